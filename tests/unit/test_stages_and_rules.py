"""Staged relations, and one expression for the rules of all fields."""

import os

from pyspark.sql import functions as F

from chartloom.functions import identity
from chartloom.plans.documents import Relations


def test_named_by_rule_is_named_field(spark):
    values = ["", None, " x ", "12/02/2023", "Féminin", "externe", "rap#7", "CFCD2O84-95D5-65EF-66E7-DFF9F98764DA", "mg/dl", "médecine  interne", "5"]
    rules = [*sorted(identity._NORMALIZERS), "none"]
    df = spark.createDataFrame([(r, v) for r in rules for v in values], "rule string, v string")
    one = identity.named_by_rule(rules[:-1], F.col("rule"), F.col("v"))
    each = F.coalesce(*(F.when(F.col("rule") == r, identity.named_field(r, F.col("v"))) for r in rules))
    assert df.where(~one.eqNullSafe(each)).count() == 0


def test_shared_relations_are_written_once_and_released(spark):
    made = []

    def base(r):
        made.append("base")
        return spark.range(5).select("id", F.lit(None).alias("nothing"))

    r = Relations({"base": base, "double": lambda r: r["base"].select((F.col("id") * 2).alias("id"))}, shared=("base",))
    assert sorted(x.id for x in r["double"].collect()) == [0, 2, 4, 6, 8] and r["base"].count() == 5 and made == ["base"]
    assert r["base"].dtypes == [("id", "bigint"), ("nothing", "string")]
    folder = r["base"].inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    r.release()
    assert not os.path.isdir(folder)
