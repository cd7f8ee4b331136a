"""What is costly for a row is worked out once for it, and rows that become documents are dealt over all cores."""

from pyspark.sql import functions as F

from chartloom import queries, rendered
from chartloom.operators import relational as rel
from chartloom.plans import ocr_tables, tables

STEP = "array_distinct(filter(transform("  # the first step of a table's normalisation


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _customers(spark, n):
    return spark.range(n).select(F.col("id").alias("c_custkey"), F.lit("Ann").alias("c_name"), F.lit("X").alias("c_mktsegment"))


def _counted(spark, df):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def marked(x):
        seen.add(1)
        return x

    return df.withColumn("name", marked.asNondeterministic()("name")), seen


def test_a_filter_on_the_role_does_not_repeat_the_normalisation(spark):
    found = tables.normalized(rendered.raw_tables(_customers(spark, 2))).where("table_role = 'results_table'").select("doc_id", F.posexplode("records"))
    assert _plan(found).count(STEP) == 1 and found.count() == 8


def test_filters_of_recognised_rows_do_not_repeat_what_they_test(spark):
    rows = ocr_tables.result_rows(rendered.ocr_pages(_customers(spark, 2)))
    assert all("regexp" not in line for line in _plan(rows).split("\n") if line.strip(" +-:*()0123456789").startswith("Filter") and "reference" in line)
    assert rows.count() == 6


def test_a_fallback_reads_each_relation_once(spark):
    first, seen = _counted(spark, spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "doc_id int, name string").repartition(1))
    second = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id int, name string")
    found = sorted(tuple(r) for r in rel.fallback_union([first, second], "doc_id").select("doc_id", "name", "tier").collect())
    assert found == [(1, "a", 1), (1, "b", 1), (2, "y", 2)] and seen.value <= 3


def test_customers_of_one_row_group_are_dealt_over_all_cores(spark, tmp_path):
    _customers(spark, 1000).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    rows = queries.queries()["table_duplicates"](spark, str(tmp_path))
    tasks = queries._spread(spark.read.parquet(str(tmp_path / "customer.parquet"))).select(F.spark_partition_id().alias("p")).distinct().count()
    assert rows.count() == 4000 and tasks >= spark.sparkContext.defaultParallelism
    assert "Exchange hashpartitioning(c_custkey" in _plan(rows)


def test_blocks_of_a_stool_report_label_lines_once_and_look_fields_up_once(spark):
    from chartloom.plans import segments

    lines = spark.createDataFrame([("a", 1, ["Origine : Externe"], "native")], "doc_id string, page_number int, lines array<string>, text_source string")
    plan = segments.stool_blocks(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9]+") <= 11 and plan.count("^Origine") <= 5  # 26 and 20 with a label for each title and values repeated
