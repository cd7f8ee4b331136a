"""Relational operators that the engine is built from.

Order is explicit everywhere: an operator that says "first" or "latest" takes its ordering.  Per-key choices are aggregates
(``min_by``/``max_by`` over a struct) where one row is wanted, as those combine before the shuffle and never gather a key's rows;
window functions are used only where several rows of a key stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _order(*columns: str | Column) -> Column:
    return F.struct(*columns)


def worked_out(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once a row.

    A column of ``withColumn`` is repeated in every filter that uses it, as filters move below the step that makes it; nothing moves below a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order`` (null keys are one key); one shuffle with map-side combining."""
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), _order(*order)).alias("_row"))
    return grouped.select(*keys, "_row.*").select(*df.columns)


def latest(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The row of each key with the greatest time (nulls last), then the smallest ``tie``.

    With a numeric tie it is an aggregate that combines before the shuffle.
    """
    if isinstance(df.schema[tie].dataType, T.NumericType):
        rest = [c for c in df.columns if c not in keys]
        grouped = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, -F.col(tie))).alias("_row"))
        return grouped.select(*keys, "_row.*").select(*df.columns)
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(time).desc_nulls_last(), F.col(tie))))
    return ranked.where("_n = 1").drop("_n")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts each map task's groups to ``n`` before the shuffle."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_n") <= n).drop("_n")


def last_of_series(df: DataFrame, keys: list[str], time: str, tie: str, n: int) -> DataFrame:
    """The last ``n`` points of each series with ``position`` 1..n in ascending order; unknown times count as latest."""
    backwards = Window.partitionBy(*keys).orderBy(F.col(time).desc_nulls_first(), F.col(tie).desc())
    kept = df.withColumn("_n", F.row_number().over(backwards)).where(F.col("_n") <= n)
    return kept.withColumn("position", F.max("_n").over(Window.partitionBy(*keys)) - F.col("_n") + 1).drop("_n")


def modal(df: DataFrame, keys: list[str], category: str, least: int = 1) -> DataFrame:
    """``keys, category, rows``: the category with the most rows (first by name on ties), if it has ``least`` or more."""
    counts = df.groupBy(*keys, category).agg(F.count("*").alias("rows")).where(F.col("rows") >= least)
    best = counts.groupBy(*keys).agg(F.min_by(F.struct(category, "rows"), F.struct(-F.col("rows"), category)).alias("_b"))
    return best.select(*keys, f"_b.{category}", "_b.rows")


def preferred_pool(df: DataFrame, keys: list[str], preferred: Column, least: int) -> DataFrame:
    """A key's preferred rows if it has ``least`` of them, else all its rows."""
    flagged = df.withColumn("_p", F.coalesce(preferred, F.lit(False)))
    enough = F.count_if("_p").over(Window.partitionBy(*keys)) >= least
    return flagged.withColumn("_e", enough).where(F.col("_p") | ~F.col("_e")).drop("_p", "_e")


def first_match(df: DataFrame, keys: list[str], predicate: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """``keys, name``: the value at each key's first row that satisfies a predicate, null if none does."""
    return df.groupBy(*keys).agg(F.min_by(F.when(predicate, value), F.when(predicate, _order(*order))).alias(name))


def ranked_dedup(df: DataFrame, keys: list[str], rank: list[Column], ordinal: str, source: Column) -> DataFrame:
    """One row per key, that of the highest rank (first by ordinal on ties), with its losers.

    ``duplicate_sources`` lists ``source`` of the other rows in the order in which a reader from first to last would drop
    them: a row that is beaten is listed when the better one appears.  What a row drops depends on the best before it only, a running
    maximum, so no list grows row by row.
    """
    order = Window.partitionBy(*keys).orderBy(ordinal)
    rows = df.select("*", F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)]).alias("_rank"), source.alias("_source"), F.row_number().over(order).alias("_n"))
    before = F.max(F.struct("_rank", (-F.col("_n")).alias("m"), "_source")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_b", before)
    lost = F.when(F.col("_n") > 1, F.struct("_n", F.when(F.col("_rank") > F.col("_b._rank"), F.col("_b._source")).otherwise(F.col("_source")).alias("s")))
    rest = [c for c in df.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_rank", -F.col("_n"))).alias("_row"), F.array_sort(F.collect_list(lost)).alias("_lost"))
    return best.select(*keys, "_row.*", F.transform("_lost", lambda x: x["s"]).alias("duplicate_sources"))


def fallback_union(relations: list[DataFrame], key: str) -> DataFrame:
    """Per key the rows of the first relation that has any; ``tier`` tells which (1 the first).  Rows without a key fall out."""
    tiers = [r.withColumn("tier", F.lit(i + 1)) for i, r in enumerate(relations)]
    everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tiers).where(F.col(key).isNotNull())
    # a window, so that no relation is worked out a second time to learn which keys it has
    return everything.withColumn("_best", F.min("tier").over(Window.partitionBy(key))).where("tier = _best").drop("_best")


def look_up(df: DataFrame, dimension: DataFrame, on: list[tuple[str, str]], values: dict[str, object], order: list[str] | None = None) -> DataFrame:
    """Left join to a dimension's first row by key, with defaults for what is missing or empty.

    Of several rows of a key the first by ``order`` counts, whole; without an order the smallest by its values.
    """
    right_keys = [b for _, b in on]
    row = F.struct(*values)
    side = dimension.groupBy(*right_keys).agg((F.min_by(row, _order(*order)) if order else F.min(row)).alias("_row")) if values else dimension
    side = side.select(*(F.col(b).alias(f"_k{i}") for i, b in enumerate(right_keys)), *(["_row.*"] if values else []))
    joined = df.join(side, [F.col(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(on)], "left")
    return joined.select(*df.columns, *(F.coalesce(v, F.lit(d)).alias(v) for v, d in values.items()))


def band_join(anchors: DataFrame, items: DataFrame, keys: list[str], start: str, end: str, at: str) -> DataFrame:
    """Items whose position lies in an anchor's half-open band [start, end) of the same keys."""
    return anchors.join(items, keys).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))


def near_join(left: DataFrame, right: DataFrame, keys: list[str], at: Column, other: Column, reach: float) -> DataFrame:
    """Pairs of rows of the same keys whose positions ``at`` (of left) and ``other`` (of right) differ by ``reach`` at most.

    Positions are cut into bins of that width; a left row goes to its own and both neighbouring bins, so rows meet on an equality and far ones never do.
    """
    cell = lambda c: F.floor(c / reach)
    a = left.withColumn("_at", at).withColumn("_cell", F.explode(F.sequence(cell(F.col("_at")) - 1, cell(F.col("_at")) + 1)))
    b = right.withColumn("_other", other).withColumn("_cell", cell(F.col("_other")))
    return a.join(b, [*keys, "_cell"]).where(F.abs(F.col("_at") - F.col("_other")) <= reach).drop("_at", "_other", "_cell")


def two_key_match(df: DataFrame, facts: DataFrame, keys: list[str], alternatives: list[list[Column]], on: list[str], value: str, order: str) -> DataFrame:
    """Left join to facts that are known under several forms of one key; adds ``value`` and ``matched``.

    ``alternatives`` are the forms of the key ``on``, in the order in which a row of ``facts`` writes them; of all that write one key the last by ``order``, and of one row's forms the later, counts.
    """
    forms = F.array(*(F.struct(F.lit(i).alias("form"), *(c.alias(n) for c, n in zip(form, on))) for i, form in enumerate(alternatives)))
    written = facts.select(*keys, F.col(value).alias("_value"), F.col(order).alias("_order"), F.explode(forms).alias("_f")).select(*keys, "_value", F.struct("_order", "_f.form", "_value").alias("_order"), *(F.col(f"_f.{n}").alias(f"_k{i}") for i, n in enumerate(on)))
    known = written.groupBy(*keys, *(f"_k{i}" for i in range(len(on)))).agg(F.max_by(F.struct("_value"), "_order").alias("_hit"))
    known = known.select(*(F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)), *(f"_k{i}" for i in range(len(on))), "_hit")
    same = [F.col(k) == F.col(f"_g{i}") for i, k in enumerate(keys)] + [F.col(n).eqNullSafe(F.col(f"_k{i}")) for i, n in enumerate(on)]
    joined = df.join(known, same, "left")
    return joined.select(*df.columns, F.col("_hit._value").alias(value + "_found"), F.col("_hit").isNotNull().alias("matched"))


def unpivot_pairs(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys, field, value``: one row per column, values as strings."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(*keys, pairs.alias("_p")).select(*keys, "_p.*")


def pairs_to_map(df: DataFrame, keys: list[str], field: str, value: str, ordinal: str) -> DataFrame:
    """Per key a map of field to value; of repeated fields the last by ordinal counts."""
    single = df.groupBy(*keys, field).agg(F.max_by(value, ordinal).alias(value))
    return single.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, value)))).alias("fields"))


def pair_lines(lines: Column) -> Column:
    """(at, name, value) of each line that is followed by one that begins with ':'.

    A line that served as a value does not begin a pair: in a run of ':' lines only every other one can.
    """
    start = F.struct(F.lit(False).alias("used"), F.array().cast("array<struct<at:int,name:string,value:string>>").alias("out"))
    ends = F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("i"), F.get(lines, i + 1).alias("after")))

    def step(acc: Column, x: Column) -> Column:
        begins = ~acc["used"] & F.coalesce(x["after"].startswith(":"), F.lit(False))
        pair = F.struct(x["i"].alias("at"), x["line"].alias("name"), x["after"].alias("value"))
        return F.struct(begins.alias("used"), F.when(begins, F.array_append(acc["out"], pair)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ends, start, step)["out"]


def set_agreement(final: Column, earlier: Column) -> Column:
    """How a final set of names agrees with an earlier one."""
    none_final, none_earlier = F.size(final) == 0, F.size(earlier) == 0
    same = (F.size(F.array_except(final, earlier)) == 0) & (F.size(F.array_except(earlier, final)) == 0)
    return (
        F.when(none_earlier, "consistent")
        .when(none_final, "needs_review")
        .when(same, "consistent")
        .when(F.arrays_overlap(final, earlier), "partial_overlap")
        .otherwise("discordant_findings")
    )


def diff_tables(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Where two tables differ, cell by cell: ``keys, field, reason, expected, actual``.

    Rows are matched by ``keys`` (null equals null) in a full outer join.  Reasons: ``missing_row`` and ``extra_row`` (field null), ``missing_column`` (a field that actual lacks), ``missing_value``,
    ``extra_value``, ``different_value``.  Values are compared as JSON where they are nested, as strings otherwise.
    """
    shown = lambda df, c: F.to_json(F.struct(F.col(c).alias("v"))) if dict(df.dtypes)[c].startswith(("struct", "array", "map")) else F.col(c).cast("string")
    fields = [c for c in expected.columns if c not in keys]
    a = expected.select(*(F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)), F.array(*(shown(expected, c) for c in fields)).cast("array<string>").alias("_want"))
    b = actual.select(*(F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)), F.array(*(shown(actual, c) if c in actual.columns else F.lit(None) for c in fields)).cast("array<string>").alias("_have"))
    joined = a.join(b, [F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(keys))], "full")
    cell = lambda field, reason, want, have: F.struct(field.cast("string").alias("field"), F.lit(reason).alias("reason") if isinstance(reason, str) else reason.alias("reason"), want.alias("expected"), have.alias("actual"))
    none = F.lit(None).cast("string")
    cells = []
    for i, c in enumerate(fields):
        want, have = F.get("_want", F.lit(i)), F.get("_have", F.lit(i))
        reason = F.lit("missing_column") if c not in actual.columns else F.when(have.isNull(), "missing_value").when(want.isNull(), "extra_value").otherwise("different_value")
        cells.append(F.when(~want.eqNullSafe(have), cell(F.lit(c), reason, want, have)))
    found = F.when(F.col("_have").isNull(), F.array(cell(none, "missing_row", none, none))).when(F.col("_want").isNull(), F.array(cell(none, "extra_row", none, none))).otherwise(F.array_compact(F.array(*cells)) if cells else F.array().cast("array<struct<field:string,reason:string,expected:string,actual:string>>"))
    return joined.select(*(F.coalesce(f"_a{i}", f"_b{i}").alias(k) for i, k in enumerate(keys)), F.explode(found).alias("_d")).select(*keys, "_d.*")
