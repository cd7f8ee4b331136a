"""Connected components of a link table, by alternating large-star and small-star rounds.

Links stay distributed; each round's links are written to the shared folder, and only one
number (the rows that changed) comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.shared import materialize, release, small_side


#: Links up to which the nodes' minima are broadcast (two nodes a link at most); neighbours from which a node is joined on its own.
BROADCAST_LINKS, HUB = 50_000, 20_000


def _with_least(links: DataFrame, least: DataFrame, n_links: int, spent: list[DataFrame]) -> DataFrame:
    """links(u, v) with m of least(u, m, n).

    A hub's links would all meet in one task of a shuffled join.  Few links need no shuffle; else the hubs are joined apart, by broadcast
    where their counted number allows it, and only the other nodes' links are shuffled by node.
    """
    if n_links <= BROADCAST_LINKS:
        return links.join(F.broadcast(least), "u")
    least = materialize(least, "links-least")
    spent.append(least)
    hubs = least.where(F.col("n") > HUB).select("u", F.col("m").alias("hub_m"))
    marked = links.join(small_side(hubs, hubs.count()), "u", "left")
    at_hubs = marked.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m"))
    others = marked.where("hub_m is null").select("u", "v").join(least.where(F.col("n") <= HUB).select("u", "m"), "u")
    return at_hubs.unionByName(others.select("u", "v", "m"))


def _large_star(links: DataFrame, n_links: int, spent: list[DataFrame]) -> DataFrame:
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both.where("v > u"), least, n_links, spent).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame, n_links: int, spent: list[DataFrame]) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, least, n_links, spent).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).where("a <> b")


def _sums(links: DataFrame):
    return links.agg(F.count("*"), *(F.sum(F.col(c).cast("decimal(38,0)")) for c in ("a", "b"))).first()


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs to ``(node, component)``; the component is its smallest node.

    Self links and rows with a null are ignored; nodes without a link are not returned.
    Repeated links count once.  No links: an empty result.
    """
    current = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    size = _sums(current)
    while size[0]:
        spent = [current]
        current = materialize(_small_star(_large_star(current, size[0], spent), size[0], spent).distinct(), "links")
        release(*spent)
        now = _sums(current)
        if now == size:
            break
        size = now
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.union(roots)
