"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is two minimum aggregations (combined map-side) and two equi joins. A node with
very many links would be one task of such a join: minima of nodes with more links than a bound
are broadcast instead, and their links are dealt by a hash of both ends. The bound grows with
the number of links so that at most HOT_NODES nodes exceed it, whatever the table's size.
Each round's links are written to the shared folder, which cuts the lineage; the round before
is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import free, materialize, standing


HOT_NODES = 20_000
HOT_LINKS = 64


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def _with_least(links: DataFrame, n_links: int) -> DataFrame:
    """(u, v, m): links with the least v of each u. n_links is at least the number of links."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    bound = max(HOT_LINKS, n_links // HOT_NODES)  # at most n_links / bound <= HOT_NODES nodes have more
    hot = least.where(F.col("n") > bound).select(F.col("u").alias("hu"), F.col("m").alias("hm"))
    marked = links.join(F.broadcast(hot), F.col("u") == F.col("hu"), "left")
    marked = marked.withColumn("at", F.when(F.col("hm").isNull(), F.col("u")).otherwise(F.xxhash64("v", "u")))
    return marked.join(least.select(F.col("u").alias("at"), "m"), "at", "left").select("u", "v", F.coalesce("hm", "m").alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    Null ends and self-links are ignored; repeated links count once; an empty table gives an empty table.
    """
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = materialize(both.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    mark = _mark(links)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        ways = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(ways, 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        lows = _with_least(large, 2 * mark[0])
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        small = lows.select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        at = standing()
        links = materialize(small, "links")
        before, mark = mark, _mark(links)
        free(edges.sparkSession, at - 1, (links,))
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
