"""Graphs over edge tables: depth, closure, blast radius, forbidden reach, execution order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.shared import cut


def closure(edges: DataFrame, source: str, target: str, max_rounds: int = 64) -> DataFrame:
    """(src, dst): all pairs joined by a path of one edge or more. Paths double every round, so rounds grow as the log of the longest.

    The result is a closure and may itself be large; it is meant for dependency graphs. Rounds end when nothing is new.
    """
    found = edges.select(F.col(source).alias("src"), F.col(target).alias("dst")).where("src is not null and dst is not null").distinct()
    n = found.count()
    for _ in range(max_rounds):
        hop = found.alias("a").join(found.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        found = cut(found.unionByName(hop).distinct())
        before, n = n, found.count()
        if n == before:
            return found
    raise RuntimeError(f"closure did not settle in {max_rounds} rounds")


def chain_depth(nodes: DataFrame, key: str, step: str) -> DataFrame:
    """key, depth: length of the chain step 0, 1, 2, ... of each key, ended by the first gap. Linear, without recursion.

    In a chain without gaps the step equals the number of distinct smaller steps, so the depth counts the steps for which
    that holds.
    """
    from pyspark.sql import Window

    place = F.dense_rank().over(Window.partitionBy(key).orderBy(step)) - 1
    return nodes.select(key, step).distinct().withColumn("_place", place).where(F.col(step) == F.col("_place")).groupBy(key).agg(F.count(F.lit(1)).alias("depth"))


def blast_radius(calls: DataFrame, references: DataFrame, item: str) -> DataFrame:
    """item, callers, callees, outside_refs, total for every item: calls (caller, callee), references (item, path, home)."""
    callers = calls.groupBy(F.col("callee").alias(item)).agg(F.countDistinct("caller").alias("callers"))
    callees = calls.groupBy(F.col("caller").alias(item)).agg(F.countDistinct("callee").alias("callees"))
    outside = references.where("path <> home").groupBy(item).agg(F.count(F.lit(1)).alias("outside_refs"))
    all_items = calls.select(F.col("caller").alias(item)).unionByName(calls.select(F.col("callee").alias(item))).unionByName(references.select(item)).distinct()
    found = all_items.join(callers, item, "left").join(callees, item, "left").join(outside, item, "left").na.fill(0)
    return found.withColumn("total", F.col("callers") + F.col("callees") + F.col("outside_refs"))


def forbidden_reach(edges: DataFrame, kinds: DataFrame, source: str, target: str) -> DataFrame:
    """(src, dst) of the closure where an app reaches another app or a library reaches an app. kinds: node, kind."""
    k = lambda c: kinds.select(F.col("node").alias(c), F.col("kind").alias(f"{c}_kind"))
    found = closure(edges, source, target).join(k("src"), "src").join(k("dst"), "dst")
    return found.where("src <> dst and dst_kind = 'app' and src_kind in ('app', 'lib')").select("src", "dst")


def execution_levels(deps: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, level): level 0 needs nothing, every node stands above all it needs. deps: node, needs (null for none).

    Raises ValueError on a cycle: a round that settles no node.
    """
    edges = cut(deps.where("needs is not null").select("node", "needs").distinct())
    left = cut(deps.select("node").unionByName(edges.select(F.col("needs").alias("node"))).distinct())
    done = None
    for level in range(max_rounds):
        open_edges = edges.join(left.select(F.col("node").alias("needs")), "needs", "left_semi")
        free = cut(left.join(open_edges, "node", "left_anti").withColumn("level", F.lit(level)))
        if not free.limit(1).count():
            if left.limit(1).count():
                raise ValueError("the dependencies hold a cycle")
            break
        done = free if done is None else done.unionByName(free)
        left = cut(left.join(free, "node", "left_anti"))
    return done if done is not None else left.withColumn("level", F.lit(0))
