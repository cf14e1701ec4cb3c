"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the mixture over its share of the
corpus. Each row draws its number of copies by inverting a Poisson distribution at a number
that a hash of its key gives, so a run repeats exactly, and copies are then ordered by a
second hash over the whole table. Only built-in expressions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import enough_partitions, materialize

STEPS = 2.0**52
HOT_SOURCES = 1_000


def uniform(key: Column, salt: str) -> Column:
    """A double in [0, 1): the first 52 bits of the MD5 of salt and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), key)), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(STEPS)


def poisson_steps(rate: Column) -> Column:
    """struct<first, steps>: P(X <= k) for k = first, first + 1, ... up to where a 52-bit number can't reach.

    Below first lies less than 1e-30 of the distribution. The first probability is added up in logarithms, so no rate underflows.
    """
    reach = 12 * F.sqrt(rate) + 60
    first = F.greatest(F.lit(0), F.ceil(rate - reach).cast("int"))
    logs = F.when(first > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(first, F.lit(1))), F.lit(0.0), lambda acc, k: acc + F.log(rate / k))).otherwise(0.0)
    p = F.exp(logs - rate)
    start = F.named_struct(F.lit("p"), p, F.lit("total"), p, F.lit("all"), F.array(p))
    grow = lambda acc, k: F.named_struct(F.lit("p"), acc["p"] * rate / k, F.lit("total"), acc["total"] + acc["p"] * rate / k, F.lit("all"), F.concat(acc["all"], F.array(acc["total"] + acc["p"] * rate / k)))
    steps = F.aggregate(F.sequence(first + 1, F.ceil(rate + reach).cast("int")), start, grow, lambda acc: acc["all"])
    return F.struct(first.alias("first"), steps.alias("steps"))


def rates(docs: DataFrame, weights: dict[str, float] | None, source_col: str = "source", epochs: float = 1.0, temper: float = 0.5) -> DataFrame:
    """(source, n, rate) per source, null included: target rows over rows. Without weights a source's target is its count to the power temper:
    1 keeps the corpus as it is, 0 makes all sources alike.

    Sources with no weight given get rate 0. Targets of sources that have no rows are left out and the rest scaled up,
    so the mixture's mean size is epochs times the corpus.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(temper))
    else:
        if any(w < 0 or not math.isfinite(w) for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        table = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(table, F.col("source")), F.lit(0.0))
    counts = counts.withColumn("weight", weight)
    total = counts.agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).first()  # two numbers
    scale = F.lit(float(epochs) * (total["n"] or 0))
    return counts.select("source", "n", F.coalesce(F.try_divide(F.col("weight") * scale, F.lit(float(total["w"] or 0.0)) * F.col("n")), F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id", seed: int = 42, epochs: float = 1.0, temper: float = 0.5) -> DataFrame:
    """docs with each row repeated by its draw, ordered by a global hash; adds mix_copy (from 0), mix_copies and mix_key.

    Rows that draw 0 are left out: that is the method. Null sources are a source of their own; a null id draws as the
    text 'null' does; rows that repeat an id draw alike. Columns of docs named like the added ones are replaced.

    The steps of at most HOT_SOURCES sources with the most rows are broadcast, which is all of them unless there are more; the others
    have few rows each and are joined. The order's key is a uniform hash, so ranges of equal size are known without a sample of
    the rows and one shuffle of the copies is all.
    """
    docs = docs.drop("mix_copy", "mix_copies", "mix_key")
    names = docs.columns
    drawing = rates(docs, weights, source_col, epochs, temper).withColumn("_mix", F.when(F.col("rate") > 0, poisson_steps(F.col("rate"))))
    steps = materialize(drawing.select(F.col("source").alias("_mix_source"), F.col("_mix.first").alias("_mix_first"), F.col("_mix.steps").alias("_mix_steps"), F.col("n").alias("_mix_n")), "steps")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    u = uniform(key, f"draw-{seed}")
    same = F.col(source_col).eqNullSafe(F.col("_mix_source"))
    if steps.count() <= HOT_SOURCES:
        drawn = docs.join(F.broadcast(steps), same)
    else:
        top = steps.orderBy(F.col("_mix_n").desc(), "_mix_source").limit(HOT_SOURCES)
        hot = F.broadcast(top)
        rest = docs.join(hot.select("_mix_source"), same, "left_anti")
        drawn = docs.join(hot, same).unionByName(rest.join(steps, same))
    n = F.coalesce(F.col("_mix_first") + F.size(F.filter("_mix_steps", lambda c: c <= u)), F.lit(0))
    # a row of no copies explodes to none; a filter in its place would be pushed below the join, to a side that lacks the id
    places = F.when(F.col("mix_copies") > 0, F.sequence(F.lit(0), F.col("mix_copies") - 1))
    copies = drawn.withColumn("mix_copies", n).select(*names, "mix_copies", F.explode(places).alias("mix_copy"))
    keyed = copies.withColumn("mix_key", F.md5(F.concat(F.lit(f"order-{seed}:"), key, F.lit(":"), F.col("mix_copy").cast("string"))))
    ranges = enough_partitions(docs)
    place = F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("bigint") * F.lit(ranges)
    dealt = keyed.repartitionById(ranges, F.shiftrightunsigned(place, 32).cast("int"))
    return dealt.sortWithinPartitions("mix_key").select(*names, "mix_copy", "mix_copies", "mix_key")
