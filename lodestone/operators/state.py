"""Durable state over append-only tables: latest per key, time to live, bounded logs, roll-ups, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import cut


def latest_per_key(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the largest seq of each key. A maximum over structs, combined map-side: no key's log is sorted or held."""
    others = [c for c in log.columns if c not in keys and c != seq]
    found = log.groupBy(*keys).agg(F.max(F.struct(F.col(seq).alias(seq), *others)).alias("_last"))
    return found.select(*keys, F.col(f"_last.{seq}"), *[F.col(f"_last.{c}") for c in others])


def valid_at(entries: DataFrame, when: str, now: Column, ttl: int | None) -> DataFrame:
    """Entries with when + ttl after now, strictly; all of them without a ttl."""
    return entries if ttl is None else entries.where(F.col(when) + ttl > now)


def ttl_put(log: DataFrame, entry: DataFrame, keys: list[str], seq: str, when: str, now: Column, ttl: int | None) -> DataFrame:
    """The map after a put: latest per key, expired entries purged."""
    return valid_at(latest_per_key(log.unionByName(entry), keys, seq), when, now, ttl)


def admitted(entries: DataFrame, duration: str, least: float) -> DataFrame:
    """Cache admission: entries that took at least so long."""
    return entries.where(F.col(duration) >= least)


def last_n(log: DataFrame, seq: str, n: int) -> DataFrame:
    """The last n entries, a top-k that each partition answers first."""
    return log.orderBy(F.col(seq).desc()).limit(n)


def bounded_push(log: DataFrame, entry: DataFrame, seq: str, most: int) -> DataFrame:
    """The log after a push; where it has become longer than most, the oldest entry goes."""
    joined = log.unionByName(entry)
    over = joined.agg(F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_first"))
    return joined.crossJoin(F.broadcast(over)).where((F.col("_n") <= most) | (F.col(seq) > F.col("_first"))).drop("_n", "_first")


def approval_rollup(df: DataFrame, key: str, approved: Column) -> DataFrame:
    """key, total, approved, percent (two decimals; 0 where there is nothing), complete."""
    found = df.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(approved).alias("approved"))
    return found.select(key, "total", "approved", F.round(F.coalesce(F.try_divide(F.col("approved") * 100.0, F.col("total")), F.lit(0.0)), 2).alias("percent"), (F.col("approved") == F.col("total")).alias("complete"))


def fold_notes(df: DataFrame, key: str, order: str, text: str, author: str) -> DataFrame:
    """key, note (texts in order, one a line), authors (distinct, by first appearance), n. Null texts are skipped."""
    found = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text, author))).alias("_all"), F.count(F.lit(1)).alias("n"))
    return found.select(key, F.array_join(F.col(f"_all.{text}"), "\n").alias("note"), F.array_join(F.array_distinct(F.col(f"_all.{author}")), ",").alias("authors"), "n")


def ranked(df: DataFrame, order: list[Column], group: str | None = None, n_groups: int = 64) -> DataFrame:
    """df with rank, 1 for the first row by order. Without a group the ranking is global and still distributed:

    rows are range-partitioned by order, ranked within their partition, and shifted by the counts of the partitions before,
    of which there are at most n_groups.
    """
    if group:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    # dealt once and written: two range exchanges would each draw their own bounds
    dealt = cut(df.repartitionByRange(n_groups, *order).withColumn("_p", F.spark_partition_id()))
    local = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    shift = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_shift"))
    return local.join(F.broadcast(shift), "_p").withColumn("rank", (F.col("_r") + F.col("_shift")).cast("bigint")).drop("_p", "_r", "_shift")


def ttl_entries(log: DataFrame, keys: list[str], seq: str, gone: str | None = None) -> DataFrame:
    """All entries of the map, expired ones too; keys whose last entry is a deletion (gone is true) have none."""
    latest = latest_per_key(log, keys, seq)
    return latest if gone is None else latest.where(~F.coalesce(F.col(gone), F.lit(False)))


def ttl_delete(log: DataFrame, wanted: DataFrame, keys: list[str], seq: str, when: str, now: Column, ttl: int | None) -> tuple[DataFrame, DataFrame]:
    """(the map without the wanted keys, the entries taken out that were still valid)."""
    latest = latest_per_key(log, keys, seq)
    return latest.join(wanted.select(*keys), keys, "left_anti"), valid_at(latest.join(wanted.select(*keys).distinct(), keys, "left_semi"), when, now, ttl)


def session_choices(log: DataFrame, session: str, now: Column, variables: DataFrame | None = None, ttl: int = 86_400) -> DataFrame:
    """(var, choice) that hold in a session: the latest of each variable since the last clear, within ttl; unknown variables are left out.

    log: session, seq, action (set, clear), var, choice, when.
    """
    own = log.where(F.col("session") == session)
    cleared = own.where("action = 'clear'").agg(F.max("seq").alias("_c"))
    live = own.where("action = 'set'").crossJoin(F.broadcast(cleared)).where("_c is null or seq > _c").select("var", "seq", "choice", "when")
    found = valid_at(latest_per_key(live, ["var"], "seq"), "when", now, ttl).select("var", "choice")
    return found if variables is None else found.join(variables.select("var"), "var", "left_semi")


def rerun(log: DataFrame, seq: str, back: int = 1) -> DataFrame:
    """The entry that stands back places from the end of a log."""
    return last_n(log, seq, back).orderBy(F.col(seq).asc()).limit(1)


def next_index(names: DataFrame, key: str) -> DataFrame:
    """key, index: the number that the next window of each name takes, one more than there are."""
    return names.groupBy(key).agg((F.count(F.lit(1)) + 1).alias("index"))
