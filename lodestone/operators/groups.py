"""Grouping operators: structural groups, exact item sets, dispatch spread, sole members, ambiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signature_groups(df: DataFrame, signature: Column, file: str, is_test: Column | None = None, size: Column | None = None, min_members: int = 2, min_test_size: int = 60) -> DataFrame:
    """Groups of rows with an equal signature: signature, members, files, cross_file, all_test.

    Groups of fewer than min_members go, and so do all-test groups whose smallest size is below min_test_size. The
    signature is hashed before the shuffle, so its length doesn't matter; counts are combined map-side.
    """
    test = F.lit(False) if is_test is None else is_test
    rows = df.select(F.sha2(signature, 256).alias("signature"), F.col(file).alias("_file"), test.alias("_test"), (F.lit(min_test_size) if size is None else size).alias("_size"))
    groups = rows.groupBy("signature").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("_file").alias("files"), F.bool_and("_test").alias("all_test"), F.min("_size").alias("_size"))
    kept = groups.where((F.col("members") >= min_members) & (~F.col("all_test") | (F.col("_size") >= min_test_size)))
    return kept.select("signature", "members", "files", (F.col("files") > 1).alias("cross_file"), "all_test")


def exact_set_groups(df: DataFrame, owner: str, item: Column, min_items: int = 3, min_owners: int = 3) -> DataFrame:
    """Owners that hold exactly the same set of at least min_items items: items (sorted), n_items, owners, first_owner.

    An owner's set is bounded by its own rows; groups hold counts only.
    """
    sets = df.select(F.col(owner).alias("_owner"), item.alias("_item")).where("_item is not null").groupBy("_owner").agg(F.array_sort(F.collect_set("_item")).alias("items"))
    sets = sets.where(F.size("items") >= min_items)
    groups = sets.groupBy("items").agg(F.count(F.lit(1)).alias("owners"), F.min("_owner").alias("first_owner"))
    return groups.where(F.col("owners") >= min_owners).select("items", F.size("items").alias("n_items"), "owners", "first_owner")


def dispatch_spread(df: DataFrame, key: str, file: str, min_sites: int = 3, min_files: int = 2) -> DataFrame:
    """Keys handled at min_sites sites or more in min_files files or more: key, sites, files."""
    found = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("sites"), F.countDistinct(file).alias("files"))
    return found.where((F.col("sites") >= min_sites) & (F.col("files") >= min_files))


def sole_production(df: DataFrame, keys: list[str], is_test: Column) -> DataFrame:
    """Keys with exactly one row that is no test and none that is."""
    found = df.groupBy(*keys).agg(F.count_if(~is_test).alias("production"), F.count_if(is_test).alias("tests"))
    return found.where("production = 1 and tests = 0").select(*keys)


def ambiguous(df: DataFrame, name: str, version: str, allowed: DataFrame | None = None) -> DataFrame:
    """Names with more than one version and not in allowed: name, versions."""
    found = df.groupBy(F.col(name).alias("name")).agg(F.countDistinct(version).alias("versions")).where("versions > 1")
    return found if allowed is None else found.join(allowed, "name", "left_anti")
