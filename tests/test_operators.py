import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as fx
from lodestone.functions.templates import expand
from lodestone.operators import graphs, joins, state
from lodestone.operators.linediff import line_diff, modified_runs

LINES = st.lists(st.sampled_from(["a", "b", "", "stmt"]), max_size=7)


@given(LINES, LINES)
def test_line_diff_rebuilds_both_sides(a, b):
    script = line_diff(a, b)
    assert [a[i] for op, i, _ in script if op != "add"] == a
    assert [b[j] for op, _, j in script if op != "delete"] == b
    assert all(a[i] == b[j] for op, i, j in script if op == "keep")


def test_modified_runs_pair_deletes_with_adds():
    assert modified_runs(line_diff(["x", "old", "y"], ["x", "new", "more", "y"])) == [(1, 1)]


def test_scalar_functions(spark):
    row = spark.createDataFrame([("a\r\nb\n", "src/A.RS", "&mut  Foo", "x {{ a::b }} {{c}} {{c}}")], "t string, p string, k string, v string").select(
        fx.lines(F.col("t")).alias("lines"), fx.language_of(F.col("p")).alias("lang"), fx.normalize_type(F.col("k")).alias("kind"), fx.placeholders(F.col("v")).alias("names"),
        fx.line_slice(F.col("t"), F.lit(1), F.lit(9)).alias("out"), fx.subsequence(F.col("p"), "sr").alias("sub"), fx.programs_used(F.lit("ls -l | grep 'a|b' && `which vi` x")).alias("programs"),
        fx.ref_display(F.lit("0123456789abcdef0123456789abcdef01234567")).alias("ref"),
    ).first()
    assert row["lines"] == ["a\r", "b"] and row["lang"] == "Rust" and row["kind"].strip() == "Foo" and row["names"] == ["a::b", "c", "c"]
    assert row["out"] is None and row["sub"] and row["ref"] == "0123456"
    assert {"ls", "grep", "which"} <= set(row["programs"])


def test_templates_take_values_literally(spark):
    t = spark.createDataFrame([("echo {{ v }} {{v}}",)], "t string")
    got = expand(t, "t", {"v": spark.createDataFrame([("$1",), ("a\\b",)], "x string")})
    assert sorted(r["command"] for r in got.collect()) == ["echo $1 $1", "echo a\\b a\\b"]


def test_intervals_come_once_and_touching_ends_overlap(spark):
    a = spark.createDataFrame([(1, "f", 0, 100), (2, "f", 5, 4)], "i int, k string, s int, e int")
    b = spark.createDataFrame([(7, "f", 100, 300), (8, "f", 101, 102), (9, "g", 0, 9)], "i int, k string, s int, e int")
    assert [(r["l_i"], r["r_i"]) for r in joins.interval_overlap(a, b, "k", "s", "e", 10).collect()] == [(1, 7)]


def test_ttl_is_strict_and_a_log_drops_one(spark):
    log = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 3, 5)], "k string, seq int, at int")
    latest = state.latest_per_key(log, ["k"], "seq")
    assert {r["k"] for r in state.valid_at(latest, "at", F.lit(25), 20).collect()} == {"a"}
    assert {r["k"] for r in state.valid_at(latest, "at", F.lit(25), 5).collect()} == set()
    entry = spark.createDataFrame([("c", 4, 1)], "k string, seq int, at int")
    assert sorted(r["seq"] for r in state.bounded_push(log, entry, "seq", 3).collect()) == [2, 3, 4]


def test_execution_levels_and_cycles(spark):
    deps = spark.createDataFrame([("use", "listing"), ("use", "dir"), ("listing", "dir"), ("dir", None)], "node string, needs string")
    assert {r["node"]: r["level"] for r in graphs.execution_levels(deps).collect()} == {"dir": 0, "listing": 1, "use": 2}
    with pytest.raises(ValueError):
        graphs.execution_levels(spark.createDataFrame([("a", "b"), ("b", "a")], "node string, needs string"))


def test_forbidden_reach_follows_paths(spark):
    edges = spark.createDataFrame([("app1", "lib1"), ("lib1", "lib2"), ("lib2", "app2")], "a string, b string")
    kinds = spark.createDataFrame([("app1", "app"), ("app2", "app"), ("lib1", "lib"), ("lib2", "lib")], "node string, kind string")
    assert {(r["src"], r["dst"]) for r in graphs.forbidden_reach(edges, kinds, "a", "b").collect()} == {("app1", "app2"), ("lib1", "app2"), ("lib2", "app2")}


def test_ranks_are_one_to_n_over_many_rows_with_a_payload(spark):
    n = 1_200_000
    rows = spark.range(n).select((F.col("id") * 7919 % 1_000_003).alias("k"), "id", F.md5(F.col("id").cast("string")).alias("payload"))
    got = state.ranked(rows, [F.col("k").desc(), F.col("id")]).select("k", "id", "rank")
    assert tuple(got.agg(F.count("*"), F.countDistinct("rank"), F.min("rank"), F.max("rank")).first()) == (n, n, 1, n)
    w = Window.partitionBy(F.expr("rank div 1000")).orderBy("rank")
    assert got.withColumn("before", F.lag("k").over(w)).where("before < k").count() == 0
