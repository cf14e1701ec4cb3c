import random

from pyspark.sql import functions as F

from lodestone.operators.setjoin import set_members, set_pairs
from lodestone.operators.similarity import array_sets
from lodestone.plans import catalog


def drawn(seed=3):
    r = random.Random(seed)
    sets, k = {}, 0
    for n in (0, 1, 3, 4, 5, 7, 10, 20, 60, 150, 400, 700):
        for _ in range(12):
            base = [int(10_000 * r.random() ** 4) for _ in range(3 * n)]
            base = list(dict.fromkeys(base))[:n]
            for share in (0, 0, 0.03, 0.08, 0.16, 0.3):
                sets[k] = sorted({w if r.random() >= share else 20_000 + r.randrange(10**6) for w in base})
                k += 1
    return sets


def test_pairs_and_classes_as_by_brute_force(spark):
    sets = drawn()
    df = spark.createDataFrame([(k, s) for k, s in sets.items()], "owner bigint, features array<bigint>").repartition(5)
    rep = {}
    for k, s in sets.items():
        if len(s) >= 4:
            rep.setdefault(tuple(s), k)
    classes = [(k, set(s)) for s, k in rep.items()]
    want = []
    for i, (a, x) in enumerate(classes):
        for b, y in classes[i + 1 :]:
            shared = len(x & y)
            if shared >= 4 and shared >= 0.7 * len(x | y) - 1e-9:
                want.append((a, b, shared, len(x | y)))
    assert len(want) > 200
    assert sorted(map(tuple, set_pairs(df).collect())) == sorted(want)
    assert sorted(map(tuple, set_members(df).collect())) == sorted((k, rep[tuple(s)]) for k, s in sets.items() if len(s) >= 4)


def test_no_pairs_of_no_sets(spark):
    assert set_pairs(spark.createDataFrame([(1, [1, 2])], "owner bigint, features array<bigint>")).count() == 0
    assert set_pairs(spark.createDataFrame([(1, [1, 2, 3, 4])], "owner bigint, features array<bigint>")).count() == 0


def test_rows_of_one_owner_make_one_set(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "a", None]), (1, ["b", "d"]), (3, None), (None, ["e"]), (None, ["f"])], "id bigint, words array<string>")
    got = {r["owner"]: r["features"] for r in array_sets(rows, "id", F.col("words")).collect() if r["features"] is not None}
    of = lambda *words: sorted(spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).toPandas().iloc[:, 0].tolist())
    assert got == {1: of("a", "b", "d"), 2: of("a", "c"), None: of("e", "f")}


def test_near_dup_docs_ships_no_sets_for_each_pair(spark, tmp_path):
    r = random.Random(5)
    words = [f"w{k}" for k in range(1500)]
    texts = [(k, " ".join(w if r.random() > 0.05 else f"x{r.randrange(10**9)}" for w in words)) for k in range(120)]
    spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    shuffled = lambda: sum(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False))[0].totalShuffleWrite() for _ in (1,))
    before = shuffled()
    now = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert catalog.QUERIES["near_dup_docs"](spark, str(tmp_path)).count() == 120 * 119 // 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", now)
    assert shuffled() - before < 10 * sum(len(t) for _, t in texts)
