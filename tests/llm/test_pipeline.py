import hashlib
import re
import zlib
from collections import Counter

import corpus_pipeline
from lodestone.llm import queries
from tests.oracle import connect, differs

SF = "/root/testdata/sf0.001"


def test_oracles(spark):
    con = connect(SF)
    for name, sql in queries.ORACLES.items():
        assert differs(queries.QUERIES[name](spark, SF).toPandas(), con.execute(sql).fetchdf()) == ""


COLUMNS = {
    "op1_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2_winnowing": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op3_licenses": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op4_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op5_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op6_hnsw": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_substrings": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op8_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_idstore": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
}


def test_queries_return_their_columns_for_every_row(spark):
    """Names, types, ids and ranges of the registered queries, against the texts where that is cheap."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for name, columns in COLUMNS.items():
        found = queries.QUERIES[name](spark, SF)
        assert columns.items() <= dict(found.dtypes).items(), name
        rows = found.collect()
        key = "vec_id" if name == "op6_hnsw" else "doc_id"
        if name != "op6_hnsw":
            assert sorted({r[key] for r in rows}) == sorted(texts), name
        for r in rows:
            if name == "op1_simhash":
                assert len(r["fingerprint"]) == 16 and r["fingerprint"] == r["fingerprint"].lower() and r["component_id"] <= r["doc_id"]
            elif name == "op2_winnowing":
                assert r["n_chars"] == len(texts[r["doc_id"]]) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            elif name in ("op5_lm", "op8_quality"):
                folds, held = (7, 2) if name == "op5_lm" else (3, 1)
                assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held)
                assert r["score"] <= 0 if name == "op5_lm" else r["predicted"] == int(r["score"] >= 0.5)
            elif name == "op7_substrings":
                assert r["n_words"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])) >= r["n_removed"]


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, sizes = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{k}")
        sizes.append(docs.count())
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        if k == 0:
            kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
            wrong = [i for i, q in labels.items() if (i in kept) != bool(q)]
            assert len(wrong) <= 0.03 * len(labels)
        if k == 1:
            texts = Counter(hashlib.md5((r["text"] or "").lower().encode()).hexdigest() for r in docs.collect())
            assert max(texts.values()) == 1
            again = corpus_pipeline.simhash_dedup(spark, docs, SF)
            assert again.count() == docs.count()
        if k == 2:
            assert docs.count() == before.count()
            again = corpus_pipeline.substring_dedup(spark, docs, SF)
            assert again.count() == docs.count()
        if k == 3:
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= {r["doc_id"] for r in before.select("doc_id").collect()}
    assert set(docs.columns) >= {"doc_id", "piece", "sequence_id", "offset"} and sizes[-1] >= sizes[-2]


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
