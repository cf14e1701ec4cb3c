"""Each operator against brute force on small tables, and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import common, hnsw, idstore, licenses, lm, mixing, packing, quality, simhash, substrings, tokens, winnowing
from lodestone.llm.components import connected_components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def made_texts(seed=3):
    """Prose with exact copies, near copies, shared passages, odd characters, empty and long texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("etaoin shrdlué"[0:14].replace(" ", "")) for _ in range(rnd.randint(1, 7)))
    prose = lambda n: [word() for _ in range(n)]
    passage = prose(70)
    texts = [" ".join(prose(rnd.randint(1, 260))) for _ in range(40)]
    texts += [texts[0], texts[1], texts[1]]
    for k in range(2, 12):
        w = prose(200)
        texts.append(" ".join(w))
        w[rnd.randrange(200)] = "changed"
        texts.append("\n".join(w))
    texts += [" ".join(prose(9) + passage + prose(k)) for k in range(8)] + [" ".join(passage[:50]), " ".join(passage[:49]), " ".join(passage * 3)]
    texts += ["", None, " \t\n", "one", "Licensed under the MIT License. All rights reserved.", "x" * 50_000, "é ü 日本 ok\x0b\x0cfine", "a " * 3000, "don't  stop\n\nnow  ", "ends<|endoftext|> here"]
    return texts


@pytest.fixture(scope="module")
def texts():
    return made_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(3 * i + 1, t, "en", None if i == 5 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, all columns null, columns named like outputs."""
    rows = [(None, "no id at all"), (5, "same row twice"), (5, "same row twice"), (5, "other text, same id"), (7, None), (None, None), (8, "")]
    return spark.createDataFrame([(i, t, None, None, None, "x", 1) for i, t in rows], SCHEMA + ", component_id string, length int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (7, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


def reference_simhash(text, n=4):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(low)
    sh = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash_matches_brute_force(docs, texts):
    got = {r["id"]: (r["fp"] & (1 << 64) - 1, r["component"]) for r in simhash.near_duplicates(docs).collect()}
    fps = [reference_simhash(t) for t in texts]
    root = components(len(fps), [(a, b) for b in range(len(fps)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert got == {3 * i + 1: (fps[i], 3 * root[i] + 1) for i in range(len(fps))}
    assert any(r != i for i, r in enumerate(root))


def test_simhash_in_chunks_of_a_hot_bucket_gives_the_same(docs):
    rows = lambda **k: sorted(map(tuple, simhash.near_duplicates(docs, **k).collect()))
    assert rows(max_bucket=3) == rows()


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 10])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(3)])
    end = np.repeat([90, 240], [90, 150])
    links = [(i, j) for i in range(240) for j in range(i + 1, end[i]) if int(fps[i] ^ fps[j]).bit_count() <= radius]
    assert simhash.bit_sliced_links(fps, end, radius).flatten().tolist() == components(240, links)


def test_simhash_odd_rows(odd, nothing):
    got = sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=str)
    assert len(got) == 7 and Counter(r[0] for r in got) == Counter([None, None, 5, 5, 5, 7, 8])
    assert {r[2] for r in got if r[1] == 0} == {7}  # the null text, the empty one and the row without an id
    assert simhash.near_duplicates(nothing).count() == 0


def test_similar_documents_catch_near_copies_and_leave_the_rest(spark):
    rnd = random.Random(5)
    prose = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    rows = []
    for k in range(30):
        w = prose(300)
        rows.append((2 * k, " ".join(w)))
        w[rnd.randrange(300)] = w[rnd.randrange(300)] = "zz"
        rows.append((2 * k + 1, " ".join(w)))
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows + [(None, "x"), (900, "p"), (900, "p")], "doc_id bigint, text string"))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([2 * k for k in range(30)] + [900, None], key=str)


def test_similar_documents_are_exactly_those_alike_at_the_likeness(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    texts = []
    for n in [8, 9, 12, 16, 20, 24, 30, 34, 36, 40, 80, 300] * 8:
        w = [word() for _ in range(n)]
        texts.append(w)
        for _ in range(3):  # copies around the likeness: some words more at the end, one word changed every so often
            copy = w + [word() for _ in range(rnd.randrange(n // 3 + 1))]
            if rnd.random() < 0.5 and n > 30:
                for at in range(rnd.randrange(20), n, 30 + rnd.randrange(20)):
                    copy[at] = word()
            texts.append(copy)
    base = [word() for _ in range(100)]
    texts += [base[:k] + [word() for _ in range(100 - k)] for k in (70, 75, 80, 85, 88, 90, 92, 95) for _ in range(12)]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    edges = [(i, k) for i in range(len(sets)) for k in range(i) if len(sets[i] & sets[k]) / len(sets[i] | sets[k]) >= 0.8]
    root = list(range(len(sets)))
    for _ in range(len(sets)):
        before = list(root)
        for i, k in edges:
            root[i] = root[k] = min(root[i], root[k])
        if root == before:
            break
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    got = {r["id"]: r["component"] for r in simhash.similar_documents(docs).collect()}
    wrong = [i for i in got if got[i] != root[i]]
    assert len(got) == len(texts) and wrong == []
    few = spark.createDataFrame([(0, "a b c d e f g h"), (1, "a b c d e f g i"), (2, "a b c d e f g h"), (3, ""), (4, None)], "doc_id bigint, text string")
    assert {tuple(r) for r in simhash.similar_documents(few).collect()} == {(0, 0), (1, 1), (2, 0), (3, 3), (4, 3)}


def test_short_texts_that_share_most_words_are_linked_only_at_the_likeness(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(34)]
    texts = []
    for _ in range(150):  # one to three words of one text changed: likenesses from 0.5 to 1, of which few are links
        copy = list(base)
        for at in rnd.sample(range(34), rnd.choice([1, 2, 2, 3, 3])):
            copy[at] = word()
        texts.append(copy[: rnd.choice([34, 34, 36, 30])])
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    edges = [(i, k) for i in range(len(sets)) for k in range(i) if len(sets[i] & sets[k]) / len(sets[i] | sets[k]) >= 0.8]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    got = {r["id"]: r["component"] for r in simhash.similar_documents(docs, max_bucket=40).collect()}
    want = components(len(sets), edges)
    assert 1 < len(set(want)) and [got[i] for i in range(len(sets))] == want


@pytest.mark.parametrize("chunks", [1, 2])
def test_links_of_a_group_are_the_alike_pairs_between_components(chunks):
    rnd = random.Random(12)
    base = rnd.sample(range(1 << 40), 30)
    sets = [sorted(set(rnd.sample(base, rnd.randrange(18, 31))) | {rnd.randrange(1 << 40) for _ in range(rnd.randrange(3))}) for _ in range(80)]
    n, known, own = np.array(list(map(len, sets))), np.arange(80) // 2, np.arange(80) % chunks
    a, b = simhash.alike_links(np.zeros((80, 2), np.uint64), n, known, own, np.concatenate(sets), 0, 0.8)
    like = lambda i, k: len(set(sets[i]) & set(sets[k])) / len(set(sets[i]) | set(sets[k]))
    want = [(i, k) for i in range(80) for k in range(i) if known[i] != known[k] and (chunks == 1 or own[i] != own[k]) and like(i, k) >= 0.8]
    assert want and components(80, zip(a.tolist(), b.tolist())) == components(80, want)


def test_dropping_near_duplicates_judges_rows_that_repeat_an_id_by_their_texts(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a), (1, b), (2, c), (3, b), (4, a), (5, c), (5, "alone"), (6, "twice"), (6, "twice")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(tuple(r) for r in kept.collect()) == [(1, a), (1, b), (2, c), (5, "alone"), (6, "twice")]


def winnowed(text, k=5, w=8):
    rot = lambda h, b: ((h << b) | (h >> (64 - b))) & (1 << 64) - 1
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]

    def gram(xs):
        a = 0
        for x in xs:
            a = rot(a, 1) ^ x
        return a - (a >> 63 << 64)  # signed, as the engine keeps and compares it

    g = [gram(h[i : i + k]) for i in range(len(h) - k + 1)] if len(h) >= k else [gram(h)] if h else []
    out = []
    for r in [range(i, i + w) for i in range(len(g) - w + 1)] or ([range(len(g))] if g else []):
        j = max(i for i in r if g[i] == min(g[x] for x in r))
        if (g[j], j) not in out[-1:]:
            out.append((g[j], j))
    return out


def test_winnowing_matches_brute_force(docs, texts):
    got = {r["doc_id"]: [(x["hash"], x["position"]) for x in r["fingerprint"]] for r in winnowing.document_fingerprints(docs).collect()}
    assert got == {3 * i + 1: winnowed(t) for i, t in enumerate(texts)}


def test_edits_follow_descending_ids(docs, texts):
    got = {r["doc_id"]: r for r in winnowing.edit_likeness(docs).collect()}
    likeness = lambda a, b: 1.0 if not a and not b else len({x for x, _ in a} & {x for x, _ in b}) / len({x for x, _ in a} | {x for x, _ in b})
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[3 * i + 1]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert math.isclose(r["near_edited"], likeness(winnowed(t), winnowed(edited))) and math.isclose(r["near_next"], likeness(winnowed(t), winnowed(after)))


def test_winnowing_plans_and_gives_the_same_rows_at_many_partitions(spark, docs, texts):
    got = sorted(map(tuple, winnowing.edit_likeness(docs).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5000")
    try:
        many = winnowing.edit_likeness(docs)
        assert sorted(map(tuple, many.collect())) == got
        # ids of 5000 ranges: all cut points and guests are in the plan
        wide = winnowing.edit_likeness(spark.range(20_000).selectExpr("id as doc_id", "cast(id as string) as text"))
        assert len(wide._jdf.queryExecution().executedPlan().toString()) > 0
        assert wide.where("doc_id = 17").first()["near_next"] == 0.0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_winnowing_is_native_and_takes_odd_rows(odd, nothing):
    plan = winnowing.edit_likeness(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|BatchEval", plan)
    assert winnowing.edit_likeness(odd).count() == 7 and winnowing.edit_likeness(nothing).count() == 0
    assert winnowing.edit_likeness(odd.where("doc_id = 8")).first()["near_next"] == 1.0


def test_license_places(docs, texts):
    got = {r["doc_id"]: r for r in licenses.license_digest(licenses.scan_licenses(docs)).collect()}
    i = next(k for k, t in enumerate(texts) if t and t.startswith("Licensed"))
    r = got[3 * i + 1]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == (8, 1, 5, 5, "reserved", "mit,reserved", 1.0)
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        at = [a for p in licenses.PHRASES for a in range(len(w)) if w[a : a + len(p.split())] == p.split()]
        assert (got[3 * k + 1]["n_words"], got[3 * k + 1]["n_base"]) == (len(w), len(at))


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
        ("is licensed under the GNU Lesser General Public License", {"lgpl"}),
        ("Distributed under the terms of the Apache License, 2.0", {"apache-2.0"}),
        ("Licensed under the Apache License, Version 3.0", set()),
        ("Copyright (c) 2020 Some One. All rights reserved.", {"copyright-notice"}),
        ("SPDX-License-Identifier: MIT", {"spdx"}),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", set()),
        ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", {"apache-2.0", "apache-2.0-notice"}),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", {"gpl-3.0-notice"}),
        ("Permission to use, copy, alter, and distribute this software for any purpose with or without fee is hereby granted", set()),
    ],
)
def test_templates_accept_exact_mandatory_wording_only(text, labels):
    assert {x[2] for x in licenses.Scanner().scan("so " + text + " and on")[2]} == labels


def filled(markup):
    """A text of a template: optional wording kept, open regions filled."""
    markup = re.sub(r"<<(begin|end)Optional>>", " ", markup)
    return re.sub(r"<<var;[^>]*match=([^>]*)>>", lambda m: "some one" if re.fullmatch(r"\d+-\d+", m[1]) else m[1].split("|")[0], markup)


@pytest.mark.parametrize("label", ["mit", "isc", "0bsd", "bsd-2-clause", "bsd-3-clause", "zlib", "bsl-1.0", "unlicense"])
def test_whole_license_texts_with_a_word_changed_anywhere_are_not_accepted(label):
    rnd = random.Random(label)
    markup = next(m for x, m in licenses.TEMPLATES if x == label)
    words = filled(markup).split()
    scan = lambda w: {x[2] for x in licenses.Scanner().scan(" ".join(["so", *w, "on"]))[2]} - {"copyright-notice"}
    assert scan(words) == {label}
    last = len(words) - 1
    for at in [last, *rnd.sample(range(30, last), 12)]:
        if any(c.isalpha() for c in words[at]) and words[at] not in ("some", "one") and not words[at].strip("1234567890.").startswith("(including"):
            assert label not in scan([*words[:at], "otherwise-put", *words[at + 1 :]]) or "Optional" in markup and at < 60
    assert scan(words[:-4]) == set()


def test_template_markup():
    auto = licenses.compile_template("t", "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> <<var;name=x;match=1-2>> z")
    accepts = {s: auto.match(licenses.words_of(s), 0) for s in ("a q z", "a b q z", "a b c q r z", "a z", "a b c q r s z", "a c d z")}
    assert accepts == {"a q z": 3, "a b q z": 4, "a b c q r z": 6, "a z": -1, "a b c q r s z": -1, "a c d z": 4}
    for bad in ("a <<beginOptional>> b", "a <<endOptional>>"):
        with pytest.raises(ValueError):
            licenses.compile_template("t", bad)


def test_licenses_odd_rows(odd, nothing):
    assert licenses.license_digest(licenses.scan_licenses(odd)).count() == 7 and licenses.scan_licenses(nothing).count() == 0


@pytest.mark.parametrize("as_text", [False, True])
@pytest.mark.parametrize(("file", "by"), [("byte_bpe_50k.json", "blanks"), ("word_bpe_49k.json", "words")])
def test_pieces_encode_like_whole_texts(file, by, texts, as_text):
    rnd = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "B", "é", " ", "　", "\xa0", "'s", "'", "1", "!", "日", "\r", "\x1c", "\x85", "́", "İ", "Σ", "<|endoftext|>", "<|startoftext|>", "<|END", "̸", "="]
    many = texts + ["<|endoftext|>", "a<|endoftext|>", " <|endoftext|><|endoftext|> b", "<|startoftext|><|endoftext|"] + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(60))) for _ in range(1500)]
    whole = Tokenizer.from_file(public_tokenizers.path(file))
    whole.encode_special_tokens = as_text
    ids, first = tokens.PieceEncoder(public_tokenizers.path(file), by, as_text).encode(pa.array(many))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [x.ids for x in whole.encode_batch([t or "" for t in many], add_special_tokens=False)]


def expected_ids(texts, file, end):
    whole = Tokenizer.from_file(public_tokenizers.path(file))
    return [x.ids + [end] for x in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_holds_every_piece_once_without_gaps(docs, texts):
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=256).collect()
    ids = expected_ids(texts, "word_bpe_49k.json", 1)
    wanted = {(3 * i + 1, k): (256 * k, len(x[256 * k : 256 * k + 256]), crc(x[256 * k : 256 * k + 256])) for i, x in enumerate(ids) for k in range(-(-len(x) // 256))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == wanted and len(rows) == len(wanted)
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(held) <= 1.05 * sum(x[1] for x in wanted.values()) / 256 + 2


def test_sum_of_squares_rule():
    lengths = np.random.default_rng(0).integers(1, 41, 400)
    bins, offsets, fill = packing.sum_of_squares(lengths, 40)
    gaps, state, levels = Counter(), {}, []
    for size, b in zip(lengths.tolist(), bins.tolist()):
        cost = lambda g: sum(v * v for v in g.values())
        options = {}
        for gap in [g for g in gaps if gaps[g] and g >= size] + [40]:
            after = Counter(gaps)
            if gap < 40 or (gap == 40 and False):
                after[gap] -= 1
            if gap > size:
                after[gap - size] += 1
            options[gap] = cost(after)
        gap = 40 - state.get(b, 0)
        assert options[gap] == min(options.values())
        if gap < 40:
            gaps[gap] -= 1
        if gap > size:
            gaps[gap - size] += 1
        state[b] = state.get(b, 0) + size
        levels.append(state[b])
    assert max(levels) <= 40 and fill.sum() == lengths.sum()


def test_a_shard_holds_a_bounded_number_of_pieces_of_long_documents(spark):
    docs = spark.createDataFrame([(i, "word " * 40_000) for i in range(20)], "doc_id long, text string")
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=100, shard_pieces=100).collect()
    shards = Counter(r["sequence_id"] >> 32 for r in rows)
    assert len(rows) == 20 * 401 and max(shards.values()) < 200


def test_packing_odd_rows(odd, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack_documents(odd, path).count() == 7 and packing.pack_documents(nothing, path).count() == 0


def test_id_store_round_trip(docs, texts):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in idstore.store_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    at, wanted = 0, {}
    for i, ids in enumerate(expected_ids(texts, "byte_bpe_50k.json", 2)):
        wanted[3 * i + 1] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == wanted


def test_minimal_perfect_hash():
    for n in (0, 1, 2, 7, 5000):
        keys = np.stack([np.random.default_rng(n).permutation(10 * n)[:n], np.zeros(n, int)], axis=1).astype(np.int64)
        h = idstore.key_hash(keys)
        seeds = idstore.build_index(h) if n else np.zeros(1, np.uint32)
        if n:
            slots = idstore._slots(h, seeds[idstore._buckets(h, len(seeds))], n)
            assert sorted(slots.tolist()) == list(range(n))
            prints = np.empty(n, "<u4")
            prints[slots] = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            assert (idstore.lookup(keys, seeds.tobytes(), prints.tobytes()) == slots).all()
            assert (idstore.lookup(keys + 10**9, seeds.tobytes(), prints.tobytes()) == -1).mean() > 0.99


def test_keyed_reads_of_present_absent_and_repeated_ids(spark, tmp_path, docs, texts, nothing):
    file = public_tokenizers.path("byte_bpe_50k.json")
    path = str(tmp_path / "store")
    idstore.write_store(docs, file, path)
    ids = expected_ids(texts, "byte_bpe_50k.json", 2)
    asked = [1, 4, 3 * len(texts) - 2, 2, 0, -5, 10**12, None, 4]
    got = {(r["doc_id"], r["occurrence"]): r["tokens"] for r in idstore.get_documents(spark, path, asked).collect()}
    assert got == {(1, 0): ids[0], (4, 0): ids[1], (3 * len(texts) - 2, 0): ids[-1]}
    assert idstore.get_documents(spark, path, []).count() == 0 == idstore.get_documents(spark, path, [3]).count()
    many = spark.createDataFrame([(5, f"t{k}") for k in range(9)] + [(6, "x")], "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    idstore.write_store(many, file, path + "2", shard_docs=1)  # one id's rows in several shards
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert spark.read.parquet(path + "2").count() >= 5
    assert sorted((r["doc_id"], r["occurrence"]) for r in idstore.get_documents(spark, path + "2", [5, 6, 7]).collect()) == [(5, k) for k in range(9)] + [(6, 0)]
    idstore.write_store(nothing, file, path + "3")
    assert idstore.get_documents(spark, path + "3", [1]).count() == 0


def test_id_store_odd_rows(odd, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = sorted(idstore.store_documents(odd, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 5, 5, 5, 7, 8] and rows[1]["start"] == rows[0]["n_tokens"]
    assert idstore.store_documents(nothing, path).count() == 0


def test_mixing_draws_follow_the_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 4000, "a").when(F.col("id") < 5900, "b").alias("source"), F.lit(1).alias("mix_copy"))
    rows = mixing.mix(docs, {"a": 1.0, "b": 3.0}).collect()
    n = Counter(r["source"] for r in rows)
    assert set(n) == {"a", "b"} and abs(n["a"] - 1500) < 160 and abs(n["b"] - 4500) < 280
    per = Counter(r["doc_id"] for r in rows if r["source"] == "b")
    draws = Counter(per.get(i, 0) for i in range(4000, 5900))
    rate = 4500 / 1900
    for k in range(5):
        p = math.exp(-rate) * rate**k / math.factorial(k)
        assert abs(draws[k] - 1900 * p) < 5 * math.sqrt(1900 * p)
    assert [r["mix_key"] for r in rows] == sorted(r["mix_key"] for r in rows)
    assert rows == mixing.mix(docs.repartition(7), {"a": 1.0, "b": 3.0}).collect()


def test_mixing_odd_rows(odd, nothing, spark):
    got = mixing.mix(odd, epochs=50.0)
    assert got.columns == [*odd.columns, "mix_copy", "mix_copies", "mix_key"] and got.where("doc_id is null").count() > 0
    assert mixing.mix(nothing).count() == 0 and mixing.mix(odd, {}).count() == 0
    high = mixing.mix(spark.createDataFrame([(1, "a")], "doc_id bigint, source string"), {"a": 1.0}, epochs=5000.0).count()
    assert 4500 < high < 5500
    with pytest.raises(ValueError):
        mixing.mix(odd, {"a": -1.0})


def removed(texts, n=50):
    first, words = {}, [WORD.findall(t or "") for t in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = []
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window", [50, 7, 2])
def test_substring_dedup_matches_brute_force(docs, texts, window, monkeypatch):
    monkeypatch.setattr(substrings, "RANGE_BYTES", 20_000)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup_substrings(docs, window=window).collect()}
    wanted = {3 * i + 1: (n, k, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, k, kept) in enumerate(removed(texts, window))}
    assert got == wanted and sum(k for _, k, _ in got.values()) > 0


def test_substring_dedup_across_small_batches(docs, texts, monkeypatch):
    monkeypatch.setitem(substrings.batched.__globals__, "BATCH_BYTES", 2000)
    got = {r["doc_id"]: r["text"] for r in substrings.dedup_substrings(docs, carry=["doc_id", "text"]).collect()}
    assert got == {3 * i + 1: kept if k else t for i, (t, (_, k, kept)) in enumerate(zip(texts, removed(texts)))}


def test_substring_dedup_odd_rows(spark, odd, nothing):
    long = " ".join(f"w{k}" for k in range(60))
    rows = spark.createDataFrame([(None, long, 1), (4, long, 2), (4, long, 3), (9, long + " end", 4)], "doc_id bigint, text string, n_removed int")
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in substrings.dedup_substrings(rows, carry=["doc_id", "text", "n_removed"]).collect()), key=lambda r: r[2])
    assert got == [(None, long, 1), (4, long, 2), (4, long, 3), (9, "end", 4)]
    assert substrings.dedup_substrings(odd).count() == 7 and substrings.dedup_substrings(nothing).count() == 0


def test_quality_learns_from_document_labels(spark):
    rnd = random.Random(2)
    good = lambda: " ".join("".join(rnd.choice("aeioudnrst") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(5, 300)))
    bad = lambda: good() + " " + " ".join(["BUY!!"] * rnd.randint(60, 200)) + " " + good()
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(400)]
    docs = spark.createDataFrame(rows + [(1000, "", 1), (1001, None, 1)], "doc_id bigint, text string, quality int")
    labels = docs.where("doc_id < 1000").select("doc_id", "quality")
    model = quality.train(docs.drop("quality"), labels, fold=lambda i: quality.crc_fold(i, 3) != 1)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.5) == bool(i % 3) for i in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 402
    again = quality.train(docs.repartition(5), labels, fold=lambda i: quality.crc_fold(i, 3) != 1)
    assert all(np.array_equal(model.p[k], again.p[k]) for k in model.p)


def test_attention_gradient():
    rng = np.random.default_rng(0)
    x, first, y, weight = rng.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
    model = quality.AttentionModel.fresh(5)

    def loss():
        s = model.forward(x, first)["score"]
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / weight.sum()

    for key, g in model.gradient(x, first, y, weight).items():
        at = tuple(rng.integers(0, n) for n in g.shape)
        was = model.p[key][at]
        model.p[key][at] = was + 1e-5
        up = loss()
        model.p[key][at] = was - 1e-5
        down = loss()
        model.p[key][at] = was
        assert math.isclose((up - down) / 2e-5, g[at], rel_tol=1e-4, abs_tol=1e-8)


def test_quality_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(5, 1), (5, 0), (7, 2), (None, 1), (8, None)], "doc_id bigint, quality int")
    model = quality.train(odd, labels)
    assert quality.score(odd, model, keep=odd.columns).columns == [*odd.columns, "quality_score"]
    assert quality.score(odd, model).count() == 7 and quality.score(nothing, model).count() == 0
    assert quality.train(nothing, labels) is None and quality.score(odd, None).first()["quality_score"] == 0.5


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_of_slices_equal_words_of_texts(kind):
    texts = ["The first OF many\tWords", None, "", "A b  C\x0bd", "É Last one", "x"]
    whole = pa.RecordBatch.from_arrays([pa.array(texts, kind)], ["text"])
    for lower in (True, False):
        got = []
        for part in common.slices(iter([whole]), "text", 8):
            codes, first, words = common.word_codes(part.column("text"), lower)
            got += [[words[c].decode() for c in codes[a:b]] for a, b in zip(first, first[1:])]
        low = lambda t: t.translate({c: c + 32 for c in range(65, 91)}) if lower else t
        assert got == [WORD.findall(low(t or "")) for t in texts]


def test_language_model_counts_the_words_of_a_text_that_begins_a_slice(spark):
    rows = [(i, " ".join(f"Word{i % 3}" for _ in range(n))) for i, n in enumerate((300_000, 300_000, 300_000, 4_000, 5))]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["n_known"]) for r in got} == {i: (t.count(" ") + 2,) * 2 for i, t in rows}


def test_language_model_scores(docs, texts):
    got = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    words = [WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    train = [i for i in range(len(texts)) if zlib.crc32(str(3 * i + 1).encode()) % 7 != 2]
    c = Counter(w for i in train for w in words[i])
    n, v = sum(c.values()) + len(train), len(c) + 1
    for i, w in enumerate(words):
        r = got[3 * i + 1]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in train, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    held = [i for i in range(len(texts)) if i not in train]
    assert sum(got[3 * i + 1]["score"] for i in held) > sum(got[3 * i + 1]["base_score"] for i in held)


def test_rare_words_joined_or_broadcast_score_alike(docs, monkeypatch):
    rows = lambda: {r["doc_id"]: (r["base_score"], r["score"], r["n_known"]) for r in lm.score_documents(docs).collect()}
    wanted = rows()
    monkeypatch.setattr(lm, "COMMON_WORDS", 800)
    got = rows()
    assert all(np.allclose(got[k], wanted[k], rtol=1e-9) for k in wanted)


def test_nce_recovers_conditionals_and_is_normalised():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(12) * 0.5, size=12)
    table = lm.log10_table(lm.train_nce(p * 1e5, dims=12, steps=600))
    assert np.allclose((10**table).sum(axis=1), 1) and np.abs(10**table - p).mean() < 0.02


def test_language_model_odd_rows(odd, nothing):
    assert lm.score_documents(odd).count() == 7 and lm.score_documents(nothing).count() == 0


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 16))
    near = np.concatenate([base, base[:40] + rng.normal(size=(40, 16)) * 0.15, base[:1] + rng.normal(size=(150, 16)) * 0.1, base[:5]])
    return near[rng.permutation(len(near))]


def test_embedding_links_match_brute_force(spark, vectors):
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    bad = [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] * 16, [], [1.0, 0.0]]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000 + k, v) for k, v in enumerate(bad)] + [(None, vectors[0].tolist())]
    got = {r["vec_id"]: r for r in hnsw.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), block_rows=100).collect()}
    root = components(len(x), list(zip(*np.nonzero(np.triu(near)))))
    assert len(got) == len(rows)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert 0.99 * near.sum() <= found <= near.sum()
    assert sum(got[i]["component_id"] == root[i] for i in range(len(x))) >= 0.99 * len(x)
    for k in range(len(bad)):
        assert (got[1000 + k]["n_links"], got[1000 + k]["component_id"], got[1000 + k]["kept"]) == (0, 1000 + k, True)


def test_links_belong_to_vectors_where_ids_repeat_and_to_any_finite_size(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a), (1, b), (2, [1.0, 0.01, 0.0]), (3, [0.01, 1.0, 0.0]), (4, [0.02, 1.0, 0.0]), (5, [0.0, 0.0, 1e300]), (6, [0.0, 1e290, 1e300]), (7, [0.0, 0.0, 1e-320]), (8, [0.0, -0.0, 0.0])]
    odd = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id bigint, embedding array<double>, node string, n_links int")
    for parts in ({}, {"block_rows": 2, "shards": 3}, {"shard_bytes": 1000}):
        got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in hnsw.near_duplicate_vectors(odd, **parts).collect())
        assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (5, 2, 5, True), (6, 2, 5, False), (7, 2, 5, False), (8, 0, 8, True)]


def test_graph_recall_against_brute_force():
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(300, 32))
    x = (centers[rng.integers(0, 300, 4000)] + rng.normal(size=(4000, 32)) * 0.25).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, r = hnsw.audited_links(hnsw.Graph.build(x.astype(np.float32)), x, x[:500], 0.9)
    true = {(a, b) for a, b in zip(*np.nonzero(x[:500] @ x.T >= 0.9))}
    found = set(zip(i.tolist(), r.tolist()))
    assert found <= true and len(found) >= 0.98 * len(true)


def test_embeddings_of_an_empty_table(spark):
    assert hnsw.near_duplicate_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_id_ranges(spark):
    df = spark.createDataFrame([(i,) for i in [*range(100), *[50] * 300, None]], "i bigint")
    bounds = common.id_bounds(df, "i", 8)
    assert bounds == sorted(set(bounds)) and len(bounds) <= 7
    got = {r["i"]: r["p"] for r in df.select("i", common.range_of(F.col("i"), bounds).alias("p")).collect()}
    assert got[None] == 0 and all(got[i] == sum(b <= i for b in bounds) for i in range(100))


def test_hnsw_audit_sees_ordinary_queries_beside_a_hot_group_and_ends_exact():
    rng = np.random.default_rng(3)
    hot = rng.normal(size=16) + 0.02 * rng.normal(size=(500, 16))
    pairs = rng.normal(size=(100, 16))
    x = hnsw._unit(np.concatenate([hot, pairs, pairs + 0.02 * rng.normal(size=(100, 16))]))
    graph = hnsw.Graph.build(x.astype(np.float32))
    cut = np.arange(500, len(x))  # no walk enters or leaves these rows
    graph.links[0][np.isin(graph.links[0], cut)] = -1
    graph.links[0][cut] = -1
    got = hnsw.audited_links(graph, x, x, 0.9)
    assert set(zip(*(v.tolist() for v in got))) == set(zip(*(v.tolist() for v in np.nonzero(x @ x.T >= 0.9))))
