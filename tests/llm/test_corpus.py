"""The corpus operators against brute force, with nulls, empty and long texts, ties,
repeated rows, empty tables and columns whose names clash."""

import base64
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillstone.llm import ann, bpe, licenses, lines, minhash, packing, quality, sharding, topk, warc
from quillstone.llm.catalog import tokenizer_file
from quillstone.llm.common import Scratch
from quillstone.llm.components import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, node int, score string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ed"]) for _ in range(n))


def corpus() -> list[tuple[int | None, str | None]]:
    base = prose(1, 120).split()
    rows: list[tuple[int | None, str | None]] = [(i, prose(100 + i, 20 + 7 * i)) for i in range(20)]
    rows += [(30, " ".join(base)), (31, " ".join(base)), (32, " ".join(base).upper() + "  \n"), (33, " ".join([*base[:60], "other", *base[61:]]))]
    rows += [(40 + i, " ".join([*base[: 10 + i], *prose(500 + i, 3).split(), *base[13 + i :]])) for i in range(40)]
    rows += [(90, None), (91, ""), (92, " \t\n"), (93, "one"), (94, "one two"), (95, "One  two"), (96, prose(7, 9000)), (97, "café naïve 日本 🙂   x"), (None, prose(3, 30))]
    return rows + [(98, "twice"), (98, "twice")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", None if i % 7 == 0 else f"src{i % 3}", 0, "x", i, "y") for i, (d, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def reachable(sets: dict, percent: int) -> dict:
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in sets}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_op1_minhash(docs, empty, words, percent):
    found = minhash.near_duplicates(docs, words, percent).collect()
    sets = {}
    for d, t in corpus():
        w = (t or "").encode().lower().split()
        if d is not None:
            sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    root = reachable(sets, percent)
    assert len(found) == len(corpus())
    for r in found:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id), r
    assert minhash.near_duplicates(empty, words, percent).count() == 0


def test_op1_null_and_repeated_ids(spark):
    """Copies without an id link what lies between them; an id may stand for different texts."""
    w = prose(60, 200).split()
    chain = [" ".join([*w[: 10 * i], *[f"x{i}a{k}" for k in range(10 * i)][:0], *[f"q{k}" for k in range(3 * i)], *w[3 * i :]]) for i in range(4)]
    other = prose(61, 150)
    rows = [(5, chain[0]), (None, chain[1]), (9, chain[2]), (7, other), (7, chain[2] + " end"), (None, other), (None, None), (None, "lone words here")]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, n int")
    sets = {}
    for i, (_, t) in enumerate(rows):
        x = (t or "").encode().lower().split()
        sets[i] = {tuple(x[k : k + 3]) for k in range(len(x) - 2)}
    root = reachable(sets, 80)
    want = Counter()
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in root if root[j] == root[i] and rows[j][0] is not None]
        comp = min(ids) if ids and sets[i] else d
        want[d, len(sets[i]), comp, d is not None and d == comp] += 1
    assert Counter(tuple(r) for r in minhash.near_duplicates(df, 3, 80).collect()) == want
    assert len({c for d, n, c, k in want if d is None}) > 1


def test_op1_pairs_at_the_threshold_share_a_key():
    """Of 8,000 pairs at a similarity of exactly 0.8 none is left out (with 9 chunks of 7 three were)."""
    r = np.random.default_rng(1)
    a, b = np.empty((2, 8000, minhash.SYMBOLS), np.uint64)
    for i in range(len(a)):
        h = r.integers(0, 2**63, 20, dtype=np.uint64) * np.uint64(2)
        a[i], b[i] = minhash.signature(h[:18]), minhash.signature(h[2:])
    assert (minhash.chunk_keys(a, 80) == minhash.chunk_keys(b, 80)).any(axis=1).all()


def test_components_of_a_path(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.comp for r in components(edges, Scratch(spark, "t"), "path").collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 100: 100, 101: 100}


def test_op2_byte_bpe(docs, empty):
    import tiktoken

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter(tuple(r) for r in bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect())
    want = Counter()
    for d, t in corpus():
        ids = coder.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    tokens = bpe.encode(docs, path, public_tokenizers.PATTERN)
    assert sorted(bytes(r.data) for r in bpe.decode(tokens, path, public_tokenizers.PATTERN).collect()) == sorted((t or "").encode() for _, t in corpus())
    assert bpe.round_trip(empty, path, public_tokenizers.PATTERN).count() == 0


def test_op2_and_op5_fill_their_tables_without_the_collector(monkeypatch):
    """New words are no garbage; the collector went through them over and over."""
    import gc

    ranks = bpe.load_ranks(tokenizer_file("byte_bpe_50k.tiktoken"))
    coders = bpe.ByteBPE(sorted(ranks, key=ranks.__getitem__), public_tokenizers.PATTERN), packing.WordTokenizer(tokenizer_file("word_bpe_49k.json"))
    r = random.Random(5)
    texts = [" ".join(f"{r.choice(WORDS)}{r.randrange(10**6)}" for _ in range(60)) for _ in range(100)]
    runs = []
    counted = lambda phase, info: runs.append(phase)
    before = gc.get_threshold()
    gc.set_threshold(50)
    gc.callbacks.append(counted)
    try:
        for coder, some in zip(coders, (texts, [t.encode() for t in texts]), strict=True):
            runs.clear()
            assert len(list(coder.encode_batch(some))) == 100
            assert len(runs) < 20 and gc.isenabled(), type(coder)
    finally:
        gc.callbacks.remove(counted)
        gc.set_threshold(*before)


def test_op2_odd_texts():
    import tiktoken

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.ByteBPE(sorted(ranks, key=ranks.get), public_tokenizers.PATTERN)
    r = random.Random(5)
    pool = [chr(c) for c in range(400)] + [" "] * 150 + ["\n", "\t", "'s", "'ll", "　", "é", "日", "🙂"] * 10
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["a" * 50_000, "  " * 5000]
    assert list(ours.encode_batch(texts)) == [coder.encode_ordinary(t) for t in texts]


def test_op3_shards(docs, empty, spark):
    rows = sharding.stratified_shards(docs).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in corpus())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert sharding.stratified_shards(empty).count() == 0
    few = spark.createDataFrame([(i, "t", "en", None, 0, "", 0, "") for i in range(3)], SCHEMA)
    assert sorted((r.shard, r.slot) for r in sharding.stratified_shards(few).collect()) == [(0, 0), (1, 0), (2, 0)]


def test_op3_mixture(spark):
    rows = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 < 6, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"))
    placed = sharding.stratified_shards(rows).join(rows, "doc_id").groupBy("source", "shard").count().collect()
    by = defaultdict(list)
    for r in placed:
        by[r.source].append(r["count"])
    assert all(len(v) == 8 and max(v) - min(v) <= 2 for v in by.values())


def brute_top(vectors, queries, k):
    out = {}
    for q, v in queries:
        scores = sorted(((-(v @ w), i) for i, w in vectors if i != q))[:k]
        out[q] = [(i, -s) for s, i in scores]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=16) * (1 + i % 5)], 0, 1) for i in range(600)]
    rows += [(1000 + i, rows[7][1], 0, 1) for i in range(60)]
    rows += [(2000, None, 0, 1), (2100, [float("nan")] * 16, 0, 1), (2200, [1.0, None] + [0.0] * 14, 0, 1), (2300, [0.0] * 16, 0, 1), (2400, [], 0, 1), (2500, [1.0, 2.0], 0, 1), (2600, [float("inf")] * 16, 0, 1), (None, [1.0] * 16, 0, 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, rank int")


def sound(rows, zero):
    return [(i, np.array(v)) for i, v, *_ in rows if i is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]


def test_op9_exact(spark, vectors, monkeypatch):
    rows, table = vectors
    monkeypatch.setattr(topk, "BUCKET", 64)
    monkeypatch.setattr(topk, "QUERIES", 3)
    whole = [(i, np.floor(v * 1024).astype(np.int64)) for i, v in sound(rows, True)]
    want = brute_top(whole, [(i, v) for i, v in whole if i % 50 == 0], 10)
    got = defaultdict(list)
    for r in topk.top_k(table, every=50).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == want
    assert topk.top_k(table.limit(0)).count() == 0
    few = topk.top_k(table.filter("vec_id in (0, 1, 2)"), every=1).groupBy("query_id").count().collect()
    assert sorted(tuple(r) for r in few) == [(0, 2), (1, 2), (2, 2)]


def test_op9_wide_numbers(spark):
    q, c = np.array([[2**40, 3]]), np.array([[2**20, 1], [1, 2]])
    assert topk._scores(q, c).tolist() == [[2**60 + 3, 2**40 + 6]]
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (3, [1.0, 1.0]), (4, [1.7e308, -1.7e308]), (5, [0.0, 5.0])]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).orderBy("rank").collect()
    whole = {i: [int(np.floor(1024 * x)) if abs(x) < 1e300 else int(np.sign(x) * np.finfo(float).max) for x in v] for i, v in rows}
    want = {i: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(whole[0], whole[i])))) for i in whole if i}
    assert [(r.vec_id, r.score) for r in found] == sorted(want.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("search", [lambda t: topk.top_k(t, k=3, every=10), lambda t: ann.nearest(t, k=3, every=10)])
def test_repeated_rows_of_a_query(spark, search):
    """Many rows of one id leave room for the others with the same vector."""
    rows = [(0, [1.0, 2.0])] * 30 + [(i, [1.0, 2.0]) for i in range(1, 6)] + [(10, [0.5, 0.5]), (10, [0.25, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in search(table).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    assert found == {0: [1, 2, 3], 10: [0, 0, 0]}


def test_op4_recall_and_scores(vectors):
    rows, table = vectors
    good = sound(rows, False)
    want = brute_top(good, [(i, v) for i, v in good if i % 20 == 0], 20)
    got = defaultdict(list)
    by_id = dict(good)
    for r in ann.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        assert r.score == pytest.approx(float(by_id[r.query_id] @ by_id[r.vec_id]), rel=1e-12)
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    assert ann.nearest(table.limit(0)).count() == 0


def test_op5_packing(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, size=256).collect()
    want = Counter()
    total = 0
    for d, t in corpus():
        ids = np.array(coder.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        for k in range(0, len(ids), 256):
            want[d, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.1 * -(-total // 256) + 1
    assert packing.pack_documents(empty, path).count() == 0


def test_op5_random_texts(monkeypatch, tmp_path):
    """Ids equal the library's, with room in the tables and without, and with other settings."""
    import json

    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    r = random.Random(6)
    pool = [chr(c) for c in range(32, 0x250)] + [" "] * 150 + ["\n", "\t", "\r\n", "'s", "'LL", "\u3000", "e\u0301", "日", "🙂", "İ", "Σ", "<|endoftext|>", "ſ", "ß"] * 6
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 80))) for _ in range(1500)] + ["a" * 20_000, "", " \n", "Ab cd " * 3000, "é" * 5000]
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for room in (packing.MEMO_BYTES, 2000):
        monkeypatch.setattr(packing, "MEMO_BYTES", room)
        coder = packing.WordTokenizer(path)
        data = [t.encode() for t in texts]
        assert coder.by_run and list(coder.encode_batch(data)) == want and list(coder.encode_batch(data)) == want
    with open(path) as f:
        other = json.load(f)
    other["normalizer"]["normalizers"].pop()  # keeps capitals
    (tmp_path / "other.json").write_text(json.dumps(other))
    coder, lib = packing.WordTokenizer(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert not coder.by_run
    assert list(coder.encode_batch([b"One TWO three"])) == [np.array(lib.encode("One TWO three", add_special_tokens=False).ids, "<u4").tobytes()]


def test_op5_plan_uses_every_piece():
    r = np.random.default_rng(1)
    histogram = Counter(int(x) for x in r.integers(1, 2049, 5000)) + Counter({1: 3000, 2048: 5, 1024: 9})
    plan = packing.plan_packing(histogram, 2048)
    assert plan.used == dict(histogram)
    assert plan.sequences <= 1.02 * sum(k * n for k, n in histogram.items()) / 2048 + 1
    assert packing.plan_packing({}, 2048).sequences == 0


def test_op5_triple_with_one_of_the_longest():
    avail = np.zeros(101, np.int64)
    avail[[40, 35, 25, 20]] = 1
    assert packing._filler(avail, 100) == [40, 35, 25] and avail.sum() == 4


def test_op6_licenses(spark, docs, empty):
    mit = licenses.TEXTS["MIT"].replace("\n", "\n\n").replace("MIT License", "MIT License\n\nCopyright (c) 2020 Someone")
    texts = [(1, mit.upper()), (2, "Prose.\nReleased under the MIT Licence!\nMore"), (3, "licensed under the apache license, v2.0"), (4, "A talk about the MIT License and others"), (5, None), (6, "x\n\nSPDX-License-Identifier: GPL-3.0\n\ny"), (7, "Copyright 2021 A\n" + licenses.TEXTS["BSD-2-Clause"])]
    got = {(r.doc_id, r.scope, r.license) for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {(1, "document", "MIT"), (2, "line", "MIT"), (3, "document", "Apache-2.0"), (6, "paragraph", "GPL-3.0"), (6, "line", "GPL-3.0"), (7, "document", "BSD-2-Clause")}
    assert licenses.scan(docs).count() == 0 and licenses.scan(empty).count() == 0


def test_op6_every_known_text_has_an_anchor():
    import re

    notices = [f"SPDX-License-Identifier: {k}" for k in licenses.NAMES] + [f"{v} the {n}" for v in licenses.VERBS for ns in licenses.NAMES.values() for n in ns]
    with_word = [x for x in notices if "licen" in x.lower()]
    assert all(re.search(licenses.ANCHOR, x) for x in [*licenses.TEXTS.values(), *with_word, "SPDX-License-Identifier: MIT"])
    assert not [x for x in notices if not re.search(licenses.ANCHOR, x)], "a notice that the scan would skip"


def test_op6_whole_texts_inside_documents(spark):
    mit = licenses.TEXTS["MIT"].replace("\n", "\n\n").replace("MIT License", "MIT License\n\nCopyright (c) 2020 Someone")
    further = dict(licenses.FURTHER[:2])
    folder = "/usr/share/common-licenses"
    texts = [(1, f"A readme.\n\n{mit}\n\nMore prose."), (2, "Copyright (c) 2024 X. Released under the MIT License."), (3, further["BSD-3-Clause"]), (4, further["BSL-1.0"].replace("\n", "\n\n")), (5, "A talk.\n\nOn the permission to talk.")]
    want = {(1, "run", 1, "MIT"), (2, "document", 0, "MIT"), (3, "document", 0, "BSD-3-Clause"), (4, "document", 0, "BSL-1.0")}
    for i, (name, spdx) in enumerate({"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}.items(), 10):
        if os.path.exists(f"{folder}/{name}"):
            with open(f"{folder}/{name}") as f:
                text = f.read()
            texts += [(i, text), (100 + i, f"Prose.\n\n{text}\n\nMore.")]
            want |= {(i, "document", 0, spdx), (100 + i, "run", 1, spdx)}
    rows = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.scope, r.place, r.license) for r in rows if r.scope in ("document", "run")} == want
    headers = [text.replace("\n", "\n\n") for _, text in licenses.FURTHER[2:]]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(headers)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license) for r in rows if r.scope == "document"} == {(i, spdx) for i, (spdx, _) in enumerate(licenses.FURTHER[2:])}


def test_op7_lines(spark, docs, empty):
    long = prose(11, 90).split()
    near = " ".join([*long[:40], "changed", *long[41:]])
    texts = [(1, "Title\n" + " ".join(long)), (2, " ".join(long).upper() + ".\nshort line"), (3, near + "\nTitle"), (4, None), (5, ""), (6, prose(12, 60) + "\n" + prose(12, 60)), (7, " ".join(long))]
    df = spark.createDataFrame([(*x, "en", b"x") for x in texts], "doc_id long, text string, kept string, group binary")
    rows = {(r.doc_id, r.line_no): r for r in lines.deduplicated_lines(df).collect()}
    assert set(rows) == {(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1), (6, 0), (6, 1), (7, 0)}
    assert [k for k in sorted(rows) if rows[k].kept and rows[k].group_id == rows[1, 1].group_id] == [(1, 1)]
    assert rows[2, 0].group_id == rows[7, 0].group_id == rows[1, 1].group_id == rows[3, 0].group_id
    out = {r.doc_id: r.text for r in lines.drop_repeated_lines(df).collect()}
    assert out == {1: texts[0][1], 2: "short line", 4: None, 5: "", 6: prose(12, 60)}
    assert lines.drop_repeated_lines(df).columns == df.columns and lines.drop_repeated_lines(df).dtypes == df.dtypes
    assert lines.deduplicated_lines(empty).count() == 0 and lines.drop_repeated_lines(empty).count() == 0 and lines.drop_repeated_lines(docs).count() > 0


def test_op7_rows_of_one_id(spark):
    """Lines go by row: other texts under the id, or under no id, keep theirs."""
    texts = [(1, "A"), (5, "A"), (5, "B"), (None, "C\nA"), (None, "D\nE"), (6, "E"), (8, "F"), (8, "F")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = Counter((r.doc_id, r.text) for r in lines.drop_repeated_lines(df).collect())
    assert out == Counter([(5, "B"), (None, "C\nA"), (None, "D\nE"), (8, "F")])
    long = prose(13, 200)
    df = spark.createDataFrame([(1, long), (None, long + " more"), (2, "x " + long + " more")], "doc_id long, text string")
    assert len({r.group_id for r in lines.deduplicated_lines(df).collect()}) == 1


def brute_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_op7_edit_distance():
    r = random.Random(1)
    for _ in range(1500):
        a = "".join(r.choice("ab c") for _ in range(r.randint(0, 30)))
        b = list(a)
        for _ in range(r.randint(0, 6)):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 2)] = [r.choice("ab cd")] * r.randint(0, 2)
        b = "".join(b)
        d, n = brute_distance(a, b), max(len(a), len(b))
        assert lines.edit_distance(a, b) == d <= lines.edits_by_words(a.split(" "), b.split(" "), 10**6)
        assert lines.similar(a, b, 0.8) == (d <= int(n * 0.2 + 1e-9))
    for _ in range(300):
        a = "".join(r.choice("ab c") for _ in range(r.randint(30, 90)))
        b = "".join(c if r.random() < 0.8 else r.choice("abd") for c in a) if r.random() < 0.5 else "".join(r.choice("ab c") for _ in range(r.randint(30, 90)))
        d, most = brute_distance(a, b), r.randint(0, 60)
        found = lines.edit_distance(a, b, most)
        assert found == d if d <= most else most < found <= d


def test_op7_pairs_verified_together(monkeypatch):
    r = random.Random(4)
    pairs = [("", ""), ("", "abc"), ("a" * 64, "a" * 64), ("é" * 70, "é" * 69 + "a"), ("a" * 65, "b" * 70)]
    for _ in range(600):
        a = "".join(r.choice("ab c") for _ in range(r.choice([1, 20, 63, 64, 65, 127, 128, 129, 300, 400])))
        b = list(a)
        for _ in range(r.randint(0, len(a) // 3)):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 2)] = [r.choice("abcd ")] * r.randint(0, 2)
        pairs.append((a, "".join(b)))
    plain = [(a.encode(), b.encode()) for a, b in pairs if a.isascii()]
    assert lines.edit_distances(plain).tolist() == [lines.edit_distance(a.decode(), b.decode()) for a, b in plain]
    want = [lines.similar(a, b, 0.8) for a, b in pairs]
    for together in (1, 10**6):
        monkeypatch.setattr(lines, "TOGETHER", together)
        assert lines.similar_pairs(pairs, 0.8).tolist() == want
    assert lines.similar_pairs([], 0.8).tolist() == []


def test_op7_long_pairs_are_counted_and_verified_together(monkeypatch):
    """120 pairs of some 1,300 characters take no Python loop of their own, and counts of
    characters only tell of pairs that are no links."""
    r = random.Random(41)
    pairs = []
    for i in range(120):
        a = prose(7000 + i, 400)[:1300]
        b = list(a if i % 3 else prose(9000 + i, 400)[:1300])
        for _ in range(r.randrange(350)):
            b[r.randrange(len(b))] = r.choice("aeé ,日")
        pairs.append((a, "".join(b)[: r.randrange(1280, 1301)]))
    distance = np.array([lines.edit_distance(a, b) for a, b in pairs])
    assert (lines._unlike(pairs) <= distance).all()
    monkeypatch.setattr(lines, "similar", None)
    monkeypatch.setattr(lines, "edits_by_words", None)
    most = np.array([int(max(map(len, p)) * 0.2 + 1e-9) for p in pairs])
    assert (lines.similar_pairs(pairs, 0.8) == (distance <= most)).all()
    assert 20 < (distance <= most).sum() < 100


def test_op7_pairs_take_words_by_their_diagonals(monkeypatch):
    """Texts of 300 characters have 61 diagonals within a similarity of 0.8, so that one word of 64 holds them and
    pairs of all lengths up to there are verified in one call; distances are those of plain columns."""
    r = random.Random(12)
    pairs = []
    for i in range(400):
        a = prose(100 + i, 80)[: r.randint(70, 300)]
        b = "".join(c if r.random() > 0.17 else r.choice("aeé 日") for c in a) if i % 2 else prose(900 + i, 80)[: len(a)]
        pairs.append((a, b[r.randint(0, 9) :]))
    calls = []
    banded = lines._banded
    monkeypatch.setattr(lines, "_banded", lambda *x: calls.append(len(x[1])) or banded(*x))
    monkeypatch.setattr(lines, "similar", None)
    distance = np.array([lines.edit_distance(a, b) for a, b in pairs])
    most = np.array([int(max(map(len, p)) * 0.2 + 1e-9) for p in pairs])
    assert (lines.similar_pairs(pairs, 0.8) == (distance <= most)).all() and 50 < (distance <= most).sum() < 250
    assert len(calls) <= 3
    for share in (0, 0.1, 0.5, 1):
        most = np.array([int(max(map(len, p)) * share) for p in pairs])
        found = lines.edit_distances(pairs, most)
        assert np.where(distance <= most, found == distance, found > most).all()


def test_op7_counts_leave_out_no_link():
    """Pairs that counts of characters and of neighbours tell apart are no links; most chance pairs are."""
    r = random.Random(13)
    texts, links = ["", "é", "ab"], 0
    for i in range(150):
        x = prose(i, 60)[: r.randint(20, 400)]
        texts += [x, "".join(c if r.random() > 0.18 else r.choice("aeé 日") for c in x), x[r.randint(0, len(x) // 5) :]]
    i, j = np.triu_indices(len(texts), 1)
    may = lines._possible(lines._counts(texts), i, j, 0.8)
    for x, y, z in zip(i.tolist(), j.tolist(), may.tolist(), strict=True):
        if not z or y - x < 3:
            like = lines.similar_pairs([(texts[x], texts[y])], 0.8)[0] if y - x < 3 else False
            links += like
            assert z or not like
    assert links > 100 and may.mean() < 0.2


def test_op7_large_key_in_few_calls(monkeypatch):
    """Chance pairs of a key are told apart together, not strip by strip."""
    r = random.Random(15)
    vocabulary = ["".join(r.choice("etaoinsh") for _ in range(r.randint(2, 6))) for _ in range(60)]
    norm = sorted((random_line(r, vocabulary, r.randint(90, 110)) for _ in range(300)), key=len)
    sims, keys, _, short = lines.fingerprints([x.encode() for x in norm])
    e = np.zeros(len(norm), lines.ENTRY)
    e["size"], e["node"], e["s0"], e["s1"] = [len(x) for x in norm], np.arange(len(norm)), sims[:, 0], sims[:, 1]
    monkeypatch.setattr(lines, "DISTANCE", 128)
    monkeypatch.setattr(lines, "_allowed", lambda size: np.full(size.shape, 128))
    calls = []
    verify = lines.similar_pairs
    monkeypatch.setattr(lines, "similar_pairs", lambda pairs, least: calls.append(len(pairs)) or verify(pairs, least))
    joined, to = lines.linked_entries(e, 0, np.hstack([keys, short]), norm, None, 0.6)
    pairs = {(i, j) for i in range(len(norm)) for j in range(i) if lines.similar(norm[i], norm[j], 0.6)}
    root = reachable_pairs(len(norm), pairs)
    label = list(range(len(norm)))
    for x, y in zip(joined.tolist(), to.tolist(), strict=True):
        label[x] = y
    assert len(calls) <= 9 and all((root[i] == root[j]) == (label[i] == label[j]) for i in range(len(norm)) for j in range(i))


def test_op7_normalised_lines_of_any_script():
    import re

    def plain(t):
        return [" ".join(re.sub(r"[^\w\s]+", " ", x.lower()).split()).encode() for x in t.split("\n")]

    r = random.Random(14)
    letters = "aZ _.,\n\n\t \x0b\x1c\x85\xa0ÉéßΣσςİıñÑ“”—日本\u3000\u0301\u200b½²ⅧⓐÅＡ٣"
    for _ in range(3000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 25)))
        assert lines.normalised_lines(t) == plain(t) == lines.normalised_lines(t.encode())
    for k in [*range(0x80, 0x3000), *range(0xF900, 0x11000)]:
        t = f"Ab{chr(k)}Cd {chr(k)}\n{chr(k)} x"
        assert lines.normalised_lines(t) == plain(t)


def test_op7_normalised_lines_agree_on_ascii():
    import re

    r = random.Random(2)
    for _ in range(500):
        t = "".join(chr(r.randrange(128)) for _ in range(60))
        want = [" ".join(re.sub(r"[^\w\s]+", " ", x.lower()).split()).encode() for x in t.split("\n")]
        assert lines.normalised_lines(t) == want == lines.normalised_lines(t + "é")[:-1] + [want[-1]]


def test_op7_long_lines_in_pieces(monkeypatch):
    text = prose(5, 3000).encode()
    whole = lines.fingerprints([text, b"a short line of words"])
    monkeypatch.setattr(lines, "PIECE", 100)
    parts = lines.fingerprints([text, b"a short line of words"])
    assert all((x == y).all() for x, y in zip(parts[1:], whole[1:], strict=True)) and len(lines.fingerprints([])[0]) == 0
    assert int(np.bitwise_count(parts[0] ^ whole[0]).sum()) <= 16  # grams of a seam between pieces vote twice


def random_line(r: random.Random, vocabulary: list[str], chars: int) -> str:
    w: list[str] = []
    while sum(map(len, w)) + len(w) < chars:
        w.append(r.choice(vocabulary))
    return " ".join(w)


@pytest.mark.parametrize("large", [256, 12])
def test_op7_random_edits_against_all_pairs(spark, monkeypatch, large):
    """Pairs of an edit similarity of 0.8 or more over all pairs; the groups must join
    0.9 of them and nothing else. A third of the lines share one start of 100 characters."""
    monkeypatch.setattr("quillstone.llm.components.LARGE", large)
    monkeypatch.setattr(lines, "LARGE", large)
    r = random.Random(8)
    vocabulary = ["".join(r.choice("etaoinshrdlucmf") for _ in range(r.randint(1, 9))) for _ in range(2000)]
    start = random_line(r, vocabulary, 100)
    texts = []
    for i in range(150):
        x = random_line(r, vocabulary, r.randint(20, 300))
        x = f"{start} {random_line(r, vocabulary, 60)}" if i % 3 == 0 else x
        texts.append(x)
        for _ in range(2):
            w = x.split()
            for _ in range(r.randint(1, max(1, len(w) // 6))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            y = " ".join(w)
            texts.append(y if r.random() < 0.5 else "".join(c if r.random() > 0.04 else r.choice("xyz") for c in x))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {x.doc_id: x.group_id for x in lines.deduplicated_lines(df).collect()}
    pairs = {(i, j) for i in range(len(texts)) for j in range(i) if lines.similar(texts[i], texts[j], lines.SIMILARITY)}
    root = reachable_pairs(len(texts), pairs)
    assert len(pairs) > 200 and sum(group[i] == group[j] for i, j in pairs) >= 0.9 * len(pairs)
    assert all(root[i] == root[j] for i in group for j in range(i) if group[i] == group[j])


@pytest.mark.parametrize("block", [4096, 40])
def test_op7_all_pairs_of_a_large_key(spark, monkeypatch, block):
    """Lines with one start and each a tenth of their characters changed share a large key: all
    pairs of a key that are close and similar enough must be in one group."""
    monkeypatch.setattr("quillstone.llm.components.LARGE", 12)
    monkeypatch.setattr(lines, "LARGE", 12)
    monkeypatch.setattr(lines, "BLOCK", block, raising=False)
    r = random.Random(6)
    vocabulary = ["".join(r.choice("etaoinshrdlucmf") for _ in range(r.randint(2, 9))) for _ in range(2000)]
    start = random_line(r, vocabulary, 60)
    texts = []
    for _ in range(60):
        x = random_line(r, vocabulary, 120)
        for _ in range(3):
            texts.append(f"{start} {''.join(c if r.random() > 0.13 else r.choice('xyz') for c in x)}")
    clean = [x.encode() for x in texts]
    sims, keys, _, short = lines.fingerprints(clean)
    keys = np.hstack([keys, short])
    pairs = set()
    for i in range(len(texts)):
        for j in range(i):
            bits = int(np.bitwise_count(sims[i] ^ sims[j]).sum())
            meet = bool(((keys[i] == keys[j]) & (keys[i] != 0)).any()) and bits <= min(lines.DISTANCE, 10 + max(map(len, (texts[i], texts[j]))) // 4)
            if meet and lines.similar(texts[i], texts[j], lines.SIMILARITY):
                pairs.add((i, j))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {x.doc_id: x.group_id for x in lines.deduplicated_lines(df).collect()}
    root = reachable_pairs(len(texts), pairs)
    assert len(pairs) > 20
    assert all((root[i] == root[j]) == (group[i] == group[j]) for i in group for j in range(i))


def test_op7_few_pairs_join_copies(monkeypatch):
    """Of n copies under one key some n pairs are verified, and n - 1 rows come out."""
    r = random.Random(9)
    x = prose(4, 40)
    norm = sorted({"".join(c if r.random() > 0.01 else r.choice("xyz") for c in x) for _ in range(300)}, key=len)
    sims, keys, _, short = lines.fingerprints([x.encode() for x in norm])
    e = np.zeros(len(norm), lines.ENTRY)
    e["size"], e["node"], e["s0"], e["s1"] = [len(x) for x in norm], np.arange(len(norm)), sims[:, 0], sims[:, 1]
    tried = []
    verify = lines.similar_pairs
    monkeypatch.setattr(lines, "similar_pairs", lambda pairs, least: tried.extend(pairs) or verify(pairs, least))
    joined, _ = lines.linked_entries(e, 0, np.hstack([keys, short]), norm, None, 0.8)
    assert len(joined) == len(norm) - 1 and len(tried) <= 4 * len(norm)


def reachable_pairs(n: int, pairs: set) -> list[int]:
    root = list(range(n))
    for i, j in pairs:
        a, b = root[i], root[j]
        root = [a if x == b else x for x in root]
    return root


def test_op7_one_changed_word_is_found(spark):
    """Groups against edit similarity over all pairs: lines of 8 to 40 words, a word of each replaced."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(3000)]
    texts = []
    for i in range(120):
        w = [r.choice(vocabulary) for _ in range(r.randint(8, 40))]
        texts += [" ".join(w), " ".join([*w[: (k := r.randrange(len(w)))], r.choice(vocabulary), *w[k + 1 :]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {x.doc_id: x.group_id for x in lines.deduplicated_lines(df).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if lines.similar(texts[i], texts[j], lines.SIMILARITY)]
    assert len(pairs) > 100 and sum(group[i] == group[j] for i, j in pairs) >= 0.97 * len(pairs)
    assert {(i, j) for i in group for j in range(i) if group[i] == group[j]} <= set(pairs)


def test_op7_short_lines_and_lines_without_spaces(spark):
    han = "这是一个没有空格的很长的句子它应该被去重"
    texts = [(1, "Title\nAll rights reserved.\n" + han), (2, "all rights reserved\n" + han + "\nother"), (3, "title!\n--"), (4, "title")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {(r.doc_id, r.line_no): r for r in lines.deduplicated_lines(df).collect()}
    assert {k: r.kept for k, r in rows.items()} == {(1, 0): True, (1, 1): True, (1, 2): True, (2, 0): False, (2, 1): False, (2, 2): True, (3, 0): False, (4, 0): False}
    assert {r.doc_id: r.text for r in lines.drop_repeated_lines(df).collect()} == {1: texts[0][1], 2: "other", 3: "--"}


def test_op8_quality(spark, docs, empty):
    junk = [(i, "!! " + prose(i, 50).upper().replace(" ", "!! "), 0) for i in range(200, 300)]
    good = [(i, prose(i, 60).capitalize() + ".", 1) for i in range(300, 500)]
    df = spark.createDataFrame([x[:2] for x in junk + good] + [(999, ""), (998, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q, "x") for d, _, q in junk + good] + [(None, 1, "x"), (201, None, "x"), (7, 9, "x")], "doc_id long, quality int, text string")
    rows = {r.doc_id: r for r in quality.score_documents(df, labels).collect()}
    for d, _, q in junk + good:
        assert rows[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and rows[d].predicted == q and (rows[d].score >= 0.7) == bool(q)
    assert 0 <= rows[999].score == rows[998].score <= 1
    assert {r.doc_id for r in quality.accepted_documents(df, labels).collect()} >= {d for d, _, q in good}
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(empty, labels).count() == 0


def test_op8_learns_nothing_from_the_held_out_fold(spark):
    df = spark.createDataFrame([(i, prose(i, 40)) for i in range(60)], "doc_id long, text string")
    a = [(i, i % 2) for i in range(60)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in a]
    scores = [{r.doc_id: r.score for r in quality.score_documents(df, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (a, flipped)]
    assert all(abs(scores[0][i] - scores[1][i]) < 1e-9 for i in range(60))


def test_op10_warc(spark):
    pages = [(1, "http://a", "<p>x</p>"), (5, "http://b\r\nWARC-Type: fake", "<p>x</p>"), (3, None, "<p>x</p>"), (2, "http://c", None), (4, "http://d", ""), (6, "u", "é" * 9000), (6, "u", "é" * 9000)]
    df = spark.createDataFrame([(*p, "n") for p in pages], "page_id long, url string, html string, sha256 string")
    scratch = Scratch(spark, "t")
    warc.write_archive(df, scratch)
    rows = warc.read_archive(spark, scratch.root).collect()
    assert len(rows) == len(pages) and spark.read.parquet(scratch.path("payloads")).count() == 3
    for r in rows:
        body = next(((h or "").encode() for i, _, h in pages if i == r.page_id))
        top = max(i for i, _, h in pages if (h or "").encode() == body)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r.payload_bytes, r.payload_digest, r.declared_digest, bytes(r.payload)) == (len(body), digest, digest, body)
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == top else ("revisit", top))
        head, block = bytes(r.record).split(b"\r\n\r\n", 1)
        assert block == (body if r.record_type == "response" else b"") + b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
        assert head.count(b"WARC-Type: ") == 1 + (b"fake" in head)
    none = Scratch(spark, "t")
    warc.write_archive(df.limit(0), none)
    assert warc.read_archive(spark, none.root).count() == 0
    small = Scratch(spark, "t")
    warc.write_archive(df, small, min_bytes=100)
    kinds = {r.page_id: r.record_type for r in warc.read_archive(spark, small.root).collect()}
    assert set(kinds.values()) == {"response"}


def test_op10_damage_is_found(spark):
    scratch = Scratch(spark, "t")
    warc.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), scratch)
    spark.read.parquet(scratch.path("payloads")).withColumn("payload", F.encode(F.lit("y"), "UTF-8")).write.parquet(f"{scratch.root}-bad/payloads")
    spark.read.parquet(scratch.path("headers")).write.parquet(f"{scratch.root}-bad/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, f"{scratch.root}-bad").select("payload_bytes").collect()


def test_lines_that_meet_nothing_leave_no_text(spark, monkeypatch):
    rng = np.random.default_rng(11)
    texts = ["".join(map(chr, rng.integers(97, 123, 80))) for _ in range(300)]
    texts += [texts[0][:40] + "x" + texts[0][41:], texts[1], "short", "é" * 15, "short"]
    written = {}
    write = lines.Scratch.write

    def keep(self, df, name, free=False):
        out = write(self, df, name, free)
        if name == "lines":
            written["norm"] = [r.norm for r in out.collect() if r.norm is not None]
        return out

    monkeypatch.setattr(lines.Scratch, "write", keep)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {r.doc_id: r.group_id for r in lines.deduplicated_lines(df).collect()}
    assert len(group) == len(texts) and group[300] == group[0] and group[301] == group[1] and group[302] == group[304] != group[303]
    assert len(set(group.values())) == len(texts) - 3
    assert {texts[0], texts[300]} <= set(written["norm"]) and len(written["norm"]) < 10
    marks = lines.node_marks(spark.createDataFrame([(-1,), (5,), (5,), (1 << 62,)], "node long"))
    assert lines.marked(marks, np.array([-1, 5, 6, 0, 1])).tolist() == [True, True, False, True, False]
    assert np.bitwise_count(marks).sum() == 3


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_of_few_and_many_edges(spark, tmp_path, monkeypatch, few):
    from quillstone.llm import components as parts
    from quillstone.llm.common import Scratch

    monkeypatch.setattr(parts, "FEW", few)
    rng = np.random.default_rng(3)
    edges = [(int(a) - 40, int(b) - 40) for a, b in rng.integers(0, 150, (90, 2))] + [(1000 + (37 * i) % 101, 1000 + (37 * i + 37) % 101) for i in range(100)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = parts.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "c")
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.comp for r in found.collect()} == {x: y for x, y in label.items() if x not in alone}
    assert parts.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"), "none").count() == 0


def test_pairs_by_common_ends():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = "".join(rng.choice(list("abé"), int(rng.integers(1, 30))))
        cut, end = sorted(rng.integers(0, len(a) + 1, 2).tolist())
        b = a[:cut] + "".join(rng.choice(list("abé"), int(rng.integers(0, 6)))) + a[end:]
        assert lines._between(a, b) >= lines.edit_distance(a, b)
        assert lines.similar_pairs([(a, b)], 0.8).tolist() == [lines.similar(a, b, 0.8)]
