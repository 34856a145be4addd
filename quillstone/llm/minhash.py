"""MinHash near-duplicates through a multi-index Hamming join over b-bit signatures."""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Scratch
from .components import by_difference, link_by_keys

#: A signature has SYMBOLS symbols of BITS bits, in chunks. Two signatures of which a chunk
#: differs in at most one symbol share a key: a chunk with one symbol left out. From a
#: similarity of 0.85 on 9 chunks of 7 are enough: a pair at 0.85 has no such chunk with a
#: probability of 0.283 ** 9, about 1 in 85,000; at 0.9 with 0.150 ** 9, 1 in 26 million. Below
#: there are 12 of 5: at 0.8 it is 0.263 ** 12, about 1 in 9 million (with 9 of 7 1 in 2,293).
SYMBOLS, BITS = 63, 16
CHUNKS, WIDTH = 9, 7
LOW_PERCENT, LOW_CHUNKS, LOW_WIDTH = 85, 12, 5
#: Two low bits of each symbol are kept beside the keys. Pairs that share a key differ
#: in more than SKETCH_LIMIT of the 63 with a probability under 1e-7 at 0.8 or above.
SKETCH_LIMIT = 26

_MIX = [np.uint64(x) for x in np.random.default_rng(20240229).integers(1, 2**63, SYMBOLS, dtype=np.uint64) | np.uint64(1)]
_XOR = [np.uint64(x) for x in np.random.default_rng(20240301).integers(0, 2**63, SYMBOLS, dtype=np.uint64)]
_A, _B, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(31)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _B
    return x ^ (x >> _S)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``words`` words.

    ASCII letters are lower-cased and ASCII white space parts words. A text with fewer
    words is one shingle, one without words has none.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < words:
        return np.array([xxh64_intdigest(b" ".join(tokens), len(tokens))], np.uint64)
    h = np.fromiter(map(xxh64_intdigest, tokens), np.uint64, len(tokens))
    n = len(h) - words + 1
    out = h[:n].copy()
    for i in range(1, words):
        out = _mixed(out * _A + h[i : i + n])
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """SYMBOLS symbols of BITS bits: low bits of the least hash under each permutation."""
    out = np.empty(SYMBOLS, np.uint64)
    for i, (m, c) in enumerate(zip(_MIX, _XOR, strict=True)):
        x = (hashes ^ c) * m
        x ^= x >> _S
        x *= _B
        out[i] = x.min()
    return _mixed(out) >> np.uint64(64 - BITS)


def chunk_keys(sig: np.ndarray, percent: int) -> np.ndarray:
    """64-bit keys of each row: each chunk with each one symbol left out, in chunks for links
    of ``percent``."""
    chunks, width = (CHUNKS, WIDTH) if percent >= LOW_PERCENT else (LOW_CHUNKS, LOW_WIDTH)
    keys = np.empty((len(sig), chunks * width), np.uint64)
    for c in range(chunks):
        part = sig[:, c * width : (c + 1) * width]
        for gap in range(width):
            x = np.full(len(sig), c * width + gap + 1, np.uint64) * _A
            for j in range(width):
                if j != gap:
                    x = _mixed(x * _A + part[:, j] + np.uint64(1))
            keys[:, c * width + gap] = x
    return keys


def _planes(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.arange(SYMBOLS, dtype=np.uint64)
    one = np.uint64(1)
    return tuple(((sig >> np.uint64(k) & one) << place).sum(axis=1, dtype=np.uint64) for k in (0, 1))


def _digest(hashes: np.ndarray) -> bytes:
    return blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Per row of ``docs(id, text, own)``: ``id, own, n`` (set size), ``digest`` (16 bytes, of the
    whole set), ``sig``."""

    def run(batches):
        for b in batches:
            n, digest, sig = [], [], []
            for t in b.column(2).to_pylist():
                h = shingle_hashes(t, words)
                n.append(len(h))
                digest.append(_digest(h) if len(h) else None)
                sig.append(signature(h).astype("<u2").tobytes() if len(h) else None)
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
                names=["id", "own", "n", "digest", "sig"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "own", "text").mapInArrow(run, f"id {kind}, own long, n long, digest binary, sig binary")


def _symbols(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SYMBOLS).astype(np.uint64)


def _keys(nodes: DataFrame, percent: int) -> DataFrame:
    """``key, node``: a row for each key of each node."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys = chunk_keys(_symbols(b.column(1)), percent)
                yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(b.column(0).to_numpy().repeat(keys.shape[1]))], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def sketches(nodes: DataFrame) -> DataFrame:
    """``node, n, p, q``: the set size and two bit planes of each signature."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                p, q = (pa.array(x.view(np.int64)) for x in _planes(_symbols(b.column(2))))
                yield pa.record_batch([b.column(0), b.column(1), p, q], names=["node", "n", "p", "q"])

    return nodes.select("node", "n", "sig").mapInArrow(run, "node long, n long, p long, q long")


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Link documents whose sets of ``words``-word shingles have a Jaccard similarity of
    at least ``percent`` / 100, and find the connected groups.

    Documents with equal sets become one node. Nodes whose signatures agree in a chunk
    but for one symbol are candidates, and every candidate link is confirmed on the
    whole sets (100 * intersection >= percent * union). Columns: the id, ``n_shingles``,
    ``component_id`` (the smallest id reachable, its own included), ``kept`` (whether
    it is that id). Null, empty and blank texts have the size 0 and are linked with
    nothing; rows that repeat an id are documents of their own; a null id never names a
    component unless nothing else is in it, and its ``kept`` is null then false. An
    empty table gives no rows. Other columns are ignored. Below a percent of 80 the
    index finds fewer links than the figures above say.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("own"))
    rows = scratch.write(signatures(texts, words), "signatures")
    # equal digests have equal sets, so that any row's size and signature will do
    full = rows.filter("n > 0").groupBy("digest").agg(
        F.first("n").alias("n"), F.first("sig").alias("sig"), F.min(F.struct("own", "id")).alias("at"), F.min("id").alias("least")
    )
    full = scratch.write(full.select("digest", "n", "sig", "at.own", "at.id", "least", F.monotonically_increasing_id().alias("node")), "nodes", free=True)

    def near(a: str, b: str):
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        apart = F.col(f"{a}.p").bitwiseXOR(F.col(f"{b}.p")).bitwiseOR(F.col(f"{a}.q").bitwiseXOR(F.col(f"{b}.q")))
        return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.bit_count(apart) <= SKETCH_LIMIT)

    def prepare(wanted: DataFrame) -> DataFrame:
        """``node, h``: the sorted hashes of each node's set, from one of its documents."""
        at = full.select("node", "digest", "own", "id").join(wanted, "node", "left_semi").alias("w")
        found = texts.alias("t").join(at, (F.col("t.own") == F.col("w.own")) & F.col("t.id").eqNullSafe(F.col("w.id")))

        def sets(batches):
            seen = set()  # copies of a row meet in a task, and one of them is enough
            for b in batches:
                node, h = [], []
                for x, digest, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    if x not in seen and len(found := shingle_hashes(t, words)) and _digest(found) == digest:
                        seen.add(x)
                        node.append(x)
                        h.append(found.tobytes())
                yield pa.record_batch([pa.array(node, pa.int64()), pa.array(h, pa.binary())], names=["node", "h"])

        return found.select("node", "digest", "text").mapInArrow(sets, "node long, h binary")

    def verify(pairs: DataFrame, known: DataFrame) -> DataFrame:
        def confirm(batches):
            for b in batches:
                keep = []
                for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                    u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    n = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
                    if 100 * n >= percent * (len(u) + len(v) - n):
                        keep.append(i)
                took = pa.array(keep, pa.int32())
                yield pa.record_batch([b.column(0).take(took), b.column(1).take(took)], names=["a", "b"])

        both = pairs.join(known.toDF("b", "hb"), "b").join(known.toDF("a", "ha"), "a").select("a", "b", "ha", "hb")
        return both.mapInArrow(confirm, "a long, b long").distinct()

    def refer(sample: DataFrame, known: DataFrame) -> DataFrame:
        def majority(rows: pa.Table) -> pa.Table:
            each = [np.frombuffer(x, np.uint64) for x in rows["h"].to_pylist()]
            element, n = np.unique(np.concatenate(each), return_counts=True)
            return pa.table({"hub": rows["hub"][:1], "reference": [element[2 * n > len(each)].tobytes()]})

        return sample.join(known, "node").select("hub", "h").groupBy("hub").applyInArrow(majority, "hub long, reference binary")

    def differ(pairs: DataFrame, references: DataFrame, known: DataFrame) -> DataFrame:
        share = (100 - percent) / (100 + percent)

        def sides(batches):
            for b in batches:
                slack, size, alone, diff = [], [], [], []
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    own, reference = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    beside = np.setdiff1d(own, reference, assume_unique=True)
                    d = np.concatenate([beside, np.setdiff1d(reference, own, assume_unique=True)])
                    s = len(d) - share * len(own)
                    # a link's other row has at most 100 / percent times the elements
                    least = s - share * len(own) * 100 / percent
                    slack.append(s)
                    size.append(len(d))
                    alone.append(len(beside))
                    diff.append(d[: max(len(beside), len(d) + 1 - max(1, math.ceil(least / 2 - 1e-6)))].view(np.int64))
                yield pa.record_batch(
                    [b.column(0), b.column(1), pa.array(slack, pa.float64()), pa.array(size, pa.int32()), pa.array(alone, pa.int32()), pa.array(diff, pa.list_(pa.int64()))],
                    names=["hub", "node", "slack", "size", "own", "diff"],
                )

        both = pairs.join(known, "node").join(references, "hub").select("hub", "node", "h", "reference")
        return both.mapInArrow(sides, "hub long, node long, slack double, size int, own int, diff array<long>")

    def beyond(open_rows: DataFrame, known: DataFrame) -> DataFrame:
        told = (lambda sample: refer(sample, known)), (lambda pairs, references: differ(pairs, references, known))
        return by_difference(open_rows, near, ["n", "p", "q"], *told, scratch, "near")

    comp = link_by_keys([_keys(full, percent)], sketches(full), near, prepare, verify, beyond, scratch, "near")
    of_node = full.select("node", "digest", "least").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    scratch.drop("near-contents")
    smallest = of_node.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = scratch.write(of_node.join(smallest, "comp").select("digest", "component_id"), "named")
    out = rows.select("id", "n", "digest").join(named, "digest", "left")
    group = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        group.alias("component_id"),
        F.coalesce(F.col("id") == group, F.lit(False)).alias("kept"),
    )
