"""Best-fit packing of token sequences by exact complements over a length histogram."""

from __future__ import annotations

import json
import os
import zlib
from dataclasses import dataclass, field
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, collector_paused, prefix_counts

#: Bytes that a worker's table of tokenized strings may take, and that of strings seen lately,
#: which keeps none of more than LONG bytes; results don't depend on them.
MEMO_BYTES, LATELY_BYTES, LONG = 160 << 20, 48 << 20, 256
#: What an entry takes beside its characters, about.
ENTRY_BYTES = 200
#: Rows of one length that one window sorts.
PER_RANGE = 256
MAX_RANGES = 65536
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Settings of a tokenizer file for which texts may be cut as WordTokenizer does.
WORD_SETTINGS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordTokenizer:
    """Ids of whole texts by a `tokenizers` file, through tables of strings seen before.

    With WORD_SETTINGS the file's pre-tokenizer drops white space and never joins what it
    parts, so a text is encoded run by run of non-space characters. Runs of plain
    printable characters below U+0250 (where lower-casing and composition are per
    character) are cut by the file's own pattern, and new words are encoded many to a
    call; the token that ends a word shows where the next one starts. Other runs go to
    the library as they are, and with other settings whole texts do.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        own = [x["content"] for x in settings["added_tokens"]]
        self.by_run = (
            all(settings[k] == v for k, v in WORD_SETTINGS.items())
            and settings["model"].get("end_of_word_suffix") == "</w>"
            and all(x.startswith("<|") for x in own)
            and not settings["truncation"] and not settings["padding"]
        )
        self.find = regex.compile(WORD_PATTERN).findall
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.runs: dict[bytes, bytes] = {}
        self.lately: dict[bytes, bytes] = {}
        self.room = MEMO_BYTES

    def _encode(self, strings: list[str]):
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _learn_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        found: dict[bytes, bytes] = {}
        blocks = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        for block, data in zip(blocks, self._encode([b" ".join(b).decode() for b in blocks]), strict=True):
            cuts = np.flatnonzero(self.ends[np.frombuffer(data, "<u4")])
            if len(cuts) != len(block):  # a word that the library parts further
                found.update(zip(block, self._encode([w.decode() for w in block]), strict=True))
            else:
                cuts = [0, *(4 * cuts + 4).tolist()]
                found.update(zip(block, [data[x:y] for x, y in pairwise(cuts)], strict=True))
        return found

    def _learn(self, runs: set[bytes]) -> dict[bytes, bytes]:
        if not runs:
            return {}
        letters = [r for r in runs if r.isalpha()]  # of ASCII
        single = [r.lower() for r in letters]
        plain: dict[bytes, list[bytes]] = {}
        other: list[bytes] = []
        rest = [*runs.difference(letters)]
        # no run holds a space, so all are decoded at once
        for r, s in zip(rest, b" ".join(rest).decode().split(" ") if rest else [], strict=True):
            if s.isprintable() and "<|" not in s and (s.isascii() or (max(s) < "\u0250" and "\u0130" not in s)):
                low = s.lower()
                plain[r] = [low.encode()] if s.isalpha() else [w.encode() for w in self.find(low)]
            else:
                other.append(r)
        words = self._learn_words([*{*single, *chain.from_iterable(plain.values())}])
        get = words.__getitem__
        found = dict(zip(letters, map(get, single), strict=True))
        found.update((r, b"".join(map(get, ws))) for r, ws in plain.items())
        found.update(zip(other, self._encode([r.decode() for r in other]), strict=True))
        return found

    def encode_batch(self, texts: list[bytes]):
        """Little-endian unsigned 32-bit ids of each UTF-8 text."""
        if not self.by_run:
            for t in texts:
                yield from self._encode([t.decode()])
            return
        for at in range(0, len(texts), 512):
            with collector_paused():
                out = self._encode_runs(texts[at : at + 512])
            yield from out

    def _encode_runs(self, texts: list[bytes]) -> list[bytes]:
        parts = [t.split() for t in texts]
        unknown = set().union(*parts)
        unknown -= self.runs.keys()
        again = unknown & self.lately.keys()
        new = {r: self.lately[r] for r in again}
        new.update(self._learn(unknown - again))
        self.runs.update(new)
        out = [b"".join(map(self.runs.__getitem__, p)) for p in parts]
        for r in again:  # seen in two blocks: it stays while there is room
            self.room -= ENTRY_BYTES + len(r) + len(new[r])
        stays = again if self.room > 0 else ()
        passing = new.keys() - stays
        for r in passing:
            del self.runs[r]
        if sum(map(len, passing)) + ENTRY_BYTES * (len(self.lately) + len(passing)) > LATELY_BYTES:
            self.lately = {}
        self.lately.update((r, new[r]) for r in passing if len(r) <= LONG)
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``size`` tokens of every text followed by ``end_id``.

    Columns ``id, piece, start, length, crc``. A null text is empty: its only token is
    the end id. ``tokenizer_path`` must be readable on every executor.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        for b in batches:
            coder = _tokenizer(tokenizer_path)
            at, piece, start, length, crc = [], [], [], [], []
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for row, data in enumerate(coder.encode_batch(texts)):
                data += end
                for k in range(0, len(data), 4 * size):
                    part = data[k : k + 4 * size]
                    at.append(row)
                    piece.append(k // (4 * size))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.record_batch(
                [b.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "crc"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, piece int, start long, length long, crc long")


@dataclass
class Plan:
    """For each run of ranks of one length: the first rank, how many share a sequence,
    the first sequence and the offset there."""

    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    used: dict[int, int] = field(default_factory=dict)

    def add(self, items: list[tuple[int, int]], times: int) -> None:
        offset = 0
        for length, many in items:
            rank = self.used.get(length, 0)
            self.rows.append((length, rank, many, self.sequences, offset))
            self.used[length] = rank + many * times
            offset += length * many
        self.sequences += times


def _merge(lengths: list[int]) -> list[tuple[int, int]]:
    return [(x, lengths.count(x)) for x in sorted(set(lengths), reverse=True)]


def _filler(avail: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths with the sum ``gap``, the longest first."""
    if avail[gap]:
        return [gap]

    def pair(total: int, most: int) -> list[int] | None:
        low = np.arange(max(1, total - most), total // 2 + 1)
        hit = np.flatnonzero((avail[low] > 0) & (avail[total - low] > 0) & ((total - low != low) | (avail[low] > 1)))
        return [int(total - low[hit[0]]), int(low[hit[0]])] if len(hit) else None

    if two := pair(gap, gap - 1):
        return two
    for a in np.flatnonzero(avail[: gap - 1])[::-1]:
        if 3 * a < gap:
            return None
        avail[a] -= 1
        two = pair(gap - int(a), min(int(a), gap - int(a) - 1))
        avail[a] += 1
        if two:
            return [int(a), *two]
    return None


def plan_packing(histogram: dict[int, int], size: int) -> Plan:
    """Pack counts of lengths; work and memory depend on ``size`` and the number of
    distinct lengths, never on the number of rows.

    Long pieces come first: each length that is still there is filled exactly by a
    single, a pair or a triple of other lengths as often as counts allow, which uses
    one of them up. What finds no exact complement is packed best-fit decreasing,
    all bins with equal space and contents at a time.
    """
    avail = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        avail[length] = n
    plan = Plan()
    if avail[size]:
        plan.add([(size, 1)], int(avail[size]))
        avail[size] = 0
    for length in range(size - 1, size // 4 - 1, -1):
        while avail[length] > 0:
            avail[length] -= 1
            rest = _filler(avail, size - length)
            avail[length] += 1
            if not rest:
                break
            items = _merge([length, *rest])
            times = min(int(avail[x]) // k for x, k in items)
            for x, k in items:
                avail[x] -= k * times
            plan.add(items, times)
    _best_fit(avail, size, plan)
    return plan


def _best_fit(avail: np.ndarray, size: int, plan: Plan) -> None:
    bins: list[list[tuple[list[tuple[int, int]], int]]] = [[] for _ in range(size + 1)]
    there = np.zeros(size + 1, bool)

    def put(space: int, contents: list[tuple[int, int]], times: int) -> None:
        bins[space].append((contents, times))
        there[space] = True

    for length in range(size, 0, -1):
        left = int(avail[length])
        while left:
            fit = np.flatnonzero(there[length:])
            space = int(fit[0]) + length if len(fit) else size
            contents, times = bins[space].pop() if len(fit) else ([], left)
            there[space] = bool(bins[space])
            many = min(space // length, left)
            filled = min(times, left // many)
            put(space - many * length, [*contents, (length, many)], filled)
            if len(fit) and times > filled:
                put(space, contents, times - filled)
            left -= many * filled
    for group in bins:
        for contents, times in group:
            plan.add(contents, times)


def pack(pieces: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """Place written ``pieces`` (see token_pieces): adds ``sequence_id`` and ``offset``.

    The driver gets a histogram of at most ``size`` rows. Pieces of equal length are
    interchangeable: their rank among that length picks their place in the plan.
    """
    spark = pieces.sparkSession
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in histogram.collect()}
    plan = plan_packing(counts, size)
    starts = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(starts)

    ways = F.broadcast(
        spark.createDataFrame([(k, min(MAX_RANGES, -(-n // PER_RANGE))) for k, n in counts.items()], "length long, ways long")
    )
    rows = pieces.join(ways, "length").withColumn("rng", F.pmod(F.xxhash64("id", "piece", "crc"), "ways")).drop("ways")
    before = prefix_counts(rows, ["length"], "rng", "before")
    w = Window.partitionBy("length", "rng").orderBy("id", "piece", "start", "crc")
    ranked = (
        rows.withColumn("rn", F.row_number().over(w))
        .join(before, ["length", "rng"])
        .select("id", "piece", "start", "length", "crc", (F.col("before") + F.col("rn") - 1).alias("rank"))
    )

    def place(batches):
        t = sent.value
        keys = t[:, 0] << 48 | t[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            _, first, many, sequence, offset = t[np.searchsorted(keys, length << 48 | rank, "right") - 1].T
            k = rank - first
            yield pa.record_batch(
                [*(b.column(i) for i in range(5)), pa.array(sequence + k // many), pa.array(offset + k % many * length)],
                names=["id", "piece", "start", "length", "crc", "sequence_id", "offset"],
            )

    kind = pieces.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, crc long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every text into pieces of at most ``size`` tokens and pack them into few sequences.

    Columns: the id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset``. Each text is tokenized once; later steps move only these numbers.
    Null and empty texts are one piece of length 1; repeated rows are packed each;
    an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(token_pieces(docs, tokenizer_path, size, end_id, id_col, text_col), "pieces")
    return pack(pieces, size, scratch).withColumnsRenamed({"id": id_col, "crc": "ids_crc32"})
