"""Byte-level BPE through sentencepiece: model serialised from a rank vocabulary, encode, decode."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import collector_paused

#: Byte b is spelled as the character U+0100 + b: a letter, never white space.
SHIFT = 0x100
_TO_CHARS = {b: SHIFT + b for b in range(256)}
#: Bytes that a worker's table of segments already encoded may take, about. Beyond it, segments
#: are encoded afresh each batch, as those of more than LONG characters always are;
#: results don't depend on it.
MEMO_BYTES, ENTRY_BYTES, LONG = 96 << 20, 250, 64

_NORMAL, _UNKNOWN, _BPE = 1, 2, 2
_SPACE_AFTER_SPACE = re.compile(r"\s ")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def spell(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHARS)


def model_proto(vocab: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is unknown, piece r + 1 the token of rank r,
    scored -r, so that the best-scored merge is the one of lowest rank."""
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, _UNKNOWN)]
    pieces += [_field(1, spell(token).encode()) + _field(2, float(-rank)) + _field(3, _NORMAL) for rank, token in enumerate(vocab)]
    trainer = _field(3, _BPE) + _field(4, len(pieces))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class _Memo(dict):
    """A bounded table; what no longer fits lives in ``spare`` until the batch ends."""

    def __init__(self) -> None:
        self.spare: dict = {}
        self.room = MEMO_BYTES

    def __missing__(self, key):
        return self.spare[key]

    def keep(self, found: dict) -> None:
        for segment, ids in found.items():
            size = ENTRY_BYTES + len(segment) + 36 * len(ids)
            if len(segment) <= LONG and size <= self.room:
                self.room -= size
                self[segment] = ids
            else:
                self.spare[segment] = ids


class ByteBPE:
    """Encodes and decodes with the ranks of a dense vocabulary."""

    def __init__(self, vocab: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.vocab = vocab
        self.words = {token: rank for rank, token in enumerate(vocab)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(vocab))
        self.find = regex.compile(pattern).findall
        self.decimal = [str(i) for i in range(len(vocab))]
        self.memo = _Memo()

    def _segments(self, text: str) -> list[str]:
        """Parts whose pre-tokens are those of the whole text.

        No pre-token goes on over a space that follows a non-space character, so a
        text can be cut before each such space; with spaces in a row it stays whole.
        """
        if _SPACE_AFTER_SPACE.search(text):
            return [text]
        head, *rest = text.split(" ")
        return [head, *(" " + x for x in rest)]

    def _learn(self, segments: set[str]) -> None:
        pre = {s: [p.encode() for p in self.find(s)] for s in segments}
        odd = [*{p for ps in pre.values() for p in ps if p not in self.words}]
        ids = self.model.encode([spell(p) for p in odd], num_threads=1)
        known = {p: tuple(i - 1 for i in x) for p, x in zip(odd, ids, strict=True)}
        word = self.words
        self.memo.keep({s: tuple(chain.from_iterable((word[p],) if p in word else known[p] for p in ps)) for s, ps in pre.items()})

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(texts), 256):
            with collector_paused():
                out = self._encode_some(texts[at : at + 256])
            yield from out

    def _encode_some(self, texts: list[str]) -> list[list[int]]:
        parts = [self._segments(t) for t in texts]
        if new := set(chain.from_iterable(parts)) - self.memo.keys():
            self._learn(new)
        get = self.memo.__getitem__
        out = [list(chain.from_iterable(map(get, p))) for p in parts]
        self.memo.spare = {}
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))

    def digest(self, ids: list[int]) -> str:
        return hashlib.sha256(" ".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest()


_CODERS: dict[str, ByteBPE] = {}


def _coder(vocab: list[bytes], pattern: str, key: str) -> ByteBPE:
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = ByteBPE(vocab, pattern)
    return _CODERS[key]


def _vocab(docs: DataFrame, path: str, pattern: str):
    """Read on the driver, sent once to each executor; its size is the vocabulary's."""
    ranks = load_ranks(path)
    vocab = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in vocab] != list(range(len(vocab))):
        raise ValueError("ranks must run from 0 without gaps")
    key = hashlib.sha256(pattern.encode() + b"\0".join(vocab)).hexdigest()
    return docs.sparkSession.sparkContext.broadcast(vocab), key


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``ids`` array<int> of every whole text; a null text is empty and has no ids."""
    vocab, key = _vocab(docs, path, pattern)

    def run(batches):
        for b in batches:
            coder = _coder(vocab.value, pattern, key)
            ids = list(coder.encode_batch([t or "" for t in b.column(1).to_pylist()]))
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and ``data`` binary: the tokens' bytes in order; null ids give no bytes."""
    vocab, key = _vocab(tokens, path, pattern)

    def run(batches):
        for b in batches:
            coder = _coder(vocab.value, pattern, key)
            data = [coder.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(data, pa.binary())], names=["id", "data"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(run, f"id {kind}, data binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text, decode its ids, and return digests of both.

    Columns: the id, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by one
    space), ``decoded_sha256`` (of the bytes that the ids decode to). One pass without
    an exchange: neither texts nor ids leave their task. Null and empty texts have no
    tokens and the digests of nothing; repeated rows stay repeated; an empty table
    gives no rows; other columns are ignored.
    """
    vocab, key = _vocab(docs, path, pattern)

    def run(batches):
        for b in batches:
            coder = _coder(vocab.value, pattern, key)
            n, ids_hash, text_hash = [], [], []
            for ids in coder.encode_batch([t or "" for t in b.column(1).to_pylist()]):
                n.append(len(ids))
                ids_hash.append(coder.digest(ids))
                text_hash.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.record_batch(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
