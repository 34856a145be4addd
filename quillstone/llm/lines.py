"""Fuzzy line deduplication: lines that share a key, a SimHash distance, edit similarity, one line per group."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import pairwise
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from xxhash import xxh3_128_digest

from .common import Scratch, collector_paused
from .components import LARGE, components, least_reached

SIMILARITY = 0.8
#: Shorter normalised lines meet as equal lines only.
FUZZY_CHARS = 16
#: A key is the least hash of the line's grams of GRAM bytes that fall in one of KEYS bins of
#: BINS. Keys of more than LARGE lines are compared with the lines at hand, in blocks of BLOCK.
GRAM, KEYS = 14, 8
BINS = 2 * KEYS
BLOCK = 4096
#: Entries of a large key that are compared with all others at a time, at most.
STRIP = 256
#: Lines under SHORT bytes have SHORT_KEYS more keys, of two least hashes of grams of SMALL bytes.
SHORT, SHORT_KEYS, SMALL = 64, 6, 6
#: Of the 128 bits of two SimHashes over grams of SMALL bytes, how many may differ; see
#: _allowed. Of long lines that edits bring down to a similarity of 0.8, 99 in 100 differ in 41
#: at most, unlike ones in 60 or so, and chance pairs grow with the square of the lines.
DISTANCE = 40
#: Bytes hashed at a time, and of a piece; longer lines are taken in pieces.
HASHED, PIECE = 1 << 15, 1 << 14
#: Bytes of text whose entries (some 36 bytes for each of a line's keys) one task gathers.
RANGE_BYTES = 1 << 26
#: Lines whose entries a task passes on at a time.
DEALT = 20_000
#: Bits of the map, sent to all tasks, of the nodes whose texts are needed (a power of two).
MARKS = 1 << 26
#: Pairs of lines that are verified together, at least for each 64 diagonals, and at most; of how many
#: words of 64 diagonals at most, and how many words their characters' places and their diagonals take.
TOGETHER, BATCH, WIDEST, PLACES, CELLS = 12, 8192, 32, 1 << 22, 1 << 15
#: Characters of the pairs that a task verifies at a time, of a text from which on
#: a pair's characters are counted first, and how many pairs' are counted at once.
GATHERED, COUNTED, TALLIED = 1 << 25, 1024, 256
#: Columns after which pairs verified together are looked at for ones that can't be links.
STEP = 16

_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)
_NONE = _U(1 << 63)
_LOW, _HIGH = _U((1 << 32) - 1), ~_U((1 << 32) - 1)
_ELSEWHERE = np.random.default_rng(20240517).integers(0, 1 << 30, (64, 32))
_PUNCTUATION = re.compile(r"[^\w\s]+")
_ASCII = bytes(range(128))
_LOWER = bytes(
    (b | 32 if 65 <= b <= 90 else b) if b == 10 or chr(b).isalnum() or b == 95 or b > 127 else 32 for b in range(256)
)


@lru_cache(maxsize=1 << 16)
def _plain(c: str) -> str | None:
    """What a character past ASCII is in a normalised line (a space parts words), where its neighbours and its
    lower case don't matter to that; else null."""
    low = c.lower()
    if c == "Σ" or len(low) > 1:
        return None
    return low if low.isalnum() else " "


def _lowered(data: bytes) -> bytes | None:
    """A text in lower case, a space for each character that parts words."""
    if not data.isascii():
        for c in set(data.translate(None, _ASCII).decode()):
            if (x := _plain(c)) is None:
                return None
            if x != c:
                data = data.replace(c.encode(), x.encode())
    return data.translate(_LOWER)


def normalised_lines(text: str | bytes) -> list[bytes]:
    """Each line in UTF-8: lower case, without punctuation, words parted by one space."""
    text = text.encode() if isinstance(text, str) else text
    data = _lowered(text)
    if data is None:
        return [" ".join(_PUNCTUATION.sub(" ", x.lower()).split()).encode() for x in text.decode().split("\n")]
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" ").split(b"\n")


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance: what both texts begin and end with goes first, the rest is
    bit-parallel over one whole number per column (Myers 1999). Where no way through a
    column can end within ``most``, the least that one can is the result."""
    if a == b:
        return 0
    start = len(commonprefix([a, b]))
    a, b = a[start:], b[start:]
    end = len(commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    look = max(32, len(a) // 16)
    for t, c in enumerate(b, 1):
        same = places.get(c, 0)
        flat = (((same & up) + up) ^ up) | same | down
        rise, fall = down | ~(flat | up) & full, up & flat
        score += bool(rise & last) - bool(fall & last)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | ~(flat | rise) & full, rise & flat
        if most is not None and t % look == 0 and (least := _least_end(up, down, t, len(a), len(b))) > most:
            return least
    return score


def _least_end(up: int, down: int, t: int, m: int, n: int) -> int:
    """A bound of the distance from below by column ``t``: its entries, and what the lengths of
    the rests differ in."""
    up, down = (np.unpackbits(np.frombuffer(x.to_bytes(m // 8 + 1, "little"), np.uint8), bitorder="little")[:m].astype(np.int32) for x in (up, down))
    column = t + np.cumsum(up - down)
    rest = np.abs(np.arange(m - 1, -1, -1) - (n - t))
    return int(min(t + abs(m - n + t), (column + rest).min()))


def edits_by_words(x: list[str], y: list[str], most: int) -> int:
    """The length of one way to edit words ``x`` into ``y``, which bounds their edit distance
    from above; beyond ``most`` it stops. It replaces a word, or leaves one out, where what
    follows agrees again."""
    i = j = cost = 0
    m, n = len(x), len(y)
    while cost <= most and i < m and j < n:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
        elif x[i + 1 : i + 2] == y[j + 1 : j + 2]:
            cost += max(len(x[i]), len(y[j])) if max(len(x[i]), len(y[j])) < 4 else edit_distance(x[i], y[j])
            i, j = i + 1, j + 1
        elif j + 1 < n and x[i] == y[j + 1]:
            cost += len(y[j]) + 1
            j += 1
        elif i + 1 < m and x[i + 1] == y[j]:
            cost += len(x[i]) + 1
            i += 1
        else:
            cost += edit_distance(x[i], y[j])
            i, j = i + 1, j + 1
    return cost + sum(map(len, x[i:])) + m - i + sum(map(len, y[j:])) + n - j


def similar(a: str, b: str, least: float) -> bool:
    """Whether one less the edit distance over the longer length is at least ``least``."""
    most = int(max(len(a), len(b)) * (1 - least) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    return edits_by_words(a.split(" "), b.split(" "), most) <= most or edit_distance(a, b, most) <= most


def _common(a: str, b: str) -> int:
    """How many characters both texts begin with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _between(a: str, b: str) -> int:
    """A bound of the distance from above: the longer rest between what both texts begin and end with."""
    start = _common(a, b)
    a, b = a[start:], b[start:]
    return max(len(a), len(b)) - _common(a[::-1], b[::-1])


def _padded(texts: list, width: int) -> np.ndarray:
    """Characters of texts (or bytes) by row, spaces beyond their ends."""
    if isinstance(texts[0], bytes):
        return np.frombuffer(b"".join([x.ljust(width) for x in texts]), np.uint8).reshape(-1, width)
    return np.frombuffer("".join([x.ljust(width) for x in texts]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width)


def edit_distances(pairs: list[tuple], most: np.ndarray | None = None) -> np.ndarray:
    """Levenshtein distances of pairs of texts (or of bytes), of any lengths: the bit-parallel columns of all pairs
    are found together, in words of 64 rows.

    Of a pair whose distance is beyond its ``most``, some number beyond it is the result. A way within ``most``
    leaves the diagonals of its two ends by half of what it has beyond their difference at most, so
    that only ``most`` + 1 diagonals are looked at, in bits that go down a row with each column (Hyyro 2003)."""
    number: dict = {}
    i, j = (np.array([number.setdefault(p[k], len(number)) for p in pairs], np.int64) for k in (0, 1))
    texts = list(number)
    size = np.array([len(x) for x in texts], np.int64)
    i, j = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
    m, n = size[i], size[j]
    most = n if most is None else np.asarray(most, np.int64)
    out = n - m  # also where one is empty
    at = np.flatnonzero((out <= most) & (m > 0))
    at = at[np.argsort(-n[at], kind="stable")]
    if len(at):
        out[at] = _banded(texts, i[at], j[at], m[at], n[at], most[at])
    return out


def _banded(texts: list, i: np.ndarray, j: np.ndarray, m: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """edit_distances of texts of ``m`` and ``n`` characters, the longest ``n`` first and 0 < ``m`` <= ``n`` <= ``m + most``.
    The last bit is the lowest row, ``low`` diagonals below the first one."""
    low = (most - (n - m)) // 2
    words = int((2 * low + n - m).max()) // 64 + 1
    last = 64 * words - 1
    one, top, six, wrap = _U(1), _U(63), _U(6), _U(63)
    given = i, j
    (i, first), (j, second) = ((np.unique(x, return_inverse=True)[1], [texts[k] for k in np.unique(x).tolist()]) for x in (i, j))
    rows, text = _padded(first, int(m.max())), _padded(second, int(n[0]))
    code = np.zeros(int(max(rows.max(), text.max())) + 1, np.int32)
    code[rows] = 1
    kinds = int(code.sum()) + 1  # 0 are those that the first texts don't have
    code[code > 0] = np.arange(1, kinds, dtype=np.int32)
    rows, text = (np.ascontiguousarray(code[x].T) for x in (rows, text))
    # where each first text has each character, word by word after so many that no row is in; what
    # it is filled up with are rows below its last one, which change none above
    room = kinds * (max(len(text) + int(low.max()), len(rows) + last) // 64 + words + 2)
    own = np.arange(len(first)) * room
    if len(first) * room > PLACES and len(n) > 1:  # many scripts or long texts: fewer at a time
        half = len(n) // 2
        del rows, text
        return np.concatenate([_banded(texts, given[0][x], given[1][x], m[x], n[x], most[x]) for x in (slice(half), slice(half, None))])
    places = np.zeros(len(first) * room, _U)
    for t, x in enumerate(rows):
        places[own + (words + t // 64) * kinds + x] |= one << _U(t % 64)
    own = own[i] + (low + 1) // 64 * kinds
    off = ((low + 1) % 64).astype(_U)
    begin = np.clip(last - low - 64 * np.arange(words)[:, None], 0, 64).astype(_U)
    up, down = ~_U(0) << begin, np.zeros((words, len(n)), _U)
    level = np.zeros(len(n), _U)  # columns in which the lowest row's entry is that of the diagonal before
    out, at = np.empty(len(n), np.int64), np.arange(len(n))
    two, flow, word = np.empty((6, words, len(n)), _U), np.empty((2, len(n)), _U), np.empty((words + 1) * len(n), _U)
    chars = np.empty(len(n), np.int32)
    place, further = np.empty((words + 1) * len(n), np.int64), kinds * np.arange(1, words + 1)[:, None]
    longer = np.searchsorted(-n, -np.arange(int(n[0])), side="left").tolist()  # pairs longer than each t come first
    for t in range(len(longer)):
        live = longer[t]
        if not live:
            break
        same, d, rise, fall, x, y = two[:, :, :live]
        at_words, found = (x[: (words + 1) * live].reshape(-1, live) for x in (place, word))
        text[t].take(j[:live], out=chars[:live], mode="clip")
        np.add(own[:live], chars[:live], out=at_words[0])
        np.add(at_words[0], further, out=at_words[1:])
        places.take(at_words, out=found, mode="clip")
        shift = off[:live]
        np.right_shift(found[:-1], shift, out=same)
        np.subtract(_U(64), shift, out=flow[0, :live])
        np.left_shift(found[1:], flow[0, :live], out=x)  # none of it at 64
        same |= x
        shift += one
        np.right_shift(shift, six, out=flow[0, :live])
        shift &= wrap
        flow[0, :live] *= _U(kinds)
        own[:live] += flow[0, :live].view(np.int64)
        p, q = up[:, :live], down[:, :live]
        np.bitwise_and(same, p, out=x)
        np.add(x, p, out=d)
        if words > 1:
            carry = flow[0, :live]
            for w in range(words):
                if w:
                    d[w] += carry
                if w < words - 1:
                    np.invert(d[w], out=carry)
                    carry &= p[w]
                    carry |= x[w]
                    carry >>= top
        d ^= p
        d |= same
        d |= q
        np.bitwise_or(d, p, out=rise)
        np.invert(rise, out=rise)
        rise |= q
        np.bitwise_and(d, p, out=fall)
        z = flow[1, :live]
        np.right_shift(d[words - 1], top, out=z)
        level[:live] += z
        np.right_shift(d, one, out=x)
        if words > 1:
            np.left_shift(d[1:], top, out=y[1:])
            x[:-1] |= y[1:]
        np.bitwise_or(x, rise, out=p)
        np.invert(p, out=p)
        p |= fall
        np.bitwise_and(x, rise, out=q)
        if t % STEP == STEP - 1:
            # no entry of a diagonal is less than those before, and the last one is as many rows off
            least = t + 1 - level[:live].view(np.int64) - (n - m)[:live]
            gone = np.flatnonzero(least > most[:live])
            if 4 * len(gone) >= live:
                out[at[gone]] = least[gone]
                stay = np.ones(len(at), bool)
                stay[gone] = False
                ended = np.flatnonzero(stay[live:]) + live
                out[at[ended]] = _ends(up[:, ended], down[:, ended], level[ended], low[ended], m[ended], n[ended], last)
                stay[live:] = False
                at, j, m, n, most, low, own, off, level = (x[stay] for x in (at, j, m, n, most, low, own, off, level))
                longer[t + 1 :] = np.searchsorted(-n, -np.arange(t + 1, len(longer)), side="left").tolist()
                up, down = up[:, stay], down[:, stay]
    out[at] = _ends(up, down, level, low, m, n, last)
    return out


def _ends(up: np.ndarray, down: np.ndarray, level: np.ndarray, low: np.ndarray, m: np.ndarray, n: np.ndarray, last: int) -> np.ndarray:
    """The entries of row ``m`` after column ``n``: the lowest row's, less what the rows between rise by."""
    base = 64 * np.arange(len(up))[:, None]
    first, end = np.clip(last - (n - m) - low - base, 0, 64).astype(_U), np.clip(last - base, 0, 64).astype(_U)
    rows = (~_U(0) << first) & ~(~_U(0) << end)
    rise = np.bitwise_count(up & rows).astype(np.int64).sum(axis=0) - np.bitwise_count(down & rows).astype(np.int64).sum(axis=0)
    return low + n - level.view(np.int64) - rise


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the length, how many characters it has of each of 64 classes of their numbers, and how many
    pairs of neighbours of each of 256."""
    n = np.array([len(x) for x in texts], np.int64)
    chars, grams = np.zeros((len(n), 64), np.int32), np.zeros((len(n), 256), np.int32)
    place = np.cumsum(n) // PIECE  # so many at a time that they stay at hand
    cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True]) if len(n) else []
    for x, y in pairwise(cuts):
        flat = np.frombuffer("".join(texts[x:y]).encode("utf-32-le", "surrogatepass"), np.uint32)
        own = np.repeat(np.arange(y - x), n[x:y])
        chars[x:y] = np.bincount((own << 6) + (flat & 63), minlength=(y - x) << 6).reshape(-1, 64)
        two = (own[:-1] << 8) + (flat[:-1] * np.uint32(37) + flat[1:] & 255)
        grams[x:y] = np.bincount(two[own[:-1] == own[1:]], minlength=(y - x) << 8).reshape(-1, 256)
    return n, chars, grams


def _possible(counts: tuple[np.ndarray, np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of texts ``i`` and ``j`` of _counts may be similar: an edit changes one character on each
    side at most, and two pairs of neighbours."""
    n, chars, grams = counts
    out = np.ones(len(i), bool)
    for k in range(0, len(i), TALLIED):
        x, y = i[k : k + TALLIED], j[k : k + TALLIED]
        most = (np.maximum(n[x], n[y]) * (1 - least) + 1e-9).astype(np.int64)
        more = np.abs(n[x] - n[y])
        may = more <= most
        may &= np.abs(chars[x] - chars[y]).sum(axis=1) + more <= 2 * most
        some = np.flatnonzero(may)
        x, y = x[some], y[some]
        gap = np.abs(np.maximum(n[x] - 1, 0) - np.maximum(n[y] - 1, 0))
        may[some] = np.abs(grams[x] - grams[y]).sum(axis=1) + gap <= 4 * most[some]
        out[k : k + TALLIED] = may
    return out


def _unlike(pairs: list[tuple[str, str]]) -> np.ndarray:
    """A bound of each distance from below: how many characters of one text are beyond those of the
    other, by the 64 classes of their numbers."""
    n = np.array([len(x) for side in zip(*pairs, strict=True) for x in side])
    text = "".join(x for side in zip(*pairs, strict=True) for x in side)
    kind = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) & 63
    count = np.bincount(np.repeat(np.arange(len(n)) << 6, n) + kind, minlength=len(n) << 6).reshape(2, len(pairs), 64)
    more = count[0] - count[1]
    return np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))


def similar_pairs(pairs: list[tuple[str, str]], least: float) -> np.ndarray:
    """``similar`` of each pair. Pairs whose diagonals take as many words are compared together where there
    are enough of them: TOGETHER times as many as these words, or 8 times TOGETHER of shorter texts."""
    out = np.zeros(len(pairs), bool)
    size = np.array([[len(x) for x, _ in pairs], [len(y) for _, y in pairs]], np.int64)
    longest = size.max(axis=0)
    most = (longest * (1 - least) + 1e-9).astype(np.int64)
    possible = longest - size.min(axis=0) <= most
    long = np.flatnonzero(possible & (longest >= COUNTED))
    for k in range(0, len(long), TALLIED):
        some = long[k : k + TALLIED]
        possible[some] = _unlike([pairs[i] for i in some]) <= most[some]
        for i in some[possible[some]]:
            if _between(*pairs[i]) <= most[i]:
                out[i], possible[i] = True, False
    of_width: dict[int, list[int]] = {}
    width = most // 64 + 1  # words that the diagonals take
    for i in np.flatnonzero(possible)[np.argsort(longest[possible], kind="stable")].tolist():
        w = int(width[i])
        of_width.setdefault(w if w < 5 else 4 * w.bit_length() + (w >> w.bit_length() - 3), []).append(i)
    some: list[int] = []
    for left, more in zip(range(len(of_width) - 1, -1, -1), of_width.values(), strict=True):
        some = more[::-1] + some[::-1]  # the longest first
        words = int(width[some[0]])
        if (len(some) < TOGETHER * words if longest[some[0]] >= COUNTED else len(some) < 8 * TOGETHER) or words > WIDEST:
            if left and words < 4:  # too few, so that wider ones take them along
                some = some[::-1]
                continue
            out[some] = [similar(*pairs[i], least) for i in some]
            some = []
            continue
        k = 0
        while k < len(some):
            at = some[k : k + max(1, min(BATCH, CELLS // words, PLACES // max(1, int(longest[some[k]]))))]
            alike = int(np.searchsorted(-longest[at], -0.5 * longest[at[0]], side="right"))
            at = at[: max(alike, 8 * TOGETHER)]
            out[at] = edit_distances([pairs[i] for i in at], most[at]) <= most[at]
            k += len(at)
        some = []
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> _U(32)
    h *= _A
    h ^= h >> _U(29)
    h *= _B
    h ^= h >> _U(32)
    return h


def _grams(pieces: list[bytes], *sizes: int):
    """For each size (6 to 16 bytes): 64-bit hashes of all places of the pieces, which pieces are
    padded to the largest size, how many places each has, and at which no gram begins."""
    data = [x.ljust(max(sizes)) for x in pieces]
    counts = np.array([len(x) for x in data])
    ends = np.cumsum(counts)
    n = int(ends[-1])
    eight = np.ndarray((n + 8,), "<u8", b"".join(data) + bytes(16), strides=(1,)).copy()  # the word from each byte on
    for size in sizes:
        if size < 8:
            h = eight[:n] << _U(8 * (8 - size))
            h &= _HIGH
            h |= eight[:n] & _LOW
        else:
            h = eight[:n] * _B
            h ^= eight[size - 8 : size - 8 + n] + _A
        yield _mixed(h), counts, (ends - np.arange(1, size)[:, None]).reshape(-1)


def _pieces(lines: list[bytes]):
    """``lines`` in pieces that overlap by a gram less a byte, some HASHED bytes at a time: the
    first line, the line of each piece from there, the pieces."""
    own: list[int] = []
    pieces: list[bytes] = []
    room = HASHED
    for i, x in enumerate(lines):
        whole = len(x) < PIECE + GRAM
        for part in (x,) if whole else [x[k : k + PIECE + GRAM - 1] for k in range(0, len(x) - GRAM + 1, PIECE)]:
            if own and len(part) > room:
                yield own[0], np.array(own) - own[0], pieces
                own, pieces, room = [], [], HASHED
            own.append(i)
            pieces.append(part)
            room -= len(part)
    if own:
        yield own[0], np.array(own) - own[0], pieces


def _lower(least: np.ndarray, own: np.ndarray, h: np.ndarray, counts: np.ndarray, none: np.ndarray) -> None:
    """Take the hashes but those at ``none`` into ``least``, the least of each line and bin."""
    bins = least.shape[1]
    place = ((h >> _U(32)) * _U(bins) >> _U(32)).view(np.int64)
    place += np.repeat(own * bins, counts)
    h = h * _B
    h >>= _U(4)
    h[none] = _NONE
    np.minimum.at(least.reshape(-1), place, h)


def _filled(least: np.ndarray) -> np.ndarray:
    """Symbols of each line: an empty bin takes the least hash of the first bin that is not
    empty in a fixed random order."""
    bins = least.shape[1]
    out, (i, j) = least.copy(), np.nonzero(least == _NONE)
    for t, other in enumerate(_ELSEWHERE % bins, 1):
        if not len(i):
            break
        x = least[i, other[j]]
        out[i, j] = np.where(x == _NONE, x, x + _U(t << 40))
        i, j = i[x == _NONE], j[x == _NONE]
    return _mixed(out + np.arange(1, bins + 1, dtype=_U) * _B)


def fingerprints(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line the SimHash (two longs), KEYS keys, as many further symbols that no search takes yet, and
    SHORT_KEYS keys that only lines under SHORT bytes have (else 0)."""
    least = np.full((len(lines), BINS), _NONE, _U)
    votes = np.zeros((len(lines), 128), np.int32)
    for low, own, pieces in _pieces(lines):
        n = int(own[-1]) + 1
        (small, some, no_small), (large, many, no_large) = _grams(pieces, SMALL, GRAM)
        _lower(least[low : low + n], own, large, many, no_large)
        # a gram votes for or against one bit
        at = (small & _U(255)).view(np.int64)
        at += np.repeat(own * 256, some)
        at[no_small] = n * 256
        cast = np.bincount(at, minlength=n * 256 + 1)[:-1].reshape(n, 2, 128)
        votes[low : low + n] += (cast[:, 0] - cast[:, 1]).astype(np.int32)
    keys = _filled(least)
    short = np.flatnonzero([len(x) < SHORT for x in lines])
    pairs = np.full((len(short), 2 * SHORT_KEYS), _NONE, _U)
    for low, own, pieces in _pieces([lines[i] for i in short]):
        ((small, some, none),) = _grams(pieces, SMALL)
        _lower(pairs[low : low + int(own[-1]) + 1], own, small, some, none)
    pairs = _filled(pairs)
    both = np.zeros((len(lines), SHORT_KEYS), _U)
    both[short] = _mixed(pairs[:, ::2] * _A + pairs[:, 1::2]) | _U(1)
    return np.packbits(votes > 0, axis=1).view("<u8"), keys[:, :KEYS], keys[:, KEYS:], both


#: A line under one of its keys.
ENTRY = np.dtype([("key", "<u8"), ("size", "<u4"), ("node", "<i8"), ("s0", "<u8"), ("s1", "<u8")])


def entries(lines: dict[bytes, bytes]) -> np.ndarray:
    """The entries of lines, by digest, in order of their keys."""
    clean = list(lines.values())
    sims, keys, _, short = fingerprints(clean)
    every = np.hstack([keys, short])
    key = every.reshape(-1)
    at = np.argsort(key)
    at = at[np.searchsorted(key[at], _U(0), side="right") :]
    line = np.empty(len(clean), ENTRY)
    line["size"] = [len(x) if x.isascii() else len(x.decode()) for x in clean]
    line["node"] = np.frombuffer(b"".join(lines), "<i8")[::2]
    line["s0"], line["s1"] = sims[:, 0], sims[:, 1]
    out = line[at // every.shape[1]]
    out["key"] = key[at]
    return out


def _group_sizes(key: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, how often its value is there."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    counts = np.diff(np.r_[starts, len(key)])
    return np.repeat(counts, counts)


def close_pairs(e: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of entries with a common key, of sizes and SimHashes that a link allows. Each
    place meets the next one, the one after, and so on while key and size allow it."""
    i = np.arange(len(e) - 1)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = 0
    while len(i):
        step += 1
        j = i + step
        i = i[j < len(e)]
        j = i + step
        i = i[(e["key"][i] == e["key"][j]) & (e["size"][i] >= similarity * e["size"][j] - 1e-6)]
        j = i + step
        bits = np.bitwise_count(e["s0"][i] ^ e["s0"][j]).astype(np.int64) + np.bitwise_count(e["s1"][i] ^ e["s1"][j])
        close = np.flatnonzero((bits <= _allowed(e["size"][j])) & (e["node"][i] != e["node"][j]))
        left.append(i[close])
        right.append(j[close])
    return np.concatenate(left), np.concatenate(right)


def _allowed(size):
    """How many bits the SimHashes of a pair may differ in, by the larger size."""
    return np.minimum(DISTANCE, 10 + size.astype(np.int64) // 4)


def linked_entries(e: np.ndarray, place: int, keys: np.ndarray, norm: list[str], side: np.ndarray | None, similarity: float):
    """Components among entries of one key, by the links of all pairs that are close and don't share
    a key before this one (of the number ``place``), but for pairs that links already join.

    Three rows of middle sizes meet all others first, then each strip of rows all later ones, as
    arrays. Of the close pairs of different components that a component has part in, one is
    verified, then four, and so on until no pair is left, so that few pairs join n copies of a
    line. ``side`` (two values) leaves out the pairs of one side. Gives places of entries that are
    joined to one before, and that one's place.
    """
    order = np.argsort(e["size"], kind="stable")
    size, s0, s1, node = (e[c][order] for c in ("size", "s0", "s1", "node"))
    size = size.astype(np.int64)
    before = keys[order, :place]
    part = None if side is None else side[order]
    counts = _counts([norm[i] for i in order])
    n = len(e)
    label = np.arange(n)

    def nth(group: np.ndarray) -> np.ndarray:
        """How many places before have the same value."""
        by = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.r_[True, group[by][1:] != group[by][:-1]])
        out = np.empty(len(by), np.int64)
        out[by] = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
        return out

    def close(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows x and y, of those in ``apart``, that may be linked."""
        apart &= (label[x][:, None] != label[y]) & (node[x][:, None] != node[y])
        if part is not None:
            apart &= part[x][:, None] != part[y]
        at, to = np.nonzero(apart)
        at, to = np.minimum(x[at], y[to]), np.maximum(x[at], y[to])
        bits = np.bitwise_count(s0[at] ^ s0[to]).astype(np.int64) + np.bitwise_count(s1[at] ^ s1[to])
        near = (bits <= _allowed(size[to])) & (size[at] >= similarity * size[to] - 1e-6)
        at, to = at[near], to[near]
        if 4 * len(at) < len(x) * n:  # else copies, which are soon one component
            met = np.zeros(len(at), bool)
            for k in range(place):
                met |= (before[at, k] == before[to, k]) & (before[at, k] != 0)
            at, to = at[~met], to[~met]
            may = _possible(counts, at, to, similarity)
            at, to = at[may], to[may]
        return at, to

    def join(at: np.ndarray, to: np.ndarray) -> None:
        """Join rows ``at`` and ``to`` that are linked."""
        nonlocal label
        few = 1
        while True:
            still = label[at] != label[to]
            at, to = at[still], to[still]
            if not len(at):
                return
            wanted = np.ones(len(at), bool)
            if len(at) > STRIP:
                wanted = (nth(label[at]) < few) | (nth(label[to]) < few)
            a, b = at[wanted], to[wanted]
            linked = similar_pairs([(norm[order[j]], norm[order[k]]) for j, k in zip(a, b, strict=True)], similarity)
            label = least_reached(label, a[linked], b[linked])
            at, to = at[~wanted], to[~wanted]
            few *= 4 if 4 * linked.sum() > len(a) else n  # where few are links, the others hardly save any

    for x in (n // 2, n // 4, 3 * n // 4):
        join(*close(np.array([x]), np.arange(n), np.ones((1, n), bool)))
    held, i = [], 0
    while i < n - 1:
        x = np.arange(i, min(i + STRIP, n - 1))
        # of the later ones, which are as large at least, those up to the most that a link allows
        y = np.arange(i + 1, int(np.searchsorted(similarity * size - 1e-6, size[x[-1]], side="right")))
        i = int(x[-1]) + 1
        held.append(close(x, y, x[:, None] < y))
        if i >= n - 1 or sum(len(at) for at, _ in held) > 4 * BATCH:
            join(*(np.concatenate(side) for side in zip(*held, strict=True)))
            held = []
    joined = np.flatnonzero(label != np.arange(n))
    return order[joined], order[label[joined]]


def link_large_keys(entry: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` that links join among the lines of ``entry(key, node)`` that share a key, of
    ``known(node, digest, norm)``; for each key a row less than its lines at most (and block).

    All pairs of a key meet, as arrays, each under the first of their common keys only. A
    key of more than BLOCK lines is parted at random, and each two parts meet in a task."""

    def tell(batches):
        for b in batches:
            clean = [x.encode() for x in b.column(1).to_pylist()]
            sims, keys, _, short = fingerprints(clean)
            every = np.ascontiguousarray(np.hstack([keys, short]))
            told = [pa.array([x.tobytes() for x in every], pa.binary())] + [pa.array(np.ascontiguousarray(sims[:, k]).view(np.int64)) for k in (0, 1)]
            yield pa.record_batch([b.column(0), pc.utf8_length(b.column(1)), b.column(1), *told], names=["node", "size", "norm", "keys", "s0", "s1"])

    def meet(rows: pa.Table) -> pa.Table:
        e = np.empty(rows.num_rows, ENTRY)
        for c in ("key", "node", "size", "s0", "s1"):
            x = rows[c].to_numpy()
            e[c] = x.view("<u8") if c in ("key", "s0", "s1") else x
        keys = np.frombuffer(b"".join(rows["keys"].to_pylist()), "<u8").reshape(len(e), -1)
        own = np.flatnonzero((keys == e["key"][:, None]).any(axis=0))
        i, j, block = (rows[c].to_numpy() for c in ("i", "j", "block"))
        side = None if i[0] == j[0] else block == i[0]
        with collector_paused():
            a, b = linked_entries(e, int(own[0]) if len(own) else 0, keys, rows["norm"].to_pylist(), side, similarity)
        a, b = e["node"][a], e["node"][b]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    told = known.select("node", "norm").join(entry.select("node").distinct(), "node", "left_semi").mapInArrow(tell, "node long, size int, norm string, keys binary, s0 long, s1 long")
    parts = entry.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    block = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")
    rows = entry.join(parts, "key").select("key", "node", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select("key", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # the work goes by pairs of lines rather than by bytes
    tasks = max(int(entry.sparkSession.conf.get("spark.sql.shuffle.partitions")), entry.count() // BLOCK)
    return rows.join(told, "node").repartition(tasks, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(meet, "a long, b long")


_FOUND = "key long, size int, a long, b long, s0 long, s1 long"


def meetings(docs: DataFrame, similarity: float) -> DataFrame:
    """What meets under the keys of the lines of ``docs(row, id, text)``: candidate pairs ``a, b``
    (``key`` is null), and all entries of keys with more than LARGE (``b`` is null).

    Tasks pass on their entries as blocks of bytes, one for each range of keys, and the
    tasks that gather a range sort it and compare its keys' entries as arrays. A key that is large in one
    batch already does not gather: its entries there go on to any range, and one of them to
    its own, marked by the size 0, so that all others of the key go on too.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // RANGE_BYTES))

    def dealt(lines: dict[bytes, bytes], number: int) -> pa.RecordBatch:
        pid, data = [], []
        e = entries(lines)
        large = _group_sizes(e["key"]) > LARGE
        if large.any():
            some = e[large]
            pid.append(ranges + number % ranges)
            data.append(some.tobytes())
            mark = some[np.r_[True, some["key"][1:] != some["key"][:-1]]]
            mark["size"] = 0
            e = np.concatenate([e[~large], mark])
            e = e[np.argsort(e["key"], kind="stable")]
        place = ((e["key"] >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
        pid += place[cuts[:-1]].tolist()
        data += [e[x:y].tobytes() for x, y in pairwise(cuts)]
        return pa.record_batch([pa.array(pid, pa.int32()), pa.array(data, pa.binary())], names=["pid", "data"])

    def deal(batches):
        lines: dict[bytes, bytes] = {}
        number = 0
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                for x in normalised_lines(t or b""):
                    if len(x) >= 4 * FUZZY_CHARS or len(x) >= FUZZY_CHARS and len(x.decode()) >= FUZZY_CHARS:
                        lines.setdefault(xxh3_128_digest(x), x)
                if len(lines) >= DEALT:
                    yield dealt(lines, number)
                    lines, number = {}, number + 1
        if lines:
            yield dealt(lines, number)

    def meet(blocks: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(blocks["data"].to_pylist()), ENTRY)
        if blocks["pid"][0].as_py() >= ranges:
            large, left, right = e, *np.empty((2, 0), np.int64)
        else:
            key = np.ascontiguousarray(e["key"])
            at = np.argsort(key)
            e = e[at[_group_sizes(key[at]) > 1]]  # most keys are those of one line
            e = e[np.lexsort((e["node"], e["size"], e["key"]))]
            same = np.r_[False, (e["key"][1:] == e["key"][:-1]) & (e["node"][1:] == e["node"][:-1]) & (e["size"][1:] == e["size"][:-1])]
            e = e[~same[: len(e)]]
            marked = np.unique(e["key"][e["size"] == 0])
            e = e[e["size"] > 0]
            some = _group_sizes(e["key"]) if len(e) else np.empty(0, np.int64)
            open_ = (some > LARGE) | np.isin(e["key"], marked)
            large, e = e[open_], e[~open_ & (some > 1)]
            left, right = close_pairs(e, similarity)
        m, n = len(large), len(left)
        a = np.minimum(e["node"][left], e["node"][right])
        b = np.maximum(e["node"][left], e["node"][right])
        pairs = np.unique(np.stack([a, b]), axis=1) if n else np.empty((2, 0), np.int64)
        nulls = [pa.nulls(pairs.shape[1], t) for t in (pa.int64(), pa.int32())]
        own = [pa.array(np.ascontiguousarray(large[c]).view("<i8")) for c in ("key", "node", "s0", "s1")]
        key, node, s0, s1 = own
        columns = [
            (key, nulls[0]), (pa.array(large["size"].astype(np.int32)), nulls[1]), (node, pa.array(pairs[0])),
            (pa.nulls(m, pa.int64()), pa.array(pairs[1])), (s0, nulls[0]), (s1, nulls[0]),
        ]
        return pa.table([pa.concat_arrays(x) for x in columns], names=["key", "size", "a", "b", "s0", "s1"])

    return docs.select("text").mapInArrow(deal, "pid int, data binary").groupBy("pid").applyInArrow(meet, _FOUND)


def node_marks(nodes: DataFrame) -> np.ndarray:
    """A map of MARKS bits in words of 64, in which those of ``nodes(node)`` are set."""
    word = F.shiftright(F.col("node").bitwiseAND(MARKS - 1), 6).alias("word")
    bit = F.expr("shiftleft(1L, cast(node & 63 as int))")
    found = nodes.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(MARKS // 64, _U)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(_U)
    return out


def marked(marks: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Which nodes have their bit set; some have that were not meant."""
    at = node.view(_U) & _U(MARKS - 1)
    return (marks[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)


def document_lines(docs: DataFrame, marks: np.ndarray) -> DataFrame:
    """Lines that have a word of ``docs(row, id, text)``: ``row, id, line, digest`` (16 bytes) and, where
    marked, ``node`` (half of the digest) and ``norm``, the normalised line."""
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches):
        for b in batches:
            texts = b.column(2).cast(pa.binary()).to_pylist()
            for at in range(0, len(texts), 256):
                row, line, clean, digest = [], [], [], []
                for i, t in enumerate(texts[at : at + 256], at):
                    for k, x in enumerate(normalised_lines(t or b"")):
                        if x:
                            row.append(i)
                            line.append(k)
                            clean.append(x)
                            digest.append(xxh3_128_digest(x))
                node = np.frombuffer(b"".join(digest), "<i8")[::2]
                told = marked(sent.value, np.ascontiguousarray(node))
                text = pa.array([x if y else None for x, y in zip(clean, told.tolist(), strict=True)], pa.binary()).cast(pa.string())
                took = pa.array(row, pa.int32())
                yield pa.record_batch(
                    [b.column(0).take(took), b.column(1).take(took), pa.array(line, pa.int32()), pa.array(digest, pa.binary()), pa.array(node, mask=~told), text],
                    names=["row", "id", "line", "digest", "node", "norm"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("row", "id", "text").mapInArrow(run, f"row long, id {kind}, line int, digest binary, node long, norm string")


def _gathered(batches, columns: tuple[str, ...], most: int):
    """Tables of batches whose texts in ``columns`` take some ``most`` bytes together."""
    some, size = [], 0
    for b in batches:
        some.append(b)
        size += sum(pc.sum(pc.binary_length(b[c])).as_py() or 0 for c in columns)
        if size >= most:
            yield pa.Table.from_batches(some)
            some, size = [], 0
    if some:
        yield pa.Table.from_batches(some)


def line_groups(docs: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """One row per line that has a word: ``row, id, line, group, kept`` of ``docs(row, id, text)``.

    Lines that are equal once normalised are one node, whatever their length. Nodes of
    FUZZY_CHARS characters and more that share a key and whose SimHashes are close (see
    _allowed) are linked if their edit similarity (one less the edit distance over the
    longer length) is at least ``similarity``. All such pairs are compared, but those that
    other links join already: keys of up to LARGE nodes by meetings, larger ones by
    link_large_keys.

    Nodes go by 64 bits of their digest while pairs are sought. Of different lines with the same
    64 bits one takes part in the search, the others meet as equal lines only.
    """
    found = scratch.write(meetings(docs, similarity), "met", free=True)
    pairs = scratch.write(found.filter("b is not null").select("a", "b").distinct(), "pairs", free=True)
    entry = scratch.write(found.filter("b is null").select("key", F.col("a").alias("node")).distinct(), "entries", free=True)
    scratch.drop("met")

    # only lines that meet need their texts again
    marks = node_marks(entry.select("node").union(pairs.select(F.explode(F.array("a", "b")))))
    occurrences = scratch.write(document_lines(docs, marks), "lines", free=True)
    told = occurrences.filter(F.col("norm").isNotNull()).select("node", "digest", "norm").dropDuplicates(["node"])
    known = scratch.write(told, "contents", free=True)

    def verify(pairs: DataFrame) -> DataFrame:
        def confirm(batches):
            for t in _gathered(batches, ("x", "y"), GATHERED):
                x, y = t["x"].to_pylist(), t["y"].to_pylist()
                nodes, at, place = np.unique(np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()]), return_index=True, return_inverse=True)
                i, j = place.reshape(2, -1)
                may = np.flatnonzero(_possible(_counts([x[k] if k < len(x) else y[k - len(x)] for k in at.tolist()]), i, j, similarity))
                with collector_paused():
                    found = similar_pairs([(x[k], y[k]) for k in may.tolist()], similarity)
                yield from t.select(["a", "b"]).take(pa.array(may[found])).combine_chunks().to_batches()

        both = pairs.join(known.select(F.col("node").alias("a"), F.col("norm").alias("x")), "a")
        both = both.join(known.select(F.col("node").alias("b"), F.col("norm").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long").distinct()

    # the large keys, and one pair for each node, link most; then those that are still apart
    links = scratch.write(link_large_keys(entry, known, similarity).distinct(), "links-0", free=True)
    one = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = links.union(scratch.write(verify(one), "links-1", free=True))
    comp = scratch.write(components(links, scratch, "c-1"), "comp-1")
    left = pairs.join(one, ["a", "b"], "left_anti")
    left = left.join(comp.toDF("a", "x"), "a", "left").join(comp.toDF("b", "y"), "b", "left")
    left = left.filter(~F.coalesce(F.col("x") == F.col("y"), F.lit(False))).select("a", "b")
    more = scratch.write(verify(left), "links-2", free=True)
    if not more.isEmpty():
        comp = scratch.write(components(links.union(more), scratch, "c-2"), "comp-2")
    of_node = comp.join(known.select("node", "digest"), "node")
    label = of_node.groupBy("comp").agg(F.min("digest").alias("group"))
    named = of_node.join(label, "comp").select("digest", "group")
    grouped = occurrences.select("row", "id", "line", "digest").join(named, "digest", "left").withColumn("group", F.coalesce("group", "digest"))
    grouped = scratch.write(grouped.select("row", "id", "line", "group"), "grouped", free=True)
    scratch.drop("lines", "pairs", "entries", "contents", "links-0", "links-1", "links-2")
    first = grouped.groupBy("group").agg(F.min(F.struct("id", "row", "line")).alias("first"))
    kept = (F.col("row") == F.col("first.row")) & (F.col("line") == F.col("first.line"))
    return grouped.join(first, "group").select("row", "id", "line", "group", kept.alias("kept"))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def deduplicated_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line that has a word: the id, ``line_no`` (from 0), ``group_id`` (hex), ``kept``.

    See line_groups. Null, empty and blank texts have no lines. Every row is a document of its
    own, also if it repeats an id or has none; a null id sorts before all others. An
    empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    out = line_groups(_numbered(docs, id_col, text_col), scratch, similarity)
    return out.select(F.col("id").alias(id_col), F.col("line").alias("line_no"), F.lower(F.hex("group")).alias("group_id"), "kept")


def drop_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with only the kept lines and those without a word; columns and their
    order stay.

    A document of which no text is left goes; one that had none before stays as it is.
    Lines go by row, so that other rows of an id keep theirs.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    whole = scratch.write(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "docs")
    text = F.col("doc").getField(text_col)
    groups = line_groups(whole.select("row", F.col("doc").getField(id_col).alias("id"), text.alias("text")), scratch, similarity)
    gone = groups.filter(~F.col("kept")).groupBy("row").agg(F.collect_list("line").alias("gone"))

    def left(batches):
        for b in batches:
            out = []
            for t, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                drop = set(gone)
                out.append("\n".join([x for k, x in enumerate(t.split("\n")) if k not in drop]))
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], names=["doc", "text"])

    changed = whole.join(gone, "row")
    kind = StructType([whole.schema["doc"], StructField("text", StringType())])
    changed = changed.select("doc", text.alias("text"), "gone").mapInArrow(left, kind).filter(F.trim("text") != "")
    changed = changed.select(F.col("doc").withField(f"`{text_col}`", F.col("text")).alias("doc"))
    out = whole.join(gone, "row", "left_anti").select("doc").union(changed)
    return out.select([F.col("doc").getField(c).alias(c) for c in docs.columns]).to(StructType(docs.schema.fields))
