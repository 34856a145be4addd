"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Remainder of crc32(id as text) modulo FOLDS that is never learned from.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7

_LOWER = bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_STOP = b".,;:'\"()-"
_CALL = b"!?"
_SIGN = bytes(c for c in range(33, 127) if c not in _LOWER + _UPPER + _DIGIT + _STOP + _CALL)
_SPACE = b" \t\r\n\x0b\x0c"
CLASSES = (_UPPER, _DIGIT, _STOP, _CALL, _SIGN, _SPACE)

NAMES = (
    "chars", "words", "lines", "upper", "digit", "stop", "call", "sign", "space", "other",
    "word_length", "vocabulary", "top_word", "echo", "letters_only", "all_caps", "title",
    "repeated_lines", "line_words", "sentence_words",
)


def _odds(part: float, whole: float) -> float:
    """Log odds of a share, pulled in by half a percent so that 0 and 1 stay finite."""
    share = part / whole if whole else 0.0
    return log((share + 0.005) / (1.005 - share))


def statistics(text: str) -> list[float]:
    """Transformed statistics of one whole text; an empty text has them too."""
    data = text.encode()
    n = len(data)
    counts = [n - len(data.translate(None, c)) for c in CLASSES]
    other = len(data.translate(None, bytes(range(128))))
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    seen = Counter(words)
    m = len(words)
    top = max(seen.values(), default=0)
    echo = sum(map(eq, words, words[1:]))
    plain = caps = title = 0
    for w, k in seen.items():
        if w.isalpha():
            plain += k
        if w.isupper():
            caps += k
        elif w[0].isupper():
            title += k
    ends = text.count(".") + text.count("!") + text.count("?")
    return [
        log(1 + n), log(1 + m), log(1 + len(lines)),
        *(_odds(c, n) for c in counts), _odds(other, n),
        log(1 + n / (m or 1)), log(1 + len(seen)) / log(2 + m), _odds(top, m), _odds(echo, m),
        _odds(plain, m), _odds(caps, m), _odds(title, m),
        _odds(len(lines) - len(set(lines)), len(lines)), log(1 + m / (len(lines) or 1)), log(1 + m / (1 + ends)),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the array ``x`` of statistics of each whole text (null: empty)."""

    def run(batches):
        for b in batches:
            x = [statistics(t or "") for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, x array<double>")


def held_out(id_col: str) -> Column:
    """Whether an id is in the fold that no model learns from; false for a null id."""
    text = F.col(id_col).cast("string")
    return F.coalesce(F.crc32(text.cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse Cholesky factor of the covariance, log prior and log determinant."""

    center: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    whitening: tuple[np.ndarray, ...]
    offsets: tuple[float, ...]
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1: log densities differ by Mahalanobis distances and offsets."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.center) / self.scale
        density = [o - 0.5 * np.square((z - m) @ w.T).sum(axis=1) for m, w, o in zip(self.means, self.whitening, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """From each class's count, sum and sum of outer products.

    A class covariance is shrunk by ``pooled`` towards the pooled one and then by
    ``ridge`` towards a multiple of the identity. With one class only the score is
    constant: that class, or one half without any row.
    """
    d = len(NAMES)
    present = [k for k in (0, 1) if k in sums and sums[k][0] > 0]
    if len(present) < 2:
        nothing = np.zeros(d)
        return Discriminant(nothing, nothing + 1, (), (), (), float(present[0]) if present else 0.5)
    n = sum(sums[k][0] for k in present)
    center = sum(sums[k][1] for k in present) / n
    scale = np.sqrt(np.maximum(np.diag(sum(sums[k][2] for k in present)) / n - center**2, 1e-6))  # a constant statistic has rounding noise only
    means, scatter = [], []
    for k in present:
        nk, s, ss = sums[k]
        mean = s / nk
        means.append((mean - center) / scale)
        scatter.append((ss - nk * np.outer(mean, mean)) / np.outer(scale, scale))
    together = sum(scatter) / n
    whitening, offsets = [], []
    for k, sc in zip(present, scatter, strict=True):
        cov = (1 - pooled) * sc / sums[k][0] + pooled * together
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        whitening.append(np.linalg.inv(lower))
        offsets.append(log(sums[k][0] / n) - float(np.log(np.diag(lower)).sum()))
    return Discriminant(center, scale, tuple(means), tuple(whitening), tuple(offsets))


def class_sums(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Sums over all rows of ``x`` by ``label``: 2 (1 + d + d^2) numbers reach the driver."""
    d = len(NAMES)

    def run(batches):
        total = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
        for b in batches:
            label = b.column(0).to_numpy()
            x = np.array(b.column(1).to_pylist(), float).reshape(-1, d)
            for k in total:
                part = x[label == k]
                total[k] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        for k, v in total.items():
            yield pa.record_batch([pa.array([k] * len(v), pa.int32()), pa.array(range(len(v)), pa.int32()), pa.array(v)], names=["label", "i", "v"])

    rows = labelled.select("label", "x").mapInArrow(run, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for k in (0, 1):
        v = np.zeros(1 + d + d * d)
        for r in rows:
            if r.label == k:
                v[r.i] = r.v
        out[k] = (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return out


def learn(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> Discriminant:
    """The discriminant of written statistics ``id, x`` and labels, without the held-out fold."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
    return fit(class_sums(stats.join(known, "id")))


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Learn from labelled documents outside the held-out fold and score every document.

    Columns: the id, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier),
    ``predicted`` (1 from ``threshold`` on). The fit uses all such rows: statistics are
    computed once for each document, written, and summed by class on the executors.
    Only statistics of the text enter a score. Null and empty texts are scored like
    others; rows of ``labels`` with a null id or a label other than 0 and 1 are left
    out; repeated rows count and come out repeatedly; without labels of both classes
    the score is constant; an empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.write(document_statistics(docs, id_col, text_col), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(learn(stats, labels, id_col, label_col))

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(-1, len(NAMES))
            yield pa.record_batch([b.column(0), pa.array(model.value.score(x))], names=["id", "score"])

    kind = stats.schema["id"].dataType.simpleString()
    scored = stats.mapInArrow(run, f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col),
        held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The documents that score ``threshold`` or more, with their columns as they are.

    After the fit texts are scored where they are read, so that no text is exchanged.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    stats = scratch.write(document_statistics(docs, id_col, text_col), "statistics")
    model = spark.sparkContext.broadcast(learn(stats, labels, id_col, label_col))
    scratch.drop("statistics")

    @F.pandas_udf("boolean")
    def accepts(text: pd.Series) -> pd.Series:
        x = np.array([statistics(t or "") for t in text], float).reshape(-1, len(NAMES))
        return pd.Series(model.value.score(x) >= threshold)

    return docs.filter(accepts(F.col(text_col)))
