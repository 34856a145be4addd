"""Optimal one-to-one assignment within each group (Kuhn-Munkres with potentials)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def solve(scores: np.ndarray, floor: float = 0.0) -> list[tuple[int, int]]:
    """Pairs of row and column with the largest total score; pairs under ``floor`` are
    taken out afterwards. In order of the shorter side, rows where both are equal."""
    if not scores.size:
        return []
    flipped = scores.shape[0] > scores.shape[1]
    cost = -(scores.T if flipped else scores)
    taken = _shortest_paths(cost)
    pairs = [(c, r) if flipped else (r, c) for r, c in enumerate(taken)]
    return [(r, c) for r, c in pairs if scores[r, c] >= floor]


def _shortest_paths(cost: np.ndarray) -> list[int]:
    """Column of each row at the least total cost, rows no more than columns.

    Rows join one at a time along a shortest augmenting path in reduced costs; the
    inner search over columns is one vector operation.
    """
    rows, cols = cost.shape
    row_price, col_price = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for start in range(rows):
        dist = np.full(cols, np.inf)
        came = np.full(cols, -1)
        done = np.zeros(cols, bool)
        row, base, last = start, 0.0, -1
        while True:
            reach = base + cost[row] - row_price[row] - col_price
            better = ~done & (reach < dist - 1e-15)
            dist[better], came[better] = reach[better], last
            open_cols = np.where(done, np.inf, dist)
            last = int(open_cols.argmin())
            base = float(open_cols[last])
            done[last] = True
            if owner[last] < 0:
                break
            row = int(owner[last])
        row_price[start] += base
        inner = done & (owner >= 0)
        row_price[owner[inner]] += base - dist[inner]
        col_price[done] -= base - dist[done]
        while last >= 0:
            previous = int(came[last])
            owner[last] = start if previous < 0 else owner[previous]
            last = previous
    out = [0] * rows
    for c, r in enumerate(owner):
        if r >= 0:
            out[r] = c
    return out


def assign(scores: DataFrame, by: list[str], floor: float = 0.0, row: str = "q_idx", col: str = "a_idx", score: str = "score") -> DataFrame:
    """``by, row, col, score, pair_order`` of each group's optimum; absent cells score 0.

    A group is one assessment's matrix (tens by hundreds). Rows are exchanged and sorted
    by group and solved group after group as they stream by, which costs far less than
    a Python call per group.
    """
    kinds = ", ".join(f"`{c}` {scores.schema[c].dataType.simpleString()}" for c in by)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = np.unique(pdf[row]), np.unique(pdf[col])
        m = np.zeros((len(r), len(c)))
        m[np.searchsorted(r, pdf[row]), np.searchsorted(c, pdf[col])] = pdf[score]
        pairs = solve(m, floor)
        out = {k: [pdf[k].iloc[0]] * len(pairs) for k in by}
        out |= {row: [r[i] for i, _ in pairs], col: [c[j] for _, j in pairs], score: [m[i, j] for i, j in pairs], "pair_order": range(len(pairs))}
        return pd.DataFrame(out)

    def run(frames):
        rest = None
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if pdf.empty:
                continue
            number = (pdf[by] != pdf[by].shift()).any(axis=1).cumsum()
            cut = int(np.searchsorted(number, number.iloc[-1]))
            rest = pdf.iloc[cut:]
            if cut:
                yield pd.concat([best(g) for _, g in pdf.iloc[:cut].groupby(number.iloc[:cut])])
        if rest is not None and len(rest):
            yield best(rest)

    out = f"{kinds}, `{row}` long, `{col}` long, `{score}` double, pair_order int"
    cells = scores.select(*by, F.col(row).cast("long").alias(row), F.col(col).cast("long").alias(col), F.col(score).cast("double").alias(score))
    return cells.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, out)
