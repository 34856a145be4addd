from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.functions.similarity import lcs_length, token_set_ratio
from quillstone.operators.assignment import solve


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_total_is_the_optimum(rows, cols, seed):
    m = np.random.default_rng(seed).integers(0, 9, (rows, cols)) / 8
    pairs = solve(m)
    assert len(pairs) == min(rows, cols) == len({r for r, _ in pairs}) == len({c for _, c in pairs})
    t = m if rows <= cols else m.T
    best = max(sum(t[i, p[i]] for i in range(t.shape[0])) for p in permutations(range(t.shape[1]), t.shape[0]))
    assert abs(sum(m[r, c] for r, c in pairs) - best) < 1e-9


def test_optimal_not_greedy_and_floor():
    assert solve(np.array([[0.9, 0.8], [0.8, 0.1]])) == [(0, 1), (1, 0)]
    assert solve(np.array([[0.3, 0.2]]), 0.45) == []
    assert solve(np.empty((0, 0))) == []


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=40), st.text("abc ", max_size=40))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert lcs_length(a, b) == table[-1][-1]


def test_token_set_ratio():
    assert token_set_ratio("cell wall", "wall cell thick") == 100.0
