import random

import numpy as np

from catchment.llm import hard_negatives
from catchment.llm.hard_negatives import mine

SCHEMA = "vec_id long, label int, embedding array<double>, id long, scores int, planes string, `column` int"


def brute(rows, every=100, k=5, low=80):
    """All scores as Python integers, from rows of (id, label, vector)."""
    best = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(
                c is not None and np.isfinite(c) for c in v):
            x = [int(np.floor(256 * c)) for c in v]
            best[i] = min(best.get(i, (label, x)), (label, x))
    out = []
    for a, (label, x) in best.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, own) for i, (own, y) in best.items() if i != a)
        for score, i, _ in [s for s in scored if s[2] == label][:k]:
            fits = [(s, j) for s, j, own in scored if own != label and low * -score <= 100 * -s <= 100 * -score]
            out += [(a, i, n + 1, j, -score, -s) for n, (s, j) in enumerate(fits[:k])]
    return sorted(out)


def rows_of(n, labels, dims, seed):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    out = [(i, rng.randrange(labels) if rng.random() < 0.6 else 0,
            [c + rng.gauss(0, 0.4) for c in centre[rng.randrange(4)]]) for i in range(n)]
    out += [(n + i, rng.randrange(labels), out[7][2]) for i in range(20)]  # ties
    return out


def got(frame, rows, **options):
    full = [(*r, 3, 4, "p", 5) for r in rows]
    return sorted(tuple(r) for r in mine(frame(full, SCHEMA), **options).collect())


def test_equals_brute_force(frame):
    rows = rows_of(700, 6, 13, 1)
    want = brute(rows, every=10)
    assert len(want) > 500 and got(frame, rows, every=10) == want


def test_many_blocks_columns_and_stripes(frame, monkeypatch):
    for name, value in (("BLOCK", 7), ("STRIPE", 3), ("COLUMN", 4), ("AT_ONCE", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = rows_of(300, 40, 8, 2)
    assert got(frame, rows, every=5) == brute(rows, every=5)


def test_odd_rows(frame):
    rows = [*rows_of(150, 3, 5, 3), (0, 1, [0.1] * 5), (0, 0, [0.2] * 5), (None, 1, [1.0] * 5), (900, None, [1.0] * 5),
            (1000, 1, None), (1001, 1, [1.0, None, 0.0, 0.0, 0.0]), (1002, 1, [float("nan")] * 5),
            (1003, 1, [float("inf")] * 5), (1004, 1, []), (1005, 1, [0.0] * 5), (1006, 2, [0.5] * 9),
            (1007, 2, [300.7] * 5), (-100, 2, [-1.0] * 5)]
    rows += rows[5:9]  # repeated rows
    assert got(frame, rows, every=50) == brute(rows, every=50)
    assert got(frame, []) == got(frame, [(1, 2, [1.0])]) == got(frame, [(0, 2, [])]) == []


def test_scores_are_exact():
    rng = np.random.default_rng(4)
    for dims, top in ((1, 3), (8, 1 << 20), (17, 255), (64, 1 << 12)):
        x, y = rng.integers(-top, top, (50, dims)), rng.integers(-top, top, (9, dims))
        planes = hard_negatives.packed(x)
        assert (hard_negatives.scores(hard_negatives.subset_sums(y, planes.shape[1]), planes) == x @ y.T).all()
