import random

import numpy as np
import pytest

from catchment.llm import whitening
from catchment.llm.whitening import Spectrum, rank_one, refine, whiten

SCHEMA = "vec_id long, embedding array<double>, id long, x string, n int, component int"


def got(frame, rows, **options):
    return whiten(frame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA), **options).collect()


def check(out, rows, components=4, skip=()):
    """Rows against a dense eigensolver and Python integers."""
    kept = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + [0] * (dims - len(x))) for i, x in kept]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], dtype=float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    wanted = min(components, dims)
    kept, out = [r for r in kept if r[0] not in skip], [r for r in out if r.vec_id not in skip]
    assert len(out) == len(kept) * wanted
    assert sorted((str(r.vec_id), r.component, r.deviation) for r in out) == sorted(
        (str(i), c + 1, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in kept for c in range(wanted))
    by_id = dict(kept)
    for c in range(wanted):
        mine = [r for r in out if r.component == c + 1 and r.vec_id is not None]
        assert {r.n for r in mine} <= {n}
        assert mine[0].explained == pytest.approx(values[c] / values.sum(), rel=1e-9, abs=1e-13)
        want = [(np.array(by_id[r.vec_id]) - np.array(sums) / n) @ vectors[:, c] / np.sqrt(values[c]) for r in mine]
        ours = np.array([r.whitened for r in mine], dtype=float)
        sign = np.sign(ours[np.abs(want).argmax()] * want[np.abs(want).argmax()])
        assert np.abs(ours * sign - want).max() < 1e-8 * max(1, np.abs(want).max())
    assert all(r.identity_error < 1e-9 for r in out)


def random_rows(n, dims, seed):
    rng = np.random.default_rng(seed)
    stretch = np.linspace(2.0, 0.1, dims)
    return [(i, [float(c) for c in rng.normal(size=dims) * stretch + 1]) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 2, 3, 9, 24])
def test_equals_a_dense_solver(frame, dims):
    rows = random_rows(300, dims, dims)
    check(got(frame, rows), rows)


def test_copies_count_once_and_odd_rows(frame):
    rows = random_rows(60, 6, 1)
    rows += [(100 + i, rows[3][1]) for i in range(200)]
    good = rows + [(7, rows[8][1]), (None, rows[9][1]), (900, [1.0, 2.0])]
    bad = [(901, None), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6), (904, [float("-inf")] * 6)]
    out = got(frame, good + bad)
    check(out, good, skip=(7,))
    assert sum(r.vec_id == 7 for r in out) == 8
    assert not {r.vec_id for r in out} & {901, 902, 903, 904}


def test_without_variance(frame):
    assert got(frame, []) == got(frame, [(1, []), (2, None)]) == []
    out = got(frame, [(i, [1.0, 2.0, 3.0]) for i in range(3)])
    assert len(out) == 9 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 for r in out)
    # Two distinct vectors have one direction.
    out = got(frame, [(1, [1.0, 2.0, 3.0]), (2, [3.0, 2.0, 1.0])])
    assert sorted((r.component, r.explained) for r in out if r.whitened is not None) == [(1, pytest.approx(1.0))] * 2
    big = got(frame, [(1, [2.0**40]), (2, [0.0]), (3, [1.0])])
    assert {r.deviation is None for r in big} == {True, False} or all(r.deviation is None for r in big)


@pytest.mark.parametrize("kind", ["plain", "line", "bits", "few"])
def test_updates_keep_the_scatter_matrix(kind):
    rng = np.random.default_rng(3)
    x = {"plain": rng.integers(-500, 500, (200, 16)), "bits": rng.integers(0, 2, (200, 16)),
         "line": rng.integers(-500, 500, (200, 1)) * np.arange(1, 17),
         "few": np.tile(rng.integers(-9, 9, (3, 16)), (60, 1)) * 1000}[kind]
    whole, parts = Spectrum(16), [Spectrum(16) for _ in range(4)]
    for i, row in enumerate(x):
        whole.add(row)
        parts[min(i // 9, 3)].add(row)  # of sizes 9, 9, 9 and the rest
    total = Spectrum(16)
    for part in parts:
        total.combine(part)
    y = x - x.mean(0)
    for s in (whole, total):
        assert (np.diff(s.values) >= 0).all() and np.abs(s.vectors.T @ s.vectors - np.eye(16)).max() < 1e-12
        assert np.abs(s.vectors @ np.diag(s.values) @ s.vectors.T - y.T @ y).max() < 1e-11 * np.abs(y.T @ y).max()


def test_nothing_to_update():
    values, vectors = np.array([1.0, 2.0]), np.eye(2)
    assert (rank_one(values, vectors, 1.0, np.zeros(2))[0] == values).all()


def test_the_spectrum_leaves_little_to_refine(spark, frame):
    """Directions of the updates are right before refinement, and refinement mends wrong ones."""
    rng = random.Random(5)
    x = [[rng.randint(-300, 300) * (k + 1) for k in range(20)] for _ in range(400)]
    df = frame([(v,) for v in x], "x array<long>")
    whole = whitening.spectrum(df, 20)
    theta, directions, _, off = refine(df, whole, 4)
    assert off < 1e-11
    turn = np.linalg.qr(np.eye(20) + 0.02 * np.random.default_rng(1).normal(size=(20, 20)))[0]
    whole.vectors = whole.vectors @ turn
    again, bent, _, off = refine(df, whole, 4)
    assert off > 1e-4 and again == pytest.approx(theta, rel=1e-6)
    assert np.abs(np.abs((bent * directions).sum(0)) - 1).max() < 1e-6
