"""Whitening of embeddings by an incremental eigendecomposition.

Every partition of the distinct vectors keeps the spectrum of its own scatter matrix and adds one
vector after the other as a centred rank-one update: the new eigenvalues are the roots of the
secular equation, components that an update cannot move are deflated. Spectra of partitions are
combined in a tree, one rank-one update for each eigenpair of the one and one for the distance of
the means. The leading directions are then refined by Rayleigh-Ritz steps over all vectors:
products with the covariance are summed in the partitions, and what the residuals leave is
corrected by the combined spectrum.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_pandas, whole_groups

SCALE = 256
COMPONENTS = 4
GUARD = 8  # directions beyond those wanted in a Rayleigh-Ritz step
FAN = 8  # spectra combined by one task
ROUNDS = 6  # of refinement at most
ROOT_STEPS = 80
STRAIGHTEN = 512  # updates after which the directions are made orthogonal again
EPS = np.finfo(float).eps


def secular_roots(poles: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """pole_i - root_j of 1 + sum squares_i / (pole_i - x), (poles x roots).

    Poles ascend strictly, squares are positive. All roots are sought together, each as its
    distance from the nearer pole: rational steps through both neighbouring poles, kept inside
    a bracket that bisection shrinks.
    """
    k = len(poles)
    if k == 1:
        return -squares[:, None]
    last = poles[-1] + 2 * squares.sum()  # beyond the last root
    upper = np.append(poles[1:], last)
    columns = np.arange(k)
    middle = (poles + upper) / 2
    above = 1 + (squares[:, None] / (poles[:, None] - middle)).sum(0) <= 0  # the root lies above
    near = np.where(above & (columns < k - 1), columns + 1, columns)
    gap = poles[:, None] - poles[near]
    half = (upper - poles) / 2
    low = np.where(above, np.where(near == columns, half, -half), 0.0)
    high = np.where(above, np.where(near == columns, upper - poles, 0.0), half)
    at = (low + high) / 2
    own, other = gap[columns, columns], gap[np.minimum(columns + 1, k - 1), columns]
    out = np.empty((k, k))
    below = (np.arange(k)[:, None] <= columns) * squares[:, None]  # weights of the poles below a root
    beyond = squares[:, None] - below
    # First guess: both neighbouring poles exactly, the others as they are half-way.
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        s0, s1 = squares, np.append(squares[1:], 0.0)
        c = 1 + (squares[:, None] / (poles[:, None] - middle)).sum(0) - s0 / (poles - middle) - s1 / (upper - middle)
        a = c * (own + other) + s0 + s1
        b = c * own * other + s0 * other + s1 * own
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        guess = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        at = np.where((guess > low) & (guess < high), guess, at)
        for _ in range(ROOT_STEPS):
            distance = gap - at
            inverse = 1 / distance
            down, up = np.einsum("ij,ij->j", below, inverse), np.einsum("ij,ij->j", beyond, inverse)
            value = 1 + down + up
            done = np.abs(value) <= 4 * EPS * k * (1 - down + up)
            if 2 * np.count_nonzero(done) >= len(done):
                out[:, columns[done]] = distance[:, done]
                open_ = np.flatnonzero(~done)
                if not len(open_):
                    return out
                columns, at, low, high, own, other, value = (
                    x[open_] for x in (columns, at, low, high, own, other, value))
                gap, below, beyond, inverse = gap[:, open_], below[:, open_], beyond[:, open_], inverse[:, open_]
            low = np.where(value < 0, at, low)
            high = np.where(value > 0, at, high)
            inverse *= inverse
            psi, phi = np.einsum("ij,ij->j", below, inverse), np.einsum("ij,ij->j", beyond, inverse)
            d0, d1 = own - at, other - at
            c = value - d0 * psi - d1 * phi
            a = (d0 + d1) * value - d0 * d1 * (psi + phi)
            b = d0 * d1 * value
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            if columns[-1] == k - 1:
                step[-1] = d0[-1] + d0[-1] ** 2 * psi[-1] / (value[-1] - d0[-1] * psi[-1])
            there = at + step
            inside = (there >= low) & (there <= high) & (there != 0)
            new = np.where(inside, there, (low + high) / 2)
            if (new == at).all():
                break
            at = new
    out[:, columns] = gap - at
    return out


def rank_one(values: np.ndarray, vectors: np.ndarray, weight: float, u: np.ndarray):
    """Eigenpairs of vectors diag(values) vectors' + weight u u', ascending, for weight >= 0."""
    z = vectors.T @ u * np.sqrt(weight)
    size = z @ z
    small = 8 * EPS * max(abs(values[-1]), abs(values[0]), size)
    if size <= small * EPS:
        return values, vectors
    # Directions of one eigenvalue are turned so that a single one of them meets the update.
    starts = np.flatnonzero(np.append(True, np.diff(values) > small))
    if len(starts) < len(values):
        for s, e in zip(starts, np.append(starts[1:], len(values))):
            length = np.linalg.norm(z[s:e])
            if e - s > 1 and length:
                mirror = z[s:e].copy()
                mirror[-1] += length if mirror[-1] >= 0 else -length
                mirror /= np.linalg.norm(mirror)
                if vectors.base is not None or not vectors.flags.owndata:
                    vectors = vectors.copy()
                vectors[:, s:e] -= 2 * np.outer(vectors[:, s:e] @ mirror, mirror)
                z[e - 1] = -length if z[e - 1] >= 0 else length
                z[s:e - 1] = 0
    moved = np.abs(z) * np.sqrt(size) > small
    if not moved.any():
        return values, vectors
    poles, part = values[moved], z[moved]
    distance = secular_roots(poles, part * part)
    # The update whose roots these are exactly gives orthogonal directions.
    apart = np.abs(poles[:, None] - poles)
    np.fill_diagonal(apart, 1.0)
    exact = np.exp((np.log(np.abs(distance)).sum(1) - np.log(apart).sum(1)) / 2)
    turn = (np.sign(part) * exact)[:, None] / distance
    turn /= np.linalg.norm(turn, axis=0)
    nearest = np.abs(distance).argmin(0)
    new_values = values.copy()
    new_values[moved] = poles[nearest] - distance[nearest, np.arange(len(poles))]
    new_vectors = vectors.copy()
    new_vectors[:, moved] = vectors[:, moved] @ turn
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


class Spectrum:
    """Number, exact sums and the eigenpairs of the scatter matrix of some vectors."""

    def __init__(self, dims: int):
        self.n = 0
        self.sums = np.zeros(dims, dtype=np.int64)
        self.values, self.vectors = np.zeros(dims), np.eye(dims)
        self.updates = 0

    def _update(self, weight: float, u: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, weight, u)
        self.updates += 1
        if self.updates % STRAIGHTEN == 0:
            self.vectors = np.linalg.qr(self.vectors)[0] * 1.0

    def add(self, x: np.ndarray) -> None:
        """One more vector: a rank-one update by its distance from the mean so far."""
        if self.n:
            self._update(self.n / (self.n + 1), x - self.sums / self.n)
        self.n += 1
        self.sums += x

    def combine(self, other: "Spectrum") -> None:
        if not self.n:
            self.__dict__.update(other.__dict__)
            return
        if other.n:
            self._update(self.n * other.n / (self.n + other.n), other.sums / other.n - self.sums / self.n)
            for value, vector in zip(other.values, other.vectors.T):
                if value > 0:
                    self._update(value, vector)
            self.n += other.n
            self.sums = self.sums + other.sums

    def row(self) -> pd.DataFrame:
        return pd.DataFrame({"n": [self.n], "sums": [self.sums.tolist()], "size": [self.values.tolist()],
                             "vectors": [np.ascontiguousarray(self.vectors).tobytes()]})

    @staticmethod
    def of(row) -> "Spectrum":
        out = Spectrum(0)
        out.n, out.sums, out.values = int(row.n), np.array(row.sums, dtype=np.int64), np.array(row.size)
        out.vectors = np.frombuffer(row.vectors).reshape(len(out.sums), -1).copy()
        return out


def matrix(rows, dims: int) -> np.ndarray:
    """Integer vectors as a matrix; shorter ones end in zeros."""
    out = np.zeros((len(rows), dims), dtype=np.int64)
    for own, row in zip(out, rows):
        own[:len(row)] = row
    return out


def spectrum(vectors: DataFrame, dims: int) -> Spectrum:
    """The spectrum of all rows of ``vectors`` (x): one a task, then combined in a tree."""
    def grow(batches):
        own = Spectrum(dims)
        for batch in batches:
            for x in matrix(batch["x"].tolist(), dims):
                own.add(x)
        if own.n:
            yield own.row()

    def merge(batches):
        for frame in whole_groups(batches, ["slot"]):
            for slot, part in frame.groupby("slot"):
                total = Spectrum(dims)
                for row in part.itertuples(index=False):
                    total.combine(Spectrum.of(row))
                yield total.row().assign(slot=slot // FAN)

    schema = "n long, sums array<long>, size array<double>, vectors binary"
    parts = materialize(map_pandas(vectors.select("x"), grow, schema).withColumn(
        "slot", F.spark_partition_id().cast("long")), "spectra")
    left = parts.agg(F.max("slot")).first()[0] + 1
    # A slot is a number of tasks; every round leaves one for each FAN of them.
    parts = parts.withColumn("slot", F.floor(F.col("slot") / FAN))
    while True:
        left = -(-left // FAN)
        parts = materialize(map_pandas(
            parts.repartition("slot").sortWithinPartitions("slot", "n"), merge, schema + ", slot long"), "spectra")
        if left == 1:
            return Spectrum.of(parts.first())


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


def products(vectors: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The covariance times ``basis``, row by row, and then the trace; sums over all rows."""
    dims, width = basis.shape

    def run(batches):
        total, trace = np.zeros((dims, width)), 0.0
        for batch in batches:
            y = centred(matrix(batch["x"].tolist(), dims), n, sums)
            total += y.T @ (y @ basis)
            trace += (y * y).sum()
        yield pd.DataFrame({"at": np.arange(total.size + 1), "part": np.append(total.ravel(), trace)})

    found = map_pandas(vectors.select("x"), run, "at int, part double").groupBy("at").agg(F.sum("part").alias("part"))
    out = np.zeros(dims * width + 1)
    for row in found.collect():  # one row for each entry of a (dims x width) matrix
        out[row["at"]] = row["part"]
    return out / n


def refine(vectors: DataFrame, whole: Spectrum, wanted: int):
    """(eigenvalues, directions, trace, off): the leading pairs of the covariance of all rows.

    Every round is one pass. The residual of a direction, split by the combined spectrum and
    divided by the distances of its eigenvalues, is what the direction lacks; Rayleigh-Ritz on the
    directions with these corrections follows until the residuals are rounding. ``off`` is the
    largest residual before the first round, as a share of the largest eigenvalue.
    """
    dims = len(whole.values)
    full = np.linalg.qr(whole.vectors[:, ::-1])[0]
    known = whole.values[::-1] / whole.n
    basis = full[:, :min(dims, wanted + GUARD)]
    best = None
    first = None
    for _ in range(ROUNDS):
        found = products(vectors, whole.n, whole.sums, basis)
        image, trace = found[:-1].reshape(basis.shape), found[-1]
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        keep = min(dims, wanted + GUARD)
        basis, image, theta = basis[:, :keep], image[:, :keep], theta[:keep]
        rest = image - basis * theta
        largest = max(theta[0], np.finfo(float).tiny)
        off = np.abs(rest[:, :wanted]).max() / largest
        first = off if first is None else first
        fell = best is None or off < best[0] / 2
        if best is None or off < best[0]:
            best = (off, theta[:wanted], basis[:, :wanted], trace, first)
        if not fell or off <= EPS:
            break  # rounding is all that is left
        share = full.T @ rest
        distance = known[:, None] - theta
        far = np.abs(distance) > 1e-9 * largest
        share = np.where(far, share / np.where(far, distance, 1), 0)
        basis = np.linalg.qr(basis - full @ share)[0]
    return best[1:]


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows whose vector is no null and holds only finite numbers; x = floor(256 c)."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("x"))
    return rows.filter(F.col("x").isNotNull()).filter(~bad).withColumn(
        "x", F.transform("x", lambda c: F.floor(c * SCALE).cast("long")))


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row that remains.

    Rows with a null vector, or one that holds a null, NaN or infinite component, are dropped. The
    fit is over each distinct integer vector floor(256 c) once: ``n`` of them. ``deviation`` is
    the exact sum of squares of n x - sums, null where it exceeds 64 bits. ``whitened`` is the
    centred vector along component 1, 2, … of falling eigenvalue, in units of its deviation.
    Directions without variance, as with a single distinct vector, have no whitened value and
    explain 0. Repeated rows and ids, null ids included, each keep their rows; shorter vectors
    end in zeros; empty tables and vectors without components give no rows. Other columns are
    ignored.
    """
    spark = table.sparkSession
    schema = (f"`{id_col}` long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    rows = materialize(usable(table, id_col, vector_col), "vectors")
    distinct = materialize(rows.select("x").distinct(), "distinct")
    dims = distinct.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return spark.createDataFrame([], schema)
    whole = spectrum(distinct, dims)
    wanted = min(components, dims)
    theta, directions, trace, _ = refine(distinct, whole, wanted)
    n, sums = whole.n, whole.sums
    live = theta > 64 * dims * EPS * max(trace, 0.0)
    scale = np.where(live, 1 / np.sqrt(np.where(live, theta, 1)), np.nan)
    explained = np.where(live, theta / (trace if trace > 0 else 1), 0.0)
    project = directions * scale

    def spread(batches):
        total = np.zeros((wanted, wanted + 1))
        for batch in batches:
            w = centred(matrix(batch["x"].tolist(), dims), n, sums) @ np.where(live, project, 0)
            total[:, :wanted] += w.T @ w
            total[:, wanted] += w.sum(0)
        yield pd.DataFrame({"at": np.arange(total.size), "part": total.ravel()})

    sums_of = np.zeros(wanted * (wanted + 1))
    for row in (map_pandas(distinct, spread, "at int, part double").groupBy("at")
                .agg(F.sum("part").alias("part")).collect()):
        sums_of[row["at"]] = row["part"]
    moments = sums_of.reshape(wanted, wanted + 1) / n
    error = np.abs(moments[:, :wanted] - np.outer(moments[:, wanted], moments[:, wanted]) - np.eye(wanted))
    error = float(error[np.ix_(live, live)].max()) if live.any() else 0.0

    def out(batches):
        for batch in batches:
            x = matrix(batch["x"].tolist(), dims)
            far = n * x - sums
            if float(np.abs(far).max(initial=0)) ** 2 * dims < 2.0 ** 62:
                deviation = (far * far).sum(1).tolist()
            else:
                exact = [sum(int(v) ** 2 for v in row) for row in far]
                deviation = [v if v < 1 << 63 else None for v in exact]
            w = (far / n) @ project
            repeat = np.repeat(np.arange(len(x)), wanted)
            yield pd.DataFrame({
                "id": batch["id"].iloc[repeat].astype("Int64"), "component": np.tile(np.arange(1, wanted + 1), len(x)),
                "n": n, "deviation": pd.array([deviation[i] for i in repeat], dtype="Int64"),
                "whitened": [None if np.isnan(v) else v for v in w.ravel().tolist()],
                "explained": np.tile(explained, len(x)), "identity_error": error})

    return map_pandas(rows, out, schema.replace(f"`{id_col}`", "id")).withColumnRenamed("id", id_col)
