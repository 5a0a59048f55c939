"""Embedding whitening by shifted CholeskyQR.

Rows are centred exactly (n * x - S in integers), so the large common offset of x never meets a product.
Distributed passes sum the Gram matrix of the rows of Q = A R^-1, each task solving the triangular system for its
own rows; the Cholesky factor of the sum is composed into R.  The first Gram is shifted by a
multiple of the rounding error, so that it factors however ill-conditioned the rows are, and later ones
where they still have to; passes go on until Q is orthonormal.  The driver holds a d x d matrix: its singular
value decomposition gives the components and eigenvalues to the accuracy of a QR of the rows, not of their squares.

Defined results: rows whose vector is null or holds null or non-finite entries, or entries whose x is beyond
a long, are dropped; vectors of different lengths are whitened apart, each length with its own n, sums and components;
repeated rows count as often as they occur; a null id is kept; an empty table or empty vectors give no rows.  A
component without variance (fewer rows than dimensions, constant or dependent dimensions) has explained 0 and null
whitened values and is left out of the identity error.  deviation is null where it is beyond a long.  Extra
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import Batches, lists_of

COMPONENTS = 32
OFFSET, STEPS = 1_000_000, 64
LONG = 2**63 - 1
EPS = float(np.finfo(float).eps)
PASSES = 8
#: Largest entry of Q'Q - I at which Q counts as orthonormal.
CLOSE = 1e-12


@dataclass(frozen=True)
class Fit:
    """What whitening needs to know of all vectors of one length; the components are columns."""

    rows: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    passes: int

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S in integers, of Python where 64 bits may not hold them."""
        return deviations(x, self.rows, self.sums)

    @property
    def scales(self) -> np.ndarray:
        """Per component the factor that makes its variance one; 0 without variance."""
        alive = self.eigenvalues > 0
        return np.where(alive, 1 / np.sqrt(np.where(alive, self.eigenvalues, 1)), 0)


def deviations(x: np.ndarray, rows: int, sums: tuple[int, ...]) -> np.ndarray:
    largest = int(np.abs(x).max(initial=0)) * rows + max(map(abs, sums), default=0)
    if largest <= LONG:
        return x * np.int64(rows) - np.array(sums, np.int64)
    return x.astype(object) * rows - np.array(sums, object)


def grid(vectors: DataFrame, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The kept columns and the long array x of every usable vector."""
    entries = F.transform("embedding", lambda c: F.floor(c.cast("double") * STEPS))
    fine = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float(2**56)))
    return vectors.filter(F.col("embedding").isNotNull() & fine & (F.size("embedding") > 0)).select(
        *keep, F.transform(entries, lambda v: v.cast("long") + OFFSET).alias("x")
    )


def _matrices(batches: Batches, name: str = "x"):
    """(batch, row numbers, matrix) per vector length of every batch."""
    for batch in batches:
        values, offsets = lists_of(pa.Table.from_batches([batch]), name)
        sizes = np.diff(offsets)
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            yield batch, at, values[offsets[at][:, None] + np.arange(d)]


def column_sums(x: DataFrame) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Per vector length the number of rows and the exact sum of every dimension."""

    def add(batches: Batches) -> Batches:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for _, at, m in _matrices(batches):
            d = m.shape[1]
            rows, total = held.get(d, (0, np.zeros(d, object)))
            safe = int(np.abs(m).max()) <= LONG // len(m)
            held[d] = rows + len(at), total + (m if safe else m.astype(object)).sum(axis=0)
        for d, (rows, total) in held.items():
            # Sums as text: a decimal(38) adds them exactly.
            cols = [np.full(d, d), np.arange(d), np.full(d, rows)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([str(v) for v in total])], names=["d", "pos", "n", "total"])

    parts = x.select("x").mapInArrow(add, "d long, pos long, n long, total string")
    done = parts.groupBy("d", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # one row per dimension
    out: dict[int, tuple[int, tuple[int, ...]]] = {}
    for d in {r.d for r in done}:
        mine = sorted((r for r in done if r.d == d), key=lambda r: r.pos)
        out[d] = mine[0].n, tuple(int(r.total) for r in mine)
    return out


def grams(
    x: DataFrame,
    stats: dict[int, tuple[int, tuple[int, ...]]],
    factors: dict[int, list[np.ndarray]],
    basis: dict[int, np.ndarray] | None = None,
) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length the column sums and the Gram matrix of the centred rows, solved through each of the ``factors``
    in turn and projected on the ``basis``, if given."""

    def add(batches: Batches) -> Batches:
        held: dict[int, np.ndarray] = {}
        for _, _, m in _matrices(batches):
            d = m.shape[1]
            if d in factors:
                q = deviations(m, *stats[d]).astype(float) / stats[d][0]
                for r in factors[d]:
                    q = solved(q, r)
                if basis:
                    q = q @ basis[d]
                q = np.column_stack([np.ones(len(q)), q])
                held[d] = held.get(d, 0) + q.T @ q
        for d, g in held.items():
            i, j = np.triu_indices(len(g))
            cols = [np.full(len(i), d), i, j, g[i, j]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["d", "i", "j", "v"])

    parts = x.select("x").mapInArrow(add, "d long, i long, j long, v double")
    out = {d: np.zeros(((basis[d].shape[1] if basis else d) + 1,) * 2) for d in factors}
    for r in parts.groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect():  # (d + 1)(d + 2) / 2 numbers a length
        out[r.d][r.i, r.j] = out[r.d][r.j, r.i] = r.v
    return {d: (g[0, 1:], g[1:, 1:]) for d, g in out.items()}


def solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows R^-1 by forward substitution; a zero on the diagonal, of a column without variance, gives a zero column."""
    q = np.zeros(rows.shape)
    for j in range(r.shape[1]):
        if r[j, j]:
            q[:, j] = (rows[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def cholesky(gram: np.ndarray, rows: int, shifted: bool) -> np.ndarray:
    """Upper R with R'R = gram, shifted by the bound on its rounding error in the first pass, or where it does not factor.
    Columns that are zero stay zero."""
    live = np.flatnonzero(np.diag(gram) > 0)
    r = np.zeros_like(gram)
    if len(live):
        part, d = gram[np.ix_(live, live)], len(live)
        shift = 11 * (rows * d + d * (d + 1)) * EPS / 2 * np.linalg.norm(part, 2)
        shift = min(shift, 1e-3 * np.linalg.norm(part, 2))
        if not shifted:
            try:
                r[np.ix_(live, live)] = np.linalg.cholesky(part).T
                return r
            except np.linalg.LinAlgError:
                pass
        r[np.ix_(live, live)] = np.linalg.cholesky(part + shift * np.eye(d)).T
    return r


def fit(x: DataFrame) -> dict[int, Fit]:
    """The components of every vector length, from all rows of ``x`` (see ``grid``)."""
    stats = column_sums(x)
    factors: dict[int, list[np.ndarray]] = {d: [] for d in stats}
    traces: dict[int, float] = {}
    unfinished = set(stats)
    while unfinished:
        sums = grams(x, stats, {d: factors[d] for d in unfinished})
        for d in sorted(unfinished):
            gram, first = sums[d][1], not factors[d]
            if first:
                traces[d] = float(np.trace(gram)) / stats[d][0]
            elif orthonormal(gram) or len(factors[d]) == PASSES:
                unfinished.discard(d)
                continue
            factors[d].append(cholesky(gram, stats[d][0], first))
    out = {}
    for d, (rows, total) in stats.items():
        composed = reduce(lambda r, step: step @ r, factors[d], np.eye(d))
        _, sigma, basis = np.linalg.svd(composed)
        sigma = np.where(sigma > sigma.max(initial=0) * 4 * d * EPS, sigma, 0)
        out[d] = Fit(rows, total, sigma**2 / rows, basis.T, traces[d], len(factors[d]))
    return out


def orthonormal(gram: np.ndarray) -> bool:
    """Q'Q is the identity, but for columns that are zero."""
    live = np.diag(gram) > 0
    return bool(np.abs(gram - np.diag(live.astype(float))).max(initial=0) <= CLOSE)


def identity_errors(x: DataFrame, fits: dict[int, Fit], count: int) -> dict[int, float]:
    """Per length the largest entry of the whitened rows' covariance minus the identity, over the rows themselves."""
    stats = {d: (f.rows, f.sums) for d, f in fits.items()}
    basis = {d: f.components[:, :count] * f.scales[:count] for d, f in fits.items()}
    out = {}
    for d, (sums, gram) in grams(x, stats, {d: [] for d in fits}, basis).items():
        mean = sums / fits[d].rows
        live = fits[d].eigenvalues[:count] > 0
        gap = (gram / fits[d].rows - np.outer(mean, mean) - np.eye(len(mean)))[np.ix_(live, live)]
        out[d] = float(np.abs(gap).max(initial=0))
    return out


def whiten(vectors: DataFrame, count: int = COMPONENTS, fitted: dict[int, Fit] | None = None) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    x = grid(vectors)
    fits = fitted or fit(x)
    errors = identity_errors(x, fits, count)

    def project(batches: Batches) -> Batches:
        for batch, at, m in _matrices(batches):
            f = fits.get(m.shape[1])
            if f is None:
                continue
            k = min(count, m.shape[1])
            away = f.deviations(m)
            wide = away.dtype == object or float(np.abs(away).max(initial=0)) ** 2 * m.shape[1] > LONG
            squares = ((away.astype(object) if wide else away) ** 2).sum(axis=1)
            deviation = [int(v) if v <= LONG else None for v in squares] if wide else squares
            whitened = (away.astype(float) / f.rows) @ (f.components[:, :k] * f.scales[:k])
            dead = np.tile(f.eigenvalues[:k] == 0, len(at))
            explained = f.eigenvalues[:k] / f.trace if f.trace > 0 else np.zeros(k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(at) * k, f.rows)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                    pa.array(whitened.ravel(), mask=dead),
                    pa.array(np.tile(explained, len(at))),
                    pa.array(np.full(len(at) * k, errors[m.shape[1]])),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    rows = x.select(F.col("vec_id").cast("long"), "x")
    return rows.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
