"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance V of the fitted vectors is never formed. A block Q of more directions than are wanted
is multiplied by it in passes over all rows: each task adds up ``Xc' (Xc Q)`` of its centred rows, and
one number per entry and task meets in a sum. Between passes a Chebyshev polynomial of V is built up by
its three-term recurrence: it stays small on the interval of the unwanted spectrum and grows fast
above it. After some steps the block is orthogonalised (QR), V is projected on it (Rayleigh-Ritz), and
the residual of every wanted pair is measured; the iteration ends when all residuals are down to
rounding. The interval runs from a lower bound of the spectrum, found by a Lanczos vector that rides
along in the first passes, to the least Ritz value of the block.

Entries become whole numbers first, so sums, centring and deviations are exact: a row enters the
products as ``n * x - S``, divided by n only then. What the driver holds is of the size of dimensions by
directions, whatever the number of rows.

Defined cases: rows with a null vector, with null or non-finite entries, or with entries of 2**46 or
more in size take no part; nor do vectors of another width than most have. Repeated rows and null ids
count as rows. Directions without variance give no component, so equal vectors, a single row or an
empty table give no rows. A deviation beyond the range of a long is null.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf.llm.vectors import blob, longs, matrix, runs, usable
from tidyshelf.session import cut

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Vectors of one stored blob.
BLOB_ROWS = 1024
#: Largest size of an entry: scaled and shifted ones stay exact as doubles.
LARGEST = 2.0 ** 46
#: Highest degree of one polynomial, and how far it may set the strongest direction above the weakest
#: wanted one, which the orthogonalisation must still tell apart.
DEGREE, SPREAD = 12, 1e9
#: Residuals (of the largest eigenvalue) that end the iteration, at once or when they no longer fall.
TIGHT, ENOUGH, CYCLES = 2e-15, 1e-12, 60
#: Share of the largest eigenvalue below which a direction has no variance.
RANK = 1e-12
_NULL_ID = np.iinfo(np.int64).min

COLUMNS = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
           "identity_error double")


@dataclass
class Fit:
    """What a fit knows: rows, exact sums per dimension, directions, eigenvalues, trace."""

    rows: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    passes: int


def stored(vectors: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """Blobs of up to ``BLOB_ROWS`` vectors of whole numbers, written once; and their width."""
    fine, width = usable(vectors.select(F.col("vec_id").cast("long"), F.col(vector).alias("v")), "v", LARGEST)

    def pack(batches):
        def build(run, _):
            whole = np.floor(SCALE * matrix(run.column("v").combine_chunks(), width)).astype(np.int64)
            ids = run.column("vec_id")
            small = not len(whole) or np.abs(whole).max() < 2 ** 31 - 1
            return {"ids": blob(longs(ids, _NULL_ID)), "small": bool(small),
                    "whole": blob(whole.astype(np.int32) if small else whole)}
        yield from runs(batches, BLOB_ROWS, None, build)

    return cut(fine.mapInArrow(pack, "ids binary, small boolean, whole binary")), width


def _whole(batch: pa.RecordBatch, width: int):
    """(ids, x) of each blob of a batch."""
    for ids, small, data in zip(*(batch.column(c).to_pylist() for c in ("ids", "small", "whole"))):
        kind = np.int32 if small else np.int64
        yield np.frombuffer(ids, np.int64), np.frombuffer(data, kind).reshape(-1, width).astype(np.int64) + SHIFT


def _sums(blobs: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum per dimension."""
    def add(batches):
        rows, total = 0, [0] * width
        for batch in batches:
            for _, x in _whole(batch, width):
                rows += len(x)
                total = [a + b for a, b in zip(total, x.sum(axis=0).tolist())]
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array(range(-1, width), pa.int32()),
            "s": pa.array([str(s) for s in [rows, *total]])})

    found = (blobs.select("ids", "small", "whole").mapInArrow(add, "dim int, s string")
             .groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    by = {row["dim"]: int(row["s"]) for row in found}
    return by.get(-1, 0), [by.get(i, 0) for i in range(width)]


def _differences(x: np.ndarray, rows: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: as longs, or as Python numbers where longs could not hold them."""
    near = [round(Fraction(s, rows)) for s in sums]
    rest = np.array([s - rows * c for s, c in zip(sums, near)], object)
    apart = x - np.array(near, np.int64)
    if rows * (int(np.abs(apart).max(initial=0)) + 1) < 2 ** 62:
        return rows * apart - rest.astype(np.int64)
    return rows * apart.astype(object) - rest


def _centred(x: np.ndarray, rows: int, sums: list[int]) -> np.ndarray:
    return _differences(x, rows, sums).astype(np.float64) / rows


def _added(blobs: DataFrame, width: int, columns: int, build, dims: int) -> np.ndarray:
    """Sum over all blobs of the (dims x columns) matrices that ``build`` makes of their rows."""
    def add(batches):
        total = np.zeros((dims, columns))
        for batch in batches:
            for _, x in _whole(batch, width):
                total += build(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.reshape(-1))], ["at", "s"])

    found = blobs.select("ids", "small", "whole").mapInArrow(add, "at int, s double").groupBy("at").agg(
        F.sum("s").alias("s")).toPandas()
    out = np.zeros(dims * columns)
    out[found["at"].to_numpy()] = found["s"].to_numpy()
    return out.reshape(dims, columns)


class _Covariance:
    """Products with the covariance, one pass each."""

    def __init__(self, blobs: DataFrame, width: int, rows: int, sums: list[int]):
        self.blobs, self.width, self.rows, self.sums, self.passes = blobs, width, rows, sums, 0

    def __matmul__(self, block: np.ndarray) -> np.ndarray:
        rows, sums = self.rows, self.sums

        def product(x):
            c = _centred(x, rows, sums)
            return c.T @ (c @ block)

        self.passes += 1
        return _added(self.blobs, self.width, block.shape[1], product, self.width) / rows


def _ritz(block: np.ndarray, image: np.ndarray):
    """Block and image turned to Ritz vectors, falling Ritz values, residual norms."""
    inner = block.T @ image
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    block, image = block @ turn, image @ turn
    return block, image, values, np.linalg.norm(image - block * values, axis=0)


class _Lanczos:
    """Lower bound of the spectrum: one vector that takes part in passes made anyway."""

    def __init__(self, width: int, random: np.random.Generator):
        start = random.standard_normal(width)
        self.basis, self.images = [start / np.linalg.norm(start)], []

    def step(self, image: np.ndarray) -> None:
        self.images.append(image)
        basis = np.array(self.basis).T
        rest = image - basis @ (basis.T @ image)
        rest -= basis @ (basis.T @ rest)
        self.left = np.linalg.norm(rest)
        self.basis.append(rest / self.left if self.left > 0 else rest)

    def bound(self) -> float:
        basis, image = np.array(self.basis[:len(self.images)]).T, np.array(self.images).T
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        return max(0.0, float(values[0] - self.left * abs(turn[-1, 0])))


def subspace(v: _Covariance, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(directions, eigenvalues, worst residual) of the ``wanted`` largest eigenvalues."""
    width, random = v.width, np.random.default_rng(7)
    size = min(width, wanted + max(8, wanted // 2))
    block = np.linalg.qr(random.standard_normal((width, size)))[0]
    lanczos, floor = _Lanczos(width, random), 0.0
    block, image, values, residual = _ritz(block, v @ block)
    best, worst = np.inf, 0.0
    for cycle in range(CYCLES):
        top = max(values[0], 0.0)
        known = int(min(wanted, (values > RANK * top).sum()))
        worst = float(residual[:known].max(initial=0.0)) / top if top > 0 else 0.0
        if worst <= TIGHT or size == width or (worst <= ENOUGH and worst > best / 2):
            return block[:, :known], values[:known], worst
        best = min(best, worst)
        low, high = floor, max(float(values[-1]), floor + RANK * top)
        half, mid = (high - low) / 2, (high + low) / 2
        grow = lambda value: np.arccosh(max((value - mid) / half, 1 + 1e-12))
        spread = grow(top) - grow(values[known - 1])
        need = np.arccosh(max(worst / TIGHT, 2.0)) / grow(values[known - 1])
        degree = int(np.clip(min(need + 1, np.log(SPREAD / min(worst, 1)) / max(spread, 1e-9)), 2, DEGREE))
        # Scaled recurrence: the strongest direction keeps its size, the others shrink.
        first = scale = half / (top - mid)
        before, now = block, (image - mid * block) * (scale / half)
        for _ in range(degree - 1):
            if cycle == 0:
                both = v @ np.column_stack([now, lanczos.basis[-1]])
                product = both[:, :-1]
                lanczos.step(both[:, -1])
            else:
                product = v @ now
            after = 1 / (2 / first - scale)
            before, now = now, (product - mid * now) * (2 * after / half) - before * (scale * after)
            scale = after
        if cycle == 0 and lanczos.images:
            floor = min(lanczos.bound(), 0.999 * float(values[-1]))
        block = np.linalg.qr(now / np.linalg.norm(now, axis=0))[0]
        block, image, values, residual = _ritz(block, v @ block)
    raise ArithmeticError(f"no convergence: residual {worst:g}")


def fit(blobs: DataFrame, width: int, components: int = COMPONENTS) -> Fit:
    rows, sums = _sums(blobs, width)
    if not rows or not width:
        return Fit(rows, sums, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0, 0)
    squares = blobs.select("ids", "small", "whole").mapInArrow(
        _square_sums(width, rows, sums), "s string").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).first()
    trace = float(Fraction(int(squares["s"] or 0), rows ** 3))
    if trace <= 0:
        return Fit(rows, sums, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0, 0)
    v = _Covariance(blobs, width, rows, sums)
    directions, values, residual = subspace(v, min(components, width))
    strongest = np.abs(directions).argmax(axis=0)
    directions = directions * np.sign(directions[strongest, np.arange(directions.shape[1])])
    return Fit(rows, sums, directions, values, trace, residual, v.passes)


def _deviations(x: np.ndarray, rows: int, sums: list[int]) -> list[int]:
    apart = _differences(x, rows, sums)
    if apart.dtype != object and x.shape[1] * (int(np.abs(apart).max(initial=0)) ** 2) >= 2 ** 62:
        apart = apart.astype(object)
    return (apart * apart).sum(axis=1).tolist()


def _square_sums(width: int, rows: int, sums: list[int]):
    def add(batches):
        total = 0
        for batch in batches:
            for _, x in _whole(batch, width):
                total += sum(_deviations(x, rows, sums))
        yield pa.RecordBatch.from_pydict({"s": [str(total)]})
    return add


def identity_error(blobs: DataFrame, width: int, model: Fit) -> float:
    """Largest entry of the whitened rows' covariance less the identity, measured over all rows."""
    count = len(model.values)
    if not count:
        return 0.0
    turn, rows, sums = model.directions / np.sqrt(model.values), model.rows, model.sums

    def moments(x):
        white = _centred(x, rows, sums) @ turn
        return np.vstack([white.T @ white, white.sum(axis=0)])

    total = _added(blobs, width, count, moments, count + 1) / rows
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(count)).max())


def transform(blobs: DataFrame, width: int, model: Fit) -> DataFrame:
    """A row for each vector and component."""
    count, rows, sums = len(model.values), model.rows, model.sums
    turn = model.directions / np.sqrt(model.values)
    explained = model.values / (model.trace or 1.0)
    error = identity_error(blobs, width, model)
    most = 2 ** 63 - 1

    def rows_of(batches):
        for batch in batches:
            for ids, x in _whole(batch, width):
                if not count:
                    continue
                white = _centred(x, rows, sums) @ turn
                deviation = pa.array([d if d <= most else None for d in _deviations(x, rows, sums)], pa.int64())
                each = np.repeat(np.arange(len(x)), count)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[each], mask=ids[each] == _NULL_ID),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), rows)), deviation.take(pa.array(each)),
                    pa.array(white.reshape(-1)), pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(each), error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blobs.mapInArrow(rows_of, COLUMNS)


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """Fits all rows and whitens all rows."""
    blobs, width = stored(vectors, vector)
    return transform(blobs, width, fit(blobs, width, components))
