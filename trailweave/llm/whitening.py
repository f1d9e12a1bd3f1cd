"""Whitening of embeddings: covariance by tiles, eigenvectors, and projections of unit variance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import drop, stored
from .centroids import packed

SCALE, SHIFT = 64, 1_000_000
WIDTH, BLOCK = 16, 1024  # dimensions and rows of a column block
MOST = 1 << 52  # whole numbers up to here are exact in a double
_NOISE = 1e-12  # eigenvalues up to this part of the largest are rounding


def scaled(table: DataFrame, key: str, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``key``, ``dims`` and ``x``, floor(scale * entry) + shift as 64-bit numbers, of the rows whose vector is not null and has finite entries only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
            for dims in np.unique(lengths[lengths > 0]).tolist():
                own = np.flatnonzero(lengths == dims)
                found = pc.cast(column.take(pa.array(own)).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
                good = np.isfinite(found).all(axis=1)
                found = np.floor(found[good] * scale)
                if (np.abs(found) > MOST).any():
                    raise ValueError(f"entries beyond {MOST} / {scale}")
                kept = own[good]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(np.full(len(kept), dims, np.int32)), packed(found.astype(np.int64) + shift)], ["key", "dims", "x"])

    kind = table.schema[key].dataType.simpleString()
    return table.select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInArrow(run, f"key {kind}, dims int, x binary")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dims)


#: From a matrix of whole numbers to the matrix that is meant; sent to the tasks.
Seen = Callable[[np.ndarray], np.ndarray]


class Centred:
    """x - S / n, rounded once: whole numbers less the whole part of the mean, less its fraction."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.over = [s % n for s in sums]
        self.part = np.array([s % n / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n * x - S) ** 2, exact."""
        y = x - self.whole
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if most * most * x.shape[1] < 1 << 63:
            away = self.n * y - np.array(self.over, np.int64)
            return pa.array(np.einsum("ij,ij->i", away, away)).cast(pa.decimal128(38, 0))
        away = self.n * y.astype(object) - np.array(self.over, object)
        return pa.array([Decimal(int(v)) for v in (away * away).sum(axis=1)], pa.decimal128(38, 0))


class Whitened:
    """Centred vectors projected on eigenvectors, over the roots of the eigenvalues."""

    def __init__(self, centred: Centred, values: np.ndarray, vectors: np.ndarray, mean: np.ndarray | float = 0.0):
        self.centred, self.by, self.mean = centred, vectors / np.sqrt(values), mean

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.by - self.mean


def column_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """How many rows of ``x`` there are, and the exact sum of each dimension; tasks add up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims + 1, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            total += np.append(x.sum(axis=0), len(x))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), pa.array(total)], ["at", "total"])

    out = [0] * (dims + 1)
    for r in fit.select("x").mapInArrow(run, "at bigint, total bigint").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r["at"]] = int(r["total"])
    return out[-1], out[:-1]


def column_means(fit: DataFrame, dims: int, seen: Seen, n: int) -> np.ndarray:
    """Means of what is seen of ``fit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            total = total + seen(_matrix(batch.column("x"), dims)).sum(axis=0)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "total"])

    found = fit.select("x").mapInArrow(run, "at bigint, total double").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()
    return np.array([r["total"] for r in found]) / n


def column_blocks(fit: DataFrame, dims: int, seen: Seen, width: int, block: int) -> DataFrame:
    """What is seen of ``fit`` (already centred), cut into row blocks of up to ``block`` rows and each of those into blocks of ``width`` columns.

    Each column block comes once for every tile (``a``, ``b``), a <= b, that it takes part in: ``part`` tells the row block and ``col`` the columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            for i in range(0, len(x), block):
                z = seen(x[i : i + block])
                cuts = [np.ascontiguousarray(z[:, j : j + width]) for j in range(0, z.shape[1], width)]
                tiles = [(a, b, col) for a in range(len(cuts)) for b in range(a, len(cuts)) for col in sorted({a, b})]
                a, b, col = (pa.array(t, pa.int32()) for t in zip(*tiles, strict=True))
                data = pa.array([cuts[c].tobytes() for _, _, c in tiles], pa.binary())
                yield pa.RecordBatch.from_arrays([a, b, pa.array([(task << 32) + made] * len(tiles)), col, pa.array([len(z)] * len(tiles), pa.int32()), data], ["a", "b", "part", "col", "rows", "data"])
                made += 1

    return fit.select("x").mapInArrow(run, "a int, b int, part bigint, col int, rows int, data binary")


def tile_sums(blocks: DataFrame) -> DataFrame:
    """For each tile (``a``, ``b``) and each cell ``at`` of it (row by row), the sum of products over all rows: ``total``.

    Column blocks are shuffled by tile and row block, so that those of a tile and a row block meet; a task multiplies
    pair after pair, holding one tile's sums, and the tasks' sums meet in a groupBy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, left = None, 0.0, None

        def out() -> pa.RecordBatch:
            cells = total.ravel()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), now[0], np.int32)), pa.array(np.full(len(cells), now[1], np.int32)), pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["a", "b", "at", "total"])

        for batch in batches:
            for a, b, part, col, rows, data in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "part", "col", "rows", "data")), strict=True):
                cut = np.frombuffer(data, np.float64).reshape(rows, -1)
                if a != b and col == a:
                    left = (part, cut)
                    continue
                if now != (a, b):
                    if now is not None:
                        yield out()
                    now, total = (a, b), 0.0
                if a != b and left[0] != part:
                    raise ValueError("a column block without the other one of its tile")
                total = total + (cut if a == b else left[1]).T @ cut
        if now is not None:
            yield out()

    dealt = blocks.repartition("a", "b", "part").sortWithinPartitions("a", "b", "part", "col")
    return dealt.mapInArrow(run, "a int, b int, at int, total double").groupBy("a", "b", "at").agg(F.sum("total").alias("total"))


def covariance(fit: DataFrame, dims: int, seen: Seen, size: int, n: int, width: int = WIDTH, block: int = BLOCK) -> np.ndarray:
    """The covariance, divisor ``n``, of the ``size`` columns that are seen, already centred, of ``fit``: its tiles are put together on the driver, which holds size * size numbers."""
    out = np.zeros((size, size))
    found = tile_sums(column_blocks(fit, dims, seen, width, block)).toArrow()
    a, b, at, total = (np.asarray(found[c].combine_chunks()) for c in ("a", "b", "at", "total"))
    wide = np.minimum(width, size - b * width)
    row, col = a * width + at // np.maximum(wide, 1), b * width + at % np.maximum(wide, 1)
    out[row, col] = out[col, row] = total / n
    return out


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` eigenvalues, falling, and unit eigenvectors (columns) whose largest entry is positive; those without variance are left out."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    real = values > _NOISE * max(values[0], 0.0) if len(values) else np.zeros(0, bool)
    values, vectors = values[real], vectors[:, real]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])


def whitened(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = SCALE, shift: int = SHIFT, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """For each row with a whole vector and each component, by falling variance: ``key``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Entries become floor(scale * entry) + shift.  The fit is over each distinct vector of these once: ``n`` of them, their
    means, and their covariance, centred before it is multiplied, by tiles.  ``deviation`` is a decimal.
    Rows whose vector is null, empty, or has null or non-finite entries are left out, and so are those of another
    length than the most frequent one (the longest, if tied), which can't be projected.  Components without variance
    (fewer distinct vectors than dimensions) are left out, too, so that a table of one distinct vector gives no rows;
    nor does an empty table.  Null and repeated keys are rows like others; other columns aren't read.
    """
    kind = table.schema[key].dataType.simpleString()
    rows = stored(scaled(table, key, vector, scale, shift))
    schema = f"key {kind}, deviation decimal(38,0), whitened array<double>"
    common = rows.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    n, explained, error, seen, dims = 0, np.zeros(0), 0.0, None, 0
    if common:
        dims = common["dims"]
        rows = rows.where(F.col("dims") == dims)
        fit = stored(rows.select("x").distinct())
        n, sums = column_sums(fit, dims)
        centred = Centred(n, sums)
        v = covariance(fit, dims, centred, dims, n, width, block)
        values, vectors = principal(v, components)
        if len(values):
            seen, explained = Whitened(centred, values, vectors), values / np.trace(v)
            off = Whitened(centred, values, vectors, column_means(fit, dims, seen, n))
            error = float(np.abs(covariance(fit, dims, off, len(values), n, width, block) - np.eye(len(values))).max())
        drop(fit)
    if seen is None:
        found = table.sparkSession.createDataFrame([], schema)
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("x"), dims)
                ends = (np.arange(len(x) + 1) * len(explained)).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(seen(x).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("key"), seen.centred.deviation(x), values], ["key", "deviation", "whitened"])

        found = rows.select("key", "x").mapInArrow(run, schema)
    found = found.select("key", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    shares = F.array(*(F.lit(float(e)) for e in explained)).cast("array<double>")
    return found.select(F.col("key").alias(key), (F.col("place") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of all ``embeddings``; a deviation beyond 64 bits is null."""
    found = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))
