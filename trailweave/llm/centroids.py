"""Clustering around centroids: Lloyd's rounds over vectors of whole numbers, so that no result depends on the order of sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import stored

DIMS, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, "3:"
MOST = 1 << 27  # of a component's absolute value: squared distances of 64 of them fit in 64 bits


def finite_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column have exactly ``dims`` entries, none null or not finite, and their entries as doubles."""
    right = np.flatnonzero(np.asarray(pc.equal(pc.fill_null(pc.list_value_length(column), -1), dims)))
    flat = pc.cast(column.take(pa.array(right)).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(len(right), dims)
    good = np.isfinite(flat).all(axis=1)
    return right[good], flat[good]


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def scaled(table: DataFrame, key: str, vector: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``key`` and ``v``, floor(scale * component) as 32-bit numbers, of the rows whose vector has exactly ``dims`` finite components.

    A component beyond ``MOST`` is an error, as distances wouldn't fit in 64 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, found = finite_rows(batch.column(1), dims)
            found = np.floor(found * scale)
            if (np.abs(found) > MOST).any():
                raise ValueError(f"components beyond {MOST} / {scale}")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), packed(found.astype(np.int32))], ["key", "v"])

    kind = table.schema[key].dataType.simpleString()
    return table.select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInArrow(run, f"key {kind}, v binary")


def matrix(values: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.int32).reshape(-1, dims).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the number of the nearest centroid, the smallest if tied, and its squared distance."""
    distances = np.empty((len(centroids), len(x)), np.int64)
    for k, centroid in enumerate(centroids):
        away = x - centroid
        distances[k] = np.einsum("ij,ij->i", away, away)
    at = distances.argmin(axis=0)
    return at, distances[at, np.arange(len(x))]


def first_centroids(rows: DataFrame, k: int, dims: int, seed: str) -> np.ndarray:
    """The vectors with the ``k`` smallest SHA-256 of seed and key, in that order; ties go by the vector, and null keys come last."""
    lot = F.sha2(F.concat(F.lit(seed), F.col("key").cast("string")).cast("binary"), 256)
    found = rows.select("v", lot.alias("lot")).orderBy(F.asc_nulls_last("lot"), "v").limit(k).collect()
    return matrix([bytes(r["v"]) for r in found], dims)


def sums(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """For each centroid the sums of its vectors' components, their number, and the upper and lower halves of their distances' sum.

    Each partition adds up its own vectors; the partitions' whole numbers, k * (components + 3) each, meet in a groupBy.
    """
    held = rows.sparkSession.sparkContext.broadcast(centroids)
    k, dims = centroids.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, dims + 3), np.int64)
        for batch in batches:
            x = matrix(batch["v"], dims)
            at, distance = nearest(x, held.value)
            for c in np.unique(at):
                own = at == c
                total[c, :dims] += x[own].sum(axis=0)
                total[c, dims:] += [own.sum(), (distance[own] >> 32).sum(), (distance[own] & 0xFFFFFFFF).sum()]
        place = np.flatnonzero(total)
        yield pd.DataFrame({"place": place, "total": total.ravel()[place]})

    out = np.zeros(k * (dims + 3), object)
    for r in rows.mapInPandas(run, "place bigint, total bigint").groupBy("place").agg(F.sum("total").alias("total")).collect():
        out[r["place"]] = r["total"]
    return out.reshape(k, dims + 3)


def lloyd(rows: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after some rounds: each becomes the floor of its vectors' mean, by component; one without vectors stays."""
    for _ in range(rounds):
        after = centroids.copy()
        for c, total in enumerate(sums(rows, centroids)):
            if n := total[-3]:
                after[c] = [s // n for s in total[:-3]]
        if (after == centroids).all():
            break  # further rounds change nothing
        centroids = after
    return centroids


def clustered(table: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """For each row whose vector has exactly ``dims`` finite components: ``key``, ``cluster``, squared ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    Other rows (null vectors, other lengths, null or non-finite entries) are left out; fewer than ``k`` rows give as many
    centroids; null and repeated keys are rows like others; an empty table gives no rows, and other columns aren't read.
    Rows are written once as whole numbers and read in each round.  An inertia beyond 64 bits is an error.
    """
    rows = stored(scaled(table, key, vector, dims, scale))
    centroids = lloyd(rows, first_centroids(rows, k, dims, seed), rounds)
    inertia = [(int(hi) << 32) + int(lo) for hi, lo in sums(rows, centroids)[:, -2:]]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    held = rows.sparkSession.sparkContext.broadcast((centroids, np.array(inertia, np.int64), np.array(digests, object)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, inertia, digests = held.value
        for batch in batches:
            at, distance = nearest(matrix(batch["v"], dims), centroids)
            yield pd.DataFrame({"key": batch["key"], "cluster": at.astype(np.int32), "distance": distance, "cluster_inertia": inertia[at], "inertia": sum(inertia.tolist()), "centroid_sha256": digests[at]})

    kind = table.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all ``embeddings`` after ten rounds."""
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _rounds(rounds: int) -> str:
    """A round for each number: distances by component, the nearest centroid of each vector, and floors of means."""
    out = []
    for r in range(rounds + 1):
        out.append(f"d{r} AS (SELECT row, c, sum((x - m) * (x - m)) AS distance FROM x JOIN c{r} USING (dim) GROUP BY row, c), a{r} AS MATERIALIZED (SELECT row, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM d{r} GROUP BY row)")
        if r < rounds:
            means = f"SELECT c, dim, (s - ((s % n) + n) % n) // n AS m FROM (SELECT c, dim, sum(x) AS s, count(*) AS n FROM x JOIN a{r} USING (row) GROUP BY c, dim)"
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, c{r}.dim, coalesce(n.m, c{r}.m) AS m FROM c{r} LEFT JOIN ({means}) n ON n.c = c{r}.c AND n.dim = c{r}.dim)")
    return ",\n".join(out)


ORACLE_SQL = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) = {DIMS} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
x AS MATERIALIZED (SELECT row, unnest(range({DIMS})) AS dim, unnest(v) AS x FROM kept),
c0 AS MATERIALIZED (SELECT c, unnest(range({DIMS})) AS dim, CAST(unnest(v) AS HUGEINT) AS m FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}' || vec_id), v) - 1 AS c, v FROM kept ORDER BY c LIMIT {K})),
{_rounds(ROUNDS)},
digests AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY dim)) AS digest FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256
FROM kept JOIN a{ROUNDS} USING (row) JOIN digests USING (c)"""
