"""Mixing sources to target weights by iterative proportional fitting (raking)."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._columns import free_names, shielded
from ._store import drop, stored
from ._text import TOKENS, buffers, owners, pieces, spans, word_hashes

DIMENSIONS = ("source", "lang", "topic")

#: For each dimension its target shares by value, or a power: shares go with the tokens to that power.
TARGETS: dict[str, dict[str, float] | float] = {"source": 0.7, "lang": 0.7, "topic": 0.8}
NO_TOPIC = "none"  # of texts without words
WIDTH = 128  # of the vectors by which texts are clustered
_SCALE = 1000  # of centres, which are whole numbers, so that nothing depends on the order of sums


def text_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A vector of small whole numbers for each text, by its words' hashes and the roots of their sums, and its number of tokens."""
    h, offsets = word_hashes(column)
    row, place = owners(offsets), (h >> np.uint64(64 - 7)).astype(np.int64)
    sums = np.bincount(row * WIDTH + place, 1.0 - 2.0 * (h & np.uint64(1)), len(column) * WIDTH).reshape(-1, WIDTH)
    sums = np.sign(sums) * np.sqrt(np.abs(sums))
    length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    vectors = np.rint(127 * np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)).astype(np.int8)
    data, ends = buffers(column)
    first, _ = spans(TOKENS[data], ends)
    return vectors, np.diff(np.searchsorted(first, ends))


def _packed(vectors: np.ndarray) -> pa.Array:
    ends = (np.arange(len(vectors) + 1) * WIDTH).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(vectors))])


def _vectors_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, WIDTH).astype(np.float64)


def described(documents: DataFrame) -> DataFrame:
    """``source``, ``lang``, ``tokens`` and ``vector`` of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in pieces(batch.column("text")):
                part = batch.slice(i, j - i)
                vectors, tokens = text_vectors(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("source"), part.column("lang"), pa.array(tokens), _packed(vectors)], ["source", "lang", "tokens", "vector"])

    kinds = {c: documents.schema[c].dataType.simpleString() for c in ("source", "lang")}
    return documents.select("source", "lang", "text").mapInArrow(run, f"source {kinds['source']}, lang {kinds['lang']}, tokens bigint, vector binary")


def _lang(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "")


def languages_of(rows: DataFrame, most: int) -> list[str]:
    """All languages in order, null as an empty one; more than ``most`` are an error, as each has a mean vector of its own."""
    found = rows.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} languages")
    return sorted(r["lang"] for r in found)


def lang_means(rows: DataFrame, langs: list[str]) -> np.ndarray:
    """The mean vector of each language's texts, as whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), WIDTH + 1))
        for batch in batches:
            vectors, place = _vectors_of(batch.column("vector")), np.asarray(pc.index_in(_lang(batch.column("lang")), pa.array(langs, pa.string())))
            some = vectors.any(axis=1)
            for k in np.unique(place[some]):
                own = vectors[some & (place == k)]
                sums[k, :-1] += own.sum(axis=0)
                sums[k, -1] += len(own)
        number = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(sums.ravel()[number].astype(np.int64))], ["at", "n"])

    found = rows.select("vector", "lang").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(len(langs) * (WIDTH + 1))
    sums[[r["at"] for r in found]] = [float(r["n"]) for r in found]
    sums = sums.reshape(len(langs), WIDTH + 1)
    return np.rint(sums[:, :-1] / np.maximum(sums[:, -1:], 1))


@dataclass
class Topics:
    """Clusters of texts by what their words have beyond their language's: else topics would be languages, whose shares are given apart."""

    langs: list[str]
    means: np.ndarray
    centres: np.ndarray

    def beyond(self, vectors: np.ndarray, lang: pa.Array) -> np.ndarray:
        place = np.asarray(pc.index_in(_lang(lang), pa.array(self.langs, pa.string())))
        return np.where(vectors.any(axis=1)[:, None], vectors - self.means[place], 0.0)

    def names(self, vectors: np.ndarray, lang: pa.Array) -> pa.Array:
        at = nearest(self.beyond(vectors, lang), self.centres)
        return pa.array([f"topic {k}" if k >= 0 else NO_TOPIC for k in np.where(vectors.any(axis=1), np.maximum(at, 0), -1).tolist()], pa.string())


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the centre with the largest product, the first if tied; -1 of vectors without words.  Products are whole numbers, so exact."""
    if not len(centres):
        return np.full(len(vectors), -1)
    return np.where(vectors.any(axis=1), np.argmax(vectors @ centres.T, axis=1), -1)


def _centres(sums: np.ndarray) -> np.ndarray:
    """Directions of some sums of vectors, as whole numbers."""
    length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return np.rint(_SCALE * np.divide(sums, length, out=np.zeros_like(sums), where=length > 0))


def _clustered(some: np.ndarray, topics: int, starts: int = 16, rounds: int = 10) -> np.ndarray:
    """Centres of the best of some clusterings of a few vectors, each from other ones of them."""
    best, centres = -1.0, some[:0]
    for k in range(starts):
        found = _centres(some[np.random.default_rng(k).permutation(len(some))[:topics]])
        for _ in range(rounds):
            at = nearest(some, found)
            found = _centres(np.stack([some[at == c].sum(axis=0) for c in range(len(found))]))
        if (fit := float((some @ found.T).max(axis=1).sum())) > best:
            best, centres = fit, found
    return centres


def learn_topics(rows: DataFrame, topics: int = 8, rounds: int = 6, seeds: int = 256, most_langs: int = 1000) -> Topics:
    """``topics`` clusters of all vectors (spherical k-means): each round adds up, in Spark, the vectors nearest to each centre.

    It starts from the best of some clusterings of ``seeds`` vectors, the ones with the least hashes.
    """
    words = rows.where(F.col("vector") != F.lit(bytes(WIDTH))).select("vector", "lang")
    first = words.withColumn("lot", F.xxhash64("vector", "lang")).distinct().orderBy("lot", "vector", "lang").limit(seeds).select("vector", "lang").toArrow()
    langs = languages_of(rows, most_langs)
    found = Topics(langs, lang_means(rows, langs), np.zeros((0, WIDTH)))
    if not first.num_rows:
        return found
    found.centres = _clustered(found.beyond(_vectors_of(first.column("vector").combine_chunks()), first.column("lang").combine_chunks()), topics)
    for _ in range(rounds):
        held = rows.sparkSession.sparkContext.broadcast(found)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(held.value.centres.shape)
            for batch in batches:
                vectors = held.value.beyond(_vectors_of(batch.column("vector")), batch.column("lang"))
                at = nearest(vectors, held.value.centres)
                for k in np.unique(at[at >= 0]):
                    sums[k] += vectors[at == k].sum(axis=0)
            number = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(sums.ravel()[number].astype(np.int64))], ["at", "n"])

        sums = np.zeros(found.centres.size)
        for r in words.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
            sums[r["at"]] = float(r["n"])
        after = _centres(sums.reshape(found.centres.shape))
        if (after == found.centres).all():
            break
        found = Topics(langs, found.means, after)
    return found


def with_topics(documents: DataFrame, found: Topics, topic: str, tokens: str) -> DataFrame:
    """Adds to ``documents`` each text's topic and number of tokens, under these names."""
    held = documents.sparkSession.sparkContext.broadcast(found)
    names = documents.columns
    at = next(k for k, c in enumerate(names) if c.lower() == "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in pieces(batch.column("text")):
                part = batch.slice(i, j - i)
                vectors, n = text_vectors(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, held.value.names(vectors.astype(np.float64), part.column(at)), pa.array(n)], [*names, topic, tokens])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInArrow(run, f"{schema}, `{topic}` string, `{tokens}` bigint")


def _cell(name: str) -> F.Column:
    """A dimension's value as a key that isn't null: null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def cells(rows: DataFrame, found: Topics) -> DataFrame:
    """Sums of ``tokens`` of described rows by ``DIMENSIONS`` (as keys); tasks add up before anything is shuffled."""
    held = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topic = held.value.names(_vectors_of(batch.column("vector")), batch.column("lang"))
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("lang"), topic, batch.column("tokens")], [*DIMENSIONS, "tokens"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("source", "lang")}
    named = rows.mapInArrow(run, f"source {kinds['source']}, lang {kinds['lang']}, topic string, tokens bigint")
    return named.groupBy(*(_cell(name).alias(name) for name in DIMENSIONS)).agg(F.sum("tokens").alias("tokens"))


def shares(sums: dict[str, float], target: dict[str, float] | float) -> dict[str, float]:
    """Target shares of the values that have tokens: given (a value without one gets 0), or by a power of the tokens."""
    if isinstance(target, dict):
        named = {f"={k}" if k is not None else "": v for k, v in target.items()}
        raw = {k: float(named.get(k, 0.0)) for k, v in sums.items() if v > 0}
    else:
        raw = {k: float(v) ** target for k, v in sums.items() if v > 0}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total else dict.fromkeys(raw, 0.0)


def rake_local(rows: list[tuple], targets: dict, rounds: int = 1000, tolerance: float = 1e-9) -> tuple[list[float], float]:
    """Weights of cells (value of each dimension, ..., tokens) for which weighted sums of tokens have the target shares, and how far off any share was in the last round."""
    tokens = np.array([row[-1] for row in rows], np.float64)
    weight = np.ones(len(rows))
    dims = []
    for k, name in enumerate(DIMENSIONS):
        values = sorted({row[k] for row in rows})
        number = {v: i for i, v in enumerate(values)}
        at = np.array([number[row[k]] for row in rows], np.int64)
        wanted = shares(dict(zip(values, np.bincount(at, tokens, len(values)), strict=True)), targets[name])
        dims.append((at, np.array([wanted.get(v, 0.0) for v in values])))
    total, worst = tokens.sum(), 0.0
    for _ in range(rounds):
        worst = 0.0
        for at, wanted in dims:
            now = np.bincount(at, tokens * weight, len(wanted)) / total
            factor = np.divide(wanted, now, out=np.zeros(len(wanted)), where=now > 0)
            worst = max(worst, np.abs(now - wanted).max(initial=0.0))
            weight = weight * factor[at]
        if worst < tolerance:
            break
    return weight.tolist(), float(worst)


def rake_spark(table: DataFrame, targets: dict, rounds: int = 1000, tolerance: float = 1e-9) -> tuple[DataFrame, float]:
    """As ``rake_local``, for tables of cells too large for the driver: adds ``weight``.

    A weight is the product of one factor for each dimension's value.  Every step computes one dimension's factors
    from the cells and the other factors, and writes them, so that plans and lineage stay as short as at first.
    """
    total = float(table.agg(F.sum("tokens")).first()[0] or 0)
    factors, wanted, written = {}, {}, {}
    for name in DIMENSIONS:
        sums = table.groupBy(name).agg(F.sum("tokens").alias("n")).where("n > 0")
        if isinstance(targets[name], dict):
            named = [(f"={k}" if k is not None else "", float(v)) for k, v in targets[name].items()]
            given = table.sparkSession.createDataFrame(named, f"{name} string, raw double")
            sums = sums.join(given, name, "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
        else:
            sums = sums.withColumn("raw", F.pow(F.col("n").cast("double"), F.lit(targets[name])))
        all_raw = sums.agg(F.sum("raw")).first()[0] or 1.0
        wanted[name] = stored(sums.select(name, (F.col("raw") / all_raw).alias("wanted")))
        factors[name] = wanted[name].select(name, F.lit(1.0).alias(f"f_{name}"))
    weight = F.col("f_source") * F.col("f_lang") * F.col("f_topic")

    def with_factors() -> DataFrame:
        out = table
        for name in DIMENSIONS:
            out = out.join(factors[name], name)
        return out

    worst = 0.0
    for _ in range(rounds):
        worst = 0.0
        for name in DIMENSIONS:
            now = with_factors().groupBy(name).agg((F.sum(F.col("tokens") * weight) / total).alias("now"), F.first(f"f_{name}").alias("f"))
            step = now.join(wanted[name], name).withColumn("away", F.abs(F.col("now") - F.col("wanted")))
            factor = F.when(F.col("now") > 0, F.col("f") * F.col("wanted") / F.col("now")).otherwise(0.0)
            step = stored(step.select(name, factor.alias(f"f_{name}"), "away"))
            worst = max(worst, step.agg(F.max("away")).first()[0] or 0.0)
            if name in written:
                drop(written[name])
            factors[name], written[name] = step.drop("away"), step
        if worst < tolerance:
            break
    return with_factors().select(*table.columns, weight.alias("weight")), worst


def weights(table: DataFrame, targets: dict, driver_cells: int = 100_000, rounds: int = 1000, off: float = 1e-6) -> tuple[DataFrame, bool]:
    """The table of cells with ``weight``, and whether it is proven small: up to ``driver_cells`` rows are raked on the driver, more by Spark, with the same steps.

    Targets that no weights of these cells meet (a share of more than ``off`` is missing after all rounds) are told by a warning.
    """
    spark = table.sparkSession
    table = stored(table.where("tokens > 0"))
    if small := table.count() <= driver_cells:
        rows = [tuple(row) for row in table.select(*DIMENSIONS, "tokens").collect()]
        found, worst = rake_local(rows, targets, rounds) if rows else ([], 0.0)
        schema = ", ".join(f"{name} string" for name in DIMENSIONS) + ", weight double"
        out = spark.createDataFrame([(*row[:-1], w) for row, w in zip(rows, found, strict=True)], schema)
    else:
        out, worst = rake_spark(table, targets, rounds)
    if worst > off:
        warnings.warn(f"no weights meet the targets: after {rounds} rounds a share is off by {worst:.3g}", stacklevel=2)
    return out, small


def calibrated(documents: DataFrame, targets: dict | None = None, seed: int = 0, topics: int = 8, **options) -> DataFrame:
    """Adds to ``documents`` its ``topic``, ``tokens``, ``probability`` to be sampled, and ``sampled``; columns of these names are replaced.

    Topics are clusters of all texts by their words, beyond what their language has (see ``Topics``); more than 1000
    languages are an error.  Cells are all combinations of ``source``, ``lang`` and topic.
    Raking gives each a weight such that weighted tokens have the target shares of every dimension; the probability is the weight over the largest, so that expected
    tokens have those shares, too.  Whether a document is sampled is a hash of seed, id and text against it: it
    holds however often a task runs, and repeated rows share their fate.  Null values are a cell's value like any
    other; texts that are null or without tokens get probability 0, and rows and other columns stay as they are.
    """
    targets = TARGETS if targets is None else targets
    rows = stored(described(documents))
    centres = learn_topics(rows, topics)
    table, small = weights(cells(rows, centres), targets, **options)
    drop(rows)
    largest = table.agg(F.max("weight")).first()[0] or 1.0
    topic, tokens, weight, *keys = free_names(documents, "topic", "tokens", "weight", "source", "lang", "cell")
    table = table.select(*(F.col(a).alias(b) for a, b in zip(DIMENSIONS, keys, strict=True)), F.col("weight").alias(weight))
    given = with_topics(documents, centres, topic, tokens)
    given = given.withColumns(dict(zip(keys, (_cell("source"), _cell("lang"), _cell(topic)), strict=True)))
    given = given.join(F.broadcast(table) if small else table, keys, "left")
    chance = F.when(F.col(tokens) > 0, F.coalesce(F.col(weight), F.lit(0.0)) / largest).otherwise(0.0)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11)).cast("double") / float(1 << 53)
    out = {"topic": F.col(topic), "tokens": F.col(tokens), "probability": chance, "sampled": uniform < chance}
    return given.select(*(f"`{c}`" for c in documents.columns if c not in out), *(v.alias(k) for k, v in out.items()))


def sample(documents: DataFrame, **options) -> DataFrame:
    """Those ``documents`` that are sampled (see ``calibrated``), with all their columns, whatever they are called."""
    return shielded(documents, lambda given: calibrated(given, **options).where("sampled"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling probabilities of all ``documents`` under the standard targets."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return calibrated(documents).drop("text")
