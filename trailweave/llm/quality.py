"""Quality scores by co-training a text-content and a metadata classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import stored
from ._text import WORDS, buffers, mix, owners, pieces, word_hashes
from .language_id import fold

BITS = 18  # of the buckets that features are hashed to, for each view
VIEWS = ("text", "metadata")
#: Kinds of bytes whose shares of a text are features.
KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*", b"|", b"!?", b".,;:", b"\n", b" ", bytes(range(128, 256)))


def _bucket(name: str, value: np.ndarray) -> np.ndarray:
    """A feature for each value of a named property."""
    seed = np.uint64(int.from_bytes(name.encode()[:8].ljust(8, b"\0"), "little"))
    return mix(mix(np.asarray(value).astype(np.int64).view(np.uint64)) ^ seed)


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) pairs without repeats: the words of each text, and the sizes of its shares of kinds of bytes, by powers of two."""
    h, offsets = word_hashes(column, WORDS)
    rows, found = [owners(offsets)], [h]
    data, ends = buffers(column)
    size = np.maximum(np.diff(ends), 1)
    all_rows = np.arange(len(column))
    for k, kind in enumerate(KINDS):
        table = np.zeros(256, np.int32)
        table[list(kind)] = 1
        sums = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
        share = (sums[ends[1:]] - sums[ends[:-1]]) / size
        rows.append(all_rows)
        found.append(_bucket(f"kind{k}", np.ceil(2 * np.log2(share * 4096 + 1))))
    words = np.diff(offsets)
    rows += [all_rows, all_rows]
    found += [_bucket("words", np.ceil(2 * np.log2(words + 1))), _bucket("length", np.ceil(4 * size / np.maximum(words, 1)))]
    return _distinct(np.concatenate(rows), np.concatenate(found))


def metadata_features(lang: list, source: list, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) pairs of a page's language, source, both together, and length; null is a value like any other."""
    rows = np.arange(len(n_chars))
    codes = [np.array([hash_text(f"{kind}={x}") for x in values], np.uint64) for kind, values in (("lang", lang), ("source", source))]
    found = [_bucket("lang", codes[0].view(np.int64)), _bucket("source", codes[1].view(np.int64)), _bucket("both", (codes[0] * np.uint64(3) + codes[1]).view(np.int64)), _bucket("chars", np.ceil(2 * np.log2(np.maximum(n_chars, 0) + 1)))]
    return _distinct(np.tile(rows, len(found)), np.concatenate(found))


def hash_text(text: str) -> int:
    return int(word_hashes(pa.array([text.encode().hex()]))[0][0])


def _distinct(rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((rows.astype(np.int64) << BITS) | (found >> np.uint64(64 - BITS)).astype(np.int64))
    return both >> BITS, both & ((1 << BITS) - 1)


def views(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    n_chars = np.asarray(batch.column("n_chars").cast(pa.int64()).fill_null(0))
    return [text_features(batch.column("text")), metadata_features(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), n_chars)]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Linear:
    """Logistic regression over buckets."""

    weight: np.ndarray
    bias: float = 0.0

    def logits(self, rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, self.weight[buckets], minlength=n) + self.bias

    @classmethod
    def fit(cls, rows: np.ndarray, buckets: np.ndarray, y: np.ndarray, taught: np.ndarray, share: float, steps: int = 100, decay: float = 1e-4, rate: float = 0.3, prior: float = 4.0) -> Linear:
        """Full-batch AdaGrad on labelled rows, over features scaled by their smoothed log-odds, so that rare but telling ones count.

        The odds also count the rows that the other view has labelled: ``taught`` has those of class 0 and 1 by bucket, of ``share`` a row each.
        Features of one row alone tell nothing of others and get weight 0.
        """
        zeros, ones = (np.bincount(buckets[y[rows] == k], minlength=1 << BITS) + share * taught[k] for k in (0, 1))
        used = np.flatnonzero(np.bincount(buckets, minlength=1 << BITS) + taught.sum(axis=0) > 1)
        base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        odds = np.zeros(1 << BITS)
        odds[used] = np.log((ones[used] + prior * base) / (zeros[used] + prior * (1 - base))) - np.log(base / (1 - base))
        known, at = np.unique(buckets, return_inverse=True)
        scale = odds[known]
        weight, bias = np.full(len(known), 0.1), np.log(base / (1 - base))
        past, past_bias = np.full(len(known), 1e-8), 1e-8
        for _ in range(steps):
            error = sigmoid(np.bincount(rows, (weight * scale)[at], minlength=len(y)) + bias) - y
            grad = np.bincount(at, error[rows], minlength=len(known)) * scale / len(y) + decay * weight
            past += grad * grad
            weight -= rate * grad / np.sqrt(past)
            past_bias += error.mean() ** 2
            bias -= 0.1 * error.mean() / np.sqrt(past_bias)
        full = 0.1 * odds  # of features that no labelled row has
        full[known] = weight * scale
        return cls(full, float(bias))


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of the columns of z, and a bias, of a logistic regression with a little decay (Platt's scaling for one or more views)."""
    scale = np.maximum(np.abs(z).mean(axis=0), 1e-6)
    x = np.column_stack((z / scale, np.ones(len(z))))
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton's steps would do in fewer, but may diverge where classes part cleanly
        w -= 0.5 * (x.T @ (sigmoid(x @ w) - y) / len(y) + 1e-3 * w)
    return np.concatenate((w[:-1] / scale, w[-1:]))


@dataclass
class Model:
    """Views' classifiers with the weights that combine their logits."""

    linear: list[Linear]
    combine: np.ndarray

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        z = np.column_stack([m.logits(*f, n) for m, f in zip(self.linear, found, strict=True)])
        return sigmoid(z @ self.combine[:-1] + self.combine[-1])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) pairs of a column of packed buckets."""
    data = [np.frombuffer(x.as_buffer(), np.int32) for x in column]
    return np.repeat(np.arange(len(data)), [len(x) for x in data]), np.concatenate([*data, np.zeros(0, np.int32)]).astype(np.int64)


def featured(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of all rows, and the buckets of both views as packed numbers; ``mark`` and ``lot``, hashes of the row's id and features, and how many these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in pieces(batch.column("text")):
                part = batch.slice(i, j - i)
                packed, size, lot = [], np.zeros(len(part), np.int64), np.zeros(len(part), np.uint64)
                for k, (rows, buckets) in enumerate(views(part)):
                    ends = np.searchsorted(rows, np.arange(len(part) + 1))
                    packed.append(pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(buckets.astype(np.int32))]))
                    size += np.diff(ends)
                    np.add.at(lot, rows, mix(buckets.astype(np.uint64) + np.uint64(k << BITS)))
                yield pa.RecordBatch.from_arrays([*(part.column(f"own_{k}") for k in range(len(keep))), *packed, part.column("mark"), pa.array(mix(lot).view(np.int64)), pa.array(size)], [*keep, *VIEWS, "mark", "lot", "size"])

    given = documents.select(*(F.col(c).alias(f"own_{k}") for k, c in enumerate(keep)), F.xxhash64("doc_id").alias("mark"), "text", "lang", "source", "n_chars")
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return given.mapInArrow(run, f"{schema}, text binary, metadata binary, mark bigint, lot bigint, size bigint")


def labelled(rows: DataFrame, labels: DataFrame, target: str, size: int) -> DataFrame:
    """Up to ``size`` ids of featured rows that have a label, those with the least hashes: ``doc_id``, class ``y``, and whether it is ``held`` for calibration.

    Labels of an id that differ count by their mean, those of absent documents not at all.
    """
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(target) >= 0.5).cast("int").alias("y"))
    known = known.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    return known.withColumn("held", fold("doc_id", 4) == 2)


@dataclass
class Sample:
    """Labelled rows on the driver: their buckets by view, classes, which of them are kept for calibration, and the marks (see ``featured``) of their ids."""

    found: list[tuple[np.ndarray, np.ndarray]]
    y: np.ndarray
    held: np.ndarray
    marks: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, labels: DataFrame, target: str, size: int, features: int) -> Sample:
        ids = labelled(rows, labels, target, size).toArrow()  # bounded by size
        some = rows.join(F.broadcast(rows.sparkSession.createDataFrame(ids)), "doc_id")
        order = ["mark", "doc_id", "lot"]
        sizes = some.select(*order, "size").orderBy(*order).limit(size).toArrow()
        most = int(np.searchsorted(np.cumsum(np.asarray(sizes.column("size").combine_chunks())), features, "right"))
        table = some.orderBy(*order).limit(max(most, min(1, sizes.num_rows))).select(*VIEWS, "y", "held", "mark").toArrow().combine_chunks()
        columns = {name: (table.column(name).chunk(0) if table.num_rows else pa.array([], table.schema.field(name).type)) for name in table.schema.names}
        marks = np.unique(np.asarray(columns["mark"]))
        return cls([_unpacked(columns[v]) for v in VIEWS], np.asarray(columns["y"]).astype(np.int64), np.asarray(columns["held"].cast(pa.int8())).astype(bool), marks)

    def training(self, view: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, buckets = self.found[view]
        number = np.cumsum(~self.held) - 1
        some = ~self.held[rows]
        return number[rows[some]], buckets[some], self.y[~self.held].astype(float)

    def both_classes(self) -> bool:
        return len(set(self.y[~self.held].tolist())) == 2


BINS = 4096  # of logits from -40 to 40, for the histograms by which confident rows are chosen


def _bin(z: np.ndarray) -> np.ndarray:
    return ((np.clip(z, -40, 40) + 40) * ((BINS - 1) / 80)).astype(np.int64)


@dataclass
class Confident:
    """The rows that a view is surest of: whole bins of logits beyond a bound, and a share of the rows, by lot, in the bin at the bound."""

    low: int
    low_share: float
    high: int
    high_share: float

    @classmethod
    def of(cls, histogram: np.ndarray, zeros: int, ones: int) -> Confident:
        def bound(counts: np.ndarray, take: int) -> tuple[int, float]:
            sums = np.cumsum(counts)
            at = int(np.searchsorted(sums, take))
            return (at, (take - (sums[at] - counts[at])) / counts[at]) if at < len(counts) and counts[at] else (at, 0.0)

        low, low_share = bound(histogram, zeros)
        high, high_share = bound(histogram[::-1], ones)
        return cls(low, low_share, len(histogram) - 1 - high, high_share)

    def label(self, z: np.ndarray, lot: np.ndarray) -> np.ndarray:
        """1, 0, or -1 where the view isn't sure."""
        at, draw = _bin(z), lot.view(np.uint64) / 2.0**64
        zero = (at < self.low) | ((at == self.low) & (draw < self.low_share))
        one = (at > self.high) | ((at == self.high) & (draw < self.high_share))
        return np.where(one & ~zero, 1, np.where(zero & ~one, 0, -1))


def _summed(rows: DataFrame, values: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of what ``values`` gives for each batch, (key, count) pairs of a bounded number of keys; tasks add up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            found = [(keys, counts), *values(batch)]
            keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([n for _, n in found]), minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    table = rows.select(*VIEWS, "mark", "lot").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return np.asarray(table.column("key").combine_chunks()), np.asarray(table.column("n").combine_chunks())


def co_train(rows: DataFrame, labels: DataFrame, targets: tuple[str, ...], size: int = 8000, features: int = 16_000_000, rounds: int = 3, share: float = 0.05) -> dict[str, Model | None]:
    """For each target, two classifiers that teach each other over all rows (see ``featured``), and the weights that combine them.

    The classifiers are fitted on a bounded sample of labelled rows: up to ``size`` of them and ``features`` features in
    all, those with the least hashes of ids.  All else is counted over the whole table.  In round k each view scores
    all rows beyond the sample, whether labelled or not, labels those that it is surest of, k times ``share`` of them in the labelled rows' proportion of classes, and
    their features, added up by Spark, count for the other view as much as the labelled rows do.  Then labelled rows
    kept apart calibrate the views together.  Without labelled rows of both classes a target has no model.
    """
    spark = rows.sparkSession
    samples = {t: s for t in targets if (s := Sample.of(rows, labels, t, size, features)).both_classes()}
    names = list(samples)
    taught = {(t, v): np.zeros((2, 1 << BITS), np.int64) for t in names for v in range(2)}
    taught_rows = dict.fromkeys(taught, 0)

    def fitted() -> dict[tuple[str, int], Linear]:
        found = {}
        for t, v in taught:
            own = samples[t].training(v)
            found[t, v] = Linear.fit(*own, taught[t, v], len(own[2]) / max(len(own[2]), taught_rows[t, v]))
        return found

    models = fitted()
    for k in range(1, rounds + 1 if names else 1):
        held = spark.sparkContext.broadcast((models, {t: s.marks for t, s in samples.items()}))

        def scored(batch: pa.RecordBatch, held=held) -> Iterator[tuple[int, str, np.ndarray, np.ndarray, list]]:
            found = [_unpacked(batch.column(v)) for v in VIEWS]
            for i, t in enumerate(names):
                free = ~np.isin(np.asarray(batch.column("mark")), held.value[1][t])
                for v in range(2):
                    yield 2 * i + v, t, free, held.value[0][t, v].logits(*found[v], len(batch)), found

        def histograms(batch: pa.RecordBatch, scored=scored) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for number, _, free, z, _ in scored(batch):
                yield np.unique(number * BINS + _bin(z[free]), return_counts=True)

        keys, counts = _summed(rows, histograms)
        histogram = np.zeros(2 * len(names) * BINS, np.int64)
        histogram[keys] = counts
        chosen = []
        for number, own in enumerate(histogram.reshape(-1, BINS)):
            y = samples[names[number // 2]].y[~samples[names[number // 2]].held]
            take = int(min(1.0, k * share) * own.sum())
            ones = int(round(take * y.mean()))
            chosen.append(Confident.of(own, take - ones, ones))

        def counted(batch: pa.RecordBatch, scored=scored, chosen=chosen) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            lot = np.asarray(batch.column("lot"))
            for number, _, free, z, found in scored(batch):
                label = np.where(free, chosen[number].label(z, lot), -1)
                of, buckets = found[1 - number % 2]  # this view's labels teach the other one
                some = label[of] >= 0
                base = 2 * number << BITS + 1
                yield np.unique(base + (label[of[some]] << BITS + 1) + buckets[some], return_counts=True)
                yield base + (np.array([0, 1]) << BITS + 1) + (1 << BITS), np.array([(label == 0).sum(), (label == 1).sum()])

        keys, counts = _summed(rows, counted)
        sums = np.zeros((2 * len(names), 2, 2 << BITS), np.int64)
        sums.reshape(-1)[keys] = counts
        for number in range(2 * len(names)):
            to = names[number // 2], 1 - number % 2
            taught[to], taught_rows[to] = sums[number][:, : 1 << BITS], int(sums[number][:, 1 << BITS].sum())
        models = fitted()
    out: dict[str, Model | None] = dict.fromkeys(targets)
    for t, s in samples.items():
        z = np.column_stack([models[t, v].logits(*s.found[v], len(s.y)) for v in range(2)])
        use = s.held if len(set(s.y[s.held].tolist())) > 1 else np.ones(len(s.y), bool)
        out[t] = Model([models[t, v] for v in range(2)], calibrate(z[use], s.y[use].astype(float)))
    return out


def scored(rows: DataFrame, models: dict[str, Model | None], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of featured rows and a score, the probability of class 1, for each target; null without a model."""
    held = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_unpacked(batch.column(v)) for v in VIEWS]
            scores = [pa.nulls(len(batch), pa.float64()) if m is None else pa.array(m.scores(found, len(batch))) for m in held.value.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *scores], [*keep, *(f"{x}_score" for x in models)])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*(f"`{c}`" for c in keep), *VIEWS).mapInArrow(run, f"{schema}, " + ", ".join(f"{x}_score double" for x in models))


def quality(documents: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic"), **options) -> DataFrame:
    """``doc_id`` of all ``documents`` and, for each target that ``labels`` has a column of, its score (see ``co_train``).

    Texts count whole; null texts and null metadata are values that the models may know or not.  Repeated rows are
    scored, counted and, if labelled, sampled like any others.  Labels that are null, of a null id, or of absent
    documents count nothing.
    """
    rows = stored(featured(documents))
    return scored(rows, co_train(rows, labels, targets, **options))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` for both kinds of ``labels``."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality(documents, labels).withColumns({t: F.col(f"{t}_score") >= 0.5 for t in ("quality", "toxic")})
