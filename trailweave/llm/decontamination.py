"""Benchmark decontamination with a positional inverted index of the training texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._columns import shielded
from ._store import drop, stored
from ._text import WORDS, flat, list_array, owners, pieces, word_hashes

WINDOW = 13


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct (``item_id`` as string, ``words``: hashes of ``size`` consecutive words, or of all words of a shorter item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (item, _) in enumerate(zip(batch.column("item_id").to_pylist(), range(len(batch)), strict=True)):
                h, _ = word_hashes(batch.column("text").slice(row, 1))
                h = h.view(np.int64)
                if len(h):
                    found = np.lib.stride_tricks.sliding_window_view(h, min(size, len(h)))
                    for i in range(0, len(found), 10_000):
                        part = found[i : i + 10_000]
                        words = list_array(part.ravel(), np.arange(len(part) + 1) * part.shape[1])
                        yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), words], ["item_id", "words"])

    given = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    return given.mapInArrow(run, "item_id string, words array<bigint>").distinct()


@dataclass
class Block:
    """Windows of bounded number, with the terms of their words in order of hash."""

    terms: np.ndarray  # sorted word hashes
    windows: list[np.ndarray]  # each the terms' indexes, in order
    items: list[list[str | None]]  # of each window


def blocks(windows: DataFrame, size: int = 100_000) -> Iterator[Block]:
    """Deals (item, window) pairs by hash to blocks of about ``size``, so that no block grows with the benchmark."""
    windows = stored(windows)
    n = -(-windows.count() // size)
    for k in range(n):
        by: dict[tuple[int, ...], list[str | None]] = {}
        for row in windows.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == k).toLocalIterator():
            by.setdefault(tuple(row["words"]), []).append(row["item_id"])
        if by:
            terms = np.unique(np.array([w for words in by for w in words], np.int64).view(np.uint64))
            yield Block(terms, [np.searchsorted(terms, np.array(words, np.int64).view(np.uint64)) for words in by], list(by.values()))
    drop(windows)


def build_index(documents: DataFrame, terms: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The index, split by document: for each row the ``keep`` columns, ``n_words``, and its postings.

    Postings are the ``terms`` (indexes, ascending) that the whole text has, their frequencies, and their positions,
    ascending within each term.  Null texts have no words.
    """
    held = documents.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = held.value
        for batch in batches:
            for i, j in pieces(batch.column("__text")):
                part = batch.slice(i, j - i)
                h, offsets = word_hashes(part.column("__text"), WORDS)
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                hit = np.flatnonzero(terms[at] == h)
                row = owners(offsets)[hit]
                position = (hit - offsets[row]).astype(np.int32)
                order = np.argsort(row * np.int64(len(terms)) + at[hit], kind="stable")
                key, position = (row * np.int64(len(terms)) + at[hit])[order], position[order]
                starts = np.flatnonzero(np.diff(key, prepend=-1))
                counts = np.diff(starts, append=len(key)).astype(np.int32)
                of = key[starts] // len(terms)
                ends = np.searchsorted(of, np.arange(len(part) + 1))
                by_row = np.searchsorted(row[order], np.arange(len(part) + 1))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(len(keep))), pa.array(np.diff(offsets), pa.int64()), list_array((key[starts] % len(terms)).astype(np.int32), ends), list_array(counts, ends), list_array(position, by_row)],
                    [*keep, "n_words", "terms", "counts", "positions"],
                )

    given = documents.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{schema}, n_words bigint, terms array<int>, counts array<int>, positions array<int>")


def term_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """Occurrences of each test term in all texts: tasks add up what they read, and at most ``n_terms`` sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(flat(batch.column("terms"))[0], flat(batch.column("counts"))[0], minlength=n_terms).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "n"])

    counts = np.zeros(n_terms, np.int64)
    for row in index.select("terms", "counts").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[row["term"]] = row["n"]
    return counts


def _near(start: np.ndarray, adjusted: np.ndarray, slop: int) -> np.ndarray:
    """Those of ``start`` that have a value of ``adjusted`` (both ascending) no more than ``slop`` away."""
    at = np.searchsorted(adjusted, start - slop)
    found = at < len(adjusted)
    found[found] = adjusted[at[found]] <= start[found] + slop
    return start[found]


class Segment:
    """Postings of some documents, merged by term: positions count on from one document to the next, with gaps between."""

    def __init__(self, batch: pa.RecordBatch, n_terms: int, gap: int):
        words = np.asarray(batch.column("n_words"))
        self.base = np.concatenate(([0], np.cumsum(words + gap)))
        terms, ends = flat(batch.column("terms"))
        counts = flat(batch.column("counts"))[0]
        positions, by_row = flat(batch.column("positions"))
        term = np.repeat(terms, counts)
        order = np.argsort(term, kind="stable")
        self.positions = (positions + np.repeat(self.base[:-1], np.diff(by_row)))[order]
        self.ends = np.searchsorted(term[order], np.arange(n_terms + 1))

    def of(self, term: int) -> np.ndarray:
        return self.positions[self.ends[term] : self.ends[term + 1]]

    def matches(self, window: np.ndarray, rarest: np.ndarray, slop: int) -> np.ndarray:
        """Starts (merged positions) of a window: intersects offset-adjusted lists, those of the rarest terms first."""
        start = self.of(window[rarest[0]]) - rarest[0]
        for offset in rarest[1:]:
            if not len(start):
                break
            start = _near(start, self.of(window[offset]) - offset, slop)
        return start


def find(index: DataFrame, block: Block, counts: np.ndarray, slop: int = 2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Matches of a block's windows in an index of its terms, one row for each row of the index.

    ``spans``: from and to (past the last) word of each exact occurrence; ``items``: the items with one, distinct;
    ``near_items``: the items of which each term of some window is within ``slop`` words of its place, distinct.
    """
    order = [np.argsort(counts[window], kind="stable") for window in block.windows]
    held = index.sparkSession.sparkContext.broadcast((len(block.terms), block.windows, order, block.items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_terms, windows, order, items = held.value
        gap = max(map(len, windows)) + slop
        lead = np.array([w[o[0]] for w, o in zip(windows, order, strict=True)])
        for batch in batches:
            segment = Segment(batch, n_terms, gap)
            spans: list[list[dict]] = [[] for _ in range(len(batch))]
            exact: list[set] = [set() for _ in range(len(batch))]
            near: list[set] = [set() for _ in range(len(batch))]
            for k in np.flatnonzero(np.diff(segment.ends)[lead]):
                window = windows[k]
                found = segment.matches(window, order[k], slop)
                if not len(found):
                    continue
                for d in np.unique(np.searchsorted(segment.base, found, "right") - 1):
                    near[d].update(items[k])
                found = segment.matches(window, order[k], 0)
                rows = np.searchsorted(segment.base, found, "right") - 1
                for d, at in zip(rows.tolist(), (found - segment.base[rows]).tolist(), strict=True):
                    spans[d].append({"from": at, "to": at + len(window)})
                    exact[d].update(items[k])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), batch.column("n_words"), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(map(list, exact), pa.list_(pa.string())), pa.array(map(list, near), pa.list_(pa.string()))],
                [*keep, "n_words", "spans", "items", "near_items"],
            )

    schema = ", ".join(f"`{index.schema[name].name}` {index.schema[name].dataType.simpleString()}" for name in keep)
    return index.mapInArrow(run, f"{schema}, n_words bigint, spans array<struct<from: bigint, to: bigint>>, items array<string>, near_items array<string>")


def matches(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = 2, keep: tuple[str, ...] = ("doc_id",), block_windows: int = 100_000) -> DataFrame:
    """Exact and near occurrences of the benchmark in each document, with its ``n_words`` (see ``find`` for the columns).

    The index is written by document, so that neither building nor searching it shuffles texts or postings, and a
    passage that a third of all documents have makes no hot task.  The benchmark's windows are broadcast in blocks of
    bounded number; with more than one block, the blocks' matches are merged by row.  Null and empty texts have
    no words and no matches; repeated rows each get their result; an empty benchmark matches nothing.
    """
    found: list[DataFrame] = []
    given = documents.select(*keep, "text", F.xxhash64("text").alias("__hash"))
    inner = (*keep, "__hash")
    for block in blocks(item_windows(benchmark, size), block_windows):
        index = stored(build_index(given, block.terms, inner))
        found.append(find(index, block, term_counts(index, len(block.terms)), slop, inner))
    if not found:
        nothing = F.array().cast("array<string>")
        index = build_index(given, np.zeros(1, np.uint64), inner)
        return index.select(*keep, "n_words", F.array().cast("array<struct<from: bigint, to: bigint>>").alias("spans"), nothing.alias("items"), nothing.alias("near_items"))
    if len(found) == 1:
        return found[0].drop("__hash")
    merged = found[0]
    for more in found[1:]:
        merged = merged.unionAll(more)
    union = [F.array_distinct(F.flatten(F.collect_list(name))).alias(name) for name in ("spans", "items", "near_items")]
    merged = merged.groupBy(*inner, "n_words").agg(*union, (F.count("*") / len(found)).cast("int").alias("__copies"))
    return merged.withColumn("__copies", F.explode(F.sequence(F.lit(1), "__copies"))).drop("__copies", "__hash")


def hit_words(spans: str) -> F.Column:
    """How many words are inside any of the spans."""
    step = lambda state, span: F.struct(
        (state["hit"] + F.greatest(span["to"] - F.greatest(span["from"], state["to"]), F.lit(0))).alias("hit"),
        F.greatest(state["to"], span["to"]).alias("to"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("to"))
    return F.aggregate(F.array_sort(spans), start, step, lambda state: state["hit"])


def contamination(documents: DataFrame, benchmark: DataFrame, least: int = 20, keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """``matches`` with ``n_hit`` words inside exact occurrences and ``contaminated``: 1 of ``least`` words is hit, or more."""
    found = matches(documents, benchmark, keep=keep, **options).withColumn("n_hit", hit_words("spans"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(least) * F.col("n_hit") >= F.col("n_words")))


def clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Those ``documents`` that aren't contaminated; rows of one id and text share their fate, and all columns pass."""
    row = {"__id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__digest": F.xxhash64("text")}

    def run(documents: DataFrame) -> DataFrame:
        given = documents.withColumns(row)
        found = contamination(given.select("doc_id", "text", *row), benchmark, keep=tuple(row), **options)
        gone = stored(found.where("contaminated").select(*row).distinct())
        return given.join(gone, list(row), "left_anti")

    return shielded(documents, run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of all ``documents`` by all of ``benchmark``."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(documents, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        "contaminated",
        F.size("near_items").cast("bigint").alias("n_near_items"),
    )
