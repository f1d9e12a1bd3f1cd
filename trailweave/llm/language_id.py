"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._columns import shielded

UNDETERMINED = "und"
_PAD = 1  # stands for the end of a word; no letter has this code point
_BITS = 21  # of a code point


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter (general category L)."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)])


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, one pad for each run of others, and a pad at either end."""
    code = np.array(np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32))
    code[~_letters()[code]] = _PAD
    code = np.concatenate((np.full(1, _PAD, np.uint32), code, np.full(1, _PAD, np.uint32)))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != _PAD) | (code[:-1] != _PAD)
    return code[keep]


def ngram_counts(text: str | None, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Codes (ascending) and counts of the 1-, 2- and 3-grams of letters; words are padded at both ends.

    An n-gram is its code points, 21 bits each, so that codes are exact.  Long texts are counted in pieces that
    overlap by two letters, so that besides some bytes for each letter memory grows with the distinct n-grams alone.
    """
    code = _codes(text or "")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, len(code), piece):
        s = code[i : i + piece + 2].astype(np.int64)
        one = s[:piece]
        two = ((s[:-1] << _BITS) | s[1:])[:piece]
        parts = [one[one != _PAD], two]
        if len(s) > 2:
            three = (((s[:-2] << _BITS) | s[1:-1]) << _BITS) | s[2:]
            parts.append(three[s[1:-1] != _PAD])
        found.append(np.unique(np.concatenate(parts), return_counts=True))
    if len(found) == 1:
        codes, counts = found[0]
    else:
        codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([n for _, n in found])).astype(np.int64)
    lone = codes == ((_PAD << _BITS) | _PAD)  # a text without letters is one pad, or two
    return codes[~lone], counts[~lone]


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, best first; ties go to the smaller code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def train_profiles(documents: DataFrame, size: int = 300, max_languages: int = 10_000, merge_at: int = 500_000) -> dict[str, np.ndarray]:
    """The ``size`` most frequent n-grams of each non-null ``lang``, best first, counted over all texts given.

    Tasks count what they read; only their totals for each language and n-gram are shuffled.  The profiles are
    at most ``size`` codes for each language, and more than ``max_languages`` languages are an error, which bounds
    what the driver gets and broadcasts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        new: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def merge() -> None:
            for lang, found in new.items():
                found = [*found, *([total[lang]] if lang in total else [])]
                codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                total[lang] = codes, np.bincount(where, np.concatenate([n for _, n in found]), minlength=len(codes)).astype(np.int64)
            new.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                one = ngram_counts(text.as_py())
                new.setdefault(lang, []).append(one)
                held += len(one[0])
                if held > merge_at:
                    merge()
                    held = 0
        merge()
        for lang, (codes, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["lang", "code", "n"])

    known = documents.where(F.col("lang").isNotNull()).select("lang", "text")
    counts = known.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # A language's n-grams are as many as its alphabet allows, whatever the corpus: a small group for a window.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= size)
    rows = best.limit(max_languages * size + 1).collect()
    if len(rows) > max_languages * size:
        raise ValueError(f"more than {max_languages} languages")
    found: dict[str, list[tuple[int, int]]] = {}
    for row in rows:
        found.setdefault(row["lang"], []).append((row["rank"], row["code"]))
    return {lang: np.array([code for _, code in sorted(found[lang])], np.int64) for lang in sorted(found)}


class Profiles:
    """Ranks of all languages' n-grams, laid out for comparison with many documents."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.size, self.langs = size, list(profiles)
        self.codes = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
        self.rank = np.full((len(self.langs), len(self.codes)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[k, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngram_counts(text)
        if not len(codes) or not self.langs:
            return UNDETERMINED, 0.0
        best = top(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.codes, best), len(self.codes) - 1)
        rank = np.where(self.codes[at] == best, self.rank[:, at], -1)
        away = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(best)))).sum(axis=1)
        k = int(np.argmin(away))  # the first in order of name, if tied
        return self.langs[k], 1.0 - float(away[k]) / (self.size * len(best))


def predict(documents: DataFrame, profiles: dict[str, np.ndarray], size: int = 300, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds to the ``keep`` columns ``lang_pred``, the language at the least out-of-place distance, and ``score``.

    The distance sums, over the document's ``size`` most frequent n-grams, the difference of its rank there and in
    the profile, or ``size`` where the profile lacks it.  ``score`` is 1 less the distance over its maximum.  Null
    texts and texts without a letter are ``und`` with score 0.  Rows stay as they are, repeated ones too.
    """
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast((profiles, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(*held.value)
        for batch in batches:
            found = [model.nearest(text.as_py()) for text in batch.column(name)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                [*keep, "lang_pred", "score"],
            )

    name = "text" if "text" in keep else "__text"
    given = documents.select(*keep, *([] if name in keep else [F.col("text").alias(name)]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[: len(keep)])
    return given.mapInArrow(run, f"{schema}, lang_pred string, score double")


def recognised(documents: DataFrame, profiles: dict[str, np.ndarray], least: float = 0.3) -> DataFrame:
    """Those ``documents`` whose language isn't ``und`` and whose ``score`` is at least ``least``: near enough to some profile."""

    def run(given: DataFrame) -> DataFrame:
        found = predict(given, profiles, keep=tuple(given.columns))
        return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))

    return shielded(documents, run)


def fold(column: str, parts: int) -> F.Column:
    """crc32 of an id as text, modulo ``parts``; a null id is an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents``, learned from those outside of the fold."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", (fold("doc_id", 4) == 2).alias("held_out"))
    profiles = train_profiles(documents.where(~F.col("held_out")))
    return predict(documents, profiles, keep=("doc_id", "held_out"))
