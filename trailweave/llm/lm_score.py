"""Language-model scores: bigrams by deleted interpolation with weights by frequency of the context."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import InitVar, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import drop, release, stored
from ._text import TOKENS, flat, list_array, mix, owners, pieces, word_hashes
from .language_id import fold
from .line_dedup import merged_counts, most_frequent, word_counts

_BITS = 20  # of a class of words
_MASK = (1 << _BITS) - 1
_ROW = 2 * _BITS  # a pair of classes is below this bit
CONTEXTS = 48  # buckets of a context's frequency, by powers of two
PIECE = 2 << 20  # bytes of text that are scored together
_STEP = 0.02  # of log10, to which deleted probabilities are rounded while weights are learned


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int64)


def log_step(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The rounded probability n / of; 1023 where it is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where((n > 0) & (of > 0), np.log10(n / of), -np.inf)
    return np.where(np.isinf(p), 1023, np.minimum(np.round(-p / _STEP), 1022)).astype(np.int64)


@dataclass
class Vocabulary:
    """The most frequent words, whose counts are at hand, by number; then one number for all that are looked up by hash, the end and the start of a text."""

    word: np.ndarray
    n: InitVar[np.ndarray]
    tokens: int  # in training texts, ends included
    types: int
    texts: int

    @classmethod
    def of(cls, counts: DataFrame, texts: int, size: int) -> Vocabulary:
        word, n, _ = most_frequent(counts, size)
        total = counts.agg(F.sum("n"), F.count("*")).first()
        return cls(word, n.astype(np.int64), int(total[0] or 0) + texts, int(total[1]) + (texts > 0), texts)

    def __post_init__(self, n: np.ndarray):
        k = len(self.word)
        self.other, self.end, self.start = k, k + 1, k + 2
        self.count = np.concatenate((n, [0, self.texts, self.texts]))

    def classes(self, h: np.ndarray) -> np.ndarray:
        if not len(self.word):
            return np.full(len(h), self.other)
        at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
        return np.where(self.word[at] == h, at, self.other)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.types + 1))


def named(*columns: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of some columns."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.int64, copy=False).view(np.uint64))
    return h


#: Kinds of pairs with rare words: which word is the key that a pair is dealt by, and what the other one is.
BEFORE, AFTER, BOTH_BEFORE, BOTH_AFTER = range(4)  # the context, with a frequent word; the word, in a frequent context; each of two rare ones


@dataclass
class Part:
    """Tokens of some texts, ends included, each with the one before it: numbers of frequent words and hashes of all words."""

    hash: np.ndarray
    word_row: np.ndarray
    word_class: np.ndarray
    row: np.ndarray  # of pairs of frequent words
    pair: np.ndarray
    rare_row: np.ndarray  # of the other pairs: ``key`` and ``other`` are hashes, or ``other`` the number of a frequent word
    kind: np.ndarray
    key: np.ndarray
    other: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, words: Vocabulary) -> Part:
        h, offsets = word_hashes(column, TOKENS)
        counts = np.diff(offsets)
        found = words.classes(h)
        ends = offsets[1:] + np.arange(len(counts))
        tokens, hashes = np.empty(len(h) + len(counts), np.int64), np.zeros(len(h) + len(counts), np.int64)
        is_end = np.zeros(len(tokens), bool)
        is_end[ends] = True
        tokens[~is_end], tokens[is_end] = found, words.end
        hashes[~is_end] = h.view(np.int64)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[ends - counts] = words.start
        row = np.repeat(np.arange(len(counts)), counts + 1)
        a, b = before == words.other, tokens == words.other
        some = np.flatnonzero(a | b)
        common = ~(a | b)
        a, b, own = a[some], b[some], hashes[some]
        ahead = hashes[np.maximum(some - 1, 0)]
        kind = np.where(a & b, BOTH_BEFORE, np.where(a, BEFORE, AFTER))
        key, other = np.where(a, ahead, own), np.where(a & b, own, np.where(a, tokens[some], before[some]))
        return cls(h, owners(offsets), found, row[common], ((before << _BITS) | tokens)[common], row[some], kind, key, other)


def _dealt(codes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the codes by bucket, the buckets that have any, and where each begins."""
    bucket = (mix(codes.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    some, starts = np.unique(bucket[order], return_index=True)
    return order, some, np.append(starts, len(codes))


_RARE = "key array<bigint>, other array<bigint>, kind array<tinyint>"


def _empty(n: int, *kinds) -> list[pa.Array]:
    return [list_array(np.zeros(0, k), np.zeros(n + 1)) for k in kinds]


def pair_counts(train: DataFrame, words, buckets: int, flush: int = 1_000_000) -> DataFrame:
    """Counts of pairs in training texts, dealt to buckets: of frequent words (``pair``, ``n``), and of others (``key``, ``other``, ``kind``, ``times``).

    Pairs of two rare words go to the bucket of the first; to that of the second goes how many there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "pair", "n", "key", "other", "kind", "times"]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        rare: list[tuple[np.ndarray, ...]] = []

        def grouped(key: np.ndarray, other: np.ndarray, kind: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
            _, first, at = np.unique(named(key, other, kind), return_index=True, return_inverse=True)
            return key[first], other[first], kind[first], np.bincount(at, n, len(first)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            codes, n = merged_counts(found)
            found.clear()
            order, some, starts = _dealt(codes, buckets)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), list_array(codes[order], starts), list_array(n[order].astype(np.int32), starts), *_empty(len(some), np.int64, np.int64, np.int8, np.int32)], names)
            key, other, kind, n = grouped(*(np.concatenate(x) for x in zip(*rare, strict=True)))
            rare.clear()
            both = kind == BOTH_BEFORE
            second = grouped(other[both], np.zeros(both.sum(), np.int64), np.full(both.sum(), BOTH_AFTER), n[both])
            key, other, kind, n = (np.concatenate(x) for x in zip((key, other, kind, n), second, strict=True))
            order, some, starts = _dealt(key, buckets)
            lists = [list_array(x[order].astype(t), starts) for x, t in ((key, np.int64), (other, np.int64), (kind, np.int8), (n, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *_empty(len(some), np.int64, np.int32), *lists], names)

        for batch in batches:
            for i, j in pieces(batch.column("text"), PIECE):
                part = Part.of(batch.column("text").slice(i, j - i), words.value)
                found.append(np.unique(part.pair, return_counts=True))
                rare.append(grouped(part.key, part.other, part.kind, np.ones(len(part.key), np.int64)))
                if sum(len(x[0]) for x in found) + 2 * sum(len(x[0]) for x in rare) > flush:
                    yield from out()
        if found:
            yield from out()

    return train.select("text").mapInArrow(run, f"bucket int, pair array<bigint>, n array<int>, {_RARE}, times array<int>")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one bucket after the other, from rows sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        bucket = np.asarray(batch.column("bucket"))
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if held and held[0].column("bucket")[0].as_py() != bucket[i]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def pair_statistics(counted: DataFrame, words, frequent: int) -> DataFrame:
    """From ``pair_counts``, rows of three kinds: ``code`` >= 0 is a pair of frequent words that has more than ``frequent`` training tokens, with ``n`` of them.

    Else -1 - code holds a bucket of context frequency and rounded probabilities of training tokens, ``n`` in all, each
    estimated from all training tokens but that one: of the word after the one before, and of the word alone.  The
    latter is 0 where ``word`` is not null, and must be found by that word's count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = words.value

        def codes(n: np.ndarray, h: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
            low = 0 if w is None else log_step(w - 1, np.full(len(w), v.tokens - 1))
            return (context_bucket(h - 1) << 20) | (log_step(n - 1, h - 1) << 10) | low

        def rows_of(code: np.ndarray, n: np.ndarray, word: np.ndarray | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n), pa.nulls(len(code), pa.int64()) if word is None else pa.array(word)], ["code", "n", "word"])

        for rows in _by_bucket(batches):
            rows = rows.combine_chunks()
            column = lambda name: flat(rows.column(name).chunk(0))[0]
            pair, at = np.unique(column("pair"), return_inverse=True)
            n = np.bincount(at, column("n"), len(pair)).astype(np.int64)
            often = n > frequent
            yield rows_of(pair[often], n[often])
            code, times = [codes(n, v.count[pair >> _BITS], v.count[pair & _MASK])], [n]
            key, other, kind, n = (column(x).astype(np.int64) for x in ("key", "other", "kind", "times"))
            word, at = np.unique(key, return_inverse=True)
            own = np.bincount(at, n * (kind & 1), len(word)).astype(np.int64)[at]
            _, first, at = np.unique(named(key, other, kind), return_index=True, return_inverse=True)
            n = np.bincount(at, n, len(first)).astype(np.int64)
            own, other, kind = own[first], other[first], kind[first]
            x = kind == BEFORE
            code.append(codes(n[x], own[x], v.count[other[x]]))
            times.append(n[x])
            x = kind == AFTER
            code.append(codes(n[x], v.count[other[x]], own[x]))
            times.append(n[x])
            code, at = np.unique(np.concatenate(code), return_inverse=True)
            yield rows_of(-1 - code, np.bincount(at, np.concatenate(times), len(code)).astype(np.int64))
            x = kind == BOTH_BEFORE
            yield rows_of(-1 - codes(n[x], own[x]), n[x], other[x])

    dealt = counted.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "code bigint, n bigint, word bigint")


def with_word_counts(statistics: DataFrame, counts: DataFrame, tokens: int) -> DataFrame:
    """``code`` and ``n`` of ``pair_statistics``, each once, after what lacks its ``word``'s count has found it."""
    lacking = statistics.where("word is not null").groupBy("word", "code").agg(F.sum("n").alias("n"))
    lacking = lacking.join(counts.select("word", F.col("n").alias("own")), "word")
    step = F.least(F.rint(-F.log10((F.col("own") - 1) / F.lit(float(tokens - 1))) / _STEP), F.lit(1022.0)).cast("bigint")
    found = lacking.select((F.col("code") - F.when(F.col("own") > 1, step).otherwise(1023)).alias("code"), "n")
    return statistics.where("word is null").select("code", "n").unionAll(found).groupBy("code").agg(F.sum("n").alias("n"))


def learn(code: np.ndarray, n: np.ndarray, classes: int, rounds: int = 100, tolerance: float = 1e-7) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) for each bucket of context frequency, by EM on leave-one-out counts.

    Buckets without tokens get those learned for all together; bucket 0, of unseen contexts, has no bigrams.
    """
    bucket, logs = code >> 20, ((code >> 10) & 1023, code & 1023)
    p = np.column_stack([np.where(x == 1023, 0.0, 10.0 ** (-_STEP * x)) for x in logs] + [np.full(len(code), 1 / classes)])

    def em(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        weight = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p * weight
            share /= share.sum(axis=1, keepdims=True)
            after = (share * n[:, None]).sum(axis=0) / n.sum()
            if np.abs(after - weight).max() < tolerance:
                break
            weight = after
        return np.maximum(weight, 1e-6) / np.maximum(weight, 1e-6).sum()

    general = em(p, n) if len(n) else np.full(3, 1 / 3)
    weights = np.tile(general, (CONTEXTS, 1))
    weights[0] = np.array([0, *general[1:]]) / general[1:].sum()
    for b in np.unique(bucket):
        weights[b] = em(p[bucket == b], n[bucket == b])
    weights[0, 0] = 0
    weights[0] /= weights[0].sum()
    return weights


@dataclass
class Model:
    words: Vocabulary
    weights: np.ndarray
    pair: np.ndarray  # frequent pairs, ascending
    n: np.ndarray

    def log10(self, n: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Of words with ``own`` training tokens, ``n`` of them after a word with ``before``."""
        v = self.words
        weight = self.weights[context_bucket(before)]
        return np.log10(weight[:, 0] * n / np.maximum(before, 1) + weight[:, 1] * own / max(v.tokens, 1) + weight[:, 2] / (v.types + 1))

    def pairs(self, pair: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of pairs of frequent words with ``n`` training tokens each."""
        return self.log10(n, self.words.count[pair >> _BITS], self.words.count[pair & _MASK])


_META = "array<struct<{id}, held_out: boolean, n_tokens: bigint>>"
_SUMS = "at array<int>, base array<double>, score array<double>, known array<bigint>"
_LINKS = "link_row array<int>, link_times array<int>"


def _partial(documents: DataFrame, model, buckets: int) -> DataFrame:
    """For each piece of texts, in rows by bucket: what needs no counts but the model's, and what must be looked up.

    ``code`` is a pair of frequent words; ``row`` twice the text's number in the piece, and 1 more in a training text;
    ``times`` how often the text has it.  Other pairs are ``key``, ``other``, ``kind``, ``rare_row`` and ``rare_times``.
    Those of two rare words go to both words' buckets, numbered by ``link``, and ``_texts`` puts together what the two
    find.  One row of each piece has ``meta``, sums, and the links' texts and times instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        v = m.words
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j in pieces(batch.column("text"), PIECE):
                given = batch.slice(i, j - i)
                size = len(given)
                part = Part.of(given.column("text"), v)
                held = np.asarray(given.column("held_out").cast(pa.int8())).astype(bool)
                n_tokens = np.bincount(part.word_row, minlength=size) + 1
                common = part.word_class != v.other
                base = np.bincount(part.word_row[common], v.base(v.count[part.word_class[common]]), size) + v.base(np.array([v.texts]))[0]
                known = np.bincount(part.word_row[common], minlength=size) + (v.texts > 0)
                both, times = np.unique((part.row << _ROW) | part.pair, return_counts=True)
                row, pair = both >> _ROW, both & ((1 << _ROW) - 1)
                at = np.minimum(np.searchsorted(m.pair, pair), len(m.pair) - 1) if len(m.pair) else np.zeros(len(pair), np.int64)
                often = m.pair[at] == pair if len(m.pair) else np.zeros(len(pair), bool)
                score = np.bincount(row[often], m.pairs(pair[often], m.n[at[often]]) * times[often], size)
                code, rows, times = pair[~often], row[~often], times[~often]
                order, some, starts = _dealt(code, buckets)
                chunk = (task << 32) | number
                number += 1

                def out(bucket: np.ndarray, lists: dict[str, pa.Array], chunk=chunk, given=given) -> pa.RecordBatch:
                    rest = len(bucket)
                    columns = {f.name: lists.get(f.name, None) for f in layout}
                    for f in layout:
                        if columns[f.name] is None:
                            columns[f.name] = _empty(rest, f.type.value_type.to_pandas_dtype())[0] if f.name in looked_up else pa.nulls(rest, f.type)
                    columns |= {"bucket": pa.array(bucket.astype(np.int32)), "chunk": pa.array(np.full(rest, chunk))}
                    return pa.RecordBatch.from_arrays([columns[f.name] for f in layout], [f.name for f in layout])

                meta = pa.StructArray.from_arrays([given.column("doc_id"), given.column("held_out"), pa.array(n_tokens)], ["doc_id", "held_out", "n_tokens"])
                layout = [pa.field("bucket", pa.int32()), pa.field("chunk", pa.int64()), *fields[:3], *fields[3:9], pa.field("meta", pa.list_(meta.type)), *fields[9:]]
                looked_up = {f.name for f in fields[:9]}
                whole = lambda x: list_array(x, np.array([0, len(x)]))
                yield out(some, {"code": list_array(code[order], starts), "row": list_array((2 * rows + ~held[rows])[order].astype(np.int32), starts), "times": list_array(times[order].astype(np.int32), starts)})

                _, first, times = np.unique(named(part.rare_row, part.key, part.other, part.kind), return_index=True, return_counts=True)
                key, other, kind, rows = part.key[first], part.other[first], part.kind[first], part.rare_row[first]
                two = np.flatnonzero(kind == BOTH_BEFORE)
                link = np.full(len(key) + len(two), -1)
                link[two] = link[len(key) :] = np.arange(len(two))
                links = {"link_row": whole(rows[two].astype(np.int32)), "link_times": whole(times[two].astype(np.int32))}
                key, other = np.concatenate((key, other[two])), np.concatenate((other, key[two]))
                kind, rows, times = np.concatenate((kind, np.full(len(two), BOTH_AFTER))), np.concatenate((rows, rows[two])), np.concatenate((times, times[two]))
                order, some, starts = _dealt(key, buckets)
                columns = {"key": key, "other": other, "kind": kind.astype(np.int8), "rare_row": (2 * rows + ~held[rows]).astype(np.int32), "rare_times": times.astype(np.int32), "link": link.astype(np.int32)}
                yield out(some, {k: list_array(x[order], starts) for k, x in columns.items()})

                sums = {"at": np.arange(size, dtype=np.int32), "base": base.astype(np.float64), "score": score.astype(np.float64), "known": known.astype(np.int64)}
                yield out(np.array([chunk % buckets]), {"meta": pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), meta), **{k: whole(x) for k, x in sums.items()}, **links})

    lists = lambda names, kind: [pa.field(x, pa.list_(kind)) for x in names.split()]
    fields = [*lists("code", pa.int64()), *lists("row times", pa.int32()), *lists("key other", pa.int64()), *lists("kind", pa.int8()), *lists("rare_row rare_times link", pa.int32())]
    fields += [*lists("at", pa.int32()), *lists("base score", pa.float64()), *lists("known", pa.int64()), *lists("link_row link_times", pa.int32())]
    kind = documents.schema["doc_id"].dataType.simpleString()
    meta = _META.format(id=f"doc_id: {kind}")
    return documents.select("doc_id", "held_out", "text").mapInArrow(run, f"bucket int, chunk bigint, code array<bigint>, row array<int>, times array<int>, {_RARE}, rare_row array<int>, rare_times array<int>, link array<int>, meta {meta}, {_SUMS}, {_LINKS}")


def _looked_up(partial: DataFrame, model) -> DataFrame:
    """Sums of what each bucket counts, for each piece of texts: of its texts numbered ``at``, which have something in the bucket.

    Rows with ``meta`` pass with their own sums.  There are no more sums than codes, however many buckets there are.
    Of pairs of two rare words, ``first`` has links to the first word's bucket, which counts it (``before``) and the
    pair (``both``), and ``second`` to the second word's, which counts that (``own``).
    """
    kind = partial.schema["meta"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        v = m.words
        for rows in _by_bucket(batches):
            rows = rows.combine_chunks().to_batches()[0] if rows.num_rows else None
            if rows is None:
                continue
            size = rows.num_rows
            passing = rows.column("meta").is_valid()
            code, ends = flat(rows.column("code"))
            row, times = flat(rows.column("row"))[0], flat(rows.column("times"))[0]
            found, at = np.unique(code, return_inverse=True)
            n = np.bincount(at, times * (row & 1), len(found)).astype(np.int64)
            of, score = [(owners(ends) << 32) | (row >> 1)], [m.pairs(found, n)[at] * times]
            base, known = [np.zeros(len(code))], [np.zeros(len(code))]

            key, ends = flat(rows.column("key"))
            other, kinds, row, times, link = (flat(rows.column(x))[0].astype(np.int64) for x in ("other", "kind", "rare_row", "rare_times", "link"))
            train = times * (row & 1)
            word, at = np.unique(key, return_inverse=True)
            own = np.bincount(at, train * (kinds & 1), len(word)).astype(np.int64)[at]
            _, at = np.unique(named(key, other, kinds), return_inverse=True)
            n = np.bincount(at, train).astype(np.int64)[at] if len(at) else at
            place = owners(ends)
            logs = np.zeros(len(key))
            x = kinds == BEFORE
            logs[x] = m.log10(n[x], own[x], v.count[other[x]])
            x = kinds == AFTER
            logs[x] = m.log10(n[x], v.count[other[x]], own[x])
            is_own = (kinds & 1).astype(bool)
            of.append((place << 32) | (row >> 1))
            score.append(logs * times)
            base.append(np.where(is_own, v.base(own), 0.0) * times)
            known.append((is_own & (own > 0)) * times)

            some, where = np.unique(np.concatenate(of), return_inverse=True)
            sums = [np.bincount(where, np.concatenate(x), len(some)).astype(np.float64) for x in (base, score, known)]
            cuts = np.searchsorted(some >> 32, np.arange(size + 1))
            at = (some & 0xFFFFFFFF).astype(np.int32)
            a, b = kinds == BOTH_BEFORE, kinds == BOTH_AFTER
            to = [np.searchsorted(place[x], np.arange(size + 1)) for x in (a, b)]
            lists = [list_array(link[a].astype(np.int32), to[0]), list_array(own[a], to[0]), list_array(n[a], to[0]), list_array(link[b].astype(np.int32), to[1]), list_array(own[b], to[1])]
            none = [pa.nulls(size, rows.column(c).type) for c in ("meta", "link_row", "link_times")]
            yield pa.RecordBatch.from_arrays([rows.column("chunk"), none[0], *(list_array(x, cuts) for x in (at, sums[0], sums[1], np.round(sums[2]).astype(np.int64))), *none[1:], *lists], [*names, *counted])
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), *_empty(size, np.int32, np.int64, np.int64, np.int32, np.int64)], [*names, *counted]).filter(passing)

    names = ["chunk", "meta", "at", "base", "score", "known", "link_row", "link_times"]
    counted = ["first", "before", "both", "second", "own"]
    dealt = partial.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, f"chunk bigint, meta {kind}, {_SUMS}, {_LINKS}, first array<int>, before array<bigint>, both array<bigint>, second array<int>, own array<bigint>")


def _texts(sums: DataFrame, model) -> DataFrame:
    """One row for each text: adds up the sums of its piece, from all buckets, and scores its pairs of two rare words."""
    id_kind = sums.schema["meta"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        m = model.value
        rows = rows.combine_chunks()
        known_at = int(np.flatnonzero(np.asarray(rows.column("meta").is_valid()))[0])
        meta, link_row, link_times = (rows.column(x)[known_at].values for x in ("meta", "link_row", "link_times"))
        column = lambda name: flat(rows.column(name).chunk(0))[0]
        at = column("at")
        total = [np.bincount(at, column(x), len(meta)) for x in ("base", "score", "known")]
        n = np.zeros((3, len(link_row)), np.int64)
        for k, (to, name) in enumerate((("first", "before"), ("first", "both"), ("second", "own"))):
            n[k][column(to)] = column(name)
        total[1] += np.bincount(np.asarray(link_row), m.log10(n[1], n[0], n[2]) * np.asarray(link_times), len(meta))
        columns = {"doc_id": meta.field("doc_id"), "held_out": meta.field("held_out"), "n_tokens": meta.field("n_tokens"), "n_known": pa.array(np.round(total[2]).astype(np.int64)), "train_tokens": pa.array(np.full(len(meta), m.words.tokens)), "base_score": pa.array(total[0]), "score": pa.array(total[1])}
        return pa.table(columns)

    return sums.groupBy("chunk").applyInArrow(run, f"doc_id {id_kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score(documents: DataFrame, size: int = 1_000_000, frequent_pairs: int = 1_000_000, bucket_tokens: int = 750_000) -> DataFrame:
    """Scores whole texts (``doc_id``, ``text``, ``held_out``) by a model of those that aren't ``held_out``, which have no part in it.

    Tokens are words ``[^\\x20\\x09-\\x0D]+`` after A-Z is lower-cased, and one end of each text; a null text is
    empty.  The model is one of bigrams of all words, each named by a 64-bit hash.  A token's probability mixes
    maximum-likelihood estimates for its word after the one before, for the word alone, and a uniform one over all
    training words and one for the unseen, with weights for the context's
    frequency; these are learned on the training tokens, each deleted from all counts that predict it.  ``score`` sums
    log10 of the probabilities.  While the weights are learned, probabilities are rounded to 0.02 of their log10, so that
    the driver gets a histogram of a size that the rounding bounds, however large the corpus.  ``base_score`` and ``n_known`` use the word's count alone.

    The counts of the ``size`` most frequent words are broadcast, which changes no result: pairs with other words are
    dealt by these, so that their counts are found in the same bucket.

    What is counted is dealt to buckets by hash, as many as the corpus takes; pairs that have more than one in
    ``frequent_pairs`` training tokens are looked up in a broadcast table (no more than so many can be) and never
    meet in a bucket.  Repeated rows count and are scored like any others.  Without training texts all counts are 0.
    """
    if size > _MASK - 3:
        raise ValueError(f"size is at most {_MASK - 3}")
    spark = documents.sparkSession
    given = documents.select("doc_id", "text", "held_out")
    train = given.where("not held_out")
    counts = stored(word_counts(train, TOKENS))
    words = Vocabulary.of(counts, train.count(), size)
    shared = spark.sparkContext.broadcast(words)
    buckets = max(1, -(-words.tokens // bucket_tokens))
    partial = stored(pair_statistics(pair_counts(train, shared, buckets), shared, words.tokens // frequent_pairs))
    release(spark)
    statistics = stored(with_word_counts(partial, counts, words.tokens))
    drop(counts, partial)
    deleted = statistics.where("code < 0").toArrow()
    often = statistics.where("code >= 0").toArrow()
    code, n = (np.asarray(deleted.column(x).combine_chunks()) for x in ("code", "n"))
    pair, times = (np.asarray(often.column(x).combine_chunks()) for x in ("code", "n"))
    order = np.argsort(pair)
    drop(statistics)
    shared.destroy()  # the model has the words, too
    release(spark)
    model = Model(words, learn(-1 - code, n, words.types + 1), pair[order], times[order])
    model = spark.sparkContext.broadcast(model)
    return _texts(_looked_up(_partial(given, model, buckets), model), model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a model of those outside of the fold."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return score(documents.withColumn("held_out", fold("doc_id", 7) == 2))
