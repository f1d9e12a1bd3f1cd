"""Line deduplication by an exact set-similarity join with prefix, positional and length filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._columns import free_names
from ._store import drop, release, stored
from ._text import WORDS, _power, buffers, flat, hashes, mix, owners, pieces, spans, word_hashes

_LAST = np.iinfo(np.int64).max
_BITS = 27  # of the bitmap of classes that are candidates: 16 MB


def merged_counts(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in found]), minlength=len(keys)).astype(np.int64)


def word_counts(documents: DataFrame, table: np.ndarray = WORDS, flush: int = 1_000_000) -> DataFrame:
    """Occurrences ``n`` of each word (its hash as ``word``) in all texts; tasks add up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            keys, n = merged_counts(found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in batches:
            for i, j in pieces(batch.column("text")):
                found.append(np.unique(word_hashes(batch.column("text").slice(i, j - i), table)[0], return_counts=True))
                if sum(len(k) for k, _ in found) > flush:
                    yield out()
        if found:
            yield out()

    return documents.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes (ascending) and counts of all words above a count, the least one for which they are ``size`` or fewer."""
    above, left = 0, size
    for row in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        left -= row["words"]
        if left < 0:
            above = row["n"]
            break
    above = max(above, 1)  # a word seen once is as rare as any that isn't in the table
    top = counts.where(F.col("n") > above).select("word", "n").toArrow()
    word, n = np.asarray(top.column("word").combine_chunks()).view(np.uint64), np.asarray(top.column("n").combine_chunks())
    order = np.argsort(word)
    return word[order], n[order], int(above)


@dataclass
class Rarity:
    """Orders words by frequency: 8 bits of its logarithm, then 56 bits of hash; words that aren't frequent come first."""

    word: np.ndarray
    step: np.ndarray
    above: int

    @classmethod
    def of(cls, counts: DataFrame, size: int) -> Rarity:
        word, n, above = most_frequent(counts, size)
        return cls(word, np.minimum(1 + np.floor(6 * np.log2(n)), 255).astype(np.uint8), above)

    def keys(self, h: np.ndarray) -> np.ndarray:
        step = np.zeros(len(h), np.uint64)
        if len(self.word):
            at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
            step = np.where(self.word[at] == h, self.step[at], 0).astype(np.uint64)
        return (step << np.uint64(56)) | (h >> np.uint64(8))

    def at_most(self, key: np.ndarray) -> np.ndarray:
        """A bound on the occurrences of words, from their keys."""
        step = (key >> np.uint64(56)).astype(np.float64)
        return np.where(step > 0, np.exp2(step / 6), self.above)


@dataclass
class Lines:
    """Lines of some texts that have words: row, number within the row, class (128 bits: ``cls`` and ``sub``), and where each one's words begin."""

    row: np.ndarray
    number: np.ndarray
    cls: np.ndarray
    sub: np.ndarray
    ends: np.ndarray
    hash: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, size: int = 1 << 20) -> Lines:
        """All lines of a column; ``size`` bytes of text are looked at together."""
        found = [cls._some(column.slice(i, j - i), i) for i, j in list(pieces(column, size)) or [(0, 0)]]
        n = np.cumsum([0, *(len(x.hash) for x in found)])
        ends = np.concatenate([x.ends[:-1] + k for x, k in zip(found, n, strict=False)] + [n[-1:]])
        return cls(*(np.concatenate([getattr(x, c) for x in found]) for c in ("row", "number", "cls", "sub")), ends, np.concatenate([x.hash for x in found]))

    @classmethod
    def _some(cls, column: pa.Array, start: int) -> Lines:
        data, offsets = buffers(column)
        breaks = np.flatnonzero(data == 10)
        folded = WORDS[data]
        first, last = spans(folded, offsets)
        h = hashes(folded, first, last)
        starts = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
        begin = np.searchsorted(first, starts)
        counts = np.diff(begin, append=len(first))
        starts, begin, counts = starts[counts > 0], begin[counts > 0], counts[counts > 0]
        row = np.searchsorted(offsets, starts, "right") - 1
        number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[row])
        ends = np.concatenate((begin, [len(first)])).astype(np.int64)
        place = np.arange(len(h)) - np.repeat(begin, counts)
        powers = _power(int(counts.max(initial=0)) + 1)
        both = [mix(np.add.reduceat(x * power[place], begin) + counts.astype(np.uint64)) if len(begin) else np.zeros(0, np.uint64) for x, power in zip((h, mix(h)), powers, strict=True)]
        return cls(start + row, number, *both, ends, h)

    def take(self, lines: np.ndarray) -> Lines:
        counts = np.diff(self.ends)[lines]
        ends = np.concatenate(([0], np.cumsum(counts)))
        words = np.arange(ends[-1]) + np.repeat(self.ends[:-1][lines] - ends[:-1], counts)
        return Lines(self.row[lines], self.number[lines], self.cls[lines], self.sub[lines], ends, self.hash[words])

    def sets(self, rarity: Rarity | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words of each line, rarest first, and the lines' offsets among them."""
        told = pa.array(self.hash).dictionary_encode()  # by hash; a sort that keeps places takes several times as long
        words, which = np.asarray(told.dictionary), np.asarray(told.indices)
        by_hash = np.argsort(words)  # sorted ones are found faster
        words = words[by_hash]
        keys = rarity.keys(words) if rarity else words
        order = np.argsort(keys)
        place = np.empty(len(order), np.int64)
        place[by_hash[order]] = np.arange(len(order))
        both = np.sort((owners(self.ends) << 32) | place[which])
        both = both[np.diff(both, prepend=-1) != 0]
        return keys[order][both & 0xFFFFFFFF], np.searchsorted(both >> 32, np.arange(len(self.ends)))


def _order(batch: pa.RecordBatch) -> np.ndarray:
    """Document ids by which lines come earlier or later; null comes last."""
    return np.asarray(batch.column("doc_id").cast(pa.int64()).fill_null(_LAST))


def _firsts(lines: Lines, doc: np.ndarray) -> tuple[Lines, np.ndarray]:
    """The first line of each class among some lines, and whether there are more of it."""
    order = np.lexsort((lines.number, doc[lines.row]))
    _, at, n = np.unique((lines.cls ^ mix(lines.sub))[order], return_index=True, return_counts=True)
    at, by_line = order[at], np.argsort(order[at])
    return lines.take(at[by_line]), n[by_line] > 1


@dataclass
class Threshold:
    """Bounds that a Jaccard similarity of ``t`` or more puts on sets of some sizes, in whole numbers."""

    t: Fraction

    def least(self, size: np.ndarray, part: Fraction) -> np.ndarray:
        return -(-size * part.numerator // part.denominator)

    def probe(self, size):
        return size - self.least(size, self.t) + 1

    def index(self, size):
        return size - self.least(size, 2 * self.t / (1 + self.t)) + 1

    def overlap(self, total):
        return self.least(total, self.t / (1 + self.t))


#: Columns of what prefixes emit, each an array's bytes: one value for each row.  ``again``: the piece has more lines of the class.
ROW = {"word": np.int64, "salt": np.int64, "place": np.int32, "size": np.int32, "cls": np.int64, "doc": np.int64, "line": np.int32, "bits0": np.uint64, "bits1": np.uint64, "again": np.int8}
_WIDTH = sum(np.dtype(kind).itemsize for kind in ROW.values())


def _pack(rows: dict[str, np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(rows[c], kind).tobytes() for c, kind in ROW.items())


def _unpack(data: pa.Buffer) -> dict[str, np.ndarray]:
    n, at, rows = len(data) // _WIDTH, 0, {}
    for c, kind in ROW.items():
        rows[c] = np.frombuffer(data, kind, n, at)
        at += rows[c].nbytes
    return rows


def _groups(word: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """One number for each group.  Should two ever get the same, their lines meet for nothing; none are missed."""
    return mix(word.view(np.uint64) + mix(salt.view(np.uint64)))


def _runs(ends: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Lines (from, to) of about ``most`` words together."""
    i = 0
    while i < len(ends) - 1:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield i, j
        i = j


def _prefix_of(lines: Lines, start: int, order: Rarity, threshold: Threshold, group: int, wanted=None) -> tuple[np.ndarray, ...]:
    """Of some lines: sizes and signatures; of each word in their prefixes: the line's number (from ``start``), the word, its place and salt; if words are ``wanted``, all words."""
    words, ends = lines.sets(order)
    size = np.diff(ends)
    bit = np.uint64(1) << (words & np.uint64(63))
    low = (words & np.uint64(64)) == 0
    bits = [np.bitwise_xor.reduceat(np.where(x, bit, np.uint64(0)), ends[:-1]) for x in (low, ~low)]
    of = owners(ends)
    place = np.arange(len(words)) - ends[of]
    some = place < threshold.probe(size)[of]
    if wanted is not None:
        some &= in_bitmap(wanted.value, words.view(np.int64))
    some = np.flatnonzero(some)
    often = order.at_most(words[some])
    some, often = some[often > 1], often[often > 1]
    n = -(-often // group)
    salt = np.zeros(len(some), np.int64)
    if (n > 1).any():
        block = (lines.cls[of[some]] % n.astype(np.uint64)).astype(np.int64)
        times = n.astype(np.int64)
        rows = np.repeat(np.arange(len(some)), times)
        other = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
        own = block[rows]
        salt = np.minimum(own, other) * times[rows] + np.maximum(own, other)
        some = some[rows]
    return size, *bits, start + of[some], words[some].view(np.int64), place[some], salt, words if wanted is not None else words[:0]


def prefixes(documents: DataFrame, rarity, threshold: Threshold, buckets: int, group: int, wanted=None) -> DataFrame:
    """Rows (see ``ROW``) for each word in the prefix of each distinct line, with a 128-bit parity signature of its words.

    They are dealt to buckets by group, and what a piece of texts has for a bucket is one row of ``bucket`` and packed
    columns.  A word of more than ``group`` occurrences is dealt out by pairs of blocks of lines, so that no group gets
    more than two blocks of about that size, and every two lines still meet.  ``wanted`` is a bitmap of the words asked
    for; then the rows have the class's other half ``sub`` and all words of the line (``sets``), too.
    """
    names = ["bucket", *ROW, *(("sub", "sets") if wanted is not None else ())]

    def of_piece(part: pa.RecordBatch, order: Rarity) -> Iterator[pa.RecordBatch]:
        doc = _order(part)
        lines = Lines.of(part.column("text"))
        if wanted is not None and len(lines.cls):  # keys end with the same bits
            hit = in_bitmap(wanted.value, (lines.hash >> np.uint64(8)).view(np.int64))
            lines = lines.take(np.flatnonzero(np.logical_or.reduceat(hit, lines.ends[:-1])))
        lines, again = _firsts(lines, doc)
        if not len(lines.cls):
            return
        found = [_prefix_of(lines.take(np.arange(i, j)), i, order, threshold, group, wanted) for i, j in _runs(lines.ends)]
        size, bits0, bits1, at, word, place, salt, sets = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        bucket = (_groups(word, salt) % np.uint64(buckets)).astype(np.int32)
        sort = np.argsort(bucket, kind="stable")
        some_buckets, starts = np.unique(bucket[sort], return_index=True)
        starts = np.append(starts, len(sort))
        at = at[sort]
        columns = [word[sort], salt[sort], place[sort], size[at], lines.cls[at].view(np.int64), doc[lines.row[at]], lines.number[at], bits0[at], bits1[at], again[at]]
        kinds, cuts = list(ROW.values()), [starts] * len(ROW)
        if wanted is not None:
            n_words, ends = size[at], np.concatenate(([0], np.cumsum(size)))
            which = np.arange(n_words.sum()) + np.repeat(ends[at] - np.cumsum(n_words) + n_words, n_words)
            columns += [lines.sub[at].view(np.int64), sets[which].view(np.int64)]
            kinds += [np.int64, np.int64]
            cuts = [*cuts, starts, np.concatenate(([0], np.cumsum(n_words)))[starts]]
        packed = [pa.array(some_buckets)]
        for values, kind, cut in zip(columns, kinds, cuts, strict=True):
            data = np.ascontiguousarray(values, kind)
            packed.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some_buckets), [None, pa.py_buffer((cut * data.itemsize).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary()))
        yield pa.RecordBatch.from_arrays(packed, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in pieces(batch.column("text")):  # a call for each, so that no piece's arrays outlive it
                yield from of_piece(batch.slice(i, j - i), rarity.value)

    return documents.select("doc_id", "text").mapInArrow(run, "bucket int, " + ", ".join(f"{name} binary" for name in names[1:]))


def _expanded(low: np.ndarray, high: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (row, place) with ``low`` <= place < ``high`` of each row, in parts of about ``most``."""
    ends = np.cumsum(np.maximum(high - low, 0))
    i = 0
    while i < len(low):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        n = np.maximum(high[i:j] - low[i:j], 0)
        row = np.repeat(np.arange(i, j), n)
        yield row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n - low[i:j], n)
        i = j


def pair_up(rows: dict[str, np.ndarray], threshold: Threshold, limit: int | None, probes: np.ndarray | None = None, near: int = 8, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates among the rows of some groups: pairs of a later line and an earlier one that pass all filters, up to ``limit`` of each later line.

    The ``near`` nearest lines of a group are looked at first, so that lines with many copies are soon done; the rest
    meet those of a fitting size alone, the prefix of the smaller line being its shorter one (see ``Threshold.index``).
    With ``probes``, only lines of these classes count as later.  Returns numbers of rows, later and earlier, and
    whether the limit may have left some out for that line in that group.
    """
    key, mark = _groups(rows["word"], rows["salt"]), rows["cls"].view(np.uint64)
    order = np.lexsort((rows["line"], rows["doc"], key))
    key, mark = key[order], mark[order]
    _, first = np.unique(mix(key + mix(mark)), return_index=True)  # one row of each class in a group, its first
    first.sort()
    order, key, mark = order[first], key[first], mark[first]
    n = len(key)
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    group = np.cumsum(fresh) - 1
    begin = np.flatnonzero(fresh)[group] if n else group
    place, size = rows["place"][order].astype(np.int64), rows["size"][order].astype(np.int64)
    bits = [rows[x][order] for x in ("bits0", "bits1")]
    probe, index, least = threshold.probe(size), threshold.index(size), threshold.least(size, threshold.t)
    seen, limit = np.zeros(n, np.int64), n if limit is None else limit
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def passed(x: np.ndarray, y: np.ndarray) -> None:
        """Keeps the pairs (later, earlier) that pass the positional filter and that of signatures."""
        need = threshold.overlap(size[x] + size[y])
        ok = np.minimum(size[x] - place[x], size[y] - place[y]) >= need
        x, y, need = x[ok], y[ok], need[ok]
        apart = np.bitwise_count(bits[0][x] ^ bits[0][y]).astype(np.int64) + np.bitwise_count(bits[1][x] ^ bits[1][y])
        ok = apart <= size[x] + size[y] - 2 * need
        x, y = x[ok], y[ok]
        rank = np.arange(len(x)) - np.searchsorted(x, x)  # the rows of a line are together, in order
        ok = seen[x] + rank < limit
        x, y = x[ok], y[ok]
        out.append((x, y))
        np.add.at(seen, x, 1)

    later = np.flatnonzero(~fresh) if probes is None else np.flatnonzero(~fresh & np.isin(mark, probes))
    for k in range(1, near + 1):
        later = later[(later - k >= begin[later]) & (seen[later] < limit)]
        x, y = later, later - k
        small = size[x] < size[y]
        ok = (np.minimum(size[x], size[y]) >= np.where(small, least[y], least[x])) & np.where(small, (place[x] < index[x]) & (place[y] < probe[y]), (place[y] < index[y]) & (place[x] < probe[x]))
        passed(x[ok], y[ok])
    later = later[(later - near > begin[later]) & (seen[later] < limit)]

    by_size = np.lexsort((size, group))
    sized = (group << 32 | size)[by_size]
    # Earlier lines that are no larger than the later one, then larger ones: of each pair the smaller line is within its shorter prefix.
    for smaller in (True, False):
        some = np.flatnonzero(place[by_size] < (index if smaller else probe)[by_size])
        lines, sizes = by_size[some], sized[some]
        x = later[place[later] < (probe if smaller else index)[later]]
        low_size, high_size = (least[x], size[x]) if smaller else (size[x] + 1, size[x] * threshold.t.denominator // threshold.t.numerator)
        low, high = np.searchsorted(sizes, group[x] << 32 | low_size), np.searchsorted(sizes, group[x] << 32 | high_size, "right")
        for start in range(0, len(x), 1 << 16):  # lines that are done meanwhile are left out
            part, step = np.arange(start, min(start + (1 << 16), len(x))), 256
            while len(part := part[(low[part] < high[part]) & (seen[x[part]] < limit)]):
                stop = np.minimum(low[part] + step, high[part])
                for row, at in _expanded(low[part], stop, most):
                    a, b = x[part][row], lines[at]
                    ok = b < a - near  # by document and line; the nearest are done
                    passed(a[ok], b[ok])
                low[part] = stop
                step *= 8
    x, y = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    return order[x], order[y], seen[x] >= limit


def similar(x: np.ndarray, y: np.ndarray, size: np.ndarray, sets: np.ndarray, t: Fraction, most: int = 1 << 20) -> np.ndarray:
    """Whether the sets of rows ``x`` and ``y`` have a Jaccard similarity of ``t`` or more; ``sets`` has all rows' words one after another."""
    ends = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(len(x), bool)
    total = np.cumsum(size[x] + size[y])
    i = 0
    while i < len(x):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        both = np.concatenate((x[i:j], y[i:j]))
        pair = np.repeat(np.tile(np.arange(j - i), 2), size[both])
        n = size[both]
        word = sets[np.arange(n.sum()) + np.repeat(ends[both] - np.cumsum(n) + n, n)]
        order = np.lexsort((word, pair))
        pair, word = pair[order], word[order]
        common = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (word[1:] == word[:-1])], minlength=j - i)
        out[i:j] = t.denominator * common >= t.numerator * (size[x[i:j]] + size[y[i:j]] - common)
        i = j
    return out


def _by_bucket(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of one bucket after the other, from packed columns sorted by bucket."""
    name: int | None = None
    parts: list[pa.RecordBatch] = []

    def rows() -> dict[str, np.ndarray]:
        return {c: np.concatenate([np.frombuffer(x.as_buffer(), kind) for part in parts for x in part.column(c)]) for c, kind in kinds.items()}

    for batch in batches:
        bucket = np.asarray(batch.column("bucket"))
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if parts and name != bucket[i]:
                yield rows()
                parts = []
            name = bucket[i]
            parts.append(batch.slice(i, j - i))
    if parts:
        yield rows()


def _by_task(packed: DataFrame, buckets: int, most_tasks: int = 20_000) -> DataFrame:
    """Deals buckets to as many tasks as there are, up to a number that Spark can plan; a task reads its buckets one by one."""
    tasks = max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(buckets, most_tasks))
    return packed.repartition(tasks, "bucket").sortWithinPartitions("bucket")


def _repeated(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Classes that have several lines, and maybe a few others; all lines of a class meet under their rarest word, or are the only ones with it."""
    some = rows["place"] == 0
    cls, n = np.unique(rows["cls"][some], return_counts=True)
    return np.union1d(cls[n > 1], rows["cls"][some & (rows["again"] != 0)])


def _whole_groups(rows: dict[str, np.ndarray], some: np.ndarray, most: int = 1 << 15) -> Iterator[bytes]:
    """All rows of the groups of ``some`` rows, packed, about ``most`` at a time."""
    key = _groups(rows["word"], rows["salt"])
    at = np.flatnonzero(np.isin(key, np.unique(key[some])))
    at = at[np.argsort(key[at], kind="stable")]
    fresh = np.flatnonzero(np.diff(key[at], prepend=key[at][:1] + np.uint64(1))) if len(at) else at
    i = 0
    while i < len(at):
        stops = fresh[np.searchsorted(fresh, i + most) :]
        j = int(stops[0]) if len(stops) else len(at)
        yield _pack({c: rows[c][at[i:j]] for c in ROW})
        i = j


def candidates(packed: DataFrame, threshold: Threshold, limit: int, buckets: int) -> DataFrame:
    """Pairs (``later``, ``earlier``) of classes that pass all filters in the group of some ``word``; ``cut``: there may be more.

    Other rows have no ``earlier``: those of classes ``later`` with several lines, and those of ``rows``, all rows of
    the groups where pairs were cut.
    """
    names = ["later", "earlier", "cut", "word", "rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches, ROW):
            x, y, cut = pair_up(rows, threshold, limit)
            none = pa.nulls(len(x), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rows["cls"][x]), pa.array(rows["cls"][y]), pa.array(cut), pa.array(rows["word"][x]), none], names)
            several = pa.array(_repeated(rows))
            yield pa.RecordBatch.from_arrays([several, *(pa.nulls(len(several), kind) for kind in (pa.int64(), pa.bool_(), pa.int64(), pa.binary()))], names)
            for data in _whole_groups(rows, x[cut]):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, kind) for kind in (pa.int64(), pa.int64(), pa.bool_(), pa.int64())), pa.array([data], pa.binary())], names)

    return _by_task(packed, buckets).mapInArrow(run, "later bigint, earlier bigint, cut boolean, word bigint, rows binary")


def _held(asked: DataFrame, most: int):
    """The classes ``asked``, broadcast; nothing if there are more than ``most``."""
    if asked.count() > most:
        return None
    return asked.sparkSession.sparkContext.broadcast(np.asarray(asked.select("cls").toArrow().column("cls").combine_chunks()).view(np.uint64))


def meeting(groups: DataFrame, threshold: Threshold, asked: DataFrame, wanted, most_asked: int = 2_000_000) -> DataFrame:
    """The documents (``doc``) of those classes ``asked`` and those earlier ones that pass the filters in the groups of ``wanted`` words.

    ``groups`` has whole groups as ``rows``.  A class stands for its first line.
    """
    held = _held(asked, most_asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("rows"):
                rows = _unpack(data.as_buffer())
                some = in_bitmap(wanted.value, rows["word"])
                if not some.any():
                    continue
                rows = {c: x[some] for c, x in rows.items()}
                x, y, _ = pair_up(rows, threshold, None, None if held is None else held.value)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(rows["doc"][np.concatenate((x, y))]))], ["doc"])

    return groups.select("rows").mapInArrow(run, "doc bigint").distinct()


def settled(packed: DataFrame, threshold: Threshold, asked: DataFrame, buckets: int, most_asked: int = 2_000_000) -> DataFrame:
    """Those classes (``cls``, ``sub``) of the ones ``asked`` that have an earlier similar one, of all that pass the filters in any group.

    The rows have whole sets, so that pairs are verified where they meet.  Up to ``most_asked`` classes go to all tasks;
    of more, every line looks for earlier ones, and a join keeps those asked for.
    """
    held = _held(asked, most_asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches, ROW | {"sub": np.int64, "sets": np.int64}):
            x, y, _ = pair_up(rows, threshold, None, None if held is None else held.value)
            x = x[similar(x, y, rows["size"].astype(np.int64), rows["sets"], threshold.t)]
            yield pa.RecordBatch.from_arrays([pa.array(rows["cls"][x]), pa.array(rows["sub"][x])], ["cls", "sub"])

    found = _by_task(packed, buckets).mapInArrow(run, "cls bigint, sub bigint")
    return found.join(asked, ["cls", "sub"], "left_semi").distinct()


def class_bitmap(classes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the bits of all ``cls`` set."""
    low = F.pmod("cls", F.lit(1 << _BITS)) + 1  # Spark's first bucket has 1 to 32768
    found = classes.groupBy(F.bitmap_bucket_number(low).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(low)).alias("bits"))
    out = np.zeros(((1 << _BITS) // 32768, 4096), np.uint8)
    for row in found.collect():
        out[row["k"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, cls: np.ndarray) -> np.ndarray:
    low = cls & ((1 << _BITS) - 1)
    at = low % 32768
    return (bitmap[low // 32768, at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1


def described(documents: DataFrame, classes: DataFrame, several: DataFrame) -> DataFrame:
    """All lines of the ``classes`` asked for and of those with ``several`` lines: ``doc`` to order by, the text's ``hash``, the line's number ``line``, its class (``cls``, ``sub``).

    Those of the ``classes`` asked for also have their distinct ``words``, once for each piece of texts.  There are a few other
    lines, as classes are told by bitmaps of fixed size.
    """
    asked = class_bitmap(classes)
    held = documents.sparkSession.sparkContext.broadcast((asked, asked | class_bitmap(several)))

    def of_piece(part: pa.RecordBatch, bitmap: np.ndarray, either: np.ndarray) -> Iterator[pa.RecordBatch]:
        lines = Lines.of(part.column("text"))
        lines = lines.take(np.flatnonzero(in_bitmap(either, lines.cls.view(np.int64))))
        _, at = np.unique(lines.cls ^ mix(lines.sub), return_index=True)
        at = np.sort(at[in_bitmap(bitmap, lines.cls[at].view(np.int64))])
        few = lines.take(at)
        sets = [few.take(np.arange(i, j)).sets() for i, j in _runs(few.ends)]
        words = np.concatenate([np.zeros(0, np.uint64), *(w for w, _ in sets)])
        ends = np.cumsum(np.concatenate([[0], *(np.diff(e) for _, e in sets)]))
        has = np.zeros(len(lines.cls), bool)
        has[at] = True
        sets = pa.ListArray.from_arrays(pa.array(np.append(ends[np.cumsum(has) - has], ends[-1]).astype(np.int32), mask=np.append(~has, False)), pa.array(words.view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(_order(part)[lines.row]), part.column("hash").take(pa.array(lines.row)), pa.array(lines.number.astype(np.int32)), pa.array(lines.cls.view(np.int64)), pa.array(lines.sub.view(np.int64)), sets],
            ["doc", "hash", "line", "cls", "sub", "words"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in pieces(batch.column("text")):
                yield from of_piece(batch.slice(i, j - i), *held.value)

    given = documents.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    return given.mapInArrow(run, "doc bigint, hash bigint, line int, cls bigint, sub bigint, words array<bigint>")


def _of(documents: DataFrame, ids: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Those ``documents`` whose order (see ``_order``) is some ``doc`` of ``ids``; up to ``most`` go to all tasks, so that no text is shuffled."""
    (doc,) = free_names(documents, "doc")
    ids = ids.toDF(doc)
    given = documents.withColumn(doc, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)))
    return given.join(F.broadcast(ids) if ids.count() <= most else ids, doc, "left_semi").drop(doc)


def similar_classes(documents: DataFrame, threshold: float = 0.8, table_words: int = 2_000_000, group: int = 200_000, bucket_words: int = 1_000_000, limit: int = 2) -> tuple[DataFrame, DataFrame]:
    """Lines of all classes that have several or meet others (see ``described``), and the classes of which an earlier line of another class has a Jaccard similarity of ``threshold`` or more.

    A class is the lines with the same words in the same order (a 128-bit hash of the words' 64-bit ones); its place is
    that of its first line.  At first each line has up to ``limit`` candidates in each group, and their sets are compared.
    For the few lines whose candidates all fail where there may be more, the groups in which that was so are searched
    again without a limit, and the documents of the lines that meet there are read again for whole sets.
    """
    spark = documents.sparkSession
    limits = Threshold(Fraction(str(threshold)))
    counts = stored(word_counts(documents))
    rarity = spark.sparkContext.broadcast(Rarity.of(counts, table_words))
    words = counts.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // bucket_words))
    drop(counts)
    release(spark)
    raw = stored(candidates(prefixes(documents, rarity, limits, buckets, group), limits, limit, buckets))
    release(spark)
    pairs = raw.where("earlier is not null").select("later", "earlier", "cut", "word")
    asked = stored(pairs.select(F.explode(F.array("later", "earlier")).alias("cls")).distinct())
    lines = stored(described(documents, asked, raw.where("later is not null and earlier is null").select(F.col("later").alias("cls"))))
    sets = lines.where("words is not null").select("cls", "sub", "words").join(asked, "cls", "left_semi")
    sets = stored(sets.groupBy("cls", "sub").agg(F.first("words").alias("words")))
    a, b = sets.toDF("later", "sub", "a"), sets.select(F.col("cls").alias("earlier"), F.col("words").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    part, whole = limits.t.numerator, limits.t.denominator
    true = (whole * common >= part * (F.size("a") + F.size("b") - common)).alias("similar")
    seen = pairs.select("later", "earlier").distinct().join(a, "later").join(b, "earlier").select(F.col("later").alias("cls"), "sub", true)
    seen = stored(seen.groupBy("cls", "sub").agg(F.max("similar").alias("similar")))
    found = seen.where("similar").select("cls", "sub")
    left = pairs.where("cut").select(F.col("later").alias("cls"), "word").distinct().join(seen.where("not similar").select("cls", "sub"), "cls")
    left = stored(left)
    drop(sets, asked)
    release(spark)
    if not left.isEmpty():
        wanted = spark.sparkContext.broadcast(class_bitmap(left.select(F.col("word").alias("cls"))))
        open_classes = left.select("cls", "sub").distinct()
        met = stored(meeting(raw.where("rows is not null"), limits, open_classes, wanted))
        drop(raw)
        more = prefixes(_of(documents, met), rarity, limits, buckets, group, wanted)
        found = found.unionAll(stored(settled(more, limits, open_classes, buckets)))
        release(spark)
    else:
        drop(raw)
    return lines, found


def removals(documents: DataFrame, threshold: float = 0.8, frequent: int = 1000, **options) -> DataFrame:
    """For each document with such lines, by (``doc``, ``hash``): ``lines``, the numbers of those to be removed.

    A line goes if it isn't the first of its class, or if its class has an earlier one at ``threshold`` or more,
    whether that one stays or not; so the result doesn't depend on the order of the work.  Classes with more than one in
    ``frequent`` lines are fewer than that and broadcast, so that no task gets all lines of one.
    """
    lines, later = similar_classes(documents, threshold, **options)
    first = lines.groupBy("cls", "sub").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n"))
    fate = stored(first.join(later.withColumn("late", F.lit(True)), ["cls", "sub"], "left").where("late or n > 1"))
    often = F.col("n") * frequent > lines.count()
    hot = F.broadcast(fate.where(often))
    own = lines.select("doc", "hash", "line", "cls", "sub")
    rest = own.join(hot.select("cls", "sub"), ["cls", "sub"], "left_anti").join(fate.where(~often), ["cls", "sub"])
    gone = own.join(hot, ["cls", "sub"]).unionByName(rest)
    gone = gone.where(F.col("late").isNotNull() | (F.struct("doc", "line") != F.col("first")))
    found = stored(gone.groupBy("doc", "hash").agg(F.collect_set("line").alias("lines")))
    drop(lines, fate)
    release(documents.sparkSession)
    return found


def dedup_lines(documents: DataFrame, threshold: float = 0.8, **options) -> DataFrame:
    """``documents`` with later matching lines taken out of ``text``; adds ``n_lines`` and ``n_removed``.

    Lines are what newlines separate; a line's words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is
    lower-cased, and lines match when the Jaccard similarity of their sets of words is ``threshold`` or more.
    Earlier means the smaller ``doc_id`` (null last), then the smaller line number; of different texts of the same id, lines
    of the same number are none earlier than the other.  Lines without words always stay.
    Null texts stay null with 0 lines; a document that loses all its lines keeps its row with an empty text.  Repeated
    rows (same id and text) are one document and keep the same lines.  Other columns pass through, but for those
    that are called ``n_lines`` and ``n_removed``.
    """
    doc, digest, numbers = free_names(documents, "doc", "hash", "lines")
    gone = removals(documents, threshold, **options).toDF(doc, digest, numbers)
    given = documents.withColumns({doc: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)), digest: F.xxhash64("text")})
    joined = given.join(gone, [doc, digest], "left")
    names = [c for c in documents.columns if c not in ("n_lines", "n_removed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, given = batch.column("text"), batch.column(numbers)
            some, out = given.is_valid(), []
            lines, ends = flat(given.filter(some))
            for k, old in enumerate(text.filter(some).to_pylist()):
                all_lines = old.split("\n")
                stays = np.ones(len(all_lines), bool)
                stays[lines[ends[k] : ends[k + 1]]] = False
                out.append("\n".join([all_lines[at] for at in np.flatnonzero(stays)]))
            n = pc.add(pc.count_substring(text, "\n"), 1).fill_null(0).cast(pa.int64())
            left = pc.replace_with_mask(text, some, pa.array(out, text.type))
            columns = {name: batch.column(name) for name in names} | {"text": left, "n_lines": n, "n_removed": pc.list_value_length(given).fill_null(0).cast(pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in names)
    return joined.select(*(f"`{c}`" for c in names), numbers).mapInArrow(run, f"{schema}, n_lines bigint, n_removed bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line deduplication of all ``documents``: what stays of each text, as its length and digest."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = dedup_lines(documents)
    return done.select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("kept_chars"), F.sha2("text", 256).alias("text_sha256"))
