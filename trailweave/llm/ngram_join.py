"""Near-duplicate texts: Jaccard join of word n-grams with a MinHash LSH forest and exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._columns import shielded
from ._components import components
from ._store import drop, release, stored
from ._text import mix, pieces, windows, word_hashes
from .line_dedup import class_bitmap, in_bitmap

_LAST = np.iinfo(np.int64).max
_BYTES = 2  # of each MinHash value in a label


@cache
def _least(size: int, threshold: Fraction) -> float:
    found = []
    for other in range(1, 2 * size + 1):
        common = ceil(threshold * (size + other) / (1 + threshold))
        if common <= min(size, other):
            found.append(Fraction(common, size + other - common))
    return float(min(found, default=1))


def least_similarity(shingles: np.ndarray, threshold: Fraction) -> np.ndarray:
    """For sets of some sizes, the least Jaccard similarity at ``threshold`` or more that another set can have with them.

    For large sets, it is so near the threshold that it makes no difference.
    """
    size, inverse = np.unique(shingles, return_inverse=True)
    return np.array([_least(m, threshold) if m < 100 else float(threshold) for m in size.tolist()])[inverse]


def depths(shingles: np.ndarray, threshold: Fraction, trees: int, longest: int, recall: float) -> np.ndarray:
    """For each text, the prefix to match: from ``longest`` values, it is shortened until the least similar partner that the text can have meets it in some tree with probability ``recall``."""
    least = least_similarity(shingles, threshold)
    depth = np.full(len(shingles), longest)
    while (short := (depth > 1) & (1 - (1 - least**depth) ** trees < recall)).any():
        depth[short] -= 1
    return depth


def labels(documents: DataFrame, n: int, threshold: Fraction, trees: int, longest: int, recall: float) -> DataFrame:
    """Distinct texts by ``key``: the least ``doc_id``, ``copies``, how many shingles, the labels of all trees, side by side, and the ``depth`` to match.

    A label is ``longest`` MinHash values of the text's shingles of ``n`` words.  Texts without words have no labels.
    """
    factor = mix(np.arange(1, 2 * trees * longest + 1, dtype=np.uint64)).reshape(2, -1) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in pieces(batch.column("text")):
                part = batch.slice(i, j - i)
                key = np.array(part.column("key").to_pylist(), object)
                _, first, where = np.unique(key, return_index=True, return_inverse=True)
                doc = np.full(len(first), _LAST)
                np.minimum.at(doc, where, np.asarray(part.column("doc_id").cast(pa.int64()).fill_null(_LAST)))
                texts = part.column("text").take(pa.array(first))
                h, of = windows(*word_hashes(texts), n)
                order = np.argsort(of, kind="stable")
                h, of = h[order], of[order]
                some, starts = np.unique(of, return_index=True)
                found = np.zeros((len(first), trees * longest), ">u2")
                for k in range(trees * longest):
                    if len(some):
                        least = np.minimum.reduceat((h ^ factor[0, k]) * factor[1, k], starts)
                        found[some, k] = mix(least) >> np.uint64(64 - 8 * _BYTES)
                packed = found.tobytes()
                width = trees * longest * _BYTES
                has = np.zeros(len(first), bool)
                has[some] = True
                text_labels = [packed[r * width : (r + 1) * width] if has[r] else None for r in range(len(first))]
                shingles = np.bincount(of, minlength=len(first))
                few = np.flatnonzero(shingles[of] < 100)  # of other texts, the size makes no difference
                distinct = shingles.copy()
                distinct[of[few]] = np.bincount(of[few][np.unique(mix(h[few] + mix(of[few].astype(np.uint64))), return_index=True)[1]], minlength=len(first))[of[few]]
                depth = depths(distinct, threshold, trees, longest, recall)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(first)), pa.array(doc), pa.array(np.bincount(where, minlength=len(first))), pa.array(shingles), pa.array(text_labels, pa.binary()), pa.array(depth.astype(np.int32))],
                    ["key", "doc", "copies", "shingles", "labels", "depth"],
                )

    found = documents.where(F.col("text").isNotNull()).select("doc_id", text_key().alias("key"), "text")
    found = found.mapInArrow(run, "key binary, doc bigint, copies bigint, shingles bigint, labels binary, depth int")
    return found.groupBy("key").agg(F.min("doc").alias("doc"), F.sum("copies").alias("copies"), *(F.first(c).alias(c) for c in ("shingles", "labels", "depth")))


def text_key() -> F.Column:
    """A text's name: 128 bits of a digest."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def forest_runs(texts: DataFrame, trees: int, longest: int, shallow: int) -> DataFrame:
    """Texts (``id``) that share a prefix of ``shallow`` values, the shortest that any text matches, with others in some ``tree``.

    The tries are the labels of all trees, sorted over all partitions, with texts under one prefix as neighbours.  The
    sort goes on by the whole label and the text's id, so that a hot prefix, too, is dealt out over many tasks;
    the first and last run of each partition are kept even if they have one text there.
    """
    width = longest * _BYTES
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    rows = texts.where(F.col("labels").isNotNull()).select("id", "labels", tree.alias("tree"))
    rows = rows.select("id", "tree", F.expr(f"substring(labels, tree * {width} + 1, {width})").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, alone = None, None  # the last prefix, and its text if it has been the only one so far
        for batch in batches:
            if not len(batch):
                continue
            label = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint8).reshape(-1, width)
            full = np.ascontiguousarray(np.column_stack((np.asarray(batch.column("tree")).astype(np.uint8), label[:, : shallow * _BYTES])))
            fresh = np.ones(len(full), bool)
            fresh[1:] = (full[1:] != full[:-1]).any(axis=1)
            fresh[0] = before != full[0].tobytes()
            keep = ~fresh
            keep[:-1] |= ~fresh[1:]
            keep[0] |= before is None
            keep[-1] = True  # the next batch may go on with it
            out = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([out.column("id"), out.column("tree"), pa.array([x.tobytes() for x in full[keep][:, 1:]], pa.binary())], ["id", "tree", "prefix"])
            before = full[-1].tobytes()

    dealt = rows.repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    return dealt.mapInArrow(run, "id bigint, tree int, prefix binary")


def met(labels: np.ndarray, depth: np.ndarray, sides: tuple[np.ndarray, np.ndarray], tree: int, longest: int, least: float) -> np.ndarray:
    """Which text of one side meets which of the other in ``tree``, and in no tree before, under the longer of the prefixes that they match.

    Two texts of which too few values agree (less than the share ``least``) are left out; a text doesn't meet itself.
    """
    x, y = sides
    used = np.unique(depth)
    longer = np.maximum(depth[x][:, None], depth[y][None, :]) if len(used) > 1 else None

    def same(k: int) -> np.ndarray:
        out = None
        for d in used:
            prefix = np.ascontiguousarray(labels[:, k * longest : k * longest + d]).view(f"V{2 * d}").ravel()
            number = np.unique(prefix, return_inverse=True)[1].astype(np.int32)
            equal = number[x][:, None] == number[y][None, :]
            if longer is None:
                return equal
            equal &= longer == d
            out = equal if out is None else out | equal
        return out

    out = same(tree) & (x[:, None] != y[None, :])
    for k in range(tree):
        if not out.any():
            return out
        out &= ~same(k)
    bound = least * labels.shape[1]
    if np.count_nonzero(out) < out.size / 8:
        a, b = np.nonzero(out)
        for start in range(0, len(a), 1 << 14):
            part = slice(start, start + (1 << 14))
            out[a[part], b[part]] = (labels[x[a[part]]] == labels[y[b[part]]]).sum(axis=1) >= bound
        return out
    columns, agree = np.ascontiguousarray(labels.T), np.zeros(out.shape, np.uint16)
    for c in columns:
        agree += c[x][:, None] == c[y][None, :]
    return out & (agree >= bound)


def verify(ids: np.ndarray, sides: tuple[np.ndarray, np.ndarray], allowed: np.ndarray, shingles: list[np.ndarray], t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Of some texts, how many others each is similar to among the pairs ``allowed`` of both sides, and the least id that it is linked with (by any path).

    Shingles that two texts share are counted by products of matrices, some thousand columns at a time.
    """
    x, y = sides
    size = np.array([len(s) for s in shingles])
    _, column, times = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(ids)), size)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros(allowed.shape, np.float32)
    step = 8192
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        i, j = np.searchsorted(column, (start, start + step))
        part_of = np.zeros((len(ids), min(step, int(column[j - 1]) - start + 1)), np.float32)
        part_of[row[i:j], column[i:j] - start] = 1
        common += part_of[x] @ part_of[y].T
    both = size[x][:, None] + size[y][None, :] - common
    linked = allowed & (t.denominator * common >= t.numerator * both)
    count = np.zeros(len(ids), np.int64)
    count[x] = linked.sum(axis=1)
    if x is not y:
        count[y] = linked.sum(axis=0)
    root = ids.copy()
    while True:
        after = root.copy()
        after[x] = np.minimum(root[x], np.where(linked, root[y][None, :], _LAST).min(axis=1, initial=_LAST))
        after[y] = np.minimum(after[y], np.where(linked, root[x][:, None], _LAST).min(axis=0, initial=_LAST))
        if (after == root).all():
            return count, root
        root = after


@dataclass
class Group:
    """Texts of a task: those of one run, or of two blocks of a large run."""

    name: tuple  # tree, prefix, blocks a and b
    rows: list[tuple]  # id, block, depth, labels, and what else there is

    def pairs(self, longest: int, least: float) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """The two sides whose texts are compared (the same one within a block), and which of them meet."""
        tree, _, a, b = self.name
        labels = np.frombuffer(b"".join(r[3] for r in self.rows), np.uint16).reshape(len(self.rows), -1)
        block = np.array([r[1] for r in self.rows])
        x = np.flatnonzero(block == a)
        sides = (x, x if a == b else np.flatnonzero(block == b))
        return sides, met(labels, np.array([r[2] for r in self.rows]), sides, tree, longest, least)


_GROUP = ("tree", "prefix", "a", "b")
_MEMBER = ("id", "block", "depth", "labels")


def _groups(batches: Iterator[pa.RecordBatch], extra: Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, list]]]) -> Iterator[Group]:
    """The groups one after another, from rows sorted by group; ``extra`` gives parts of a batch with one more value for each row."""
    open_group = None
    for batch in batches:
        for part, values in extra(batch):
            for row in zip(*(part.column(c).to_pylist() for c in (*_GROUP, *_MEMBER)), values, strict=True):
                if open_group is None or open_group.name != row[:4]:
                    if open_group is not None:
                        yield open_group
                    open_group = Group(row[:4], [])
                open_group.rows.append(row[4:])
    if open_group is not None:
        yield open_group


def partners(runs: DataFrame, texts: DataFrame, longest: int, least: float, members: int, shingles: int) -> DataFrame:
    """Those texts of each run (or two blocks of it) that meet another one there first, with what tells whom (see ``met``).

    A run of more than ``members`` texts or ``shingles`` is cut by hash into blocks of about that size, and each two blocks
    meet in a task of their own.
    """
    sizes = runs.join(texts.select("id", "shingles"), "id").groupBy("tree", "prefix")
    sizes = sizes.agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("shingles") / shingles)).cast("int").alias("blocks"))
    sizes = stored(sizes.where("n > 1").drop("n"))
    given = runs.join(sizes, ["tree", "prefix"]).join(texts.select("id", "depth", "labels"), "id")
    given = given.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    given = given.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    given = given.select("tree", "prefix", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), *_MEMBER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, lambda batch: [(batch, [None] * len(batch))]):
            if len(group.rows) > 1:
                (x, y), meet = group.pairs(longest, least)
                some = np.union1d(x[meet.any(axis=1)], y[meet.any(axis=0)])
                rows = [group.rows[k] for k in some]
                if rows:
                    same = [pa.array([x] * len(rows), kind) for x, kind in zip(group.name, (pa.int32(), pa.binary(), pa.int32(), pa.int32()), strict=True)]
                    own = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([*same, *own], [*_GROUP, *_MEMBER])

    dealt = given.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return dealt.mapInArrow(run, "tree int, prefix binary, a int, b int, id bigint, block int, depth int, labels binary")


def links(documents: DataFrame, texts: DataFrame, met_texts: DataFrame, n: int, threshold: Fraction, longest: int, least: float) -> DataFrame:
    """For each text (``id``) with any: ``links``, to how many other texts, and ``root``, a text of the same group.

    Each two texts that met are compared by all their shingles, in the run where they met first.
    """
    asked = texts.join(met_texts.select("id").distinct(), "id", "left_semi").select("id", "key")
    asked = stored(asked)
    held = documents.sparkSession.sparkContext.broadcast(class_bitmap(asked.select(F.xxhash64("key").alias("cls"))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark = np.asarray(batch.column("mark"))
            at = np.unique(mark, return_index=True)[1]
            yield batch.take(pa.array(at[in_bitmap(held.value, mark[at])])).select(["key", "text"])

    given = documents.where(F.col("text").isNotNull()).select(text_key().alias("key"), "text").withColumn("mark", F.xxhash64("key"))
    given = given.mapInArrow(pick, "key binary, text string").join(asked, "key").dropDuplicates(["id"]).select("id", "text")
    dealt = met_texts.join(given, "id").select(*_GROUP, *_MEMBER, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def extra(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
            for i, j in pieces(batch.column("text")):
                rows = batch.slice(i, j - i)
                h, of = windows(*word_hashes(rows.column("text")), n)
                order = np.argsort(of, kind="stable")
                yield rows, [np.unique(x) for x in np.split(h[order], np.searchsorted(of[order], np.arange(1, len(rows))))]

        for group in _groups(batches, extra):
            if len(group.rows) > 1:
                ids = np.array([r[0] for r in group.rows])
                count, root = verify(ids, *group.pairs(longest, least), [r[4] for r in group.rows], threshold)
                some = count > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count[some].astype(np.int64)), pa.array(root[some])], ["id", "links", "root"])

    dealt = dealt.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return dealt.mapInArrow(run, "id bigint, links bigint, root bigint")


def near_duplicates(documents: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = 24, longest: int = 6, recall: float = 0.99999, members: int = 512, shingles: int = 1_500_000) -> DataFrame:
    """One row for each row of ``documents``: ``doc_id``, ``key`` (of its text), ``copies``, ``n_links``, ``group_doc`` and ``group_key``.

    Texts are compared by the Jaccard similarity of their sets of ``n``-word shingles (all words, if fewer);
    ``n_links`` counts the other different texts at ``threshold`` or more, ``copies`` the rows with the very same
    text.  A group is what links and copies connect; ``group_doc`` and ``group_key`` name its document with the least
    id (null last), of several the one with the least key.  Texts without words have copies but no links; null texts are each a group of their own.

    Candidates are texts that meet in some tree of a forest of MinHash labels.  Each text shortens the prefix that it
    matches until a partner of the least similarity that it can have meets it with probability ``recall``, so that
    short texts, whose similarities are few, keep long ones; two texts meet under the longer prefix of both.
    Pairs whose labels agree in far too few values (a chance of 1e-7 at the threshold) aren't compared, all others that met are, once.
    """
    spark = documents.sparkSession
    t = Fraction(str(threshold))
    texts = labels(documents, n, t, trees, longest, recall)
    texts = stored(texts.withColumn("id", F.monotonically_increasing_id()))
    shallow = int(depths(np.array([1000]), t, trees, longest, recall)[0])
    least = max(0.0, threshold - float(np.sqrt(np.log(1e7) / (2 * trees * longest))))
    runs = stored(forest_runs(texts, trees, longest, shallow))
    release(spark)
    pairs = stored(partners(runs, texts, longest, least, members, shingles))
    release(spark)
    found = stored(links(documents, texts, pairs, n, t, longest, least))
    release(spark)
    roots = stored(components(found.select(F.col("id").alias("u"), F.col("root").alias("v"))))
    counts = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    named = texts.select("id", "key", "doc", "copies").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    best = named.groupBy("root").agg(F.min(F.struct("doc", "key")).alias("best"))
    named = named.join(best, "root").join(counts, "id", "left")
    named = stored(named.select("key", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.expr("nullif(best.doc, 9223372036854775807)").alias("group_doc"), F.col("best.key").alias("group_key")))
    drop(texts, runs, pairs, found, roots)
    release(spark)
    ids = documents.select("doc_id", F.when(F.col("text").isNotNull(), text_key()).alias("key"))
    return ids.join(named, "key", "left").select("doc_id", "key", F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("group_doc")).alias("group_doc"), "group_key")


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """Those ``documents`` that have the least id of their group (see ``near_duplicates``), one of rows that are the same; null texts all stay."""
    return shielded(documents, lambda given: _one_of_each(given, **options))


def _one_of_each(documents: DataFrame, **options) -> DataFrame:
    row = {"__doc": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)), "__key": text_key()}
    groups = stored(near_duplicates(documents, **options).withColumn("__doc", row["__doc"]))
    stays = F.col("key").isNull() | (F.col("doc_id").eqNullSafe(F.col("group_doc")) & (F.col("key") == F.col("group_key")))
    gone = groups.where(~stays).select("__doc", F.col("key").alias("__key")).distinct()
    left = documents.withColumns(row).join(gone, ["__doc", "__key"], "left_anti")
    twice = groups.where(F.col("key").isNotNull() & stays & (F.col("copies") > 1)).groupBy("__doc", F.col("key").alias("__key")).count().where("count > 1")
    if not twice.isEmpty():
        left = left.where("text is null").unionAll(left.where("text is not null").dropDuplicates(["__doc", "__key"]))
    return left


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all ``documents``: ``class_id`` is the least doc_id of the group."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(documents)
    return found.select("doc_id", F.col("group_doc").alias("class_id"), "n_links", "copies")
