"""Sharding: groups of equal texts packed by best fit decreasing into shards of near equal bytes, or into few shards of a fixed capacity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, isqrt
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import drop, stored

OVERHEAD = 8  # bytes that each document takes beside its text
DIGITS = 14  # binary digits that sizes of groups are told apart by


def text_size(text: str = "text") -> F.Column:
    return (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + OVERHEAD).cast("bigint")


def text_group(text: str = "text") -> F.Column:
    """128 bits that name a text; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def size_class(size: str, digits: int = DIGITS) -> F.Column:
    """Sizes rounded up to ``digits`` binary digits, so that there are at most 2**(digits - 1) of them for each doubling, whatever the corpus."""
    step = f"shiftleft(1L, greatest(length(bin({size})) - {digits}, 0))"
    return F.expr(f"(({size} + {step} - 1) div {step}) * {step}")


class _Node:
    __slots__ = ("key", "left", "priority", "right")

    def __init__(self, key: tuple[int, int], priority: float):
        self.key, self.priority, self.left, self.right = key, priority, None, None


def _split(node: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
    """Nodes below a key, and the others."""
    if node is None:
        return None, None
    if node.key < key:
        node.right, rest = _split(node.right, key)
        return node, rest
    less, node.left = _split(node.left, key)
    return less, node


def _merge(a: _Node | None, b: _Node | None) -> _Node | None:
    if a is None or b is None:
        return a or b
    if a.priority > b.priority:
        a.right = _merge(a.right, b)
        return a
    b.left = _merge(a, b.left)
    return b


class Room:
    """Open shards by what room they have left, in a balanced tree (a treap): each step takes logarithmic time."""

    def __init__(self):
        self.root: _Node | None = None
        self.priorities = Random(0)

    def put(self, room: int, shard: int) -> None:
        node = _Node((room, shard), self.priorities.random())
        less, rest = _split(self.root, node.key)
        self.root = _merge(_merge(less, node), rest)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes the shard with the least room that has ``least`` at least."""
        less, rest = _split(self.root, (least, -1))
        found = rest
        while found is not None and found.left is not None:
            found = found.left
        if found is not None:
            _, rest = _split(rest, (found.key[0], found.key[1] + 1))
        self.root = _merge(less, rest)
        return found and found.key

    def take_largest(self) -> tuple[int, int]:
        found = self.root
        while found.right is not None:
            found = found.right
        self.root, _ = _split(self.root, found.key)
        return found.key


@dataclass
class Plan:
    """Which groups go where: groups are numbered by falling size class, and those of run i end at ``ends[i]`` and go to ``shards[i]``."""

    classes: np.ndarray  # ascending
    first: np.ndarray  # of each class, the number of its first group
    ends: np.ndarray
    shards: np.ndarray
    opened: int


def least_capacity(sizes: list[int], counts: list[int], shards: int) -> int:
    """What the fullest of ``shards`` must hold at least if groups larger than that have shards of their own; sizes fall."""
    total = sum(s * n for s, n in zip(sizes, counts, strict=True))
    best, rest, own = total / shards, total, 0
    for size, n in zip(sizes, counts, strict=True):
        for _ in range(min(n, shards - 1 - own)):
            rest, own = rest - size, own + 1
            best = min(best, rest / (shards - own))
        if own == shards - 1:
            break
    return max(1, ceil(best))


def pack(sizes: np.ndarray, counts: np.ndarray, shards: int | None = None, capacity: int | None = None) -> Plan:
    """Best fit decreasing over ``counts`` groups of each of some ``sizes``: each group enters the shard with the least room that holds it.

    With a ``capacity``, a shard is opened when no open one has room, and a group beyond the capacity gets a shard of
    its own.  With ``shards``, all of them are open from the start, with the least capacity that so many can have, and
    a group that fits nowhere enters the shard with the most room.  Groups of one size are put in at once, as many as
    a shard holds, which is what single steps give: a shard that was tightest stays so.
    """
    order = np.argsort(-sizes, kind="stable")
    falling, many = sizes[order].tolist(), counts[order].tolist()
    room, opened, runs = Room(), 0, []
    if shards is not None:
        capacity, opened = least_capacity(falling, many, shards), shards
        for shard in range(shards):
            room.put(capacity, shard)
    for size, left in zip(falling, many, strict=True):
        while left:
            found = room.take(size)
            if found is not None:
                n = min(left, found[0] // size)
            elif shards is not None:
                found, n = room.take_largest(), 1
            else:
                found, n = (max(capacity, size), opened), min(left, max(1, capacity // size))
                opened += 1
            room.put(found[0] - n * size, found[1])
            runs.append((n, found[1]))
            left -= n
    ends = np.cumsum([n for n, _ in runs], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])[:-1]
    return Plan(np.array(falling[::-1], np.int64), first[::-1].astype(np.int64), ends, np.array([s for _, s in runs], np.int32), opened)


def _numbered(rows: DataFrame, within: str, order: str, n: int, name: str) -> DataFrame:
    """Adds the place of each of ``n`` rows among those of its ``within``, from 0, which may be most rows.

    Rows are dealt to about sqrt(n) chunks by the hash of ``order``, numbered by chunk, and begin after the chunks before.
    """
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(order), F.lit(isqrt(max(n - 1, 0)) + 1)))
    cells = rows.groupBy(within, "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(within).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(within, "chunk").orderBy(order)) - 1
    both = rows.withColumn("place", place).join(cells.select(within, "chunk", before.alias("before")), [within, "chunk"])
    return both.withColumn(name, F.col("before") + F.col("place")).drop("chunk", "place", "before")


def assignment(rows: DataFrame, shards: int | None = None, capacity: int | None = None) -> tuple[DataFrame, int]:
    """The ``shard`` of each ``group`` of rows (group, size), and how many rows there are.

    Copies are added up before they are shuffled.  Only the number of groups of each size class reaches the driver, of
    which there are at most 2**13 for each doubling of size (see ``size_class``); the plan goes back to the tasks in
    runs, at most one for each class and shard.
    """
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")).withColumn("class", size_class("bytes"))
    groups = stored(groups)
    found = groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).toArrow()
    sizes, counts = np.asarray(found["class"], np.int64), np.asarray(found["n"], np.int64)
    held = rows.sparkSession.sparkContext.broadcast(pack(sizes, counts, shards, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        for batch in batches:
            number = plan.first[np.searchsorted(plan.classes, np.asarray(batch.column("class")))] + np.asarray(batch.column("rank"))
            at = np.searchsorted(plan.ends, number, "right")
            yield pa.RecordBatch.from_arrays([batch.column("group"), pa.array(plan.shards[at], pa.int32())], ["group", "shard"])

    ranked = _numbered(groups.select("group", "class"), "class", "group", int(counts.sum()), "rank")
    return ranked.select("group", "class", "rank").mapInArrow(run, "group binary, shard int"), sum(found["copies"].to_pylist())


def sharded(documents: DataFrame, key: str = "doc_id", shards: int | None = 24, capacity: int | None = None) -> DataFrame:
    """For each row of ``documents``: ``key``, its ``size``, ``text_crc32``, ``group``, ``shard`` and ``slot`` (gapless from 0 within the shard).

    Groups are equal texts and stay together.  Give ``shards`` for so many of near equal bytes, or None and a
    ``capacity`` for few shards of it.  A null text is as an empty one: 8 bytes, and one group with it; keys may be null
    or repeated, and each row has a place of its own; an empty table gives no rows, and other columns aren't read.
    Sizes are told apart by ``DIGITS`` binary digits: shards differ by up to 1 in 2**13 more than with exact sizes.
    Places follow a hash, so each shard is shuffled.
    """
    rows = documents.select(F.col(key).alias("key"), text_size().alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), text_group().alias("group"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    placed, n = assignment(rows, shards, capacity)
    out = stored(rows.join(placed, "group"))
    drop(rows)
    return _numbered(out, "shard", "row", n, "slot").select(F.col("key").alias(key), "size", "text_crc32", "group", "shard", F.col("slot").cast("bigint").alias("slot"))


def write_shards(documents: DataFrame, path: str, shards: int | None = 24, capacity: int | None = None, rows_of_file: int = 1_000_000) -> None:
    """Writes all columns of ``documents`` as Parquet below ``path``, in folders ``shard=0``, ``shard=1``, ...

    A shard's rows come from as many tasks as write all others, so that none holds a shard.  A column named ``shard``
    is replaced.
    """
    given = documents.drop("shard")
    rows = stored(given.select(text_size().alias("size"), text_group().alias("group")))
    placed, n = assignment(rows, shards, capacity)
    names = [f"column {k}" for k in range(len(given.columns))]
    both = given.withColumn("own group", text_group()).toDF(*names, "group").join(placed, "group").drop("group")
    both = both.repartition("shard", F.pmod(F.xxhash64(*(f"`{c}`" for c in names if both.schema[c].dataType.typeName() != "map")), F.lit(n // rows_of_file + 1)))
    both.toDF(*given.columns, "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    drop(rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 24 shards of near equal bytes; copies stay together."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = sharded(documents)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
