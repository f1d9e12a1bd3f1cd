"""Crawls of citations from seed papers: by levels, and best-first."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .paths import ranked_by


class TooManyCitations(ValueError):
    """More than the driver's queue may hold."""


def top_citations(cited: DataFrame, n: int) -> DataFrame:
    """The ``n`` most important citations (src, dst, importance) of each paper; ties go to the smaller id."""
    order = Window.partitionBy("src").orderBy(F.desc("importance"), "dst")
    return cited.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def by_levels(seeds: DataFrame, top: DataFrame, depth: int) -> DataFrame:
    """Papers within ``depth`` top citations of the seeds (id): id, depth (the least), importance (the highest at that depth).

    Each level joins its papers with their citations and drops those seen; levels are written, so plans stay short.
    """
    seen = written(seeds.select("id", F.lit(0).alias("depth"), F.lit(None).cast("int").alias("importance")).dropDuplicates(["id"]))
    level, levels = seen, []
    for d in range(1, depth + 1):
        reached = level.select(F.col("id").alias("src")).join(top, "src").groupBy(F.col("dst").alias("id")).agg(F.max("importance").alias("importance"))
        level = written(reached.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth"), "importance"))
        levels.append(level)
        seen = seen.unionAll(level)
    out = levels[0] if levels else seen.limit(0)
    for more in levels[1:]:
        out = out.unionAll(more)
    return out


def best_first(seeds: list[str], top: DataFrame, depth: int, limit: int | None = None, completed: frozenset[str] = frozenset(), max_edges: int = 1_000_000) -> list[tuple[str, int, int, str]]:
    """The crawl's order: (id, depth, importance, ``crawled`` or ``skipped``), most important first, then least deep.

    A paper is seen when it is queued, so that its depth is that of who queues it first; ``limit`` 0 or null is none, and
    completed papers are passed through without counting.  The order depends on every step before, so it is found on
    the driver, over the citations that can be reached, which must be ``max_edges`` at most.
    """
    spark = top.sparkSession
    reach = by_levels(spark.createDataFrame([(s,) for s in seeds], "id string"), top, max(depth - 1, 0))
    ids = spark.createDataFrame([(s,) for s in seeds], "src string").unionAll(reach.select("id")).distinct()
    rows = top.join(ids, "src", "left_semi").select("src", "dst", "importance", "place").limit(max_edges + 1).collect()
    if len(rows) > max_edges:
        raise TooManyCitations(f"more than {max_edges} citations can be reached; best_first_table has no such bound")
    cited: dict[str, list[tuple[int, str, int]]] = {}
    for row in rows:
        cited.setdefault(row["src"], []).append((row["place"], row["dst"], row["importance"]))
    queue: list[tuple[int, int, int, str]] = []
    seen, number, done, out = set(), 0, 0, []

    def enqueue(paper: str, at: int) -> None:
        nonlocal number
        for _, dst, importance in sorted(cited.get(paper, ())):
            if dst not in seen:
                heapq.heappush(queue, (-importance, at, number, dst))
                seen.add(dst)
                number += 1

    for seed in seeds:
        seen.add(seed)
        enqueue(seed, 1)
    while queue and not (limit and done >= limit):
        importance, at, _, paper = heapq.heappop(queue)
        if at > depth:
            continue
        skipped = paper in completed
        out.append((paper, at, -importance, "skipped" if skipped else "crawled"))
        done += not skipped
        if at < depth:
            enqueue(paper, at + 1)
    return out


_ORDER = "place int, id string, depth int, importance int, status string"


def best_first_table(seeds: list[str], top: DataFrame, depth: int, limit: int | None = None, completed: frozenset[str] = frozenset(), max_edges: int = 1_000_000) -> DataFrame:
    """The order of ``best_first`` as a table (place, id, depth, importance, status), over any number of citations.

    Up to ``max_edges`` reachable citations go through the driver's queue; more are settled by ``best_first_rounds``, with the same rows.
    """
    spark = top.sparkSession
    try:
        found = best_first(seeds, top, depth, limit, completed, max_edges)
    except TooManyCitations:
        return best_first_rounds(seeds, top, depth, limit, completed)
    return spark.createDataFrame([(n, *row) for n, row in enumerate(found)], _ORDER)


def best_first_rounds(seeds: list[str], top: DataFrame, depth: int, limit: int | None = None, completed: frozenset[str] = frozenset()) -> DataFrame:
    """As ``best_first``, with the queue as a table: no step brings papers to the driver.

    Papers of one importance and depth are one bucket, in the order in which they were queued.  A round takes the best
    bucket and settles at once its papers up to the first one that queues something more important, which goes before
    the rest; a paper that several of them cite is queued by the first.  So there is a round for each bucket, and one for
    each paper that another one goes before.
    """
    spark = top.sparkSession
    ids = lambda rows, kind="id string": spark.createDataFrame(rows, kind)
    first = ids([(s, n) for n, s in reversed(list(enumerate(seeds)))], "seed string, parent bigint").groupBy("seed").agg(F.min("parent").alias("parent"))
    cited = top.select("src", "dst", "importance", "place")
    known, parts, done, base, phase = ids([(s,) for s in sorted(set(seeds))]), [], 0, 0, 0
    children = first.join(cited, F.col("seed") == F.col("src"))
    children = children.join(first.select(F.col("seed").alias("dst"), F.col("parent").alias("own")), "dst", "left").where("own is null or own > parent")

    def claimed(rows: DataFrame, at: int) -> DataFrame:
        """The papers that are queued: by the first citation of each."""
        by = rows.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("parent", "place", "importance")).alias("c"))
        return by.select("id", F.col("c.importance").alias("importance"), F.lit(at).alias("depth"), F.col("c.parent").alias("parent"), F.col("c.place").alias("place"))

    def queued(claims: DataFrame) -> DataFrame:
        return ranked_by(claims, "parent", "place", "id").select("id", "importance", "depth", (F.col("rank") + base).cast("bigint").alias("number"))

    queue = written(queued(claimed(children, 1)))
    base, known = queue.count(), known.unionAll(queue.select("id")).distinct()
    if depth < 1:
        queue = queue.limit(0)
    while (head := queue.orderBy(F.desc("importance"), "depth").first()) is not None:
        bucket = queue.where((F.col("importance") == head["importance"]) & (F.col("depth") == head["depth"]))
        claims, stop = None, None
        if head["depth"] < depth:
            met = bucket.select(F.col("id").alias("src"), F.col("number").alias("parent")).join(cited, "src").join(known.select(F.col("id").alias("dst")), "dst", "left_anti")
            claims = written(claimed(met, head["depth"] + 1))
            stop = claims.where(F.col("importance") > head["importance"]).agg(F.min("parent")).first()[0]
        settled = bucket if stop is None else bucket.where(F.col("number") <= stop)
        status = F.when(F.col("id").isin(*completed), "skipped").otherwise("crawled") if completed else F.lit("crawled")
        settled = written(settled.withColumns({"status": status, "phase": F.lit(phase)}))
        counted = settled.where("status = 'crawled'")
        n = counted.count()
        if limit and done + n >= limit:
            last = counted.orderBy("number").limit(limit - done).agg(F.max("number")).first()[0]
            parts.append(settled.where(F.col("number") <= last))
            break
        done, phase = done + n, phase + 1
        parts.append(settled)
        queue = queue.join(settled.select("id"), "id", "left_anti")
        if claims is not None:
            new = written(queued(claims if stop is None else claims.where(F.col("parent") <= stop)))
            base, queue, known = base + new.count(), queue.unionByName(new), known.unionAll(new.select("id"))
        queue, known = written(queue), written(known)
    out = ids([], "id string, importance int, depth int, number bigint, status string, phase int")
    for part in parts:
        out = out.unionByName(part)
    return ranked_by(out, "phase", "number").select((F.col("rank") - 1).cast("int").alias("place"), "id", "depth", "importance", "status")


def planned_total(seeds: F.Column, top: int, depth: int, limit: int | None = None) -> F.Column:
    """The most papers that a crawl can take up."""
    if limit is not None:
        return F.lit(max(0, limit)).cast("bigint")
    if depth <= 0 or top <= 0:
        return F.lit(0).cast("bigint")
    return F.greatest(F.lit(0), seeds * sum(top**d for d in range(1, depth + 1))).cast("bigint")


def statistics(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def queue_statistics(order: DataFrame, reached: DataFrame) -> DataFrame:
    """One row on a crawl (see ``best_first_table``) among what levels reach (see ``by_levels``): papers ``visited``, ``crawled``, ``skipped``, and ``waiting``, those not visited.

    Some may be out of a crawl's reach though not of the levels': it counts the depth of who queues a paper first.
    """
    counts = order.agg(F.count("*").alias("visited"), F.count_if(F.col("status") == "crawled").alias("crawled"), F.count_if(F.col("status") == "skipped").alias("skipped"))
    waiting = reached.join(order.select("id"), "id", "left_anti").agg(F.count("*").alias("waiting"))
    return counts.withColumn("waiting", waiting.scalar())
