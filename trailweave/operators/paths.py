"""Multi-hop paths from one node: expansion, additive scores and ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: How much a relationship adds to a path's score; other types add nothing.
RELATION_WEIGHTS = {"MENTIONS": 3.0, "USES": 8.0, "EXTENDS": 10.0, "COMPARES": 7.0, "ENABLES": 9.0, "IMPROVES": 8.0, "ADDRESSES": 6.0}
CITATION_WEIGHTS = {"EXTENDS": 20.0, "COMPARES": 15.0, "USES": 12.0}
OTHER_CITATION, PER_IMPORTANCE, NO_IMPORTANCE, PER_HOP, BASE = 10.0, 2.0, 3, -2.0, 100.0


def _looked_up(column: F.Column, values: dict[str, float], other: float) -> F.Column:
    out = F.lit(other)
    for name, value in values.items():
        out = F.when(column == name, value).otherwise(out)
    return out


def edge_weight(kind: F.Column, importance: F.Column, citation: F.Column) -> F.Column:
    """What one relationship adds to a path's score, so that scores accumulate as paths grow."""
    cited = PER_IMPORTANCE * F.coalesce(importance, F.lit(NO_IMPORTANCE)) + _looked_up(citation, CITATION_WEIGHTS, OTHER_CITATION)
    return F.when(kind == "CITES", cited).otherwise(_looked_up(kind, RELATION_WEIGHTS, 0.0))


def both_ways(edge: DataFrame) -> DataFrame:
    """Each relationship in both directions, under its one key; the relationships are computed once."""
    rest = [F.col(c) for c in edge.columns if c not in ("src", "dst", "src_label", "dst_label")]
    there = F.struct("src", "dst", "src_label", "dst_label")
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dst_label").alias("src_label"), F.col("src_label").alias("dst_label"))
    return edge.select(F.explode(F.array(there, back)).alias("way"), *rest).select("way.*", *rest).select(*edge.columns)


def expand(edge: DataFrame, start: str, k: int, label: str = "Paper", return_to_start: bool = False, keep: Callable[[DataFrame, int], DataFrame] | None = None, store: bool = True) -> DataFrame:
    """All directed paths of 1 to ``k`` hops from ``start`` that use no relationship twice.

    Columns: node, node_label, hops, route (node ids), labels, keys (of relationships), rels (type, importance,
    citation type and context of each), weight (sum of ``edge_weight``).  Unless ``return_to_start``, no path comes back
    to its first node.  Each hop is an equi-join on a node id; which paths to drop is decided hop by hop, and only ids
    and what scores need is carried along.  Paths that go on are written while this is called, so that none is found twice
    and the next hop's join knows how few they are, unless ``store`` is False.  ``keep`` may drop paths of each hop, given how many hops are left.
    """
    rel = F.struct(F.col("type"), F.col("importance_score").alias("importance"), F.col("citation_type").alias("citation"), F.col("context"))
    hop = edge.select("src", "dst", "dst_label", "key", rel.alias("rel"), edge_weight(F.col("type"), F.col("importance_score"), F.col("citation_type")).alias("w"))
    first = hop.where(F.col("src") == start)
    if not return_to_start:
        hop = hop.where(F.col("dst") != start)
        first = first.where(F.col("dst") != start)
    level = first.select(
        F.col("dst").alias("node"), F.col("dst_label").alias("node_label"), F.lit(1).alias("hops"), F.array("src", "dst").alias("route"), F.array(F.lit(label), "dst_label").alias("labels"),
        F.array("key").alias("keys"), F.array("rel").alias("rels"), F.col("w").alias("weight"),
    )
    levels = [level]
    for left in range(k - 1, -1, -1):
        if keep:
            levels[-1] = keep(levels[-1], left)
        if len(levels) < k and store:  # read by the next hop and with the rest
            levels[-1] = written(levels[-1])
        if not left:
            break
        met = levels[-1].join(hop, F.col("node") == F.col("src")).where(~F.array_contains("keys", F.col("key")))
        levels.append(met.select(
            F.col("dst").alias("node"), F.col("dst_label").alias("node_label"), (F.col("hops") + 1).alias("hops"), F.array_append("route", F.col("dst")).alias("route"), F.array_append("labels", F.col("dst_label")).alias("labels"),
            F.array_append("keys", F.col("key")).alias("keys"), F.array_append("rels", F.col("rel")).alias("rels"), (F.col("weight") + F.col("w")).alias("weight"),
        ))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionAll(more)
    return out


def _count(condition) -> F.Column:
    return F.size(F.filter("rels", condition))


def scored(paths: DataFrame) -> DataFrame:
    """Adds the parts of the score by name, ``score``, and ``is_paper``: whether the path has a citation."""
    cited = lambda kind: _count(lambda r: (r["type"] == "CITES") & (r["citation"] == kind))
    typed = lambda kind: _count(lambda r: r["type"] == kind)
    counts = {
        "cite_count": typed("CITES"),
        "cite_importance": F.aggregate(F.filter("rels", lambda r: r["type"] == "CITES"), F.lit(0), lambda s, r: s + F.coalesce(r["importance"], F.lit(NO_IMPORTANCE))),
        "cite_extends": cited("EXTENDS"), "cite_compares": cited("COMPARES"), "cite_uses": cited("USES"),
        "mentions": typed("MENTIONS"), "entity_uses": typed("USES"), "entity_extends": typed("EXTENDS"), "entity_compares": typed("COMPARES"),
        "enables": typed("ENABLES"), "improves": typed("IMPROVES"), "addresses": typed("ADDRESSES"),
        "entity_count": F.size(F.filter("labels", lambda x: x == "Entity")),
    }
    out = paths.withColumns({name: column.cast("int") for name, column in counts.items()})
    return out.withColumns({"score": BASE + F.col("weight") + PER_HOP * F.col("hops"), "is_paper": F.col("cite_count") > 0})


def breakdown(paths: DataFrame) -> DataFrame:
    """Adds the score's groups of parts as sums: importance, citation types, mentions, entity relations, length."""
    others = F.col("cite_count") - F.col("cite_extends") - F.col("cite_compares") - F.col("cite_uses")
    parts = {
        "cite_importance_score": PER_IMPORTANCE * F.col("cite_importance"),
        "cite_type_score": sum((F.col(f"cite_{k.lower()}") * v for k, v in CITATION_WEIGHTS.items()), OTHER_CITATION * others),
        "mentions_score": F.col("mentions") * RELATION_WEIGHTS["MENTIONS"],
        "entity_relation_score": sum((F.col(c) * RELATION_WEIGHTS[k] for c, k in (("entity_uses", "USES"), ("entity_extends", "EXTENDS"), ("entity_compares", "COMPARES"), ("enables", "ENABLES"), ("improves", "IMPROVES"), ("addresses", "ADDRESSES"))), F.lit(0.0)),
        "length_penalty": PER_HOP * F.col("hops"),
    }
    return paths.withColumns({**parts, "rel_types": F.transform("rels", lambda r: r["type"])})


def candidates(paths: DataFrame) -> DataFrame:
    """Scored paths of both classes: with a citation, or without one but with an entity."""
    return scored(paths).where("cite_count > 0 or entity_count > 0").withColumn("presort", F.when(F.col("is_paper"), F.col("cite_importance")).otherwise(F.col("entity_uses") + F.col("entity_extends") + F.col("enables")))


def paper_order() -> list[F.Column]:
    return [F.desc("cite_importance"), F.asc("hops"), F.asc(F.array_join("keys", "|"))]


def entity_order() -> list[F.Column]:
    return [F.desc("presort"), F.asc("hops"), F.asc(F.array_join("keys", "|"))]


def rank_order() -> list[F.Column]:
    """Score first; ties: paths with citations, then each class's own order, then the keys, which makes the order total."""
    return [F.desc("score"), F.desc("is_paper"), F.desc("presort"), F.asc("hops"), F.asc(F.array_join("keys", "|"))]


def ranked_by(rows: DataFrame, *order: F.Column | str) -> DataFrame:
    """Adds ``rank`` from 1 to all rows, without bringing them into one task.

    Rows are dealt out by ranges of the order and written once; each range is numbered by itself, after the counts of
    the ranges before it.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    counts = dealt.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return dealt.withColumn("place", place).join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.col("place")).drop("range", "before", "place")


def running_sum(rows: DataFrame, value: str, name: str, *order: F.Column | str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` up to each row in order: by range, as in ``ranked_by``, after the sums of the ranges before it."""
    dealt = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sums = dealt.groupBy("range").agg(F.sum(value).alias("sum"))  # a row for each range
    before = sums.select("range", (F.sum("sum").over(Window.orderBy("range")) - F.col("sum")).alias("before"))
    own = F.sum(value).over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("own", own).join(F.broadcast(before), "range").withColumn(name, F.col("before") + F.col("own")).drop("range", "before", "own")


def ranked(paths: DataFrame, order: list[F.Column], top: int | None = None) -> DataFrame:
    """Adds ``rank`` from 1.  With ``top``, Spark sorts only that many rows of each task; give it wherever not all ranks are needed."""
    if top is None:
        return ranked_by(paths, *order).withColumn("rank", F.col("rank").cast("int"))
    return paths.orderBy(*order).limit(max(top, 0)).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def bounds(edge: DataFrame, k: int) -> list[DataFrame]:
    """For 1 to ``k`` hops left, the most that they can add to the score of a path that ends in a ``node``: ``more``; 0 of nodes that aren't there.

    One backward pass over the relationships for each hop, which ignores that paths use none twice; so no path gets more.
    """
    hop = edge.select("src", "dst", (edge_weight(F.col("type"), F.col("importance_score"), F.col("citation_type")) + PER_HOP).alias("w"))
    out: list[DataFrame] = []
    for _ in range(k):
        rows = hop
        if out:
            rows = hop.join(out[-1].select(F.col("node").alias("dst"), "more"), "dst", "left").withColumn("w", F.col("w") + F.coalesce("more", F.lit(0.0)))
        out.append(rows.where("w > 0").groupBy(F.col("src").alias("node")).agg(F.max("w").alias("more")))
        if len(out) < k:
            out[-1] = written(out[-1])
    return out


def best(edge: DataFrame, start: str, k: int, top: int, label: str = "Paper", keep: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """The ``top`` candidates by ``rank_order`` with their ``rank``, by branch and bound: as ranking all paths, without finding most of them.

    A first search goes on with the most promising paths of each hop alone, by what they have and can get (see
    ``bounds``); the last of its ``top`` best scores is a floor.  The whole search drops paths at each hop that can't
    reach it.  It reads all relationships once for each hop, so it pays where paths are many more than relationships.
    ``keep`` is called with what is left of each hop of the whole search (and may count it).
    """
    if top < 1:
        return ranked(candidates(expand(edge, start, k, label)), rank_order(), top)
    more = [None, *bounds(edge, k - 1)]
    score = BASE + F.col("weight") + PER_HOP * F.col("hops")

    def hopeful(level: DataFrame, left: int) -> DataFrame:
        found = level.join(more[left], "node", "left") if left else level.withColumn("more", F.lit(0.0))
        return found.withColumn("hope", score + F.coalesce("more", F.lit(0.0)))

    def promising(level: DataFrame, left: int) -> DataFrame:
        return hopeful(level, left).orderBy(F.desc("hope"), F.array_join("keys", "|")).limit(2 * top).select(*level.columns)

    first = candidates(expand(edge, start, k, label, keep=promising, store=False)).select("score").orderBy(F.desc("score")).limit(top)
    floor = first.agg(F.count("*"), F.min("score")).first()
    least = floor[1] if floor[0] == top else None

    def reaching(level: DataFrame, left: int) -> DataFrame:
        found = level if least is None else hopeful(level, left).where(F.col("hope") >= least).select(*level.columns)
        return keep(found, left) if keep else found

    return ranked(candidates(expand(edge, start, k, label, keep=reaching)), rank_order(), top)


def totals(paths: DataFrame) -> DataFrame:
    """One row: paths of each class, distinct nodes, and edges (with repeats) of all paths."""
    nodes = paths.select(F.explode("route").alias("id")).agg(F.countDistinct("id").alias("total_nodes"))
    counts = paths.agg(
        F.count("*").alias("total_paths"), F.count_if("is_paper").alias("total_paper_paths"), F.count_if(~F.col("is_paper")).alias("total_entity_paths"),
        F.coalesce(F.sum("hops"), F.lit(0)).cast("bigint").alias("total_edges"),
    )
    return counts.withColumn("total_nodes", nodes.scalar())


def within_edge_budget(paths: DataFrame, order: list[F.Column], max_edges: int | None) -> DataFrame:
    """The first paths in order whose edges, added up, stay within a budget."""
    if max_edges is None:
        return paths
    return running_sum(paths, "hops", "edges_used", *order).where(F.col("edges_used") <= max_edges)


def k_hop(edge: DataFrame, start: str, k: int, max_paths: int | None = None, max_edges: int | None = None) -> DataFrame:
    """Paths that may come back to the start, shortest first, up to ``max_paths`` (1000) and ``max_edges``; their score is 0."""
    order = [F.asc("hops"), F.asc(F.array_join("keys", "|"))]
    found = expand(edge, start, k, return_to_start=True).orderBy(*order).limit(1000 if max_paths is None else max_paths).withColumn("score", F.lit(0.0))
    if max_edges is None:
        return found
    used = F.sum("hops").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # of as many rows as the limit allows
    return found.withColumn("edges_used", used).where(F.col("edges_used") <= max_edges)
