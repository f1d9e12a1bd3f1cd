"""Path queries: expansion, classes, scores, ranks, limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import paths as P
from ..sources import graph_fixture
from ..sources.tables import written
from ._registry import Registry

TARGET, K = "P1", 3
R = Registry()


def _all(spark, d, k=K):
    return P.candidates(P.expand(graph_fixture.load_for_paths(spark, d).edge, TARGET, k))


def _once(spark, d, k=K):
    """The paths, written, for queries that read them more than once."""
    return written(_all(spark, d, k))


def _flat(df, *more):
    return df.select(F.array_join("keys", "|").alias("path"), "node", "node_label", F.col("hops").cast("bigint").alias("hops"), *more)


def walk(k=K, start=TARGET, edge="edge", back=False):
    stop = "" if back else f" AND e.dst <> '{start}'"
    return f"""WITH RECURSIVE {graph_fixture.SQL},
weighed AS (SELECT *, CASE type WHEN 'CITES' THEN 2.0 * coalesce(importance_score, 3) + CASE citation_type WHEN 'EXTENDS' THEN 20 WHEN 'COMPARES' THEN 15 WHEN 'USES' THEN 12 ELSE 10 END
  WHEN 'MENTIONS' THEN 3 WHEN 'USES' THEN 8 WHEN 'EXTENDS' THEN 10 WHEN 'COMPARES' THEN 7 WHEN 'ENABLES' THEN 9 WHEN 'IMPROVES' THEN 8 WHEN 'ADDRESSES' THEN 6 ELSE 0 END AS w FROM {edge}),
walk AS (SELECT '{start}' AS node, 'Paper' AS node_label, 0 AS hops, ['{start}'] AS route, CAST([] AS VARCHAR[]) AS keys, CAST(0 AS DOUBLE) AS weight, 0 AS cite_count, 0 AS cite_importance, 0 AS cite_extends, 0 AS cite_compares, 0 AS cite_uses,
    0 AS mentions, 0 AS entity_uses, 0 AS entity_extends, 0 AS entity_count
  UNION ALL SELECT e.dst, e.dst_label, hops + 1, list_append(route, e.dst), list_append(keys, e.key), weight + e.w, cite_count + (e.type = 'CITES')::INT, cite_importance + CASE WHEN e.type = 'CITES' THEN coalesce(importance_score, 3) ELSE 0 END,
    cite_extends + (e.type = 'CITES' AND coalesce(citation_type, '') = 'EXTENDS')::INT, cite_compares + (e.type = 'CITES' AND coalesce(citation_type, '') = 'COMPARES')::INT, cite_uses + (e.type = 'CITES' AND coalesce(citation_type, '') = 'USES')::INT,
    mentions + (e.type = 'MENTIONS')::INT, entity_uses + (e.type = 'USES')::INT, entity_extends + (e.type = 'EXTENDS')::INT, entity_count + (e.dst_label = 'Entity')::INT
  FROM walk JOIN weighed e ON e.src = walk.node WHERE hops < {k} AND NOT list_contains(keys, e.key){stop}),
found AS (SELECT *, array_to_string(keys, '|') AS path, cite_count > 0 AS is_paper, 100 + weight - 2.0 * hops AS score,
  CASE WHEN cite_count > 0 THEN cite_importance ELSE entity_uses + entity_extends END AS presort FROM walk WHERE hops > 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, is_paper DESC, presort DESC, hops, path) AS rank FROM found WHERE cite_count > 0 OR entity_count > 0)
"""


BOTH = "(SELECT * FROM edge UNION ALL SELECT dst, src, type, dst_label, src_label, importance_score, citation_type, context, key FROM edge)"
_ROW = "path, node, node_label, CAST(hops AS BIGINT) AS hops"


@R.add("multihop_paths", walk() + f"SELECT {_ROW}, weight FROM found")
def multihop_paths(spark, d):
    return _flat(P.expand(graph_fixture.load_for_paths(spark, d).edge, TARGET, K), "weight")


@R.add("paper_paths", walk() + f"SELECT {_ROW}, cite_importance, CAST(row_number() OVER (ORDER BY cite_importance DESC, hops, path) AS INTEGER) AS rank FROM found WHERE cite_count > 0")
def paper_paths(spark, d):
    return _flat(P.ranked(_all(spark, d).where("is_paper"), P.paper_order()), "cite_importance", "rank")


@R.add("entity_paths", walk() + f"SELECT {_ROW}, presort, CAST(row_number() OVER (ORDER BY presort DESC, hops, path) AS INTEGER) AS rank FROM found WHERE cite_count = 0 AND entity_count > 0")
def entity_paths(spark, d):
    return _flat(P.ranked(_all(spark, d).where("not is_paper"), P.entity_order()), "presort", "rank")


@R.add("k_hop_paths", walk(2, back=True) + f", best AS (SELECT *, sum(hops) OVER (ORDER BY hops, path ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT * FROM found ORDER BY hops, path LIMIT 200)) SELECT {_ROW}, CAST(0 AS DOUBLE) AS score FROM best WHERE used <= 300")
def k_hop_paths(spark, d):
    return _flat(P.k_hop(graph_fixture.load_for_paths(spark, d).edge, TARGET, 2, max_paths=200, max_edges=300), "score")


@R.add("edge_budget_prefix", walk(2, back=True) + f", best AS (SELECT *, sum(hops) OVER (ORDER BY hops, path ROWS UNBOUNDED PRECEDING) AS used FROM found) SELECT {_ROW}, CAST(used AS BIGINT) AS edges_used FROM best WHERE used <= 100")
def edge_budget_prefix(spark, d):
    found = P.expand(graph_fixture.load_for_paths(spark, d).edge, TARGET, 2, return_to_start=True)
    return _flat(P.within_edge_budget(found, [F.asc("hops"), F.asc(F.array_join("keys", "|"))], 100), "edges_used")


@R.add("undirected_khop", walk(2, edge=BOTH, back=True) + f"SELECT {_ROW} FROM found ORDER BY hops, path LIMIT 50")
def undirected_khop(spark, d):
    found = P.expand(P.both_ways(graph_fixture.load_for_paths(spark, d).edge), TARGET, 2, return_to_start=True)
    return _flat(found.orderBy("hops", F.array_join("keys", "|")).limit(50))


@R.add("path_score", walk() + """SELECT path, CAST(2.0 * cite_importance AS DOUBLE) AS cite_importance_score, CAST(20.0 * cite_extends + 15.0 * cite_compares + 12.0 * cite_uses + 10.0 * (cite_count - cite_extends - cite_compares - cite_uses) AS DOUBLE) AS cite_type_score,
CAST(3.0 * mentions AS DOUBLE) AS mentions_score, CAST(8.0 * entity_uses + 10.0 * entity_extends AS DOUBLE) AS entity_relation_score, CAST(-2.0 * hops AS DOUBLE) AS length_penalty, score FROM ranked""")
def path_score(spark, d):
    return P.breakdown(_all(spark, d)).select(F.array_join("keys", "|").alias("path"), "cite_importance_score", "cite_type_score", "mentions_score", "entity_relation_score", "length_penalty", "score")


@R.add("path_totals", walk() + """SELECT count(*) AS total_paths, count(*) FILTER (WHERE is_paper) AS total_paper_paths, count(*) FILTER (WHERE NOT is_paper) AS total_entity_paths,
CAST(sum(hops) AS BIGINT) AS total_edges, (SELECT count(DISTINCT id) FROM (SELECT unnest(route) AS id FROM ranked)) AS total_nodes FROM ranked""")
def path_totals(spark, d):
    return P.totals(written(_all(spark, d).select("route", "hops", "is_paper")))


@R.add("rank_candidates", walk() + f"SELECT CAST(rank AS INTEGER) AS rank, {_ROW}, score FROM ranked")
def rank_candidates(spark, d):
    return _flat(P.ranked(_all(spark, d), P.rank_order()), "score", "rank")


_TOP = "ORDER BY rank LIMIT 20"


@R.add("flagship", walk() + f"SELECT CAST(rank AS INTEGER) AS rank, {_ROW}, score FROM ranked {_TOP}")
def flagship(spark, d):
    """Few paths begin at one paper within three hops, so all are ranked; see ``best_paths``."""
    found = P.candidates(P.expand(graph_fixture.load_for_paths(spark, d).edge, TARGET, K, store=False))
    return _flat(P.ranked(found, P.rank_order(), top=20), "score", "rank")


@R.add("best_paths", walk(4) + f"SELECT CAST(rank AS INTEGER) AS rank, {_ROW}, score FROM ranked {_TOP}")
def best_paths(spark, d):
    """The best paths of up to four hops, by branch and bound."""
    return _flat(P.best(graph_fixture.load_for_paths(spark, d).edge, TARGET, 4, 20), "score", "rank")


@R.add("response_limit", walk() + f"SELECT CAST(rank AS INTEGER) AS rank, {_ROW}, score FROM ranked ORDER BY rank LIMIT 10")
def response_limit(spark, d):
    return _flat(P.best(graph_fixture.load_for_paths(spark, d).edge, TARGET, K, 10), "score", "rank")


@R.add("topn_paths", walk() + f"""SELECT * FROM (SELECT 'entity' AS class, {_ROW}, presort FROM found WHERE cite_count = 0 AND entity_count > 0 ORDER BY presort DESC, hops, path LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'paper', {_ROW}, presort FROM found WHERE cite_count > 0 ORDER BY cite_importance DESC, hops, path LIMIT 5)""")
def topn_paths(spark, d):
    found = _once(spark, d)
    papers = found.where("is_paper").orderBy(*P.paper_order()).limit(5)
    entities = found.where("not is_paper").orderBy(*P.entity_order()).limit(5)
    return _flat(entities, "presort").withColumn("class", F.lit("entity")).unionByName(_flat(papers, "presort").withColumn("class", F.lit("paper")))


@R.add("union_path_classes", walk() + "SELECT CASE WHEN is_paper THEN 'paper' ELSE 'entity' END AS class, count(*) AS paths, sum(score) AS score FROM ranked GROUP BY 1")
def union_path_classes(spark, d):
    found = _once(spark, d)
    both = found.where("is_paper").withColumn("class", F.lit("paper")).unionByName(found.where("not is_paper").withColumn("class", F.lit("entity")))
    return both.groupBy("class").agg(F.count("*").alias("paths"), F.sum("score").alias("score"))


@R.add("union_scopes", walk() + f""", near AS (SELECT {_ROW} FROM found WHERE hops <= 2)
SELECT 'path' AS part, {_ROW} FROM ranked UNION ALL SELECT 'k_hop', * FROM near""")
def union_scopes(spark, d):
    edge = graph_fixture.load_for_paths(spark, d).edge
    best = P.candidates(P.expand(edge, TARGET, K))
    near = P.expand(edge, TARGET, 2)
    return _flat(best).withColumn("part", F.lit("path")).unionByName(_flat(near).withColumn("part", F.lit("k_hop")))


@R.add("reverse_paths", walk(2) + "SELECT path, array_to_string(list_reverse(route), '<') AS reversed, array_to_string(list_reverse(keys), '|') AS reversed_keys FROM ranked")
def reverse_paths(spark, d):
    return _all(spark, d, 2).select(F.array_join("keys", "|").alias("path"), F.array_join(F.reverse("route"), "<").alias("reversed"), F.array_join(F.reverse("keys"), "|").alias("reversed_keys"))


@R.add("first_appearance_dedupe", walk() + """, best AS (SELECT * FROM ranked), places AS (SELECT rank, route[i] AS id, i FROM best, unnest(range(1, len(route) + 1)) AS t(i)),
firsts AS (SELECT id, min(rank * 100 + i) AS place FROM places GROUP BY id) SELECT id, CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS position FROM firsts ORDER BY place LIMIT 40""")
def first_appearance_dedupe(spark, d):
    return _firsts(P.ranked(_all(spark, d), P.rank_order()), 40)


def _firsts(best, limit):
    places = best.select("rank", F.posexplode("route").alias("place", "id"))
    firsts = places.groupBy("id").agg(F.min(F.struct("rank", "place")).alias("first")).orderBy("first").limit(limit)
    return P.ranked(firsts, [F.asc("first")], limit).select("id", F.col("rank").alias("position"))


@R.add("merge_edges_first", walk() + """, best AS (SELECT * FROM ranked), places AS (SELECT rank, keys[i] AS key, i FROM best, unnest(range(1, len(keys) + 1)) AS t(i)),
firsts AS (SELECT key, min(rank * 100 + i) AS place FROM places GROUP BY key) SELECT e.src AS from_id, e.dst AS to_id, e.type, e.importance_score, e.citation_type, CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS position FROM firsts JOIN edge e USING (key)""")
def merge_edges_first(spark, d):
    best = P.ranked(_all(spark, d), P.rank_order())
    rows = best.select("rank", "route", F.posexplode("rels").alias("place", "rel")).select("rank", "place", F.get("route", F.col("place")).alias("from_id"), F.get("route", F.col("place") + 1).alias("to_id"), "rel.*")
    firsts = rows.groupBy("from_id", "to_id", "type").agg(F.min(F.struct("rank", "place", "importance", "citation")).alias("first"))
    return P.ranked(firsts, [F.asc("first.rank"), F.asc("first.place")]).select("from_id", "to_id", "type", F.col("first.importance").alias("importance_score"), F.col("first.citation").alias("citation_type"), F.col("rank").alias("position"))


@R.add("graph_summary", walk() + """, best AS (SELECT * FROM ranked) SELECT count(*) AS paths, (SELECT count(DISTINCT id) FROM (SELECT unnest(route) AS id FROM best)) AS unique_nodes,
(SELECT count(DISTINCT key) FROM (SELECT unnest(keys) AS key FROM best)) AS unique_edges FROM best""")
def graph_summary(spark, d):
    best = _once(spark, d)
    nodes = best.select(F.explode("route").alias("id")).agg(F.countDistinct("id").alias("unique_nodes"))
    edges = best.select(F.explode("keys").alias("key")).agg(F.countDistinct("key").alias("unique_edges"))
    return best.agg(F.count("*").alias("paths")).withColumns({"unique_nodes": nodes.scalar(), "unique_edges": edges.scalar()})


@R.add("grounding_topk", walk() + """, best AS (SELECT * FROM ranked WHERE rank <= 3), places AS (SELECT rank, route[i] AS id, i FROM best, unnest(range(1, len(route) + 1)) AS t(i)),
firsts AS (SELECT id, min(rank * 100 + i) AS place FROM places GROUP BY id), named AS (SELECT CASE WHEN p.id IS NULL THEN 'entity' ELSE 'paper' END AS kind, coalesce(p.title, e.name) AS name, place FROM firsts f LEFT JOIN paper p USING (id) LEFT JOIN entity e USING (id)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY place) AS n FROM named) SELECT kind, name, CAST(n AS INTEGER) AS n FROM numbered WHERE n <= 5""")
def grounding_topk(spark, d):
    g = graph_fixture.load(spark, d)
    best = P.ranked(_all(spark, d), P.rank_order(), top=3)
    firsts = best.select("rank", F.posexplode("route").alias("place", "id")).groupBy("id").agg(F.min(F.struct("rank", "place")).alias("first"))
    named = firsts.join(g.paper.select("id", "title"), "id", "left").join(g.entity.select("id", "name"), "id", "left")
    named = named.select(F.when(F.col("title").isNull(), "entity").otherwise("paper").alias("kind"), F.coalesce("title", "name").alias("name"), "first")
    return named.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("first"))).where("n <= 5").drop("first")


@R.add("prompt_defaults", walk() + "SELECT greatest(1, count(*)) AS max_paths, greatest(1, (SELECT count(DISTINCT id) FROM (SELECT unnest(route) AS id FROM ranked))) AS max_nodes, CAST(greatest(1, sum(hops)) AS BIGINT) AS max_edges, CAST(3 AS BIGINT) AS neighbor_k FROM ranked")
def prompt_defaults(spark, d):
    one = F.lit(1).cast("bigint")
    t = P.totals(_once(spark, d))
    return t.select(F.greatest("total_paths", one).alias("max_paths"), F.greatest("total_nodes", one).alias("max_nodes"), F.greatest("total_edges", one).alias("max_edges"), F.greatest(F.lit(K).cast("bigint"), one).alias("neighbor_k"))


@R.add("type_collect", walk() + """, t AS (SELECT DISTINCT 'node' AS kind, coalesce(e.type, 'Paper') AS name FROM (SELECT unnest(route) AS id FROM ranked) LEFT JOIN entity e USING (id)
UNION SELECT DISTINCT 'edge', split_part(key, '>', 2) FROM (SELECT unnest(keys) AS key FROM ranked)) SELECT kind, name, CAST(row_number() OVER (PARTITION BY kind ORDER BY name <> 'Paper', name) AS INTEGER) AS position FROM t""")
def type_collect(spark, d):
    g = graph_fixture.load(spark, d)
    found = _once(spark, d)
    nodes = found.select(F.explode("route").alias("id")).distinct().join(g.entity.select("id", "type"), "id", "left").select(F.lit("node").alias("kind"), F.coalesce("type", F.lit("Paper")).alias("name"))
    edges = found.select(F.explode("rels").alias("r")).select(F.lit("edge").alias("kind"), F.col("r.type").alias("name"))
    order = Window.partitionBy("kind").orderBy(F.col("name") != "Paper", "name")
    return nodes.unionAll(edges).distinct().withColumn("position", F.row_number().over(order))
