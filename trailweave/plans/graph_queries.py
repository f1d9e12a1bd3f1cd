"""Lookups, searches and counts over the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as C
from ..operators import lookups as L
from ..operators import paths as P
from ..operators.substrings import NameIndex
from ..sources import graph_fixture
from ..sources.tables import scratch
from ._registry import Registry
from .path_queries import walk

R = Registry()
G = f"WITH {graph_fixture.SQL}\n"
NAMES = "(SELECT id, 'Paper' AS label, title AS name, NULL::VARCHAR AS entity_type FROM paper UNION ALL SELECT id, 'Entity', name, type FROM entity)"
BOTH = "(SELECT * FROM edge UNION ALL SELECT dst, src, type, dst_label, src_label, importance_score, citation_type, context, key FROM edge)"


@R.add("scan_nodes_by_label", G + "SELECT id, title, summary, published_date FROM paper WHERE id = 'P1'")
def scan_nodes_by_label(spark, d):
    return graph_fixture.load(spark, d).paper.where("id = 'P1'").limit(1)


@R.add("lookup_papers_in", G + "SELECT id, title, published_date FROM paper WHERE id IN ('P1', 'P5', 'P77', 'nope')")
def lookup_papers_in(spark, d):
    ids = spark.createDataFrame([("P1",), ("P5",), ("P77",), ("nope",)], "id string")
    return L.in_ids(graph_fixture.load(spark, d).paper, ids).select("id", "title", "published_date")


@R.add("lookup_entities_in", G + "SELECT id, type, name, description FROM entity WHERE id IN ('S1', 'N3', 'R2', 'nope')")
def lookup_entities_in(spark, d):
    ids = spark.createDataFrame([("S1",), ("N3",), ("R2",), ("nope",)], "id string")
    return L.in_ids(graph_fixture.load(spark, d).entity, ids)


@R.add("lookup_published_range", G + "SELECT id, ':' || substr(published_date, 1, 10) AS date_range FROM paper")
def lookup_published_range(spark, d):
    return L.date_range(graph_fixture.load(spark, d).paper)


PRESETS = {
    "all": (None, None), "papers": ("CITES", None), "method": ("MENTIONS", "Method"), "dataset": ("MENTIONS", "Dataset"), "benchmark": ("MENTIONS", "Benchmark"),
    "task": ("MENTIONS", "Task"), "cites": ("CITES", None), "mentions": ("MENTIONS", None),
}


def _preset_sql(name, kind, entity):
    where = "src_label = 'Paper'" + (f" AND type = '{kind}'" if kind else "") + (f" AND dst IN (SELECT id FROM entity WHERE type = '{entity}')" if entity else "")
    return f"SELECT * FROM (SELECT '{name}' AS preset, src, type, dst FROM edge WHERE {where} ORDER BY src, type, dst LIMIT 100)"


@R.add("filter_label_prop", G + " UNION ALL ".join(_preset_sql(n, *v) for n, v in PRESETS.items()))
def filter_label_prop(spark, d):
    g = graph_fixture.load(spark, d)
    out = None
    for name, (kind, entity) in PRESETS.items():
        some = L.typed_edges(g, kind, entity).orderBy("src", "type", "dst").limit(100).select(F.lit(name).alias("preset"), "src", "type", "dst")
        out = some if out is None else out.unionAll(some)
    return out


def _name_index(spark, graph):
    return NameIndex.write(L.names(graph).select("id", "name"), scratch(spark, "index"))


@R.add("keyword_search", G + f"SELECT n.id, n.label, n.name, e.type AS rel, e.dst AS neighbour, e.key FROM {NAMES} n LEFT JOIN {BOTH} e ON e.src = n.id WHERE contains(lower(n.name), 'brand#2') ORDER BY n.id, e.key, e.dst LIMIT 50")
def keyword_search(spark, d):
    g = graph_fixture.load(spark, d, dates=False)
    return L.keyword_search(g, "BRAND#2", _name_index(spark, g), limit=50)


@R.add("projection_detail", G + f"SELECT id, label, coalesce(nullif(name, ''), id) AS shown FROM {NAMES}")
def projection_detail(spark, d):
    return L.display_names(L.names(graph_fixture.load(spark, d))).select("id", "label", "shown")


@R.add("edge_attr_mask", G + "SELECT key, CASE WHEN type = 'CITES' THEN importance_score END AS importance_score, CASE WHEN type = 'CITES' THEN citation_type END AS citation_type FROM edge")
def edge_attr_mask(spark, d):
    return L.masked(graph_fixture.load(spark, d).edge).select("key", "importance_score", "citation_type")


@R.add("paper_context", G + "SELECT p.id, p.title, p.summary, coalesce(string_agg(DISTINCT e.type || ':' || e.name, ',' ORDER BY e.type || ':' || e.name), '') AS entities FROM paper p LEFT JOIN edge m ON m.src = p.id AND m.type = 'MENTIONS' LEFT JOIN entity e ON e.id = m.dst GROUP BY ALL")
def paper_context(spark, d):
    found = L.paper_context(graph_fixture.load(spark, d))
    return found.withColumn("entities", F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["type"], e["name"])), ","))


_CITED = "SELECT src AS paper_id, dst AS cited_id, coalesce(importance_score, 3) AS importance, coalesce(title, '') AS title, CAST(row_number() OVER (PARTITION BY src ORDER BY coalesce(importance_score, 3) DESC, dst) AS INTEGER) AS place FROM edge e JOIN paper p ON p.id = e.dst WHERE e.type = 'CITES'"


@R.add("citations_ranked", G + _CITED)
def citations_ranked(spark, d):
    return L.citations_ranked(graph_fixture.load(spark, d))


@R.add("topn_citations", G + f"SELECT * FROM ({_CITED}) WHERE place <= 5")
def topn_citations(spark, d):
    return L.citations_ranked(graph_fixture.load(spark, d)).where("place <= 5")


_SHOWN = walk() + ", shown AS (SELECT DISTINCT unnest(route) AS id FROM ranked)"


def _best_nodes(spark, d, g):
    found = P.candidates(P.expand(g.edge, "P1", 3))
    return found.select(F.explode("route").alias("id")).distinct().join(L.names(g).select("id", "label", "name", "entity_type"), "id")


@R.add("node_details", _SHOWN + " SELECT s.id, CASE WHEN p.id IS NULL THEN 'Entity' ELSE 'Paper' END AS label, coalesce(p.title, e.name) AS name, e.type AS entity_type, p.title, p.summary, e.description FROM shown s LEFT JOIN paper p USING (id) LEFT JOIN entity e USING (id)")
def node_details(spark, d):
    g = graph_fixture.load_for_paths(spark, d)
    return L.node_details(_best_nodes(spark, d, g), L.names(g))


@R.add("edge_endpoint_check", _SHOWN + " SELECT key FROM edge WHERE src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown)")
def edge_endpoint_check(spark, d):
    g = graph_fixture.load_for_paths(spark, d)
    return L.endpoints_in(g.edge, _best_nodes(spark, d, g)).select("key")


@R.add("path_highlight_match", walk() + f""", names AS (SELECT * FROM {NAMES}), hit AS (SELECT n.id, n.name FROM names n JOIN (SELECT DISTINCT unnest(route) AS id FROM ranked WHERE rank <= 3) USING (id))
SELECT n.id, n.name FROM names n WHERE EXISTS (SELECT 1 FROM hit h WHERE h.id = n.id OR contains(lower(n.name), lower(h.name)) OR contains(lower(h.name), lower(n.name)))""")
def path_highlight_match(spark, d):
    g = graph_fixture.load_for_paths(spark, d, dates=False)
    best = P.candidates(P.expand(g.edge, "P1", 3)).orderBy(*P.rank_order()).limit(3)
    hit = best.select(F.explode("route").alias("id")).distinct().join(L.names(g), "id")
    return L.highlight(L.names(g).select("id", "name"), hit, _name_index(spark, g))


@R.add("node_counts", G + f"SELECT label, count(*) AS n FROM {NAMES} GROUP BY label")
def node_counts(spark, d):
    return L.label_counts(graph_fixture.load(spark, d))


@R.add("rel_counts", G + "SELECT type, count(*) AS n FROM edge GROUP BY type")
def rel_counts(spark, d):
    return L.type_counts(graph_fixture.load(spark, d))


@R.add("ensure_constraints", G + "SELECT 'paper' AS name, count(*) - count(DISTINCT id) AS violations FROM paper UNION ALL SELECT 'entity', count(*) - count(DISTINCT id) FROM entity UNION ALL SELECT 'edge', count(*) - count(DISTINCT key) FROM edge")
def ensure_constraints(spark, d):
    return L.duplicate_keys(graph_fixture.load(spark, d))


_LATE = """, late AS (SELECT list(p.id) AS ids FROM paper p, (SELECT published_date AS day FROM paper WHERE id = 'P1') t WHERE p.published_date > t.day OR p.id = 'P1')"""


@R.add("future_paper_filter", walk() + _LATE + " SELECT path, array_to_string([x FOR x IN route IF NOT list_contains(ids, x)], '>') AS kept FROM ranked, late")
def future_paper_filter(spark, d):
    g = graph_fixture.load_for_paths(spark, d)
    kept = C.without_future(P.candidates(P.expand(g.edge, "P1", 3)), g.paper, "P1")
    return kept.select(F.array_join("keys", "|").alias("path"), F.array_join("kept", ">").alias("kept"))


#: Paths as the context shows them: without the target and what is later, reversed.
_KEPT = walk() + _LATE + """, best AS (SELECT rank, score, [x FOR x IN route IF NOT list_contains(ids, x)] AS nodes, keys FROM ranked, late),
linear AS (SELECT rank, score, list_reverse(nodes) AS nodes, list_reverse([k FOR k IN keys IF list_contains(nodes, split_part(k, '>', 1)) AND list_contains(nodes, split_part(k, '>', 3))]) AS keys FROM best WHERE len(nodes) >= 2),
kept AS (SELECT *, row_number() OVER (ORDER BY rank) AS idx FROM linear WHERE len(keys) = len(nodes) - 1),
named AS (SELECT id, 'Paper' AS label, title AS name, summary, NULL::VARCHAR AS kind FROM paper UNION ALL SELECT id, 'Entity', name, NULL::VARCHAR, type FROM entity),
spots AS (SELECT idx, i, nodes[i] AS id, keys[i] AS key FROM kept, unnest(range(1, len(nodes) + 1)) AS t(i)),
nodes AS (SELECT n.*, row_number() OVER (ORDER BY place) AS number FROM (SELECT id, min(idx * 100 + i) AS place FROM spots GROUP BY id) JOIN named n USING (id)),
edges AS (SELECT e.*, row_number() OVER (ORDER BY place) AS number FROM (SELECT key, min(idx * 100 + i) AS place FROM spots WHERE key IS NOT NULL GROUP BY key) JOIN edge e USING (key))
"""


def _options(name, **more):
    return C.Options(graph_format=name, **more)


@R.add("path_filter", _KEPT + "SELECT CAST(idx AS INTEGER) AS idx, array_to_string(nodes, '<') AS nodes, array_to_string(keys, '|') AS edges, score FROM kept")
def path_filter(spark, d):
    found = C.prepared(graph_fixture.load_for_paths(spark, d), "P1", 3, _options("paths"))
    edges = F.transform("edges", lambda e: F.concat_ws(">", e["from_id"], e["type"], e["to_id"]))
    return found.select("idx", F.array_join(F.transform("nodes", lambda n: n["id"]), "<").alias("nodes"), F.array_join(edges, "|").alias("edges"), "score")


@R.add("select_paths", walk() + "SELECT 0 AS part, CAST(rank AS INTEGER) AS rank, path FROM ranked WHERE rank <= 25 UNION ALL SELECT * FROM (SELECT 1, CAST(row_number() OVER (ORDER BY hops, path) AS INTEGER) AS rank, path FROM found2 ORDER BY rank LIMIT 25)".replace("found2", "(WITH RECURSIVE w AS (SELECT 'P1' AS node, 0 AS hops, CAST([] AS VARCHAR[]) AS keys UNION ALL SELECT e.dst, hops + 1, list_append(keys, e.key) FROM w JOIN edge e ON e.src = w.node WHERE hops < 1 AND NOT list_contains(keys, e.key)) SELECT hops, array_to_string(keys, '|') AS path FROM w WHERE hops > 0)"))
def select_paths(spark, d):
    found = C.select_paths(graph_fixture.load_for_paths(spark, d), "P1", 3, C.Options(scope="path_plus_k_hop", max_paths=25, neighbor_k=1))
    return found.select("part", "rank", F.array_join("keys", "|").alias("path"))


@R.add("merge_nodes", _KEPT + "SELECT CAST(number AS INTEGER) AS number, id, label, name, CASE label WHEN 'Paper' THEN 'Summary=' || summary ELSE 'Type=' || kind END AS details FROM nodes")
def merge_nodes(spark, d):
    g = graph_fixture.load_for_paths(spark, d)
    found = C.merged_nodes(C.prepared(g, "P1", 3, _options("paths")), g, _options("paths"))
    return found.withColumn("details", F.array_join(F.transform("details", lambda x: F.concat_ws("=", x["k"], x["v"])), ";"))


@R.add("max_edges_trunc", _KEPT + "SELECT CAST(number AS INTEGER) AS number, src AS from_id, dst AS to_id, type FROM edges ORDER BY number LIMIT 20")
def max_edges_trunc(spark, d):
    g = graph_fixture.load_for_paths(spark, d)
    o = _options("paths")
    paths = C.prepared(g, "P1", 3, o)
    return C.kept_edges(C.merged_edges(paths, o), C.merged_nodes(paths, g, o), 20).select("number", "from_id", "to_id", "type")


@R.add("ctx_paths", _KEPT + """, parts AS (SELECT s.idx, s.i, n.name, e.type || coalesce('{' || nullif(concat_ws(', ', 'citation_type=' || citation_type, 'importance_score=' || importance_score), '') || '}', '') AS label FROM spots s JOIN nodes n USING (id) LEFT JOIN edge e USING (key)),
said AS (SELECT idx, string_agg(name || CASE WHEN label IS NULL THEN '' ELSE ' <-(' || label || ')- ' END, '' ORDER BY i) AS body FROM parts GROUP BY idx)
SELECT 0 AS section, 0 AS ord, '### Graph Paths' AS line UNION ALL SELECT 1, CAST(idx AS INTEGER), idx || '. ' || body FROM said UNION ALL SELECT 2, 0, '' UNION ALL SELECT 2, 1, '### Node Details'
UNION ALL SELECT 3, CAST(number AS INTEGER), '- ' || name || ' (' || label || ')' || chr(10) || '  - ' || CASE label WHEN 'Paper' THEN 'Summary: ' || summary ELSE 'Type: ' || kind END FROM nodes""")
def ctx_paths(spark, d):
    return C.context_lines(graph_fixture.load_for_paths(spark, d), "P1", 3, _options("paths"))


@R.add("ctx_triples", _KEPT + """SELECT 0 AS section, 0 AS ord, '## Relationships' AS line UNION ALL
SELECT 1, CAST(e.number AS INTEGER), '(' || a.name || ', ' || e.type || coalesce('[' || nullif(concat_ws(',', 'importance=' || importance_score, 'type=' || citation_type), '') || ']', '') || ', ' || b.name || ')' FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst
UNION ALL SELECT 2, 0, '' UNION ALL SELECT 2, 1, '## Node Attributes' UNION ALL SELECT 3, CAST(number AS INTEGER), '(' || name || ', is_a, ' || label || ')' || chr(10) || '(' || name || ', ' || CASE label WHEN 'Paper' THEN 'summary, "' || summary ELSE 'type, "' || kind END || '")' FROM nodes
UNION ALL SELECT 4, 0, '' UNION ALL SELECT 4, 1, '## Ranked Paths' UNION ALL SELECT 5, CAST(k.idx AS INTEGER), 'Path[score=' || k.score || ']: ' || r.route FROM kept k JOIN (SELECT idx, string_agg(name, ' -> ' ORDER BY i) AS route FROM spots JOIN nodes USING (id) GROUP BY idx) r USING (idx)""")
def ctx_triples(spark, d):
    return C.context_lines(graph_fixture.load_for_paths(spark, d), "P1", 3, _options("triples"))


_STRAIGHT = "kept AS (SELECT *, row_number() OVER (ORDER BY rank) AS idx FROM linear WHERE len(keys) = len(nodes) - 1)"
#: In diagrams, paths with a gap keep their nodes.
_DRAWN = _KEPT.replace(_STRAIGHT, "kept AS (SELECT rank, score, nodes, CASE WHEN len(keys) = len(nodes) - 1 THEN keys ELSE CAST([] AS VARCHAR[]) END AS keys, row_number() OVER (ORDER BY rank) AS idx FROM linear)")
_ENDS = "edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst"


@R.add("ctx_mermaid", _DRAWN + f"""SELECT 0 AS section, 0 AS ord, '```mermaid' AS line UNION ALL SELECT 0, 1, 'graph RL' UNION ALL SELECT 9, 0, '```'
UNION ALL SELECT 1, CAST(number AS INTEGER), '  N' || number || '["' || name || '<br/>' || CASE label WHEN 'Paper' THEN 'Summary=' || summary ELSE 'Type=' || kind END || '"]' FROM nodes
UNION ALL SELECT 2, CAST(e.number AS INTEGER), '  N' || a.number || ' -- ' || concat_ws('<br/>', e.type, 'citation_type=' || citation_type, 'importance_score=' || importance_score) || ' --> N' || b.number FROM {_ENDS}""")
def ctx_mermaid(spark, d):
    return C.context_lines(graph_fixture.load_for_paths(spark, d), "P1", 3, _options("mermaid"))


@R.add("mermaid_statistics", G + f"SELECT CAST(sum(length(t) - length(regexp_replace(t, '[(){{}}\\[\\]|<>`:;]', '', 'g'))) AS BIGINT) AS removed_chars, count(*) FILTER (WHERE length(t) - length(regexp_replace(t, '[(){{}}\\[\\]|<>`:;]', '', 'g')) > 0.4 * length(t)) AS unsafe_labels FROM (SELECT CASE WHEN summary LIKE 'S%' THEN '((:' || summary[1:2] || '))' ELSE '[' || title || ']' END AS t FROM paper)")
def mermaid_statistics(spark, d):
    paper = graph_fixture.load(spark, d).paper
    name = F.when(F.col("summary").startswith("S"), F.concat(F.lit("((:"), F.substring("summary", 1, 2), F.lit("))"))).otherwise(F.concat(F.lit("["), "title", F.lit("]")))
    return C.label_statistics(paper.select(name.alias("name"), F.array().cast("array<struct<k: string, v: string>>").alias("details")))


@R.add("ctx_narrative", _KEPT + """, said AS (SELECT id, CASE label WHEN 'Paper' THEN 'Paper "' || name || '" (Summary: ' || summary || ')' ELSE kind || ' "' || name || '"' END AS t FROM nodes),
steps AS (SELECT k.idx, k.score, i, a.t AS a, b.t AS b, e.type || coalesce(' with ' || nullif(concat_ws(', ', 'importance ' || importance_score || '/5', 'type: ' || citation_type), ''), '') AS how FROM (SELECT *, unnest(range(1, len(keys) + 1)) AS i FROM kept) k JOIN said a ON a.id = k.nodes[i] JOIN said b ON b.id = k.nodes[i + 1] JOIN edge e ON e.key = k.keys[i])
SELECT 0 AS section, CAST(idx AS INTEGER) AS ord, '### Path ' || idx || ' (relevance: ' || score || ')' || chr(10) || string_agg(CASE i WHEN 1 THEN a || ' ' ELSE '' END || how || ' ' || b, ' ' ORDER BY i) || chr(10) AS line FROM steps GROUP BY idx, score
UNION ALL SELECT 1, 0, '### Graph Summary' UNION ALL SELECT 1, 1, (SELECT count(*) FROM kept) || ' paths, ' || (SELECT count(*) FROM nodes) || ' unique nodes, ' || (SELECT count(*) FROM edges) || ' unique edges.'""")
def ctx_narrative(spark, d):
    return C.context_lines(graph_fixture.load_for_paths(spark, d), "P1", 3, _options("narrative"))


@R.add("ctx_json_graph", _KEPT + f"""SELECT 0 AS section, CAST(number AS INTEGER) AS ord, '{{"id":"' || id || '","type":"' || label || '","name":"' || name || '",' || CASE label WHEN 'Paper' THEN '"summary":"' || summary ELSE '"subtype":"' || kind END || '"}}' AS line FROM nodes
UNION ALL SELECT 1, CAST(e.number AS INTEGER), '{{"from":"' || src || '","to":"' || dst || '","relation":"' || e.type || '"' || coalesce(',"importance":"' || importance_score || '"', '') || coalesce(',"citation_type":"' || citation_type || '"', '') || '}}' FROM {_ENDS}
UNION ALL SELECT 2, CAST(idx AS INTEGER), '{{"route":["' || array_to_string(nodes, '","') || '"],"score":' || score || '}}' FROM kept""")
def ctx_json_graph(spark, d):
    return C.context_lines(graph_fixture.load_for_paths(spark, d), "P1", 3, _options("json_graph"))
