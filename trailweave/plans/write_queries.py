"""Upserts, ad-hoc reads and data-set loads over extractions made of orders and their lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import adhoc, upserts
from ..sources import files, graph_fixture
from ._registry import Registry

R = Registry()
G = f"WITH {graph_fixture.SQL}\n"
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus"


def extractions(spark, d):
    """An extraction for each order with lines: lines are entities, relations to the next line's, and cited papers.

    What a line says is made while lines are columns, before an order's are gathered.
    """
    table = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    in_order = Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", "))
    lines = table("lineitem").withColumns({"place": F.row_number().over(in_order), "next": F.lead("l_suppkey").over(in_order)})
    lines = lines.withColumns({name: F.concat(F.lit("Thing "), (F.col(key) % 40).cast("string")) for name, key in (("name", "l_suppkey"), ("next", "next"))})
    kind = F.when(F.col("l_returnflag") == "A", "Method").when(F.col("l_returnflag") == "N", "Dataset").otherwise("Task")
    entity = F.struct(kind.alias("type"), "name", F.col("l_linestatus").alias("description"))
    relation = F.struct(F.col("name").alias("source"), F.concat("next", F.when(F.col("l_quantity") > 25, "?").otherwise("")).alias("target"), F.when(F.col("l_linestatus") == "F", " uses ").otherwise("1 bad").alias("relation_type"))
    cited = F.struct(F.concat(F.lit("Title  Nr "), F.col("l_partkey").cast("string")).alias("title"), (1 + F.col("l_partkey") % 5).cast("int").alias("importance_score"), F.col("l_returnflag").alias("citation_type"), F.lit(None).cast("string").alias("context"))
    lines = lines.select("l_orderkey", F.struct("place", entity.alias("entity"), cited.alias("cited")).alias("said"), F.when(F.col("next").isNotNull(), F.struct("place", relation.alias("relation"))).alias("related"))  # the last line has no next one
    told = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("said")).alias("said"), F.sort_array(F.collect_list("related")).alias("related"))
    return table("orders").join(told, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("P"), "o_custkey").alias("paper_id"), F.col("o_orderpriority").alias("paper_summary"), F.array("o_orderstatus", "o_orderpriority").alias("claims"),
        F.col("said.entity").alias("entities"), F.col("related.relation").alias("relations"), F.col("said.cited").alias("cited_papers"),
    )


LINES = f"""lines AS (SELECT l_orderkey AS seq, row_number() OVER w - 1 AS place, 'P' || o_custkey AS paper_id, l_partkey, l_linestatus AS description, l_quantity, l_returnflag,
  CASE l_returnflag WHEN 'A' THEN 'Method' WHEN 'N' THEN 'Dataset' ELSE 'Task' END AS type, 'Thing ' || (l_suppkey % 40) AS name, 'Thing ' || (lead(l_suppkey) OVER w % 40) AS target, l_linestatus
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_ORDER})),
ents AS (SELECT *, substr(sha256(lower(type) || ':' || lower(name)), 1, 16) AS id, substr(sha256('title nr ' || l_partkey), 1, 16) AS cited FROM lines),
named AS (SELECT seq, name, arg_max(id, place) AS id FROM ents GROUP BY ALL),
resolved AS (SELECT e.seq, e.paper_id, a.id AS src, b.id AS dst, 'USES' AS type FROM ents e JOIN named a ON a.seq = e.seq AND a.name = e.name JOIN named b ON b.seq = e.seq AND b.name = e.target WHERE l_linestatus = 'F' AND l_quantity <= 25)
"""


@R.add("upsert_papers", G + """, new AS (SELECT 'P' || o_custkey * 3 AS id, arg_max('New ' || o_orderpriority, o_orderkey) AS title FROM orders GROUP BY 1)
SELECT id, coalesce(n.title, p.title) AS title FROM paper p FULL JOIN new n USING (id)""")
def upsert_papers(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("P"), F.col("o_custkey") * 3).alias("id"), F.concat(F.lit("New "), "o_orderpriority").alias("title"), F.col("o_orderkey").alias("seq"))
    return upserts.upsert_papers(graph_fixture.load(spark, d).paper, rows).select("id", "title")


@R.add("upsert_dates", G + """, new AS (SELECT 'P' || o_custkey * 3 AS id, arg_max(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), o_orderkey) AS day FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT id, coalesce(day, published_date) AS published_date FROM paper LEFT JOIN new USING (id)""")
def upsert_dates(spark, d):
    day = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("P"), F.col("o_custkey") * 3).alias("id"), day.alias("published_date"), F.col("o_orderkey").alias("seq"))
    return upserts.upsert_dates(graph_fixture.load(spark, d).paper, rows).select("id", "published_date")


_CITED = "known AS (SELECT 'P' || o_custkey * 3 AS src, 'X' || (o_orderkey % 50) AS dst, o_orderpriority AS title, o_orderkey AS seq FROM orders WHERE 'P' || o_custkey * 3 IN (SELECT id FROM paper))"


def _cited(spark, d):
    g = graph_fixture.load(spark, d)
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("P"), F.col("o_custkey") * 3).alias("src"), F.concat(F.lit("X"), F.col("o_orderkey") % 50).alias("dst"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("seq"))
    return upserts.upsert_citations(g.paper, g.edge, rows)


@R.add("upsert_citations_titles", G + f", {_CITED} SELECT id, title FROM paper UNION ALL SELECT dst, arg_min(title, seq) FROM known GROUP BY dst")
def upsert_citations_titles(spark, d):
    return _cited(spark, d)[0].select("id", "title")


@R.add("upsert_citations_edges", G + f", {_CITED} SELECT key, importance_score FROM edge UNION ALL SELECT DISTINCT src || '>CITES>' || dst, NULL::INTEGER FROM known")
def upsert_citations_edges(spark, d):
    return _cited(spark, d)[1].select("key", "importance_score")


@R.add("entity_resolve", f"WITH {LINES} SELECT seq, paper_id, src, dst, type FROM resolved")
def entity_resolve(spark, d):
    return upserts.resolved_relations(extractions(spark, d))


def _written(spark, d):
    return upserts.write_extracted(graph_fixture.load(spark, d), extractions(spark, d))


@R.add("write_extracted_papers", G + f""", {LINES}, told AS (SELECT 'P' || o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS summary, arg_max(o_orderstatus || ',' || o_orderpriority, o_orderkey) AS claims FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT id, title, coalesce(t.summary, p.summary) AS summary, claims FROM paper p FULL JOIN told t USING (id) UNION ALL SELECT DISTINCT cited, 'Title  Nr ' || l_partkey, NULL, NULL FROM ents""")
def write_extracted_papers(spark, d):
    return _written(spark, d).paper.select("id", "title", "summary", F.array_join("claims", ",").alias("claims"))


@R.add("write_extracted_entities", G + f", {LINES} SELECT id, type, name, description FROM entity UNION ALL SELECT id, arg_max(type, (seq, place)), arg_max(name, (seq, place)), arg_max(description, (seq, place)) FROM ents GROUP BY id")
def write_extracted_entities(spark, d):
    return _written(spark, d).entity


@R.add("write_extracted", G + f""", {LINES} SELECT key, importance_score, citation_type FROM edge UNION ALL SELECT DISTINCT paper_id || '>MENTIONS>' || id, NULL::INTEGER, NULL::VARCHAR FROM ents
UNION ALL SELECT DISTINCT src || '>USES>' || dst, NULL::INTEGER, NULL::VARCHAR FROM resolved
UNION ALL SELECT paper_id || '>CITES>' || cited, CAST(arg_max(1 + l_partkey % 5, (seq, place)) AS INTEGER), arg_max(l_returnflag, (seq, place)) FROM ents GROUP BY paper_id, cited""")
def write_extracted(spark, d):
    return _written(spark, d).edge.select("key", "importance_score", "citation_type")


@R.add("adhoc_graph_query", G + "SELECT p.id, p.title, count(*) AS mentions FROM paper p JOIN edge m ON m.src = p.id AND m.type = 'MENTIONS' JOIN entity e ON e.id = m.dst WHERE e.name LIKE '%0%' GROUP BY p.id, p.title")
def adhoc_graph_query(spark, d):
    sql = "SELECT p.id, p.title, count(*) AS mentions FROM paper p JOIN edge m ON m.src = p.id AND m.type = :kind JOIN entity e ON e.id = m.dst WHERE contains(e.name, :part) GROUP BY p.id, p.title"
    return adhoc.run(graph_fixture.load(spark, d), sql, kind="MENTIONS", part="0")


@R.add("adhoc_subgraph", G + "SELECT DISTINCT id FROM (SELECT unnest([src, dst]) AS id FROM edge WHERE type = 'EXTENDS')")
def adhoc_subgraph(spark, d):
    g = graph_fixture.load(spark, d)
    return adhoc.subgraph(g, g.edge.where("type = 'EXTENDS'").select("key"))[0].select("id")


@R.add("src_dataset_load", "WITH t AS (SELECT doc_id AS seq, split_part(text, chr(10), 1) AS title FROM documents), k AS (SELECT *, trim(regexp_replace(nfc_normalize(lower(title)), '\\s+', ' ', 'g')) AS norm FROM t) SELECT substr(sha256(norm), 1, 16) AS paper_id, arg_min(title, seq) AS title FROM k WHERE norm <> '' GROUP BY norm")
def src_dataset_load(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("seq"), F.substring_index("text", "\n", 1).alias("target_paper"), F.lit(None).cast("array<string>").alias("references"), F.lit(None).cast("string").alias("paper_local_path"))
    return files.dataset_papers(rows).select("paper_id", "title")


@R.add("source_fallback", "SELECT 'P' || p_partkey AS paper_id, CASE WHEN p_size < 10 THEN 'cache' WHEN p_size < 30 THEN 'arxiv' WHEN p_size < 45 THEN 's2' END AS source FROM part WHERE p_size < 45")
def source_fallback(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("P"), "p_partkey").alias("paper_id"), F.col("p_name").alias("location"), "p_size")
    return files.first_of_sources([("cache", part.where("p_size < 10")), ("arxiv", part.where("p_size < 30")), ("s2", part.where("p_size < 45"))]).select("paper_id", "source")


@R.add("title_match_s2", "SELECT n_name AS query, lower(n_name) || '!' AS title FROM nation WHERE n_nationkey % 7 < 5")
def title_match_s2(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    asked = nation.select(F.col("n_name").alias("query"))
    hit = nation.select(F.col("n_name").alias("query"), (F.col("n_nationkey") % 7 + 1).alias("n"), F.concat(F.lower("n_name"), F.lit("!")).alias("title"))
    miss = nation.select("n_name", F.lit(1), F.lit("another title"))
    return files.matched_titles(asked, hit.unionAll(miss))


@R.add("reference_number_join", """SELECT 'P' || p_partkey AS paper_id, CAST(1 + p_partkey % 4 AS INTEGER) AS number, CASE p_partkey % 4 WHEN 0 THEN 'A. One, ' || p_name WHEN 1 THEN 'B. Two, ' || p_brand
WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'thebibliography' ELSE 'C. Three, ' || p_type || '. thebibliography' END END AS entry FROM part""")
def reference_number_join(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    last = F.when(F.col("p_size") % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" C. Three, "), "p_type", F.lit(".")))
    bbl = F.concat(F.lit("\\begin{thebibliography}{9}\n\\bibitem{a} A. One, \\emph{"), "p_name", F.lit("}\n\\bibitem[x]{b} B. Two,~"), "p_brand", F.lit("\n\\bibitem{c}"), last, F.lit("\n\\end{thebibliography} after"))
    refs = part.select(F.concat(F.lit("P"), "p_partkey").alias("paper_id"), (1 + F.col("p_partkey") % 4).cast("int").alias("number"), T.numbered_references(bbl).alias("refs"))
    return refs.select("paper_id", "number", F.get("refs", F.col("number") - 1).alias("entry"))


@R.add("batch_assign", "SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_partkey) - 1) // 1000 AS BIGINT) AS batch FROM part")
def batch_assign(spark, d):
    return upserts.batches(spark.read.parquet(f"{d}/part.parquet").select("p_partkey"), "p_partkey", 1000)
