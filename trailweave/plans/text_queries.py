"""Text functions over titles, texts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lookups as L
from ._registry import Registry

R = Registry()


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


_NORM = "trim(regexp_replace(nfc_normalize(lower(text)), '\\s+', ' ', 'g'))"


@R.add("normalize_title", f"SELECT doc_id, {_NORM} AS title FROM documents")
def normalize_title(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.normalize_title(F.col("text")).alias("title"))


@R.add("paper_id", f"SELECT item_id, substr(sha256({_NORM}), 1, 16) AS paper_id FROM benchmark")
def paper_id(spark, d):
    return _table(spark, d, "benchmark").select("item_id", T.paper_id(F.col("text")).alias("paper_id"))


@R.add("entity_id", "SELECT p_partkey, substr(sha256(lower(p_brand) || ':' || lower(p_name)), 1, 16) AS id FROM part")
def entity_id(spark, d):
    return _table(spark, d, "part").select("p_partkey", T.entity_id(F.col("p_brand"), F.col("p_name")).alias("id"))


@R.add("title_match_key", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_brand || ' - ' || p_name), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM part")
def title_match_key(spark, d):
    return _table(spark, d, "part").select("p_partkey", T.title_match_key(F.concat_ws(" - ", "p_brand", "p_name")).alias("key"))


@R.add("strip_latex", "SELECT p_partkey, 'On ' || p_name || ' and its use' || CASE p_size % 3 WHEN 0 THEN ' S ' || p_brand WHEN 1 THEN ' q' ELSE '' END AS title FROM part")
def strip_latex(spark, d):
    raw = F.concat(F.lit("% note\n\\textbf{On} \\emph{"), "p_name", F.lit("}~{and}\\newline its   \\cite[p. 3]{use}"))
    direct = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("\\newline\\section*{S} "), "p_brand")).when(F.col("p_size") % 3 == 1, "\\a\\b{q}").otherwise("\\par\\newpage")
    raw = F.concat(raw, direct)
    return _table(spark, d, "part").select("p_partkey", T.strip_latex(raw).alias("title"))


@R.add("title_from_reference", "SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE 'A study of ' || p_name END AS title FROM part")
def title_from_reference(spark, d):
    title = F.concat(F.lit("A study of "), "p_name")
    entry = F.element_at(F.array(F.concat(F.lit('A. One, "'), title, F.lit('." 2020.')), F.concat(F.lit("B. Two. "), title, F.lit(". In Proceedings of X.")), F.concat(F.lit("C. Three. "), title, F.lit(". 2019.")), F.lit("no title here")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _table(spark, d, "part").select("p_partkey", T.title_from_reference(entry).alias("title"))


@R.add("looks_like_citation", "SELECT doc_id, coalesce(length(t) >= 140 OR regexp_matches(lower(t), 'arxiv|proceedings|journal|doi') OR (regexp_matches(t, '\\b(19|20)\\d{2}\\b') AND (length(t) - length(replace(t, ',', '')) >= 2 OR length(t) - length(replace(t, '.', '')) >= 4)), false) AS is_citation FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents)")
def looks_like_citation(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.looks_like_citation(F.col("text")).alias("is_citation"))


@R.add("safe_id", "SELECT page_id, replace(replace(url, '/', '_'), ':', '_') AS id FROM pages")
def safe_id(spark, d):
    return _table(spark, d, "pages").select("page_id", T.safe_id(F.col("url")).alias("id"))


@R.add("idea_id", "SELECT p_partkey, 'idea_' || p_partkey || '_' || regexp_replace((p_name || ' ' || p_brand || ' ' || p_type)[1:30], '[^a-zA-Z0-9]', '_', 'g') AS id FROM part")
def idea_id(spark, d):
    return _table(spark, d, "part").select("p_partkey", T.idea_id(F.col("p_partkey"), F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("id"))


@R.add("mermaid_sanitize", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '[\"''\\[\\](){}|<>`:;\\n\\r\\t]', ' ', 'g'), '\\s+', ' ', 'g')) AS label FROM pages")
def mermaid_sanitize(spark, d):
    return _table(spark, d, "pages").select("page_id", T.mermaid_sanitize(F.col("html")).alias("label"))


@R.add("truncate_label", "SELECT p_partkey, CASE WHEN length(p_name) > 12 THEN rtrim(p_name[1:9]) || '...' ELSE p_name END AS label, p_name[1:3] AS short FROM part")
def truncate_label(spark, d):
    return _table(spark, d, "part").select("p_partkey", T.truncate_label(F.col("p_name"), 12).alias("label"), T.truncate_label(F.col("p_name"), 3).alias("short"))


@R.add("escape_html", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def escape_html(spark, d):
    return _table(spark, d, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


@R.add("split_ids", "SELECT p_partkey, p_name || '|' || p_brand AS ids FROM part")
def split_ids(spark, d):
    ids = T.split_ids(F.concat(F.lit(" "), "p_name", F.lit(" ,, "), "p_brand", F.lit(",")))
    return _table(spark, d, "part").select("p_partkey", F.array_join(ids, "|").alias("ids"))


@R.add("list_join", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS said FROM orders GROUP BY 1")
def list_join(spark, d):
    return _table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ").alias("said"))


@R.add("fixed1", "SELECT o_orderkey, printf('%.1f', o_totalprice) AS price FROM orders")
def fixed1(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", T.fixed1(F.col("o_totalprice")).alias("price"))


@R.add("relation_type_valid", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'USES_' || p_partkey WHEN 1 THEN NULL ELSE 'X' END AS kind FROM part")
def relation_type_valid(spark, d):
    raw = F.element_at(F.array(F.concat(F.lit("  uses_"), F.col("p_partkey").cast("string"), F.lit("\n")), F.lit("part of"), F.lit("x")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return _table(spark, d, "part").select("p_partkey", T.relation_type(raw).alias("kind"))


@R.add("unique_sorted", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag || ' ' || l_linestatus))), ',') AS said FROM lineitem GROUP BY 1")
def unique_sorted(spark, d):
    raw = F.collect_list(F.concat(F.lit(" "), "l_returnflag", F.lit("  "), "l_linestatus"))
    return _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(T.unique_sorted(F.concat(raw, F.array(F.lit(" ")))), ",").alias("said"))


@R.add("distinct_dedupe", "SELECT p_partkey, CASE WHEN p_name = p_brand THEN p_name ELSE p_name || '|' || p_brand END AS said FROM part")
def distinct_dedupe(spark, d):
    return _table(spark, d, "part").select("p_partkey", F.array_join(F.array_distinct(F.array("p_name", "p_brand", "p_name")), "|").alias("said"))


@R.add("published_day", "SELECT o_orderkey, o_orderdate AS day FROM orders")
def published_day(spark, d):
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.element_at(F.array(F.lit("Z"), F.lit("+09:00"), F.lit("")), (F.col("o_orderkey") % 3 + 1).cast("int")))
    return _table(spark, d, "orders").select("o_orderkey", T.published_day(text).alias("day"))


@R.add("direct_caps", """SELECT l_suppkey, array_to_string(['- P' || p || CASE p % 2 WHEN 0 THEN ' (Method)' ELSE ' (Entity)' END FOR p IN list_sort(list_distinct(list(l_partkey)))[1:20]], chr(10)) AS entities,
array_to_string(['- ' || q FOR q IN list_sort(list_distinct(list(CAST(floor(l_quantity) AS INTEGER))))[1:10]], chr(10)) AS claims FROM lineitem GROUP BY 1""")
def direct_caps(spark, d):
    found = _table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"), F.array_sort(F.collect_set(F.floor("l_quantity").cast("int"))).alias("said"))
    entities = F.transform("parts", lambda p: F.struct(F.concat(F.lit("P"), p.cast("string")).alias("name"), F.when(p % 2 == 0, "Method").alias("type")))
    return found.select("l_suppkey", *L.direct_lines(entities, F.transform("said", lambda x: x.cast("string"))))


@R.add("path_mermaid", "SELECT p_partkey, 'graph RL' || chr(10) || '  N0[' || CASE WHEN length(t) > 30 THEN t[1:30] || '...' ELSE t END || ']' || chr(10) || '  N1[' || p_brand || ']' || chr(10) || '  N0 --> N1' AS said FROM (SELECT *, p_name || ' ' || p_type AS t FROM part)")
def path_mermaid(spark, d):
    names = F.array(F.concat_ws(" ", "p_name", "p_type"), F.col("p_brand"))
    return _table(spark, d, "part").select("p_partkey", T.path_mermaid(names).alias("said"))


@R.add("type_fields", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Paper' WHEN 1 THEN n_name ELSE 'Entity' END AS kind FROM nation")
def type_fields(spark, d):
    from ..operators import context as C

    node = F.struct(F.when(F.col("n_nationkey") % 3 == 0, "Paper").otherwise("Entity").alias("label"), F.when(F.col("n_nationkey") % 3 == 1, F.col("n_name")).otherwise("").alias("entity_type"))
    return _table(spark, d, "nation").select("n_nationkey", C.node_kind(node).alias("kind"))


@R.add("truthy_merge", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END, '') END, o_orderpriority) AS value FROM orders")
def truthy_merge(spark, d):
    value = F.when(F.col("o_orderkey") % 2 == 0, None).when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus"))
    return _table(spark, d, "orders").select("o_orderkey", L.truthy(value, "o_orderpriority").alias("value"))
