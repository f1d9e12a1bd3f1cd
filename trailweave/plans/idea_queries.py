"""Parsers of ideas, texts for papers, and files of results, over texts made of parts and nations."""

from __future__ import annotations

import io
import tarfile

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import ideas as I
from ..sources import files, graph_fixture, keyed_files
from ..sources.tables import scratch, written
from ._registry import Registry

R = Registry()


def _part(spark, d):
    return spark.read.parquet(f"{d}/part.parquet")


def _text(*pieces: str) -> F.Column:
    """Column names in braces, all else as it is."""
    return F.concat(*(F.col(x[1:-1]) if x.startswith("{") else F.lit(x) for x in pieces))


@R.add("extract_section", "SELECT p_partkey, p_type || ' more of ' || p_brand AS method, CASE WHEN p_partkey % 2 = 0 THEN 'it fails' ELSE 'none' END AS risk FROM part")
def extract_section(spark, d):
    text = F.concat(_text("# Idea\nMethod: ", "{p_type}", "\n\n  more of ", "{p_brand}", " \nNext:\nMethod: no\n"), F.when(F.col("p_partkey") % 2 == 0, "## Risk\n it fails").otherwise(""))
    return _part(spark, d).select("p_partkey", I.section(text, ("method", "approach")).alias("method"), I.section(text, ("risk",), "none").alias("risk"))


@R.add("extract_list_items", "SELECT p_partkey, p_brand || '|' || p_type AS items, 'See experiment plan' AS others FROM part")
def extract_list_items(spark, d):
    text = _text("Plan\nDatasets:\n- ", "{p_brand}", "\nwords\n * ", "{p_type}", " \n")
    return _part(spark, d).select("p_partkey", F.array_join(I.list_items(text, ("dataset",)), "|").alias("items"), F.array_join(I.list_items(text, ("metric",)), "|").alias("others"))


@R.add("papers_from_chain", "SELECT p_partkey, p_name || '|Paper on ' || p_type AS papers FROM part")
def papers_from_chain(spark, d):
    text = _text('1. see: "', "{p_name}", '"\n2) Paper on ', "{p_type}", '\nStep 3: go on with it\nagain: "', "{p_name}", '"')
    return _part(spark, d).select("p_partkey", F.array_join(I.papers_from_chain(text), "|").alias("papers"))


@R.add("parse_entities", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || '|' || p_type WHEN 1 THEN p_type || '|' || p_brand ELSE p_type END AS names FROM part")
def parse_entities(spark, d):
    text = F.element_at(F.array(_text("- ", "{p_brand}", "\n* ", "{p_type}", "\n- ", "{p_brand}"), _text("{p_type}", " , ", "{p_brand}", ","), _text("{p_type}")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return _part(spark, d).select("p_partkey", F.array_join(I.entity_names(text), "|").alias("names"))


@R.add("title_from_idea", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE p_brand || ' comes first' END AS title FROM part")
def title_from_idea(spark, d):
    text = F.element_at(F.array(_text("words\n Title: ", "{p_name}", "\n# no"), _text("words\n## ", "{p_type}"), _text("\n ", "{p_brand}", " comes first\nthen more")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return _part(spark, d).select("p_partkey", I.title_from_idea(text).alias("title"))


@R.add("chain_mermaid", "SELECT p_partkey, 'graph LR' || chr(10) || '  N0[\"' || p_brand || ' (x)\"]' || chr(10) || '  N1[\"then ' || p_type[1:35] || '\"]' || chr(10) || '  N0 --> N1' AS said FROM part")
def chain_mermaid(spark, d):
    return _part(spark, d).select("p_partkey", I.chain_mermaid(_text("1. ", "{p_brand}", " [x]\n\n2) then ", "{p_type}", "\nno")).alias("said"))


@R.add("download_metadata", """SELECT o_orderkey, '{"published_date":' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '"' END || '}' AS metadata FROM orders""")
def download_metadata(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", I.metadata_json(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))).alias("metadata"))


_TEXTS = f"""WITH ents AS (SELECT DISTINCT s_nationkey, s_name FROM supplier)
SELECT 'N' || n_nationkey AS paper_id, CASE n_nationkey % 3 WHEN 0 THEN 'tex of ' || n_name || chr(10) || chr(10) || 'bib' WHEN 1 THEN concat_ws(chr(10) || chr(10), '{I.NOTE}', 'Paper summary:' || chr(10) || n_name,
  'Key methods/approaches:' || (SELECT string_agg(chr(10) || '- ' || s_name, '' ORDER BY s_name) FROM ents WHERE s_nationkey = n_nationkey), 'Key entities:' || (SELECT string_agg(chr(10) || '- ' || s_name || ' (Method): ' || s_name, '' ORDER BY s_name) FROM ents WHERE s_nationkey = n_nationkey)) END AS text,
  CASE n_nationkey % 3 WHEN 0 THEN 'latex' WHEN 1 THEN 'extraction' END AS origin FROM nation"""


@R.add("paper_text_fallback", _TEXTS)
def paper_text_fallback(spark, d):
    nation, supplier = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "supplier"))
    key = F.concat(F.lit("N"), "n_nationkey").alias("paper_id")
    latex = nation.where("n_nationkey % 3 = 0").select(key, F.concat(F.lit("tex of "), "n_name").alias("latex"), F.lit("bib").alias("bbl"))
    own = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_set(F.struct(F.col("s_name").alias("name"), F.lit("Method").alias("type"), F.col("s_name").alias("description")))).alias("entities"))
    cited = F.array().cast("array<struct<title: string, reference_number: int, citation_type: string>>")
    found = nation.where("n_nationkey % 3 < 2").join(own, "n_nationkey", "left").select(key, F.col("n_name").alias("paper_summary"), F.array().cast("array<string>").alias("claims"), "entities", cited.alias("cited_papers"))
    return files.paper_texts(nation.select(key), latex, found)


def _files(rows, path):
    rows.write.partitionBy("n_nationkey").text(path)
    return path


@R.add("cache_replay", """SELECT 'processed' AS name, count(*) AS n FROM nation UNION ALL SELECT 'not JSON', 1 UNION ALL SELECT 'claims: missing', 1 UNION ALL SELECT 'entities: a wrong value', 1
UNION ALL SELECT 'entities', (SELECT count(*) FROM supplier) + 2 * count(*) + (SELECT count(*) FROM region) FROM nation UNION ALL SELECT 'limited', 7 UNION ALL SELECT 'title of X3', (SELECT length('Title of ' || n_name) FROM nation WHERE n_nationkey = 3)""")
def cache_replay(spark, d):
    """An extraction for each nation in a file of its own, and files that are none."""
    entity = F.array(F.struct(F.lit("Task").alias("type"), F.concat(F.lit("use of "), "n_name").alias("name")))
    nation = spark.read.parquet(f"{d}/nation.parquet")
    good = nation.select("n_nationkey", F.to_json(F.struct(F.concat(F.lit("X"), "n_nationkey").alias("paper_id"), F.col("n_name").alias("paper_summary"), F.array().cast("array<string>").alias("claims"), entity.alias("entities"))).alias("value"))
    bad = [(-1, "{bad"), (-2, '{"paper_summary": "s", "entities": []}'), (-3, '{"paper_summary": "s", "claims": [], "entities": [{"type": "T", "name": 3}]}')]
    path = _files(good.unionByName(spark.createDataFrame(bad, "n_nationkey int, value string")), scratch(spark, "files"))
    papers = nation.select(F.concat(F.lit("X"), "n_nationkey").alias("paper_id"), F.concat(F.lit("Title of "), "n_name").alias("title"))
    graph, counts = files.replayed(graph_fixture.load(spark, d), spark, path, papers=papers)
    some = files.replayed(graph_fixture.load(spark, d), spark, path, limit=7)[1].agg(F.lit("limited").alias("name"), F.sum("n").alias("n"))
    rows = counts.select(F.coalesce("cause", F.lit("processed")).alias("name"), "n")
    title = graph.paper.where("id = 'X3'").select(F.lit("title of X3"), F.length("title").cast("bigint"))
    return rows.unionAll(graph.entity.select(F.lit("entities"), F.col("id")).groupBy("entities").count()).unionAll(some).unionAll(title)


def _folder(spark):
    return scratch(spark, "files")


@R.add("extraction_cache", "SELECT 'P' || s_suppkey AS paper_id, s_name AS paper_summary, CAST(1 AS INTEGER) AS entities FROM supplier WHERE s_suppkey % 7 > 0 AND s_suppkey % 11 > 0")
def extraction_cache(spark, d):
    """Extractions written to files of their own and read again; those of an old version, and what isn't JSON, are left out."""
    path, supplier = _folder(spark), spark.read.parquet(f"{d}/supplier.parquet")
    entity = F.array(F.struct(F.lit("Method").alias("type"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("description")))
    found = supplier.select(F.concat(F.lit("P"), "s_suppkey").alias("paper_id"), F.col("s_name").alias("paper_summary"), F.array().cast("array<string>").alias("claims"), entity.alias("entities"))
    files.write_extractions(found, path)
    broken = F.when(F.col("s_suppkey") % 7 == 0, F.to_json(F.struct(F.col("s_name").alias("paper_id"), F.lit(1).alias("_cache_version")))).otherwise("{")
    keyed_files.write(supplier.where("s_suppkey % 7 = 0 or s_suppkey % 11 = 0").select(F.concat(F.lit("P"), "s_suppkey", F.lit(".json")).alias("key"), broken.alias("content")), path)
    return files.extractions(spark, path).select("paper_id", "paper_summary", F.size("entities").alias("entities"))


def _archives(rows):
    """Archives (key, content) of the files of each paper: rows (paper_id, files), each a list of name and body."""

    def archive(files):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for f in sorted(files, key=lambda f: f["name"]):
                body = f["body"].encode()
                info = tarfile.TarInfo(f["name"])
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
        return out.getvalue()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([f"{p}.tar.gz" for p in batch.column("paper_id").to_pylist()], pa.string()), pa.array(map(archive, batch.column("files").to_pylist()), pa.binary())], ["key", "content"])

    return rows.repartition("paper_id").mapInArrow(run, "key string, content binary")


def _papers(spark, d):
    """A folder with an archive for every other supplier, PDFs (some of them none), and metadata for every third."""
    path, supplier = _folder(spark), spark.read.parquet(f"{d}/supplier.parquet").withColumn("paper_id", F.concat(F.lit("P"), "s_suppkey"))
    body = lambda name, text: F.struct(F.lit(name).alias("name"), text.alias("body"))
    own = F.array(body("long.tex", F.repeat(F.lit("x"), 99)), body("r.bbl", F.concat(F.lit("\\bibitem{a} By \\emph{"), "s_name", F.lit("}"))), F.when(F.col("s_suppkey") % 4 == 0, body("src/main.tex", F.concat(F.lit("tex of "), "s_name"))))
    keyed_files.write(_archives(supplier.where("s_suppkey % 2 = 0").select("paper_id", F.filter(own, lambda x: x.isNotNull()).alias("files"))), path)
    pdf = F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.lit("%PDF-1 "), "s_name")).otherwise("no document")
    keyed_files.write(supplier.select(F.concat("paper_id", F.lit(".pdf")).alias("key"), pdf.alias("content")), path)
    keyed_files.write(supplier.where("s_suppkey % 3 = 0").select(F.concat("paper_id", F.lit(".json")).alias("key"), F.to_json(F.struct(F.lit("2020-02-03T00:00:00").alias("published_date"))).alias("content")), path)
    return path


@R.add("src_paper_files", """SELECT 'P' || s_suppkey AS paper_id, CASE WHEN s_suppkey % 2 = 0 THEN 'latex' ELSE 'pdf' END AS kind, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE '%PDF-1 ' || s_name END AS pdf, CASE WHEN s_suppkey % 3 = 0 THEN '2020-02-03T00:00:00' END AS published_date
FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 5 > 0""")
def src_paper_files(spark, d):
    found = files.paper_files(spark, _papers(spark, d))
    return found.select("paper_id", "kind", F.when(F.col("kind") == "pdf", F.col("content").cast("string")).alias("pdf"), "published_date")


@R.add("src_latex_tar", """SELECT 'P' || s_suppkey AS paper_id, CASE WHEN s_suppkey % 4 = 0 THEN 'tex of ' || s_name ELSE repeat('x', 99) END AS latex, '[1] By ' || s_name || chr(10) || chr(10) || CASE WHEN s_suppkey % 4 = 0 THEN 'tex of ' || s_name ELSE repeat('x', 99) END AS message FROM supplier WHERE s_suppkey % 2 = 0""")
def src_latex_tar(spark, d):
    latex = written(files.latex_sources(files.paper_files(spark, _papers(spark, d)).where("kind = 'latex'")))
    return latex.select("paper_id", "latex").join(files.messages(latex), "paper_id")


@R.add("idea_results", "SELECT n_name AS idea, CASE n_nationkey % 2 WHEN 0 THEN 'a|' || n_name ELSE 'x|y' END AS experiments, CASE n_nationkey % 2 WHEN 0 THEN 'e1;e2' ELSE n_name END AS entities, '' AS trend FROM nation")
def idea_results(spark, d):
    value = F.when(F.col("n_nationkey") % 2 == 0, F.to_json(F.struct(F.col("n_name").alias("idea"), F.array(F.lit("a"), F.col("n_name")).alias("related_experiments"), F.array(F.lit("e1"), F.lit("e2")).alias("entities"))))
    value = value.otherwise(F.to_json(F.struct(F.col("n_name").alias("idea"), F.lit("x\n\n y").alias("related_experiments"), F.col("n_name").alias("entities"))))
    path = _files(spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", value.alias("value")), scratch(spark, "files"))
    return files.idea_results(spark, path).select("idea", F.array_join("related_experiments", "|").alias("experiments"), F.replace("entities", F.lit("\n"), F.lit(";")).alias("entities"), "trend")
