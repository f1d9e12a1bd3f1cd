"""Progress, crawls, saved documents and streams over events, orders and the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crawl as K
from ..operators import documents as D
from ..operators import lookups as L
from ..operators import progress as G
from ..sources import graph_fixture
from ..sources.tables import delete, scratch, written
from ..streaming import ingest, status
from ._registry import Registry
from .write_queries import LINES, extractions

R = Registry()
GRAPH = graph_fixture.SQL

PROGRESS = """updates AS (SELECT 'P' || user_id AS paper_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'downloading' WHEN 'click' THEN 'extracting' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status, props AS error, ts, event_id AS seq FROM events),
state AS (SELECT paper_id, arg_max(status, (ts, seq)) AS status, arg_max(error, (ts, seq)) AS error, min(ts) FILTER (WHERE status = 'downloading') AS started_at, min(ts) FILTER (WHERE status = 'completed') AS completed_at FROM updates GROUP BY 1),
papers AS (SELECT 'P' || c_custkey AS paper_id, CASE WHEN c_custkey % 3 = 0 THEN 'citation' ELSE 'dataset' END AS source, coalesce(status, 'pending') AS status, CASE WHEN status = 'failed' THEN error END AS error_message, started_at, completed_at FROM customer LEFT JOIN state ON paper_id = 'P' || c_custkey)
"""


def _registered(spark, d):
    source = F.when(F.col("c_custkey") % 3 == 0, "citation").otherwise("dataset")
    return spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("P"), "c_custkey").alias("paper_id"), source.alias("source"))


def _papers(spark, d):
    state = G.folded(ingest.updates_of(spark.read.parquet(f"{d}/events.parquet")))
    return G.current(_registered(spark, d), state)


_STATE = "SELECT paper_id, source, status, error_message, started_at, completed_at FROM papers"


@R.add("progress_state", f"WITH {PROGRESS} {_STATE}")
def progress_state(spark, d):
    return _papers(spark, d)


@R.add("progress_stream", f"WITH {PROGRESS} {_STATE}")
def progress_stream(spark, d):
    """As ``progress_state``, from a stream of the events' files."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    path = scratch(spark, "streams")
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/[e]vents.parquet")
    status.track(ingest.updates_of(events), path).awaitTermination()
    return G.current(_registered(spark, d), status.state(spark, path, times=schema["ts"].dataType.simpleString()))


@R.add("progress_summary", f"""WITH {PROGRESS} SELECT source, count(*) AS total_known, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'not_found') AS not_found,
count(*) FILTER (WHERE status IN ('downloading', 'extracting', 'writing')) AS in_progress, count(*) FILTER (WHERE status = 'pending') AS pending FROM papers GROUP BY ROLLUP (source)""")
def progress_summary(spark, d):
    return G.summary(_papers(spark, d))


@R.add("progress_dataset", f"""WITH {PROGRESS}, s AS (SELECT count(*) FILTER (WHERE status = 'completed') AS processed, count(*) FILTER (WHERE status IN ('failed', 'not_found')) AS failed FROM papers WHERE source = 'dataset')
SELECT CAST(900 AS BIGINT) AS total, processed, failed, greatest(0, 900 - processed - failed) AS pending FROM s""")
def progress_dataset(spark, d):
    return G.dataset_summary(_papers(spark, d), 900)


@R.add("completed_skip", f"WITH {PROGRESS} SELECT paper_id FROM papers WHERE status <> 'completed'")
def completed_skip(spark, d):
    papers = _papers(spark, d)
    return G.left_to_do(papers.select("paper_id"), papers.where("status = 'completed'"))


@R.add("status_classify", "SELECT event_id, CASE WHEN event_type = 'error' AND event_id % 3 < 2 THEN 'not_found' ELSE 'failed' END AS status FROM events")
def status_classify(spark, d):
    message = F.when(F.col("event_type") == "error", F.element_at(F.array(F.lit("Paper Not Found: x"), F.lit("No open access PDF"), F.lit("timeout")), (F.col("event_id") % 3 + 1).cast("int")))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", G.classified(message).alias("status"))


_TOP = f"""{GRAPH}, ranked AS (SELECT src, dst, coalesce(importance_score, 3) AS importance, row_number() OVER (PARTITION BY src ORDER BY coalesce(importance_score, 3) DESC, dst) AS place FROM edge WHERE type = 'CITES'),
top AS (SELECT * FROM ranked WHERE place <= 3), seeds AS (SELECT id FROM paper WHERE id IN ('P1', 'P2', 'P3')),
l1 AS (SELECT dst AS id, 1 AS depth, max(importance) AS importance FROM top WHERE src IN (SELECT id FROM seeds) AND dst NOT IN (SELECT id FROM seeds) GROUP BY dst),
l2 AS (SELECT dst AS id, 2 AS depth, max(importance) AS importance FROM top WHERE src IN (SELECT id FROM l1) AND dst NOT IN (SELECT id FROM seeds UNION SELECT id FROM l1) GROUP BY dst),
l3 AS (SELECT dst AS id, 3 AS depth, max(importance) AS importance FROM top WHERE src IN (SELECT id FROM l2) AND dst NOT IN (SELECT id FROM seeds UNION SELECT id FROM l1 UNION SELECT id FROM l2) GROUP BY dst),
crawl AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)
"""


def _top(spark, d):
    cited = L.citations_ranked(graph_fixture.load(spark, d)).select(F.col("paper_id").alias("src"), F.col("cited_id").alias("dst"), "importance")
    return written(K.top_citations(cited, 3))  # each level of a crawl reads it


@R.add("crawl_bfs", f"WITH {_TOP} SELECT id, depth, importance FROM crawl")
def crawl_bfs(spark, d):
    return K.by_levels(spark.createDataFrame([("P1",), ("P2",), ("P3",)], "id string"), _top(spark, d), 3)


@R.add("visited_difference", f"WITH {_TOP} SELECT id FROM paper WHERE id NOT IN (SELECT id FROM crawl)")
def visited_difference(spark, d):
    seen = crawl_bfs(spark, d).select("id")
    return graph_fixture.load(spark, d).paper.select("id").join(seen, "id", "left_anti")


def _crawl(spark, d):
    return K.best_first_table(["P1", "P2", "P3"], _top(spark, d), 3, limit=100, completed=frozenset({"P7"}))


@R.add("crawl_priority")
def crawl_priority(spark, d):
    """The best-first order of a crawl: every step depends on those before, so SQL can't express it; tests hold it against brute force."""
    return _crawl(spark, d)


@R.add("crawl_queue")
def crawl_queue(spark, d):
    """How many papers a crawl of up to 100 has visited, and how many it leaves; a test holds it against brute force, as the crawl's order."""
    return K.queue_statistics(_crawl(spark, d), crawl_bfs(spark, d))


@R.add("crawl_stats", f"WITH {_TOP} SELECT CASE WHEN importance >= 5 THEN 'crawled' ELSE 'skipped' END AS status, count(*) AS n FROM crawl GROUP BY 1")
def crawl_stats(spark, d):
    return K.statistics(crawl_bfs(spark, d).select(F.when(F.col("importance") >= 5, "crawled").otherwise("skipped").alias("status")))


@R.add("planned_total", "SELECT n_nationkey AS seeds, CAST(n_nationkey * (3 + 9 + 27) AS BIGINT) AS planned, CAST(7 AS BIGINT) AS limited, CAST(0 AS BIGINT) AS without FROM nation")
def planned_total(spark, d):
    seeds = F.col("n_nationkey")
    return spark.read.parquet(f"{d}/nation.parquet").select(seeds.alias("seeds"), K.planned_total(seeds, 3, 3).alias("planned"), K.planned_total(seeds, 3, 3, 7).alias("limited"), K.planned_total(seeds, 3, 0).alias("without"))


DOCS = """docs AS (SELECT 'D' || (o_orderkey % 3000) AS id, o_orderkey AS seq, 'P' || (o_custkey % 20) AS target_paper_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS saved_at, CAST(o_orderpriority[1] AS INTEGER) AS rating, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS notes,
  CASE WHEN o_orderkey % 3 = 0 THEN 'A' || (o_custkey % 10) END AS analysis_id, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 < 3 THEN o_orderstatus END AS prompt, o_orderstatus AS title, o_orderpriority AS motivation, CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS method,
  CASE WHEN o_orderkey % 2 = 0 THEN [o_orderstatus, o_orderpriority] END AS differences FROM orders),
latest AS (SELECT d.* FROM (SELECT arg_max(docs, (saved_at, seq)) AS d FROM docs GROUP BY id))
"""


def _docs(spark, d):
    key = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(
        F.concat(F.lit("D"), key % 3000).alias("id"), key.alias("seq"), F.concat(F.lit("P"), F.col("o_custkey") % 20).alias("target_paper_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("saved_at"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"), F.when(key % 5 == 0, F.col("o_orderpriority")).alias("notes"), F.when(key % 3 == 0, F.concat(F.lit("A"), F.col("o_custkey") % 10)).alias("analysis_id"),
        F.when(key % 4 == 0, "").when(key % 4 < 3, F.col("o_orderstatus")).alias("prompt"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("motivation"), F.when(key % 7 > 0, F.col("o_orderstatus")).alias("method"),
        F.when(key % 2 == 0, F.array("o_orderstatus", "o_orderpriority")).alias("differences"),
    )


@R.add("doc_list", f"WITH {DOCS} SELECT id, saved_at, seq FROM latest WHERE target_paper_id = 'P7' ORDER BY saved_at DESC, seq DESC LIMIT 50")
def doc_list(spark, d):
    return D.listed(_docs(spark, d), "P7").select("id", "saved_at", "seq")


@R.add("doc_get", f"WITH {DOCS} SELECT id, arg_min(seq, (CASE title WHEN 'O' THEN 1 WHEN 'F' THEN 2 WHEN 'P' THEN 3 END, seq)) AS seq FROM docs WHERE id IN ('D1', 'D2', 'D42', 'nope') GROUP BY id")
def doc_get(spark, d):
    ids = spark.createDataFrame([("D1",), ("D2",), ("D42",), ("nope",)], "id string")
    return D.lookup(_docs(spark, d).withColumn("place", F.col("title")), ids, ("O", "F", "P")).select("id", "seq")


@R.add("doc_update", f"WITH {DOCS} SELECT id, seq, CASE WHEN seq % 2 = 0 THEN 1 ELSE rating END AS rating, CASE WHEN seq % 3 = 0 THEN 'new' ELSE notes END AS notes FROM latest")
def doc_update(spark, d):
    docs = D.latest(_docs(spark, d))
    changes = docs.select("id", F.when(F.col("seq") % 2 == 0, 1).cast("int").alias("rating"), F.when(F.col("seq") % 3 == 0, "new").alias("notes"), F.lit(0).alias("seq"))
    return D.updated(docs, changes).select("id", "seq", "rating", "notes")


@R.add("proposal_groups", f"""WITH {DOCS} SELECT coalesce('analysis:' || nullif(analysis_id, ''), 'prompt:' || nullif(prompt, ''), 'proposal:' || id) AS group_key, count(*) AS proposals, max(saved_at) AS latest, min(seq) AS first_seq FROM docs GROUP BY 1""")
def proposal_groups(spark, d):
    return D.groups(_docs(spark, d))


@R.add("export_markdown", f"""WITH {DOCS}, listed AS (SELECT *, CAST(row_number() OVER (ORDER BY saved_at DESC, seq DESC) AS INTEGER) AS number FROM latest WHERE target_paper_id = 'P7' ORDER BY number LIMIT 50)
SELECT id, number, '## 提案 ' || number || ': ' || title || chr(10) || chr(10) || '- **対象論文**: ' || target_paper_id || chr(10) || '- **評価**: ' || repeat('★', rating) || repeat('☆', 5 - rating) || chr(10)
|| coalesce('- **メモ**: ' || notes || chr(10), '') || '- **保存日時**: ' || saved_at || chr(10) || chr(10) || coalesce('### 生成プロンプト' || chr(10) || '```text' || chr(10) || nullif(prompt, '') || chr(10) || '```' || chr(10) || chr(10), '')
|| '### 動機' || chr(10) || motivation || chr(10) || chr(10) || '### 手法' || chr(10) || coalesce(method, 'N/A') || chr(10) || chr(10)
|| coalesce('### 既存研究との差異' || chr(10) || array_to_string(['- ' || x || chr(10) FOR x IN differences], '') || chr(10), '') || '---' || chr(10) || chr(10) AS markdown FROM listed""")
def export_markdown(spark, d):
    return D.markdown(D.chosen(_docs(spark, d), paper="P7"))


@R.add("export_json", f"WITH {DOCS} SELECT a.id, CAST(a.number AS INTEGER) AS number, l.seq FROM (VALUES (1, 'D9'), (2, 'D4')) a(number, id) JOIN latest l USING (id)")
def export_json(spark, d):
    found = D.exported_json(D.chosen(_docs(spark, d), ["D9", "nope", "D4"]))
    return found.select("id", "number", F.get_json_object("json", "$.seq").cast("bigint").alias("seq"))


def _items(spark, d, text):
    """A stream of files with an extraction's text for each order."""
    path = scratch(spark, "streams")
    found = extractions(spark, d).select("seq", text.alias("value"), F.lit(None).cast("string").alias("paper_id"), F.lit(None).cast("string").alias("published_date"))
    found.write.option("parquet.block.size", ingest.ITEM_BLOCK).parquet(f"{path}/items")
    return path, spark.readStream.schema(ingest.ITEM).option("maxFilesPerTrigger", 4).parquet(f"{path}/items")


def _ingested(spark, d, text):
    path, stream = _items(spark, d, text)
    layers = ingest.start_layers(graph_fixture.load(spark, d), f"{path}/tables")
    writer = ingest.BufferedWriter(layers, extractions=20_000, seconds=60)
    ingest.ingest(stream, writer, f"{path}/checkpoint").awaitTermination()
    writer.close()
    for folder in ("items", "checkpoint"):  # all of it is in the layers
        delete(spark, f"{path}/{folder}")
    return layers


def _text():
    return F.to_json(F.struct("paper_id", "paper_summary", "claims", "entities", "relations", "cited_papers"))


@R.add("ingest_pipeline", f"""WITH {GRAPH}, {LINES} SELECT key FROM edge UNION ALL SELECT DISTINCT paper_id || '>MENTIONS>' || id FROM ents UNION ALL SELECT DISTINCT src || '>USES>' || dst FROM resolved UNION ALL SELECT DISTINCT paper_id || '>CITES>' || cited FROM ents""")
def ingest_pipeline(spark, d):
    """Extractions as a stream of files into the graph's layers."""
    return _ingested(spark, d, _text()).read("edge").select("key")


@R.add("ingest_outcomes", """SELECT CASE WHEN k < 5 THEN 'failed' ELSE 'completed' END AS status, CASE k WHEN 0 THEN 'not JSON' WHEN 1 THEN 'cited_papers: a wrong value' WHEN 2 THEN 'claims: not a list' WHEN 3 THEN 'paper_summary: missing' WHEN 4 THEN 'not an object' END AS cause, count(*) AS n
FROM (SELECT least(o_orderkey % 9, 5) AS k FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY ALL""")
def ingest_outcomes(spark, d):
    """As ``ingest_pipeline``, with wrong extractions among the others: how many were ingested, and failed by cause."""
    k, whole = F.col("seq") % 9, _text()
    text = F.when(k == 0, F.concat(F.lit("{"), whole)).when(k == 1, F.replace(whole, F.lit('"importance_score":'), F.lit('"importance_score":7'))).when(k == 2, F.to_json(F.struct("paper_id", "paper_summary", F.lit("x").alias("claims"))))
    text = text.when(k == 3, F.to_json(F.struct("paper_id", "claims", "entities"))).when(k == 4, F.lit("[1]")).otherwise(whole)
    return ingest.outcomes(_ingested(spark, d, text))
