"""The property graph as views over the star-schema tables: papers are parts, entities suppliers, nations and regions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import written

PAPER, ENTITY = "Paper", "Entity"


@dataclass
class Graph:
    """Node and edge tables.

    paper: id, title, summary, published_date (ISO text).  entity: id, type, name, description.  edge: src, dst, type,
    src_label, dst_label, importance_score, citation_type, context, key.
    """

    paper: DataFrame
    entity: DataFrame
    edge: DataFrame


def edge_key(src: str = "src", kind: str = "type", dst: str = "dst") -> F.Column:
    return F.concat_ws(">", src, kind, dst)


def load(spark: SparkSession, sf_dir: str, dates: bool = True) -> Graph:
    """The graph; without ``dates`` those of papers are null, and what reads papers alone reads no lines."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    part, line = table("part"), table("lineitem")
    first = line.groupBy("l_partkey").agg(F.min("l_shipdate").alias("day"))
    paper = (part.join(first, part.p_partkey == first.l_partkey, "left") if dates else part.withColumn("day", F.lit(None).cast("timestamp"))).select(
        F.concat(F.lit("P"), "p_partkey").alias("id"),
        F.concat_ws(" ", "p_name", "p_brand").alias("title"),
        F.col("p_type").alias("summary"),
        F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss").alias("published_date"),
    )
    supplier, nation, region = table("supplier"), table("nation"), table("region")
    entity = (
        supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.lit("Method").alias("type"), F.col("s_name").alias("name"))
        .unionAll(nation.select(F.concat(F.lit("N"), "n_nationkey"), F.lit("Dataset"), "n_name"))
        .unionAll(region.select(F.concat(F.lit("R"), "r_regionkey"), F.lit("Benchmark"), "r_name"))
        .withColumn("description", F.lit(""))
    )
    kind = F.create_map(*(F.lit(x) for pair in CITATION_TYPES.items() for x in pair))
    numbered = line.where("l_orderkey is not null and l_linenumber is not null").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("n"), F.col("l_partkey").alias("d"), (1 + F.floor("l_quantity") % 5).cast("int").alias("imp"), F.concat("l_returnflag", "l_linestatus").alias("flag"))
    following = F.collect_list(F.struct("d", "imp", "flag")).over(Window.partitionBy("l_orderkey").orderBy("n").rangeBetween(1, 1))
    pairs = numbered.select(F.col("d").alias("s"), following.alias("next")).select("s", F.explode("next").alias("b")).select("s", "b.*").where("s <> d")
    cites = pairs.repartition("s", "d").groupBy("s", "d").agg(F.max("imp").alias("importance_score"), F.max("flag").alias("flag"))
    none = F.lit(None)
    edge = (
        cites.select(F.concat(F.lit("P"), "s").alias("src"), F.concat(F.lit("P"), "d").alias("dst"), F.lit("CITES").alias("type"), F.lit(PAPER).alias("src_label"), F.lit(PAPER).alias("dst_label"), "importance_score", kind[F.col("flag")].alias("citation_type"))
        .unionAll(line.where("l_quantity >= 45").select(F.concat(F.lit("P"), "l_partkey"), F.concat(F.lit("S"), "l_suppkey"), F.lit("MENTIONS"), F.lit(PAPER), F.lit(ENTITY), none.cast("int"), none.cast("string")).distinct())
        .unionAll(supplier.select(F.concat(F.lit("S"), "s_suppkey"), F.concat(F.lit("N"), "s_nationkey"), F.lit("USES"), F.lit(ENTITY), F.lit(ENTITY), none.cast("int"), none.cast("string")))
        .unionAll(nation.select(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey"), F.lit("EXTENDS"), F.lit(ENTITY), F.lit(ENTITY), none.cast("int"), none.cast("string")))
        .withColumn("context", none.cast("string"))
        .withColumn("key", edge_key())
    )
    return Graph(paper, entity, edge)


def load_for_paths(spark: SparkSession, sf_dir: str, dates: bool = True) -> Graph:
    """As ``load``, with the edges written once, as each hop of a path reads them."""
    graph = load(spark, sf_dir, dates)
    return replace(graph, edge=written(graph.edge))


#: What a line's flags stand for; other flags have no citation type.
CITATION_TYPES = {"AF": "EXTENDS", "AO": "COMPARES", "NF": "USES", "NO": "BACKGROUND", "RF": "MENTIONS"}

#: The same views in DuckDB's SQL, to follow WITH or WITH RECURSIVE.
SQL = """
paper AS (SELECT 'P' || p_partkey AS id, p_name || ' ' || p_brand AS title, p_type AS summary, strftime(day, '%Y-%m-%dT%H:%M:%S') AS published_date
  FROM part LEFT JOIN (SELECT l_partkey, min(l_shipdate) AS day FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey),
entity AS (SELECT 'S' || s_suppkey AS id, 'Method' AS type, s_name AS name, '' AS description FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'Dataset', n_name, '' FROM nation
  UNION ALL SELECT 'R' || r_regionkey, 'Benchmark', r_name, '' FROM region),
cites AS (SELECT a.l_partkey AS s, b.l_partkey AS d, max(CAST(1 + floor(b.l_quantity) % 5 AS INTEGER)) AS importance_score, max(b.l_returnflag || b.l_linestatus) AS flag
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey GROUP BY ALL),
edge0 AS (SELECT 'P' || s AS src, 'P' || d AS dst, 'CITES' AS type, 'Paper' AS src_label, 'Paper' AS dst_label, importance_score,
    CASE flag WHEN 'AF' THEN 'EXTENDS' WHEN 'AO' THEN 'COMPARES' WHEN 'NF' THEN 'USES' WHEN 'NO' THEN 'BACKGROUND' WHEN 'RF' THEN 'MENTIONS' END AS citation_type FROM cites
  UNION ALL SELECT DISTINCT 'P' || l_partkey, 'S' || l_suppkey, 'MENTIONS', 'Paper', 'Entity', NULL::INTEGER, NULL::VARCHAR FROM lineitem WHERE l_quantity >= 45
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'USES', 'Entity', 'Entity', NULL::INTEGER, NULL::VARCHAR FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'EXTENDS', 'Entity', 'Entity', NULL::INTEGER, NULL::VARCHAR FROM nation),
edge AS (SELECT *, NULL::VARCHAR AS context, src || '>' || type || '>' || dst AS key FROM edge0)
"""
