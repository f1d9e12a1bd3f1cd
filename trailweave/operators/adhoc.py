"""Read-only SQL over the graph as views ``paper``, ``entity`` and ``edge``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.graph_fixture import Graph
from . import lookups as L


def reads_only(spark: SparkSession, sql: str) -> bool:
    """Whether Spark parses a statement as a query, without any command or insert in it."""
    kind = spark._jvm.java.lang.Class.forName
    others = [kind(f"org.apache.spark.sql.catalyst.plans.logical.{name}") for name in ("Command", "ParsedStatement")]
    work = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while work:
        plan = work.pop()
        if any(other.isInstance(plan) for other in others):
            return False
        work += [plan.children().apply(i) for i in range(plan.children().size())]
    return True


def run(graph: Graph, sql: str, **values) -> DataFrame:
    """A query over the views, with ``values`` for its parameters; statements that do more than read are an error."""
    spark = graph.paper.sparkSession
    if not reads_only(spark, sql):
        raise ValueError("only queries are run")
    for name in ("paper", "entity", "edge"):
        getattr(graph, name).createOrReplaceTempView(name)
    return spark.sql(sql, args=values or None)


def subgraph(graph: Graph, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes and relationships of some relationships' keys (column ``key``), for display."""
    edges = graph.edge.join(keys.select("key").distinct(), "key", "left_semi")
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return L.display_names(L.in_ids(L.names(graph), ids)), edges
