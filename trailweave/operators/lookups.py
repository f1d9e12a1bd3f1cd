"""Point and set lookups, searches, neighbourhoods and enrichment over the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.graph_fixture import Graph
from .paths import both_ways
from .substrings import NameIndex

DEFAULT_IMPORTANCE = 3


def truthy(column: str | F.Column, other: str | F.Column | None = None) -> F.Column:
    """The value, or the other one where it is null or empty."""
    value = F.nullif(F.col(column) if isinstance(column, str) else column, F.lit(""))
    return value if other is None else F.coalesce(value, F.col(other) if isinstance(other, str) else other)


def in_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id").distinct(), "id", "left_semi")


def date_range(paper: DataFrame, manual: str | None = None) -> DataFrame:
    """``:YYYY-MM-DD`` up to each paper's date; a date given by hand wins, and dates that don't parse give null."""
    day = F.try_to_timestamp(F.regexp_replace("published_date", r"(Z|[+-]\d{2}:?\d{2})$", ""))
    return paper.select("id", F.coalesce(F.lit(manual).cast("string"), F.concat(F.lit(":"), F.date_format(day, "yyyy-MM-dd"))).alias("date_range"))


def typed_edges(graph: Graph, kind: str | None = None, entity_type: str | None = None) -> DataFrame:
    """Relationships from papers, of one type, and to entities of one type."""
    found = graph.edge.where(F.col("src_label") == "Paper")
    if kind:
        found = found.where(F.col("type") == kind)
    if entity_type:
        found = found.join(graph.entity.where(F.col("type") == entity_type).select(F.col("id").alias("dst")), "dst", "left_semi")
    return found.select("src", "type", "dst")


def names(graph: Graph) -> DataFrame:
    """All nodes: id, label, name (a paper's title), entity_type, summary, description, published_date."""
    text = lambda value=None: F.lit(value).cast("string")
    paper = graph.paper.select("id", text("Paper").alias("label"), F.col("title").alias("name"), text().alias("entity_type"), "summary", text().alias("description"), "published_date")
    return paper.unionAll(graph.entity.select("id", text("Entity"), "name", "type", text(), "description", text()))


def keyword_search(graph: Graph, keyword: str, index: NameIndex, limit: int | None = None) -> DataFrame:
    """Nodes whose title or name contains a keyword in any case, with each neighbour over either direction, if any.

    ``index`` has the nodes' names (see ``names``): what is read of it are the lists of the keyword's rarest trigram.
    With ``limit``, the first rows by id, key and neighbour, in that order: as each node gives a row at least, they are
    those of as many first ids, and neighbours are looked up for these alone.
    """
    hit = index.containing([keyword]).select("id")
    if limit is not None:
        hit = F.broadcast(hit.distinct().orderBy("id").limit(limit))
    found = names(graph).select("id", "label", "name").join(hit, "id", "left_semi")
    around = both_ways(graph.edge).select(F.col("src").alias("id"), F.col("type").alias("rel"), F.col("dst").alias("neighbour"), "key")
    if limit is None:
        return found.join(around, "id", "left")
    around = around.join(hit, "id", "left_semi")
    return found.join(around, "id", "left").orderBy(F.asc("id"), F.asc_nulls_last("key"), F.asc_nulls_last("neighbour")).limit(limit)


def display_names(nodes: DataFrame) -> DataFrame:
    """What a path shows of a node: a paper's title or id, or ``Unknown``; an entity's name or id."""
    paper = truthy("name", truthy("id", F.lit("Unknown")))
    return nodes.withColumn("shown", F.when(F.col("label") == "Paper", paper).otherwise(truthy("name", "id")))


def masked(edge: DataFrame) -> DataFrame:
    """Importance, citation type and context of citations only."""
    return edge.withColumns({c: F.when(F.col("type") == "CITES", F.col(c)) for c in ("importance_score", "citation_type", "context")})


def paper_context(graph: Graph) -> DataFrame:
    """Each paper with its distinct mentioned entities, by type and name; a paper without any has none."""
    mentioned = graph.edge.where("type = 'MENTIONS'").select(F.col("src").alias("id"), F.col("dst").alias("entity"))
    named = mentioned.join(graph.entity.where("name is not null").select(F.col("id").alias("entity"), F.struct("type", "name").alias("e")), "entity")
    found = graph.paper.select("id", "title", "summary").join(named, "id", "left")
    return found.groupBy("id", "title", "summary").agg(F.array_sort(F.collect_set("e")).alias("entities"))


def citations_ranked(graph: Graph) -> DataFrame:
    """Citations of each paper with title and importance (3 if unknown), and their place by importance."""
    out = graph.edge.where("type = 'CITES' and dst is not null").select(F.col("src").alias("paper_id"), F.col("dst").alias("cited_id"), F.coalesce("importance_score", F.lit(DEFAULT_IMPORTANCE)).alias("importance"))
    out = out.join(graph.paper.select(F.col("id").alias("cited_id"), F.coalesce("title", F.lit("")).alias("title")), "cited_id")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("importance"), "cited_id")))


def node_details(shown: DataFrame, nodes: DataFrame) -> DataFrame:
    """Path nodes (id, label, name, entity_type) with stored properties; an entity's stored name and type win if they aren't empty."""
    stored = nodes.select("id", F.col("name").alias("s_name"), F.col("entity_type").alias("s_type"), "summary", F.col("description").alias("s_description"))
    entity = F.col("label") == "Entity"
    return shown.join(stored, "id", "left").select(
        "id", "label",
        F.when(entity, truthy("s_name", "name")).otherwise(F.col("name")).alias("name"),
        F.when(entity, truthy("s_type", "entity_type")).alias("entity_type"),
        F.when(~entity, truthy("s_name")).alias("title"),
        F.when(~entity, F.col("summary")).alias("summary"),
        F.when(entity, F.coalesce("s_description", F.lit(""))).alias("description"),
    )


def direct_lines(entities: F.Column, claims: F.Column, most_entities: int = 20, most_claims: int = 10) -> list[F.Column]:
    """Lists of a paper's first entities (structs of name and type) and first claims, as they are shown without paths: ``entities`` and ``claims``."""
    said = F.transform(F.slice(entities, 1, most_entities), lambda e: F.concat(F.lit("- "), e["name"], F.lit(" ("), F.coalesce(e["type"], F.lit("Entity")), F.lit(")")))
    told = F.transform(F.slice(claims, 1, most_claims), lambda c: F.concat(F.lit("- "), c))
    return [F.coalesce(F.array_join(x, "\n"), F.lit("")).alias(name) for x, name in ((said, "entities"), (told, "claims"))]


def endpoints_in(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relationships of which both ends are among the nodes."""
    src = edge.join(nodes.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    return src.join(nodes.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")


def highlight(nodes: DataFrame, path: DataFrame, index: NameIndex, most: int = 1000) -> DataFrame:
    """Nodes (id, name) that a path's nodes (id, name) match by id, or by lower-cased name as a part of the other.

    ``index`` has the nodes' names.  The path's side is a list of some tens of names; more than ``most`` are an error.
    """
    found = path.select("id", "name").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a path of more than {most} nodes")
    shown = [r["name"] for r in found if r["name"] is not None]
    own = nodes.sparkSession.createDataFrame([(r["id"],) for r in found], f"id {nodes.schema['id'].dataType.simpleString()}")
    ids = own.unionAll(index.containing(shown).select("id")).unionAll(index.within(shown).select("id")).distinct()
    return nodes.join(ids, "id", "left_semi")


def label_counts(graph: Graph) -> DataFrame:
    return names(graph).groupBy("label").agg(F.count("*").alias("n"))


def type_counts(graph: Graph) -> DataFrame:
    return graph.edge.groupBy("type").agg(F.count("*").alias("n"))


def duplicate_keys(graph: Graph) -> DataFrame:
    """For each table, how many keys are not unique, and null ones: the constraints hold if all are 0."""
    out = None
    for name, table, key in (("paper", graph.paper, "id"), ("entity", graph.entity, "id"), ("edge", graph.edge, "key")):
        some = table.groupBy(key).agg(F.count("*").alias("n")).agg(F.count_if((F.col("n") > 1) | F.col(key).isNull()).alias("violations"))
        some = some.select(F.lit(name).alias("name"), "violations")
        out = some if out is None else out.unionAll(some)
    return out
