"""Batch upserts of papers, dates, citations and extractions: each returns the tables' next snapshot.

Where a batch has several rows of a key, the last one by ``seq`` counts.  Snapshots are equi-joins on the keys, so that
applying a batch twice gives the same tables.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.graph_fixture import ENTITY, PAPER, Graph, edge_key
from ..sources.tables import written

EXTRACTION = (
    "seq bigint, paper_id string, paper_summary string, claims array<string>, entities array<struct<type: string, name: string, description: string>>, "
    "relations array<struct<source: string, target: string, relation_type: string>>, cited_papers array<struct<title: string, importance_score: int, citation_type: string, context: string>>"
)

CITED = ("importance_score", "citation_type", "context")
BEYOND_ASCII = r"[^\x00-\x7F]"
#: An extraction with more pairs of an entity and a relation than this resolves its relations by joins.
LOOKUPS = 1_000_000


def newest(rows: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """The first row of each key by an order.

    For keys that seldom occur twice: rows are dealt out before they are sorted, so each is sorted once, and columns that
    nobody reads are left out.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.repartition(*keys).withColumn("own number", number).where(F.col("own number") == 1).drop("own number")


def _last(rows: DataFrame, key, seq, *names: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), seq).alias("new"))


def upsert_papers(paper: DataFrame, rows: DataFrame) -> DataFrame:
    """Papers of ``rows`` (id, title, seq) are added, or get the new title."""
    both = paper.join(_last(rows, "id", "seq", "title"), "id", "full_outer")
    return both.withColumn("title", F.when(F.col("new").isNull(), F.col("title")).otherwise(F.col("new.title"))).select(*paper.columns)


def upsert_dates(paper: DataFrame, rows: DataFrame) -> DataFrame:
    """Known papers get the date of ``rows`` (id, published_date, seq); null dates change nothing."""
    both = paper.join(_last(rows.where("published_date is not null"), "id", "seq", "published_date"), "id", "left")
    return both.withColumn("published_date", F.coalesce("new.published_date", "published_date")).select(*paper.columns)


def _edge_rows(found: DataFrame, kind: F.Column, src_label: str, dst_label: str) -> DataFrame:
    none = F.lit(None)
    out = found.withColumns({"type": kind, "src_label": F.lit(src_label), "dst_label": F.lit(dst_label)})
    for name, sort in (("importance_score", "int"), ("citation_type", "string"), ("context", "string")):
        if name not in found.columns:
            out = out.withColumn(name, none.cast(sort))
    return out.withColumn("key", edge_key())


def _new_edges(edge: DataFrame, found: DataFrame) -> DataFrame:
    """The edges with those of ``found`` that aren't there yet."""
    return edge.unionByName(found.dropDuplicates(["key"]).join(edge.select("key"), "key", "left_anti").select(*edge.columns))


def upsert_citations(paper: DataFrame, edge: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations ``rows`` (src, dst, title, seq) of papers known before; cited papers that aren't are added with the first title."""
    known = rows.join(paper.select(F.col("id").alias("src")), "src", "left_semi")
    stubs = known.groupBy(F.col("dst").alias("id")).agg(F.min_by("title", "seq").alias("title")).join(paper.select("id"), "id", "left_anti")
    cites = _edge_rows(known.select("src", "dst").distinct(), F.lit("CITES"), PAPER, PAPER)
    return paper.unionByName(stubs, allowMissingColumns=True), _new_edges(edge, cites)


def entities_of(extractions: DataFrame) -> DataFrame:
    """A row for each entity of each extraction: seq, place, paper_id, id, type, name, description."""
    rows = extractions.select("seq", "paper_id", F.posexplode("entities").alias("place", "e")).select("seq", "place", "paper_id", "e.*")
    return rows.withColumns({"id": T.entity_id(F.col("type"), F.col("name")), "description": F.coalesce("description", F.lit(""))})


def resolved_relations(extractions: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Relations with a valid type of which both ends are entities of the same extraction; of several of a name, the last."""
    entities = entities_of(extractions) if entities is None else entities
    named = entities.groupBy("seq", "name").agg(F.max_by("id", "place").alias("id"))
    rows = extractions.select("seq", "paper_id", F.explode("relations").alias("r")).select("seq", "paper_id", "r.source", "r.target", T.relation_type(F.col("r.relation_type")).alias("type"))
    rows = rows.where(F.col("type").isNotNull())
    rows = rows.join(named.select("seq", F.col("name").alias("source"), F.col("id").alias("src")), ["seq", "source"])
    rows = rows.join(named.select("seq", F.col("name").alias("target"), F.col("id").alias("dst")), ["seq", "target"])
    return rows.select("seq", "paper_id", "src", "dst", "type")


def _cited(extractions: DataFrame) -> DataFrame:
    rows = extractions.select("seq", F.col("paper_id").alias("src"), F.posexplode("cited_papers").alias("place", "c")).select("seq", "place", "src", "c.*")
    return rows.withColumn("context", F.coalesce("context", F.lit("")))


def citations_of(extractions: DataFrame) -> DataFrame:
    """A row for each cited paper of each extraction; only titles beyond ASCII, which may have to be composed, go through Python."""
    rows = _cited(extractions)
    beyond = F.coalesce(F.col("title").rlike(BEYOND_ASCII), F.lit(False))
    return rows.where(~beyond).withColumn("dst", T.paper_id(F.col("title"), compose=False)).unionAll(rows.where(beyond).withColumn("dst", T.paper_id(F.col("title"))))


def usual() -> F.Column:
    """Whether an extraction needs neither Python, as its titles are in ASCII, nor joins, as its names are few enough to be looked up one by one."""
    ascii_only = F.coalesce(~F.array_join("cited_papers.title", "").rlike(BEYOND_ASCII), F.lit(True))
    size = lambda name: F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0)).cast("bigint")
    return ascii_only & (size("entities") * size("relations") <= LOOKUPS)


def _looked_up_relations(extractions: DataFrame) -> DataFrame:
    """As ``resolved_relations``, within each row: the last entity of a name is the first from behind."""
    behind = {name: F.reverse(F.col(f"entities.{name}")) for name in ("name", "type")}
    rows = extractions.select(behind["name"].alias("names"), behind["type"].alias("types"), F.explode("relations").alias("r")).select("names", "types", "r.*")
    rows = rows.withColumns({end: F.array_position("names", F.col(name)) for end, name in (("a", "source"), ("b", "target"))}).where("a > 0 and b > 0")
    kind = lambda at: F.get("types", (F.col(at) - 1).cast("int"))
    equal = rows.select("source", "target", "relation_type", kind("a").alias("a"), kind("b").alias("b")).distinct()  # before ids are made
    return equal.select(T.entity_id(F.col("a"), F.col("source")).alias("src"), T.entity_id(F.col("b"), F.col("target")).alias("dst"), T.relation_type(F.col("relation_type")).alias("type")).where("type is not null")


def _at() -> F.Column:
    """The order of rows by seq and place as one number, which sums of hashed groups can hold."""
    return F.coalesce("seq", F.lit(-(2**63))).cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + F.col("place").cast("decimal(10,0)")


def _said(extractions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Mentions (src, dst), distinct relations (src, dst, type) and citations (src, dst, properties, seq, place) of extractions, and cited titles (dst, title, first and last place).

    Each reads the extractions by itself.  Whether some are not ``usual`` is looked up at once.
    """
    rows = extractions if "usual" in extractions.columns else extractions.withColumn("usual", usual())
    plain, odd = rows.where("usual"), rows.where("not usual")
    entities = entities_of(rows)
    relations, cites = _looked_up_relations(plain), _cited(plain)
    titles = cites.withColumn("at", _at()).groupBy("title").agg(F.min("at").alias("first"), F.max("at").alias("last")).withColumn("dst", T.paper_id(F.col("title"), compose=False))
    cites = cites.withColumn("dst", T.paper_id(F.col("title"), compose=False))
    if not odd.isEmpty():
        relations = relations.unionByName(resolved_relations(odd).select("src", "dst", "type"))
        more = citations_of(odd)
        cites = cites.unionByName(more)
        titles = titles.unionByName(more.withColumn("at", _at()).groupBy("title", "dst").agg(F.min("at").alias("first"), F.max("at").alias("last")))
    mentions = entities.select(F.col("paper_id").alias("src"), F.col("id").alias("dst"))
    return mentions, relations.distinct(), cites.select("src", "dst", *CITED, "seq", "place"), titles


def _new_papers(extractions: DataFrame, titles: DataFrame) -> DataFrame:
    told = newest(extractions.select(F.col("paper_id").alias("id"), F.struct(F.col("paper_summary").alias("summary"), "claims").alias("told"), "seq"), ("id",), F.desc("seq")).drop("seq")
    full = F.when(F.col("title") != "", F.col("title"))
    cited = titles.groupBy(F.col("dst").alias("id")).agg(F.coalesce(F.min_by(full, F.when(full.isNotNull(), F.col("first"))), F.max_by("title", "last")).alias("title"))
    return told.join(cited, "id", "full_outer").select("id", "title", "told", F.lit(None).cast("string").alias("published_date"))


def _new_entities(extractions: DataFrame) -> DataFrame:
    """Equal entities are counted as one before their ids are made and the last of each is taken."""
    equal = extractions.select("seq", F.posexplode("entities").alias("place", "e")).select("seq", "place", "e.*").groupBy("type", "name", "description").agg(F.max(_at()).alias("at"))
    named = equal.withColumns({"id": T.entity_id(F.col("type"), F.col("name")), "description": F.coalesce("description", F.lit(""))})
    return named.groupBy("id").agg(F.max_by(F.struct("type", "name", "description"), "at").alias("e")).select("id", "e.*")


def _edges(mentions: DataFrame, relations: DataFrame, cites: DataFrame) -> DataFrame:
    mentions, relations = _edge_rows(mentions, F.lit("MENTIONS"), PAPER, ENTITY), _edge_rows(relations, F.col("type"), ENTITY, ENTITY)
    return mentions.unionByName(relations).unionByName(_edge_rows(cites, F.lit("CITES"), PAPER, PAPER), allowMissingColumns=True)


def changes(extractions: DataFrame) -> dict[str, DataFrame]:
    """What a batch of extractions (see ``EXTRACTION``) says of each key, to be merged into what is known of it (see ``MERGES``).

    ``paper``: a title, of cited papers, and ``told``, the summary and claims of the extracted ones; ``entity``; ``edge``:
    mentions, resolved relations, and citations with their properties.  The extractions are read several times, and should
    be written before, best with ``usual``.
    """
    mentions, relations, cites, titles = _said(extractions)
    props = newest(cites, ("src", "dst"), F.desc("seq"), F.desc("place")).drop("seq", "place")
    return {"paper": _new_papers(extractions, titles), "entity": _new_entities(extractions), "edge": _edges(mentions.distinct(), relations, props)}


def told_papers(paper: DataFrame) -> DataFrame:
    """A graph's papers as ``changes`` has them: what they say counts unless something newer is told."""
    claims = "claims" if "claims" in paper.columns else F.lit(None).cast("array<string>").alias("claims")
    return paper.select("id", "title", F.struct("summary", claims).alias("told"), "published_date")


def shown_papers(paper: DataFrame) -> DataFrame:
    """The other way round: summary and claims as columns."""
    return paper.select("id", "title", F.col("told.summary").alias("summary"), "published_date", F.col("told.claims").alias("claims"))


def merged_papers(rows: DataFrame) -> DataFrame:
    """The first title that isn't empty, the last summary and claims, the last date, by ``layer``."""
    full = F.when(F.col("title") != "", F.col("layer"))
    title = F.coalesce(F.min_by("title", full), F.max_by("title", F.when(F.col("title").isNotNull(), F.col("layer"))))
    return rows.repartition("id").groupBy("id").agg(title.alias("title"), F.max_by("told", F.when(F.col("told").isNotNull(), F.col("layer"))).alias("told"), F.max_by("published_date", F.when(F.col("published_date").isNotNull(), F.col("layer"))).alias("published_date"))


def merged_entities(rows: DataFrame) -> DataFrame:
    """The last properties, by ``layer``."""
    return newest(rows, ("id",), F.desc("layer")).drop("layer")


def merged_edges(rows: DataFrame, *then: str) -> DataFrame:
    """Of citations the last properties, by ``layer`` and ``then`` by other columns; of all others the first."""
    order = F.when(F.col("type") == "CITES", F.col("layer")).otherwise(-F.col("layer"))
    return newest(rows, ("key",), order.desc(), *map(F.desc, then)).drop("layer", *then)


MERGES = {"paper": merged_papers, "entity": merged_entities, "edge": merged_edges}


def write_extracted(graph: Graph, extractions: DataFrame) -> Graph:
    """The graph after a batch of extractions (see ``EXTRACTION``).

    Papers get summary and claims, entities all properties; mentions and typed relations are added once; cited papers
    are added, with a title where they have none; citations get the new properties.  The batch is written while this is
    called, and merged into the tables as a stream's layers are (see ``changes``); what it says of edges is so in one
    step with those that are there.
    """
    rows = written(extractions.withColumn("usual", usual()))
    mentions, relations, cites, titles = _said(rows)
    new = {"paper": _new_papers(rows, titles), "entity": _new_entities(rows)}
    old = {"paper": told_papers(graph.paper), "entity": graph.entity}
    both = {name: MERGES[name](old[name].withColumn("layer", F.lit(0)).unionByName(new[name].withColumn("layer", F.lit(1)))) for name in new}
    said = _edges(mentions, relations, cites).withColumn("layer", F.lit(1))
    edge = merged_edges(graph.edge.withColumn("layer", F.lit(0)).unionByName(said, allowMissingColumns=True), "seq", "place")
    paper = shown_papers(both["paper"]).select(*graph.paper.columns, *(["claims"] if "claims" not in graph.paper.columns else []))
    return replace(graph, paper=paper, entity=both["entity"].select("id", "type", "name", "description"), edge=edge.select(*graph.edge.columns))


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds ``batch``, from 0: rows in order, ``size`` to a batch.

    Ranges are sorted by task and counted first, so that no task numbers all rows.
    """
    from .paths import ranked_by

    return ranked_by(rows, order).withColumn("batch", F.floor((F.col("rank") - 1) / size).cast("bigint")).drop("rank")
