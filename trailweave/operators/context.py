"""Graph context for prompts: selects, filters and renders the paths around a paper as text in five formats.

Every step is a DataFrame over the selected paths, numbered by ranges of their order; ``render`` alone brings lines together.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.graph_fixture import Graph
from ..sources.tables import written
from . import lookups as L
from . import paths as P

FORMATS = ("mermaid", "paths", "json_graph", "triples", "narrative")
SCOPES = ("path", "k_hop", "path_plus_k_hop")
#: What may be shown of each type of node and relationship.
NODE_FIELDS = {"Paper": ("paper_claims", "paper_summary", "paper_title"), "Entity": ("entity_description", "entity_type")}
#: Lines of a diagram's label, characters of a line and of a label, and the share of characters taken out beyond which a label is unsafe.
MOST_LABEL_LINES, MOST_LINE, MOST_LABEL, UNSAFE_SHARE = 1000, 100_000, 1_000_000, 0.4
EDGE_FIELDS = {"CITES": ("citation_type", "context", "importance_score", "type")} | dict.fromkeys(("MENTIONS", "USES", "EXTENDS", "COMPARES", "ENABLES", "IMPROVES", "ADDRESSES"), ("context", "type"))


@dataclass
class Options:
    """What to select and show.  Unknown formats, scopes, types and fields, and limits below 1, are errors; repeated fields count once."""

    graph_format: str = "mermaid"
    scope: str = "path"
    node_type_fields: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(NODE_FIELDS))
    edge_type_fields: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(EDGE_FIELDS))
    max_paths: int | None = None
    max_nodes: int | None = None
    max_edges: int | None = None
    neighbor_k: int | None = None
    include_inline_edges: bool = True
    include_target_paper: bool = False
    exclude_future_papers: bool = True
    reverse_paths: bool = True

    def __post_init__(self):
        if self.graph_format not in FORMATS:
            raise ValueError(f"graph_format is one of {FORMATS}")
        if self.scope not in SCOPES:
            raise ValueError(f"scope is one of {SCOPES}")
        for name in ("max_paths", "max_nodes", "max_edges", "neighbor_k"):
            if (value := getattr(self, name)) is not None and value < 1:
                raise ValueError(f"{name} is 1 or more")
        for kind, given in self.node_type_fields.items():
            if wrong := set(given) - set(NODE_FIELDS["Paper" if kind == "Paper" else "Entity"]):
                raise ValueError(f"{kind} has no fields {sorted(wrong)}")
        for kind, given in self.edge_type_fields.items():
            if kind not in EDGE_FIELDS or (wrong := set(given) - set(EDGE_FIELDS[kind])):
                raise ValueError(f"no such fields of {kind}: {given}")
        self.node_type_fields = {k: tuple(dict.fromkeys(v)) for k, v in self.node_type_fields.items()}
        self.edge_type_fields = {k: tuple(dict.fromkeys(v)) for k, v in self.edge_type_fields.items()}

    def node_fields(self, kind: str) -> tuple[str, ...]:
        return self.node_type_fields.get(kind, self.node_type_fields.get("Entity", ()) if kind != "Paper" else ())


def shows(options: dict[str, tuple[str, ...]], kind: F.Column, name: str | None = None, other: tuple[str, ...] = ()) -> F.Column:
    """Whether a type's fields have ``name`` (or any); types that aren't listed have those of ``other``."""
    yes = [k for k, v in options.items() if (name in v if name else v)]
    listed = kind.isin(list(options))
    return F.when(listed, kind.isin(yes) if yes else F.lit(False)).otherwise(F.lit(bool(name in other if name else other)))


def node_kind(node: F.Column) -> F.Column:
    return F.when(node["label"] == "Paper", "Paper").otherwise(F.coalesce(F.nullif(node["entity_type"], F.lit("")), F.lit("Entity")))


def _shows_node(options: Options, node: F.Column, name: str | None = None) -> F.Column:
    return shows(options.node_type_fields, node_kind(node), name, options.node_type_fields.get("Entity", ()))


def without_future(found: DataFrame, paper: DataFrame, target: str, include_target: bool = False, exclude_future: bool = True) -> DataFrame:
    """Adds to paths ``kept``, the nodes of their route that aren't later than the target, nor the target itself.

    Nodes without a date stay; if the target has none, all do.
    """
    keyed = found.withColumn("path_key", F.array_join("keys", "|"))
    nodes = keyed.select("path_key", F.posexplode("route").alias("place", "id")).join(paper.select("id", "published_date"), "id", "left")
    nodes = nodes.withColumn("day", paper.where(F.col("id") == target).select(F.max("published_date")).scalar())
    late = F.coalesce(F.col("published_date") > F.col("day"), F.lit(False)) if exclude_future else F.lit(False)
    stays = ~late if include_target else ~late & (F.col("id") != target)
    kept = nodes.groupBy("path_key").agg(F.array_sort(F.collect_list(F.when(stays, F.struct("place", "id")))).alias("kept"))
    return keyed.join(kept.withColumn("kept", F.transform("kept", lambda x: x["id"])), "path_key").drop("path_key")


def select_paths(graph: Graph, target: str, k: int, options: Options) -> DataFrame:
    """The ranked paths and, after them, those of the neighbourhood, each up to ``max_paths``; nothing is taken out twice."""
    parts = []
    if options.scope != "k_hop":
        found = P.candidates(P.expand(graph.edge, target, k))
        parts.append(P.ranked(found, P.rank_order(), options.max_paths).select(F.lit(0).alias("part"), "rank", "route", "keys", "rels", "score"))
    if options.scope != "path":
        found = P.k_hop(graph.edge, target, options.neighbor_k or k, options.max_paths, options.max_edges)
        order = [F.asc("hops"), F.asc(F.array_join("keys", "|"))]
        parts.append(P.ranked(found, order).select(F.lit(1).alias("part"), "rank", "route", "keys", "rels", "score"))
    return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])


def with_nodes(selected: DataFrame, graph: Graph, target: str) -> DataFrame:
    """Turns routes into ``nodes`` (id, label, name, entity_type, and whether it is ``late``r than the target) and ``edges`` (type, from_id, to_id, importance, citation, context)."""
    places = selected.select("part", "rank", F.posexplode("route").alias("place", "id"))
    named = places.join(L.display_names(L.names(graph)).select("id", "label", F.col("shown").alias("name"), "entity_type"), "id")
    day = graph.paper.where(F.col("id") == target).select(F.max("published_date")).scalar()
    named = named.join(graph.paper.select("id", "published_date"), "id", "left").withColumn("late", F.coalesce(F.col("published_date") > day, F.lit(False)))
    nodes = named.groupBy("part", "rank").agg(F.array_sort(F.collect_list(F.struct("place", "id", "label", "name", "entity_type", "late"))).alias("nodes"))
    joined = selected.join(nodes, ["part", "rank"])
    cites = lambda r, name: F.when(r["type"] == "CITES", r[name])
    edges = F.transform(F.sequence(F.lit(0), F.size("rels") - 1), lambda i: F.struct(
        F.get("rels", i)["type"].alias("type"), F.get("route", i).alias("from_id"), F.get("route", i + 1).alias("to_id"),
        cites(F.get("rels", i), "importance").alias("importance"), cites(F.get("rels", i), "citation").alias("citation"), cites(F.get("rels", i), "context").alias("context"),
    ))
    return joined.select("part", "rank", "score", F.transform("nodes", lambda n: n.dropFields("place")).alias("nodes"), edges.alias("edges"))


def filter_paths(paths: DataFrame, target: str, options: Options) -> DataFrame:
    """Drops nodes that are later than the target, the target, and types that aren't shown; then relationships without both ends.

    A path keeps two nodes or more and as many relationships less one, else it goes; in the mermaid format, its nodes stay.
    """
    late = lambda n: n["late"] if options.exclude_future_papers else F.lit(False)
    stays = lambda n: ~late(n) & _shows_node(options, n) & (F.lit(True) if options.include_target_paper else n["id"] != target)
    paths = paths.withColumn("nodes", F.transform(F.filter("nodes", stays), lambda n: n.dropFields("late"))).where(F.size("nodes") >= 2)
    paths = paths.withColumn("ids", F.transform("nodes", lambda n: n["id"]))
    whole = lambda e: shows(options.edge_type_fields, e["type"]) & F.array_contains("ids", e["from_id"]) & F.array_contains("ids", e["to_id"])
    paths = paths.withColumn("edges", F.filter("edges", whole)).drop("ids")
    linear = F.size("edges") == F.size("nodes") - 1
    if options.graph_format == "mermaid":
        return paths.withColumn("edges", F.when(linear, F.col("edges")).otherwise(F.slice("edges", 1, 0)))
    return paths.where(linear)


def numbered(rows: DataFrame, name: str, *order: str, top: int | None = None) -> DataFrame:
    """Adds the number of each row in order, from 1; with ``top``, of the first rows alone."""
    given = rows.withColumnRenamed("rank", "given_rank")
    return P.ranked(given, [F.asc("given_rank" if c == "rank" else c) for c in order], top).withColumnRenamed("rank", name)


def prepared(graph: Graph, target: str, k: int, options: Options) -> DataFrame:
    """Selected, filtered and reversed paths with their number ``idx``."""
    paths = filter_paths(with_nodes(select_paths(graph, target, k, options), graph, target), target, options)
    if options.reverse_paths:
        paths = paths.withColumns({"nodes": F.reverse("nodes"), "edges": F.reverse("edges")})
    return numbered(paths, "idx", "part", "rank").select("idx", "nodes", "edges", "score")


def first_nodes(paths: DataFrame, max_nodes: int | None) -> DataFrame:
    """Distinct nodes by first appearance, numbered from 1 as ``position``."""
    rows = paths.select("idx", F.posexplode("nodes").alias("place", "n"))
    firsts = rows.groupBy(F.col("n.id").alias("id")).agg(F.min(F.struct("idx", "place", "n")).alias("first"))
    found = numbered(firsts, "position", "first.idx", "first.place", top=max_nodes)
    return found.select("position", "first.n.*")


def merged_nodes(paths: DataFrame, graph: Graph, options: Options) -> DataFrame:
    """Distinct nodes with what is shown of them: ``details`` in fixed order, as keys and values."""
    nodes = first_nodes(paths, options.max_nodes)
    full = nodes.select("position", "id").join(L.node_details(nodes.select("id", "label", "name", "entity_type"), L.names(graph)), "id")
    node = F.struct("label", "entity_type")
    pair = lambda name, key, value: F.when(_shows_node(options, node, name) & F.nullif(value, F.lit("")).isNotNull(), F.struct(F.lit(key).alias("k"), value.alias("v")))
    paper = F.array(pair("paper_title", "Title", F.when(F.col("title") != F.col("name"), F.col("title"))), pair("paper_summary", "Summary", F.col("summary")))
    entity = F.array(pair("entity_type", "Type", F.col("entity_type")), pair("entity_description", "Description", F.col("description")))
    details = F.filter(F.when(F.col("label") == "Paper", paper).otherwise(entity), lambda x: x.isNotNull())
    kept = full.where(_shows_node(options, node)).withColumn("details", details)
    return numbered(kept, "number", "position").select("number", "id", "label", "name", "details")


def edge_details(edge: F.Column, options: Options) -> F.Column:
    """What is shown of a relationship, as keys and values in fixed order."""
    pair = lambda name, value, empty: F.when(shows(options.edge_type_fields, edge["type"], name) & (value.isNotNull() if empty else F.nullif(value, F.lit("")).isNotNull()), F.struct(F.lit(name).alias("k"), value.cast("string").alias("v")))
    found = F.array(pair("citation_type", edge["citation"], False), pair("importance_score", edge["importance"], True), pair("context", edge["context"], False))
    return F.filter(found, lambda x: x.isNotNull())


def merged_edges(paths: DataFrame, options: Options) -> DataFrame:
    """Distinct relationships by (from, to, type) in order of first appearance, with the details they first have."""
    rows = paths.where(F.size("edges") == F.size("nodes") - 1).select("idx", F.posexplode("edges").alias("place", "e"))
    firsts = rows.groupBy("e.from_id", "e.to_id", "e.type").agg(F.min(F.struct("idx", "place", "e")).alias("first"))
    return numbered(firsts, "number", "first.idx", "first.place").select("number", "from_id", "to_id", "type", edge_details(F.col("first.e"), options).alias("details"))


def kept_edges(edges: DataFrame, nodes: DataFrame, max_edges: int | None) -> DataFrame:
    """Relationships of which both ends are shown, the first ``max_edges``, with both ends' number and name."""
    a = nodes.select(F.col("id").alias("from_id"), F.col("number").alias("from_number"), F.col("name").alias("from_name"))
    b = nodes.select(F.col("id").alias("to_id"), F.col("number").alias("to_number"), F.col("name").alias("to_name"))
    both = edges.join(a, "from_id").join(b, "to_id")
    return both if max_edges is None else both.orderBy("number").limit(max_edges)


def _value(details: str, key: str) -> F.Column:
    return F.get(F.filter(details, lambda x: x["k"] == key), F.lit(0))["v"]


def _line(df: DataFrame, section: int, order, line: F.Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.col(order).cast("int").alias("ord") if isinstance(order, str) else F.lit(order).alias("ord"), line.alias("line"))


def _texts(df: DataFrame, *rows: tuple[int, int, str]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(rows), "section int, ord int, line string")


def paths_lines(paths: DataFrame, graph: Graph, options: Options) -> DataFrame:
    """A numbered line for each path, then the nodes' details."""
    label = lambda e: F.concat(F.when(shows(options.edge_type_fields, e["type"], "type"), e["type"]).otherwise(""), F.when(F.size(edge_details(e, options)) > 0, F.concat(F.lit("{"), F.array_join(F.transform(edge_details(e, options), lambda x: F.concat_ws("=", x["k"], x["v"])), ", "), F.lit("}"))).otherwise(""))
    plain = F.array_join(F.transform("nodes", lambda n: n["name"]), " <- ")
    inline = plain
    if options.include_inline_edges:
        steps = F.zip_with("edges", F.slice("nodes", 2, F.size("nodes")), lambda e, n: F.concat(F.when(label(e) != "", F.concat(F.lit(" <-("), label(e), F.lit(")- "))).otherwise(" <- "), n["name"]))
        inline = F.when(F.size("edges") == 0, plain).otherwise(F.concat(F.get("nodes", F.lit(0))["name"], F.array_join(steps, "")))
    out = _texts(paths, (0, 0, "### Graph Paths"), (2, 0, ""), (2, 1, "### Node Details")).unionAll(_line(paths, 1, "idx", F.concat(F.col("idx").cast("string"), F.lit(". "), inline)))
    nodes = merged_nodes(paths, graph, options)
    detail = F.array_join(F.transform("details", lambda x: F.concat(F.lit("\n  - "), x["k"], F.lit(": "), x["v"])), "")
    return out.unionAll(_line(nodes, 3, "number", F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.col("label"), F.lit(")"), detail)))


def _label(parts: F.Column) -> F.Column:
    """A diagram's label of some lines, of characters without a meaning there."""
    lines = F.filter(F.transform(F.slice(parts, 1, MOST_LABEL_LINES), T.mermaid_sanitize), lambda x: x != "")
    return T.truncate_label(F.array_join(F.transform(lines, lambda x: T.truncate_label(x, MOST_LINE)), "<br/>"), MOST_LABEL)


def _node_parts() -> F.Column:
    return F.concat(F.array("name"), F.transform("details", lambda x: F.concat_ws("=", x["k"], x["v"])))


def label_statistics(nodes: DataFrame) -> DataFrame:
    """Of merged nodes' labels in a diagram: characters taken out of them, and ``unsafe`` ones, with a line that is empty then or has lost too many."""
    parts = F.slice(_node_parts(), 1, MOST_LABEL_LINES)
    lost = lambda x: (T.mermaid_sanitize(x) == "") | (T.mermaid_removed(x) / F.greatest(F.length(x), F.lit(1)) > UNSAFE_SHARE)
    shown = F.exists(parts, lambda x: T.mermaid_sanitize(x) != "")
    removed = F.aggregate(F.transform(parts, T.mermaid_removed), F.lit(0), lambda a, b: a + b)
    return nodes.agg(F.coalesce(F.sum(removed), F.lit(0)).cast("bigint").alias("removed_chars"), F.count_if(shown & F.exists(parts, lost)).alias("unsafe_labels"))


def mermaid_lines(paths: DataFrame, graph: Graph, options: Options) -> DataFrame:
    """A diagram: nodes with safe labels, then relationships."""
    nodes = written(merged_nodes(paths, graph, options))
    edges = kept_edges(merged_edges(paths, options), nodes, options.max_edges)
    pairs = F.transform("details", lambda x: F.concat_ws("=", x["k"], x["v"]))
    nodes = nodes.withColumn("shown", _label(_node_parts()))
    kind = F.when(shows(options.edge_type_fields, F.col("type"), "type"), F.array("type")).otherwise(F.array().cast("array<string>"))
    edges = edges.withColumn("shown", _label(F.concat(kind, pairs)))
    name = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    arrow = F.when(F.col("shown") != "", F.concat(F.lit(" -- "), F.col("shown"), F.lit(" --> "))).otherwise(" --> ")
    out = _texts(paths, (0, 0, "```mermaid"), (0, 1, "graph RL" if options.reverse_paths else "graph LR"), (9, 0, "```"))
    out = out.unionAll(_line(nodes.where("shown <> ''"), 1, "number", F.concat(F.lit("  "), name("number"), F.lit('["'), F.col("shown"), F.lit('"]'))))
    return out.unionAll(_line(edges, 2, "number", F.concat(F.lit("  "), name("from_number"), arrow, name("to_number"))))


def triples_lines(paths: DataFrame, graph: Graph, options: Options) -> DataFrame:
    """Relationships, attributes of nodes, and ranked paths as triples."""
    nodes = written(merged_nodes(paths, graph, options))
    edges = kept_edges(merged_edges(paths, options), nodes, options.max_edges)
    attrs = F.array_compact(F.array(F.concat(F.lit("importance="), _value("details", "importance_score")), F.concat(F.lit("type="), _value("details", "citation_type"))))
    predicate = F.concat(F.col("type"), F.when(F.size(attrs) > 0, F.concat(F.lit("["), F.array_join(attrs, ","), F.lit("]"))).otherwise(""))
    comment = F.coalesce(F.concat(F.lit(" # "), _value("details", "context")), F.lit(""))
    triple = F.concat(F.lit("("), F.col("from_name"), F.lit(", "), predicate, F.lit(", "), F.col("to_name"), F.lit(")"), comment)
    own = F.transform("details", lambda x: F.concat(F.lit("\n("), F.col("name"), F.lit(", "), F.lower(x["k"]), F.lit(', "'), x["v"], F.lit('")')))
    attribute = F.concat(F.lit("("), F.col("name"), F.lit(", is_a, "), F.col("label"), F.lit(")"), F.array_join(own, ""))
    route = F.concat(F.lit("Path"), F.when(F.col("score") != 0, F.concat(F.lit("[score="), T.python_float("score"), F.lit("]"))).otherwise(""), F.lit(": "), F.array_join(F.transform("nodes", lambda n: n["name"]), " -> "))
    out = _texts(paths, (0, 0, "## Relationships"), (2, 0, ""), (2, 1, "## Node Attributes"), (4, 0, ""), (4, 1, "## Ranked Paths"))
    return out.unionAll(_line(edges, 1, "number", triple)).unionAll(_line(nodes, 3, "number", attribute)).unionAll(_line(paths, 5, "idx", route))


def narrative_lines(paths: DataFrame, graph: Graph, options: Options) -> DataFrame:
    """A paragraph for each path, and a summary; a relationship's details are those of the last type between its ends."""
    nodes, edges = written(merged_nodes(paths, graph, options)), written(merged_edges(paths, options))
    inline = F.array_compact(F.array(*(F.concat(F.lit(f"{k}: "), _value("details", k)) for k in ("Summary", "Claims", "Description"))))
    described = F.concat(F.coalesce(_value("details", "Type"), F.col("label")), F.lit(' "'), F.col("name"), F.lit('"'), F.when(F.size(inline) > 0, F.concat(F.lit(" ("), F.array_join(inline, "; "), F.lit(")"))).otherwise(""))
    say = nodes.select("id", described.alias("said"))
    last = edges.groupBy("from_id", "to_id").agg(F.max_by("details", "number").alias("details"))
    steps = paths.select("idx", "nodes", F.posexplode("edges").alias("place", "e")).select("idx", "place", "e.*", F.get("nodes", F.col("place"))["id"].alias("a"), F.get("nodes", F.col("place") + 1)["id"].alias("b"))
    steps = steps.join(say.toDF("a", "a_said"), "a").join(say.toDF("b", "b_said"), "b").join(last, ["from_id", "to_id"], "left")
    attrs = F.array_compact(F.array(F.concat(F.lit("importance "), _value("details", "importance_score"), F.lit("/5")), F.concat(F.lit("type: "), _value("details", "citation_type"))))
    said = F.array_compact(F.array(
        F.when(F.col("place") == 0, F.col("a_said")), F.concat(F.col("type"), F.when(F.size(attrs) > 0, F.concat(F.lit(" with "), F.array_join(attrs, ", "))).otherwise("")),
        F.col("b_said"), F.concat(F.lit('Context: "'), _value("details", "context"), F.lit('".')),
    ))
    told = steps.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("place", F.array_join(said, " ").alias("said")))).alias("told"))
    head = F.concat(F.lit("### Path "), F.col("idx").cast("string"), F.when(F.col("score") != 0, F.concat(F.lit(" (relevance: "), T.python_float("score"), F.lit(")"))).otherwise(""))
    body = paths.join(told, "idx", "left").select("idx", F.concat(head, F.lit("\n"), F.coalesce(F.array_join(F.transform("told", lambda x: x["said"]), " "), F.lit("")), F.lit("\n")).alias("line"))
    counts = paths.agg(F.count("*").alias("p")).withColumns({"n": nodes.agg(F.count("*")).scalar(), "e": edges.agg(F.count("*")).scalar()})
    summary = F.format_string("%d paths, %d unique nodes, %d unique edges.", "p", "n", "e")
    return _line(body, 0, "idx", F.col("line")).unionAll(_texts(paths, (1, 0, "### Graph Summary"))).unionAll(_line(counts, 1, 1, summary))


def json_rows(paths: DataFrame, graph: Graph, options: Options) -> DataFrame:
    """Nodes (section 0), relationships (1) and paths (2), each a JSON object in a line."""
    nodes = written(merged_nodes(paths, graph, options))
    edges = kept_edges(merged_edges(paths, options), nodes, options.max_edges)
    claims = F.split(_value("details", "Claims"), ", ")
    node = F.to_json(F.struct("id", F.col("label").alias("type"), "name", _value("details", "Summary").alias("summary"), claims.alias("claims"), _value("details", "Type").alias("subtype"), _value("details", "Description").alias("description")))
    edge = F.to_json(F.struct(F.col("from_id").alias("from"), F.col("to_id").alias("to"), F.col("type").alias("relation"), _value("details", "context").alias("context"), _value("details", "importance_score").alias("importance"), _value("details", "citation_type").alias("citation_type")))
    path = F.to_json(F.struct(F.transform("nodes", lambda n: n["id"]).alias("route"), F.when(F.col("score") != 0, F.col("score")).alias("score")))
    return _line(nodes, 0, "number", node).unionAll(_line(edges, 1, "number", edge)).unionAll(_line(paths, 2, "idx", path))


LINES = {"paths": paths_lines, "mermaid": mermaid_lines, "triples": triples_lines, "narrative": narrative_lines, "json_graph": json_rows}


def context_lines(graph: Graph, target: str, k: int, options: Options | None = None) -> DataFrame:
    """The context as lines with ``section`` and ``ord`` to sort by.  The paths are found once and written, as each section reads them."""
    options = options or Options()
    return LINES[options.graph_format](written(prepared(graph, target, k, options)), graph, options)


def shown_lines(lines: DataFrame, graph_format: str) -> DataFrame:
    """The lines of ``context_lines`` that are shown: headings of sections without lines go, and so do formats without what they are for."""
    sections = {r["section"] for r in lines.select("section").distinct().collect()}  # a handful of numbers
    if graph_format in ("paths", "triples"):
        return lines.where((F.col("section") % 2 == 1) | (F.col("section") + 1).isin(sorted(sections)))
    needed = {"mermaid": 1, "narrative": 0, "json_graph": 2}[graph_format]
    return lines if needed in sections else lines.limit(0)


def render(lines: DataFrame, graph_format: str) -> str:
    """The text of ``context_lines`` on the driver, for contexts that options bound (a prompt's); see ``write_context`` for others."""
    rows = shown_lines(lines, graph_format).orderBy("section", "ord").collect()
    if graph_format == "json_graph":
        found = {name: [json.loads(r["line"]) for r in rows if r["section"] == k] for k, name in enumerate(("nodes", "edges", "paths"))}
        return json.dumps(found, indent=2, ensure_ascii=False) if rows else ""
    return "\n".join(r["line"] for r in rows).strip()


def write_context(lines: DataFrame, graph_format: str, path: str) -> None:
    """The lines as text files, which tasks sort and write by ranges: one after the other, by name, they are the text of ``render``.

    Of ``json_graph`` each line is an object of its own, with the name of its list.
    """
    rows = shown_lines(lines, graph_format)
    if graph_format == "json_graph":
        name = F.element_at(F.array(F.lit("nodes"), F.lit("edges"), F.lit("paths")), F.col("section") + 1)
        rows = rows.withColumn("line", F.concat(F.lit('{"'), name, F.lit('":'), F.col("line"), F.lit("}")))
    rows.orderBy("section", "ord").select("line").write.text(path)
