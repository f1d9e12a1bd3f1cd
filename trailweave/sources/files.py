"""Readers and writers of files: data-set rows, extraction and document JSON, paper archives."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ideas as I
from ..functions import text as T
from ..operators import extractions as X
from ..operators import upserts as U
from ..operators.paths import ranked_by
from . import keyed_files
from .graph_fixture import Graph
from .tables import written

CACHE_VERSION = 2
_EXTRACTION = (
    "paper_id string, paper_summary string, claims array<string>, entities array<struct<type: string, name: string, description: string>>, "
    "relations array<struct<source: string, target: string, relation_type: string>>, cited_papers array<struct<title: string, reference_number: int, importance_score: int, citation_type: string, context: string>>, "
    "_cache_version int, _corrupt string"
)


def dataset_papers(rows: DataFrame) -> DataFrame:
    """Papers of data-set rows (seq, target_paper, references, paper_local_path): without blank titles, the first row of each id."""
    titled = rows.where(T.squeezed(F.col("target_paper")) != "").withColumn("paper_id", T.paper_id(F.col("target_paper")))
    first = titled.groupBy("paper_id").agg(F.min_by(F.struct(F.col("target_paper").alias("title"), F.coalesce("references", F.array().cast("array<string>")).alias("references"), F.col("paper_local_path").alias("local_path")), "seq").alias("p"))
    return first.select("paper_id", "p.*")


def reference_titles(find_cite: F.Column) -> F.Column:
    """Titles of a JSON field that is an object with ``top_references``: a list of them, or an object with a list ``title``; else none."""
    as_list = F.from_json(F.get_json_object(find_cite, "$.top_references"), "array<string>")
    as_object = F.from_json(F.get_json_object(find_cite, "$.top_references.title"), "array<string>")
    return F.coalesce(as_object, as_list, F.array().cast("array<string>"))


def extractions(spark: SparkSession, path: str) -> DataFrame:
    """Cached extractions of the current version, or without any; files that can't be read are left out."""
    found = spark.read.schema(_EXTRACTION).json(path, multiLine=True, columnNameOfCorruptRecord="_corrupt", recursiveFileLookup=True)
    kept = found.where(F.col("_corrupt").isNull() & F.col("paper_id").isNotNull() & (F.col("_cache_version").isNull() | (F.col("_cache_version") == CACHE_VERSION)))
    return kept.drop("_corrupt", "_cache_version")


def write_extractions(found: DataFrame, path: str) -> None:
    """A JSON file of the current version for each extraction, named by its paper's id; a paper's file is replaced, and all appear at once."""
    rows = found.withColumn("_cache_version", F.lit(CACHE_VERSION))
    keyed_files.write(rows.select(F.concat(T.safe_id(F.col("paper_id")), F.lit(".json")).alias("key"), F.to_json(F.struct("*")).alias("content")), path)


def paper_files(spark: SparkSession, path: str) -> DataFrame:
    """The best file of each paper id (the name up to its first dot): a LaTeX archive before a PDF; with the date of its ``.json`` metadata, if any.

    The choice is made by paths and first bytes; contents are read again for the chosen files alone.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,pdf}").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(F.lower(name).endswith(".tar.gz"), "latex").when(F.lower(name).endswith(".pdf") & (F.col("magic") == F.unhex(F.lit("25504446"))), "pdf")
    found = files.select("path", F.substring("content", 1, 4).alias("magic")).withColumns({"paper_id": F.substring_index(name, ".", 1), "kind": kind}).where(F.col("kind").isNotNull())
    best = found.groupBy("paper_id").agg(F.min(F.struct("kind", "path")).alias("b")).select("paper_id", "b.*")
    text = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True, recursiveFileLookup=True)
    paper = F.substring_index(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), ".", 1)
    dates = text.groupBy(paper.alias("paper_id")).agg(F.max(F.get_json_object("value", "$.published_date")).alias("published_date"))
    return files.select("path", "length", "content").join(best, "path").join(dates, "paper_id", "left")


def _sources(content: bytes) -> tuple[str | None, str | None]:
    """The main LaTeX file of an archive (by name, else the longest) and its longest bibliography."""
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as tar:
            files = [m for m in tar.getmembers() if m.isfile()]
            tex = [m for m in files if m.name.lower().endswith(".tex")]
            bbl = [m for m in files if m.name.lower().endswith(".bbl")]
            named = [m for m in tex if any(w in m.name.lower() for w in ("main", "paper"))]
            best = [named[0] if named else max(tex, key=lambda m: m.size) if tex else None, max(bbl, key=lambda m: m.size) if bbl else None]
            return tuple(None if m is None else tar.extractfile(m).read().decode("utf-8", "ignore") for m in best)
    except (tarfile.TarError, EOFError, OSError):
        return None, None


def latex_sources(files: DataFrame) -> DataFrame:
    """Adds to archives (paper_id, content) their ``latex`` and ``bbl`` texts; both are null if the archive can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_sources(bytes(x)) for x in batch["content"]]
            yield pd.DataFrame({"paper_id": batch["paper_id"], "latex": [a for a, _ in found], "bbl": [b for _, b in found]})

    return files.select("paper_id", "content").mapInPandas(run, "paper_id string, latex string, bbl string")


def messages(latex: DataFrame, most: int = 10_000_000) -> DataFrame:
    """What a model is asked about each paper: the LaTeX up to a length, after the numbered references, if any."""
    refs = T.numbered_references(F.coalesce("bbl", "latex"))
    hint = F.array_join(F.transform(refs, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")
    return latex.select("paper_id", F.concat(F.when(F.size(refs) > 0, F.concat(hint, F.lit("\n\n"))).otherwise(""), F.substring("latex", 1, most)).alias("message"))


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved documents with the file's time as ``saved_at``, where it has none."""
    found = spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True).select("*", "_metadata.file_modification_time")
    if "saved_at" in found.columns:
        return found.withColumn("saved_at", F.coalesce("saved_at", F.date_format("file_modification_time", "yyyy-MM-dd'T'HH:mm:ss"))).drop("file_modification_time")
    return found.withColumnRenamed("file_modification_time", "saved_at")


def first_of_sources(found: list[tuple[str, DataFrame]]) -> DataFrame:
    """For each paper the first source that has it: tables (paper_id, location) in order of preference."""
    out = None
    for place, (name, table) in enumerate(found):
        some = table.select("paper_id", F.lit(name).alias("source"), "location", F.lit(place).alias("place"))
        out = some if out is None else out.unionAll(some)
    return out.groupBy("paper_id").agg(F.min_by(F.struct("source", "location"), F.struct("place", "location")).alias("s")).select("paper_id", "s.*")


def matched_titles(asked: DataFrame, results: DataFrame, most: int = 5) -> DataFrame:
    """For each asked title, the first of its search results (query, n, title, ...) that is the same title but for case and marks."""
    key = T.title_match_key
    both = asked.join(results.where(F.col("n") <= most).withColumnRenamed("title", "found"), "query").where(key(F.col("query")) == key(F.col("found")))
    return both.groupBy("query").agg(F.min_by("found", "n").alias("title"))


def replayed(graph: Graph, spark: SparkSession, path: str, limit: int | None = None, papers: DataFrame | None = None) -> tuple[Graph, DataFrame]:
    """The graph after cached extractions, one JSON object a file, in order of the files' names; and how many files there are by ``cause``, null if they were processed.

    With ``limit``, the first files alone.  Files that aren't an extraction are counted by what is wrong with them (see
    ``extractions.cause``) and left out.  Of rows of one key the last file's count, so that one batch does what many in
    order would.  ``papers`` (see ``dataset_papers``) are written first, so that titles are known.
    """
    found = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"))
    if limit is not None:
        found = found.orderBy("file").limit(limit)
    found = written(X.parsed(ranked_by(found, "file").select(F.col("rank").cast("bigint").alias("seq"), "value")).drop("value"))
    if papers is not None:
        graph = replace(graph, paper=U.upsert_papers(graph.paper, papers.select(F.col("paper_id").alias("id"), "title", F.lit(0).alias("seq"))))
    return U.write_extracted(graph, found.where("cause is null").drop("cause")), found.groupBy("cause").agg(F.count("*").alias("n"))


def paper_texts(papers: DataFrame, latex: DataFrame, extractions: DataFrame) -> DataFrame:
    """For each paper (paper_id), its whole ``text``: the LaTeX with its bibliography, else the text that its extraction gives, else null; and which it is."""
    own = F.when(F.col("bbl").isNotNull(), F.concat_ws("\n\n", "latex", "bbl")).otherwise(F.col("latex"))
    made = extractions.select("paper_id", I.extraction_text(F.col("paper_summary"), F.col("claims"), F.col("entities"), F.col("cited_papers")).alias("made"))
    both = papers.join(latex.select("paper_id", own.alias("own")), "paper_id", "left").join(made, "paper_id", "left")
    return both.select("paper_id", F.coalesce("own", "made").alias("text"), F.when(F.col("own").isNotNull(), "latex").when(F.col("made").isNotNull(), "extraction").alias("origin"))


def idea_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of idea chains, one JSON object a file: texts that are missing are empty, and lists of experiments and entities come in either form."""
    texts = ("idea", "idea_chain", "experiment", "trend", "future", "human", "prompt")
    found = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    field = lambda name: F.get_json_object("value", f"$.{name}")
    raw = lambda name: F.from_json("value", "map<string, string>")[name]
    lists = {name: F.coalesce(F.from_json(field(name), "array<string>"), F.array().cast("array<string>")).alias(name) for name in ("year", "ideas")}
    return found.select(*(F.coalesce(field(name), F.lit("")).alias(name) for name in texts), I.related_experiments(raw("related_experiments")).alias("related_experiments"), I.entities_text(raw("entities")).alias("entities"), *lists.values())
