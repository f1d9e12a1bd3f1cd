"""Saved documents (analyses and proposals): lists, lookups, updates, groups and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIST_LIMIT = 50


def latest(docs: DataFrame) -> DataFrame:
    """One row for each ``id``, the one saved last; ties go to the later ``seq``."""
    names = [c for c in docs.columns if c != "id"]
    return docs.groupBy("id").agg(F.max_by(F.struct(*names), F.struct("saved_at", "seq")).alias("d")).select("id", "d.*")


def listed(docs: DataFrame, paper: str | None = None, limit: int = LIST_LIMIT) -> DataFrame:
    """Newest first, each id once, of one paper or all."""
    found = latest(docs)
    if paper is not None:
        found = found.where(F.col("target_paper_id") == paper)
    return found.orderBy(F.desc("saved_at"), F.desc("seq")).limit(limit)


def lookup(docs: DataFrame, ids: DataFrame, places: tuple[str, ...]) -> DataFrame:
    """Documents by id; of several in different ``place``s, the one in the first of them."""
    found = docs.join(ids.select("id").distinct(), "id", "left_semi")
    at = F.array_position(F.array(*map(F.lit, places)), F.col("place"))
    order = Window.partitionBy("id").orderBy(F.when(at > 0, at).asc_nulls_last(), "seq")
    return found.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def updated(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Documents with ``rating`` and ``notes`` of ``changes`` (id, rating, notes, seq) that aren't null; the last of each counts."""
    change = changes.groupBy("id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}") for c in ("rating", "notes")))
    both = docs.join(change, "id", "left")
    return both.withColumns({c: F.coalesce(f"new_{c}", c) for c in ("rating", "notes")}).select(*docs.columns)


def deleted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("id").distinct(), "id", "left_anti")


def groups(docs: DataFrame) -> DataFrame:
    """Proposals that belong together, by analysis, else prompt, else id: how many, the newest date, and their order of appearance."""
    some = lambda kind, name: F.concat(F.lit(f"{kind}:"), F.nullif(F.col(name), F.lit("")))
    key = F.coalesce(some("analysis", "analysis_id"), some("prompt", "prompt"), F.concat(F.lit("proposal:"), "id"))
    return docs.groupBy(key.alias("group_key")).agg(F.count("*").alias("proposals"), F.max("saved_at").alias("latest"), F.min("seq").alias("first_seq"))


def _part(head: str, name: str, tail: str = "\n") -> F.Column:
    return F.coalesce(F.concat(F.lit(head), F.nullif(F.col(name).cast("string"), F.lit("")), F.lit(tail)), F.lit(""))


def markdown(docs: DataFrame) -> DataFrame:
    """Each proposal (id, number, title, target_paper_id, rating, notes, saved_at, prompt, motivation, method, differences) as Markdown.

    The headings are fixed values.
    """
    stars = F.when(F.col("rating") > 0, F.concat(F.lit("- **評価**: "), F.repeat(F.lit("★"), F.col("rating")), F.repeat(F.lit("☆"), F.greatest(5 - F.col("rating"), F.lit(0))), F.lit("\n"))).otherwise("")
    other = lambda name: F.coalesce(F.col(name), F.lit("N/A"))
    differences = F.when(F.col("differences").isNotNull(), F.concat(F.lit("### 既存研究との差異\n"), F.array_join(F.transform("differences", lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""), F.lit("\n"))).otherwise("")
    text = F.concat(
        F.lit("## 提案 "), F.col("number").cast("string"), F.lit(": "), F.coalesce("title", F.lit("Untitled")), F.lit("\n\n- **対象論文**: "), F.col("target_paper_id"), F.lit("\n"),
        stars, _part("- **メモ**: ", "notes"), F.lit("- **保存日時**: "), F.col("saved_at"), F.lit("\n\n"), _part("### 生成プロンプト\n```text\n", "prompt", "\n```\n\n"),
        F.lit("### 動機\n"), other("motivation"), F.lit("\n\n### 手法\n"), other("method"), F.lit("\n\n"), differences, F.lit("---\n\n"),
    )
    return docs.select("id", "number", text.alias("markdown"))


def chosen(docs: DataFrame, ids: list[str] | None = None, paper: str | None = None) -> DataFrame:
    """Documents to export with their ``number``: those asked for in their order, missing ones left out, else the list."""
    if ids:
        asked = docs.sparkSession.createDataFrame(list(enumerate(ids)), "at int, id string")
        found = asked.join(latest(docs), "id")
        return found.withColumn("number", F.row_number().over(Window.orderBy("at"))).drop("at")
    found = listed(docs, paper)
    return found.withColumn("number", F.row_number().over(Window.orderBy(F.desc("saved_at"), F.desc("seq"))))


def exported_json(docs: DataFrame) -> DataFrame:
    return docs.select("id", "number", F.to_json(F.struct(*[c for c in docs.columns if c != "number"])).alias("json"))
