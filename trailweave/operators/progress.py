"""Progress of papers through ingestion: status from updates, summaries, what is left, and download outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "downloading", "extracting", "writing", "completed", "failed", "not_found")
FAILED = ("failed", "not_found")


def classified(message: F.Column) -> F.Column:
    """What a failed download's message means; without a message it is a failure."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return F.when(text.contains("not found") | text.contains("no open access pdf"), "not_found").otherwise("failed")


def folded(updates: DataFrame) -> DataFrame:
    """For each paper, from updates (paper_id, status, error, ts, seq): its last status, that one's error, and the first times it was begun and completed.

    All parts are aggregates that can be merged, so that results of batches fold on into the same state.
    """
    return updates.groupBy("paper_id").agg(
        F.max_by(F.struct("status", F.when(F.col("status").isin(*FAILED), F.col("error")).alias("error")), F.struct("ts", "seq")).alias("last"),
        F.min(F.when(F.col("status") == "downloading", F.col("ts"))).alias("started_at"),
        F.min(F.when(F.col("status") == "completed", F.col("ts"))).alias("completed_at"),
        F.max(F.struct("ts", "seq")).alias("at"),
    ).select("paper_id", "last.status", F.col("last.error").alias("error_message"), "started_at", "completed_at", "at")


def merged(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state (see ``folded``) after another batch's."""
    both = state.unionByName(batch)
    return both.groupBy("paper_id").agg(
        F.max_by(F.struct("status", "error_message"), "at").alias("last"), F.min("started_at").alias("started_at"), F.min("completed_at").alias("completed_at"), F.max("at").alias("at")
    ).select("paper_id", "last.*", "started_at", "completed_at", "at")


def current(registered: DataFrame, state: DataFrame) -> DataFrame:
    """Registered papers with their state; those without updates are pending, and updates of others are ignored."""
    return registered.join(state.drop("at"), "paper_id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def summary(papers: DataFrame) -> DataFrame:
    """Counts by source, and of all (source null): unknown statuses are pending."""
    busy = ("downloading", "extracting", "writing")
    count = lambda *names: F.count_if(F.col("status").isin(*names))
    return papers.withColumn("source", F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))).rollup("source").agg(
        F.count("*").alias("total_known"), count("completed").alias("completed"), count("failed").alias("failed"), count("not_found").alias("not_found"),
        count(*busy).alias("in_progress"), F.count_if(~F.col("status").isin("completed", *FAILED, *busy)).alias("pending"),
    )


def dataset_summary(papers: DataFrame, total: int) -> DataFrame:
    """Counters of the data set's own papers against a given total."""
    own = papers.where("source = 'dataset'").agg(F.count_if(F.col("status") == "completed").alias("processed"), F.count_if(F.col("status").isin(*FAILED)).alias("failed"))
    return own.select(F.lit(total).cast("bigint").alias("total"), "processed", "failed", F.greatest(F.lit(0).cast("bigint"), F.lit(total) - F.col("processed") - F.col("failed")).alias("pending"))


def left_to_do(papers: DataFrame, done: DataFrame) -> DataFrame:
    return papers.join(done.select("paper_id").distinct(), "paper_id", "left_anti")


def open_papers(papers: DataFrame) -> DataFrame:
    """Papers to take up again; one that was being written is neither open nor done."""
    return papers.where(F.col("status").isin("pending", "downloading", "extracting")).select("paper_id")
