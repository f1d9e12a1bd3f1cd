"""Pairwise tournaments and absolute scores of ideas: pairs, swap test, ELO ratings, ranks and reports.

All tables have a column ``tournament``: many of them run side by side, dealt out by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("novelty", "significance", "feasibility", "clarity", "effectiveness")
START, K_FACTOR = 1000.0, 32.0


def all_pairs(ideas: DataFrame) -> DataFrame:
    """Each two ideas (tournament, idx from 0, idea) of a tournament once, the smaller ``idx`` first, numbered in order from 0: a round robin has n(n-1)/2 games by definition."""
    a, b = (ideas.select("tournament", F.col("idx").alias(f"{x}_idx"), F.col("idea").alias(f"idea_{x}")) for x in "ab")
    n = ideas.groupBy("tournament").agg(F.count("*").alias("n"))
    seq = (F.col("a_idx") * (2 * F.col("n") - F.col("a_idx") - 1) / 2 + F.col("b_idx") - F.col("a_idx") - 1).cast("bigint")
    return a.join(n, "tournament").join(b, "tournament").where("a_idx < b_idx").select("tournament", seq.alias("seq"), "idea_a", "idea_b")


def swap_resolved(raw: DataFrame) -> DataFrame:
    """Adds ``winner`` (a, b or tie), ``score`` for a, ``consistent`` and ``reasoning`` to answers ``ab`` and ``ba``: 0 first, 1 second, else tie.

    ``ba`` was asked in swapped order; answers that disagree make a tie.
    """
    back = F.when(F.col("ba") == 0, 1).when(F.col("ba") == 1, 0).otherwise(2)
    same = F.coalesce(F.col("ab") == back, F.lit(False))
    winner = F.when(same & (F.col("ab") == 0), "a").when(same & (F.col("ab") == 1), "b").otherwise("tie")
    out = raw.withColumns({"consistent": same, "winner": winner, "score": F.when(winner == "a", 1.0).when(winner == "b", 0.0).otherwise(0.5)})
    if "ab_reasoning" in raw.columns:
        apart = F.concat(F.lit("Inconsistent results (AB: "), F.col("ab_reasoning"), F.lit(", BA: "), F.col("ba_reasoning"), F.lit(")"))
        out = out.withColumn("reasoning", F.when(same, F.col("ab_reasoning")).otherwise(apart))
    return out


#: What plans of experiments are compared by.
EXPERIMENT_METRICS = ("feasibility", "quality", "clarity")


def experiments_resolved(answers: DataFrame) -> DataFrame:
    """The outcome of comparing two plans of experiments: a row for each metric of ``answers`` (tournament, seq, and ``ab_feasibility_score``, ``ab_feasibility_reasoning``, ``ba_...``).

    As ``swap_resolved``; answers that disagree have one fixed reasoning.
    """
    each = [F.struct(F.lit(m).alias("metric"), F.col(f"ab_{m}_score").alias("ab"), F.col(f"ba_{m}_score").alias("ba"), F.col(f"ab_{m}_reasoning").alias("said")) for m in EXPERIMENT_METRICS]
    rows = answers.select("tournament", "seq", F.explode(F.array(*each)).alias("x")).select("tournament", "seq", "x.*")
    return swap_resolved(rows).withColumn("reasoning", F.when(F.col("consistent"), F.col("said")).otherwise("Inconsistent results")).drop("said")


def elo_ratings(ideas: DataFrame, results: DataFrame, start: float = START, k_factor: float = K_FACTOR) -> DataFrame:
    """Ratings by tournament and metric after all games (tournament, seq, metric, idea_a, idea_b, score), one after the other.

    Each game depends on those before, so the games of a tournament's metric are read as a sorted stream by one task, which holds no
    more than the ratings of its ideas.  Ideas without a game keep the first rating.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name: tuple | None = None
        ratings: dict[str, float] = {}

        def out() -> pa.RecordBatch:
            n = len(ratings)
            return pa.RecordBatch.from_arrays([pa.array([name[0]] * n, pa.string()), pa.array([name[1]] * n, pa.string()), pa.array(list(ratings), pa.string()), pa.array(list(ratings.values()), pa.float64())], ["tournament", "metric", "idea", "rating"])

        for batch in found:
            for tournament, metric, a, b, score in zip(*(batch.column(c).to_pylist() for c in ("tournament", "metric", "idea_a", "idea_b", "score")), strict=True):
                if name != (tournament, metric):
                    if name:
                        yield out()
                    name, ratings = (tournament, metric), {}
                ra, rb = ratings.get(a, start), ratings.get(b, start)
                expected = 1.0 / (1.0 + 10 ** ((rb - ra) / 400.0))
                ratings[a] = ra + k_factor * (score - expected)
                ratings[b] = rb + k_factor * ((1.0 - score) - (1.0 - expected))
        if name:
            yield out()

    games = results.select(F.col("tournament").cast("string"), "seq", "metric", F.col("idea_a").cast("string"), F.col("idea_b").cast("string"), F.col("score").cast("double"))
    played = games.repartition("tournament", "metric").sortWithinPartitions("tournament", "metric", "seq").mapInArrow(run, "tournament string, metric string, idea string, rating double")
    every = ideas.select(F.col("tournament").cast("string").alias("tournament"), F.col("idea").cast("string").alias("idea")).withColumn("metric", F.explode(F.array(*map(F.lit, METRICS))))
    return every.join(played, ["tournament", "metric", "idea"], "left").withColumn("rating", F.coalesce("rating", F.lit(start)))


def overall(ratings: DataFrame, value: str = "rating") -> DataFrame:
    """Means over all metrics."""
    return ratings.groupBy("tournament", "idea").agg((F.sum(value) / len(METRICS)).alias("overall"))


def ranking(scores: DataFrame, ideas: DataFrame) -> DataFrame:
    """Ranks by ``overall`` within a tournament, which has some tens of ideas; no two are the same, ties go by ``idx``."""
    order = Window.partitionBy("tournament").orderBy(F.desc("overall"), "idx")
    return scores.join(ideas.select("tournament", "idea", "idx"), ["tournament", "idea"]).withColumn("rank", F.row_number().over(order))


def swap_bias(resolved: DataFrame) -> DataFrame:
    """By tournament and metric: games, share of consistent ones, and share in which the first place won both times."""
    first = ((F.col("ab") == 0) & (F.col("ba") == 0)).cast("int")
    return resolved.groupBy("tournament", "metric").agg(F.count("*").alias("games"), F.avg(F.col("consistent").cast("int")).alias("agreement"), F.avg(first).alias("first_twice"))


def sources_of(ideas: DataFrame, sources: DataFrame, known: tuple[str, ...] = ("graph", "coi", "target_paper")) -> DataFrame:
    """Adds each idea's ``source`` by ``idx`` (unknown ones are the first of ``known``) and whether it ``is_target``."""
    both = ideas.join(sources.select("tournament", "idx", F.col("source").alias("given")), ["tournament", "idx"], "left")
    source = F.when(F.col("given").isin(*known), F.col("given")).otherwise(known[0])
    return both.withColumn("source", source).withColumn("is_target", F.col("source") == "target_paper").drop("given")


def pairwise_report(ranked: DataFrame, ratings: DataFrame) -> DataFrame:
    """Lines of each tournament's report: section 0 ranks, section 1 metrics by idea."""
    from ..functions import text as T

    title = F.coalesce(F.nullif("title", F.lit("")), "idea")
    rows = ranked.select("tournament", F.lit(0).alias("section"), F.col("rank").alias("ord"), F.lit(0).alias("sub"), F.format_string("| %d | %s | %s |", "rank", title, T.fixed1(F.col("overall"))).alias("line"))
    number = F.array_position(F.array(*map(F.lit, METRICS)), F.col("metric")).cast("int")
    line = F.format_string("| %s | %s |", F.initcap("metric"), T.fixed1(F.col("rating")))
    return rows.unionAll(ranked.select("tournament", "idea", "rank").join(ratings, ["tournament", "idea"]).select("tournament", F.lit(1), F.col("rank"), number, line))


def single_report(ranked: DataFrame, scores: DataFrame) -> DataFrame:
    """Lines of the report on absolute scores: section 0 the table of ranks, section 1 the metrics by idea."""
    from ..functions import text as T

    wide = scores.groupBy("tournament", "idea").agg(*(F.max(F.when(F.col("metric") == m, F.col("score"))).alias(m) for m in METRICS))
    cells = [F.coalesce(F.col(m).cast("string"), F.lit("-")) for m in METRICS]
    title = F.coalesce(F.nullif("title", F.lit("")), "idea")
    rows = ranked.join(wide, ["tournament", "idea"]).select("tournament", F.lit(0).alias("section"), F.col("rank").alias("ord"), F.lit(0).alias("sub"), F.concat(F.format_string("| %d | %s | %s | ", "rank", title, T.fixed1(F.col("overall"))), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    number = F.array_position(F.array(*map(F.lit, METRICS)), F.col("metric")).cast("int")
    line = F.format_string("- **%s** (%d/10): %s", F.initcap("metric"), "score", "reasoning")
    return rows.unionAll(ranked.select("tournament", "idea", "rank").join(scores, ["tournament", "idea"]).select("tournament", F.lit(1), F.col("rank"), number, line))


def evaluation_documents(ranked: DataFrame, ratings: DataFrame, at: F.Column, model: str) -> DataFrame:
    """A JSON document (key, content) of each tournament's evaluation: when, by which model, ratings by metric and overall, and the ranking.

    ``ranked`` has tournament, idea, title, overall and rank, ``ratings`` tournament, idea, metric and rating.  Documents
    are named by their time, in a folder by tournament.
    """
    pairs = lambda *names: F.map_from_entries(F.collect_list(F.struct(*names)))
    by_metric = ratings.groupBy("tournament", "metric").agg(pairs("idea", "rating").alias("r")).groupBy("tournament").agg(pairs("metric", "r").alias("by_metric"))
    scores = ratings.groupBy("tournament", "idea").agg(pairs("metric", "rating").alias("scores_by_metric"))
    place = lambda a, b: a["rank"] - b["rank"]
    entry = F.struct("rank", F.col("idea").alias("idea_id"), F.col("title").alias("idea_title"), F.col("overall").alias("overall_score"), "scores_by_metric")
    rows = ranked.join(scores, ["tournament", "idea"], "left")
    found = rows.groupBy("tournament").agg(F.array_sort(F.collect_list(entry), place).alias("ranking"), pairs("idea", "overall").alias("overall_ratings")).join(by_metric, "tournament", "left").withColumn("at", at)
    elo = F.struct(F.col("by_metric").alias("ratings_by_metric"), "overall_ratings")
    content = F.to_json(F.struct(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("evaluated_at"), F.lit(model).alias("model_name"), elo.alias("elo_ratings"), "ranking"))
    return found.select(F.concat_ws("/", F.col("tournament").cast("string"), F.concat(F.lit("evaluation_"), F.date_format("at", "yyyyMMdd_HHmmss"), F.lit(".json"))).alias("key"), content.alias("content"))


def loaded_evaluations(documents: DataFrame) -> DataFrame:
    """The rankings of saved evaluations (key, content): key, evaluated_at, and a row for each idea with its scores by metric."""
    kind = "evaluated_at timestamp_ntz, ranking array<struct<rank: int, idea_id: string, idea_title: string, overall_score: double, scores_by_metric: map<string, double>>>"
    found = documents.select("key", F.from_json(F.col("content").cast("string"), kind).alias("e"))
    return found.select("key", "e.evaluated_at", F.explode("e.ranking").alias("r")).select("key", "evaluated_at", "r.*")


def report_documents(lines: DataFrame, name: str) -> DataFrame:
    """A text (key, content) of each tournament's report, from its lines (see ``pairwise_report``, ``single_report``)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "ord", "sub", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("tournament").agg(text.alias("content")).select(F.concat_ws("/", F.col("tournament").cast("string"), F.lit(name)).alias("key"), "content")
