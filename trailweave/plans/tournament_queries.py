"""Tournaments of eight parts each as ideas, by their keys in order, with answers made of their sizes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import tournament as M
from ..sources import keyed_files
from ..sources.tables import scratch, written
from ._registry import Registry

R = Registry()
_SIZE = 8
_METRICS = ", ".join(f"({k}, '{m}')" for k, m in enumerate(M.METRICS))
SQL = f"""ideas AS (SELECT 'T' || (p_partkey // {_SIZE}) AS tournament, CAST(row_number() OVER (PARTITION BY p_partkey // {_SIZE} ORDER BY p_partkey) - 1 AS INTEGER) AS idx, 'P' || p_partkey AS idea, p_name AS title, p_size FROM part),
metrics(m, metric) AS (VALUES {_METRICS}),
pairs AS (SELECT a.tournament, row_number() OVER (PARTITION BY a.tournament ORDER BY a.idx, b.idx) - 1 AS seq, a.idx AS ai, b.idx AS bi, a.idea AS idea_a, b.idea AS idea_b, a.p_size AS sa, b.p_size AS sb FROM ideas a JOIN ideas b ON a.tournament = b.tournament AND a.idx < b.idx),
raw AS (SELECT *, (sa + seq + m) % 3 AS ab, (sb + seq + m) % 3 AS ba FROM pairs, metrics),
resolved AS (SELECT *, ab = CASE ba WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS consistent FROM raw),
games AS (SELECT *, CASE WHEN consistent AND ab = 0 THEN 'a' WHEN consistent AND ab = 1 THEN 'b' ELSE 'tie' END AS winner, CASE WHEN consistent AND ab = 0 THEN 1.0 WHEN consistent AND ab = 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS score FROM resolved)
"""
ELO = f"""WITH RECURSIVE {SQL}, sizes AS (SELECT tournament, count(*) AS n FROM ideas GROUP BY 1),
fold AS (SELECT tournament, metric, 0 AS step, [1000.0::DOUBLE FOR i IN range({_SIZE})] AS r FROM sizes, metrics
UNION ALL SELECT f.tournament, f.metric, step + 1, [CASE WHEN i = ai THEN r[ai + 1] + 32 * (score - 1 / (1 + pow(10, (r[bi + 1] - r[ai + 1]) / 400))) WHEN i = bi THEN r[bi + 1] + 32 * ((1 - score) - (1 - 1 / (1 + pow(10, (r[bi + 1] - r[ai + 1]) / 400)))) ELSE r[i + 1] END FOR i IN range({_SIZE})]
  FROM fold f JOIN games g ON g.tournament = f.tournament AND g.metric = f.metric AND g.seq = f.step),
ratings AS (SELECT f.tournament, metric, idea, r[idx + 1] AS rating FROM fold f JOIN sizes s ON s.tournament = f.tournament AND step = n * (n - 1) // 2 JOIN ideas i ON i.tournament = f.tournament),
overalls AS (SELECT tournament, idea, sum(rating) / 5 AS overall FROM ratings GROUP BY ALL)
"""


def _ideas(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_size", F.floor(F.col("p_partkey") / _SIZE).alias("t"))
    place = F.row_number().over(Window.partitionBy("t").orderBy("p_partkey")) - 1  # of up to eight
    return part.select(F.concat(F.lit("T"), F.col("t").cast("string")).alias("tournament"), place.alias("idx"), F.concat(F.lit("P"), "p_partkey").alias("idea"), F.col("p_name").alias("title"), F.col("p_size").alias("size"))


def _asked(spark, d):
    """All pairs with both ideas' sizes, of which answers are made."""
    ideas = _ideas(spark, d)
    size = lambda name: ideas.select("tournament", F.col("idea").alias(f"idea_{name}"), F.col("size").alias(f"size_{name}"))
    return M.all_pairs(ideas).join(size("a"), ["tournament", "idea_a"]).join(size("b"), ["tournament", "idea_b"])


def _resolved(spark, d):
    raw = _asked(spark, d).select("*", F.posexplode(F.array(*map(F.lit, M.METRICS))).alias("m", "metric"))
    answers = {k: (F.col(f"size_{x}") + F.col("seq") + F.col("m")) % 3 for k, x in (("ab", "a"), ("ba", "b"))}
    return M.swap_resolved(raw.withColumns(answers))


def _rated(spark, d):
    return M.elo_ratings(_ideas(spark, d), _resolved(spark, d))


@R.add("all_pairs", f"WITH {SQL} SELECT tournament, seq, idea_a, idea_b FROM pairs")
def all_pairs(spark, d):
    return M.all_pairs(_ideas(spark, d))


@R.add("swap_resolve", f"WITH {SQL} SELECT tournament, seq, metric, winner, score, consistent FROM games")
def swap_resolve(spark, d):
    return _resolved(spark, d).select("tournament", "seq", "metric", "winner", "score", "consistent")


@R.add("swap_experiments", f"""WITH {SQL}, kinds(k, metric) AS (VALUES (0, 'feasibility'), (1, 'quality'), (2, 'clarity')), asked AS (SELECT tournament, seq, metric, (sa + seq + k) % 3 AS ab, (sb + seq + k) % 3 AS ba, idea_a || k AS said FROM pairs, kinds),
told AS (SELECT *, ab = CASE ba WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS consistent FROM asked)
SELECT tournament, seq, metric, CASE WHEN consistent AND ab = 0 THEN 'a' WHEN consistent AND ab = 1 THEN 'b' ELSE 'tie' END AS winner, CASE WHEN consistent THEN said ELSE 'Inconsistent results' END AS reasoning FROM told""")
def swap_experiments(spark, d):
    answers = _asked(spark, d)
    for k, m in enumerate(M.EXPERIMENT_METRICS):
        score = {x: (F.col(f"size_{y}") + F.col("seq") + k) % 3 for x, y in (("ab", "a"), ("ba", "b"))}
        answers = answers.withColumns({f"{x}_{m}_{what}": value for x in ("ab", "ba") for what, value in (("score", score[x]), ("reasoning", F.concat("idea_a", F.lit(str(k)))))})
    return M.experiments_resolved(answers).select("tournament", "seq", "metric", "winner", "reasoning")


@R.add("swap_bias", f"WITH {SQL} SELECT tournament, metric, count(*) AS games, avg(consistent::INT) AS agreement, avg((ab = 0 AND ba = 0)::INT) AS first_twice FROM games GROUP BY ALL")
def swap_bias(spark, d):
    return M.swap_bias(_resolved(spark, d))


@R.add("elo_ratings", ELO + "SELECT tournament, metric, idea, round(rating, 6) AS rating FROM ratings")
def elo_ratings(spark, d):
    return _rated(spark, d).withColumn("rating", F.round("rating", 6))


def _overall(spark, d):
    """Rounded, so that equal ratings tie in either engine."""
    return M.overall(_rated(spark, d)).withColumn("overall", F.round("overall", 6))


@R.add("elo_ranking", ELO + "SELECT tournament, idea, round(overall, 6) AS overall, CAST(row_number() OVER (PARTITION BY tournament ORDER BY round(overall, 6) DESC, idx) AS INTEGER) AS rank FROM overalls JOIN ideas USING (tournament, idea)")
def elo_ranking(spark, d):
    return M.ranking(_overall(spark, d), _ideas(spark, d)).select("tournament", "idea", "overall", "rank")


@R.add("report_pairwise", ELO + """, ranked AS (SELECT * REPLACE (round(overall, 6) AS overall), row_number() OVER (PARTITION BY tournament ORDER BY round(overall, 6) DESC, idx) AS rank FROM overalls JOIN ideas USING (tournament, idea))
SELECT tournament, 0 AS section, CAST(rank AS INTEGER) AS ord, 0 AS sub, '| ' || rank || ' | ' || title || ' | ' || printf('%.1f', overall) || ' |' AS line FROM ranked
UNION ALL SELECT tournament, 1, CAST(rank AS INTEGER), CAST(m + 1 AS INTEGER), '| ' || upper(metric[1]) || metric[2:] || ' | ' || printf('%.1f', rating) || ' |' FROM ratings JOIN ranked USING (tournament, idea) JOIN metrics USING (metric)""")
def report_pairwise(spark, d):
    ideas, rated = _ideas(spark, d), _rated(spark, d)
    ranked = M.ranking(_overall(spark, d), ideas).join(ideas.select("idea", "title"), "idea")
    return M.pairwise_report(ranked, rated)


@R.add("saved_evaluations", ELO + """, ranked AS (SELECT tournament, idea, title, round(overall, 6) AS overall, CAST(row_number() OVER (PARTITION BY tournament ORDER BY round(overall, 6) DESC, idx) AS INTEGER) AS rank FROM overalls JOIN ideas USING (tournament, idea))
SELECT tournament || '/evaluation_20240131_080910.json' AS key, idea AS idea_id, title AS idea_title, rank, overall AS overall_score, round(rating, 6) AS novelty FROM ranked JOIN ratings USING (tournament, idea) WHERE metric = 'novelty'
UNION ALL SELECT tournament || '/report.md', NULL, '| 1 | ' || title || ' | ' || printf('%.1f', overall) || ' |', NULL, NULL, NULL FROM ranked WHERE rank = 1""")
def saved_evaluations(spark, d):
    """Evaluations and reports as files of their own, read back: rankings, and the first line of each report."""
    ideas, rated = _ideas(spark, d), written(_rated(spark, d))
    overall = M.overall(rated).withColumn("overall", F.round("overall", 6))
    ranked = M.ranking(overall, ideas).join(ideas.select("idea", "title"), "idea")
    path = scratch(spark, "files")
    keyed_files.write(M.evaluation_documents(ranked, rated.withColumn("rating", F.round("rating", 6)), F.lit("2024-01-31 08:09:10").cast("timestamp_ntz"), "none"), path)
    keyed_files.write(M.report_documents(M.pairwise_report(ranked, rated), "report.md"), path)
    found = keyed_files.read(spark, path)
    rankings = M.loaded_evaluations(found.where(F.col("key").endswith(".json"))).select("key", "idea_id", "idea_title", "rank", "overall_score", F.col("scores_by_metric")["novelty"].alias("novelty"))
    none = lambda kind: F.lit(None).cast(kind)
    return rankings.unionAll(found.where(F.col("key").endswith(".md")).select("key", none("string"), F.substring_index(F.col("content").cast("string"), "\n", 1), none("int"), none("double"), none("double")))


_SINGLE = SQL + ", scored AS (SELECT tournament, idea, idx, title, metric, m, CAST(1 + (p_size + m * 7) % 10 AS INTEGER) AS score FROM ideas, metrics), singles AS (SELECT tournament, idea, idx, title, sum(score) / 5.0 AS overall FROM scored GROUP BY ALL)"


def _scored(spark, d):
    return _ideas(spark, d).select("tournament", "idea", "size", F.posexplode(F.array(*map(F.lit, M.METRICS))).alias("m", "metric")).withColumn("score", (1 + (F.col("size") + F.col("m") * 7) % 10).cast("int"))


@R.add("single_overall", f"WITH {_SINGLE} SELECT tournament, idea, CAST(overall AS DOUBLE) AS overall FROM singles")
def single_overall(spark, d):
    return M.overall(_scored(spark, d), "score")


@R.add("single_ranking", f"WITH {_SINGLE} SELECT tournament, idea, CAST(row_number() OVER (PARTITION BY tournament ORDER BY overall DESC, idx) AS INTEGER) AS rank FROM singles")
def single_ranking(spark, d):
    return M.ranking(M.overall(_scored(spark, d), "score"), _ideas(spark, d)).select("tournament", "idea", "rank")


@R.add("report_single", f"""WITH {_SINGLE}, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY tournament ORDER BY overall DESC, idx) AS INTEGER) AS rank FROM singles)
SELECT tournament, 0 AS section, rank AS ord, 0 AS sub, '| ' || rank || ' | ' || title || ' | ' || printf('%.1f', overall) || ' | ' || cells || ' |' AS line FROM ranked JOIN (SELECT idea, string_agg(score, ' | ' ORDER BY m) AS cells FROM scored GROUP BY idea) USING (idea)
UNION ALL SELECT tournament, 1, rank, CAST(m + 1 AS INTEGER), '- **' || upper(metric[1]) || metric[2:] || '** (' || score || '/10): because' FROM ranked JOIN scored USING (tournament, idea, idx, title)""")
def report_single(spark, d):
    ideas, scored = _ideas(spark, d), _scored(spark, d).withColumn("reasoning", F.lit("because"))
    ranked = M.ranking(M.overall(scored, "score"), ideas).join(ideas.select("idea", "title"), "idea")
    return M.single_report(written(ranked.select("tournament", "idea", "title", "overall", "rank")), scored)


@R.add("proposal_source_map", f"WITH {SQL} SELECT tournament, idx, idea, CASE WHEN p_size % 4 = 1 THEN 'coi' WHEN p_size % 4 = 2 THEN 'target_paper' ELSE 'graph' END AS source, p_size % 4 = 2 AS is_target FROM ideas")
def proposal_source_map(spark, d):
    ideas = _ideas(spark, d)
    given = F.when(F.col("size") % 4 == 1, "coi").when(F.col("size") % 4 == 2, "target_paper").otherwise("unheard of")
    return M.sources_of(ideas, ideas.where("size % 4 > 0").select("tournament", "idx", given.alias("source"))).select("tournament", "idx", "idea", "source", "is_target")
