"""The best paths by branch and bound against ranking all of them, and how many paths either finds."""

import random

import pytest
from pyspark.sql import functions as F

from trailweave.operators import paths

EDGE = "src string, dst string, type string, src_label string, dst_label string, importance_score int, citation_type string, context string, key string"


def graph(spark, seed, nodes, edges):
    rng, rows = random.Random(seed), {}
    for _ in range(edges):
        a, b = rng.randrange(nodes), rng.randrange(nodes)
        kind = rng.choice(["CITES"] * 6 + ["MENTIONS", "USES", "EXTENDS", "ALIAS_OF"])
        label = ["Paper" if n % 4 else "Entity" for n in (a, b)]
        cited = (rng.choice([None, 1, 2, 3, 4, 5]), rng.choice(["EXTENDS", "USES", "COMPARES", None])) if kind == "CITES" else (None, None)
        rows[a, kind, b] = (f"N{a}", f"N{b}", kind, *label, *cited, None, f"N{a}>{kind}>N{b}")
    return spark.createDataFrame(list(rows.values()), EDGE)


def shown(df):
    return [(r["rank"], r["keys"], r["score"]) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize(("seed", "top"), [(1, 5), (2, 1), (3, 40), (4, 100_000), (5, 0)])
def test_same_rows_as_ranking_all(spark, seed, top):
    edge = graph(spark, seed, 30, 120)
    want = paths.ranked(paths.candidates(paths.expand(edge, "N1", 3)), paths.rank_order(), top=top)
    assert shown(paths.best(edge, "N1", 3, top)) == shown(want)


def test_far_fewer_paths_are_found(spark):
    edge, kept, found = graph(spark, 7, 60, 420), [], []

    def count(into):
        def keep(level, left):
            into.append(level.count())
            return level

        return keep

    best = shown(paths.best(edge, "N1", 4, 10, keep=count(kept)))
    every = paths.expand(edge, "N1", 4, keep=count(found))
    assert best == shown(paths.ranked(paths.candidates(every), paths.rank_order(), top=10))
    assert len(best) == 10 and sum(found) > 1000 and 5 * sum(kept) < sum(found)


def test_bounds_are_never_too_low(spark):
    edge = graph(spark, 9, 25, 80)
    more = [{r["node"]: r["more"] for r in b.collect()} for b in paths.bounds(edge, 3)]
    for row in paths.expand(edge, "N2", 3, return_to_start=True).select("weight", "hops").withColumn("gain", F.col("weight") - 2 * F.col("hops")).collect():
        assert row["gain"] <= more[row["hops"] - 1].get("N2", 0.0)


def test_paths_that_go_on_are_written(spark):
    """The next hop's join so knows that they are few, and doesn't deal out all relationships."""
    from trailweave.operators import paths

    edge = spark.createDataFrame([("A", "B", "CITES", "Paper", "Paper", 1, "USES", None, "A>CITES>B"), ("B", "C", "CITES", "Paper", "Paper", 1, "USES", None, "B>CITES>C")], "src string, dst string, type string, src_label string, dst_label string, importance_score int, citation_type string, context string, key string")
    found = paths.expand(edge, "A", 2)
    assert any("/table-" in f for f in found.inputFiles()) and sorted(r["node"] for r in found.collect()) == ["B", "C"]
