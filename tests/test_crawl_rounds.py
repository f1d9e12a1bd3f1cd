"""Best-first crawls by rounds over tables, against the queue of one process."""

import random

import pytest

from trailweave.operators import crawl


def graph(spark, seed, nodes=24, degree=3):
    rng = random.Random(seed)
    rows = [(f"P{a}", f"P{b}", rng.randrange(1, 6)) for a in range(nodes) for b in rng.sample(range(nodes), degree)]
    return crawl.top_citations(spark.createDataFrame(rows, "src string, dst string, importance int"), degree).cache()


@pytest.mark.parametrize(("seed", "depth", "limit"), [(1, 2, None), (2, 3, None), (3, 3, 7), (4, 0, None)])
def test_same_order(spark, seed, depth, limit):
    top = graph(spark, seed)
    seeds, completed = ["P0", "P5", "P0"], frozenset({"P3", "P7", "P11"})
    want = [(n, *row) for n, row in enumerate(crawl.best_first(seeds, top, depth, limit, completed))]
    assert [tuple(r) for r in crawl.best_first_table(seeds, top, depth, limit, completed).orderBy("place").collect()] == want
    found = crawl.best_first_table(seeds, top, depth, limit, completed, max_edges=1).orderBy("place").collect()
    assert [tuple(r) for r in found] == want


def test_more_citations_than_the_queue_may_hold(spark):
    with pytest.raises(crawl.TooManyCitations):
        crawl.best_first(["P0"], graph(spark, 1), 3, max_edges=2)


def test_queue_statistics(spark):
    top = graph(spark, 6)
    order = crawl.best_first(["P0"], top, 3, 5, frozenset({"P3"}))
    reached = crawl.by_levels(spark.createDataFrame([("P0",)], "id string"), top, 3)
    found = crawl.queue_statistics(crawl.best_first_table(["P0"], top, 3, 5, frozenset({"P3"})), reached).first()
    visited = {r[0] for r in order}
    assert tuple(found) == (len(order), 5, len(order) - 5, len({r["id"] for r in reached.collect()} - visited))
