"""The trigram index against looking at every name."""

import random

import pytest

from trailweave.operators import lookups
from trailweave.operators.substrings import NameIndex


@pytest.fixture(scope="module")
def names():
    rng = random.Random(6)
    found = [(f"N{k}", "".join(rng.choice("abcAB ä😀") for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 12, 40])))) for k in range(600)]
    return [*found, ("N1", "again abc"), ("null", None), (None, "cab cab"), ("hot", "abcabcabc"), *[(f"H{k}", "the same name of many") for k in range(200)]]


@pytest.fixture(scope="module")
def index(spark, names, tmp_path_factory):
    return NameIndex.write(spark.createDataFrame(names, "id string, name string"), str(tmp_path_factory.mktemp("index")))


def pairs(df):
    return sorted(map(tuple, df.collect()), key=repr)


ASKED = [["abc"], ["ABc "], ["a"], ["ab"], [""], ["ä😀"], ["zzz"], ["abcabcabcabcabc"], ["same name", "cab", "b", "nowhere"], []]


@pytest.mark.parametrize("asked", ASKED, ids=str)
def test_containing(index, names, asked):
    want = {(i, n.lower()) for i, n in names if n is not None and any(a.lower() in n.lower() for a in asked)}
    assert pairs(index.containing(asked)) == sorted(want, key=repr)


@pytest.mark.parametrize("asked", [*ASKED, ["x the same name of many y", "cab cab abca"]], ids=str)
def test_within(index, names, asked):
    want = {(i, n.lower()) for i, n in names if n is not None and any(n.lower() in a.lower() for a in asked)}
    assert pairs(index.within(asked)) == sorted(want, key=repr)


def test_highlight(spark, index, names):
    nodes = spark.createDataFrame(names, "id string, name string")
    path = [("N3", None), ("null", "no such"), ("hot", "xABCABCabcx"), ("N9", "cab")]
    said = [n.lower() for _, n in path if n is not None]
    want = sorted(((i, n) for i, n in names if i in {i for i, _ in path} or i is not None and n is not None and any(a in n.lower() or n.lower() in a for a in said)), key=repr)
    found = lookups.highlight(nodes, spark.createDataFrame(path, "id string, name string"), index)
    assert sorted(set(pairs(found)), key=repr) == sorted(set(want), key=repr) or {i for i, _ in pairs(found)} == {i for i, _ in want}
    with pytest.raises(ValueError, match="more than 3 nodes"):
        lookups.highlight(nodes, spark.createDataFrame(path, "id string, name string"), index, most=3)


def test_a_search_reads_its_lists_alone(index):
    plan = index.containing(["same name"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [EqualTo(gram" in plan or "EqualTo(gram" in plan
    assert not any(x in plan for x in ("NestedLoop", "Cartesian"))
    assert "NestedLoop" not in index.within(["same name"])._jdf.queryExecution().executedPlan().toString()
    assert index.rarest(["same name", "abc"])["same name"] in {"sam", "ame", "me ", "e n", " na", "nam"} and index.rarest(["zzzz"]) == {"zzzz": None}


def test_a_search_with_a_limit_has_the_first_rows(spark, tmp_path):
    """Neighbours are looked up for the first nodes alone, and relationships are computed once for both directions."""
    from trailweave.operators import paths
    from trailweave.sources import graph_fixture

    sf = "/root/testdata/sf0.001"
    g = graph_fixture.load(spark, sf, dates=False)
    index = NameIndex.write(lookups.names(g).select("id", "name"), str(tmp_path))
    every = sorted(((r["id"], r["key"] is None, r["key"] or "", r["neighbour"] or "") for r in lookups.keyword_search(g, "brand#2", index).collect()))
    for limit in (1, 7, 60):
        some = [(r["id"], r["key"] is None, r["key"] or "", r["neighbour"] or "") for r in lookups.keyword_search(g, "brand#2", index, limit=limit).collect()]
        assert sorted(some) == every[:limit]
    assert "Union" not in paths.both_ways(spark.createDataFrame([("a", "b", "X", "Y", "k")], "src string, dst string, src_label string, dst_label string, key string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in lookups.names(g).select("id", "name")._jdf.queryExecution().optimizedPlan().toString()
