"""Operators over small graphs made by hand."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from trailweave.functions import text as T
from trailweave.operators import adhoc, context, crawl, documents, lookups, paths, progress, tournament, upserts
from trailweave.operators.substrings import NameIndex
from trailweave.sources import files
from trailweave.sources.graph_fixture import Graph

EDGE = "src string, dst string, type string, src_label string, dst_label string, importance_score int, citation_type string, context string, key string"


def make(spark, edges, papers=(), entities=()):
    rows = [(s, d, t, "Paper" if s[0] == "P" else "Entity", "Paper" if d[0] == "P" else "Entity", i, c, x, f"{s}>{t}>{d}") for s, d, t, i, c, x in edges]
    ids = sorted({x for e in edges for x in e[:2]})
    paper = [*papers, *((i, f"Title {i}", f"About {i}", None) for i in ids if i[0] == "P" and i not in {p[0] for p in papers})]
    entity = [*entities, *((i, "Method", f"Name {i}", "") for i in ids if i[0] == "E" and i not in {e[0] for e in entities})]
    return Graph(
        spark.createDataFrame(paper, "id string, title string, summary string, published_date string"),
        spark.createDataFrame(entity, "id string, type string, name string, description string"),
        spark.createDataFrame(rows, EDGE),
    )


@pytest.fixture(scope="module")
def small(spark):
    return make(
        spark,
        [("P1", "P2", "CITES", 5, "EXTENDS", "c"), ("P2", "P3", "CITES", None, None, None), ("P3", "P1", "CITES", 1, "USES", ""), ("P1", "E1", "MENTIONS", None, None, None), ("E1", "E2", "ENABLES", None, None, None), ("E2", "E3", "ALIAS_OF", None, None, None), ("P2", "P2", "CITES", 2, "COMPARES", None)],
        [("P1", "One", "s1", "2020-01-01T00:00:00"), ("P2", "Two [2]", "s2", "2019-01-01T00:00:00"), ("P3", "", "s3", "2021-05-05T00:00:00")],
        [("E1", "Method", "Tree", "tall"), ("E2", "", "Leaf", ""), ("E3", "Task", "Root", None)],
    )


def test_expand_uses_no_edge_twice_and_does_not_return(small):
    found = {r["p"]: r["weight"] for r in paths.expand(small.edge, "P1", 3).select(F.array_join("keys", "|").alias("p"), "weight").collect()}
    assert found["P1>CITES>P2"] == 2 * 5 + 20
    assert found["P1>CITES>P2|P2>CITES>P3"] == 30 + 2 * 3 + 10  # no importance counts as 3, no type as another one
    assert found["P1>MENTIONS>E1|E1>ENABLES>E2|E2>ALIAS_OF>E3"] == 3 + 9 + 0
    assert found["P1>CITES>P2|P2>CITES>P2|P2>CITES>P3"] == 30 + (4 + 15) + 16
    assert not [p for p in found if p.endswith(">P1")]
    assert len(paths.expand(small.edge, "P1", 3, return_to_start=True).collect()) > len(found)


def test_score_and_breakdown(small):
    row = paths.breakdown(paths.scored(paths.expand(small.edge, "P1", 1))).where("node = 'P2'").first()
    assert (row["score"], row["cite_importance_score"], row["cite_type_score"], row["length_penalty"]) == (100 + 30 - 2, 10, 20, -2)


def test_ranked_by_numbers_all_rows(spark):
    values = [random.Random(3).randrange(1000) for _ in range(2000)]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(5)
    got = [(r["v"], r["i"]) for r in paths.ranked_by(rows, F.desc("v"), "i").orderBy("rank").collect()]
    assert got == sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("name", context.FORMATS)
def test_contexts(small, name):
    options = context.Options(graph_format=name)
    text = context.render(context.context_lines(small, "P1", 2, options), name)
    assert "P1" not in text or name == "json_graph"
    assert "Leaf" in text  # E1 - E2 stays
    assert "Root" not in text  # three hops away


def test_mermaid_text(small):
    options = context.Options(graph_format="mermaid", include_target_paper=True, max_nodes=2, reverse_paths=False)
    text = context.render(context.context_lines(small, "P1", 1, options), "mermaid")
    assert text == "\n".join(["```mermaid", "graph LR", '  N1["One<br/>Summary=s1"]', '  N2["Two 2<br/>Summary=s2"]', "  N1 -- CITES<br/>citation_type=EXTENDS<br/>importance_score=5<br/>context=c --> N2", "```"])


@pytest.mark.parametrize("name", context.LINES)
def test_written_contexts(small, tmp_path, name):
    import json

    for target, folder in (("P1", "a"), ("P99", "b")):
        lines = context.context_lines(small, target, 2, context.Options(graph_format=name, include_target_paper=True))
        context.write_context(lines, name, str(tmp_path / folder))
        text = "".join(p.read_text() for p in sorted((tmp_path / folder).glob("part-*.txt")))
        if name == "json_graph":
            found = [json.loads(x) for x in text.splitlines()]
            lists = {k: [x[k] for x in found if k in x] for k in ("nodes", "edges", "paths")}
            text = json.dumps(lists, indent=2, ensure_ascii=False) if found else ""
        assert text.strip() == context.render(lines, name) and bool(text) == (target == "P1" or name in ("paths", "triples") and bool(text))


def test_no_paths_render_nothing(small):
    for name in ("mermaid", "json_graph"):
        assert context.render(context.context_lines(small, "P99", 2, context.Options(graph_format=name)), name) == ""


@pytest.mark.parametrize("bad", [{"graph_format": "svg"}, {"scope": "all"}, {"max_paths": 0}, {"node_type_fields": {"Paper": ("entity_type",)}}, {"edge_type_fields": {"ALIAS_OF": ("type",)}}])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        context.Options(**bad)


def test_keyword_search_and_names(small, tmp_path):
    index = NameIndex.write(lookups.names(small).select("id", "name"), str(tmp_path))
    assert {r["id"] for r in lookups.keyword_search(small, "LEA", index).collect()} == {"E2"}
    assert {r["id"]: r["shown"] for r in lookups.display_names(lookups.names(small)).collect()}["P3"] == "P3"


def test_upserts_are_idempotent(spark, small):
    batch = spark.createDataFrame(
        [
            (1, "P1", "new", ["a"], [("Method", "X", None), ("Task", "X", "d")], [("X", "X", " uses "), ("X", "Y", "uses"), ("X", "X", "1 no")], [("Cited  Paper", 4, "USES", None)]),
            (2, "P9", "other", [], [], [], [("cited paper", 5, "EXTENDS", "why"), ("", 1, None, None)]),
            (3, "P1", None, None, None, None, None),
        ],
        upserts.EXTRACTION,
    )
    once = upserts.write_extracted(small, batch)
    twice = upserts.write_extracted(once, batch)
    for name in ("paper", "entity", "edge"):
        assert sorted(map(str, getattr(once, name).collect())) == sorted(map(str, getattr(twice, name).collect()))
    papers = {r["id"]: r for r in once.paper.collect()}
    assert papers["P1"]["summary"] is None and papers["P9"]["title"] is None
    edges = {r["key"]: r for r in once.edge.collect()}
    cited = [e for k, e in edges.items() if k.startswith("P9>CITES>")]
    assert {(e["importance_score"], e["citation_type"]) for e in cited} == {(5, "EXTENDS"), (1, None)}
    entities = {r["id"]: r for r in once.entity.where("name = 'X'").collect()}
    assert len(entities) == 2
    loops = [k for k, e in edges.items() if e["type"] == "USES"]
    task = next(i for i, e in entities.items() if e["type"] == "Task")
    assert loops == [f"{task}>USES>{task}"]  # the last entity of a name


def test_dates_and_citations(spark, small):
    dates = spark.createDataFrame([("P2", "2000", 1), ("P2", None, 2), ("nope", "2001", 1)], "id string, published_date string, seq int")
    after = {r["id"]: r["published_date"] for r in upserts.upsert_dates(small.paper, dates).collect()}
    assert after["P2"] == "2000" and "nope" not in after
    rows = spark.createDataFrame([("P1", "P2", "x", 1), ("P1", "P7", "first", 1), ("P1", "P7", "second", 2), ("no", "P8", "y", 1)], "src string, dst string, title string, seq int")
    paper, edge = upserts.upsert_citations(small.paper, small.edge, rows)
    assert {r["id"]: r["title"] for r in paper.collect()}["P7"] == "first"
    assert edge.count() == small.edge.count() + 1


def test_elo_against_a_fold(spark):
    ideas = spark.createDataFrame([(t, i, f"i{i}") for t in "xy" for i in range(4)], "tournament string, idx int, idea string")
    rng = random.Random(1)
    games = [(s, "novelty", f"i{a}", f"i{b}", rng.choice([0.0, 0.5, 1.0])) for s, (a, b) in enumerate((a, b) for a in range(4) for b in range(a + 1, 4))]
    ratings = {f"i{i}": 1000.0 for i in range(4)}
    for _, _, a, b, score in games:
        expected = 1 / (1 + 10 ** ((ratings[b] - ratings[a]) / 400))
        ratings[a], ratings[b] = ratings[a] + 32 * (score - expected), ratings[b] - 32 * (score - expected)
    got = tournament.elo_ratings(ideas, spark.createDataFrame([("x", *g) for g in games], "tournament string, seq int, metric string, idea_a string, idea_b string, score double"))
    assert {r["idea"]: round(r["rating"], 9) for r in got.where("metric = 'novelty' and tournament = 'x'").collect()} == {k: round(v, 9) for k, v in ratings.items()}
    assert got.where("rating = 1000 and (metric <> 'novelty' or tournament = 'y')").count() == 36
    assert [tuple(r) for r in tournament.all_pairs(ideas).orderBy("tournament", "seq").collect()][:2] == [("x", 0, "i0", "i1"), ("x", 1, "i0", "i2")]


def test_swap(spark):
    raw = spark.createDataFrame([(0, 1, "p", "q"), (0, 0, "p", "q"), (1, 0, "p", "q"), (2, 2, "p", "q"), (None, 1, "p", "q")], "ab int, ba int, ab_reasoning string, ba_reasoning string")
    got = [(r["winner"], r["score"], r["reasoning"]) for r in tournament.swap_resolved(raw).collect()]
    apart = "Inconsistent results (AB: p, BA: q)"
    assert got == [("a", 1.0, "p"), ("tie", 0.5, apart), ("b", 0.0, "p"), ("tie", 0.5, "p"), ("tie", 0.5, apart)]


def test_crawl_order_against_a_heap(spark):
    rng = random.Random(7)
    cites = [(f"P{a}", f"P{b}", rng.randint(1, 5)) for a in range(60) for b in rng.sample(range(60), 6) if a != b]
    top = crawl.top_citations(spark.createDataFrame(cites, "src string, dst string, importance int"), 3)
    by = {}
    for s, d, i in sorted(cites, key=lambda c: (c[0], -c[2], c[1])):
        by.setdefault(s, []).append((d, i))
    queue, seen, n, want = [], {"P0", "P1"}, 0, []
    for source, depth in (("P0", 1), ("P1", 1)):
        for d, i in by[source][:3]:
            if d not in seen:
                heapq.heappush(queue, (-i, depth, n, d)), seen.add(d)
                n += 1
    while queue:
        i, depth, _, p = heapq.heappop(queue)
        want.append((p, depth, -i))
        for d, j in by.get(p, [])[:3] if depth < 3 else []:
            if d not in seen:
                heapq.heappush(queue, (-j, depth + 1, n, d)), seen.add(d)
                n += 1
    got = crawl.best_first(["P0", "P1"], top, 3)
    assert [g[:3] for g in got] == want
    assert [g[:3] for g in crawl.best_first(["P0", "P1"], top, 3, limit=5)] == want[:5]
    assert len(crawl.best_first(["P0", "P1"], top, 3, limit=0)) == len(want)  # 0 is no limit
    assert "skipped" in {g[3] for g in crawl.best_first(["P0", "P1"], top, 3, completed=frozenset({want[0][0]}))}
    with pytest.raises(ValueError):
        crawl.best_first(["P0", "P1"], top, 3, max_edges=2)


def test_progress_folds_in_batches(spark):
    rng = random.Random(2)
    rows = [(f"P{rng.randrange(9)}", rng.choice(progress.STATUSES), f"e{i}", i // 3, i) for i in range(200)]
    schema = "paper_id string, status string, error string, ts int, seq int"
    whole = progress.folded(spark.createDataFrame(rows, schema))
    state = progress.folded(spark.createDataFrame(rows[:70], schema))
    for some in (rows[70:71], rows[71:]):
        state = progress.merged(state, progress.folded(spark.createDataFrame(some, schema)))
    assert sorted(map(str, whole.collect())) == sorted(map(str, state.select(whole.columns).collect()))


def test_documents(spark):
    docs = spark.createDataFrame([("a", 1, "p", "2020", None, "n", "c"), ("a", 2, "p", "2021", 3, None, "b"), ("b", 3, "q", "2019", 1, "m", "a")], "id string, seq int, target_paper_id string, saved_at string, rating int, notes string, place string")
    assert [r["seq"] for r in documents.listed(docs).collect()] == [2, 3]
    change = spark.createDataFrame([("a", 5, None, 1), ("a", None, "new", 2), ("z", 1, "x", 1)], "id string, rating int, notes string, seq int")
    assert {(r["seq"], r["rating"], r["notes"]) for r in documents.updated(docs, change).collect()} == {(1, 5, "new"), (2, 5, "new"), (3, 1, "m")}
    assert documents.lookup(docs, spark.createDataFrame([("a",)], "id string"), ("b", "c")).first()["seq"] == 2


def test_only_queries_are_run(spark, small):
    assert adhoc.run(small, "SELECT count(*) AS n FROM paper WHERE title <> 'Dataset'").first()["n"] == 3
    for sql in ("DROP TABLE x", "CREATE TABLE x AS SELECT 1", "INSERT INTO x SELECT 1", "SET a = 1", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a"):
        with pytest.raises(ValueError):
            adhoc.run(small, sql)


def test_titles(spark):
    said = ["Test Paper", "  Test   Paper　", "Café", "Café", "a\x1cb", None, ""]
    rows = spark.createDataFrame([(s,) for s in said], "t string").select(T.normalize_title(F.col("t")).alias("n"), T.paper_id(F.col("t")).alias("i"))
    got = [(r["n"], r["i"]) for r in rows.collect()]
    assert got[0] == got[1] and got[2] == got[3] and got[4][0] == "a b" and got[5][0] is None and len(got[0][1]) == 16


def test_files(spark, tmp_path):
    import io
    import json
    import tarfile

    (tmp_path / "x").mkdir()
    for name, body in (("a", {"paper_id": "A", "claims": ["c"]}), ("b", {"paper_id": "B", "_cache_version": 2}), ("c", {"paper_id": "C", "_cache_version": 1})):
        (tmp_path / "x" / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "x" / "d.json").write_text("{broken")
    kept = files.extractions(spark, str(tmp_path / "x"))
    assert {r["paper_id"] for r in kept.collect()} == {"A", "B"}
    files.write_extractions(kept.repartition(1), str(tmp_path / "y"))
    assert files.extractions(spark, str(tmp_path / "y")).orderBy("paper_id").collect() == kept.orderBy("paper_id").collect()
    (tmp_path / "p").mkdir()
    with tarfile.open(tmp_path / "p" / "A.tar.gz", "w:gz") as tar:
        for name, body in (("long.tex", b"x" * 99), ("main.tex", b"\\bibitem{a} One"), ("r.bbl", b"\\bibitem{a} Two, \\emph{T}")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    (tmp_path / "p" / "A.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "p" / "B.pdf").write_bytes(b"not one")
    (tmp_path / "p" / "C.tar.gz").write_bytes(b"broken")
    found = files.paper_files(spark, str(tmp_path / "p"))
    assert {(r["paper_id"], r["kind"]) for r in found.select("paper_id", "kind").collect()} == {("A", "latex"), ("C", "latex")}
    said = {r["paper_id"]: r["message"] for r in files.messages(files.latex_sources(found)).collect()}
    assert said["A"] == "[1] Two, T\n\n\\bibitem{a} One" and said["C"] is None
    rows = spark.createDataFrame([(json.dumps({"top_references": ["a"]}),), (json.dumps({"top_references": {"title": ["b", "c"]}}),), ("{}",), (None,)], "f string")
    assert [r[0] for r in rows.select(files.reference_titles(F.col("f"))).collect()] == [["a"], ["b", "c"], [], []]
