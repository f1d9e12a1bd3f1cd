"""Parsers of ideas against values worked out by hand."""

from pyspark.sql import functions as F

from trailweave.functions import ideas as I


def values(spark, function, texts):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    return [r[0] for r in df.orderBy("k").select(function(F.col("x")).alias("y")).collect()]


def test_section(spark):
    text = "intro\n# Motivation\nwhy it\n\n matters \nMethod: do this\nand that\nNext:\nnot this\nMethod: nor this"
    assert values(spark, lambda x: I.section(x, ("motivation",), "none"), [text, "nothing", None]) == ["why it matters Method: do this and that", "none", "none"]
    assert values(spark, lambda x: I.section(x, ("method", "approach")), [text]) == ["do this and that"]


def test_list_items(spark):
    text = "Datasets used\n- One\n* Two.\n1. Three\nplain\n• \n" + "\n" * 10 + "- far\ndata again\n- One"
    assert values(spark, lambda x: I.list_items(x, ("dataset", "data")), [text, "no list", None]) == [["One", "Two.", "Three", "One"], [I.NO_ITEMS], [I.NO_ITEMS]]


def test_papers_and_entities(spark):
    chain = '1. Paper "A" and "B"\nStep 2: then\n3) Paper: a longer title\nplain line without marks\nsee: "A"'
    assert values(spark, I.papers_from_chain, [chain, "", None]) == [["A", "B", "Paper: a longer title"], [], []]
    assert values(spark, I.entity_names, ["- BERT\n* GPT\nBERT", "a, b;c,, a", "a; b", "one name", "", None]) == [["BERT", "GPT"], ["a", "b;c"], ["a", "b"], ["one name"], [], []]


def test_titles(spark):
    assert values(spark, I.title_from_idea, ["x\nTITLE:  My Title \n# H", "first\n## Head", "\n first line \nsecond", "", "y" * 300]) == ["My Title", "Head", "first line", I.NO_TITLE, I.NO_TITLE]
    assert values(spark, I.chain_mermaid, ["1. First step [a]\nshort\n2) Second \"one\"", ""]) == ["graph LR\n  N0[\"First step (a)\"]\n  N1[\"Second 'one'\"]\n  N0 --> N1", "graph LR\n  A[CoI Generated Idea]"]


def test_results(spark):
    assert values(spark, I.related_experiments, [None, "null", '["a", null, "b"]', '"x\\n\\n y "', '""', "5"]) == [[], [], ["a", "b"], ["x", "y"], [""], ["5"]]
    assert values(spark, I.entities_text, [None, '["a", null, "b"]', '"x"', "5"]) == ["", "a\nb", "x", "5"]


def test_extraction_text(spark):
    schema = "s string, c array<string>, e array<struct<type: string, name: string, description: string>>, p array<struct<title: string, reference_number: int, citation_type: string>>"
    rows = [("Sum", ["c1", "c2"], [("Method", " B ", ""), ("Method", "A", "d"), ("Dataset", "D", None), ("", "no", None)], [("T", None, "COMPARES"), ("", 3, "COMPARES"), ("U", 1, "USES")]), (None, None, None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(I.extraction_text(F.col("s"), F.col("c"), F.col("e"), F.col("p"))).collect()]
    want = [I.NOTE, "Paper summary:\nSum", "Claims:\n- c1\n- c2", "Key methods/approaches:\n- A\n- B", "Datasets/benchmarks:\n- D", "Comparison baselines (from citations):\n- Reference #3\n- T", "Key entities:\n- B (Method)\n- A (Method): d\n- D (Dataset)"]
    assert got == ["\n\n".join(want), I.NOTE]


def test_archives_are_made_without_a_group_for_each(spark):
    import io
    import tarfile

    from trailweave.plans.idea_queries import _archives

    rows = spark.createDataFrame([("P1", [("b.tex", "ä"), ("a.bbl", "")]), ("P2", [])], "paper_id string, files array<struct<name: string, body: string>>")
    made = _archives(rows)
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
    found = {r["key"]: [(m.name, m.size) for m in tarfile.open(fileobj=io.BytesIO(bytes(r["content"]))).getmembers()] for r in made.collect()}
    assert found == {"P1.tar.gz": [("a.bbl", 0), ("b.tex", 2)], "P2.tar.gz": []}
