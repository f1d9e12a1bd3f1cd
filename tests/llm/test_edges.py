"""Each operator and stage over odd and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailweave.llm import chat_format, decontamination, html_text, language_id, line_dedup, lm_score, media, mixing, ngram_join, quality

BENCHMARK = "item_id bigint, text string, score int"


def score_lm(docs, _):
    return lm_score.score(docs.select("doc_id", "text").withColumn("held_out", language_id.fold("doc_id", 7) == 2))


def score_quality(docs, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (7, 0), (None, 1), (99, 1), (10, None), (6, 0), (8, 0), (9, 1), (11, 1)], "doc_id bigint, quality int")
    return quality.quality(docs, labels, ("quality",))


ROWS = {
    "decontamination": lambda docs, spark: decontamination.contamination(docs, spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "ein satz der", 1), (3, "w1 w2", 1), (3, "w1 w2", 1)], BENCHMARK)),
    "decontamination, empty benchmark": lambda docs, spark: decontamination.contamination(docs, spark.createDataFrame([], BENCHMARK)),
    "language": lambda docs, _: language_id.predict(docs, language_id.train_profiles(docs)),
    "line dedup": lambda docs, _: line_dedup.dedup_lines(docs),
    "near duplicates": lambda docs, _: ngram_join.near_duplicates(docs),
    "language model": score_lm,
    "quality": score_quality,
    "media": lambda docs, _: media.features(media.corrected(media.stored_media(docs))),
    "html": lambda docs, _: html_text.extract(docs.select(F.col("doc_id").alias("page_id"), "source", F.col("text").alias("html")), keep=("page_id",)),
    "mixing": lambda docs, _: mixing.calibrated(docs),
}


@pytest.mark.parametrize("name", ROWS)
def test_one_row_for_each(spark, plain_documents, name):
    assert ROWS[name](plain_documents, spark).count() == plain_documents.count()


@pytest.mark.parametrize("name", ROWS)
def test_empty_tables(spark, empty_documents, name):
    assert ROWS[name](empty_documents, spark).count() == 0


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_line_dedup_values(spark, plain_documents):
    given = {r["doc_id"]: r["text"] for r in plain_documents.collect()}
    stays = {d: given[d] for d in (1, 3, 4, 5, 6, 8, 11)} | {7: given[7].split("\n")[0], 2: "", 9: "", 10: ""}
    want = [(d, stays[d], len(given[d].split("\n")) if given[d] is not None else 0) for d in stays] + [(2, "", 1), (None, "", 2), (None, None, 0)]
    assert rows_of(line_dedup.dedup_lines(plain_documents), "doc_id", "text", "n_lines") == sorted(want, key=repr)


def test_near_duplicate_values(spark, plain_documents):
    own = [(d, 0, 1, d) for d in (3, 4, 5, 6, 8, 11)]
    want = [*own, (1, 1, 3, 1), (2, 1, 3, 1), (2, 1, 3, 1), (9, 1, 1, 1), (7, 0, 3, 7), (10, 0, 3, 7), (None, 0, 3, 7), (None, 0, 1, None)]
    assert rows_of(ngram_join.near_duplicates(plain_documents), "doc_id", "n_links", "copies", "group_doc") == sorted(want, key=repr)
    assert rows_of(ngram_join.one_of_each(plain_documents), "doc_id") == sorted([(d,) for d in (1, 3, 4, 5, 6, 7, 8, 11, None)], key=repr)
    once = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (None, None)], "doc_id bigint, text string")
    assert rows_of(ngram_join.one_of_each(once), "doc_id", "text") == [(1, "a b"), (None, None), (None, None)]


def test_decontamination_values(spark, plain_documents):
    items = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "ein satz der", 1), (3, "unheard of", 1), (3, "unheard of", 1)], BENCHMARK)
    got = {(r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in decontamination.contamination(plain_documents, items).collect()}
    assert {(7, 18, 6, True), (10, 18, 6, True), (None, 18, 6, True), (None, 0, 0, False), (3, 0, 0, False), (4, 0, 0, False), (5, 0, 0, False), (8, 2, 0, False), (6, 60_000, 0, False)} <= got
    assert rows_of(decontamination.clean(plain_documents, items), "doc_id") == sorted([(d,) for d in (1, 2, 2, 3, 4, 5, 6, 8, 9, 11, None)], key=repr)


def test_values_of_null_and_empty_texts(spark, plain_documents):
    languages = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(plain_documents, language_id.train_profiles(plain_documents)).collect()}
    assert {(d, "und", 0.0) for d in (3, 4, 5, 8, None)} <= languages and not any(x == "und" for d, x, _ in languages if d in (1, 2, 6, 7, 9, 10))
    scores = rows_of(score_lm(plain_documents, spark), "doc_id", "n_tokens", "score")
    assert len({x for d, n, x in scores if d in (3, 4, 5)}) == 1 and {n for d, n, _ in scores if d in (3, 4, 5)} == {1}
    assert len({x for d, _, x in scores if d in (1, 2)}) == 1 and all(x < 0 for *_, x in scores)
    found = {r["doc_id"]: (r["n_bytes"], r["payload_bytes"], r["media_sha256"]) for r in ROWS["media"](plain_documents, spark).collect()}
    assert found[3] == found[4] and found[3][:2] == (0, 64) and found[1] == found[2]
    qualities = rows_of(score_quality(plain_documents, spark), "doc_id", "quality_score")
    assert len({x for d, x in qualities if d in (1, 2)}) == 1 and all(0 < x < 1 for _, x in qualities)
    mixed = mixing.calibrated(plain_documents).collect()
    assert {(r["topic"], r["tokens"], r["probability"], r["sampled"]) for r in mixed if r["doc_id"] in (3, 4, 5)} == {("none", 0, 0.0, False)}
    assert len({(r["probability"], r["sampled"]) for r in mixed if r["doc_id"] == 2}) == 1
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a"), (3, "<p>a")], "page_id int, html string")
    assert rows_of(html_text.extract(texts, keep=("page_id",)), "page_id", "text") == [(1, None), (2, ""), (3, "a"), (3, "a")]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(spark, odd_documents, empty_documents, tmp_path, stage):
    """Columns of any names keep their values in the rows that stay, and rows are taken from those given."""
    spark.createDataFrame([(1, "w1 w2 w3", 1), (2, None, 2)], BENCHMARK).write.parquet(str(tmp_path / "benchmark.parquet"))
    given = odd_documents.withColumns({"own_doc": F.col("key"), "own_topic": F.lit(1), "sampled": F.lit(7), "probability": F.lit("p"), "mark": F.lit(0)})
    out = stage[1](spark, given, str(tmp_path))
    assert out.columns == given.columns and [f.dataType for f in out.schema] == [f.dataType for f in given.schema]
    names = [c for c in given.columns if c not in ("text", "n_chars")]
    left = rows_of(out, *names)
    assert not [r for r in left if r not in rows_of(given, *names)] and 0 < len(left) <= given.count()
    assert len(left) == len({r[names.index("key")] for r in left})
    none = stage[1](spark, empty_documents, str(tmp_path))
    assert none.count() == 0 and none.columns == empty_documents.columns


def test_conversations(spark):
    schema = "conv_id bigint, seq bigint, payload string"
    rows = [(1, 0, None), (1, 1, "[1]"), (1, 2, "not json"), (2, 0, '{"unheard": 1}'), (None, None, '{"role": "user", "text": "x"}'), (3, 0, "{}"), (4, 0, '{"messages": []}'), (4, 0, '{"messages": []}')]
    turns = chat_format.canonical_turns(spark.createDataFrame(rows, schema))
    assert turns.where("layout is null").count() == 4
    assert chat_format.read_back(chat_format.format_turns(turns)).count() == 4
    nothing = chat_format.canonical_turns(spark.createDataFrame([], schema))
    assert chat_format.read_back(chat_format.format_turns(nothing)).count() == 0
