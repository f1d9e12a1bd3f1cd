"""What the readings of op9's texts hand on: lines that repeat or meet alone, and the documents of lines left open alone."""

import numpy as np
import pyarrow as pa

from trailweave.llm import line_dedup
from trailweave.llm._text import word_hashes


def left_open():
    """An early line, one that only seems similar to the last, and the last, which is similar to the first; these meet in the same groups.

    Words that the lines don't share come last by hash, so that all of a line's prefix is shared.
    """

    def by_hash(names):
        return [w for _, w in sorted(zip(word_hashes(pa.array([" ".join(names)]))[0].tolist(), names, strict=True))]

    own, others = by_hash([f"word{k}" for k in range(150)]), by_hash([f"other{k}" for k in range(1000)])
    near, apart = own[:145] + others[-5:], own[:133] + others[-22:-5]
    return [(10, " ".join(near)), (20, " ".join(apart)), (30, " ".join(own))]


def corpus(spark):
    others = [(100 + k, f"only{k} here{k} and{k} there{k}\n--") for k in range(40)]
    return spark.createDataFrame([*left_open(), *others, (200, "the same\nthe same again"), (201, "The same again!")], "doc_id bigint, text string").repartition(3)


def test_only_documents_of_open_lines_are_read_again(spark, monkeypatch):
    read, prefixes = [], line_dedup.prefixes

    def seen(documents, rarity, threshold, buckets, group, wanted=None):
        if wanted is not None:
            read.extend(r["doc_id"] for r in documents.collect())
        return prefixes(documents, rarity, threshold, buckets, group, wanted)

    monkeypatch.setattr(line_dedup, "prefixes", seen)
    docs = corpus(spark)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, table_words=1, limit=1).collect()}
    assert kept == {r["doc_id"]: r["text"] for r in docs.collect()} | {30: "", 201: ""}
    assert {10, 30} <= set(read) <= {10, 20, 30}


def test_lines_that_neither_repeat_nor_meet_are_not_written(spark):
    lines, later = line_dedup.similar_classes(corpus(spark), table_words=1, limit=1)
    assert sorted({r["doc"] for r in lines.select("doc").collect()}) == [10, 20, 30, 200, 201]
    assert later.distinct().count() == 1


def test_whole_groups_in_parts(spark):
    """Rows of the groups asked for come back whole, no group in two parts."""
    n = 50
    rows = {c: np.arange(n).astype(kind) for c, kind in line_dedup.ROW.items()} | {"word": np.arange(n) % 7, "salt": np.zeros(n, np.int64)}
    parts = [line_dedup._unpack(pa.py_buffer(x)) for x in line_dedup._whole_groups(rows, np.array([1, 9, 3]), most=5)]
    assert sorted(np.concatenate([p["cls"] for p in parts]).tolist()) == [k for k in range(n) if k % 7 in (1, 2, 3)]
    assert [len(set(p["word"].tolist())) for p in parts] == [1, 1, 1] and all((p["doc"] == p["cls"]).all() and (p["again"] == p["cls"]).all() for p in parts)
