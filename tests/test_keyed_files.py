"""Files by key: all of a write or none, and reading only what is asked for."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from trailweave.sources import keyed_files


def names(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def rows_of(df):
    return sorted((r["key"], None if r["content"] is None else bytes(r["content"])) for r in df.collect())


def test_written_and_read(spark, tmp_path):
    rows = [("a.json", "{}"), ("in/b.json", "ä"), ("in/deep/c.json", ""), ("d.json", None)]
    keyed_files.write(spark.createDataFrame(rows, "key string, content string"), str(tmp_path))
    assert names(tmp_path) == ["a.json", "d.json", "in/b.json", "in/deep/c.json"]
    keyed_files.write(spark.createDataFrame([("a.json", bytearray(b"\0new")), ("z", bytearray(b"z"))], "key string, content binary"), f"file://{tmp_path}")
    want = [("a.json", b"\0new"), ("d.json", b""), ("in/b.json", "ä".encode()), ("in/deep/c.json", b""), ("z", b"z")]
    assert rows_of(keyed_files.read(spark, str(tmp_path))) == want
    assert rows_of(keyed_files.read(spark, str(tmp_path), ["a.json", "in/b.json", "not there"])) == [want[0], want[2]]
    assert rows_of(keyed_files.read(spark, str(tmp_path), content=False).where("key < 'd'")) == [("a.json", None)]
    keyed_files.write(spark.createDataFrame([], "key string, content string"), str(tmp_path))
    assert len(names(tmp_path)) == 5 and not list((tmp_path / "_staging").iterdir())


def test_only_asked_files_are_opened(spark, tmp_path):
    keyed_files.write(spark.range(50).select(F.concat("id", F.lit(".txt")).alias("key"), F.lit("x").alias("content")), str(tmp_path))
    reader = keyed_files.FilteredReader({"path": str(tmp_path), "files": "7"})
    assert sum(len(p.keys) for p in reader.partitions()) == 50 and max(len(p.keys) for p in reader.partitions()) == 7
    left = list(reader.pushFilters([In(("key",), ("3.txt", "4.txt", "no")), StringStartsWith(("key",), "3"), EqualTo(("key",), "3.txt")]))
    assert left == [StringStartsWith(("key",), "3")] and [p.keys for p in reader.partitions()] == [["3.txt"]]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = spark.read.format(keyed_files.NAME).option("pushdown", "true").load(str(tmp_path)).where("key in ('5.txt', '6.txt')")
        assert rows_of(pushed) == [("5.txt", b"x"), ("6.txt", b"x")] and pushed.rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    found = keyed_files.read(spark, str(tmp_path), ["3.txt", "9.txt"])
    assert rows_of(found) == [("3.txt", b"x"), ("9.txt", b"x")] and found.rdd.getNumPartitions() == 1


@pytest.mark.parametrize("bad", [[("b", "1"), ("b", "2")], [(None, "1")], [("", "1")], [("/etc/x", "1")], [("a/../../x", "1")], [("_staging/x", "1")]])
def test_a_write_that_fails_leaves_nothing(spark, tmp_path, bad):
    keyed_files.write(spark.createDataFrame([("kept", "0")], "key string, content string"), str(tmp_path))
    rows = [(f"n{k}", "x") for k in range(40)] + bad
    with pytest.raises(Exception, match="can't be the name|two rows"):
        keyed_files.write(spark.createDataFrame(rows, "key string, content string"), str(tmp_path))
    assert names(tmp_path) == ["kept"]


def test_many_folders_are_listed_by_tasks(spark, tmp_path):
    rows = [(f"T{k}/{name}", f"{k} {name}") for k in range(30) for name in ("a.json", "in/b.md")] + [("top", "t")]
    keyed_files.write(spark.createDataFrame(rows, "key string, content string"), str(tmp_path))
    parts = keyed_files.KeyedReader({"path": str(tmp_path), "files": "7"}).partitions()
    assert [p.keys for p in parts if p.keys] == [["top"]] and max(len(p.folders) for p in parts) == 7 and sum(len(p.folders) for p in parts) == 30
    found = spark.read.format(keyed_files.NAME).option("files", "7").load(str(tmp_path))
    assert rows_of(found) == sorted((k, c.encode()) for k, c in rows)


def test_tasks_move_what_is_written(spark, tmp_path):
    """The driver gets the folders' names alone, and a move that runs again changes nothing."""
    spark.dataSource.register(keyed_files.KeyedFiles)
    rows = spark.createDataFrame([(f"T{k}/x", str(k)) for k in range(9)], "key string, content string")
    rows.select("key", F.col("content").cast("binary").alias("content")).write.format(keyed_files.NAME).options(job="j", move="false").mode("append").save(str(tmp_path))
    assert [n for n in names(tmp_path) if not n.startswith("_staging/j/")] == []
    folders = json.loads((tmp_path / "_staging/j/_folders").read_text())
    for folder in folders + folders:
        keyed_files._move(str(tmp_path), folder)
    assert [n for n in names(tmp_path) if not n.startswith("_")] == sorted(f"T{k}/x" for k in range(9))
