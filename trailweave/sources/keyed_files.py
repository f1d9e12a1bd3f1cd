"""A data source of files by key: one file a row, written aside and moved when all are there, and read by the keys that are asked for."""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

NAME = "keyed_files"


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI that Arrow knows (local, hdfs, s3, gs), and the path in it."""
    if ":/" not in path:
        return pyarrow.fs.LocalFileSystem(), path.rstrip("/")
    fs, found = pyarrow.fs.FileSystem.from_uri(path)
    return fs, found.rstrip("/")


def _checked(key: str | None) -> str:
    if not key or key.startswith(("/", "_")) or any(part in ("", "..", ".") for part in key.split("/")):
        raise ValueError(f"{key!r} can't be the name of a file")
    return key


@dataclass
class Files(InputPartition):
    keys: list[str]
    folders: tuple[str, ...] = ()  # whose files the task itself lists


def _keys(fs: pyarrow.fs.FileSystem, path: str, folder: str = "") -> list[str]:
    """The keys of all files below a folder of ``path``."""
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{path}/{folder}".rstrip("/"), recursive=True))
    keys = (i.path[len(path) + 1 :] for i in found if i.type == pyarrow.fs.FileType.File)
    return sorted(k for k in keys if not k.startswith("_") and not k.endswith(".crc"))


class KeyedReader(DataSourceReader):
    """Files below a folder, ``files`` to a partition; with ``keys``, only those are looked up and opened.

    Of more folders than ``files``, the driver reads the names alone, and their files are listed by tasks, ``files`` folders each.
    """

    def __init__(self, options: dict):
        self.path, self.files, self.content = options["path"], int(options.get("files", 1000)), options.get("content", "true").lower() == "true"
        self.asked: set[str] | None = set(json.loads(options["keys"])) if "keys" in options else None

    def partitions(self) -> list[InputPartition]:
        fs, path = _open(self.path)
        if self.asked is not None:
            found = [i.path for i in fs.get_file_info([f"{path}/{k}" for k in sorted(self.asked)]) if i.type == pyarrow.fs.FileType.File]
            keys = sorted(k for p in found if not (k := p[len(path) + 1 :]).startswith("_") and not k.endswith(".crc"))
            return [Files(some) for some in self._parts(keys)] or [Files([])]
        top = [(i.path[len(path) + 1 :], i.type) for i in fs.get_file_info(pyarrow.fs.FileSelector(path))]
        folders = sorted(k for k, kind in top if kind == pyarrow.fs.FileType.Directory and not k.startswith("_"))
        if len(folders) <= self.files:
            return [Files(some) for some in self._parts(_keys(fs, path))] or [Files([])]
        keys = sorted(k for k, kind in top if kind == pyarrow.fs.FileType.File and not k.startswith("_") and not k.endswith(".crc"))
        return [Files(some) for some in self._parts(keys)] + [Files([], tuple(some)) for some in self._parts(folders)]

    def _parts(self, names: list[str]) -> list[list[str]]:
        return [names[i : i + self.files] for i in range(0, len(names), self.files)]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, path = _open(self.path)
        for key in itertools.chain(partition.keys, *(_keys(fs, path, folder) for folder in partition.folders)):
            if not self.content:
                yield key, None
                continue
            with fs.open_input_stream(f"{path}/{key}", compression=None) as stream:
                yield key, stream.read()


class FilteredReader(KeyedReader):
    """Takes keys from filters, too; Spark asks for ``spark.sql.python.filterPushdown.enabled`` then."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("key",):
                keys = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.asked = keys if self.asked is None else self.asked & keys
            else:
                yield f


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class KeyedWriter(DataSourceWriter):
    """Each task attempt writes into a folder of its own below ``_staging``; a job that ends well moves their files, one that fails deletes them.

    With ``move`` false the folders' names are left in a file for ``write``, by which tasks move them.
    """

    def __init__(self, options: dict, schema):
        self.path, self.job, self.move = options["path"], options.get("job") or uuid.uuid4().hex, options.get("move", "true").lower() == "true"
        self.at = [schema.names.index("key"), schema.names.index("content")]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        fs, path = _open(self.path)
        context = TaskContext.get()
        folder, made, seen = f"{path}/_staging/{self.job}/{context.partitionId()}-{context.taskAttemptId()}", {""}, set()
        for row in rows:
            key, content = _checked(row[self.at[0]]), row[self.at[1]]
            if key in seen:
                raise ValueError(f"two rows have the key {key!r}")
            seen.add(key)
            inner = key.rpartition("/")[0]
            if inner not in made or len(seen) == 1:
                fs.create_dir(f"{folder}/{inner}".rstrip("/"), recursive=True)
                made.add(inner)
            with fs.open_output_stream(f"{folder}/{key}", compression=None) as stream:
                stream.write(content.encode() if isinstance(content, str) else bytes(content or b""))
        return Staged(folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        folders = [m.folder for m in messages if m is not None]
        if not self.move:
            fs, path = _open(self.path)
            fs.create_dir(f"{path}/_staging/{self.job}", recursive=True)
            with fs.open_output_stream(f"{path}/_staging/{self.job}/_folders", compression=None) as stream:
                stream.write(json.dumps(folders).encode())
            return
        for folder in folders:
            _move(self.path, folder)
        _forget(self.path, self.job)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _forget(self.path, self.job)


def _move(to: str, folder: str) -> None:
    """Moves all files of a staged folder, and deletes it; may run again after a loss."""
    fs, path = _open(to)
    made = set()
    for info in fs.get_file_info(pyarrow.fs.FileSelector(folder, recursive=True, allow_not_found=True)):
        if info.type == pyarrow.fs.FileType.File:
            key = info.path[len(folder) + 1 :]
            inner = key.rpartition("/")[0]
            if inner not in made:
                fs.create_dir(f"{path}/{inner}".rstrip("/"), recursive=True)
                made.add(inner)
            fs.move(info.path, f"{path}/{key}")
    if fs.get_file_info(folder).type == pyarrow.fs.FileType.Directory:
        fs.delete_dir(folder)


def _forget(to: str, job: str) -> None:
    fs, path = _open(to)
    if fs.get_file_info(f"{path}/_staging/{job}").type == pyarrow.fs.FileType.Directory:
        fs.delete_dir(f"{path}/_staging/{job}")


class KeyedFiles(DataSource):
    """``key`` (the path below a folder) and ``content`` of files.  Options: ``path``; for reading ``files`` (of a partition), ``content`` (false: null), ``keys`` (a JSON list) and ``pushdown`` (true: filters on keys are taken)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "key string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return (FilteredReader if self.options.get("pushdown", "").lower() == "true" else KeyedReader)(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return KeyedWriter(self.options, schema)


def read(spark: SparkSession, path: str, keys: list[str] | None = None, content: bool = True) -> DataFrame:
    """Files below a folder as ``key`` and ``content``; with ``keys``, those of them that are there, and no others are listed or opened."""
    spark.dataSource.register(KeyedFiles)
    reader = spark.read.format(NAME).option("content", str(content))
    return (reader if keys is None else reader.option("keys", json.dumps(keys))).load(path)


def write(rows: DataFrame, path: str) -> None:
    """A file for each row (key, content as text or bytes), which replaces one of that key; others stay.  All files appear when all are written: tasks move them then.

    Null, empty or absolute keys, those that leave the folder or begin with ``_``, and keys of several rows are errors.
    """
    spark, job = rows.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(KeyedFiles)
    rows.select("key", F.col("content").cast("binary").alias("content")).repartition("key").write.format(NAME).options(job=job, move="false").mode("append").save(path)
    fs, folder = _open(path)
    with fs.open_input_stream(f"{folder}/_staging/{job}/_folders", compression=None) as stream:
        folders = json.loads(stream.read())

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for staged in batch.column("folder").to_pylist():
                _move(path, staged)
            yield batch

    if folders:
        spark.createDataFrame([(x,) for x in folders], "folder string").repartition(len(folders)).mapInArrow(move, "folder string").write.format("noop").mode("overwrite").save()
    _forget(path, job)
