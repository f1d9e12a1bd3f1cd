"""Progress as keyed state: each paper's status in a state store, and a log of what is saved of it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.progress import FAILED

_TIMES = ("started_at", "completed_at", "ts")  # microseconds within the state
_STATUS = "status string, error_message string, started_at bigint, completed_at bigint, ts bigint, seq bigint"
_STATE = f"{_STATUS}, unsaved int, save_at bigint"
ENDED = ("completed", *FAILED)

#: A state store that keeps keys on disk, and writes for each batch what has changed.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _at(ts: int | None, seq: int | None) -> tuple:
    return (ts is not None, ts or 0, seq is not None, seq or 0)


class PaperStatus(StatefulProcessor):
    """The last status of a paper by (ts, seq), that one's error, and the first times it was begun and completed, which stay.

    A row is saved at once when the paper ends (completed, failed or not found) or after ``count`` updates, and else by
    a timer, ``seconds`` after the first update that wasn't saved; without ``seconds``, with each batch.
    """

    def __init__(self, seconds: float | None, count: int):
        self.wait, self.count = None if seconds is None else int(seconds * 1000), count

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paper = handle.getValueState("paper", _STATE)

    def _known(self) -> dict:
        names = [part.split()[0] for part in _STATE.split(", ")]
        return dict(zip(names, self.paper.get() if self.paper.exists() else [None] * 6 + [0, None], strict=True))

    def _saved(self, key: tuple, now: dict) -> Row:
        if now["save_at"] is not None:
            self.handle.deleteTimer(now["save_at"])
        now |= {"unsaved": 0, "save_at": None}
        return Row(paper_id=key[0], **{c: now[c] for c in ("status", "error_message", "started_at", "completed_at", "ts", "seq")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, ended = self._known(), False
        for r in rows:
            for status, name in (("downloading", "started_at"), ("completed", "completed_at")):
                if r["status"] == status and r["ts"] is not None and (now[name] is None or r["ts"] < now[name]):
                    now[name] = r["ts"]
            if now["unsaved"] == 0 and now["ts"] is None and now["seq"] is None or _at(r["ts"], r["seq"]) > _at(now["ts"], now["seq"]):
                now |= {"status": r["status"], "error_message": r["error"] if r["status"] in FAILED else None, "ts": r["ts"], "seq": r["seq"]}
            now["unsaved"] += 1
            ended |= r["status"] in ENDED
        if ended or self.wait is None or now["unsaved"] >= self.count:
            yield self._saved(key, now)
        elif now["save_at"] is None:
            now["save_at"] = timerValues.getCurrentProcessingTimeInMs() + self.wait
            self.handle.registerTimer(now["save_at"])
        self.paper.update(tuple(now.values()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self._known()
        if now["unsaved"]:
            now["save_at"] = None  # the timer is gone already
            yield self._saved(key, now)
            self.paper.update(tuple(now.values()))

    def close(self) -> None:
        pass


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]):
    """A query takes the settings that hold when it starts; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def track(updates: DataFrame, path: str, every: str | None = None, seconds: float = 1.0, count: int = 25) -> StreamingQuery:
    """Follows a stream of status updates (paper_id, status, error, ts, seq); those without a paper are ignored.

    The state is below ``path``/checkpoint, where a query that starts again goes on; a batch writes the changes of its
    own papers alone.  Rows that are saved (see ``PaperStatus``) are appended to ``path``/saved.  ``every`` is a trigger
    interval; without it, what there is is taken, saved with each batch, and the query ends.
    """
    spark = updates.sparkSession
    rows = updates.where("paper_id is not null").select("paper_id", "status", "error", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "seq")
    saved = rows.groupBy("paper_id").transformWithState(PaperStatus(seconds if every else None, count), f"paper_id string, {_STATUS}", "append", "processingTime" if every else "none")
    writer = saved.withColumns({c: F.timestamp_micros(c) for c in _TIMES}).writeStream.format("parquet").outputMode("append").option("path", f"{path}/saved").option("checkpointLocation", f"{path}/checkpoint")
    with _settings(spark, _STORE):
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def state(spark: SparkSession, path: str, batch: int | None = None, times: str = "timestamp") -> DataFrame:
    """All papers as the state store has them after the last batch, or after an earlier one: paper_id, status, error_message, started_at, completed_at, at; ``times`` is the type of the last three."""
    reader = spark.read.format("statestore").option("stateVarName", "paper")
    if batch is not None:
        reader = reader.option("batchId", batch)
    with _settings(spark, _STORE):
        found = reader.load(f"{path}/checkpoint")
    found = found.select("key.paper_id", "value.*").withColumns({c: F.timestamp_micros(c).cast(times) for c in _TIMES})
    return found.select("paper_id", "status", "error_message", "started_at", "completed_at", F.struct("ts", "seq").alias("at"))


def saved(spark: SparkSession, path: str) -> DataFrame:
    """The newest saved row of each paper."""
    rows = spark.read.schema(f"paper_id string, {_STATUS}".replace("_at bigint", "_at timestamp").replace("ts bigint", "ts timestamp")).parquet(f"{path}/saved")
    last = F.max_by(F.struct("status", "error_message", "started_at", "completed_at"), F.struct("ts", "seq"))
    return rows.groupBy("paper_id").agg(last.alias("s")).select("paper_id", "s.*")
