"""Progress as keyed state: sticky times, saving by end, count and timer, restarts, and what a batch writes."""

import random
import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from trailweave.operators import progress
from trailweave.streaming import status

UPDATE = "paper_id string, status string, error string, ts timestamp, seq bigint"
DAY = datetime(2024, 1, 1)


def append(spark, path, rows):
    spark.createDataFrame(rows, UPDATE).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, tmp_path, **options):
    stream = spark.readStream.schema(UPDATE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return status.track(stream, str(tmp_path / "out"), **options)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def some_updates(seed, n=300, papers=20):
    rng = random.Random(seed)
    return [(f"P{rng.randrange(papers)}", rng.choice(progress.STATUSES), rng.choice(["x", None]), DAY + timedelta(seconds=rng.randrange(100)), 1000 * seed + k) for k in range(n)]


def test_state_goes_on_after_a_restart(spark, tmp_path):
    """Batches in any order of time, over two runs, give what one aggregation gives; papers without an id are ignored."""
    every = some_updates(1) + [(None, "failed", "x", DAY, 1)]
    append(spark, tmp_path / "in", every[::2])
    append(spark, tmp_path / "in", every[1::2])
    run(spark, tmp_path).awaitTermination()
    state = lambda: rows_of(status.state(spark, str(tmp_path / "out")).select("paper_id", "status", "error_message", "started_at", "completed_at", "at.ts", "at.seq"))
    want = lambda rows: rows_of(progress.folded(spark.createDataFrame([r for r in rows if r[0]], UPDATE)).select("paper_id", "status", "error_message", "started_at", "completed_at", "at.ts", "at.seq"))
    assert state() == want(every)
    more = some_updates(2, n=40, papers=3)
    append(spark, tmp_path / "in", more)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "saved").glob("*.parquet")}
    run(spark, tmp_path).awaitTermination()
    assert state() == want(every + more)
    fresh = [str(p) for p in (tmp_path / "out" / "saved").glob("*.parquet") if p not in before]
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    assert {r["paper_id"] for r in spark.read.parquet(*fresh).collect()} <= {r[0] for r in more}


def test_a_batch_writes_its_own_papers_alone(spark, tmp_path):
    """What the state store writes for a batch of one paper doesn't grow with the papers that it knows."""
    append(spark, tmp_path / "in", [(f"P{k}", "failed", "some cause " * 5, DAY, k) for k in range(5000)])
    run(spark, tmp_path).awaitTermination()
    changes = lambda: {p: p.stat().st_size for p in Path(tmp_path / "out" / "checkpoint" / "state").rglob("*.changelog")}
    first = changes()
    append(spark, tmp_path / "in", [("P7", "completed", None, DAY + timedelta(1), 9000)])
    run(spark, tmp_path).awaitTermination()
    after = changes()
    assert 20 * sum(v for p, v in after.items() if p not in first) < sum(first.values())
    assert {r["status"] for r in status.state(spark, str(tmp_path / "out")).where("paper_id = 'P7'").collect()} == {"completed"}


def test_times_stay_and_errors_go(spark, tmp_path):
    steps = [("downloading", None, 5), ("failed", "lost", 6), ("downloading", None, 7), ("completed", None, 8), ("completed", None, 9)]
    for k, (name, error, at) in enumerate(steps):
        append(spark, tmp_path / "in", [("P1", name, error, DAY + timedelta(seconds=at), k)])
        run(spark, tmp_path).awaitTermination()
        if name == "failed":
            assert rows_of(status.state(spark, str(tmp_path / "out")).select("status", "error_message")) == [("failed", "lost")]
    last = status.state(spark, str(tmp_path / "out")).first()
    assert (last["status"], last["error_message"], last["started_at"], last["completed_at"]) == ("completed", None, DAY + timedelta(seconds=5), DAY + timedelta(seconds=8))
    assert rows_of(status.saved(spark, str(tmp_path / "out")).select("paper_id", "status", "completed_at")) == [("P1", "completed", DAY + timedelta(seconds=8))]


@pytest.mark.parametrize(("updates", "count", "seconds", "rows"), [(3, 25, 3600.0, 0), (3, 3, 3600.0, 1), (1, 25, 0.2, 1)])
def test_saving_by_count_and_by_timer(spark, tmp_path, updates, count, seconds, rows):
    append(spark, tmp_path / "in", [("P1", "extracting", None, DAY + timedelta(seconds=k), k) for k in range(updates)])
    query = run(spark, tmp_path, every="500 milliseconds", seconds=seconds, count=count)

    def saved():
        if not list((tmp_path / "out" / "saved").glob("*.parquet")):
            return []
        return rows_of(status.saved(spark, str(tmp_path / "out")).select("status", "error_message"))

    def wait_for(rows, most=90):
        end = time.time() + most
        while saved() != rows and time.time() < end:
            time.sleep(0.5)
        assert saved() == rows

    try:
        if rows:
            wait_for([("extracting", None)])
        else:
            while not query.recentProgress or not sum(p["numInputRows"] for p in query.recentProgress):
                time.sleep(0.2)
            assert saved() == []
        append(spark, tmp_path / "in", [("P1", "not_found", "gone", DAY + timedelta(1), 99)])
        wait_for([("not_found", "gone")])
    finally:
        query.stop()
