"""Peak memory of the tasks that read texts for op9: a piece's arrays are gone before the next one's, and the words of its lines are looked at in parts."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailweave.llm import line_dedup
from trailweave.llm._text import WORDS, _power

RARITY = line_dedup.Rarity(np.zeros(0, np.uint64), np.zeros(0, np.uint8), 2)
THRESHOLD = line_dedup.Threshold(line_dedup.Fraction("0.8"))


class Held:
    """Stands for documents and gets the function that tasks run."""

    def __init__(self, spark=None):
        self.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def texts(mb, seed=3):
    rng = random.Random(seed)
    names = [f"w{k}" for k in range(50_000)]
    rows = ["\n".join(" ".join(rng.choices(names, k=12)) for _ in range(60)) for _ in range(mb * 220)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array(rows)], ["doc_id", "hash", "text"])


def peak(run, batch):
    """MB that numpy holds at most."""
    _power(1)
    tracemalloc.start()
    n = sum(x.num_rows for x in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert n
    return most


def test_prefixes(spark):
    run = line_dedup.prefixes(Held(), SimpleNamespace(value=RARITY), THRESHOLD, 20, 200_000)
    assert peak(run, texts(12)) < 65


def test_described(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "class_bitmap", lambda _: np.full(((1 << line_dedup._BITS) // 32768, 4096), 255, np.uint8))
    run = line_dedup.described(Held(), None, None)
    assert peak(run, texts(12)) < 48


@pytest.mark.parametrize("most", [1, 7, 1 << 17])
def test_parts_of_lines(spark, monkeypatch, most):
    """Rows are the same however many words are looked at together, with all words of lines, too."""
    batch, runs = texts(1).slice(0, 20), line_dedup._runs
    wanted = SimpleNamespace(value=np.full(((1 << line_dedup._BITS) // 32768, 4096), 255, np.uint8))

    def rows(want):
        (out,) = line_dedup.prefixes(Held(), SimpleNamespace(value=RARITY), THRESHOLD, 5, 1, want)(iter([batch]))
        return out

    whole = [rows(w) for w in (None, wanted)]
    monkeypatch.setattr(line_dedup, "_runs", lambda ends: runs(ends, most))
    assert all(rows(w).equals(x) for w, x in zip((None, wanted), whole, strict=True))
