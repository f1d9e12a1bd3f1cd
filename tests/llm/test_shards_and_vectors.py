"""Sharding, clustering and whitening against plain versions, over odd rows, hot groups and empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from trailweave.llm import centroids, sharding, whitening

from .conftest import SF

DOCUMENTS = "doc_id bigint, text string, shard string, slot int, size int"
VECTORS = "vec_id bigint, embedding array<double>, cluster int, x string, component string"


def plain_pack(sizes, shards=None, capacity=None):
    """One group after the other; rooms in a list."""
    room = []
    if shards is not None:
        best = Fraction(sum(sizes), shards)
        for own in range(1, shards):
            best = min(best, Fraction(sum(sorted(sizes, reverse=True)[own:]), shards - own))
        capacity = max(1, math.ceil(best))
        room = [capacity] * shards
    for size in sorted(sizes, reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= size]
        if fits:
            at = min(fits)[1]
        elif shards is not None:
            at = max((r, k) for k, r in enumerate(room))[1]
        else:
            at = len(room)
            room.append(max(capacity, size))
        room[at] -= size
        yield size, at


@pytest.mark.parametrize("seed", range(30))
def test_packing_step_by_step(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([8, 9, 12, rng.randrange(1, 60), rng.randrange(1, 400), 1000 if seed % 3 else 8]) for _ in range(rng.randrange(1, 300))]
    kinds = Counter(sizes)
    for options in ({"shards": rng.randrange(1, 30)}, {"capacity": rng.randrange(1, 500)}):
        plan = sharding.pack(np.array(list(kinds), np.int64), np.array(list(kinds.values()), np.int64), **options)
        runs = zip(np.diff(plan.ends, prepend=0).tolist(), plan.shards.tolist(), strict=True)
        mine = [shard for n, shard in runs for _ in range(n)]
        assert list(zip(sorted(sizes, reverse=True), mine, strict=True)) == list(plain_pack(sizes, **options))
        assert plan.first[::-1].tolist() == [sum(n for s, n in kinds.items() if s > k) for k in sorted(kinds, reverse=True)]


def check_shards(given, rows, **options):
    """given: (doc_id, text), rows: the result; groups stay together, and their sizes are dealt as step by step."""
    size = lambda text: len((text or "").encode()) + 8
    want = Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in given)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots, where, total = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        where[bytes(r["group"])].add(r["shard"])
        total[bytes(r["group"])] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in where.values()) and len(where) == len({t or "" for _, t in given})
    assert Counter((total[g], min(s)) for g, s in where.items()) == Counter(plain_pack(list(total.values()), **options))


def test_shards(spark):
    rng = random.Random(1)
    hot = "the same text again " * 40
    given = [(k, hot) for k in range(700)] + [(None, "x"), (None, "x"), (None, None), (3, ""), (4, "äöü 😀")] + [(5, "long " * 50_000)] + [(k, f"{k % 300} " * rng.randrange(1, 30)) for k in range(1400)]
    given += [(k, f"same size {k:05d}") for k in range(600)]
    table = spark.createDataFrame([(*row, "s", 1, 2) for row in given], DOCUMENTS)
    check_shards(given, sharding.sharded(table).collect(), shards=24)
    check_shards(given, sharding.sharded(table, shards=None, capacity=5000).collect(), capacity=5000)
    assert sharding.sharded(table.limit(0)).count() == 0
    assert {r["slot"] for r in sharding.sharded(spark.createDataFrame([(None, None, "", 1, 1)] * 5, DOCUMENTS)).collect()} == set(range(5))


def test_large_sizes_are_rounded_up(spark):
    rows = spark.createDataFrame([(1,), (16383,), (16384,), (16385,), (10**12 + 1,), (2**62,)], "n bigint").select("n", sharding.size_class("n").alias("c")).collect()
    for n, c in rows:
        step = 1 << max(n.bit_length() - 14, 0)
        assert c == -(-n // step) * step and c - n < n / 8192 + 1


def test_shard_query(spark):
    rows = sharding.query(spark, SF).collect()
    assert {r["law"] for r in rows} == {"bytes"} and {r["shard"] for r in rows} == set(range(24)) and {r["grown_shard"] for r in rows} == {None}
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) < 1.02 * min(load.values())


def test_written_shards(spark, odd_documents, tmp_path):
    sharding.write_shards(odd_documents, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    names = odd_documents.columns
    assert Counter(map(repr, back.select(names).collect())) == Counter(map(repr, odd_documents.select(names).collect()))
    assert back.select("text", "shard").distinct().where("text is not null").groupBy("text").count().where("count > 1").count() == 0


def vectors_of(spark, rows):
    return spark.createDataFrame([(k, v, 1, "x", "y") for k, v in rows], VECTORS)


def odd_vectors(dims, n=400):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) + (k % 4) for _ in range(dims)]) for k in range(n)]
    rows += [(9000 + k, rows[7][1]) for k in range(200)] + [(7, rows[7][1]), (None, rows[8][1]), (None, rows[8][1])]
    bad = [(1, None), (2, []), (3, [1.0] * (dims - 1)), (4, [1.0] * (dims + 1)), (5, [float("nan")] + [0.0] * (dims - 1)), (6, [float("inf")] * dims), (7, [None] + [1.0] * (dims - 1))]
    return rows + bad, rows


def test_clusters(spark):
    every, rows = odd_vectors(8)
    got = centroids.clustered(vectors_of(spark, every), dims=8, k=5, rounds=4, scale=4).collect()
    x = [[math.floor(4 * c) for c in v] for _, v in rows]
    lots = sorted((k is None, hashlib.sha256(f"3:{k}".encode()).hexdigest(), v) for (k, _), v in zip(rows, x, strict=True))
    now = [v for *_, v in lots[:5]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(now))
    for _ in range(4):
        own = defaultdict(list)
        for v in x:
            own[near(v)[1]].append(v)
        now = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if own[k] else now[k] for k in range(5)]
    ends = [near(v) for v in x]
    by = Counter()
    for d, k in ends:
        by[k] += d
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    want = Counter((r[0], k, d, by[k], sum(by.values()), digest(now[k])) for r, (d, k) in zip(rows, ends, strict=True))
    assert Counter(tuple(r) for r in got) == want
    few = centroids.clustered(vectors_of(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])]), dims=2).collect()
    assert [(r["cluster"], r["distance"]) for r in few] == [(0, 0), (0, 0)]
    assert centroids.clustered(vectors_of(spark, [(1, None)])).count() == 0
    with pytest.raises(Exception, match="components beyond"):
        centroids.clustered(vectors_of(spark, [(1, [1e30])]), dims=1).collect()


@pytest.mark.parametrize("width", [3, 16])
def test_whitening(spark, width):
    every, rows = odd_vectors(7)
    got = whitening.whitened(vectors_of(spark, every), components=5, width=width, block=32).collect()
    x = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for _, v in rows]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums, strict=True)] for v in fit])
    v = z.T @ z / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:5], vectors[:, ::-1][:, :5]
    assert len(got) == 5 * len(rows) and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    want = {}
    for (key, _), a in zip(rows, x, strict=True):
        want[key] = (sum((n * c - s) ** 2 for c, s in zip(a, sums, strict=True)), np.array([float(Fraction(n * c - s, n)) for c, s in zip(a, sums, strict=True)]) @ vectors / np.sqrt(values))
    signs = {}
    for r in got:
        deviation, own = want[r["vec_id"]]
        k = r["component"] - 1
        assert int(r["deviation"]) == deviation and math.isclose(r["explained"], values[k] / np.trace(v), rel_tol=1e-9)
        signs.setdefault(k, np.sign(r["whitened"] * own[k]))
        assert math.isclose(r["whitened"], signs[k] * own[k], rel_tol=1e-7, abs_tol=1e-8)


def test_whitening_of_odd_tables(spark):
    assert whitening.whitened(vectors_of(spark, [])).count() == 0
    assert whitening.whitened(vectors_of(spark, [(1, None), (2, []), (3, [None])])).count() == 0
    assert whitening.whitened(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitening.whitened(vectors_of(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])])).collect()
    assert sorted((r["vec_id"], r["component"]) for r in line) == [(1, 1), (2, 1), (2, 1), (3, 1)] and line[0]["explained"] > 0.999999
    far = whitening.whitened(vectors_of(spark, [(1, [1e10, 0.0]), (2, [-1e10, 1.0]), (3, [0.0, 5.0])]), components=2).collect()
    assert {int(r["deviation"]) for r in far if r["vec_id"] == 1} == {(3 * 640_000_000_000) ** 2 + (3 * 0 - 384) ** 2}
