"""Operators and queries against plain versions of what they compute."""

import hashlib
import math
import random
import re
import struct
import time
import unicodedata
import zlib
from collections import Counter
from fractions import Fraction
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tools import compare
from trailweave.llm import chat_format, decontamination, html_text, language_id, line_dedup, lm_score, media, mixing, ngram_join, quality

from .conftest import SF, fold_case, prose, words


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def hits(text, windows):
    found, own = set(), words(text)
    items = set()
    for item, w in windows:
        for i in range(len(own) - len(w) + 1):
            if own[i : i + len(w)] == w:
                found.update(range(i, i + len(w)))
                items.add(item)
    return len(own), len(found), items


def test_decontamination(spark, docs):
    windows = []
    for item, text in (tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()):
        w = words(text)
        windows += [(str(item), w[i : i + 13]) for i in range(max(len(w) - 12, min(len(w), 1)))]
    by_first = {}
    for item, w in windows:
        by_first.setdefault(w[0], []).append((item, w))
    got = {r["doc_id"]: r for r in decontamination.query(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc, text, *_ in docs:
        n, hit, items = hits(text, [w for first in set(words(text)) for w in by_first.get(first, ())])
        r = got[doc]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(items), hit > 0 and 20 * hit >= n)
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def test_decontamination_in_blocks_and_near(spark):
    docs = spark.createDataFrame([(1, "x a b c d"), (1, "x a b c d"), (2, "a x b c d y"), (3, "d c b a")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d"), (2, "x a"), (3, "nowhere")], "item_id bigint, text string")
    for block in (100_000, 1):
        got = {r["doc_id"]: (r["n_hit"], sorted(r["items"]), sorted(r["near_items"])) for r in decontamination.contamination(docs, items, block_windows=block).collect()}
        assert got[1] == (5, ["1", "2"], ["1", "2"]) and got[2][:2] == (0, []) and "1" in got[2][2] and got[3][0] == 0
        assert decontamination.contamination(docs, items, block_windows=block).count() == 4


def test_line_dedup(spark):
    rng = random.Random(1)
    base = [prose(rng, n, 300).split() for n in [rng.choice([1, 3, 5, 8, 12, 20, 40]) for _ in range(60)]]
    rows = []
    for d in range(120):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                line[rng.randrange(len(line))] = f"w{rng.randrange(300)}"
            lines.append(" ".join(line) if rng.random() < 0.95 else "--- !!")
        rows.append((d, "\n".join(lines)))
    seen, want = [], {}
    for doc, text in rows:
        kept = []
        for line in text.split("\n"):
            w = frozenset(words(line))
            if not (w and any(5 * len(w & v) >= 4 * len(w | v) for v in seen)):
                kept.append(line)
            if w:
                seen.append(w)
        want[doc] = "\n".join(kept)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for options in ({}, {"group": 3, "bucket_words": 50, "limit": 1}, {"table_words": 10, "limit": 1}):
        assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, **options).collect()} == want


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1)))}


def groups_of(rows):
    """By text: how many similar other texts; by row: the least id of its group."""
    texts = sorted({t for _, t in rows if t is not None})
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[texts[i]] += 1
                links[texts[j]] += 1
                root[find(i)] = find(j)
    least = {}
    for d, t in rows:
        if t is not None:
            g = find(texts.index(t))
            least[g] = min(least.get(g, d), d)
    return links, {d: least[find(texts.index(t))] if t is not None else d for d, t in rows}


def test_near_duplicates(spark, docs):
    rng = random.Random(3)
    base = [prose(rng, n, 5000).split() for n in (3, 8, 40, 120, 400)]
    rows = [(d, t) for d, t, *_ in docs]
    for k in range(120):
        text = list(base[k % 5])
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            text[rng.randrange(len(text))] = f"v{rng.randrange(99)}"
        rows.append((10_000 + k, " ".join(text)))
    links, least = groups_of(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: (r["n_links"], r["group_doc"]) for r in ngram_join.near_duplicates(df).collect()}
    assert got == {d: (links[t], least[d]) for d, t in rows}
    kept = {r["doc_id"] for r in ngram_join.one_of_each(df).collect()}
    assert kept == {d for d, _ in rows if least[d] == d}


@pytest.mark.parametrize("options", [{"members": 7}, {"shingles": 20, "trees": 6, "longest": 3}])
def test_links_in_blocks(spark, options):
    base = prose(random.Random(4), 200, 5000).split()
    for n in (40, 4):
        df = spark.createDataFrame([(k, " ".join([*base[:-1], f"x{k}"])) for k in range(n)], "doc_id bigint, text string")
        assert [r["n_links"] for r in ngram_join.near_duplicates(df, **options).collect()] == [n - 1] * n


def test_chains_of_candidates(spark):
    """Each text shares half its shingles with the next: candidates form one chain, links none, and no text goes to more tasks than it has partners."""
    rng = random.Random(8)
    parts = [prose(rng, 60, 10**6) for _ in range(201)]
    df = spark.createDataFrame([(k, f"{parts[k]} {parts[k]} {parts[k + 1]}") for k in range(200)], "doc_id bigint, text string")
    assert {(r["n_links"], r["group_doc"] == r["doc_id"]) for r in ngram_join.near_duplicates(df, members=16).collect()} == {(0, True)}
    texts = ngram_join.labels(df, 5, Fraction(4, 5), 24, 6, 0.99999).withColumn("id", F.monotonically_increasing_id())
    texts = ngram_join.stored(texts)
    runs = ngram_join.forest_runs(texts, 24, 6, 1)
    assert ngram_join.partners(runs, texts, 6, 0.0, 16, 10**6).count() <= 4 * 200


def test_recall_near_the_threshold(spark):
    rng = random.Random(9)
    rows = []
    for k in range(300):
        text = prose(rng, rng.choice([12, 30, 100, 300]), 10**6).split()
        other = list(text)
        at = rng.randrange(len(text))
        other[at : at + max(1, len(text) // rng.choice([14, 17, 20, 30]))] = [f"new{k}"]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    links, least = groups_of(rows)
    got = {r["doc_id"]: (r["n_links"], r["group_doc"]) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(links.values()) > 200 and got == {d: (links[t], least[d]) for d, t in rows}


def test_prefixes_are_shortened_by_text():
    t = Fraction(4, 5)
    least = ngram_join.least_similarity(np.array([1, 3, 4, 6, 7, 8, 1000]), t)
    assert [round(float(x), 3) for x in least] == [1, 1, 0.8, 0.833, 0.857, 0.8, 0.8]
    depth = ngram_join.depths(np.array([1, 7, 6, 1000]), t, 24, 6, 0.99999)
    assert depth.tolist() == [6, 6, 5, 4]
    assert ngram_join.depths(np.array([1000]), t, 4, 6, 0.99999).tolist() == [1]


def test_lm_base(spark, docs):
    def tokens(text):
        return [t for t in fold_case(text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if t]

    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in docs}
    count = Counter(t for d, text, *_ in docs if not held[d] for t in tokens(text))
    texts = sum(not h for h in held.values())
    total, types = sum(count.values()) + texts, len(count) + 1
    got = {r["doc_id"]: r for r in lm_score.query(spark, SF).collect()}
    for d, text, *_ in docs:
        r, own = got[d], tokens(text)
        base = sum(math.log10((c + 1) / (total + types + 1)) for c in [*(count[t] for t in own), texts])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(own) + 1, 1 + sum(count[t] > 0 for t in own), total)
        assert abs(r["base_score"] - base) < 1e-6
    out = [r for d, r in got.items() if held[d]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # better than the unigrams on texts it hasn't seen


def test_lm_does_not_depend_on_buckets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("held_out", language_id.fold("doc_id", 7) == 2)
    one, many = ({r["doc_id"]: r["score"] for r in lm_score.score(docs.repartition(n), bucket_tokens=b, frequent_pairs=p).collect()} for n, b, p in ((1, 10**9, 10**6), (5, 700, 50)))
    assert max(abs(one[d] - many[d]) for d in one) < 1e-6


def test_lm_probabilities_sum_to_one():
    """After any context: those of all words, the end, and one word for the unseen."""
    rng = np.random.default_rng(2)
    both = rng.poisson(0.3, (50, 50))  # of pairs: contexts by words, the last of which is the end
    own, before = both.sum(axis=0), both.sum(axis=1)
    code = [(lm_score.context_bucket(np.array([before[i] - 1]))[0] << 20) | (lm_score.log_step(np.array([both[i, j] - 1]), np.array([before[i] - 1]))[0] << 10) | lm_score.log_step(np.array([own[j] - 1]), np.array([own.sum() - 1]))[0] for i in range(50) for j in range(50) if both[i, j]]
    weights = lm_score.learn(np.array(code), both[both > 0].ravel(), 51)
    words = lm_score.Vocabulary(np.arange(49, dtype=np.uint64), own[:49], int(own.sum()), 50, int(own[49]))
    model = lm_score.Model(words, weights, np.zeros(0, np.int64), np.zeros(0, np.int64))
    for i in range(51):  # the last context was never seen
        n, h = (both[i], before[i]) if i < 50 else (np.zeros(50, int), 0)
        total = (10 ** model.log10(np.append(n, 0), np.full(51, h), np.append(own, 0))).sum()
        assert abs(total - 1) < 1e-9


def test_lm_learns_nothing_from_held_out_texts(spark):
    rng = random.Random(3)
    train = [(i, prose(rng, 60, 40), False) for i in range(40)]
    folds = [[], [(100 + i, prose(rng, 60, 40), True) for i in range(20)], [(100 + i, train[i][1], True) for i in range(20)]]
    first, *others = ({r["doc_id"]: r["score"] for r in lm_score.score(spark.createDataFrame(train + fold, "doc_id bigint, text string, held_out boolean")).collect() if r["doc_id"] < 100} for fold in folds)
    assert all(abs(first[d] - other[d]) < 1e-9 for other in others for d in first)


def test_lm_of_all_words(spark):
    rng = random.Random(4)
    texts = {i: " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(80))) for i in range(120)}
    docs = spark.createDataFrame([(i, t, i % 7 == 2) for i, t in texts.items()], "doc_id bigint, text string, held_out boolean")
    pairs = {i: list(zip(["<s>", *t.split()], [*t.split(), "</s>"], strict=True)) for i, t in texts.items()}
    both = Counter(p for i, x in pairs.items() if i % 7 != 2 for p in x)
    before, own = Counter(), Counter()
    for (h, w), n in both.items():
        before[h] += n
        own[w] += n
    total, bucket = sum(own.values()), lambda n: n.bit_length()

    def parts(n, h, w, total):
        return (n / h if h else 0, w / total, 1 / (len(own) + 1))

    weights = {}
    for b in {bucket(before[h] - 1) for h, _ in both}:
        rows = [(n, parts(n - 1, before[h] - 1, own[w] - 1, total - 1)) for (h, w), n in both.items() if bucket(before[h] - 1) == b]
        weight = [1 / 3] * 3
        for _ in range(100):
            sums = [0.0] * 3
            for n, p in rows:
                mass = sum(x * y for x, y in zip(weight, p, strict=True))
                for k in range(3):
                    sums[k] += n * weight[k] * p[k] / mass
            weight = [x / sum(sums) for x in sums]
        weights[b] = weight
    got = [{r["doc_id"]: r["score"] for r in lm_score.score(docs, size=k, bucket_tokens=500).collect()} for k in (1_000_000, 20, 0)]
    for i, x in pairs.items():
        want = sum(math.log10(sum(a * b for a, b in zip(weights[bucket(before[h])], parts(both[h, w], before[h], own[w], total), strict=True))) for h, w in x)
        assert abs(got[0][i] - want) < 0.01 * abs(want)  # probabilities are rounded while weights are learned
        assert all(abs(other[i] - got[0][i]) < 1e-6 for other in got[1:])


DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_labels_of_absent_documents_take_no_places(spark):
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} text {i % 7}", "en", "web", 9) for i in range(40)], DOCUMENT)
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id bigint, quality int")
    some, same = ({r["doc_id"]: r["quality_score"] for r in quality.quality(docs, labels.where(f"doc_id < {n}"), ("quality",), size=40).collect()} for n in (4000, 40))
    assert some == same and all((score > 0.5) == (d % 2 == 1) for d, score in some.items())


def plain_co_training(docs, labels, lots, rounds, share):
    """Scores of all rows, with features from the library and all else in loops over rows."""
    batch = pa.RecordBatch.from_pylist(docs, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]))
    found = quality.views(batch)
    features = [[sorted(f[1][f[0] == r].tolist()) for r in range(len(docs))] for f in found]
    y = [labels.get(d["doc_id"]) for d in docs]
    held = [v is not None and zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2 for d, v in zip(docs, y, strict=True)]
    own = [r for r in range(len(docs)) if y[r] is not None and not held[r]]
    known = np.array([float(y[r]) for r in own])
    taught, n_taught = [np.zeros((2, 1 << quality.BITS), np.int64) for _ in range(2)], [0, 0]

    def fit(v):
        pairs = [(k, b) for k, r in enumerate(own) for b in features[v][r]]
        return quality.Linear.fit(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), known, taught[v], len(own) / max(len(own), n_taught[v]))

    def logit(m, v, r):
        return float(m.weight[features[v][r]].sum() + m.bias)

    models = [fit(0), fit(1)]
    for k in range(1, rounds + 1):
        new, said = [np.zeros_like(taught[0]) for _ in range(2)], ([], [])
        for v in range(2):
            free = [r for r in range(len(docs)) if y[r] is None]
            take = int(min(1.0, k * share) * len(free))
            ones = int(round(take * known.mean()))
            bins = {r: int(quality._bin(np.array([logit(models[v], v, r)]))[0]) for r in free}
            for label, n, order in ((0, take - ones, 1), (1, ones, -1)):
                ranked = sorted(order * b for b in bins.values())
                for r in free if n else ():
                    b = order * bins[r]
                    before, same = sum(x < b for x in ranked), ranked.count(b)
                    if before + same < n or before < n and lots[docs[r]["doc_id"]] % 2**64 / 2**64 < (n - before) / same:
                        new[1 - v][label][features[1 - v][r]] += 1
                        said[v].append(r)
            n_taught[1 - v] = len(said[v])
            assert len(set(said[v])) == len(said[v])  # else neither class counts, which this version leaves out
        taught = new
        models = [fit(0), fit(1)]
    z = np.array([[logit(models[v], v, r) for v in range(2)] for r in range(len(docs))])
    use = [r for r in range(len(docs)) if held[r]]
    combine = quality.calibrate(z[use], np.array([float(y[r]) for r in use]))
    return 1 / (1 + np.exp(-(z @ combine[:-1] + combine[-1])))


def test_co_training(spark):
    rng = random.Random(12)
    docs = []
    for d in range(160):
        good = rng.random() < 0.5
        own = " ".join(f"{'g' if good != (rng.random() < 0.1) else 'b'}{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randint(5, 60)))
        docs.append({"doc_id": d, "text": own, "lang": rng.choice(["en", "de"]), "source": f"{'a' if good != (rng.random() < 0.2) else 'b'}{rng.randrange(60)}", "n_chars": rng.randrange(5000), "good": good})
    labels = {d["doc_id"]: int(d["good"]) for d in docs if d["doc_id"] % 2}
    df = spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"]) for d in docs], DOCUMENT)
    given = spark.createDataFrame(list(labels.items()), "doc_id bigint, quality int")
    one, many = ({r["doc_id"]: r["quality_score"] for r in quality.quality(df.repartition(n), given, ("quality",), rounds=2, share=0.2).collect()} for n in (1, 5))
    assert max(abs(one[d] - many[d]) for d in one) < 1e-9
    lots = {r["doc_id"]: r["lot"] for r in quality.featured(df).collect()}
    want = plain_co_training(docs, labels, lots, 2, 0.2)
    assert max(abs(one[d["doc_id"]] - want[k]) for k, d in enumerate(docs)) < 1e-6
    assert quality.quality(df, given.where("false"), ("quality",)).where("quality_score is not null").count() == 0


def test_quality_on_labels_not_given(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"]: r for r in labels.where("doc_id % 5 = 0").collect()}
    rows = [r for r in quality.quality(docs, labels.where("doc_id % 5 != 0")).collect() if r["doc_id"] in kept]
    for target in ("quality", "toxic"):
        ones, zeros = ([r[f"{target}_score"] for r in rows if kept[r["doc_id"]][target] == y] for y in (1, 0))
        wins = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros)
        assert wins / (len(ones) * len(zeros)) > 0.9


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in language_id.query(spark, sf).collect() if r["held_out"] and r["lang_pred"] != "und" and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) / len(rows) > 0.97


def plain_ngrams(text):
    """Counts of 1-, 2- and 3-grams of the letters of words, as code points in one number; a 1 stands at either end of a word."""
    letters = [c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()]
    out = Counter()
    for word in "".join(letters).split(" "):
        if word:
            code = [1, *map(ord, word), 1]
            out.update(code[1:-1])
            out.update(a << 21 | b for a, b in zip(code, code[1:], strict=False))
            out.update((a << 21 | b) << 21 | c for a, b, c in zip(code, code[1:], code[2:], strict=False))
    return out


def best(counts):
    return sorted(counts, key=lambda c: (-counts[c], c))[:300]


def test_language_against_a_plain_version(spark, docs):
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, *_ in docs}
    sums = {}
    for d, text, lang, _ in docs:
        if not held[d] and lang is not None:
            sums.setdefault(lang, Counter()).update(plain_ngrams(text))
    ranks = {lang: {c: k for k, c in enumerate(best(n))} for lang, n in sums.items()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["held_out"]) for r in language_id.query(spark, SF).collect()}
    for d, text, *_ in docs:
        own = best(plain_ngrams(text))
        away = {lang: sum(abs(r[c] - k) if c in r else 300 for k, c in enumerate(own)) for lang, r in ranks.items()}
        want = min(sorted(away), key=away.get) if own else "und"
        assert got[d] == (want, pytest.approx(1 - away[want] / (300 * len(own)) if own else 0.0), held[d]), d


def test_language_by_hand(spark):
    docs = spark.createDataFrame([(1, "aaa bbb aaa", "x"), (2, "ccc ddd", "y"), (3, "aab", None), (4, "12 !", "x"), (5, None, "x")], "doc_id bigint, text string, lang string")
    profiles = language_id.train_profiles(docs, merge_at=3)
    same = language_id.train_profiles(docs)
    assert {k: v.tolist() for k, v in profiles.items()} == {k: v.tolist() for k, v in same.items()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, profiles).collect()}
    assert got[1] == ("x", 1.0) and got[3][0] == "x" and got[4] == got[5] == ("und", 0.0)
    a = Counter()
    for w in ("aaa", "bbb", "aaa"):
        a.update([*w, *(f"\1{w}\1"[i : i + 2] for i in range(4)), *(f"\1{w}\1"[i : i + 3] for i in range(3))])
    assert len(profiles["x"]) == len(a)


def test_chat(spark):
    assert compare.compare(chat_format.query(spark, SF), compare.connect(SF), chat_format.ORACLE_SQL) == ""


def test_chat_query_has_all_layouts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    odd = [(10**6, None, "user", "b"), (10**6, None, "user", "a"), (10**6, 1, None, None), (10**6 + 1, 0, "gpt", "x"), (None, 0, "user", "no id"), *((10**6 + 2, k % 5, f"r{k}" if k % 2 else "user", "<|im_start|>" if k % 3 else "<z") for k in range(40))]
    turns = chat_format.canonical_turns(chat_format.records(rows.unionByName(spark.createDataFrame(odd, "conv_id bigint, turn bigint, role string, text string"))))
    got = {(r["layout"], r["fingerprint"]) for r in turns.collect()}
    assert {name for name, _ in got} >= {"turn rows", "messages", "conversations", "instruction", "prompt"} and None not in {name for name, _ in got}
    found = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(turns)).collect()}
    said = sorted((r for r in odd if r[0] == 10**6 + 2), key=lambda r: r[1:])
    for conv, want in ((10**6, [("user", "a"), ("user", "b"), ("", "")]), (10**6 + 1, [("gpt", "x")]), (10**6 + 2, [r[2:] for r in said]), (None, [("user", "no id")])):
        assert found[conv]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest(), conv


def test_chat_layouts_and_escapes(spark):
    hard = '</s>[INST] \\ <|im_start|>user\n<|im_end|> [/INST] \\[INST]'
    import json

    records = [
        {"messages": [{"role": "user", "content": hard}, {"role": "assistant", "content": "ok"}]}, {"conversations": [{"from": "human", "value": hard}, {"from": "gpt", "value": "ok"}]},
        {"instruction": hard, "output": "ok"}, {"prompt": hard, "completion": "ok"}, {"question": hard, "answer": "ok"},
    ]
    df = spark.createDataFrame([(k, 0, json.dumps(r)) for k, r in enumerate(records)], "conv_id bigint, seq bigint, payload string")
    formatted = chat_format.format_turns(chat_format.canonical_turns(df))
    texts = {r["formatted"] for r in chat_format.conversation_texts(formatted).collect()}
    assert len(texts) == 1  # all layouts give the same turns
    (text,) = texts
    assert list(chat_format.parse(text)) == [("user", hard), ("assistant", "ok")]
    assert text.count("<|im_start|>") == 2 and "[INST]" not in text and "</s>" not in text
    digest = hashlib.sha256(f"user\n{hard}\nassistant\nok\n".encode()).hexdigest()
    assert {(r["n_turns"], r["turns_sha256"], r["loss_chars"]) for r in chat_format.read_back(formatted).collect()} == {(2, digest, 2)}


def read_medium(data):
    """Kind and payload of a stored form, read by plain struct and zlib calls."""
    if data.startswith(b"Content-Type"):
        data = data.partition(b"\r\n\r\n")[2][:-4]
    if data[:4] == b"RIFF":
        return "wav", data[44 : 44 + struct.unpack_from("<I", data, 40)[0]]
    if data[:2] == b"BM":
        return "bmp", data[struct.unpack_from("<I", data, 10)[0] :]
    plain = zlib.decompress(data[41 : 41 + struct.unpack_from(">I", data, 33)[0]])
    return "png", b"".join(plain[k + 1 : k + 65] for k in range(0, len(plain), 65))


def test_media(spark, docs):
    got = {r["doc_id"]: r for r in media.query(spark, SF).collect()}
    stored = {r["doc_id"]: r for r in media.corrected(media.stored_media(spark.read.parquet(f"{SF}/documents.parquet"))).collect()}
    kinds = set()
    for d, text, *_ in docs:
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r, data = got[d], bytes(stored[d]["media"])
        kind, inside = read_medium(data)
        kinds.add((kind, stored[d]["kind"], stored[d]["wrong"]))
        assert inside == payload and (stored[d]["kind"] == media.UNKNOWN) == data.startswith(b"Content") and stored[d]["wrong"] == (stored[d]["declared"] != stored[d]["kind"])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest()) and f"/{kind}@" in r["feature"]
    assert len(kinds) >= 7  # right and wrong declarations of each form, and carved ones


@pytest.mark.parametrize(
    "data",
    [b"fLaC\x00\x00\x00\x22" + bytes(34) + b"\x80\x00\x00\x00", b"%PDF-1", b"%PDF-1 startxref %%EOF", b"PK\x03\x04", b"\xff\xd8\xff\xda\x00\x02", b"GIF89a" + bytes(7) + b"!\xf9\xff", b"\x00\x00\x00\x10ftypmp42mdat", b"RIFF\x04\x00\x00\x00WAVE", b"\x89PNG\r\n\x1a\n\x00\x00\x00\x00IHDR"],
)
def test_hostile_media_take_time_in_proportion(data):
    began = time.process_time()
    found = media.sniff(data * (400_000 // len(data)) + b"PK\x05\x06" + bytes(18))
    assert time.process_time() - began < 8 and sum(f.length for f in media.outermost(found)) <= 400_100


def png():
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_carving(spark):
    image = png()
    gif = b"GIF89a\1\0\1\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02scan\xff\x00more\xff\xd9"
    mp4 = b"\x00\x00\x00\x0cftypmp42\x00\x00\x00\x0amdatxx"
    pdf = b"%PDF-1.4 x startxref 9 %%EOF"
    broken = image[:-5] + b"xxxxx"
    values = [(1, image, "image/jpeg"), (2, b"junk" + image + b"more" + gif + jpeg + mp4 + pdf + pdf, "image/png"), (3, broken, "image/png"), (4, None, "image/gif"), (5, b"", None), (6, media.to_wav(b"ab" + image), "audio/wav")]
    rows = media.corrected(spark.createDataFrame(values, "id int, media binary, declared string"))
    got = {r["id"]: r for r in rows.collect()}
    cut = {k: [(r["kind"], bytes(r["bytes"])) for r in media.carved(rows, ("id",)).where(f"id = {k}").orderBy("start").collect()] for k in (2, 6)}
    assert (got[1]["kind"], got[1]["wrong"]) == ("image/png", True)
    assert cut[2] == [("image/png", image), ("image/gif", gif), ("image/jpeg", jpeg), ("video/mp4", mp4), ("application/pdf", pdf), ("application/pdf", pdf)] and got[2]["kind"] == media.UNKNOWN
    assert got[3]["kind"] == got[4]["kind"] == got[5]["kind"] == media.UNKNOWN
    assert (got[6]["kind"], got[6]["wrong"], cut[6]) == ("audio/wav", False, [("image/png", image)])


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>One<p>Two &amp; <b>three</b>", "One\n\nTwo & three"),
        ("<ul><li>a<li>b<ol start=3><li>c</ol></ul>", "- a\n- b\n  3. c"),
        ("<table><tr><td>a<td>long<tr><th>bbb<td>x</table>", "a   | long\nbbb | x"),
        ("<head><title>t</title><style>p{}</style></head>a<script>if (a<b) {}</script>b<!-- c -->", "ab"),
        ("x<div style='display: none'>no</div><div hidden>no</div>y", "xy"),
        ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
        ("<dialog open>hi</dialog><dialog>no</dialog>", "hi"),
        ("<select><option>a<option selected>b</select>", "b"),
        ("<select><option disabled>a<option>b</select>", "b"),
        ("<select multiple><option>a<option>b</select>", "a\nb"),
        ("<svg><title>t</title><text>shown</text>not</svg>", "shown"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
        ("<table><tr><td colspan=2>both<td>c<tr><td>1<td>2<td>3</table>", "both  | c\n1 | 2 | 3"),
        ("<table><tr><td rowspan=2>r<td>a<tr><td>b<tr><td>c<td>d</table>", "r | a\n  | b\nc | d"),
        ("<p>a<div>b</p>c", "a\n\nb\n\nc"),
        ("<details><summary>s</summary>x</details><details open>y</details>", "s\ny"),
        ("a<br>b", "a\nb"),
        ("", ""),
    ],
)
def test_html(html, text):
    assert html_text.page_text(html) == text


class Words(HTMLParser):
    """Words outside of elements that aren't shown, for pages of simple elements."""

    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title")

    def handle_data(self, data):
        self.words += [] if self.hidden else [data]


def test_html_of_all_pages(spark):
    for r in html_text.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), keep=("page_id", "html")).collect():
        page = Words()
        page.feed(r["html"])
        page.close()
        lines = [re.sub(r"^\s*- ", "", line) for line in r["text"].split("\n")]
        assert " ".join(lines).split() == " ".join(page.words).split(), r["page_id"]


@pytest.mark.parametrize(
    "html",
    ["<ul><li>x" * 40_000, "<div>" * 200_000 + "x", "<table><tr><td>x" * 20_000, "<table>" + "<tr><td>a<td>b" * 9000 + "<tr><td>" + "x" * 100_000 + "<td>y</table>", "<table><tr>" + "".join(f"<td rowspan={k + 2}>a" for k in range(9000)) + "<tr><td>b" * 9000, "<table><tr><td>" + "x<br>" * 30_000 + "<td>y" * 30_000, "<table>" + "<tr><td colspan=1000>a" * 20_000],
    ids=lambda x: x[:24],
)
def test_hostile_pages_take_time_and_space_in_proportion(html):
    began = time.process_time()
    text = html_text.page_text(html)
    assert time.process_time() - began < 15 and len(text) < 12 * len(html)


def plain_raking(rows, targets, rounds=2000):
    """Probabilities of rows (source, lang, topic, tokens), scaling them to one dimension's target after the other."""
    total, weight = sum(r[3] for r in rows), [1.0] * len(rows)
    wanted = []
    for k, name in enumerate(mixing.DIMENSIONS):
        sums = Counter()
        for r in rows:
            sums[r[k]] += r[3]
        raw = {v: targets[name].get(v, 0.0) if isinstance(targets[name], dict) else n ** targets[name] for v, n in sums.items() if n}
        wanted.append({v: x / sum(raw.values()) for v, x in raw.items()})
    for _ in range(rounds):
        for k in range(3):
            now = Counter()
            for r, w in zip(rows, weight, strict=True):
                now[r[k]] += r[3] * w / total
            weight = [w * wanted[k].get(r[k], 0.0) / now[r[k]] if now[r[k]] else 0.0 for r, w in zip(rows, weight, strict=True)]
    top = max(w for w, r in zip(weight, rows, strict=True) if r[3])
    return [w / top if r[3] else 0.0 for w, r in zip(weight, rows, strict=True)]


def test_raking(spark):
    rng = random.Random(1)
    words = [[f"{t}{k}" for k in range(40)] for t in "abc"]
    rows = [(d, " ".join(rng.choices(rng.choice(words), k=rng.choice([5, 50, 300]))), rng.choice(["en", "de", None]), rng.choice(["web", "web", "books"]), 1) for d in range(300)] + [(900, "", "en", "web", 0), (901, None, "en", "web", 0)]
    df = spark.createDataFrame(rows, DOCUMENT)
    targets = {"source": {"web": 0.5, "books": 0.5}, "lang": 0.5, "topic": 0.3}
    for driver_cells in (100_000, 0):
        out = mixing.calibrated(df, targets, topics=3, driver_cells=driver_cells, rounds=40).collect()
        want = plain_raking([(r["source"], r["lang"], r["topic"], r["tokens"]) for r in out], targets, 40)
        assert max(abs(r["probability"] - w) for r, w in zip(out, want, strict=True)) < 1e-6
        assert all(r["tokens"] == len((r["text"] or "").split()) for r in out)
        assert len({(r["topic"], (r["text"] or "-")[0]) for r in out if r["tokens"] != 5}) == 4  # each kind of words is a topic, and no words are
    got = {d: s for d, s in ((r["doc_id"], r["sampled"]) for r in mixing.calibrated(df.repartition(3), targets).collect())}
    assert got == {d: s for d, s in ((r["doc_id"], r["sampled"]) for r in mixing.calibrated(df, targets).collect())}
    kept = sum(len(r["text"].split()) for r in mixing.sample(df, targets=targets).collect())
    assert abs(kept - sum(r["probability"] * r["tokens"] for r in mixing.calibrated(df, targets).collect())) < 0.2 * kept


def test_targets_that_no_weights_meet(spark):
    df = spark.createDataFrame([(1, "x y", "en", "web", 3), (2, "x y", "de", "books", 3)], DOCUMENT)
    with pytest.warns(UserWarning, match="no weights meet"):
        mixing.calibrated(df, {"source": {"web": 0.9, "books": 0.1}, "lang": {"en": 0.1, "de": 0.9}, "topic": 1.0}, rounds=20)


def test_pipeline(spark):
    """run() against the stages' plain versions, up to the last, which is held against its operator."""
    sf = SF
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    profiles = language_id.train_profiles(docs.where(language_id.fold("doc_id", 4) != 2))
    rows = [(r["doc_id"], r["text"]) for r in language_id.recognised(docs, profiles).orderBy("doc_id").collect()]
    seen, after = [], []
    for doc, text in rows:
        kept = []
        for line in text.split("\n"):
            w = frozenset(words(line))
            if not (w and any(5 * len(w & v) >= 4 * len(w | v) for v in seen)):
                kept.append(line)
            if w:
                seen.append(w)
        after.append((doc, "\n".join(kept)))
    _, least = groups_of(after)
    after = [(d, t) for d, t in after if least[d] == d]
    windows = []
    for item, text in (tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()):
        w = words(text)
        windows += [(str(item), w[i : i + 13]) for i in range(max(len(w) - 12, min(len(w), 1)))]
    by_first = {}
    for item, w in windows:
        by_first.setdefault(w[0], []).append((item, w))
    clean = []
    for d, t in after:
        n, hit, _ = hits(t, [w for first in set(words(t)) for w in by_first.get(first, ())])
        if not (hit and 20 * hit >= n):
            clean.append((d, t))
    meta = {r["doc_id"]: r for r in docs.collect()}
    left = spark.createDataFrame([(d, t, meta[d]["lang"], meta[d]["source"], len(t)) for d, t in clean], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = {(r["doc_id"], r["text"]) for r in mixing.sample(left).collect()}
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.run(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_registered():
    names = __spark_entry__.queries()
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 11)) and "pipeline" in names
