"""Inputs on which scanners that look ahead again and again take time by the square."""

import random
import struct
import time

import pytest

from trailweave.llm import html_text, media, mixing

SIZE = 400_000


@pytest.mark.parametrize("unit", ["<a ", "<a b='", "<a<a", "<a b=\"'", "<a/", "</", "<!", "<a b='\"", "<a \"' ", "<a b=c>x"])
@pytest.mark.parametrize("tail", ["", ">"])
def test_unclosed_tags(unit, tail):
    began = time.process_time()
    html_text.page_text(unit * (SIZE // len(unit)) + tail)
    assert time.process_time() - began < 8


def test_tags_that_do_not_end_are_text():
    assert html_text.page_text("a <b c='>' d>x</b> <i j='x y") == "a x <i j='x y"
    assert html_text.page_text("<p>one <a href=\"<b>\">two</a> 3 < 4 <c") == "one two 3 < 4 <c"
    assert html_text.page_text("<script>'<a b=\"</script><p>after \"quotes\">") == 'after "quotes">'


def plain_wav(data, at):
    if len(data) < at + 12 or data[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    seen, p = [], at + 12
    while p + 8 <= end <= len(data):
        seen.append(data[p : p + 4])
        size = struct.unpack_from("<I", data, p + 4)[0]
        p += 8 + size + size % 2
    return end - at if p == end and b"data" in seen and b"fmt " in seen[: seen.index(b"data")] else None


def test_riff_chunks_by_another_walk():
    rng, right = random.Random(4), 0
    for _ in range(5000):
        data = b""
        for _ in range(rng.randrange(1, 8)):
            kinds = (b"RIFF" + struct.pack("<I", rng.choice([4, 12, 20, 28, 36, rng.randrange(60)])) + b"WAVE", b"fmt " + struct.pack("<I", rng.choice([0, 1, 2, 8])), b"data" + struct.pack("<I", rng.choice([0, 1, 2, 8, 16])), bytes(rng.randrange(1, 5)))
            data += rng.choice(kinds)
        found = media.Structures(data)
        for at in found.places(b"RIFF"):
            assert media.wav_length(found, at) == plain_wav(data, at)
            right += plain_wav(data, at) is not None
    assert right > 3


def test_headers_that_jump_into_one_chain():
    n, chain = SIZE // 40, b"junk\0\0\0\0" * (SIZE // 16)
    data = b"".join(b"RIFF" + struct.pack("<I", 20 * n + len(chain) - 20 * k - 8) + b"WAVE" + b"ab  " + struct.pack("<I", 20 * (n - k - 1)) for k in range(n)) + chain
    began = time.process_time()
    media.sniff(data)
    assert time.process_time() - began < 8


def test_each_language_has_a_mean_of_its_own(spark):
    """Texts of a hundred languages, each of words of its own, and one topic word that all share half of the time."""
    rows = [(100 * k + n, " ".join([f"l{k}w{j}" for j in range(30)] + ["shared topic words " * 8] * (n % 2)), f"lang{k}", "web") for k in range(100) for n in range(4)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    topics = {r["doc_id"]: r["topic"] for r in mixing.calibrated(documents, {"source": 1.0, "lang": 1.0, "topic": 1.0}, topics=2).collect()}
    pairs = {(d % 2, t) for d, t in topics.items()}
    assert len(pairs) == 2 and len({t for _, t in pairs}) == 2
    described = mixing.described(documents)
    assert mixing.languages_of(described, 100) == sorted(f"lang{k}" for k in range(100))
    with pytest.raises(ValueError, match="more than 99 languages"):
        mixing.languages_of(described, 99)


def test_cells_by_another_layout():
    rng = random.Random(1)
    for _ in range(3000):
        given = [[(rng.choice([1, 1, 1, 2, 3, 5]), rng.choice([1, 1, 2, 3, 4, 0])) for _ in range(rng.randrange(5))] for _ in range(rng.randrange(1, 9))]
        # cells of one row don't hold each other back by what they take in later rows
        rows = [[html_text.Cell("", c, n) for c, n in row] for row in given]
        html_text.place(rows)
        want, above = [], []
        for r, row in enumerate(given):
            above, column, new = [x for x in above if x[2] > r], 0, []
            for columns, n in row:
                while any(a <= column < b for a, b, _ in above):
                    column += 1
                want.append(column)
                new.append((column, column + columns, r + n if n else len(rows)))
                column += columns
            above += [x for x in new if x[2] > r + 1]
        assert [c.at for row in rows for c in row] == want


@pytest.mark.parametrize("cell", [lambda k, n: (1, 0), lambda k, n: (1, n - k), lambda k, n: (1, 2 + k * 7919 % 5000), lambda k, n: (1000, 2 + k % 3), lambda k, n: (1000, 2 + n - k)])
def test_tables_of_cells_that_reach_down(cell):
    n = 14_000
    rows = [[html_text.Cell("x", *cell(k, n)), html_text.Cell("y")] for k in range(n)]
    began = time.process_time()
    html_text.place(rows)
    assert time.process_time() - began < 8
    if cell(0, n) == (1, 0):
        assert [row[1].at for row in rows] == list(range(1, n + 1))
