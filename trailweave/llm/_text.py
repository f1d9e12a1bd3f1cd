"""Word spans, hashes and small Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = 32


def _table(separators) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = SPACE
    return table


#: Lower-cases A-Z; all other ASCII but letters and digits separates words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
WORDS = _table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Lower-cases A-Z; white space alone separates words ``[^\x20\x09-\x0D]+``.
TOKENS = _table([0x20, *range(0x09, 0x0E)])

_STEP = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, _STEP + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, nulls as empty texts, and the offsets of its rows."""
    text = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    if not len(text) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last bytes of the words of folded text; no word passes an offset."""
    word = data != SPACE
    start, stop = word.copy(), word.copy()
    if len(data):
        start[1:] &= ~word[:-1]
        stop[:-1] &= ~word[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        start[cuts] = word[cuts]
        stop[cuts - 1] = word[cuts - 1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by differences of prefix sums of a polynomial."""
    out = np.empty(len(first), np.uint64)
    i = 0
    while i < len(first):
        base = first[i]
        j = max(i + 1, int(np.searchsorted(last, base + _STEP, "right")))
        part = data[base : last[j - 1]]
        power, inverse = _power(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * power[: len(part)], out=sums[1:])
        a, b = first[i:j] - base, last[i:j] - base
        out[i:j] = (sums[b] - sums[a]) * inverse[a]
        i = j
    return mix(out)


def word_hashes(column: pa.Array, table: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column, and the offsets of each row's words among them."""
    data, offsets = buffers(column)
    data = table[data]
    first, last = spans(data, offsets)
    return hashes(data, first, last), np.searchsorted(first, offsets)


def pieces(column: pa.Array, size: int = 4 << 20):
    """Slices (from, to) of a column of about ``size`` bytes of text, whole rows each."""
    _, offsets = buffers(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def owners(offsets: np.ndarray) -> np.ndarray:
    """The row of each element, from the rows' offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def windows(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a row, and each run's row.  A row of fewer words, but not none, is one run."""
    row = owners(offsets)
    full = np.zeros(0, np.uint64)
    keep = np.zeros(0, bool)
    if len(h) >= n:
        full = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            full = full * np.uint64(_BASE) + h[k : len(h) - n + 1 + k]
        keep = row[: len(full)] == row[n - 1 :]
    counts = np.diff(offsets)
    short = np.flatnonzero((counts > 0) & (counts < n))
    values, rows = [mix(full[keep])], [row[: len(full)][keep]]
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = counts[short] > k
            total[has] = total[has] * np.uint64(_BASE) + h[offsets[short[has]] + k]
        values.append(mix(total + counts[short].astype(np.uint64)))
        rows.append(short)
    return np.concatenate(values), np.concatenate(rows)


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A list column; one batch of it holds fewer than 2**31 values."""
    if len(values) >= 1 << 31:
        raise OverflowError(f"{len(values)} values in the lists of one batch; give fewer or shorter texts to a batch")
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (from 0) of a list column without nulls."""
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)
