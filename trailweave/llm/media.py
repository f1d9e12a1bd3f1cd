"""Media columns: signature sniffing, validation, type correction and carving of binary payloads."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import pieces

UNKNOWN = "application/octet-stream"
BLOCK = 64
RATE = 8000

#: Magic bytes of formats, and how far from its start each is.
MAGIC = (
    ("audio/wav", b"RIFF", 0),
    ("image/png", b"\x89PNG\r\n\x1a\n", 0),
    ("image/jpeg", b"\xff\xd8\xff", 0),
    ("image/gif", b"GIF87a", 0),
    ("image/gif", b"GIF89a", 0),
    ("image/bmp", b"BM", 0),
    ("application/pdf", b"%PDF-", 0),
    ("application/zip", b"PK\x03\x04", 0),
    ("audio/flac", b"fLaC", 0),
    ("video/mp4", b"ftyp", 4),
)


class Structures:
    """Bytes whose formats are checked: what checks at many places would look up again and again is found once."""

    def __init__(self, data: bytes):
        self.data = data
        self._chains: dict[str, dict[int, tuple | None]] = {}

    def places(self, mark: bytes) -> list[int]:
        """Where a mark is, ascending."""
        found, at = [], self.data.find(mark)
        while at >= 0:
            found.append(at)
            at = self.data.find(mark, at + 1)
        return found

    @cached_property
    def chunks(self) -> Chunks:
        return Chunks(self.data)

    @cached_property
    def zip_ends(self) -> list[int]:
        return self.places(b"PK\x05\x06")

    @cached_property
    def pdf_starts(self) -> list[int]:
        return self.places(b"%PDF-")

    @cached_property
    def jpeg_marks(self) -> np.ndarray:
        """Markers that end a scan: neither stuffed bytes nor restarts."""
        data = np.frombuffer(self.data, np.uint8)
        at = np.flatnonzero(data[:-1] == 0xFF)
        after = data[at + 1]
        return at[(after != 0) & ((after < 0xD0) | (after > 0xD7))]

    def chain(self, name: str, at: int, step: Callable[[int], tuple[int | None, tuple | None]]) -> tuple | None:
        """What a chain of blocks comes to.  ``step`` gives the next block's place, or None and the outcome; chains that meet go on as one, so that no block is read twice."""
        known = self._chains.setdefault(name, {})
        passed = []
        while at not in known:
            passed.append(at)
            after, outcome = step(at)
            if after is None:
                known[at] = outcome
                break
            at = after
        outcome = known[at]
        for p in passed:
            known[p] = outcome
        return outcome


class Chunks:
    """Chains of RIFF chunks that may meet: for each chunk the next one, one further on (so that any later one is found in few steps), and the first ``data`` and ``fmt `` from it on."""

    def __init__(self, data: bytes):
        self.data = data
        self.known: dict[int, tuple[int, int, int, float, float]] = {}  # next, how many follow, further on, data, fmt

    def _walk(self, at: int) -> None:
        passed = []
        while at not in self.known:
            passed.append(at)
            if at + 8 > len(self.data):
                self.known[at] = (at, 0, at, math.inf, math.inf)
                break
            size = struct.unpack_from("<I", self.data, at + 4)[0]
            at += 8 + size + size % 2
        for p in reversed(passed):
            if p in self.known:
                continue
            size, name = struct.unpack_from("<I", self.data, p + 4)[0], self.data[p : p + 4]
            after = p + 8 + size + size % 2
            _, more, far, data, fmt = self.known[after]
            _, far_more, farther, _, _ = self.known[far]
            jump = farther if more - far_more == far_more - self.known[farther][1] else after
            self.known[p] = (after, more + 1, jump, p if name == b"data" else data, p if name == b"fmt " else fmt)

    def fills(self, at: int, end: int) -> bool:
        """Whether the chunks from ``at`` come to ``end``, a ``fmt `` among them before the first ``data``."""
        self._walk(at)
        _, _, _, data, fmt = self.known[at]
        while at < end:
            after, more, jump, _, _ = self.known[at]
            if not more:
                return False
            at = jump if jump <= end else after
        return at == end and fmt < data < end


def wav_length(found: Structures, at: int) -> int | None:
    """RIFF/WAVE: a format chunk before the data chunk, and chunks that fill the length the header gives."""
    data = found.data
    if len(data) < at + 12 or data[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    return end - at if end <= len(data) and found.chunks.fills(at + 12, end) else None


def png_length(found: Structures, at: int) -> int | None:
    """PNG: chunks with right checksums, from IHDR to IEND."""
    data = found.data

    def step(p: int) -> tuple[int | None, tuple | None]:
        if p + 12 > len(data):
            return None, None
        size, kind = struct.unpack_from(">I", data, p)[0], data[p + 4 : p + 8]
        if p + 12 + size > len(data) or zlib.crc32(memoryview(data)[p + 4 : p + 8 + size]) != struct.unpack_from(">I", data, p + 8 + size)[0]:
            return None, None
        return (None, (p + 12 + size,)) if kind == b"IEND" else (p + 12 + size, None)

    if data[at + 12 : at + 16] != b"IHDR":
        return None
    end = found.chain("png", at + 8, step)
    return end[0] - at if end else None


def jpeg_length(found: Structures, at: int) -> int | None:
    """JPEG: segments with lengths up to the scan, then the end marker."""
    data = found.data

    def step(p: int) -> tuple[int | None, tuple | None]:
        """From a segment: a scan goes on to the next marker that ends it; the outcome is whether there was a scan."""
        if p + 4 > len(data) or data[p] != 0xFF or data[p + 1] == 0xD9:
            return None, (p + 2, False) if p + 2 <= len(data) and data[p : p + 2] == b"\xff\xd9" else None
        after = p + 2 + struct.unpack_from(">H", data, p + 2)[0]
        if data[p + 1] == 0xDA:
            k = int(np.searchsorted(found.jpeg_marks, after))
            if k == len(found.jpeg_marks):
                return None, None
            after = int(found.jpeg_marks[k])
            if data[after + 1] == 0xD9:
                return None, (after + 2, True)
        return after, None

    end = found.chain("jpeg", at + 2, step)
    return end[0] - at if end and end[1] else None


def gif_length(found: Structures, at: int) -> int | None:
    """GIF: screen descriptor, then images or extensions up to the trailer."""
    data = found.data
    if len(data) < at + 13:
        return None

    def table(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def block(p: int) -> tuple[int | None, tuple | None]:
        if p >= len(data):
            return None, None
        return (p + 1 + data[p], None) if data[p] else (None, (p + 1,))

    def part(p: int) -> tuple[int | None, tuple | None]:
        """Place after an image or an extension, or the end after the trailer."""
        if p >= len(data) or data[p] == 0x3B:
            return None, (p + 1,) if p < len(data) else None
        if data[p] == 0x2C and p + 10 < len(data):
            blocks = p + 11 + table(data[p + 9])
        elif data[p] == 0x21:
            blocks = p + 2
        else:
            return None, None
        after = found.chain("gif blocks", blocks, block)
        return (after[0], None) if after else (None, None)

    first = at + 13 + table(data[at + 10])
    end = found.chain("gif", first, part)
    return end[0] - at if end and end[0] > first + 1 else None


def bmp_length(found: Structures, at: int) -> int | None:
    """BMP: length in the header, a known header size, and pixels within."""
    data = found.data
    if len(data) < at + 26:
        return None
    size, reserved, pixels, header = struct.unpack_from("<IIII", data, at + 2)
    return size if not reserved and header in (12, 40, 52, 56, 108, 124) and 14 + header <= pixels <= size <= len(data) - at else None


def pdf_length(found: Structures, at: int) -> int | None:
    """PDF: a version, and the last end mark before the next PDF begins, after a cross-reference start."""
    data = found.data
    if not data[at + 5 : at + 6].isdigit():
        return None
    k = bisect_right(found.pdf_starts, at)
    stop = found.pdf_starts[k] if k < len(found.pdf_starts) else len(data)
    end = data.rfind(b"%%EOF", at, stop)
    return end + 5 - at if end > 0 and data.rfind(b"startxref", at, end) > 0 else None


def zip_length(found: Structures, at: int) -> int | None:
    """ZIP: an end record whose central directory lies between the first file and itself."""
    data, k = found.data, bisect_right(found.zip_ends, at)
    if k == len(found.zip_ends) or (end := found.zip_ends[k]) + 22 > len(data):
        return None
    size, offset, comment = struct.unpack_from("<IIH", data, end + 12)
    return end + 22 + comment - at if at + offset + size == end and end + 22 + comment <= len(data) and data[at + offset : at + offset + 4] in (b"PK\x01\x02", b"PK\x05\x06") else None


def flac_length(found: Structures, at: int) -> int | None:
    """FLAC: a stream description first, and metadata blocks within the data; frames go on to the end."""
    data = found.data

    def step(p: int) -> tuple[int | None, tuple | None]:
        if p + 4 > len(data):
            return None, None
        after = p + 4 + int.from_bytes(data[p + 1 : p + 4])
        return (None, (after,) if after <= len(data) else None) if data[p] & 0x80 else (after, None)

    if len(data) < at + 8 or data[at + 4] & 0x7F or int.from_bytes(data[at + 5 : at + 8]) != 34:
        return None
    return len(data) - at if found.chain("flac", at + 4, step) else None


def mp4_length(found: Structures, at: int) -> int | None:
    """MP4: boxes one after another, with a movie or its data among them."""
    data = found.data
    known = found._chains.setdefault("mp4", {})  # of each box: where the boxes end, and whether a movie is among them
    p, passed = at, []
    while p not in known:
        size, kind = struct.unpack_from(">I", data, p)[0] if p + 8 <= len(data) else 0, data[p + 4 : p + 8]
        if size < 8 or p + size > len(data) or not kind.isalnum():
            known[p] = (p, False)
            break
        passed.append((p, kind))
        p += size
    end = known[p]
    for q, kind in reversed(passed):
        end = known[q] = (end[0], end[1] or kind in (b"moov", b"mdat"))
    return end[0] - at if end[1] else None


VALID = {"audio/wav": wav_length, "image/png": png_length, "image/jpeg": jpeg_length, "image/gif": gif_length, "image/bmp": bmp_length, "application/pdf": pdf_length, "application/zip": zip_length, "audio/flac": flac_length, "video/mp4": mp4_length}


@cache
def _automaton() -> ahocorasick.Automaton:
    found: dict[str, list[tuple[str, int, int]]] = {}
    for kind, magic, before in MAGIC:
        found.setdefault(magic.decode("latin-1"), []).append((kind, len(magic), before))
    automaton = ahocorasick.Automaton()
    for magic, kinds in found.items():
        automaton.add_word(magic, kinds)
    automaton.make_automaton()
    return automaton


@dataclass
class Found:
    kind: str
    start: int
    length: int


def sniff(data: bytes) -> list[Found]:
    """Media in some bytes, by start: magic bytes anywhere, confirmed by the format's structure; those within others too."""
    found, structures = [], Structures(data)
    for last, kinds in _automaton().iter(data.decode("latin-1")):
        for kind, size, before in kinds:
            start = last + 1 - size - before
            if start >= 0 and (length := VALID[kind](structures, start)):
                found.append(Found(kind, start, length))
    return sorted(found, key=lambda f: (f.start, -f.length, f.kind))


def outermost(found: list[Found]) -> list[Found]:
    """Those of some media, by start, that don't begin within one before; so they don't overlap."""
    out, end = [], 0
    for f in found:
        if f.start >= end:
            out.append(f)
            end = f.start + f.length
    return out


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """Mono WAV with 8 bits a sample; a chunk of an odd number is padded."""
    pad = bytes(len(samples) % 2)
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + len(pad)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + pad


def wav_samples(data: bytes) -> tuple[int, bytes]:
    """Rate and samples, read from the chunks of a valid WAV."""
    p, rate = 12, 0
    while True:
        name, size = data[p : p + 4], struct.unpack_from("<I", data, p + 4)[0]
        if name == b"fmt ":
            rate = struct.unpack_from("<I", data, p + 12)[0]
        if name == b"data":
            return rate, data[p + 8 : p + 8 + size]
        p += 8 + size + size % 2


def to_png(samples: bytes, width: int = BLOCK) -> bytes:
    """Greyscale PNG with 8 bits a pixel; the number of samples is a multiple of the width."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    plain = np.zeros((len(rows), width + 1), np.uint8)  # each row after its filter, none
    plain[:, 1:] = rows
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(plain.tobytes(), 1)) + chunk(b"IEND", b"")


def png_samples(data: bytes) -> bytes | None:
    """Pixels of a valid greyscale PNG with 8 bits a pixel and rows without filters, else None."""
    width, height, *kind = struct.unpack_from(">IIBBBBB", data, 16)
    if kind != [8, 0, 0, 0, 0]:
        return None
    p, body = 8, []
    while p < len(data):
        size = struct.unpack_from(">I", data, p)[0]
        if data[p + 4 : p + 8] == b"IDAT":
            body.append(data[p + 8 : p + 8 + size])
        p += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return None if rows[:, 0].any() else rows[:, 1:].tobytes()


def to_bmp(samples: bytes, width: int = BLOCK) -> bytes:
    """Greyscale BMP with 8 bits a pixel and its first row on top; the number of samples is a multiple of the width, and that of 4."""
    head = struct.pack("<IiiHHIIiiII", 40, width, -(len(samples) // width), 1, 8, 0, len(samples), 0, 0, 256, 0)
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(-1, 4)
    palette[:, 3] = 0
    start = 14 + len(head) + 1024
    return b"BM" + struct.pack("<III", start + len(samples), 0, start) + head + palette.tobytes() + samples


def bmp_samples(data: bytes) -> bytes | None:
    """Pixels of a valid BMP with 8 bits a pixel, rows from the top and no padding, else None."""
    start, header, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    size = -height * width
    return data[start : start + size] if header == 40 and depth == 8 and not packing and height < 0 and width % 4 == 0 and len(data) == start + size else None


def samples_of(kind: str, data: bytes) -> tuple[int, bytes]:
    """Rate (of sound) and samples of a medium; the bytes themselves of one that isn't read here."""
    if kind == "audio/wav":
        return wav_samples(data)
    found = png_samples(data) if kind == "image/png" else bmp_samples(data) if kind == "image/bmp" else None
    return 0, data if found is None else found


def padded(payload: bytes) -> bytes:
    """Zeros up to a positive multiple of ``BLOCK`` bytes."""
    return payload + bytes(max(BLOCK, -(-len(payload) // BLOCK) * BLOCK) - len(payload))


#: Stored forms, and what is declared of them: right, wrong, unknown or nothing.  The last is a medium within other bytes.
FORMS = (to_wav, to_png, to_bmp, lambda samples: b"Content-Type: image/bmp\r\n\r\n" + to_bmp(samples) + b"\r\n--")
DECLARED = ("audio/wav", "image/png", "image/gif", UNKNOWN, None)


def stored_media(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Stores each whole text, as UTF-8 and padded, losslessly in a ``media`` column, in one of ``FORMS`` and ``declared`` as something, both by the text's checksum.  A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in pieces(batch.column("own_text")):
                part = batch.slice(i, j - i)
                texts = [(x or "").encode() for x in part.column("own_text").to_pylist()]
                marks = [zlib.crc32(x) for x in texts]
                media = pa.array([FORMS[m % len(FORMS)](padded(x)) for m, x in zip(marks, texts, strict=True)], pa.binary())
                declared = pa.array([DECLARED[m // len(FORMS) % len(DECLARED)] for m in marks], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(map(len, texts), pa.int64()), media, declared], [*keep, "n_bytes", "media", "declared"])

    given = documents.select(*(F.col(c).alias(f"own_{k}") for k, c in enumerate(keep)), F.col("text").alias("own_text"))
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return given.mapInArrow(run, f"{schema}, n_bytes bigint, media binary, declared string")


EMBEDDED = "array<struct<kind: string, start: bigint, length: bigint>>"


def corrected(media: DataFrame) -> DataFrame:
    """Adds to rows with ``media`` and ``declared``: ``kind``, the confirmed type of the whole value (else unknown), whether it was ``wrong``, and ``embedded``, where other media are in it.

    A value is of a type if one of that type starts at its first byte.  Embedded media that lie in another one of
    the list are listed as well.  Null media are unknown, with nothing embedded.  Columns of these three names are replaced.
    """
    keep = [c for c in media.columns if c not in ("kind", "wrong", "embedded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            kinds, wrong, embedded = [], [], []
            for media, declared in zip(batch.column("media"), batch.column("declared").to_pylist(), strict=True):
                found = sniff(media.as_py() or b"")
                kinds.append(found[0].kind if found and not found[0].start else UNKNOWN)
                wrong.append(kinds[-1] != declared)
                embedded.append([{"kind": f.kind, "start": f.start, "length": f.length} for f in found if f.start])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds), pa.array(wrong), pa.array(embedded, kind_of)], [*keep, "kind", "wrong", "embedded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*(f"`{c}`" for c in keep)).schema.fields)
    return media.select(*(f"`{c}`" for c in keep)).mapInArrow(run, f"{schema}, kind string, wrong boolean, embedded {EMBEDDED}")


def carved(media: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The media embedded in corrected rows, each with its ``kind``, ``start`` and ``bytes``; of those within one another the outermost, so that no byte is cut out twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                data = batch.column("media")[row].as_py() or b""
                found = outermost([Found(**x) for x in batch.column("embedded")[row].as_py() or []])
                same = pa.array([row] * len(found), pa.int64())
                columns = [*(batch.column(k).take(same) for k in range(len(keep))), pa.array([f.kind for f in found], pa.string()), pa.array([f.start for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([data[f.start : f.start + f.length] for f in found], pa.binary())], [*keep, "kind", "start", "bytes"])

    schema = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)
    return media.select(*(F.col(c).alias(f"own_{k}") for k, c in enumerate(keep)), "media", "embedded").mapInArrow(run, f"{schema}, kind string, start bigint, bytes binary")


def features(media: DataFrame) -> DataFrame:
    """Replaces ``media`` and ``embedded`` by what is read from the stored bytes: the payload's digests and a ``feature`` of the samples.

    The payload is that of the value itself or, if its type is unknown, of the first medium carved out of it.
    """
    keep = [c for c in media.columns if c not in ("media", "declared", "kind", "wrong", "embedded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, kind, inside in zip(batch.column("media"), batch.column("kind").to_pylist(), batch.column("embedded"), strict=True):
                data = value.as_py() or b""
                within = outermost([Found(**x) for x in inside.as_py() or []])
                f = Found(kind, 0, len(data)) if kind != UNKNOWN or not within else within[0]
                rate, payload = samples_of(f.kind, data[f.start : f.start + f.length])
                samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
                level = f"{samples.min(initial=0)}/{samples.max(initial=0)}/{samples.sum()}/{(samples * samples).sum()}/{np.count_nonzero(np.diff(samples >= 0))}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), f"{kind}>{f.kind}@{f.start};{rate}Hz;{level};embedded={len(within)}"))
            columns = [pa.array([row[k] for row in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, *(x.split()[0] for x in OUT)])

    schema = ", ".join(f"`{media.schema[c].name}` {media.schema[c].dataType.simpleString()}" for c in keep)
    return media.mapInArrow(run, ", ".join([schema, *OUT]))


OUT = ("payload_bytes bigint", "payload_sha256 string", "tail_crc32 bigint", "media_bytes bigint", "media_sha256 string", "feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of ``documents`` as media, sniffed, read back and described."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return features(corrected(stored_media(documents)))
