"""Media columns: signatures found by Aho-Corasick, confirmed by format validators; embedded media are carved."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from fieldglass.llm import words as W
from fieldglass.llm.shared import renamed, written

UNKNOWN = "application/octet-stream"
#: What the documents table says that its texts are.
TEXT = "text/plain"
#: Bytes of a payload come in multiples of this.
BLOCK = 64
RATE = 8000


def wav_bytes(payload: bytes, rate: int = RATE) -> bytes:
    """One channel of unsigned 8-bit samples, each a byte of the payload."""
    n = len(payload)
    head = b"RIFF" + (36 + n + n % 2).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little")
    form = b"".join(x.to_bytes(k, "little") for x, k in ((1, 2), (1, 2), (rate, 4), (rate, 4), (1, 2), (8, 2)))
    return head + form + b"data" + n.to_bytes(4, "little") + payload + b"\0" * (n % 2)


def wav_chunks(data: bytes, at: int = 0) -> dict[bytes, tuple[int, int]] | None:
    """(start, length) of each chunk of a RIFF WAVE file at `at`; None if its structure or lengths don't hold."""
    if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    if end > len(data):
        return None
    place, found = at + 12, {}
    while place + 8 <= end:
        n = int.from_bytes(data[place + 4 : place + 8], "little")
        if place + 8 + n > end:
            return None
        found.setdefault(data[place : place + 4], (place + 8, n))
        place += 8 + n + n % 2
    return found if place == end and b"data" in found and found.get(b"fmt ", (0, 0))[1] >= 16 else None


class Marks:
    """What validators look for far ahead, found once for all of a text's magic bytes."""

    def __init__(self, data: bytes):
        self.data, self.found, self.streams = data, {}, {}

    def after(self, place: int, *mark: int) -> int:
        """Where the bytes of mark stand next, from place on; -1 if nowhere."""
        if mark not in self.found:
            raw = np.frombuffer(self.data, np.uint8)
            there = np.ones(max(0, len(raw) - len(mark) + 1), bool)
            for k, value in enumerate(mark):
                there &= raw[k : k + len(there)] == value
            self.found[mark] = np.flatnonzero(there)
        k = int(np.searchsorted(self.found[mark], place))
        return int(self.found[mark][k]) if k < len(self.found[mark]) else -1

    def inflated(self, place: int) -> tuple[int, int, int] | None:
        """(end, CRC-32, length) of the deflate stream that begins at place."""
        if place not in self.streams:
            tool, at, step, crc, size = zlib.decompressobj(-15), place, 64, 0, 0
            try:
                # Steps grow, so that bytes that are no such stream are given up after a few.
                while not tool.eof and at < len(self.data):
                    part = tool.decompress(self.data[at : at + step], 1 << 20)
                    at, step = at + step, min(2 * step, 1 << 16)
                    while part:
                        crc, size = zlib.crc32(part, crc), size + len(part)
                        part = tool.decompress(tool.unconsumed_tail, 1 << 20) if tool.unconsumed_tail and not tool.eof else b""
            except zlib.error:
                pass
            self.streams[place] = (min(at, len(self.data)) - len(tool.unused_data), crc, size) if tool.eof else None
        return self.streams[place]


def wav_length(data: bytes, at: int, marks: Marks) -> int | None:
    return 8 + int.from_bytes(data[at + 4 : at + 8], "little") if wav_chunks(data, at) else None


def png_length(data: bytes, at: int, marks: Marks) -> int | None:
    place, kinds = at + 8, []
    while place + 12 <= len(data):
        n, kind = int.from_bytes(data[place : place + 4], "big"), data[place + 4 : place + 8]
        stop = place + 12 + n
        if stop > len(data) or zlib.crc32(data[place + 4 : stop - 4]) != int.from_bytes(data[stop - 4 : stop], "big"):
            return None
        kinds.append(kind)
        place = stop
        if kind == b"IEND":
            return place - at if kinds[0] == b"IHDR" and b"IDAT" in kinds else None
    return None


def gif_length(data: bytes, at: int, marks: Marks) -> int | None:
    def blocks(place: int) -> int | None:
        while place < len(data):
            n = data[place]
            place += 1 + n
            if not n:
                return place
        return None

    if at + 13 > len(data):
        return None
    flags = data[at + 10]
    place: int | None = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    images = 0
    while place is not None and place < len(data):
        mark = data[place]
        if mark == 0x3B:
            return place + 1 - at if images else None
        if mark == 0x21:
            place = blocks(place + 2)
        elif mark == 0x2C and place + 10 <= len(data):
            flags = data[place + 9]
            place = blocks(place + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
            images += 1
        else:
            return None
    return None


def jpeg_length(data: bytes, at: int, marks: Marks) -> int | None:
    place = at + 2
    while place + 4 <= len(data) and data[place] == 0xFF:
        kind, n = data[place + 1], int.from_bytes(data[place + 2 : place + 4], "big")
        if kind < 0xC0 or n < 2 or place + 2 + n > len(data):
            return None
        place += 2 + n
        if kind == 0xDA:
            end = marks.after(place, 0xFF, 0xD9)
            return end + 2 - at if end >= 0 else None
    return None


def bmp_length(data: bytes, at: int, marks: Marks) -> int | None:
    n, first, head = (int.from_bytes(data[at + a : at + a + 4], "little") for a in (2, 10, 14))
    right = data[at + 6 : at + 10] == b"\0\0\0\0" and head in (12, 40, 52, 56, 108, 124) and 14 + head <= first < n <= len(data) - at
    return n if right else None


def gzip_length(data: bytes, at: int, marks: Marks) -> int | None:
    if at + 18 > len(data) or data[at + 3] & 0xE0:
        return None
    flags, place = data[at + 3], at + 10
    if flags & 4:
        place += 2 + int.from_bytes(data[place : place + 2], "little")
    for named in (8, 16):
        if flags & named:
            end = marks.after(place, 0)
            if end < 0:
                return None
            place = end + 1
    stream = marks.inflated(place + (2 if flags & 2 else 0))
    if not stream or data[stream[0] : stream[0] + 8] != stream[1].to_bytes(4, "little") + (stream[2] & 0xFFFFFFFF).to_bytes(4, "little"):
        return None
    return stream[0] + 8 - at


def pdf_length(data: bytes, at: int, marks: Marks) -> int | None:
    """Up to the last end mark before the next file's beginning, if a cross-reference offset stands before it."""
    following = data.find(b"%PDF-", at + 5)
    end = data.rfind(b"%%EOF", at, following if following >= 0 else len(data))
    return end + 5 - at if end >= 0 and data.rfind(b"startxref", at, end) >= 0 else None


#: Magic bytes and the validators of what begins with them. Fixed values.
SIGNATURES: tuple[tuple[bytes, str, Callable[[bytes, int, Marks], int | None]], ...] = (
    (b"RIFF", "audio/wav", wav_length),
    (b"\x89PNG\r\n\x1a\n", "image/png", png_length),
    (b"GIF87a", "image/gif", gif_length),
    (b"GIF89a", "image/gif", gif_length),
    (b"\xff\xd8\xff", "image/jpeg", jpeg_length),
    (b"BM", "image/bmp", bmp_length),
    (b"\x1f\x8b\x08", "application/gzip", gzip_length),
    (b"%PDF-", "application/pdf", pdf_length),
)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    tool = ahocorasick.Automaton()
    for magic, kind, check in SIGNATURES:
        tool.add_word(magic.decode("latin-1"), (len(magic), kind, check))
    tool.make_automaton()
    return tool


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the media in data, from its beginning on; media inside found media are not listed."""
    found, free = [], 0
    marks = Marks(data)
    for end, (n, kind, check) in _automaton().iter(data.decode("latin-1")):
        at = end + 1 - n
        if at < free:
            continue
        if length := check(data, at, marks):
            found.append((kind, at, length))
            free = at + length
    return found


def inspected(data: bytes) -> tuple[str, list[dict]]:
    """The type of media that begin at the first byte, else UNKNOWN; and those that begin later, carved out."""
    found = sniff(data)
    parts = [{"type": k, "offset": a, "length": n, "data": data[a : a + n]} for k, a, n in found if a]
    return found[0][0] if found and not found[0][1] else UNKNOWN, parts


def media_columns(
    media: DataFrame,
    id_col: str = "id",
    data_col: str = "data",
    type_col: str = "declared",
    keep: Sequence[str] = (),
    features: tuple[str, Callable[[bytes, str], tuple]] | None = None,
) -> DataFrame:
    """One row for every input row: id, declared, type, corrected, embedded (type, offset, length, data of each carved part).

    type is that of media that begin at the first byte, else UNKNOWN; corrected says that it differs from the declared
    one. Media that begin later are carved. `keep` names columns that are passed on as they are; `features` is a schema and
    a function of (data, type) that gives the values of these columns, which stand last. Null data count as empty: UNKNOWN,
    nothing embedded. Any id, null or repeated, is passed on; other columns are ignored; an empty table gives an empty result.
    """
    part = "array<struct<type:string,offset:long,length:long,data:binary>>"
    schema = [f"id {media.schema[id_col].dataType.simpleString()}, declared string, type string, corrected boolean, embedded {part}"]
    schema += [f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep] + ([features[0]] if features else [])
    rows = media.select(F.col(id_col), F.col(type_col).cast("string"), F.col(data_col), *keep).toDF("id", "declared", "data",
        *(f"k{n}" for n in range(len(keep))))
    told = StructType.fromDDL(features[0]) if features else StructType()
    names = ["id", "declared", "type", "corrected", "embedded", *keep, *told.names]
    kinds = [to_arrow_type(f.dataType) for f in told.fields]
    parts_kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("data", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types, wrong, inside, more = [], [], [], []
            for value, declared in zip(batch.column(2), batch.column(1).to_pylist(), strict=True):
                data = value.as_py() or b""
                kind, parts = inspected(data)
                types.append(kind)
                wrong.append(kind != declared)
                inside.append(parts)
                if features:
                    more.append(features[1](data, kind))
            columns = [pa.array(types, pa.string()), pa.array(wrong, pa.bool_()), pa.array(inside, parts_kind), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns, *(pa.array([r[k] for r in more], kind) for k, kind in enumerate(kinds))],
                names)

    return rows.mapInArrow(run, ", ".join(schema))


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, declared, media: each text's UTF-8 bytes, filled up with zeros to a positive multiple of BLOCK, as a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.texts(batch.column(1))
            for i, j in W.chunks(at, 8 << 20):
                raw = [data[a:b].tobytes() for a, b in zip(at[i:j].tolist(), at[i + 1 : j + 1].tolist(), strict=True)]
                media = [wav_bytes(x.ljust(max(BLOCK, -len(x) % BLOCK + len(x)), b"\0")) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())],
                    ["doc_id", "n_bytes", "media"])

    rows = renamed(docs, doc_id=F.col(id_col).cast("long"), text=F.col(text_col))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary").withColumn("declared", F.lit(TEXT))


def describe(kind: str, samples: np.ndarray, embedded: list[dict]) -> str:
    """Whole-number features of 8-bit samples, so that equal samples have equal features anywhere."""
    n = max(1, len(samples))
    wide = samples.astype(np.int64)
    turns = int(np.count_nonzero(np.diff(samples >= 128)))
    parts = ",".join(f"{p['type']}@{p['offset']}+{p['length']}" for p in embedded)
    return f"{kind};channels=1;bits=8;samples={len(samples)};mean={int(wide.sum()) // n};power={int((wide * wide).sum()) // n};low={int(wide.min(initial=255))};high={int(wide.max(initial=0))};turns={turns};embedded={len(embedded)}[{parts}]"


def _stored_features(data: bytes, kind: str) -> tuple:
    chunks = wav_chunks(data) if kind == "audio/wav" else None
    if chunks is None or 8 + int.from_bytes(data[4:8], "little") != len(data):
        raise ValueError("stored media are damaged")
    start, n = chunks[b"data"]
    payload = data[start : start + n]
    parts = [{"type": k, "offset": a, "length": m, "data": payload[a : a + m]} for k, a, m in sniff(payload)]
    digests = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest()
    return n, *digests, describe(kind, np.frombuffer(payload, np.uint8), parts), parts


def media_features(media: DataFrame) -> DataFrame:
    """From stored_texts: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, type, corrected, carved.

    The stored bytes go through media_columns, which finds their type, whatever was declared. carved lists media that the
    payload itself holds, at their places in it. Stored media that aren't WAV, or aren't as long as their structure says,
    fail the query.
    """
    digests = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    features = f"{digests}, carved array<struct<type:string,offset:long,length:long,data:binary>>", _stored_features
    told = media_columns(media, "doc_id", "media", "declared", keep=["n_bytes"], features=features)
    return told.withColumnRenamed("id", "doc_id").drop("declared", "embedded")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media in the shared folder, read the files back and describe them; one row for every input row.

    Null counts as empty; ids may be null or repeated; other columns are ignored; an empty table gives an empty result.
    """
    return media_features(written(stored_texts(docs, id_col, text_col), "media"))
