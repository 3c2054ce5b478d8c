"""Token-id shards on disk, with a minimal perfect hash index from document keys to places in the raw ids.

A shard is two files. `.ids` holds raw little-endian ids, 2 bytes each where the vocabulary allows, else 4.
`.index` holds, after a JSON header with the length of each part: the document ids in order and which are null; the
bits of the perfect hash, level by level (Limasset et al., "Fast and scalable minimal perfect hashing for massive key
sets", 2017); and by hash value a fingerprint, the first id and the number of ids.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.shared import new_path, renamed, written
from fieldglass.llm.tokens import encoded, encoder
from fieldglass.llm.words import mix

MAGIC = b"FGSHARD1"
#: Bits for each key that is still without a place.
GAMMA = 2.0
LEVELS = 64
#: A shard ends with the document with which it has so many ids.
SHARD_IDS = 1 << 24
#: Stands for a null id in the ranges of shards.
NO_ID = (1 << 63) - 1


class PerfectHash:
    """key (64-bit, distinct) -> 0 .. n - 1, in about 3.7 bits a key."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [int(x.sum()) for x in levels]
        self.before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.ranks = [np.cumsum(x) - x for x in levels]

    @staticmethod
    def slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """At each level the keys that are alone in their slot stay; the others go on to the next."""
        levels = []
        while len(keys):
            if len(levels) == LEVELS:
                raise ValueError("keys are not distinct")
            size = max(64, int(GAMMA * len(keys)))
            slot = cls.slot(keys, len(levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[slot]]
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 for keys that have no place; other foreign keys get some place, which the fingerprint then refutes."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            slot = self.slot(keys[todo], k, len(bits))
            hit = bits[slot]
            out[todo[hit]] = self.before[k] + self.ranks[k][slot[hit]]
            todo = todo[~hit]
        return out


def shard_keys(ids: np.ndarray, null: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Keys of (document id, its turn among equal ids); distinct for any ids below 2 ** 63."""
    return mix(mix(ids.astype(np.uint64) + (null.astype(np.uint64) << np.uint64(63))) + turn.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def turns(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """0, 1, ... within runs of equal ids."""
    n = np.arange(len(ids))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    return n - np.maximum.accumulate(np.where(new, n, 0)) if len(ids) else n


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x94D049BB133111EB)) >> np.uint64(32)).astype(np.uint32)


def pack_index(ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
    keys = shard_keys(ids, null, turns(ids, null))
    table = PerfectHash.build(keys)
    place = table.find(keys)
    marks, start, size = np.zeros(len(ids), "<u4"), np.zeros(len(ids), "<i8"), np.zeros(len(ids), "<i8")
    marks[place], start[place], size[place] = fingerprints(keys), np.cumsum(lengths) - lengths, lengths
    parts = [ids.astype("<i8").tobytes(), np.packbits(null).tobytes(), *(np.packbits(x).tobytes() for x in table.levels), marks.tobytes(),
        start.tobytes(), size.tobytes()]
    head = json.dumps({"n": len(ids), "width": width, "levels": [len(x) for x in table.levels], "parts": [len(x) for x in parts]}).encode()
    return MAGIC + len(head).to_bytes(8, "little") + head + b"".join(parts)


class Shard:
    """Keyed access to one shard: two probes of the index on average, then one slice of the ids.

    ids gives the bytes from one place to another of the raw ids: a slice of memory, or of an open file.
    """

    def __init__(self, index: bytes, ids: Callable[[int, int], bytes]):
        if index[:8] != MAGIC:
            raise ValueError("not an index of token ids")
        size = int.from_bytes(index[8:16], "little")
        head = json.loads(index[16 : 16 + size])
        at, parts = 16 + size, []
        for n in head["parts"]:
            parts.append(index[at : at + n])
            at += n
        n = head["n"]
        self.doc_ids, self.null = np.frombuffer(parts[0], "<i8"), np.unpackbits(np.frombuffer(parts[1], np.uint8), count=n).astype(bool)
        self.table = PerfectHash(
            [np.unpackbits(np.frombuffer(p, np.uint8), count=m).astype(bool) for p, m in zip(parts[2:-3], head["levels"], strict=True)])
        self.marks, self.start, self.size = np.frombuffer(parts[-3], "<u4"), np.frombuffer(parts[-2], "<i8"), np.frombuffer(parts[-1], "<i8")
        self.ids, self.width = ids, head["width"]

    def find(self, doc_ids: np.ndarray, null: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first id, number of ids) of each key; -1, 0 for keys that aren't in the shard."""
        keys = shard_keys(doc_ids, null, turn)
        place = self.table.find(keys)
        if not len(self.marks):
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        there = (place >= 0) & (self.marks[place] == fingerprints(keys))
        return np.where(there, self.start[place], -1), np.where(there, self.size[place], 0)

    def read(self, start: int, size: int) -> np.ndarray:
        return np.frombuffer(self.ids(start * self.width, (start + size) * self.width), f"<u{self.width}")


def _root(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards in ascending order of document id (nulls first) below folder, which any pyarrow file system can hold.

    Returns their list: part, shard, path, n_docs, n_ids, low, high (the least and greatest id in it; null ids count as
    NO_ID), first (ids in all shards before). A shard ends with the document with which it has SHARD_IDS ids, so that any
    can be read whole, however large the table. Files of a task that was run again have another name and aren't in the
    list. Null and empty texts have end_id alone; repeated ids are told apart by their turn within a shard. An empty table
    gives an empty list.
    """
    fs_root = _root(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(fs_root)
        tool = encoder(tokenizer)
        kind = "<u2" if max(tool.size - 1, end_id) < 1 << 16 else "<u4"
        out, held, n_shard, n_ids = None, [], 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            ids, null, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            with fs.open_output_stream(name + ".index") as f:
                f.write(pack_index(ids, null, lengths, int(kind[-1])))
            keys = np.where(null, NO_ID, ids)
            row = [TaskContext.get().partitionId(), n_shard, name, len(ids), int(lengths.sum()), int(keys.min()), int(keys.max())]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "shard", "path", "n_docs", "n_ids", "low", "high"])

        for batch in batches:
            column = batch.column(0)
            doc_ids, null = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
            for i, ids, offsets in encoded(batch.column(1), tokenizer, end_id):
                a, n = 0, len(offsets) - 1
                while a < n:
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        name, held, n_ids = f"{root}/shard-{uuid.uuid4().hex}", [], 0
                        out = fs.open_output_stream(name + ".ids")
                    b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + SHARD_IDS - n_ids))))
                    out.write(ids[offsets[a] : offsets[b]].astype(kind).tobytes())
                    held.append((doc_ids[i + a : i + b], null[i + a : i + b], np.diff(offsets[a : b + 1])))
                    n_ids, a = n_ids + int(offsets[b] - offsets[a]), b
                    if n_ids >= SHARD_IDS:
                        yield closed()
                        out, n_shard = None, n_shard + 1
        if out is not None:
            yield closed()

    rows = renamed(docs, doc_id=F.col(id_col).cast("long"), text=F.col(text_col), tie=F.xxhash64(F.col(text_col)))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    shards = written(ordered.mapInArrow(run, "part long, shard long, path string, n_docs long, n_ids long, low long, high long"), "shards")
    before = F.sum("n_ids").over(Window.orderBy("part", "shard"))
    return shards.withColumn("first", before - F.col("n_ids"))


def _described(shard: Shard, start: np.ndarray, size: np.ndarray, first: int, doc_ids: np.ndarray, null: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(start), 4096):
        some = slice(a, a + 4096)
        found = [shard.read(s, n) for s, n in zip(start[some].tolist(), size[some].tolist(), strict=True)]
        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in found]
        heads = pa.array([x[:8].tolist() for x in found], pa.list_(pa.int32()))
        columns = [pa.array(doc_ids[some], mask=null[some]), pa.array(start[some] + first), pa.array(size[some]), pa.array(crc, pa.int64()), heads]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids_head"])


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """One row for each document, by keyed access: doc_id, start, n_tokens, ids_crc32, ids_head (its first 8 ids)."""
    fs_root = _root(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(fs_root)
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(path + ".index") as index, fs.open_input_stream(path + ".ids") as ids:
                    raw = ids.read()
                    shard = Shard(index.read(), lambda a, b, raw=raw: raw[a:b])
                start, size = shard.find(shard.doc_ids, shard.null, turns(shard.doc_ids, shard.null))
                if (start < 0).any():
                    raise ValueError(f"{path}: a document's fingerprint doesn't match")
                yield from _described(shard, start, size, first, shard.doc_ids, shard.null)

    spread = shards.select("path", "first").repartition(max(1, shards.count()))
    return spread.mapInArrow(run, _FOUND)


def find_documents(shards: DataFrame, folder: str, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows like read_shards's for the documents whose ids keys names; several where an id is repeated, none where it is unknown.

    Each key is sent only to the shards whose range of ids holds it. There the index gives its place in two probes on
    average, and of the raw ids that slice alone is read. Ranges are met by equal cells of the id space, about two for
    each shard, so nothing is broadcast and no key meets all shards. Repeated keys are asked for once; null asks for the
    rows without an id. Without shards or keys the result is empty.
    """
    fs_root = _root(folder)
    bounds = shards.agg(F.min("low").alias("a"), F.max(F.when(F.col("high") < NO_ID, F.col("high"))).alias("b"), F.count("*").alias("n")).first()
    least, most = min(bounds["a"] or 0, bounds["b"] or 0), bounds["b"] or 0
    width = max(1, -(-(most - least + 1) // max(1, bounds["n"])))
    # Rows without an id have a cell of their own.
    cell = lambda x: F.expr(f"if({x} = {NO_ID}L, -1L, (least(greatest({x}, {least}L), {most}L) - ({least}L)) div {width}L)")
    wanted = keys.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key")).distinct().withColumn("cell", cell("key"))
    none = F.array().cast("array<long>")
    cells = F.concat(
        F.when(F.col("low") < NO_ID, F.sequence(cell("low"), cell(f"least(high, {most}L)"))).otherwise(none),
        F.when(F.col("high") == NO_ID, F.array(F.lit(-1).cast("long"))).otherwise(none),
    )
    spread = shards.select("path", "first", "low", "high", F.explode(cells).alias("cell"))
    met = wanted.join(spread, "cell").filter(F.col("key").between(F.col("low"), F.col("high")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(fs_root)
        open_ = None
        for batch in batches:
            paths, firsts, asked = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            new = [k for k in range(len(paths)) if not k or paths[k] != paths[k - 1]]
            for a, b in zip(new, [*new[1:], len(paths)], strict=True):
                if open_ is None or open_[0] != paths[a]:
                    with fs.open_input_stream(paths[a] + ".index") as index:
                        source = fs.open_input_file(paths[a] + ".ids")
                        open_ = paths[a], Shard(index.read(), lambda x, y, f=source: f.read_at(y - x, x))
                shard, ids = open_[1], asked[a:b]
                turn = 0
                while len(ids):
                    null = ids == NO_ID
                    start, size = shard.find(np.where(null, 0, ids), null, np.full(len(ids), turn))
                    there = start >= 0
                    ids, null, turn = ids[there], null[there], turn + 1
                    yield from _described(shard, start[there], size[there], firsts[a], ids, null)

    parted = met.select("path", "first", "key").repartition("path").sortWithinPartitions("path", "key")
    return parted.mapInArrow(run, _FOUND)


_FOUND = "doc_id long, start long, n_tokens long, ids_crc32 long, ids_head array<int>"


def token_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, id_col: str = "doc_id",
    text_col: str = "text") -> DataFrame:
    """write_shards, then read_shards; the folder is a new one in the shared folder unless it is given."""
    folder = folder or new_path(docs.sparkSession, "token_shards")
    return read_shards(write_shards(docs, folder, tokenizer, end_id, id_col, text_col), folder)
