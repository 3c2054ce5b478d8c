"""Packing by minimum bin slack: windows are filled by subset sums over the counts of remaining lengths."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.shared import renamed, written
from fieldglass.llm.tokens import encoded

CAPACITY = 4096
#: Rows of one length that are numbered in one task, at least.
BUCKET_ROWS = 200


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length): whole windows, then the rest; a rest of over half a window is cut there, so that any two fit."""
    full, rest = divmod(n, capacity)
    out = [(k * capacity, capacity) for k in range(full)]
    if rest > capacity // 2:
        out.append((full * capacity, capacity // 2))
        rest -= capacity // 2
    if rest:
        out.append((n - rest, rest))
    return out


def best_fill(counts: Mapping[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How many of each length (descending, with positive counts) fill most of `room`; lengths that stand first are preferred.

    Bit s of `reach` says that some of the lengths so far sum to s; each length's count enters in powers of two.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int]] = []
    for length in lengths:
        n = min(counts[length], room // length)
        if not n:
            continue
        steps.append((length, reach))
        k = 1
        while n:
            take = min(k, n)
            reach |= (reach << (take * length)) & mask
            n, k = n - take, 2 * k
        if reach >> room & 1:
            break
    rest, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> rest & 1:
            rest, n = rest - length, n + 1
        if n:
            chosen[length] = n
    return chosen


def plan_windows(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(how many of each length a window takes, number of such windows)], using up the histogram.

    Each window is begun with the longest piece left and filled by best_fill; the pattern is used as often as the counts
    allow. After that some length has fewer pieces left than the pattern takes, so there are at most
    sum(capacity / length) patterns, however many pieces there are.
    """
    left = {length: n for length, n in histogram.items() if n}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError("a piece is longer than a window, or empty")
    order, plan = sorted(left, reverse=True), []
    while order:
        seed = order[0]
        left[seed] -= 1
        chosen = best_fill(left, [x for x in order if x <= capacity - seed], capacity - seed)
        left[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(left[length] // n for length, n in chosen.items())
        for length, n in chosen.items():
            left[length] -= n * times
        order = [x for x in order if left[x]]
        plan.append((dict(sorted(chosen.items(), reverse=True)), times))
    return plan


def slots_of(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, n in a window, first window, offset in it), ordered by length and rank."""
    used: dict[int, int] = {}
    rows, window = [], 0
    for pattern, times in plan:
        offset = 0
        for length, n in pattern.items():
            rows.append((length, used.get(length, 0), n, window, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        window += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def tokenised_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_of = batch.column(0)
            rows: list[tuple[int, int, int, int, int]] = []
            for first, ids, offsets in encoded(batch.column(1), tokenizer, end_id):
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                ends = offsets.tolist()
                for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                    for start, length in pieces_of(b - a, capacity):
                        rows.append((first + k, start, length, zlib.crc32(raw[4 * (a + start) : 4 * (a + start + length)]), b - a))
            flat = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([ids_of.take(pa.array(flat[:, 0])), *(pa.array(flat[:, k]) for k in range(1, 5))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids by the tokenizer file and then end_id; null and empty texts are end_id alone. It is cut into
    windows of `capacity` and a rest (pieces_of). The driver gets the number of pieces of each length, at most `capacity`
    rows, and plans which lengths fill a window; the plan is as small whatever the input. Pieces are numbered within their
    length and so find their window. Sequences are numbered from 0 and filled without gaps; the pieces of a document may lie in
    different ones. A sequence that isn't full is to be padded, unless its length is a power of two. Ids may be null or
    repeated (each row is a document of its own); other columns are ignored; an empty table gives an empty result.

    A length that many pieces share is numbered in buckets, about the square root of its pieces each.
    """
    pieces = written(tokenised_pieces(renamed(docs, doc_id=F.col(id_col).cast("long"), text=F.col(text_col)), tokenizer, end_id, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = slots_of(plan_windows(histogram, capacity))
    buckets = [1] * (capacity + 1)
    for length, n in histogram.items():
        buckets[length] = math.ceil(n / max(BUCKET_ROWS, math.isqrt(n)))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.get(F.lit(buckets), F.col("length").cast("int"))))
    sums = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket")
    bases = sums.select("length", "_bucket", (F.sum("_n").over(before) - F.col("_n")).alias("_base"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1).join(bases, ["length", "_bucket"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    places = slots[:, 0] << 48 | slots[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (2, 5))
            slot = slots[np.searchsorted(places, length << 48 | rank, "right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            turn = rank - slot[:, 1]
            sequence, offset = slot[:, 3] + turn // slot[:, 2], slot[:, 4] + turn % slot[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    numbered = ranked.select(*columns, (F.col("_base") + F.col("_rank")).alias("rank"))
    return numbered.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
