"""Passages that repeat within and across documents, by a sparse suffix array at minimiser positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm import words as W
from fieldglass.llm.shared import BROADCAST_ROWS, lookup, renamed, written

#: A passage counts from so many words on.
LEAST_WORDS = 50
#: Words hashed at a position, and how many positions in a row have at least one that is kept.
GRAM = 16
SPREAD = LEAST_WORDS - GRAM + 1
#: Words to either side of a gram that a passage of LEAST_WORDS around it can have.
SIDE = LEAST_WORDS - GRAM
#: Suffixes of one gram, or copies of one window, that one task sorts. Windows around a gram that has more are dealt by
#: their own hash instead, and of those the ones that stand more often are counted over all tasks.
GROUP = 512
#: Windows of common grams that one task reads out of its texts, about.
TASK_WINDOWS = 50_000
#: Windows that go to one bucket by their hash, at most about.
BUCKET_WINDOWS = 25_000
#: Stands for a null id, which is larger than any other.
NO_ID = (1 << 63) - 1


def least_places(h: np.ndarray) -> np.ndarray:
    """For every SPREAD hashes in a row the position of the least, the last of equal ones; never decreasing."""
    if len(h) < SPREAD:
        return np.zeros(0, np.int64)
    # Least of each SPREAD in a row by doubling: windows of 1, 2, 4, ... that overlap. Ties go to the later position.
    at = np.arange(len(h))
    size = 1
    while size < SPREAD:
        step = min(size, SPREAD - size)
        a, b = at[:-step], at[step:]
        at = np.where(h[b] <= h[a], b, a)
        size += step
    return at


class Words:
    """The hashed words of some texts in a row, their grams, and the windows of LEAST_WORDS words by their minimiser.

    first[k] is the first word of text k. place holds the kept positions in order; window k of those that lie within a
    text starts at start[k]; the windows of place[i] are those from begin[i] to begin[i + 1].
    """

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.hash, _, _, self.first = W.word_hashes(data, at)
        self.gram = W.windows(self.hash, GRAM, 6)
        text = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        self.start = np.flatnonzero(np.arange(len(self.hash)) + LEAST_WORDS <= self.first[1:][text])
        least = least_places(self.gram)[self.start]
        new = np.flatnonzero(np.diff(least, prepend=-1))
        self.place, self.begin = least[new], np.append(new, len(least))
        self.text = text[self.place]


def gathered(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... size[0] of them, then those of begin[1] and so on."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def fixed(rows: np.ndarray) -> pa.Array:
    """A binary array of the rows of a matrix of bytes."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def anchored(docs: DataFrame) -> DataFrame:
    """(id, key, text) -> id, key, n_words, and the hashes and positions of the grams kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.texts(batch.column(2))
            n, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            found, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, j in W.chunks(at):
                x = Words(data[at[i] : at[j]], at[i : j + 1] - at[i])
                n.append(np.diff(x.first))
                sizes.append(np.bincount(x.text, minlength=j - i))
                found.append(x.gram[x.place])
                places.append(x.place - x.first[x.text])
            ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v))
                for v in (np.concatenate(found).view(np.int64), np.concatenate(places).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.concatenate(n)), *lists], ["id", "key", "n_words", "grams", "places"])

    return docs.mapInArrow(run, "id long, key binary, n_words long, grams array<long>, places array<int>")


def _marked_places(batch: pa.RecordBatch, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, position) of the listed places of rows i to j; column 3 holds them."""
    lists = batch.column(3).slice(i, j - i)
    return np.repeat(np.arange(j - i), lists.value_lengths().to_numpy()), lists.flatten().to_numpy().astype(np.int64)


def suffixes(texts: DataFrame) -> DataFrame:
    """(id, key, text, places) -> a row for each place: its gram, its context to the right and to the left as a byte for each of
    SIDE words, and of the windows whose minimiser it is the hashes, and how far before the place the first one starts.

    Context past an end of the text is 0. It serves to sort suffixes and to rule out; windows are compared by their hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.texts(batch.column(2))
            for i, j in W.chunks(at):
                x = Words(data[at[i] : at[j]], at[i : j + 1] - at[i])
                text, own = _marked_places(batch, i, j)
                if not len(own):
                    continue
                a, b = x.first[text], x.first[text + 1]
                place = a + own
                number = np.searchsorted(x.place, place)
                begin, size = x.begin[number], x.begin[number + 1] - x.begin[number]
                short, whole = (x.hash >> np.uint64(56)).astype(np.uint8), W.windows(x.hash, LEAST_WORDS, 7)
                take = lambda where, ok: np.where(ok, short[np.clip(where, 0, len(short) - 1)], np.uint8(0))
                right, left = place[:, None] + GRAM + np.arange(SIDE), place[:, None] - 1 - np.arange(SIDE)
                hashes = np.ascontiguousarray(whole[x.start[gathered(begin, size)]])
                ends = np.concatenate([[0], np.cumsum(size * 8)]).astype(np.int32)
                rows = pa.array(i + text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(x.gram[place].view(np.int64)), fixed(take(right, right < b[:, None])), fixed(take(left, left >= a[:, None])),
                        pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(hashes)]),
                        pa.array((place - x.start[begin]).astype(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows),
                        pa.array(own.astype(np.int32)),
                    ],
                    ["gram", "right", "left", "windows", "before", "id", "key", "place"],
                )

    return texts.mapInArrow(run, "gram long, right binary, left binary, windows binary, before int, id long, key binary, place int")


def _reach(gram: np.ndarray, context: np.ndarray) -> np.ndarray:
    """How many words each suffix has in common with a neighbour, where rows are in order of gram and context."""
    same = np.logical_and.accumulate(context[1:] == context[:-1], axis=1).sum(axis=1)
    same = np.concatenate([[-1], np.where(gram[1:] == gram[:-1], same, -1), [-1]])
    return np.maximum(same[1:], same[:-1])


def _matched(table: pa.RecordBatch) -> pa.RecordBatch | None:
    """All suffixes of some grams, sorted by gram and context to the right -> key, start, end, other, first."""
    gram, before, ids, place = (table.column(k).to_numpy() for k in (0, 4, 5, 7))
    right, left = (W.texts(table.column(k))[0].reshape(len(gram), SIDE) for k in (1, 2))
    key = W.texts(table.column(6))[0].reshape(len(gram), 16)
    raw, ends = W.texts(table.column(3))
    hashes, begin, size = np.frombuffer(raw.tobytes(), np.uint64), ends[:-1] // 8, np.diff(ends) // 8
    # How far each suffix agrees with its neighbours to the right, and in the order of what stands to the left, to the left.
    ahead = _reach(gram, right)
    padded = np.zeros((len(gram), 40), np.uint8)
    padded[:, :SIDE] = left
    order = np.lexsort((*padded.view(">u8").T[::-1], gram))
    behind = np.empty(len(gram), np.int64)
    behind[order] = _reach(gram[order], left[order])
    # Windows within that reach, those of the least text first.
    some = np.flatnonzero(ahead + behind >= SIDE)
    some = some[np.lexsort((place[some], *key[some].view(">u8").T[::-1], ids[some]))]
    row = np.repeat(some, size[some])
    which = gathered(np.zeros(len(some), np.int64), size[some])
    shift = before[row] - which
    ok = (shift <= behind[row]) & (SIDE - shift <= ahead[row])
    row, shift, found = row[ok], shift[ok], hashes[(begin[row] + which)[ok]]
    if not len(row):
        return None
    # Equal windows; they are in the order of their texts.
    order = np.argsort(found, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = (found[order][1:] != found[order][:-1]) | (gram[row[order]][1:] != gram[row[order]][:-1])
    at = np.flatnonzero(new)
    times = np.diff(at, append=len(order))
    own, least, most = ids[row[order]], np.repeat(ids[row[order[at]]], times), np.repeat(ids[row[order[at + times - 1]]], times)
    other, first, twice = (np.empty(len(order), x) for x in (np.int64, bool, bool))
    other[order] = np.where(least != own, least, np.where(most != own, most, NO_ID))
    first[order], twice[order] = new, np.repeat(times > 1, times)
    row, start, other, first = row[twice], (place[row] - shift)[twice], other[twice], first[twice]
    if not len(row):
        return None
    return _joined(table.column(6), row, start, other, first)


_SPAN = ["key", "start", "end", "other", "first"]
_SPANS = "key binary, start int, end int, other long, first boolean"


def _by_group(batches: Iterator[pa.RecordBatch], work: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """work(rows) for rows sorted by their first column, never with a part of the rows that have one value."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = pc.equal(batch.column(0), batch.column(0)[-1])
        done = pc.index(last, True).as_py()
        if done or (held and held[-1].column(0)[-1] != batch.column(0)[-1]):
            if found := work(pa.concat_batches([*held, batch.slice(0, done)])):
                yield found
            held = []
        held.append(batch.slice(done))
    if held and (found := work(pa.concat_batches(held))):
        yield found


def compared(ordered: DataFrame) -> DataFrame:
    """Suffixes sorted by gram and context, all of a gram in one partition -> spans of windows that stand twice."""
    return ordered.mapInArrow(lambda batches: _by_group(batches, _matched), _SPANS)


class _Common:
    """The windows of some rows (id, key, text, places) whose minimiser is one of the places, in order of text and start."""

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray, i: int, j: int):
        x = Words(data[at[i] : at[j]], at[i : j + 1] - at[i])
        text, own = _marked_places(batch, i, j)
        number = np.sort(np.searchsorted(x.place, x.first[text] + own))
        size = x.begin[number + 1] - x.begin[number]
        start = x.start[gathered(x.begin[number], size)]
        self.gram, self.hash = np.repeat(x.gram[x.place[number]], size), W.windows(x.hash, LEAST_WORDS, 7)[start]
        text = np.repeat(x.text[number], size)
        self.row, self.start = i + text, start - x.first[text]


def common_windows(texts: DataFrame) -> DataFrame:
    """(id, key, text, places) -> a row for each window whose minimiser is one of the places: hash (with the gram's), id, key, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.texts(batch.column(2))
            for i, j in W.chunks(at):
                x = _Common(batch, data, at, i, j)
                rows = pa.array(x.row)
                pair = np.stack([x.gram, x.hash], axis=1).view(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [fixed(pair), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(x.start.astype(np.int32))],
                    ["hash", "id", "key", "start"])

    return texts.mapInArrow(run, "hash binary, id long, key binary, start int")


#: A window where it stands, or equal ones: how many, where the least stands by id, key and start, and the greatest id.
_WINDOW = np.dtype([("gram", "u8"), ("hash", "u8"), ("id", "i8"), ("key", ">u8", 2), ("start", "i4"), ("n", "i8"), ("most", "i8")])


def _in_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows by their hashes, equal ones by where they stand, and where those of each hash begin."""
    x = x[np.lexsort((x["start"], x["key"][:, 1], x["key"][:, 0], x["id"], x["hash"], x["gram"]))]
    new = np.ones(len(x), bool)
    new[1:] = (x["gram"][1:] != x["gram"][:-1]) | (x["hash"][1:] != x["hash"][:-1])
    return x, np.flatnonzero(new)


def _once(x: np.ndarray) -> np.ndarray:
    """Equal windows as one."""
    x, at = _in_order(x)
    out = x[at]
    if len(at):
        out["n"], out["most"] = np.add.reduceat(x["n"], at), np.maximum.reduceat(x["most"], at)
    return out


def dealt_windows(texts: DataFrame, buckets: int, once: bool, heavy: Heavy | None = None) -> DataFrame:
    """(id, key, text, places) -> the windows whose minimiser is one of the places, but the heavy ones, in buckets by their hash:
    bucket, windows. Rows are blocks of what a task has for a bucket, `once` with equal windows as one."""

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        # Without the type, NumPy would make it one of native byte order.
        x = np.concatenate(held, dtype=_WINDOW)
        x = _once(x) if once else x
        bucket = (((x["hash"] ^ x["gram"] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        own, at = np.unique(bucket[order], return_index=True)
        ends = np.append(at, len(x)).astype(np.int64) * _WINDOW.itemsize
        blocks = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(x[order].tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), blocks], ["bucket", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, at = W.texts(batch.column(2))
            keys, ids = W.texts(batch.column(1))[0].view(">u8").reshape(-1, 2), batch.column(0).to_numpy()
            for i, j in W.chunks(at):
                x = _Common(batch, data, at, i, j)
                some = np.flatnonzero(heavy.find(x) < 0) if heavy else np.arange(len(x.row))
                rows = np.empty(len(some), _WINDOW)
                rows["gram"], rows["hash"], rows["start"], rows["n"] = x.gram[some], x.hash[some], x.start[some], 1
                rows["id"], rows["key"] = ids[x.row[some]], keys[x.row[some]]
                rows["most"] = rows["id"]
                held.append(rows)
                size += len(rows)
                if size >= 2 * TASK_WINDOWS:
                    yield dealt(held)
                    held, size = [], 0
        if size:
            yield dealt(held)

    blocks = texts.mapInArrow(run, "bucket long, windows binary")
    return blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def _windows_of(table: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(W.texts(table.column(1))[0].tobytes(), _WINDOW)


def _keys_of(x: np.ndarray) -> pa.Array:
    return fixed(np.ascontiguousarray(x["key"]).view(np.uint8).reshape(len(x), 16))


def _frequent(table: pa.RecordBatch, most: int) -> pa.RecordBatch | None:
    """All windows of a bucket -> those that stand more than `most` times."""
    x = _once(_windows_of(table))
    x = x[x["n"] > most]
    if not len(x):
        return None
    pair = np.stack([x["gram"], x["hash"]], axis=1).view(np.uint8)
    columns = [fixed(pair), pa.array(x["n"].copy()), pa.array(x["id"].copy()), _keys_of(x), pa.array(x["start"].copy()), pa.array(x["most"].copy())]
    return pa.RecordBatch.from_arrays(columns, ["hash", "n", "id", "key", "start", "most"])


class Heavy:
    """Windows that stand more than GROUP times, where there are few of them: where each stands first, and the greatest id."""

    def __init__(self, rows: list):
        self.known = W.Numbering(2)
        self.known.add(*np.frombuffer(b"".join(r["hash"] for r in rows), np.uint64).reshape(-1, 2).T.copy())
        self.id, self.most = (np.array([x(r) for r in rows], np.int64) for x in (lambda r: r["least"]["id"], lambda r: r["most"]))
        self.start = np.array([r["least"]["start"] for r in rows], np.int64)
        self.key = np.frombuffer(b"".join(r["least"]["key"] for r in rows), np.uint64).reshape(-1, 2)

    def find(self, x: _Common) -> np.ndarray:
        return self.known.find(x.gram, x.hash)

    def spans(self, texts: DataFrame) -> DataFrame:
        """Spans of these windows; those of a text that follow each other are one row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, at = W.texts(batch.column(2))
                keys, ids = W.texts(batch.column(1))[0].view(np.uint64).reshape(-1, 2), batch.column(0).to_numpy()
                for i, j in W.chunks(at):
                    x = _Common(batch, data, at, i, j)
                    number = self.find(x)
                    some = np.flatnonzero(number >= 0)
                    if not len(some):
                        continue
                    number, row, start = number[some], x.row[some], x.start[some]
                    first = (self.start[number] == start) & (self.key[number] == keys[row]).all(axis=1)
                    least, most, own = self.id[number], self.most[number], ids[row]
                    yield _joined(batch.column(1), row, start, np.where(least != own, least, np.where(most != own, most, NO_ID)), first)

        return texts.mapInArrow(run, _SPANS)


def _joined(keys: pa.Array, row: np.ndarray, start: np.ndarray, other: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """Windows in order of row and start -> spans, in which those that follow each other are one."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1) | (first[1:] != first[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1
    columns = [keys.take(pa.array(row[at])), pa.array(start[at].astype(np.int32)), pa.array((start[last] + LEAST_WORDS).astype(np.int32))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.minimum.reduceat(other, at)), pa.array(first[at])], _SPAN)


def _equal_rows(table: pa.RecordBatch) -> pa.RecordBatch | None:
    """All windows of some hashes, sorted by hash, id, key and start -> spans of those that stand twice."""
    pair = W.texts(table.column(0))[0].view(np.uint64).reshape(-1, 2)
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    times = np.diff(at, append=len(pair))
    ids, start = table.column(1).to_numpy(), table.column(3).to_numpy()
    least, most, twice = np.repeat(ids[at], times), np.repeat(ids[at + times - 1], times), np.flatnonzero(np.repeat(times > 1, times))
    other = np.where(least != ids, least, np.where(most != ids, most, NO_ID))
    return _joined(table.column(2), twice, start[twice], other[twice], new[twice]) if len(twice) else None


def _equal(table: pa.RecordBatch) -> pa.RecordBatch | None:
    """All windows of a bucket -> spans of those that stand twice."""
    x, at = _in_order(_windows_of(table))
    times = np.diff(at, append=len(x))
    ids, new = x["id"], np.zeros(len(x), bool)
    new[at] = True
    least, most, twice = np.repeat(ids[at], times), np.repeat(ids[at + times - 1], times), np.flatnonzero(np.repeat(times > 1, times))
    other = np.where(least != ids, least, np.where(most != ids, most, NO_ID))
    return _joined(_keys_of(x), twice, x["start"][twice], other[twice], new[twice]) if len(twice) else None


def common_spans(texts: DataFrame, places: int) -> DataFrame:
    """(id, key, text, places) -> spans of the windows that stand twice and whose minimiser is one of the places, of which there
    are so many. Texts are dealt out evenly, as each has some windows for every place."""
    texts = texts.repartition(max(1, -(-places * SPREAD // (2 * TASK_WINDOWS))), "key")
    buckets = max(1, -(-places * SPREAD // BUCKET_WINDOWS))
    grouped = lambda df, work, schema: df.mapInArrow(lambda batches: _by_group(batches, work), schema)
    most = GROUP
    counted = grouped(dealt_windows(texts, buckets, once=True), lambda table: _frequent(table, most), "hash binary, n long, id long, key binary, start int, most long")
    heavy = written(counted.select("hash", "n", F.struct("id", "key", "start").alias("least"), "most"), "windows")
    if heavy.count() <= BROADCAST_ROWS:
        table = Heavy(heavy.collect())
        return table.spans(texts).union(grouped(dealt_windows(texts, buckets, once=False, heavy=table), _equal, _SPANS))
    windows, total = common_windows(texts), heavy.agg(F.sum("n")).first()[0]
    joined = lookup(windows, heavy, "hash", "n", total, "inner")
    other = F.when(F.col("least.id") != F.col("id"), F.col("least.id")).when(F.col("most") != F.col("id"), F.col("most")).otherwise(NO_ID)
    first = (F.col("least.key") == F.col("key")) & (F.col("least.start") == F.col("start"))
    found = joined.select("key", "start", (F.col("start") + LEAST_WORDS).alias("end"), other.alias("other"), first.alias("first"))
    rest = lookup(windows, heavy.select("hash", "n", F.lit(True).alias("heavy")), "hash", "n", total).filter("heavy is null").drop("heavy")
    ordered = rest.repartition("hash").sortWithinPartitions("hash", "id", "key", "start")
    return found.union(grouped(ordered, _equal_rows, _SPANS))


def _spans(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (id, key, text) -> the rows' id, key, n_words, and the spans of each distinct text of windows that stand twice.

    Equal texts are one here. A span's `first` says that its windows stand here first, by id, text and position.
    """
    marked = written(anchored(rows.select("id", "key", "text")), "anchors")
    once = marked.filter(F.size("grams") > 0).select("key", "grams", "places").dropDuplicates(["key"])
    pairs = F.explode(F.arrays_zip(F.col("grams").alias("g"), F.col("places").alias("p"))).alias("x")
    each = once.select("key", pairs).select("key", F.col("x.g").alias("gram"), F.col("x.p").alias("place"))
    shared = written(each.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    sums = shared.agg(F.sum("n"), F.sum(F.when(F.col("n") > GROUP, F.col("n")))).first()
    total, common = sums[0] or 0, sums[1] or 0
    hits = lookup(each, shared.withColumn("_n", F.col("n")), "gram", "_n", total,
        "inner").groupBy("key").agg(F.collect_list(F.struct("place", "n")).alias("hits"))
    # One row of each text: copies are dropped in the map tasks first.
    whole = rows.groupBy("key").agg(F.first("text").alias("text"), F.coalesce(F.min("id"), F.lit(NO_ID)).alias("id"))
    texts = written(whole.join(hits, "key").select("id", "key", "text", "hits"), "shared_texts")
    of = lambda wanted: texts.select("id", "key", "text",
        F.filter("hits", wanted)["place"].alias("places")).filter(F.size("places") > 0)
    ordered = suffixes(of(lambda x: x["n"] <= GROUP)).repartition("gram").sortWithinPartitions("gram", "right")
    return marked.select("id", "key", "n_words"), compared(ordered).union(common_spans(of(lambda x: x["n"] > GROUP), common))


def _islands(spans: DataFrame, *more: str) -> DataFrame:
    """Spans of a key that meet or overlap, put together: key, run, start, end, other."""
    by_start = Window.partitionBy("key", *more).orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    numbered = new.withColumn("run", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("key", *more, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"),
        F.min("other").alias("other")).drop("run")


def _keyed(docs: DataFrame, id_col: str, text_col: str, **more) -> DataFrame:
    rows = renamed(docs, id=F.col(id_col).cast("long"), text=F.coalesce(F.col(text_col), F.lit("")), **more)
    return rows.withColumn("key", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))


def _classes(marked: DataFrame) -> DataFrame:
    return marked.groupBy("key").agg(F.min("id").alias("least_id"), F.max("id").alias("most_id"), F.count("*").alias("copies"),
        F.first("n_words").alias("n_words"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of LEAST_WORDS words or more that stand elsewhere too, in another or the same text.

    One row for each maximal run of such words in each input row: doc_id, start, end (in words, end not included),
    n_words (of the run), doc_words, other_doc_id (an id other than the row's own of a text that shares part of the run;
    the row's own id if only rows of that id, or of none, do). Rows without any are left out. Words are
    [^\\x20\\x09-\\x0D]+ with A-Z lower-cased.

    Suffixes are kept at minimiser positions of GRAM-word hashes, one in any SPREAD, so that the same one is kept in each
    copy of a passage of LEAST_WORDS words. Grams that occur once are dropped. The suffixes of the others are sorted by what
    follows; neighbours are compared forwards, and in the order of what precedes, backwards. A passage can only lie as far
    as these reach; each LEAST_WORDS words there are compared with all others around the same gram, by 64 bits of the gram's
    words and 64 of their own, so neither the number of suffixes nor of partitions decides what is found. Of a
    gram with over GROUP suffixes, which one task shouldn't sort, the LEAST_WORDS words around each are compared by the same
    128 bits wherever they are sent by them; those that stand over GROUP times are counted over all tasks. Equal
    texts (by 128 bits of SHA-256) are worked on once: if two rows have the same text of LEAST_WORDS words, their run is
    the whole text.

    Null, empty and shorter texts have no passages; ids may be null or repeated, and rows count as copies of each other
    whatever their ids; other columns are ignored; an empty table gives an empty result.
    """
    marked, spans = _spans(_keyed(docs, id_col, text_col))
    lists = _islands(spans).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "other"))).alias("runs"))
    classes = _classes(marked)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"), F.coalesce("least_id", F.lit(NO_ID)).alias("other")))
    full = (F.col("copies") > 1) & (F.col("n_words") >= LEAST_WORDS)
    found = classes.join(lists, "key", "left").withColumn("runs", F.when(full, whole).otherwise(F.col("runs"))).filter(F.size("runs") > 0)
    texts = written(found.select("key", "n_words", "runs", "copies", "most_id"), "runs")
    total = texts.agg(F.sum("copies")).first()[0] or 0
    out = lookup(marked.select("id", "key"), texts, "key", "copies", total, "inner").select("id", "n_words", "most_id", F.explode("runs").alias("r"))
    # The whole text's other row: the least id, or for that row itself the greatest.
    mine = F.col("r.other").eqNullSafe(F.col("id"))
    other = F.when(mine, F.col("most_id")).when(F.col("r.other") != NO_ID, F.col("r.other"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("r.start").alias("start"), F.col("r.end").alias("end"),
        (F.col("r.end") - F.col("r.start")).alias("n_words"),
        F.col("n_words").alias("doc_words"), F.coalesce(other, F.col("id")).alias("other_doc_id"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, their texts without the words of repeated passages.

    Each LEAST_WORDS words in a row that stand several times are left whole where they stand first, by id (null last), text
    and position; a word goes only if it is part of such words that stand elsewhere before, and of none that stand first
    here. So each passage stays whole in one place at least. Of rows with equal texts of LEAST_WORDS words or more all but
    the first become empty. Cuts are made row by row, whatever the ids, which may be null or repeated; the white space
    before a cut goes with it. Null and shorter texts stay as they are; an empty table gives an empty result.
    """
    kept = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("all")), "rows")
    rows = _keyed(kept, f"all.{id_col}", f"all.{text_col}", row=F.col("row"))
    marked, spans = _spans(rows)
    runs = _islands(spans, "first").groupBy("key")
    pick = lambda own: F.collect_list(F.when(F.col("first") == own, F.struct("start", "end")))
    lists = runs.agg(pick(False).alias("cuts"), pick(True).alias("firsts"))
    order = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("f")
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"), order).select("key", "copies", F.col("f.row").alias("first_row"))
    sizes = marked.groupBy("key").agg(F.first("n_words").alias("n_words"))
    texts = copies.join(sizes, "key").join(lists, "key", "left").filter("cuts is not null or copies > 1")
    found = written(texts.filter(F.col("n_words") >= LEAST_WORDS), "cuts")
    total = found.agg(F.sum("copies")).first()[0] or 0
    one = lookup(rows.select("row", "key"), found, "key", "copies", total, "inner")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    copy = F.col("row") != F.col("first_row")
    cuts = F.when(copy, whole).otherwise(F.col("cuts"))
    firsts = F.when(copy, F.array().cast("array<struct<start:int,end:int>>")).otherwise(F.col("firsts"))
    mine = one.select("row", cuts.alias("cuts"), firsts.alias("firsts")).filter(F.size("cuts") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts, firsts in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                out.append(text if not cuts or text is None else _cut(text.encode(), cuts, firsts or []))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "text"])

    changed = kept.join(mine, "row").select("row", F.col(f"all.{text_col}"), "cuts", "firsts").mapInArrow(run, "row long, text string")
    both = kept.join(changed.withColumnRenamed("text", "_left"), "row", "left")
    text = F.when(F.col("_left").isNotNull(), F.col("_left")).otherwise(F.col(f"all.{text_col}"))
    return both.select(*((text if c == text_col else F.col("all")[c]).alias(c) for c in docs.columns))


def _cut(text: bytes, cuts: list[dict], firsts: list[dict]) -> str:
    data = np.frombuffer(text, np.uint8)
    starts, lengths, _ = W.spans(~W.SPACE[data], np.array([0, len(data)]))
    gone = np.zeros(len(starts), bool)
    for spans, value in ((cuts, True), (firsts, False)):
        for s in spans:
            gone[s["start"] : s["end"]] = value
    ends = starts + lengths
    # Each word goes with the white space before it.
    return b"".join(text[a:b] for a, b,
        cut in zip([0, *ends[:-1].tolist()], ends.tolist(), gone.tolist(), strict=True) if not cut).decode().strip(" \t\n\v\f\r")
