"""Streaming forms: tumbling and session windows, cuts and tracks by keyed state, layered merges, incremental pulls.

Late rows: events older than the watermark are dropped by the window operators; the stateful operators take rows of each
micro-batch in order of frame, and rows that come with a frame not above the last one seen are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldglass.operators.joins import layered

RECENT, LOST_S, LEAST_OVERLAP = 15, 2.5, 0.1


def open_frames(spark: SparkSession, path: str, schema: str, live: bool) -> DataFrame:
    """A folder of frame rows as a table, or as a stream of the files that arrive."""
    return spark.readStream.schema(schema).parquet(path) if live else spark.read.schema(schema).parquet(path)


def tumbling(df: DataFrame, at: str, width: str, keys: Sequence[str], value: str, late: str | None = None, full: int | None = None) -> DataFrame:
    """Rows, sum and mean by window; full: only windows of so many rows."""
    rows = df.withWatermark(at, late) if late else df
    out = rows.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    out = out.select(F.col("w.start").alias("start"), *keys, "n", "total", "mean")
    return out.filter(F.col("n") == full) if full else out


def sliding(df: DataFrame, at: str, width: str, step: str, keys: Sequence[str], late: str | None = None) -> DataFrame:
    rows = df.withWatermark(at, late) if late else df
    return rows.groupBy(F.window(at, width, step).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(df: DataFrame, at: str, gap: str, keys: Sequence[str], late: str | None = None) -> DataFrame:
    """Runs of rows with gaps under `gap`."""
    rows = df.withWatermark(at, late) if late else df
    out = rows.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.max(at).alias("last"))
    return out.select(F.col("w.start").alias("first"), "last", *keys, "n")


def zero_based(df: DataFrame, source: str = "source_id", frame: str = "frame") -> DataFrame:
    """Frames counted from the first that each source gave."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(frame)
        first = state.get[0] if state.exists else int(rows[frame].iloc[0])
        state.update((first,))
        yield rows.assign(index=rows[frame] - first)[[*df.columns, "index"]]

    schema = ", ".join(f"{c} {kinds[c]}" for c in df.columns) + ", index long"
    return df.groupBy(source).applyInPandasWithState(run, schema, "first long", "append", GroupStateTimeout.NoTimeout)


def live_cuts(df: DataFrame, least: float = 12.0, ratio: float = 4.0, recent: int = RECENT) -> DataFrame:
    """(source_id, frame, change) -> those with is_cut: change above `least` and `ratio` times the median of the last ones, which are the state."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = (list(state.get[0]), state.get[1]) if state.exists else ([], -1)
        out = []
        for row in pd.concat(list(parts)).sort_values("frame").itertuples():
            if row.frame <= last:
                continue
            out.append((key[0], row.frame, row.change, bool(row.change > max(least, ratio * (float(np.median(seen)) if seen else 0.0)))))
            seen, last = [*seen, float(row.change)][-recent:], int(row.frame)
        state.update((seen, last))
        yield pd.DataFrame(out, columns=["source_id", "frame", "change", "is_cut"])

    return df.select("source_id", "frame", "change").groupBy("source_id").applyInPandasWithState(run,
        "source_id string, frame long, change double, is_cut boolean", "recent array<double>, last long", "append", GroupStateTimeout.NoTimeout)


def live_tracks(df: DataFrame, rate: float = 25.0, lost_s: float = LOST_S, least: float = LEAST_OVERLAP) -> DataFrame:
    """(source_id, frame, x1, y1, x2, y2, conf, cut) -> with track_id: boxes go, best overlap first, to the tracks seen within lost_s.

    Only the last box of each such track is kept as state; a cut ends all tracks, and ids are never used again.
    """
    size = ["x1", "y1", "x2", "y2"]

    def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
        both = np.clip(high - low, 0, None).prod(axis=2)
        area = [np.clip(x[:, 2:] - x[:, :2], 0, None).prod(axis=1) for x in (a, b)]
        return both / np.maximum(area[0][:, None] + area[1][None, :] - both, 1e-9)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_id, last, flat = state.get if state.exists else (1, -1, [])
        tracks = {int(flat[i]): (int(flat[i + 1]), np.array(flat[i + 2 : i + 6])) for i in range(0, len(flat), 6)}
        out = []
        for frame, rows in pd.concat(list(parts)).sort_values(["frame", "conf"], ascending=[True, False]).groupby("frame"):
            if frame <= last:
                continue
            last = int(frame)
            tracks = {} if bool(rows["cut"].any()) else {t: v for t, v in tracks.items() if frame - v[0] <= lost_s * rate}
            boxes, names = rows[size].to_numpy(float), list(tracks)
            ids = [0] * len(boxes)
            if names:
                score = overlaps(boxes, np.array([tracks[t][1] for t in names]))
                for place in np.argsort(-score, axis=None, kind="stable"):
                    i, j = divmod(int(place), len(names))
                    if score[i, j] < least:
                        break
                    if not ids[i] and names[j] not in ids:
                        ids[i] = names[j]
            for i in range(len(boxes)):
                if not ids[i]:
                    ids[i], next_id = next_id, next_id + 1
                tracks[ids[i]] = (last, boxes[i])
            out.append(rows.assign(track_id=ids))
        state.update((next_id, last, [float(x) for t, (f, b) in tracks.items() for x in (t, f, *b)]))
        if out:
            yield pd.concat(out)[["source_id", "frame", *size, "conf", "track_id"]]

    columns = "source_id string, frame long, x1 double, y1 double, x2 double, y2 double, conf double, track_id long"
    return df.groupBy("source_id").applyInPandasWithState(run, columns, "next_id long, last long, tracks array<double>", "append",
        GroupStateTimeout.NoTimeout)


def _versions(spark: SparkSession, target: str) -> list[int]:
    """The numbers of the parts below target that were written whole."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    found = [int(n.removeprefix("part=")) for n in names if n.startswith("part=")]
    return sorted(n for n in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{target}/part={n}/_SUCCESS")))


def merge_layers(target: str, keys: Sequence[str], fields: Sequence[str]):
    """For foreachBatch: what each batch says, rows of keys, `layer` and fields, is put below target as a part of its own.

    Parts are numbered on from the last whole one, whatever the batch's own number, so a stream with a new checkpoint goes
    on where the old one stopped; a part that a failed batch left is written anew. A batch that is run again says
    the same once more, which changes nothing. Of one batch's rows of a key and layer the last by `at` stands, if there is such a
    column, else the greatest value. current_layers reads the parts."""

    def merge(batch: DataFrame, number: int) -> None:
        part = max(_versions(batch.sparkSession, target), default=-1) + 1
        last = lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.col("at"))) if "at" in batch.columns else F.max(f)
        told = batch.groupBy(*keys, "layer").agg(*(last(f).alias(f) for f in fields))
        told.write.mode("overwrite").parquet(f"{target}/part={part}")

    return merge


def current_layers(spark: SparkSession, target: str, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """keys, layer, fields: for each key and layer the value that the latest part has of each field; see merged."""
    parts = _versions(spark, target)
    if not parts:
        raise ValueError(f"nothing was merged below {target}")
    rows = spark.read.option("basePath", target).parquet(*(f"{target}/part={n}" for n in parts))
    latest = lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.col("part"))).alias(f)
    return rows.groupBy(*keys, "layer").agg(*map(latest, fields))


def compact_layers(spark: SparkSession, target: str, keys: Sequence[str], fields: Sequence[str]) -> None:
    """One part more that says all that is current, so that those before it may be deleted."""
    part = _versions(spark, target)[-1] + 1
    current_layers(spark, target, keys, fields).write.mode("overwrite").parquet(f"{target}/part={part}")


def merged(df: DataFrame, keys: Sequence[str], fields: Sequence[str], ranks: Sequence[str] = ("live", "post", "human")) -> DataFrame:
    """One row for each key from its layers."""
    return layered(df, keys, "layer", ranks, fields)


def match_in_order(detected: DataFrame, official: DataFrame, keys: Sequence[str], at: str, order: str) -> DataFrame:
    """Plays detected live, matched in order to the official ones: the n-th to the n-th, the rest unmatched (NULL)."""
    from pyspark.sql import Window

    number = lambda df, by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(by)))
    return number(detected, at).join(number(official, order), [*keys, "_n"], "left").drop("_n")


def since(records: DataFrame, stamp: str, column: str = "generated.at") -> DataFrame:
    """Records made after a stamp. Stamps are compared as times, as 00.5Z is after 00Z but sorts before it."""
    return records.filter(F.col(column).try_cast("timestamp") > F.lit(stamp).cast("timestamp"))
