"""Operators over detected boxes of frames: duplicates, matching, sizes, review, training lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions.geometry import overlap

DUPLICATE, BALL_OF_PLAYER, BALL_ASPECT, MATCH = 0.7, 1 / 3, 2.5, 0.5
BOX = "struct<id:long,box:array<double>,score:double>"


def _sides(box: Column) -> list[Column]:
    return [F.get(box, k) for k in range(4)]


def without_duplicates(boxes: DataFrame, keys: Sequence[str], id_col: str = "box_id", most: float = DUPLICATE) -> DataFrame:
    """Of each frame and label, boxes that no better kept box overlaps by more than `most`; ties by id. Boxes are folded in
    order of score into an array of kept ones, all in one expression."""
    entry = F.struct((-F.col("score")).alias("o"), F.col(id_col).cast("long").alias("id"), F.col("box").alias("box"),
        F.col("score").cast("double").alias("score"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)),
        lambda e: F.struct(e["id"].alias("id"), e["box"].alias("box"), e["score"].alias("score")))
    clash = lambda kept, e: F.exists(kept, lambda k: overlap(_sides(k["box"]), _sides(e["box"])) > most)
    kept = F.aggregate(ordered, F.array().cast(f"array<{BOX}>"), lambda kept, e: F.when(clash(kept, e), kept).otherwise(F.array_append(kept, e)))
    return boxes.groupBy(*keys).agg(kept.alias("_k")).select(*keys, F.explode("_k").alias("k")).select(*keys, F.col("k.id").alias(id_col),
        F.col("k.box").alias("box"), F.col("k.score").alias("score"))


def plausible_balls(boxes: DataFrame, frame: Sequence[str], ball: str = "football", player: str = "player") -> DataFrame:
    """Boxes without balls taller than BALL_OF_PLAYER of the frame's median player (if it has any) or too long."""
    width, height = F.col("box")[2] - F.col("box")[0], F.col("box")[3] - F.col("box")[1]
    median = F.percentile(F.when(F.col("label") == player, height), 0.5).over(Window.partitionBy(*frame))
    right = (F.coalesce(height <= BALL_OF_PLAYER * median, F.lit(True))) & (width <= BALL_ASPECT * height)
    return boxes.withColumn("_ok", (F.col("label") != ball) | right).filter("_ok").drop("_ok")


def matched(found: DataFrame, truth: DataFrame, keys: Sequence[str], least: float = MATCH) -> DataFrame:
    """hit, wrong and missed boxes of each key (frame and label): found boxes, best score first, each take the free true box
    that they overlap most, if by `least`. Boxes of a key are matched in one pass, equal true ones as one that may be taken several
    times; keys of one side only count too."""
    f = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("box").alias("box")))).alias("_f"))
    t = truth.groupBy(*keys).agg(F.array_sort(F.collect_list("box")).alias("_t"))
    sides = lambda name, box: [F.coalesce(F.transform(name, lambda e: F.get(box(e), k)), F.array().cast("array<double>")).cast(
        "array<double>").alias(f"{name}{k}") for k in range(4)]
    both = f.join(t, list(keys), "full").select(*keys, *sides("_f", lambda e: e["box"]), *sides("_t", lambda e: e))
    kinds = T.StructType([*(both.schema[k] for k in keys), *(T.StructField(c, T.LongType()) for c in ("hit", "wrong", "missed"))])
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (f_at, f_all), (t_at, t_all) = (_matrix(batch.columns[i : i + 4]) for i in (n_keys, n_keys + 4))
            hit = np.array([_hits(f_all[a:b], t_all[c:d], least) for a, b, c, d in zip(f_at[:-1], f_at[1:], t_at[:-1], t_at[1:], strict=True)],
                np.int64)
            counts = [pa.array(x) for x in (hit, np.diff(f_at) - hit, np.diff(t_at) - hit)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], *counts], names=[*keys, "hit", "wrong", "missed"])

    return both.mapInArrow(run, kinds)


def _matrix(lists: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's boxes begin, and the boxes of all rows; one with a missing side has none, so that it overlaps nothing."""
    at = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = [x.flatten() for x in lists]
    boxes = np.stack([x.to_numpy(zero_copy_only=False).astype(float) for x in flat], axis=1)
    boxes[np.any([x.is_null().to_numpy(zero_copy_only=False) for x in flat], axis=0)] = 0.0
    return at, boxes


def _hits(found: np.ndarray, truth: np.ndarray, least: float) -> int:
    """How many of the found boxes, in order, get a true box."""
    if not len(found) or not len(truth):
        return 0
    new = np.append(True, (truth[1:] != truth[:-1]).any(axis=1))
    free = np.diff(np.append(np.flatnonzero(new), len(truth)))
    truth, hit = truth[new], 0
    area = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
    true_area = area(truth)
    with np.errstate(divide="ignore", invalid="ignore"):
        for box in found:
            width = np.maximum(0.0, np.minimum(box[2], truth[:, 2]) - np.maximum(box[0], truth[:, 0]))
            common = width * np.maximum(0.0, np.minimum(box[3], truth[:, 3]) - np.maximum(box[1], truth[:, 1]))
            either = area(box) + true_area - common
            share = np.where(either == 0, 0.0, common / either)
            # As Spark orders numbers, NaN is the largest.
            share[np.isnan(share)] = np.inf
            best = int(np.argmax(share))
            if share[best] >= least:
                hit += 1
                free[best] -= 1
                if not free[best]:
                    truth, true_area, free = (np.delete(x, best, axis=0) for x in (truth, true_area, free))
                    if not len(free):
                        break
    return hit


def scores(matches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums, precision and recall; 0 where there is nothing to divide by."""
    sums = matches.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("hit", "wrong", "missed")))
    share = lambda other: F.col("hit") / F.greatest(F.lit(1), F.col("hit") + F.col(other))
    return sums.withColumns({"precision": share("wrong"), "recall": share("missed")})


def disagreements(a: DataFrame, b: DataFrame, keys: Sequence[str], frame: Sequence[str]) -> DataFrame:
    """Boxes of each frame that one model has and the other lacks."""
    return matched(a, b, keys).groupBy(*frame).agg(F.sum(F.col("wrong") + F.col("missed")).alias("disputed"))


def weakest(scores_: Column) -> Column:
    """The least score of a frame's boxes; a missing one is 1, and no boxes are -1."""
    return F.coalesce(F.array_min(F.transform(scores_, lambda s: F.coalesce(s, F.lit(1.0)))), F.lit(-1.0))


def review_order(frames: DataFrame, disputed: str, weak: str, frame: str) -> DataFrame:
    return frames.orderBy(F.desc_nulls_last(disputed), F.asc_nulls_last(weak), F.asc_nulls_last(frame))


def most_disputed(frames: DataFrame, seen: DataFrame, frame: str, k: int, disputed: str = "disputed") -> DataFrame:
    """The k frames that models disagree on most, among those not seen."""
    return frames.filter(F.col(disputed) > 0).join(seen.select(frame).distinct(), frame, "left_anti").orderBy(F.desc(disputed), frame).limit(k)


def review_lists(decisions: DataFrame, keys: Sequence[str], frame: str = "frame", decision: str = "decision") -> DataFrame:
    """kept, flagged and dropped frames in order."""
    of = lambda d: F.array_sort(F.collect_list(F.when(F.col(decision) == d, F.col(frame))))
    return decisions.groupBy(*keys).agg(of("keep").alias("kept"), of("flag").alias("flagged"), of("drop").alias("dropped"))


def reviewed_boxes(frames: DataFrame, boxes: str = "boxes", removed: str = "removed") -> DataFrame:
    """Frames without the boxes at the removed places (from 0)."""
    gone = F.coalesce(removed, F.array().cast("array<int>"))
    return frames.withColumn(boxes, F.filter(boxes, lambda b, i: ~F.array_contains(gone, i)))


def detections_document(boxes: DataFrame, keys: Sequence[str], thresholds: dict[str, float], *more: str) -> DataFrame:
    """Each frame's boxes above their label's threshold, best first within labels in order; `more` columns go with each box."""
    floor = F.coalesce(*(F.when(F.col("label") == k, F.lit(v)) for k, v in thresholds.items()))
    entry = F.struct("label", (-F.col("score")).alias("o"), "box", "score", *more)
    listed = F.array_sort(F.collect_list(entry))
    return boxes.filter(F.col("score") > floor).groupBy(*keys).agg(
        F.transform(listed, lambda e: F.struct(*(e[c].alias(c) for c in ("label", "box", "score", *more)))).alias("boxes"))


def overlap_shares(boxes: DataFrame, frame: Sequence[str], id_col: str) -> DataFrame:
    """The largest share of each box that one other box of its frame covers."""
    a = boxes.select(*frame, id_col, F.col("box").alias("_a"))
    b = boxes.select(*frame, F.col(id_col).alias("_id"), F.col("box").alias("_b"))
    p, q = _sides(F.col("_a")), _sides(F.col("_b"))
    both = F.greatest(F.lit(0.0), F.least(p[2], q[2]) - F.greatest(p[0], q[0])) * F.greatest(F.lit(0.0), F.least(p[3], q[3]) - F.greatest(p[1], q[1]))
    share = F.coalesce(F.try_divide(both, (p[2] - p[0]) * (p[3] - p[1])), F.lit(0.0))
    other = F.when(F.col("_id") != F.col(id_col), share)
    return a.join(b, list(frame)).groupBy(*frame, id_col).agg(F.coalesce(F.max(other), F.lit(0.0)).alias("covered"))


def off_field_suggestions(feet: DataFrame, frame: Sequence[str], off: str, most: float = 0.5) -> DataFrame:
    """Boxes judged off the field, but not of frames where that would be most of them."""
    share = F.avg(F.col(off).cast("double")).over(Window.partitionBy(*frame))
    return feet.withColumn("_s", share).filter(F.col(off) & (F.col("_s") <= most)).drop("_s")
