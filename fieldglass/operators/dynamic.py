"""Sequential dynamic programmes: two-state labelling and the alignment of takes to plays. One group is one film, so it is bounded."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.geometry import TAKE_LEAST_S, TAKE_MEDIAN_S, TAKE_MOST_S, TAKE_SIGMA

SAME_VIEW, TILT_WIDTH = 0.10, 5.0
EVIDENCE, CLIP, REAL_CUT, MISSED_CUT = 0.15, 0.03, 0.97, 0.03
JUNK_EDGE, JUNK_MID, JUNK_RATE, SKIP, SKIP_OPTIONAL = 2.0, 12.0, 0.01, -12.0, -0.7


def kernel_log_density(value: Column, points: Sequence[float], width: float = TILT_WIDTH) -> Column:
    """Log of a Gaussian kernel density at a value; minus infinity without points."""
    if not len(points):
        return F.lit(float("-inf"))
    total = F.aggregate(F.array(*(F.lit(float(p)) for p in points)), F.lit(0.0), lambda s,
        p: s + F.exp(-0.5 * F.pow((value - p) / width, F.lit(2.0))))
    return F.log(total / (len(points) * width * math.sqrt(2 * math.pi)) + 1e-300)


def most_likely_states(df: DataFrame, keys: Sequence[str], order: str, first: str, second: str, same: float = SAME_VIEW,
    logs: bool = True) -> DataFrame:
    """The likeliest sequence of two states: keys, order, state (0 or 1). first and second are each row's log likelihoods, or without
    `logs` likelihoods; NULL and NaN tell nothing, nor do likelihoods that aren't positive. One pass over a group's rows keeps the
    best way into either state, one back reads it off. The logarithms of likelihoods are the C library's, as those of the chances of a
    move are: the JVM's may differ in the last bit, which decides where two ways are as likely as each other."""
    stay, move = math.log(same), math.log(1 - same)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        told = np.stack([table.column(c).cast(pa.float64()).to_numpy() for c in (first, second)], axis=1)
        if not logs:
            told = np.array([math.log(x) if x > 0 else 0.0 for x in told.ravel().tolist()]).reshape(told.shape)
        told = np.nan_to_num(told, nan=0.0)
        a, b, came = math.log(0.5) + told[0, 0], math.log(0.5) + told[0, 1], np.zeros((len(told), 2), np.int8)
        for i, (x, y) in enumerate(told[1:].tolist(), 1):
            came[i] = (0 if a + stay >= b + move else 1), (0 if a + move >= b + stay else 1)
            a, b = max(a + stay, b + move) + x, max(a + move, b + stay) + y
        state = np.zeros(len(told), np.int32)
        state[-1] = 0 if a >= b else 1
        for i in range(len(told) - 1, 0, -1):
            state[i - 1] = came[i, state[i]]
        return pa.table([*(table.column(k) for k in (*keys, order)), pa.array(state)], names=[*keys, order, "state"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in (*keys, order)) + ", state int"
    return df.select(*keys, order, first, second).groupBy(*keys).applyInArrow(run, schema)


@dataclass(frozen=True)
class Take:
    """Samples [start, end): a slot (from 1) of the expected sequence, or None for footage of no play."""

    start: int
    end: int
    slot: int | None


def align_takes(reading: np.ndarray, cuts: Sequence[int], missed: Sequence[int], plays: int, step_s: float = 0.4,
    optional: Sequence[bool] | None = None) -> tuple[list[Take], list[int], float]:
    """The best way to cut film into the takes of `plays` plays, two cameras each in turn: (takes, slots skipped, score).

    reading: at each sample, the chance that the first camera is on. Boundaries are the film's ends and some of the cuts
    (likely real) and missed (unlikely). A state is (boundary, slots done); from one state to a later boundary either the next
    slot is filled or the footage is junk, and at any boundary a slot may be skipped. Everything is priced in log likelihood.
    """
    p = np.clip(np.nan_to_num(np.asarray(reading, float), nan=0.5), CLIP, 1 - CLIP)
    sums = {name: np.concatenate([[0.0], np.cumsum(x)]) for name, x in {
        1: EVIDENCE * np.log(p), 0: EVIDENCE * np.log1p(-p), None: EVIDENCE * np.log(np.maximum(p, 1 - p)) - JUNK_RATE}.items()}
    chance = {c: MISSED_CUT for c in missed if 0 < c < len(p)} | {c: REAL_CUT for c in cuts if 0 < c < len(p)}
    bounds = [0, *sorted(chance), len(p)]
    taken = np.array([0.0, *(math.log(chance[b]) for b in bounds[1:-1]), 0.0])
    passed = np.concatenate([[0.0], np.cumsum([0.0, *(math.log1p(-chance[b]) for b in bounds[1:-1]), 0.0])])
    slots = 2 * plays
    skips = np.repeat(np.where(np.asarray(optional if optional is not None else [False] * plays, bool), SKIP_OPTIONAL, SKIP), 2)
    junk = np.full(slots + 1, -JUNK_MID)
    junk[[0, slots]] = -JUNK_EDGE
    first = np.arange(1, slots + 1) % 2 == 1
    score = np.full((len(bounds), slots + 1), -np.inf)
    came = np.full((len(bounds), slots + 1, 2), -1, np.int64)

    def skip(row: int) -> None:
        for k in range(slots):
            if score[row, k] + skips[k] > score[row, k + 1]:
                score[row, k + 1], came[row, k + 1] = score[row, k] + skips[k], (row, 2)

    score[0, 0] = 0.0
    skip(0)
    for j in range(1, len(bounds)):
        for i in range(j):
            seconds = (bounds[j] - bounds[i]) * step_s
            within = TAKE_LEAST_S <= seconds <= TAKE_MOST_S
            if seconds > TAKE_MOST_S + step_s and i:
                continue
            price = taken[j] + passed[j] - passed[i + 1]
            told = {v: s[bounds[j]] - s[bounds[i]] for v, s in sums.items()}
            offers = [(score[i] + told[None] + junk + price, slice(0, slots + 1), 0)]
            if within:
                z = (math.log(seconds) - math.log(TAKE_MEDIAN_S)) / TAKE_SIGMA
                offers.insert(0, (score[i, :-1] + np.where(first, told[1], told[0]) - 0.5 * z * z + price, slice(1, slots + 1), 1))
            for value, target, kind in offers:
                better = np.flatnonzero(value > score[j, target])
                score[j, target][better] = value[better]
                came[j, target][better] = (i, kind)
        skip(j)
    if not np.isfinite(score[-1, slots]):
        raise ValueError(f"{len(p)} samples can't hold {plays} plays")
    takes, skipped, j, k = [], [], len(bounds) - 1, slots
    while (j, k) != (0, 0):
        i, kind = came[j, k]
        if kind == 2:
            skipped.append(k)
        else:
            takes.append(Take(bounds[i], bounds[j], k if kind else None))
        j, k = int(i), k - (kind > 0)
    return takes[::-1], sorted(skipped), float(score[-1, slots])


def aligned_plays(samples: DataFrame, keys: Sequence[str], order: str, reading: str, cut: str, missed: str, plays: DataFrame,
    step_s: float = 0.4) -> DataFrame:
    """Films (samples with flags cut and missed) and their plays (keys, play_index from 0, optional) -> for each play its two takes
    as sample ranges: first_start, first_end, second_start, second_end; NULL where a slot was skipped."""
    films = samples.groupBy(*keys).agg(
        F.array_sort(F.collect_list(
        F.struct(F.col(order).alias("o"), F.col(reading).cast("double").alias("p"), F.col(cut).alias("c"), F.col(missed).alias("m")))).alias(
        "samples"))
    lists = plays.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("play_index", F.coalesce("optional", F.lit(False)).alias("optional")))).alias("plays"))

    def run(batches):
        for frame in batches:
            rows = []
            for row in frame.to_dict("records"):
                s = row["samples"]
                takes, _, _ = align_takes(np.array([x["p"] if x["p"] is not None else np.nan for x in s]), [i for i, x in enumerate(s) if x["c"]],
                    [i for i, x in enumerate(s) if x["m"]], len(row["plays"]), step_s, [x["optional"] for x in row["plays"]])
                by_slot = {t.slot: (t.start, t.end) for t in takes if t.slot}
                for n, play in enumerate(row["plays"]):
                    rows.append([row[k] for k in keys]
                        + [play["play_index"], *by_slot.get(2 * n + 1, (None, None)), *by_slot.get(2 * n + 2, (None, None))])
            yield pd.DataFrame(rows,
                columns=[*keys, "play_index", "first_start", "first_end", "second_start", "second_end"]).astype(
                {c: "Int64" for c in ("first_start", "first_end", "second_start", "second_end")})

    kinds = {f.name: f.dataType.simpleString() for f in [*samples.schema, *plays.schema]}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"play_index {kinds['play_index']}"]
        + [f"{a}_{b} long" for a in ("first", "second") for b in ("start", "end")])
    return films.join(lists, list(keys)).mapInPandas(run, schema)


def best_first_view(takes: DataFrame, keys: Sequence[str], order: str, reading: str) -> DataFrame:
    """Whether strictly alternating takes begin with the first camera, by their summed log likelihood: keys, first_view (0 or 1), agreement."""
    w = Window.partitionBy(*keys).orderBy(order)
    p = F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.col(reading)))
    even = (F.row_number().over(w) % 2) == 1
    marked = takes.withColumn("_even", even).withColumns({"_yes": F.log(p), "_no": F.log(1 - p)})
    sums = marked.groupBy(*keys).agg(
        F.sum(F.when(F.col("_even"), F.col("_yes")).otherwise(F.col("_no"))).alias("_a"),
        F.sum(F.when(F.col("_even"), F.col("_no")).otherwise(F.col("_yes"))).alias("_b"),
        F.avg((F.col("_even") == (F.col(reading) >= 0.5)).cast("double")).alias("_agree"))
    return sums.select(*keys, (F.col("_a") < F.col("_b")).cast("int").alias("first_view"),
        F.when(F.col("_a") >= F.col("_b"), F.col("_agree")).otherwise(1 - F.col("_agree")).alias("agreement"))
