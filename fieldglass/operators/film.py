"""Repairs of the take sequence, the choice of optional plays, and spread picks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.operators.dynamic import align_takes
from fieldglass.operators.joins import interval_join
from fieldglass.operators.sampling import evenly_spaced

SURE, LEAST_JUMP, LEAST_S = 0.25, 6.0, 4.0


def split_takes(takes: DataFrame, samples: DataFrame, keys: Sequence[str], first_p: str = "p_first", last_p: str = "p_last", step: float = 0.4,
    width: float = 30.0) -> DataFrame:
    """Takes (take, start, end) whose two ends are surely read as different cameras hold a missed cut: they are split at the strongest
    inner change of the samples (t, diff), if it is strong enough. Returns keys, take, part, start, end."""
    sure = lambda c: F.abs(F.col(c) - 0.5) > SURE
    mixed = takes.filter(((F.col(first_p) - 0.5) * (F.col(last_p) - 0.5) < 0) & sure(first_p) & sure(last_p)
        & (F.col("end") - F.col("start") > LEAST_S))
    inside = interval_join(samples.select(*keys, "t", "diff"), mixed.select(*keys, "take", "start", "end"), keys, "t", "start", "end", width)
    inner = inside.filter((F.col("t") >= F.col("start") + 2 * step - 1e-9) & (F.col("t") < F.col("end") - step + 1e-9))
    cuts = inner.groupBy(*keys,
        "take").agg(F.max(F.struct("diff", (-F.col("t")).alias("o"))).alias("m")).filter(F.col("m.diff") >= LEAST_JUMP).select(*keys, "take",
        (-F.col("m.o")).alias("cut"))
    both = takes.select(*keys, "take", "start", "end").join(cuts, [*keys, "take"], "left")
    part = lambda n, a, b: F.struct(F.lit(n).alias("part"), a.alias("start"), b.alias("end"))
    parts = F.when(F.col("cut").isNull(),
        F.array(part(0, F.col("start"), F.col("end")))).otherwise(F.array(part(0, F.col("start"), F.col("cut")), part(1, F.col("cut"), F.col("end"))))
    return both.select(*keys, "take", F.explode(parts).alias("p")).select(*keys, "take", "p.*")


def alternation_breaks(takes: DataFrame, keys: Sequence[str], order: str, reading: str, reach: int = 5) -> DataFrame:
    """Takes where the running share that agrees with strict alternation crosses one half: there a cut is missing or one too many."""
    w = Window.partitionBy(*keys).orderBy(order)
    even = (F.row_number().over(w) % 2 == 1).cast("int")
    told = takes.withColumn("_even", even).withColumn("_yes", (F.col("_even") == (F.col(reading) >= 0.5).cast("int")).cast("double"))
    better = F.avg("_yes").over(Window.partitionBy(*keys)) >= 0.5
    agreed = told.withColumn("_agree", F.when(better, F.col("_yes")).otherwise(1 - F.col("_yes")))
    run = agreed.withColumn("_run", F.avg("_agree").over(w.rowsBetween(-reach, reach)))
    crossed = (F.col("_run") >= 0.5) != (F.lag("_run").over(w) >= 0.5)
    return run.withColumn("breaks", F.coalesce(crossed, F.lit(False))).drop("_even", "_yes", "_agree", "_run")


def chosen_optional(reading: np.ndarray, cuts: Sequence[int], missed: Sequence[int], optional: Sequence[bool],
    type_score: Callable[[list[int]], float] = lambda kept: 0.0, step_s: float = 0.4) -> tuple[list[bool], float]:
    """Which optional plays are on film: from all of them on, the flip that raises the alignment's score and type_score
    most is taken, until none does. Each choice is scored once."""
    places, known = [i for i, o in enumerate(optional) if o], {}

    def score(on: tuple[bool, ...]) -> float:
        if on not in known:
            off = {p for p, v in zip(places, on, strict=True) if not v}
            kept = [i for i in range(len(optional)) if i not in off]
            try:
                known[on] = align_takes(reading, cuts, missed, len(kept), step_s)[2] + type_score(kept)
            except ValueError:
                known[on] = -np.inf
        return known[on]

    now = (True,) * len(places)
    while True:
        flips = [now[:k] + (not now[k],) + now[k + 1 :] for k in range(len(now))]
        best = max(flips, key=score, default=now)
        if not flips or score(best) <= score(now) + 1e-9:
            off = {p for p, v in zip(places, now, strict=True) if not v}
            return [i not in off for i in range(len(optional))], score(now)
        now = best


def spread_picks(df: DataFrame, cells: Sequence[str], frame: str, order: str, per_cell: int, most_per_frame: int,
    keys: Sequence[str] = ()) -> DataFrame:
    """Of each cell up to per_cell rows spread evenly over `order`, at most most_per_frame of one frame. Choices hang on those
    before, so the candidates of a film (keys) are taken in one call, in order of their cells; without keys df is one film."""
    names = df.columns

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        used: dict = {}
        picked = []
        for _, cell in rows.sort_values([*cells, order, frame]).groupby(list(cells), sort=True):
            free = dict(enumerate(cell.index))
            for target in np.linspace(0, len(cell) - 1, min(per_cell, len(cell))):
                fit = [i for i, at in free.items() if used.get(rows.at[at, frame], 0) < most_per_frame]
                if fit:
                    at = free.pop(min(fit, key=lambda i: (abs(i - target), i)))
                    used[rows.at[at, frame]] = used.get(rows.at[at, frame], 0) + 1
                    picked.append(at)
        return rows.loc[picked, names]

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def takes_or_slices(labels: DataFrame, window: tuple[float, float], pool: int, least_s: float = LEAST_S) -> DataFrame:
    """Sure labelled takes (start_s, end_s, view, confident) inside a window, evenly spaced by view; without any, even slices of it."""
    inside = labels.filter(F.col("confident") & (F.col("end_s") - F.col("start_s") >= least_s) & (F.col("start_s") >= window[0])
        & (F.col("end_s") <= window[1])).select("start_s", "end_s", "view")
    picked = evenly_spaced(inside, ["view"], "start_s", max(1, pool // 4))
    n = max(1, pool // 2)
    size = (window[1] - window[0]) / n
    slices = labels.sparkSession.range(n).select((F.lit(window[0]) + F.col("id") * size).alias("start_s"),
        (F.lit(window[0]) + (F.col("id") + 1) * size).alias("end_s"), F.lit("unlabelled").alias("view"))
    return slices if picked.isEmpty() else picked


def shifted_shots(shots: DataFrame, first_frame: Column, rate: float) -> DataFrame:
    """Shots found in a part of a film as times and frames of the whole film, which that part begins at first_frame of."""
    seconds = {c: F.round(F.col(c) + first_frame / rate, 3) for c in ("start_s", "end_s")}
    return shots.withColumns(seconds | {c: F.col(c) + first_frame for c in ("start_frame", "end_frame")})


def bright_thresholds(windows: DataFrame, keys: Sequence[str], mean: str = "mean", margin: float = 0.05) -> DataFrame:
    """How bright a window of the film itself is at least: midway between the 20th and 80th percentile of the means, less a margin."""
    return windows.groupBy(*keys).agg(((F.percentile(mean, 0.2) + F.percentile(mean, 0.8)) / 2 - margin).alias("threshold"))


def take_summaries(frames: DataFrame, steps: DataFrame, take: Sequence[str], sure: float = 1.0) -> DataFrame:
    """One row for each take: start_frame, end_frame (not included), frames_without (frames without a place), sources (how many frames
    each source placed, by name), steps, steps_changed (dx not 0), steps_unsure (left over more than `sure`) and step_left_max.

    frames: take, frame, source (NULL without a place); steps: take, dx, left. Takes without steps have 0 and NULL.
    """
    by_source = frames.groupBy(*take, "source").agg(F.count("*").alias("n"), F.min("frame").alias("a"), F.max("frame").alias("b"))
    named = F.when(F.col("source").isNotNull(), F.struct("source", "n"))
    head = by_source.groupBy(*take).agg(
        F.min("a").alias("start_frame"), (F.max("b") + 1).alias("end_frame"),
        F.coalesce(F.sum(F.when(F.col("source").isNull(), F.col("n"))), F.lit(0)).alias("frames_without"),
        F.map_from_entries(F.array_sort(F.collect_list(named))).alias("sources"),
    )
    told = steps.groupBy(*take).agg(F.count("*").alias("steps"), F.count_if(F.col("dx") != 0).alias("steps_changed"),
        F.count_if(F.col("left") > sure).alias("steps_unsure"), F.max("left").alias("step_left_max"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("steps", "steps_changed", "steps_unsure")]
    return head.join(told, list(take), "left").select(*take, "start_frame", "end_frame", "frames_without", "sources", *counts, "step_left_max")
