"""Deterministic samples: strata with quotas, evenly spaced picks, hash splits, buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.plays import fold_of, half_of, split_share

GOLDEN = 0.6180339887498949
ANGLES, HALVES = ("sideline", "endzone"), ("first", "second")
PHASES = {"pre_snap": (0.04, 0.20), "live": (0.35, 0.65), "post_whistle": (0.80, 0.96)}
HELD_OUT = 0.15


def hash_split(df: DataFrame, key: str, share: float = HELD_OUT, folds: int = 2) -> DataFrame:
    """`split` (val or train) and `fold` of each key, stable whatever else is in the table."""
    return df.withColumns({"split": F.when(split_share(F.col(key)) < share, "val").otherwise("train"), "fold": fold_of(F.col(key), folds)})


def evenly_spaced(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """n rows of each key at even distances, the first and the last among them; all of fewer."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_m", F.count("*").over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("_m") - 1) / max(1, n - 1)))
    return ranked.filter((F.col("_m") <= n) | F.array_contains(wanted, F.col("_i").cast("long"))).drop("_i", "_m")


def quota_per_stratum(df: DataFrame, strata: Sequence[str], order: Column, quota: int) -> DataFrame:
    """The first `quota` rows of each stratum."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*strata).orderBy(order))).filter(F.col("_i") <= quota).drop("_i")


def sampled_frames(index: DataFrame, quarters: DataFrame, n: int = 2000, rate: float = 25.0,
    phases: Mapping[str, tuple[float, float]] = PHASES) -> DataFrame:
    """About n frames, as many for each half, angle and phase: play_uid, film_play_index, angle, phase_guess, half, frame, time_s, q.

    Strata in order get n / strata frames, the first ones one more. A stratum's frames go evenly over its plays; beyond one
    for each play, every further round takes all plays at an offset a golden step on. A frame that an earlier
    stratum or turn has already is left out. index: one row for each play; quarters: play_uid, qtr.
    """
    spark = index.sparkSession
    names = [(h, a, p) for h in HALVES for a in ANGLES for p in phases]
    rows = [(k, h, a, p, *map(float, phases[p]), n // len(names) + (k < n % len(names))) for k, (h, a, p) in enumerate(names)]
    strata = F.broadcast(spark.createDataFrame(rows, "stratum int, half string, angle string, phase_guess string, low double, high double, want int"))
    plays = index.join(quarters, "play_uid").withColumn("half", half_of(F.col("qtr")))
    w = Window.partitionBy("half")
    pool = plays.withColumn("_pos", F.row_number().over(w.orderBy("film_play_index", "play_uid")) - 1).withColumn("_n", F.count("*").over(w))
    # Turn k of a stratum takes the play at floor(k * n / want), or k modulo n: so each play says which turns are its own.
    few = F.col("want") < F.col("_n")
    turn_of = F.ceil(F.col("_pos") * F.col("want") / F.col("_n"))
    one = F.when((turn_of < F.col("want")) & (F.floor(turn_of * F.col("_n") / F.col("want")) == F.col("_pos")), F.array(turn_of))
    many = F.when(F.col("_pos") < F.col("want"), F.sequence(F.col("_pos").cast("long"), (F.col("want") - 1).cast("long"), F.col("_n")))
    turns = pool.join(strata, "half").withColumn("_k", F.explode(F.when(few, one).otherwise(many)))
    offset = (0.5 + F.floor(F.col("_k") / F.col("_n")) * F.lit(GOLDEN)) % 1.0
    place = lambda side: F.when(F.col("angle") == "sideline", F.col(f"sideline_{side}_s")).otherwise(F.col(f"endzone_{side}_s"))
    q = F.col("low") + F.when(few, F.lit(0.5)).otherwise(offset) * (F.col("high") - F.col("low"))
    frame = F.bround((place("start") + q * (place("end") - place("start"))) * rate).cast("long")
    found = turns.select("play_uid", "film_play_index", "angle", "phase_guess", "half", frame.alias("frame"),
        F.bround(frame / F.lit(rate), 3).alias("time_s"), F.bround(q, 3).alias("q"), "stratum", "_k")
    first = found.withColumn("_i", F.row_number().over(Window.partitionBy("frame").orderBy("stratum", "_k"))).filter("_i = 1")
    return first.drop("stratum", "_k", "_i").orderBy("frame")


def histogram(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, step: float) -> DataFrame:
    """Counts by bin from `low` on; values beyond the ends count in the end bins, and empty bins have 0."""
    bins = round((high - low) / step)
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / step))).cast("int")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"))
    every = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def grade_table(df: DataFrame, row: Column, grade: str, grades: Sequence[str], missing: str = "ungraded") -> DataFrame:
    """Rows by bucket, a column for each grade and one for rows without."""
    marked = df.select(row.alias("bucket"), F.coalesce(F.col(grade).cast("string"), F.lit(missing)).alias("_g"))
    return marked.groupBy("bucket").agg(*(F.count_if(F.col("_g") == x).alias(x) for x in (*grades, missing)))


def windowed_shares(df: DataFrame, keys: Sequence[str], order: str, value: str, moving: Column, rows: int) -> DataFrame:
    """Tumbling windows of `rows` rows (a short last one goes): share moving, median, deviation and mean; the first row of all
    has no difference and is left out of its window's share."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    marked = df.withColumn("_i", i).withColumn("window", F.floor(F.col("_i") / rows)).withColumn("_m", F.when(F.col("_i") > 0, moving.cast("double")))
    out = marked.groupBy(*keys, "window").agg(F.count("*").alias("_n"), F.avg("_m").alias("moving"), F.percentile(value, 0.5).alias("median"),
        F.stddev_pop(value).alias("deviation"), F.avg(value).alias("mean"))
    return out.filter(F.col("_n") == rows).drop("_n")


def latency_summary(df: DataFrame, keys: Sequence[str], seconds: str) -> DataFrame:
    p = F.percentile(seconds, F.array(F.lit(0.5), F.lit(0.9)))
    return df.groupBy(*keys).agg(F.try_divide(F.count(seconds), F.sum(seconds)).alias("rate"), F.avg(seconds).alias("mean"),
        p.alias("_p")).select(*keys, "rate", "mean", F.col("_p")[0].alias("median"), F.col("_p")[1].alias("p90"))
