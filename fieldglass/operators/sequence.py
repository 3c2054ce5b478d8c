"""Operators over ordered rows, all by window functions. `keys` partition, `order` orders; ties in order are the caller's to break."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(keys: Sequence[str], *order: str | Column) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def numbered_where(df: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column, name: str = "play_index") -> DataFrame:
    """1, 2, ... over the rows where the condition holds, NULL elsewhere; an older column of that name goes."""
    holds = F.coalesce(condition, F.lit(False))
    running = F.sum(holds.cast("long")).over(over(keys, *order).rowsBetween(Window.unboundedPreceding, 0))
    return df.drop(name).withColumn(name, F.when(holds, running))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], cut: Column, name: str = "island") -> DataFrame:
    """Numbers from 0 of the stretches that begin at cuts; a cut at the first row opens no second one."""
    w = over(keys, *order)
    opens = F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce(cut, F.lit(False)).cast("int"))
    return df.withColumn("_opens", opens).withColumn(name, F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def neighbour_median(value: str, keys: Sequence[str], order: Sequence[str], reach: int = 4) -> Column:
    """Median of up to `reach` rows on either side, the row itself left out; NULL without any."""
    w = over(keys, *order)
    around = F.concat(F.collect_list(value).over(w.rowsBetween(-reach, -1)), F.collect_list(value).over(w.rowsBetween(1, reach)))
    ranked, n = F.array_sort(around), F.size(around)
    low, high = F.get(ranked, F.floor((n - 1) / 2).cast("int")), F.get(ranked, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def spikes(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, ratio: float = 2.5, least: float = 8.0, reach: int = 4,
    name: str = "is_cut") -> DataFrame:
    """Rows that jump: at least `least`, and `ratio` times their neighbours' median (taken as 1 at least); never the first row."""
    base = F.greatest(F.coalesce(neighbour_median(value, keys, order, reach), F.lit(0.0)), F.lit(1.0))
    jump = (F.col(value) >= least) & (F.col(value) >= ratio * base) & (F.row_number().over(over(keys, *order)) > 1)
    return df.withColumn(name, F.coalesce(jump, F.lit(False)))


def local_jumps(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, known: str, ratio: float = 2.0, least: float = 4.0,
    reach: int = 4, name: str = "is_candidate") -> DataFrame:
    """Weaker jumps that may be cuts missed: greatest of the three rows around, at least `least` and `ratio` times the
    neighbours' median, neither the first row nor within one row of a cut known."""
    w = over(keys, *order)
    top = F.max(value).over(w.rowsBetween(-1, 1))
    near = F.max(F.coalesce(F.col(known), F.lit(False)).cast("int")).over(w.rowsBetween(-1, 1)) == 1
    base = F.greatest(neighbour_median(value, keys, order, reach), F.lit(1e-6))
    found = (F.col(value) >= least) & (F.col(value) >= ratio * base) & (F.col(value) == top) & ~near & (F.row_number().over(w) > 1)
    return df.withColumn(name, F.coalesce(found, F.lit(False)))


def running_median(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, reach: int = 2, name: str = "median") -> DataFrame:
    """Centred median of 2 * reach + 1 values, the first and last repeated beyond the ends."""
    w = over(keys, *order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = (F.collect_list(value).over(w.rowsBetween(*r)) for r in ((-reach, -1), (1, reach)))
    pad = lambda edge, have: F.array_repeat(edge, F.lit(reach) - F.size(have))
    around = F.concat(pad(F.first(value).over(whole), before), before, F.array(value), after, pad(F.last(value).over(whole), after))
    return df.withColumn(name, F.get(F.array_sort(around), reach))


def flips(df: DataFrame, keys: Sequence[str], order: str, reading: str, change: str, reach: int = 3, level: float = 0.5) -> DataFrame:
    """Where the running median of a reading crosses `level`: the row (by `order`) with the greatest change within `reach`."""
    smooth = running_median(df, keys, [order], reading, name="_m")
    w = over(keys, order)
    near = F.collect_list(F.struct(F.col(change).alias("c"), (-F.col(order)).alias("o"))).over(w.rowsBetween(-reach, reach))
    crossed = (F.col("_m") >= level) != (F.lag("_m").over(w) >= level)
    return smooth.withColumn("_at", -F.array_max(near)["o"]).withColumn("_x", crossed).filter("_x").select(*keys,
        F.col("_at").alias(order)).distinct()


def grouped_shots(samples: DataFrame, keys: Sequence[str], time: str, change: str, tilt: str, step: float = 0.4, threshold: float = 15.0,
    least: float = 3.0, cut: Column | None = None) -> DataFrame:
    """Samples -> shots: shot_index, start, duration, tilt (median of the middle half), samples, cut_diff.

    Shots shorter than `least` are put to the one before; a first short one stays.
    """
    runs = islands(samples, keys, [time], cut if cut is not None else F.col(change) > threshold, "_run")
    w = over([*keys, "_run"], time)
    n, k = F.count("*").over(Window.partitionBy(*keys, "_run")), F.row_number().over(w) - 1
    low = F.floor(n / 4)
    core = (k >= low) & (k < F.greatest(low + 1, F.floor(3 * n / 4)))
    marked = runs.withColumn("_core", core)
    value = F.when(F.col("_core") & ~F.isnan(tilt), F.col(tilt))
    raw = marked.groupBy(*keys, "_run").agg(F.min(time).alias("start"), (F.max(time) - F.min(time) + step).alias("duration"),
        F.round(F.percentile(value, 0.5), 1).alias("tilt"), F.count("*").alias("samples"), F.min_by(change, time).alias("cut_diff"))
    raw = raw.withColumn("cut_diff", F.when(F.col("_run") > 0, F.col("cut_diff")))
    return absorb_short(raw, keys, "start", "duration", least)


def absorb_short(shots: DataFrame, keys: Sequence[str], start: str, duration: str, least: float) -> DataFrame:
    """Shots with those shorter than `least` put to the one before. Whether a shot stays depends on its own length only,
    so one running count says which it belongs to."""
    w = over(keys, start)
    stays = (F.row_number().over(w) == 1) | (F.col(duration) >= least)
    homes = shots.withColumn("_stays", stays.cast("int")).withColumn("shot_index",
        F.sum("_stays").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    first = {c: F.min_by(c, start).alias(c) for c in ("tilt", "cut_diff") if c in shots.columns}
    sums = [F.sum("samples").alias("samples")] if "samples" in shots.columns else []
    end = F.max(F.col(start) + F.col(duration))
    return homes.groupBy(*keys, "shot_index").agg(F.min(start).alias(start), (end - F.min(start)).alias(duration), *first.values(), *sums)


def merged_runs(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Runs of equal values: run, value, first and last of order, rows."""
    w = over(keys, order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return islands(df, keys, [order], changed, "run").groupBy(*keys, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"),
        F.count("*").alias("rows"))


def paired(df: DataFrame, keys: Sequence[str], order: str, value: str, strict: bool = False) -> DataFrame:
    """Rows (1, 2), (3, 4), ... as pairs: pair, value_1, value_2, order_1, order_2; an odd last row goes. strict: an error if
    both of a pair have one value."""
    rank = F.row_number().over(over(keys, order)) - 1
    pairs = df.withColumn("_r", rank).withColumn("pair", F.floor(F.col("_r") / 2)).groupBy(*keys, "pair").agg(
        F.count("*").alias("_n"), *(F.max(F.when(F.col("_r") % 2 == k, F.col(c))).alias(f"{c}_{k + 1}") for c in (value, order) for k in (0, 1)))
    full = pairs.filter("_n = 2").drop("_n")
    if strict:
        full = full.filter(F.when(F.col(f"{value}_1").eqNullSafe(F.col(f"{value}_2")),
            F.raise_error(F.lit("both of a pair are alike"))).otherwise(True))
    return full


def longest_run(df: DataFrame, keys: Sequence[str], order: str, flag: Column, most_gap: int) -> DataFrame:
    """For each key the longest stretch of true rows, up to most_gap false ones in a row inside; the earliest of equals. By row number: first, last, length."""
    numbered = df.withColumn("_i", F.row_number().over(over(keys, order)).cast("long")).withColumn("_f", F.coalesce(flag, F.lit(False)))
    true = numbered.filter("_f")
    runs = islands(true, keys, ["_i"], F.col("_i") - F.lag("_i").over(over(keys, "_i")) > most_gap + 1, "_run")
    sizes = runs.groupBy(*keys, "_run").agg(F.min("_i").alias("first"), F.max("_i").alias("last"))
    best = sizes.groupBy(*keys).agg(
        F.max(F.struct((F.col("last") - F.col("first") + 1).alias("length"), (-F.col("first")).alias("_f"), F.col("last").alias("last"))).alias("m"))
    return best.select(*keys, (-F.col("m._f")).alias("first"), F.col("m.last").alias("last"), F.col("m.length").alias("length"))


def grown_run(df: DataFrame, keys: Sequence[str], order: str, weak: Column, seeds: DataFrame, most_gap: int) -> DataFrame:
    """seeds (keys, first, last as longest_run gives them), each widened through weak rows over gaps of up to most_gap."""
    numbered = df.withColumn("_i", F.row_number().over(over(keys, order)).cast("long"))
    inside = F.col("_i").between(F.col("first"), F.col("last"))
    flagged = numbered.join(seeds.select(*keys, "first", "last"), list(keys)).filter(F.coalesce(weak, F.lit(False)) | inside).withColumn("_in",
        inside)
    runs = islands(flagged, keys, ["_i"], F.col("_i") - F.lag("_i").over(over(keys, "_i")) > most_gap + 1, "_run")
    grown = runs.groupBy(*keys, "_run").agg(F.min("_i").alias("first"), F.max("_i").alias("last"), F.max("_in").alias("_in"))
    return grown.filter("_in").drop("_run", "_in")


def rolling_mean(df: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], reach: int = 2) -> DataFrame:
    """<value>_s: means over the rows within `reach` of `at`, so that gaps don't count as rows."""
    w = over(keys, at).rangeBetween(-reach, reach)
    return df.withColumns({f"{v}_s": F.avg(v).over(w) for v in values})


def speeds(df: DataFrame, keys: Sequence[str], at: str, x: str, y: str, rate: float, most_gap: int = 2) -> DataFrame:
    """Distance from the row before, per second; NULL over gaps of more than most_gap."""
    w = over(keys, at)
    gap = F.col(at) - F.lag(at).over(w)
    far = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    return df.withColumn("speed", F.when(gap <= most_gap, far / gap * rate))


def smoothed_tracks(positions: DataFrame, keys: Sequence[str], rate: float = 25.0, reach: int = 2) -> DataFrame:
    """x_yd_s, y_yd_s and speed of tracks with one row for each frame (of repeated frames one stays)."""
    once = positions.dropDuplicates([*keys, "frame"])
    return speeds(rolling_mean(once, keys, "frame", ["x_yd", "y_yd"], reach), keys, "frame", "x_yd_s", "y_yd_s", rate)


def first_sustained(df: DataFrame, keys: Sequence[str], order: str, value: str, above: float, hold: int, below: float) -> DataFrame:
    """For each key the row after the last one under `below` that comes before the first `hold` rows in a row over `above`; NULL
    if there is no such start or nothing was under `below` before it."""
    w = over(keys, order)
    fast = F.coalesce(F.col(value) > above, F.lit(False)).cast("int")
    ahead = w.rowsBetween(0, hold - 1)
    held = (F.min("_fast").over(ahead) == 1) & (F.count("*").over(ahead) == hold)
    marked = df.withColumn("_fast", fast).withColumn("_held", held).withColumn("_next", F.lead(order).over(w))
    start = marked.groupBy(*keys).agg(F.min(F.when(F.col("_held"), F.col(order))).alias("_start"))
    still = marked.join(start, list(keys)).filter((F.col(value) < below) & (F.col(order) < F.col("_start")))
    after = still.groupBy(*keys).agg(F.max(F.struct(order, "_next")).alias("m")).select(*keys, F.col("m._next").alias("found"))
    return start.join(after, list(keys), "left").select(*keys, F.col("_start").alias("sustained"), "found")


def snaps(positions: DataFrame, keys: Sequence[str], rate: float, above: float = 2.0, hold_s: float = 0.4, below: float = 0.5) -> DataFrame:
    """The snap of each take, from the players' median speed by frame."""
    medians = positions.filter((F.col("label") == "player") & F.col("speed").isNotNull()).groupBy(*keys,
        "frame").agg(F.percentile("speed", 0.5).alias("median"))
    return first_sustained(medians, keys, "frame", "median", above, max(1, round(hold_s * rate)), below).select(*keys, F.col("found").alias("snap"))


def filled_gaps(df: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], most_gap: float, cuts: DataFrame | None = None,
    blank: Sequence[str] = ()) -> DataFrame:
    """df with `filled` false, and with rows for the whole steps of `at` that gaps of up to most_gap leave out: values on the
    straight line between the two sides, columns of `blank` NULL, others as before the gap, `filled` true. cuts (keys of it,
    cut): gaps with before < cut <= after stay."""
    w = over(keys, at)
    gaps = df.withColumn("_after",
        F.lead(F.struct(at, *values)).over(w)).filter((F.col("_after")[at] - F.col(at) > 1) & (F.col("_after")[at] - F.col(at) - 1 <= most_gap))
    if cuts is not None:
        shared = [k for k in keys if k in cuts.columns]
        inside = (F.col("_c.cut") > F.col("_g." + at)) & (F.col("_c.cut") <= F.col("_g._after")[at])
        for k in shared:
            inside = inside & (F.col("_g." + k) == F.col("_c." + k))
        gaps = gaps.alias("_g").join(cuts.alias("_c"), inside, "left_anti")
    steps = gaps.withColumn("_at", F.explode(F.sequence(F.col(at) + 1, F.col("_after")[at] - 1)))
    share = (F.col("_at") - F.col(at)) / (F.col("_after")[at] - F.col(at))
    made = {v: F.col(v) * (1 - share) + F.col("_after")[v] * share for v in values}
    new = steps.select(*(F.col("_at").alias(c) if c == at else made[c].alias(c) if c in made else F.lit(None).cast(df.schema[c].dataType).alias(c)
        if c in blank else F.col(c) for c in df.columns), F.lit(True).alias("filled"))
    return df.withColumn("filled", F.lit(False)).unionByName(new)


def changes_counted(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "drive") -> DataFrame:
    """Numbers that go up when the value changes; NULL changes nothing."""
    w = over(keys, order)
    before = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col(value).isNotNull() & ~F.col(value).eqNullSafe(before)
    return df.withColumn("_new", new.cast("long")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def jump_flags(df: DataFrame, keys: Sequence[str], order: str, change: str, least: float = 12.0, ratio: float = 4.0, window: int = 15,
    name: str = "is_cut") -> DataFrame:
    """Changes above `least` and `ratio` times the median of the last `window` ones."""
    recent = F.percentile(change, 0.5).over(over(keys, order).rowsBetween(-window, -1))
    return df.withColumn(name, F.coalesce(F.col(change) > F.greatest(F.lit(least), ratio * F.coalesce(recent, F.lit(0.0))), F.lit(False)))


def array_change(df: DataFrame, keys: Sequence[str], order: str, values: str, name: str = "diff") -> DataFrame:
    """Mean absolute difference of an array to the row before; 0 for the first."""
    before = F.lag(values).over(over(keys, order))
    total = F.aggregate(F.zip_with(values, before, lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn(name, F.when(before.isNull(), F.lit(0.0)).otherwise(total / F.size(values)))


def count_guided_merge(shots: DataFrame, keys: Sequence[str], order: str, view: str, jump: str, wanted: str) -> DataFrame:
    """Shots with `home`, numbers from 0 after merging the weakest borders between shots of one view until `wanted` are left."""
    w = over(keys, order)
    same = F.col(view).eqNullSafe(F.lag(view).over(w)) & (F.row_number().over(w) > 1)
    need = F.count("*").over(Window.partitionBy(*keys)) - F.col(wanted)
    marked = shots.withColumn("_same", same).withColumn("_need", need)
    rank = F.row_number().over(Window.partitionBy(*keys, "_same").orderBy(F.coalesce(F.col(jump), F.lit(0.0)), order))
    ranked = marked.withColumn("_merge", F.col("_same") & (rank <= F.col("_need")))
    return islands(ranked, keys, [order], ~F.col("_merge"), "home").drop("_same", "_need", "_merge")


def replaced_outliers(df: DataFrame, keys: Sequence[str], order: str, value: str, bad: Column) -> DataFrame:
    """Bad values become the straight line between the good ones around; at the ends the nearest good one."""
    w = over(keys, order)
    good = F.when(~F.coalesce(bad, F.lit(False)), F.struct(F.col(order).alias("t"), F.col(value).alias("v")))
    marked = df.withColumn("_g", good)
    back = F.last("_g", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_g", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    share = F.try_divide(F.col(order) - F.col("_b.t"), F.col("_a.t") - F.col("_b.t"))
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * F.coalesce(share, F.lit(0.0))
    return marked.withColumns({"_b": back, "_a": ahead}).withColumn(value, F.coalesce(line, F.col("_b.v"), F.col("_a.v"))).drop("_g", "_b", "_a")


def rolling_outliers(df: DataFrame, keys: Sequence[str], order: str, value: str, reach: int, most: float, least_rows: int = 5,
    name: str = "is_bad") -> DataFrame:
    """Values further than `most` from the median of the rows within `reach`, where there are enough rows."""
    w = over(keys, order).rowsBetween(-reach, reach)
    far = F.abs(F.col(value) - F.percentile(value, 0.5).over(w)) > most
    return df.withColumn(name, F.coalesce(far & (F.count(value).over(w) >= least_rows), F.lit(False)))


def resampled(df: DataFrame, keys: Sequence[str], tick: str, value: str) -> DataFrame:
    """Values at every whole tick from the first to the last, on the straight line between the rows around."""
    w = over(keys, tick)
    spans = df.select(*keys, tick, value, F.lead(tick).over(w).alias("_t"), F.lead(value).over(w).alias("_v"))
    stop = F.coalesce(F.ceil("_t") - 1, F.floor(F.col(tick)))
    steps = spans.filter(F.ceil(F.col(tick)) <= stop).withColumn("_k", F.explode(F.sequence(F.ceil(F.col(tick)), stop)))
    share = F.coalesce(F.try_divide(F.col("_k") - F.col(tick), F.col("_t") - F.col(tick)), F.lit(0.0))
    return steps.select(*keys, F.col("_k").alias(tick), (F.col(value) + F.coalesce(F.col("_v") - F.col(value), F.lit(0.0)) * share).alias(value))


def trimmed_span(start: Column, end: Column, cuts: Column, rate: float, edge_s: float = 1.0) -> Column:
    """A span without what lies beyond a cut near either end; a cut trims the end that it is nearer to."""
    edge = edge_s * rate
    begin = F.array_max(F.filter(cuts, lambda c: (c - start <= edge) & (c - start < end - c)))
    stop = F.array_min(F.filter(cuts, lambda c: (end - c <= edge) & (end - c <= c - start)))
    return F.struct(F.coalesce(begin, start).alias("start"), F.coalesce(stop, end).alias("end"))
