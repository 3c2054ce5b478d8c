"""Operators over tracked boxes: votes, summaries, ends, joining of broken tracks, distances."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.geometry import predicted_miss
from fieldglass.operators.sequence import islands, over

LEAD, MOST_GAP_S, REACH, REACH_PER_S, WIDE = 10, 1.0, 0.6, 1.0, 1.9
FRAGMENT_GAP_S, FRAGMENT_DISTANCE = 2.0, 1.5
OFF_LEAST, OFF_SHARE, UNSURE = 2, 0.5, 0.25
SWAP_RUN, SWAP_AGREE, SWAP_STRONG = 4, 0.75, 0.5


def dominant(df: DataFrame, keys: Sequence[str], label: str, weight: str, name: str = "label") -> DataFrame:
    """The label with the greatest summed weight of each key; of equal ones the last in order."""
    sums = df.groupBy(*keys, label).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(*keys).agg(F.max(F.struct(F.col("_w").alias("w"), F.col(label).alias("l"))).alias("m")).select(*keys,
        F.col("m.l").alias(name), F.col("m.w").alias("weight"))


def track_summaries(boxes: DataFrame, keys: Sequence[str], at: str = "frame", conf: str = "conf") -> DataFrame:
    """first, last, seen, coverage (share of the span seen), gaps, mean_conf and confidence = mean_conf * coverage."""
    gap = (F.col(at) - F.lag(at).over(over(keys, at)) > 1).cast("long")
    out = boxes.withColumn("_gap", F.coalesce(gap, F.lit(0))).groupBy(*keys).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("seen"), F.sum("_gap").alias("gaps"), F.avg(conf).alias("mean_conf"))
    coverage = F.col("seen") / (F.col("last") - F.col("first") + 1)
    return out.withColumns({"coverage": coverage, "confidence": F.col("mean_conf") * coverage})


def track_ends(boxes: DataFrame, keys: Sequence[str], lead: int = LEAD) -> DataFrame:
    """Each track's two ends: first, last; start and finish (x, y, vx, vy, h): the feet, their speed by a straight line through
    `lead` rows (0 of fewer than 3), and the median height there; and ratio, the median width by height."""
    x, y, h = (F.col("x1") + F.col("x2")) / 2, F.col("y2"), F.col("y2") - F.col("y1")
    up, down = F.row_number().over(over(keys, F.asc("frame"))), F.row_number().over(over(keys, F.desc("frame")))
    rows = boxes.select(*keys, "frame", x.alias("_x"), y.alias("_y"), h.alias("_h"), ((F.col("x2") - F.col("x1")) / h).alias("_r"), up.alias("_up"),
        down.alias("_down"))

    def end(rank: str) -> Column:
        mine = F.col(rank) <= lead
        at = lambda c: F.max(F.when(F.col(rank) == 1, F.col(c)))
        slope = lambda c: F.when(F.count_if(mine) >= 3,
            F.coalesce(F.regr_slope(F.when(mine, F.col(c)), F.when(mine, F.col("frame"))), F.lit(0.0))).otherwise(F.lit(0.0))
        return F.struct(at("_x").alias("x"), at("_y").alias("y"), slope("_x").alias("vx"), slope("_y").alias("vy"),
            F.percentile(F.when(mine, F.col("_h")), 0.5).alias("h"))

    return rows.groupBy(*keys).agg(F.min("frame").alias("first"), F.max("frame").alias("last"), end("_up").alias("start"),
        end("_down").alias("finish"), F.percentile("_r", 0.5).alias("ratio"))


def _ends_of(column: str) -> dict[str, Column]:
    return {k: F.col(f"{column}.{k}") for k in ("x", "y", "vx", "vy", "h")}


def link_candidates(ends: DataFrame, group: Sequence[str], track: str, rate: float, cuts: DataFrame | None = None,
    most_gap_s: float = MOST_GAP_S) -> DataFrame:
    """Pairs (earlier, later, miss) of tracks that may be one: the same group (take and label), teams not opposed, a gap of up to
    most_gap_s without a cut, neither wide, and ends that predict each other. ends: track_ends with a column team (-1 or NULL unknown).

    The later's first frame lies in the cell of the earlier's last or in one of the next, so the join is on equality.
    """
    reach = max(1, int(most_gap_s * rate))
    cell = lambda c: F.floor(F.col(c) / reach)
    narrow = ends.filter(F.col("ratio") < WIDE)
    a = narrow.select(*group, F.col(track).alias("earlier"), F.col("last").alias("_last"), F.col("finish").alias("_fin"), F.col("team").alias("_ta"),
        F.explode(F.sequence(cell("last"), cell("last") + 1)).alias("_cell"))
    b = narrow.select(*group, F.col(track).alias("later"), F.col("first").alias("_first"), F.col("start").alias("_sta"), F.col("team").alias("_tb"),
        cell("first").alias("_cell"))
    gap = F.col("_first") - F.col("_last")
    opposed = (F.coalesce("_ta", F.lit(-1)) >= 0) & (F.coalesce("_tb", F.lit(-1)) >= 0) & (F.col("_ta") != F.col("_tb"))
    pairs = a.join(b, [*group, "_cell"]).filter((gap > 0) & (gap <= most_gap_s * rate) & ~opposed).withColumn("miss",
        predicted_miss(_ends_of("_fin"), _ends_of("_sta"), gap))
    near = pairs.filter(F.col("miss") <= REACH + REACH_PER_S * gap / rate)
    if cuts is not None:
        keys = [k for k in group if k in cuts.columns]
        on = (F.col("_c.cut") > F.col("_p._last")) & (F.col("_c.cut") <= F.col("_p._first"))
        for k in keys:
            on = on & (F.col(f"_p.{k}") == F.col(f"_c.{k}"))
        near = near.alias("_p").join(cuts.alias("_c"), on, "left_anti")
    return near.select(*group, "earlier", "later", "miss")


def chained(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    """(earlier, later, miss) -> track, root: pairs are taken from the least miss on, each end once; chains go by their first
    track. One group (a take's tracks of a label) is ordered in one task, as each choice hangs on those before."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ahead: dict = {}
        taken: set = set()
        for row in frame.sort_values(["miss", "earlier", "later"]).itertuples():
            if row.later not in ahead and row.earlier not in taken:
                ahead[row.later] = row.earlier
                taken.add(row.earlier)

        def root(track):
            while track in ahead:
                track = ahead[track]
            return track

        out = pd.DataFrame({"track": list(ahead), "root": [root(t) for t in ahead]})
        for g in group:
            out[g] = frame[g].iloc[0]
        return out[[*group, "track", "root"]]

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = ", ".join([f"{g} {kinds[g]}" for g in group] + [f"track {kinds['later']}", f"root {kinds['later']}"])
    return pairs.groupBy(*group).applyInPandas(run, schema)


def stitched(boxes: DataFrame, take: Sequence[str], teams: DataFrame, rate: float, cuts: DataFrame | None = None) -> DataFrame:
    """boxes (track_id, label, frame, x1, y1, x2, y2, off_field) with the ids of joined tracks' first ones; off-field tracks stay apart."""
    on = boxes.filter(~F.coalesce("off_field", F.lit(False)))
    ends = track_ends(on, [*take, "track_id", "label"]).join(teams, [*take, "track_id"], "left")
    roots = chained(link_candidates(ends, [*take, "label"], "track_id", rate, cuts), [*take, "label"]).select(*take,
        F.col("track").alias("track_id"), "root")
    return boxes.join(roots, [*take, "track_id"], "left").withColumn("track_id", F.coalesce("root", "track_id")).drop("root").select(boxes.columns)


def joined_teams(roots: DataFrame, teams: DataFrame, take: Sequence[str]) -> DataFrame:
    """The team of each joined track: the first known one of its parts."""
    homes = teams.join(roots.select(*take, F.col("track").alias("track_id"), "root"), [*take, "track_id"], "left")
    known = F.when(F.col("team") >= 0, F.struct("track_id", "team"))
    return homes.groupBy(*take, F.coalesce("root", "track_id").alias("track_id")).agg(F.coalesce(F.min(known)["team"], F.lit(-1)).alias("team"))


def fragments(ends: DataFrame, group: Sequence[str], track: str, rate: float) -> DataFrame:
    """Tracks that begin within FRAGMENT_GAP_S of another of their group ending, within FRAGMENT_DISTANCE of its heights."""
    width = max(1, int(FRAGMENT_GAP_S * rate))
    cell = lambda c: F.floor(F.col(c) / width)
    ended = ends.select(*group, F.col(track).alias("_id"), F.col("last").alias("_last"), F.col("finish").alias("_f"),
        F.explode(F.sequence(cell("last"), cell("last") + 1)).alias("_cell"))
    begun = ends.withColumn("_cell", cell("first"))
    gap = F.col("first") - F.col("_last")
    near = F.hypot(F.col("_f.x") - F.col("start.x"), F.col("_f.y") - F.col("start.y")) <= FRAGMENT_DISTANCE * F.col("_f.h")
    same = (begun["_cell"] == ended["_cell"]) & (gap > 0) & (gap <= width) & near
    for g in group:
        same = same & (begun[g] == ended[g])
    return begun.join(ended, same, "left_semi").drop("_cell")


def team_votes(margins: DataFrame, tracks: DataFrame, keys: Sequence[str], unsure: float = UNSURE) -> DataFrame:
    """Each track's team: whether the median of its confident margins is above 0; -1 without any."""
    sure = margins.filter(F.abs("margin") >= unsure).groupBy(*keys).agg((F.percentile("margin", 0.5) > 0).cast("int").alias("team"))
    return tracks.select(*keys).distinct().join(sure, list(keys), "left").withColumn("team", F.coalesce("team", F.lit(-1)))


def off_field_tracks(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tracks that most votes, and OFF_LEAST of them, put off the field. votes: keys, off."""
    off = F.sum(F.coalesce(F.col("off"), F.lit(False)).cast("int"))
    return votes.groupBy(*keys).agg(((off >= OFF_LEAST) & (off >= OFF_SHARE * F.count("*"))).alias("off_field"))


def swap_frames(margins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames (cut) from which a track follows someone else: its confident margins are split where most agree with their
    side's median, both sides long, agreeing and strong; either side is split again. One track in one call."""

    def split(m: np.ndarray, low: int, high: int) -> Iterator[int]:
        scored = []
        for k in range(low + SWAP_RUN, high - SWAP_RUN + 1):
            sides = m[low:k], m[k:high]
            middle = [np.median(s) for s in sides]
            if middle[0] * middle[1] < 0 and min(map(abs, middle)) >= SWAP_STRONG:
                agree = [int((np.sign(s) == np.sign(c)).sum()) for s, c in zip(sides, middle, strict=True)]
                if all(a >= SWAP_AGREE * len(s) for a, s in zip(agree, sides, strict=True)):
                    scored.append((-sum(agree), k))
        if scored:
            k = min(scored)[1]
            yield from split(m, low, k)
            yield k
            yield from split(m, k, high)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("frame")
        f, m = frame["frame"].to_numpy(), frame["margin"].to_numpy(float)
        cuts = [int(f[k - 1] + f[k]) // 2 for k in split(m, 0, len(m))]
        return pd.DataFrame({**{k: [frame[k].iloc[0]] * len(cuts) for k in keys}, "cut": np.array(cuts, np.int64)})

    kinds = {f.name: f.dataType.simpleString() for f in margins.schema}
    return margins.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", cut long")


def kinematics(positions: DataFrame, keys: Sequence[str], at: str, x: str, y: str, rate: float) -> DataFrame:
    """Total distance and greatest speed of each track."""
    w = over(keys, at)
    step = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    rows = positions.withColumns({"_step": step, "_speed": F.try_divide(step * rate, F.col(at) - F.lag(at).over(w))})
    return rows.groupBy(*keys).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("distance"),
        F.coalesce(F.max("_speed"), F.lit(0.0)).alias("top_speed"))


def separations(positions: DataFrame, frame: Sequence[str], target: Column, opponent: Column, track: str = "track_id") -> DataFrame:
    """For each frame and target the nearest opponent: nearest, distance. A frame holds a few players, so pairs stay few."""
    of = lambda c, p: positions.filter(c).select(*frame, F.col(track).alias(p), F.col("x_yd").alias(f"_x{p}"),
        F.col("y_yd").alias(f"_y{p}"))
    far = F.hypot(F.col("_xtarget") - F.col("_xother"), F.col("_ytarget") - F.col("_yother"))
    pairs = of(target, "target").join(of(opponent, "other"), list(frame)).withColumn("_d", far)
    return pairs.groupBy(*frame, "target").agg(F.min(F.struct("_d", "other")).alias("m")).select(*frame, "target", F.col("m.other").alias("nearest"),
        F.col("m._d").alias("distance"))


def separation_summaries(series: DataFrame, keys: Sequence[str], at: str = "frame", rate: float = 25.0, close: float = 2.0) -> DataFrame:
    """least, mean, the first frame within `close`, and the greatest closing speed, read only between frames with one counterpart."""
    w = over(keys, at)
    same = F.col("nearest") == F.lag("nearest").over(w)
    closing = F.when(same, (F.lag("distance").over(w) - F.col("distance")) * rate / (F.col(at) - F.lag(at).over(w)))
    return series.withColumn("_c", closing).groupBy(*keys).agg(
        F.min("distance").alias("least"), F.avg("distance").alias("mean"), F.min(F.when(F.col("distance") <= close, F.col(at))).alias("first_close"),
        F.max("_c").alias("closing_speed"))


def labels_redone(boxes: DataFrame, derived: Sequence[str] = ("team", "off_field", "filled")) -> DataFrame:
    """Tracked boxes as they were before filling and voting."""
    rows = boxes.filter(~F.coalesce("filled", F.lit(False))) if "filled" in boxes.columns else boxes
    return rows.drop(*derived)


def moving_people(boxes: DataFrame, keys: Sequence[str], least_frames: int, ratios: tuple[float, float]) -> DataFrame:
    """Boxes of players on the field with a team, of tracks seen in enough frames and of a plausible median height by width."""
    rows = boxes.filter((F.col("label") == "player") & (F.col("team") >= 0) & ~F.coalesce("off_field", F.lit(False)))
    ratio = F.percentile((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")), 0.5)
    kept = rows.groupBy(*keys).agg(ratio.alias("_r"),
        F.countDistinct("frame").alias("_n")).filter((F.col("_n") >= least_frames) & F.col("_r").between(*ratios))
    return rows.join(kept, list(keys), "left_semi")


def count_islands(df: DataFrame, keys: Sequence[str], order: str, gap: float) -> DataFrame:
    """Stretches without a gap of over `gap`: island, first, last, rows."""
    cut = F.col(order) - F.lag(order).over(over(keys, order)) > gap
    return islands(df, keys, [order], cut).groupBy(*keys, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"),
        F.count("*").alias("rows"))


def median_cameras(cameras: DataFrame, keys: Sequence[str], centre: str = "centre", least: int = 5) -> DataFrame:
    """The element-wise median of camera centres (arrays of 3); NULL of fewer than `least`."""
    middle = F.array(*(F.percentile(F.get(F.col(centre), k), 0.5) for k in range(3)))
    return cameras.groupBy(*keys).agg(F.when(F.count(centre) >= least, middle).alias(centre))


def modal_shift(frames: DataFrame, keys: Sequence[str], shift: str, residual: str) -> DataFrame:
    """The shift most frames give (the least of equal ones), the share of frames that give it, and their median residual."""
    best = F.mode(shift, True)
    chosen = frames.groupBy(*keys).agg(best.alias("shift"), F.count("*").alias("frames"))
    both = frames.withColumnRenamed(shift, "_s").withColumnRenamed(residual, "_r").join(chosen, list(keys)).filter("_s = shift")
    return both.groupBy(*keys, "shift", "frames").agg((F.count("*") / F.first("frames")).alias("agree"), F.percentile("_r", 0.5).alias("residual"))


def club_of_team(takes: DataFrame, keys: Sequence[str], error_if_away: Column, error_if_home: Column) -> DataFrame:
    """Which of two assignments of teams to clubs has the least summed error."""
    sums = takes.groupBy(*keys).agg(F.sum(F.abs(error_if_away)).alias("away"), F.sum(F.abs(error_if_home)).alias("home"))
    return sums.select(*keys, F.when(F.col("away") <= F.col("home"), "away").otherwise("home").alias("club"), F.least("away", "home").alias("error"))

