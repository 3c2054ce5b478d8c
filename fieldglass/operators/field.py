"""Field registration from point and line tables: homographies by robust fits, the line of scrimmage, chaining of steps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.functions.geometry import END_ZONE, FIELD_LENGTH, FIELD_WIDTH, STEP, anchor, in_field, through, turf

PIXELS, TRIES, LEAST_INLIERS, FRONT, AGREE_YD, REACH_S = 5.0, 300, 0.8, 3, 1.0, 4.0


def solved_homography(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """The least-squares homography of at least 4 points, on normalised coordinates; None if they don't determine one."""
    def normal(p: np.ndarray) -> np.ndarray:
        middle = p.mean(axis=0)
        far = np.hypot(*(p - middle).T).mean()
        s = np.sqrt(2) / far if far > 1e-12 else 1.0
        return np.array([[s, 0, -s * middle[0]], [0, s, -s * middle[1]], [0, 0, 1]])

    if len(source) < 4:
        return None
    a, b = normal(source), normal(target)
    p, q = (np.c_[x, np.ones(len(x))] @ n.T for x, n in ((source, a), (target, b)))
    zero = np.zeros_like(p)
    rows = np.vstack([np.hstack([p, zero, -q[:, :1] * p]), np.hstack([zero, p, -q[:, 1:2] * p])])
    _, size, v = np.linalg.svd(rows)
    if len(size) > 7 and size[7] < 1e-9 * size[0]:
        return None
    h = np.linalg.inv(b) @ v[-1].reshape(3, 3) @ a
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def mapped_points(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.c_[p, np.ones(len(p))] @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return q[:, :2] / q[:, 2:]


def robust_homography(image: np.ndarray, field: np.ndarray, most_px: float = PIXELS, tries: int = TRIES, seed: int = 0) -> tuple[np.ndarray,
    np.ndarray] | None:
    """(field to image homography, which pairs fit it): the largest agreement among fits of 4 random pairs, refitted three times."""
    rng, best = np.random.default_rng(seed), None
    if len(image) < 4:
        return None
    fits = lambda h: np.nan_to_num(np.hypot(*(mapped_points(h, field) - image).T), nan=np.inf) <= most_px
    for _ in range(tries if len(image) > 4 else 1):
        pick = rng.choice(len(image), 4, replace=False)
        h = solved_homography(field[pick], image[pick])
        if h is not None and (best is None or fits(h).sum() > best.sum()):
            best = fits(h)
    for _ in range(3):
        if best is None or best.sum() < 4:
            return None
        h = solved_homography(field[best], image[best])
        if h is None:
            return None
        best = fits(h)
    return h, best


def registered(pairs: DataFrame, keys: Sequence[str], share: float = LEAST_INLIERS) -> DataFrame:
    """Point pairs (img_x, img_y, fld_x, fld_y) of each frame -> h (image to field, array of 9), inliers, pairs, rms in pixels; frames
    of which too few pairs agree are left out."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        image, field = frame[["img_x", "img_y"]].to_numpy(float), frame[["fld_x", "fld_y"]].to_numpy(float)
        fit = robust_homography(image, field)
        rows = []
        if fit is not None and fit[1].mean() >= share:
            h, ok = fit
            miss = np.hypot(*(mapped_points(h, field[ok]) - image[ok]).T)
            back = np.linalg.inv(h)
            rows.append([frame[k].iloc[0] for k in keys]
                + [(back / back[2, 2]).ravel().tolist(), int(ok.sum()), len(ok), float(np.sqrt((miss**2).mean()))])
        return pd.DataFrame(rows, columns=[*keys, "h", "inliers", "pairs", "rms"])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.groupBy(*keys).applyInPandas(run,
        ", ".join(f"{k} {kinds[k]}" for k in keys) + ", h array<double>, inliers long, pairs long, rms double")


def field_positions(boxes: DataFrame, homographies: DataFrame, frame: Sequence[str], margin: float = 1.0) -> DataFrame:
    """Boxes of frames that have a homography, with x_yd and y_yd of their feet; those off the field are left out."""
    both = boxes.join(homographies.select(*frame, "h"), list(frame))
    p = through(F.col("h"), (F.col("x1") + F.col("x2")) / 2, F.col("y2"))
    return both.withColumn("_p", p).withColumns({"x_yd": F.col("_p.x"), "y_yd": F.col("_p.y")}).drop("_p",
        "h").filter(F.col("y_yd").between(-margin, 160 / 3 + margin))


def scrimmage_lines(players: DataFrame, keys: Sequence[str], x: str = "x_yd", offense: str = "offense", front: int = FRONT) -> DataFrame:
    """Where the line of scrimmage is, from both teams' places before the snap: keys, line, attack (1 if the offense faces greater x), misplaced.

    For either direction the players of both teams are counted on the wrong side of each gap between players; the gap with the fewest
    wins, the first of equal ones, direction 1 before -1. The line is midway between the `front` foremost players of each side. Frames
    without `front` players a side are left out. All by running counts.
    """
    both = players.select(*keys, F.explode(F.array(F.lit(1), F.lit(-1))).alias("attack"), F.col(x).cast("double").alias("_x"),
        F.col(offense).alias("_o")).withColumn("_z", F.col("attack") * F.col("_x"))
    w = Window.partitionBy(*keys, "attack")
    upto = w.orderBy("_z").rangeBetween(Window.unboundedPreceding, 0)
    counted = both.withColumns({
        "_off": F.count_if(F.col("_o")).over(w), "_def": F.count_if(~F.col("_o")).over(w), "_off_below": F.count_if(F.col("_o")).over(upto),
        "_def_below": F.count_if(~F.col("_o")).over(upto),
        "_next": F.min(F.struct("_z")).over(w.orderBy(F.desc("_z")).rowsBetween(Window.unboundedPreceding, -1))["_z"]}).filter(
        (F.col("_off") >= front) & (F.col("_def") >= front))
    counted = counted.withColumn("_next", F.when(F.col("_z") < F.max("_z").over(w), F.max("_next").over(Window.partitionBy(*keys, "attack", "_z"))))
    # Behind everyone, all of the offense is wrong; after a player, the offense beyond and the defense up to it are.
    after = counted.select(*keys, "attack", (F.col("_off") - F.col("_off_below") + F.col("_def_below")).alias("wrong"),
        F.when(F.col("_next").isNotNull(), (F.col("_z") + F.col("_next")) / 2).otherwise(F.col("_z") + 1).alias("at"))
    before = counted.groupBy(*keys, "attack").agg(F.first("_off").alias("wrong"), (F.min("_z") - 1).alias("at"))
    best = after.unionByName(before).groupBy(*keys).agg(F.min(F.struct("wrong", (-F.col("attack")).alias("o"), "at")).alias("m")).select(*keys,
        F.col("m.wrong").alias("misplaced"), (-F.col("m.o")).alias("attack"), F.col("m.at").alias("_at"))
    sides = counted.join(best, [*keys, "attack"]).filter(F.when(F.col("_o"), F.col("_z") <= F.col("_at")).otherwise(F.col("_z") >= F.col("_at")))
    rank = F.row_number().over(Window.partitionBy(*keys, "_o").orderBy(F.when(F.col("_o"), -F.col("_z")).otherwise(F.col("_z"))))
    fronts = sides.withColumn("_k", rank).filter(F.col("_k") <= front).groupBy(*keys, "attack",
        "misplaced").agg(F.avg(F.when(F.col("_o"), F.col("_z"))).alias("_fo"), F.avg(F.when(~F.col("_o"), F.col("_z"))).alias("_fd"))
    return fronts.filter(F.col("_fo").isNotNull() & F.col("_fd").isNotNull()).select(*keys,
        (F.col("attack") * (F.col("_fo") + F.col("_fd")) / 2).alias("line"), "attack", "misplaced", (F.col("_fd") - F.col("_fo")).alias("gap"))


def anchored_frames(lines: DataFrame, yards_to_goal: str) -> DataFrame:
    """Lines with the shift to the field's own yards, its residual, los_x and ok."""
    return lines.withColumn("_a", anchor(F.col("line"), F.col("attack"), F.col(yards_to_goal))).select(*lines.columns, "_a.*")


def on_field_share(points: DataFrame, keys: Sequence[str], margin: float = 0.0) -> DataFrame:
    return points.groupBy(*keys).agg(F.avg(in_field(F.col("x_yd"), F.col("y_yd"), margin).cast("double")).alias("share"))


def chained_registrations(frames: DataFrame, take: Sequence[str], rate: float, step: float = STEP, agree: float = AGREE_YD,
    reach_s: float = REACH_S) -> DataFrame:
    """Relative frames of a take in one frame of reference.

    frames: frame, drift (yards moved along the field since the frame before, by camera motion) and origin (where a direct
    registration puts its own zero, NULL without one; only known up to whole steps). Each registration is shifted by the whole
    steps that the drift since the one before calls for; one that then disagrees by more than `agree` is dropped. Frames between two
    are put where both sides' drifts blend, by distance; beyond the ends up to reach_s are carried on. Returns frame, x0, source.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame").reset_index(drop=True)
        f, moved = part["frame"].to_numpy(float), part["drift"].fillna(0).to_numpy(float).cumsum()
        place, kept = part["origin"].to_numpy(float).copy(), []
        for i in np.flatnonzero(~np.isnan(place)):
            if kept:
                due = place[kept[-1]] + moved[i] - moved[kept[-1]]
                place[i] += step * np.round((due - place[i]) / step)
                if abs(place[i] - due) > agree:
                    continue
            kept.append(i)
        out, source = np.full(len(f), np.nan), np.full(len(f), None, object)
        if kept:
            k = np.array(kept)
            left, right = np.searchsorted(k, np.arange(len(f)), "right") - 1, np.searchsorted(k, np.arange(len(f)))
            for i in range(len(f)):
                a, b = (k[left[i]] if left[i] >= 0 else None), (k[right[i]] if right[i] < len(k) else None)
                ways = [(abs(f[i] - f[j]), place[j] + moved[i] - moved[j]) for j in (a, b) if j is not None]
                if a == i:
                    out[i], source[i] = place[i], "direct"
                elif len(ways) == 2:
                    (da, xa), (db, xb) = ways
                    out[i], source[i] = (xa * db + xb * da) / (da + db), "between"
                elif ways[0][0] <= reach_s * rate:
                    out[i], source[i] = ways[0][1], "beyond"
        return part.assign(x0=out, source=source).dropna(subset=["x0"])[[*take, "frame", "x0", "source"]]

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    return frames.groupBy(*take).applyInPandas(run,
        ", ".join(f"{k} {kinds[k]}" for k in take) + f", frame {kinds['frame']}, x0 double, source string")


def dash_window(rows: DataFrame, keys: Sequence[str], yard: str, least_share: float = 0.5) -> DataFrame:
    """The longest stretch of whole yards at least half of which have a dash: low, high, dashes; the lowest of equals."""
    once = rows.select(*keys, F.col(yard).cast("int").alias("a")).distinct()
    other = once.withColumnRenamed("a", "b")
    pairs = once.join(other, list(keys)).filter("b >= a")
    inside = pairs.join(once.withColumnRenamed("a", "c"), list(keys)).filter("c between a and b").groupBy(*keys, "a",
        "b").agg(F.count("*").alias("dashes"))
    full = inside.filter(F.col("dashes") >= least_share * (F.col("b") - F.col("a") + 1))
    return full.groupBy(*keys).agg(F.max(F.struct((F.col("b") - F.col("a")).alias("w"), (-F.col("a")).alias("a"), "b", "dashes")).alias("m")).select(
        *keys, (-F.col("m.a")).alias("low"), F.col("m.b").alias("high"), F.col("m.dashes").alias("dashes"))


# The field's lateral lines, by how far across it they are, and the sizes of blobs that can be dashes.
HASH_LOW, HASH_HIGH = 70.75 / 3, FIELD_WIDTH - 70.75 / 3
LATERALS = (("sideline_b", 0.0), ("hash_b", HASH_LOW), ("hash_t", HASH_HIGH), ("sideline_t", FIELD_WIDTH))
DASH_AREA, DASH_SIDE = (2, 250), 30


def landmarks(spark: SparkSession) -> DataFrame:
    """The field's painted crossings: vertex (from 0, along the field and then across), label, x, y, and next_vertex, the one that
    an edge leads to across the field (NULL at the far sideline). Lines are the two end lines and each 5 yards between the goals."""
    lines = F.array(F.lit(0.0), *(F.lit(END_ZONE + STEP * k) for k in range(int((FIELD_LENGTH - 2 * END_ZONE) / STEP) + 1)), F.lit(FIELD_LENGTH))
    laterals = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(y)).alias("y")) for n, y in LATERALS))
    rows = spark.range(1).select(F.posexplode(lines).alias("i", "x")).select("i", "x", F.posexplode(laterals).alias("j", "l"))
    vertex = (F.col("i") * len(LATERALS) + F.col("j")).cast("long")
    return rows.select(vertex.alias("vertex"), F.format_string("x%03d_%s", F.col("x").cast("int"), "l.name").alias("label"), "x",
        F.col("l.y").alias("y"), F.when(F.col("j") < len(LATERALS) - 1, vertex + 1).alias("next_vertex"))


def dash_blobs(blobs: DataFrame, most_side: float = DASH_SIDE, most_area: float = DASH_AREA[1]) -> DataFrame:
    """Blobs (area, width, height) that are as small as a dash."""
    return blobs.filter(F.col("area").between(DASH_AREA[0], most_area) & (F.greatest("width", "height") <= most_side))


def turf_shares(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The share of an image's pixels (r, g, b) that read as turf."""
    return pixels.groupBy(*keys).agg(F.avg(turf(F.col("r"), F.col("g"), F.col("b")).cast("double")).alias("turf"))
