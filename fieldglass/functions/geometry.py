"""Column functions of boxes, field coordinates and homographies (arrays of 9, row by row)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD_LENGTH, FIELD_WIDTH, END_ZONE, STEP = 120.0, 160 / 3, 10.0, 5.0
ANCHOR_MOST = 1.5
TAKE_MEDIAN_S, TAKE_SIGMA, TAKE_LEAST_S, TAKE_MOST_S = 13.0, 0.6, 4.0, 75.0


def overlap(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2); 0 where both are empty."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = width * height
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def feet(x1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(((x1 + x2) / 2).alias("x"), y2.alias("y"))


def through(h: Column, x: Column, y: Column) -> Column:
    """A point through a homography; NULL on the line at infinity."""
    w = h[6] * x + h[7] * y + h[8]
    return F.struct(F.try_divide(h[0] * x + h[1] * y + h[2], w).alias("x"), F.try_divide(h[3] * x + h[4] * y + h[5], w).alias("y"))


def shifted(h: Column, by: Column) -> Column:
    """The homography after a shift of its target along x."""
    return F.transform(h, lambda v, i: F.when(i < 3, v + by * F.get(h, i + 6)).otherwise(v))


def in_field(x: Column, y: Column, margin: float = 0.0) -> Column:
    return x.between(-margin, FIELD_LENGTH + margin) & y.between(-margin, FIELD_WIDTH + margin)


def line_x(yards_to_goal: Column) -> Column:
    """Where the line of scrimmage is along the field when the offense goes right; an error beyond 0 to 100."""
    return F.when(yards_to_goal.isNull() | yards_to_goal.between(0, 100),
        END_ZONE + (100 - yards_to_goal)).otherwise(F.raise_error(F.lit("yards to the goal are 0 to 100")))


def line_x_facing(yards_to_goal: Column, attack: Column) -> Column:
    return F.when(attack > 0, 110.0 - yards_to_goal).otherwise(10.0 + yards_to_goal)


def painted_number(x: Column) -> Column:
    return F.lit(50) - F.abs(F.bround(x - 10) - 50)


def anchor(line: Column, attack: Column, yards_to_goal: Column) -> Column:
    """(shift, residual, los_x, ok): the whole number of 5-yard steps that brings a relative line nearest its official spot."""
    target = line_x_facing(yards_to_goal, attack)
    shift = F.bround((target - line) / STEP) * STEP
    residual = target - (line + shift)
    return F.struct(shift.alias("shift"), residual.alias("residual"), target.alias("los_x"), (F.abs(residual) <= ANCHOR_MOST).alias("ok"))


def snap_frame(x: Column, y: Column, los_x: Column, ball_y: Column, attacking: Column) -> Column:
    """(lateral, depth) from the ball as the offense sees it; an error unless attacking is left or right."""
    pair = lambda a, b: F.struct(a.cast("double").alias("lateral"), b.cast("double").alias("depth"))
    return F.when(attacking == "right", pair(y - ball_y, los_x - x)).when(attacking == "left",
        pair(ball_y - y, x - los_x)).otherwise(F.raise_error(F.lit("attacking is left or right")))


def duration_prior(seconds: Column) -> Column:
    """Log of a log-normal prior of take lengths, up to a constant; minus infinity outside its bounds."""
    z = (F.log(seconds) - math.log(TAKE_MEDIAN_S)) / TAKE_SIGMA
    return F.when(seconds.between(TAKE_LEAST_S, TAKE_MOST_S), -0.5 * z * z).otherwise(F.lit(float("-inf")))


def predicted_miss(end: dict[str, Column], start: dict[str, Column], gap: Column) -> Column:
    """How far a track's end and a later one's start miss each other, in box heights: either is carried on for `gap` frames
    at its own speed, and the two misses are averaged. Keys: x, y, vx, vy, h."""
    ahead = F.hypot(end["x"] + end["vx"] * gap - start["x"], end["y"] + end["vy"] * gap - start["y"])
    back = F.hypot(start["x"] - start["vx"] * gap - end["x"], start["y"] - start["vy"] * gap - end["y"])
    return F.try_divide(ahead + back, end["h"] + start["h"])


def box_line(label_index: Column, box: list[Column], width: float, height: float) -> Column:
    """A training line: class, centre and size relative to the image, clipped to it; NULL if under a pixel either way."""
    x1, x2 = (F.greatest(F.lit(0.0), F.least(v, F.lit(float(width)))) for v in (box[0], box[2]))
    y1, y2 = (F.greatest(F.lit(0.0), F.least(v, F.lit(float(height)))) for v in (box[1], box[3]))
    line = F.format_string("%d %.6f %.6f %.6f %.6f", label_index, (x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width,
        (y2 - y1) / height)
    return F.when((x2 - x1 >= 1) & (y2 - y1 >= 1) & label_index.isNotNull(), line)


def logit_emission(p: Column, clip: float = 0.02) -> Column:
    kept = F.greatest(F.lit(clip), F.least(p, F.lit(1 - clip)))
    return F.struct(F.log(kept).alias("yes"), F.log(1 - kept).alias("no"))


def projective(line: Column, x: Column) -> Column:
    """A 1-D projective map (a, b, c): (a x + b) / (c x + 1)."""
    return F.try_divide(line[0] * x + line[1], line[2] * x + 1)


def linear_light(v: Column) -> Column:
    """An sRGB value of 0 to 1 as linear light."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def lab(r: Column, g: Column, b: Column) -> Column:
    """CIE Lab (D65) of sRGB values of 0 to 1."""
    red, green, blue = linear_light(r), linear_light(g), linear_light(b)
    # The sRGB primaries over the D65 white.
    xyz = [
        (0.4124564 * red + 0.3575761 * green + 0.1804375 * blue) / 0.95047,
        0.2126729 * red + 0.7151522 * green + 0.0721750 * blue,
        (0.0193339 * red + 0.1191920 * green + 0.9503041 * blue) / 1.08883,
    ]
    fx, fy, fz = (F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116) for t in xyz)
    return F.struct((116 * fy - 16).alias("l"), (500 * (fx - fy)).alias("a"), (200 * (fy - fz)).alias("b"))


#: Crops under this height and width, in pixels, can't be read.
CROP_HEIGHT, CROP_WIDTH = 24, 6
#: A foot this far past a sideline, in yards, is off the field.
OFF_FIELD = 0.5


def crop_bounds(box: list[Column]) -> Column:
    """(x1, y1, x2, y2) of a box's crop, in whole pixels from 0 on."""
    names = ("x1", "y1", "x2", "y2")
    return F.struct(*(F.greatest(F.lit(0), F.bround(v).cast("long")).alias(n) for n, v in zip(names, box, strict=True)))


def usable_crop(height: Column, width: Column, channels: Column) -> Column:
    """Whether a crop is in colour and large enough; NULL sizes aren't."""
    return F.coalesce((channels == 3) & (height >= CROP_HEIGHT) & (width >= CROP_WIDTH), F.lit(False))


def past_sideline(y: Column, whole: Column) -> Column:
    """Whether feet at y yards are past a sideline; those of a box that the picture cuts off only past the near one."""
    return (y < -OFF_FIELD) | (whole & (y > FIELD_WIDTH + OFF_FIELD))


def take_frames(start_s: Column, end_s: Column, rate: float) -> Column:
    """(start, end) in frames of a span in seconds."""
    return F.struct(F.bround(start_s * rate).cast("long").alias("start"), F.bround(end_s * rate).cast("long").alias("end"))


def smoothstep(t: Column) -> Column:
    return t * t * (3 - 2 * t)


def eased_between(t: Column, waypoints: Column) -> Column:
    """(x, y) at time t on a path of waypoints (t, x, y) in order of time, eased in and out of each; at rest beyond the ends."""
    n = F.size(waypoints)
    first, last = F.get(waypoints, F.lit(0)), F.get(waypoints, n - 1)
    legs = F.transform(F.sequence(F.lit(0), n - 2), lambda k: F.struct(F.get(waypoints, k).alias("a"), F.get(waypoints, k + 1).alias("b")))
    leg = F.get(F.filter(legs, lambda s: (t >= s["a"]["t"]) & (t <= s["b"]["t"])), F.lit(0))
    share = F.coalesce(smoothstep(F.try_divide(t - leg["a"]["t"], leg["b"]["t"] - leg["a"]["t"])), F.lit(1.0))
    at = lambda c: F.when((t <= first["t"]) | (n == 1), first[c]).when(t >= last["t"],
        last[c]).otherwise(leg["a"][c] + (leg["b"][c] - leg["a"][c]) * share)
    return F.struct(at("x").cast("double").alias("x"), at("y").cast("double").alias("y"))


def turf(r: Column, g: Column, b: Column) -> Column:
    """Whether a pixel of 0 to 255 reads as turf: green above red and blue, and not too dark."""
    return (g > r + 12) & (g > b + 12) & (g > 40)
