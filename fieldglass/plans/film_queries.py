"""Queries of the film operators: geometry, ordered rows, tracks, boxes, frames, cameras and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import geometry as G
from fieldglass.operators import boxes, dynamic, field, film, film_room, joins, models, sampling, sequence, tracks
from fieldglass.plans import runner
from fieldglass.plans.play_queries import pick, pick_sql
from fieldglass.plans.queries import BOXED, boxed
from fieldglass.plans.registry import events, query, read
from fieldglass.sources import tables
from fieldglass.streaming import film as stream

ORDERED = ["t", "event_id"]
E_SQL = "(SELECT *, epoch_us(ts) AS t FROM events)"
W_SQL = "PARTITION BY user_id ORDER BY t, event_id"


def numbers(spark, sf) -> DataFrame:
    """Suppliers with four numbers each."""
    k = F.col("s_suppkey")
    n = lambda a, b: (k * a % b).cast("double")
    return read(spark, sf, "supplier").select("s_suppkey", n(7, 40).alias("a"), n(11, 40).alias("b"), n(13, 100).alias("c"), n(17, 61).alias("d"))


N_SQL = "(SELECT s_suppkey, (s_suppkey * 7 % 40)::DOUBLE AS a, (s_suppkey * 11 % 40)::DOUBLE AS b, (s_suppkey * 13 % 100)::DOUBLE AS c, (s_suppkey * 17 % 61)::DOUBLE AS d FROM supplier)"


# --- geometry


@query("q_feet_and_lines", f"""SELECT s_suppkey, (a + a + 9) / 2 AS feet_x, b AS feet_y, 10 + (100 - c) AS line, a BETWEEN -2 AND 122 AND d BETWEEN -2
 AND 160 / 3.0::DOUBLE + 2 AS inside, a + 3 * 0.5::DOUBLE AS h0, b + 3 * 0.25::DOUBLE AS h1, c + 3 AS h2, 3.0::DOUBLE AS h5,
 CASE WHEN d BETWEEN 4 AND 75 THEN -0.5 * ((ln(d) - ln(13.0::DOUBLE)) / 0.6) * ((ln(d) - ln(13.0::DOUBLE)) / 0.6) ELSE -999 END AS prior,
 ln(greatest(0.02, least(c / 100, 0.98))) AS yes, ln(1 - greatest(0.02, least(c / 100, 0.98))) AS no,
 (2 * a + 1) / (0.1::DOUBLE * a + 1) AS projected, (d < -0.5) OR (a > 20 AND d > 160 / 3.0::DOUBLE + 0.5) AS past,
 (c / 100) * (c / 100) * (3 - 2 * (c / 100)) AS eased,
 (sqrt((a + 2 * 3 - c) ** 2 + (b + 1 * 3 - d) ** 2) + sqrt((c - 1 * 3 - a) ** 2 + (d - 2 * 3 - b) ** 2)) / 50 AS miss FROM {N_SQL}""")
def feet_and_lines(spark, sf):
    a, b, c, d = map(F.col, "abcd")
    lit = lambda v: F.lit(float(v))
    foot, told = G.feet(a, a + 9, b), G.logit_emission(c / 100)
    h = F.array(a, b, c, *(lit(v) for v in (1, 2, 3, 0.5, 0.25, 1)))
    end, start = {"x": a, "y": b, "vx": lit(2), "vy": lit(1), "h": lit(20)}, {"x": c, "y": d, "vx": lit(1), "vy": lit(2), "h": lit(30)}
    prior = G.duration_prior(d)
    return numbers(spark, sf).select(
        "s_suppkey", foot["x"].alias("feet_x"), foot["y"].alias("feet_y"), G.line_x(c).alias("line"), G.in_field(a, d, 2.0).alias("inside"),
        *(F.get(G.shifted(h, lit(3)), k).alias(f"h{k}") for k in (0, 1, 2, 5)),
        F.when(prior == float("-inf"), -999.0).otherwise(prior).alias("prior"), told["yes"].alias("yes"), told["no"].alias("no"),
        G.projective([lit(2), lit(1), lit(0.1)], a).alias("projected"),
        G.past_sideline(d, a > 20).alias("past"), G.smoothstep(c / 100).alias("eased"), G.predicted_miss(end, start, lit(3)).alias("miss"))


@query("q_crops", f"""SELECT s_suppkey, greatest(0, CAST(round_even(a - 20.5, 0) AS BIGINT)) AS x1, greatest(0, CAST(round_even(b - 10.5,
 0) AS BIGINT)) AS y1, greatest(0, CAST(round_even(c, 0) AS BIGINT)) AS x2, greatest(0, CAST(round_even(d, 0) AS BIGINT)) AS y2,
 a >= 24 AND b >= 6 AND s_suppkey % 3 = 0 AS usable, CAST(round_even(a * 25.5::DOUBLE, 0) AS BIGINT) AS first, CAST(round_even(b * 25.5::DOUBLE,
 0) AS BIGINT) AS last FROM {N_SQL}""")
def crops(spark, sf):
    a, b, c, d = map(F.col, "abcd")
    box, span = G.crop_bounds([a - 20.5, b - 10.5, c, d]), G.take_frames(a, b, 25.5)
    usable = G.usable_crop(a, b, F.when(F.col("s_suppkey") % 3 == 0, 3).otherwise(1))
    return numbers(spark, sf).select("s_suppkey", *(box[x].alias(x) for x in ("x1", "y1", "x2", "y2")), usable.alias("usable"),
        span["start"].alias("first"), span["end"].alias("last"))


@query("q_colours", f"""WITH l AS (SELECT s_suppkey,
 {', '.join(f"CASE WHEN {c} / {m} <= 0.04045 THEN {c} / {m} / 12.92 ELSE pow(({c} / {m} + 0.055) / 1.055, 2.4) END AS {n}" for c, m, n in (('a', 40, 'r'), ('b', 40, 'g'), ('c', 100, 'u')))},
 a * 6 > 0 AS some, (b * 6 > a * 6 + 12) AND (b * 6 > c * 2 + 12) AND (b * 6 > 40) AS turf FROM {N_SQL}),
x AS (SELECT *, (0.4124564 * r + 0.3575761 * g + 0.1804375 * u) / 0.95047 AS p, 0.2126729 * r + 0.7151522 * g + 0.0721750 * u AS q,
 (0.0193339 * r + 0.1191920 * g + 0.9503041 * u) / 1.08883 AS s FROM l),
f AS (SELECT *, {', '.join(f"CASE WHEN {v} > 216 / 24389.0::DOUBLE THEN cbrt({v}) ELSE (24389 / 27.0::DOUBLE * {v} + 16) / 116 END AS f{v}" for v in 'pqs')} FROM x)
 SELECT s_suppkey, round(116 * fq - 16, 6) AS l, round(500 * (fp - fq), 6) AS a, round(200 * (fq - fs), 6) AS b, turf FROM f""")
def colours(spark, sf):
    a, b, c = map(F.col, "abc")
    lab = G.lab(a / 40, b / 40, c / 100)
    return numbers(spark, sf).select("s_suppkey", *(F.round(lab[x], 6).alias(x) for x in "lab"), G.turf(a * 6, b * 6, c * 2).alias("turf"))


@query("q_turf_shares",
    f"SELECT s_suppkey % 10 AS image, avg(CASE WHEN (b * 6 > a * 6 + 12) AND (b * 6 > c * 2 + 12) AND (b * 6 > 40) THEN 1.0::DOUBLE ELSE 0 END) AS turf FROM {N_SQL} GROUP BY ALL")
def turf_shares(spark, sf):
    a, b, c = map(F.col, "abc")
    return field.turf_shares(
        numbers(spark, sf).select((F.col("s_suppkey") % 10).alias("image"), (a * 6).alias("r"), (b * 6).alias("g"), (c * 2).alias("b")), ["image"])


@query("q_eased_paths", f"""SELECT s_suppkey, CASE WHEN t <= 0 THEN 0.0 WHEN t >= 30 THEN 40.0
 WHEN t <= 10 THEN 0 + 20 * ((t / 10) * (t / 10) * (3 - 2 * (t / 10)))
 ELSE 20 + 20 * (((t - 10) / 20) * ((t - 10) / 20) * (3 - 2 * ((t - 10) / 20))) END AS x,
 CASE WHEN t <= 0 THEN 5.0 WHEN t >= 30 THEN 5.0 WHEN t <= 10 THEN 5 - 5 * ((t / 10) * (t / 10) * (3 - 2 * (t / 10)))
 ELSE 5 * (((t - 10) / 20) * ((t - 10) / 20) * (3 - 2 * ((t - 10) / 20))) END AS y FROM (SELECT s_suppkey, a - 5 AS t FROM {N_SQL})""")
def eased_paths(spark, sf):
    stop = lambda t, x, y: F.struct(F.lit(float(t)).alias("t"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    at = G.eased_between(F.col("a") - 5, F.array(stop(0, 0, 5), stop(10, 20, 0), stop(30, 40, 5)))
    return numbers(spark, sf).select("s_suppkey", at["x"].alias("x"), at["y"].alias("y"))


@query("q_landmarks", """WITH x AS (SELECT unnest([0.0::DOUBLE] || list_transform(range(0, 21),
 lambda k: 10.0::DOUBLE + 5 * k) || [120.0::DOUBLE]) AS x), i AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM x),
l(j, name, y) AS (VALUES (0, 'sideline_b', 0.0::DOUBLE), (1, 'hash_b', 70.75::DOUBLE / 3), (2, 'hash_t', 160::DOUBLE / 3 - 70.75::DOUBLE / 3), (3,
 'sideline_t', 160::DOUBLE / 3))
SELECT i * 4 + j AS vertex, printf('x%03d_%s', CAST(x AS INTEGER), name) AS label, x, y, CASE WHEN j < 3 THEN i * 4 + j + 1 END AS next_vertex FROM i,
 l""")
def landmarks(spark, sf):
    return field.landmarks(spark)


@query("q_dash_blobs",
    f"SELECT s_suppkey, area, width, height FROM (SELECT s_suppkey, c * 4 AS area, a AS width, b AS height FROM {N_SQL}) WHERE area BETWEEN 2 AND 250 AND greatest(width, height) <= 30")
def dash_blobs(spark, sf):
    return field.dash_blobs(
        numbers(spark, sf).select("s_suppkey", (F.col("c") * 4).alias("area"), F.col("a").alias("width"), F.col("b").alias("height")))


# --- positions on the field

HOMOGRAPHY_SQL = "(2 * x + 0.5::DOUBLE * y + frame) / (0.01::DOUBLE * y + 1) AS px, (0.1::DOUBLE * x + y) / (0.01::DOUBLE * y + 1) AS py"


def homographies(spark, sf) -> DataFrame:
    n = F.col("n_nationkey")
    lit = lambda v: F.lit(float(v))
    return read(spark, sf, "nation").filter("n_nationkey < 20").select(n.alias("frame"),
        F.array(lit(2), lit(0.5), n.cast("double"), lit(0.1), lit(1), lit(0), lit(0), lit(0.01), lit(1)).alias("h"))


def placed(spark, sf) -> DataFrame:
    b = boxed(spark, sf)
    return b.select("frame", "box_id", *(F.get("box", k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))))


@query("q_field_positions",
    f"SELECT frame, box_id, px AS x_yd, py AS y_yd FROM (SELECT frame, box_id, {HOMOGRAPHY_SQL} FROM (SELECT frame, box_id, x + 15 AS x, y + 30 AS y FROM {BOXED}) WHERE frame < 20) WHERE py BETWEEN -1 AND 160 / 3.0::DOUBLE + 1")
def field_positions(spark, sf):
    return field.field_positions(placed(spark, sf), homographies(spark, sf), ["frame"]).select("frame", "box_id", "x_yd", "y_yd")


@query("q_on_field_share",
    f"SELECT frame, avg(CASE WHEN px BETWEEN 0 AND 120 AND py BETWEEN 0 AND 160 / 3.0::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS share FROM (SELECT frame, box_id, {HOMOGRAPHY_SQL} FROM (SELECT frame, box_id, x * 3 AS x, y + 30 AS y FROM {BOXED})) GROUP BY frame")
def on_field_share(spark, sf):
    lit = lambda v: F.lit(float(v))
    h = F.array(lit(2), lit(0.5), F.col("frame").cast("double"), lit(0.1), lit(1), lit(0), lit(0), lit(0.01), lit(1))
    p = G.through(h, F.col("x1") * 3, F.col("y1") + 30)
    return field.on_field_share(placed(spark, sf).select("frame", p["x"].alias("x_yd"), p["y"].alias("y_yd")), ["frame"])


@query("q_anchored_frames",
    f"SELECT s_suppkey, 5 * round_even((110 - c - a) / 5, 0) AS shift, 110 - c AS los_x, abs(110 - c - a - 5 * round_even((110 - c - a) / 5, 0)) <= 1.5 AS ok FROM (SELECT s_suppkey, a + 0.25::DOUBLE AS a, c FROM {N_SQL})")
def anchored_frames(spark, sf):
    lines = numbers(spark, sf).select("s_suppkey", (F.col("a") + 0.25).alias("line"), F.lit(1).alias("attack"), F.col("c").alias("to_goal"))
    return field.anchored_frames(lines, "to_goal").select("s_suppkey", "shift", "los_x", "ok")


# --- ordered rows


@query("q_running_median", f"""WITH n AS (SELECT event_id, user_id, [v for v in [coalesce(lag(value, 2) OVER w, first_value(value) OVER w),
 coalesce(lag(value, 1) OVER w, first_value(value) OVER w), value, coalesce(lead(value, 1) OVER w, last_value(value) OVER f), coalesce(lead(value, 2)
 OVER w, last_value(value) OVER f)]] AS v
 FROM {E_SQL} WINDOW w AS ({W_SQL}), f AS ({W_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT event_id, user_id,
 list_sort(v)[3] AS median FROM n""")
def running_median(spark, sf):
    return sequence.running_median(events(spark, sf), ["user_id"], ORDERED, "value").select("event_id", "user_id", "median")


@query("q_flips", f"""WITH n AS (SELECT user_id, t, value, row_number() OVER w AS i, list_sort([coalesce(lag(value, 2) OVER w, first_value(value)
 OVER w), coalesce(lag(value, 1) OVER w, first_value(value) OVER w), value, coalesce(lead(value, 1) OVER w, last_value(value) OVER f),
 coalesce(lead(value, 2) OVER w, last_value(value) OVER f)])[3] / 40 AS m
 FROM {E_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY t), f AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING
 AND UNBOUNDED FOLLOWING)), c AS (SELECT *, lag(m) OVER (PARTITION BY user_id ORDER BY i) AS b FROM n)
SELECT DISTINCT c.user_id, (SELECT arg_max(x.t, (x.value, -x.t)) FROM n x WHERE x.user_id = c.user_id AND x.i BETWEEN c.i - 3 AND c.i + 3) AS t FROM c
 WHERE (m >= 0.5) <> (b >= 0.5)""")
def flips(spark, sf):
    return sequence.flips(events(spark, sf).withColumn("p", F.col("value") / 40), ["user_id"], "t", "p", "value")


@query("q_grown_run", """WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type = 'view' AS f,
 event_type IN ('view', 'click') AS weak FROM events), g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY user_id ORDER BY i) > 2 THEN 1
 ELSE 0 END AS c FROM f WHERE f),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM g), s AS (SELECT user_id, run, min(i) AS a,
 max(i) AS b FROM r GROUP BY user_id, run QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY max(i) - min(i) DESC, min(i)) = 1),
w AS (SELECT f.user_id, f.i, s.a, s.b, f.i BETWEEN s.a AND s.b AS inside FROM f JOIN s USING (user_id) WHERE weak OR f.i BETWEEN s.a AND s.b),
 x AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY user_id ORDER BY i) > 3 THEN 1 ELSE 0 END AS c FROM w),
y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM x) SELECT user_id, min(i) AS first, max(i) AS last
 FROM y GROUP BY user_id, run HAVING bool_or(inside)""")
def grown_run(spark, sf):
    rows = events(spark, sf).withColumn("o", F.struct("t", "event_id"))
    seeds = sequence.longest_run(rows, ["user_id"], "o", F.col("event_type") == "view", 1)
    return sequence.grown_run(rows, ["user_id"], "o", F.col("event_type").isin("view", "click"), seeds, 2)


@query("q_outliers",
    f"""SELECT event_id, user_id, abs(value - quantile_cont(value, 0.5) OVER w) > 15 AND count(value) OVER w >= 5 AS is_bad
 FROM {E_SQL} WINDOW w AS ({W_SQL} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""")
def outliers(spark, sf):
    rows = events(spark, sf).withColumn("o", F.struct("t", "event_id"))
    return sequence.rolling_outliers(rows, ["user_id"], "o", "value", 4, 15.0).select("event_id", "user_id", "is_bad")


@query("q_replaced_outliers", """WITH e AS (SELECT event_id, user_id, event_id AS o, value, value > 30 AS bad FROM events), n AS (SELECT *,
 last_value(CASE WHEN NOT bad THEN o END IGNORE NULLS) OVER b AS bo, last_value(CASE WHEN NOT bad THEN value END IGNORE NULLS) OVER b AS bv,
 first_value(CASE WHEN NOT bad THEN o END IGNORE NULLS) OVER a AS ao, first_value(CASE WHEN NOT bad THEN value END IGNORE NULLS) OVER a AS av FROM e
 WINDOW b AS (PARTITION BY user_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id
 ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, user_id, CASE WHEN bo IS NULL THEN av WHEN ao IS NULL THEN bv WHEN ao = bo THEN bv
 ELSE bv + (av - bv) * ((o - bo) / (ao - bo)::DOUBLE) END AS value FROM n""")
def replaced_outliers(spark, sf):
    return sequence.replaced_outliers(read(spark, sf, "events"), ["user_id"], "event_id", "value", F.col("value") > 30).select("event_id", "user_id",
        "value")


@query("q_array_change", """WITH v AS (SELECT vec_id, label, embedding FROM embeddings), l AS (SELECT *, lag(embedding) OVER (PARTITION BY label
 ORDER BY vec_id) AS b FROM v)
SELECT vec_id, label, round(coalesce(list_avg(list_transform(list_zip(embedding, b), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))), 0), 5) AS diff
 FROM l""")
def array_change(spark, sf):
    rows = read(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return sequence.array_change(rows, ["label"], "vec_id", "embedding").select("vec_id", "label", F.round("diff", 5).alias("diff"))


@query("q_trimmed_spans", """WITH s AS (SELECT o_orderkey, o_orderkey % 40 AS a, o_orderkey % 40 + 60 + o_orderkey % 7 AS b,
 [o_orderkey % 40 + o_orderkey % 30, o_orderkey % 40 + 50 + o_orderkey % 13, o_orderkey % 40 + 9] AS cuts FROM orders)
SELECT o_orderkey, coalesce(list_max(list_filter(cuts, lambda c: c - a <= 25 AND c - a < b - c)), a) AS first, coalesce(list_min(list_filter(cuts,
 lambda c: b - c <= 25 AND b - c <= c - a)), b) AS last FROM s""")
def trimmed_spans(spark, sf):
    k = F.col("o_orderkey")
    a = k % 40
    span = sequence.trimmed_span(a, a + 60 + k % 7, F.array(a + k % 30, a + 50 + k % 13, a + 9), 25.0)
    return read(spark, sf, "orders").select("o_orderkey", span["start"].alias("first"), span["end"].alias("last"))


@query("q_grouped_shots", """WITH e AS (SELECT user_id, epoch_us(ts) AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k
 FROM events), c AS (SELECT *, sum(CASE WHEN k > 1 AND value > 35 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id
 ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY user_id, run) AS m FROM c),
r AS (SELECT user_id, run, min(t) AS start, max(t) - min(t) + 1 AS duration, round(median(floor(value)) FILTER (i >= m // 4
 AND i < greatest(m // 4 + 1, 3 * m // 4)), 1) AS tilt, count(*) AS samples FROM n GROUP BY ALL),
k AS (SELECT *, sum(CASE WHEN run = (SELECT min(x.run) FROM r x WHERE x.user_id = r.user_id) OR duration >= 43200000000 THEN 1 ELSE 0 END)
 OVER (PARTITION BY user_id ORDER BY start ROWS UNBOUNDED PRECEDING) - 1 AS shot FROM r)
SELECT user_id, CAST(shot AS BIGINT) AS shot_index, min(start) AS start, arg_min(tilt, start) AS tilt, CAST(sum(samples) AS BIGINT) AS samples FROM k
 GROUP BY ALL""")
def grouped_shots(spark, sf):
    rows = events(spark, sf).withColumn("tilt", F.floor("value").cast("double"))
    shots = sequence.grouped_shots(rows, ["user_id"], "t", "value", "tilt", step=1, threshold=35.0, least=43_200_000_000)
    return shots.select("user_id", F.col("shot_index").cast("long").alias("shot_index"), "start", "tilt", "samples")


@query("q_smoothed_tracks", """WITH p AS (SELECT user_id, event_id AS frame, value AS x, event_id % 50 * 1.0::DOUBLE AS y FROM events),
 s AS (SELECT user_id, frame, avg(x) OVER w AS x_yd_s, avg(y) OVER w AS y_yd_s FROM p WINDOW w AS (PARTITION BY user_id
 ORDER BY frame RANGE BETWEEN 200 PRECEDING AND 200 FOLLOWING))
SELECT user_id, frame, x_yd_s, y_yd_s, NULL::DOUBLE AS speed FROM s WHERE false UNION ALL SELECT user_id, frame, x_yd_s, y_yd_s, CASE
 WHEN frame - lag(frame) OVER w <= 2 THEN sqrt((x_yd_s - lag(x_yd_s) OVER w) ** 2 + (y_yd_s - lag(y_yd_s) OVER w) ** 2) / (frame - lag(frame)
 OVER w) * 25 END AS speed FROM s WINDOW w AS (PARTITION BY user_id ORDER BY frame)""")
def smoothed_tracks(spark, sf):
    rows = read(spark, sf, "events").select("user_id", F.col("event_id").alias("frame"), F.col("value").alias("x_yd"),
        (F.col("event_id") % 50).cast("double").alias("y_yd"))
    return sequence.smoothed_tracks(rows, ["user_id"], reach=200).select("user_id", "frame", "x_yd_s", "y_yd_s", "speed")


@query("q_snaps", """WITH m AS (SELECT user_id % 5 AS take, event_id // 40 AS frame, median(value) AS v FROM events WHERE event_type IN ('view',
 'click') GROUP BY ALL), f AS (SELECT *, CASE WHEN v > 14 THEN 1 ELSE 0 END AS fast, lead(frame) OVER (PARTITION BY take ORDER BY frame) AS nxt
 FROM m),
h AS (SELECT *, min(fast) OVER w = 1 AND count(*) OVER w = 2 AS held FROM f WINDOW w AS (PARTITION BY take ORDER BY frame ROWS BETWEEN CURRENT ROW
 AND 1 FOLLOWING)), s AS (SELECT take, min(frame) FILTER (held) AS st FROM h GROUP BY take)
SELECT s.take, (SELECT arg_max(nxt, frame) FROM h WHERE h.take = s.take AND h.v < 12 AND h.frame < s.st) AS snap FROM s""")
def snaps(spark, sf):
    rows = read(spark, sf, "events").select((F.col("user_id") % 5).alias("take"), F.floor(F.col("event_id") / 40).alias("frame"),
        F.when(F.col("event_type").isin("view", "click"), "player").alias("label"), F.col("value").alias("speed"))
    return sequence.snaps(rows, ["take"], 5.0, 14.0, 0.4, 12.0)


# --- the film


@query("q_shifted_shots",
    "SELECT o_orderkey, round(o_orderkey / 8.0::DOUBLE + o_custkey / 25.0::DOUBLE, 3) AS start_s, round(o_orderkey / 4.0::DOUBLE + o_custkey / 25.0::DOUBLE, 3) AS end_s, o_orderkey + o_custkey AS start_frame, o_orderkey * 2 + o_custkey AS end_frame FROM orders")
def shifted_shots(spark, sf):
    k = F.col("o_orderkey")
    shots = read(spark, sf, "orders").select("o_orderkey", "o_custkey", (k / 8).alias("start_s"), (k / 4).alias("end_s"), k.alias("start_frame"),
        (k * 2).alias("end_frame"))
    return film.shifted_shots(shots, F.col("o_custkey"), 25.0).drop("o_custkey")


@query("q_bright_thresholds",
    "SELECT event_type, (quantile_cont(value, 0.2) + quantile_cont(value, 0.8)) / 2 - 0.05::DOUBLE AS threshold FROM events GROUP BY ALL")
def bright_thresholds(spark, sf):
    return film.bright_thresholds(read(spark, sf, "events"), ["event_type"], "value")


@query("q_take_summaries", """WITH f AS (SELECT o_custkey % 50 AS take, o_orderkey AS frame, ([NULL, 'direct', 'between',
 'beyond'])[o_orderkey % 4 + 1] AS source FROM orders), s AS (SELECT c_custkey % 60 AS take, c_custkey % 3 AS dx, c_acctbal / 1000 AS lft
 FROM customer WHERE c_custkey % 60 < 45),
a AS (SELECT take, min(frame) AS start_frame, max(frame) + 1 AS end_frame, count(*) FILTER (source IS NULL) AS frames_without,
 count(*) FILTER (source = 'direct') AS direct, count(*) FILTER (source = 'between') AS between_ FROM f GROUP BY take),
b AS (SELECT take, count(*) AS steps, count(*) FILTER (dx <> 0) AS steps_changed, count(*) FILTER (lft > 1) AS steps_unsure, max(lft) AS step_left_max
 FROM s GROUP BY take)
SELECT take, start_frame, end_frame, frames_without, direct, between_, coalesce(steps, 0) AS steps, coalesce(steps_changed, 0) AS steps_changed,
 coalesce(steps_unsure, 0) AS steps_unsure, step_left_max FROM a LEFT JOIN b USING (take)""")
def take_summaries(spark, sf):
    frames = read(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("take"), F.col("o_orderkey").alias("frame"),
        pick((None, "direct", "between", "beyond"), F.col("o_orderkey")).alias("source"))
    steps = read(spark, sf, "customer").select((F.col("c_custkey") % 60).alias("take"), (F.col("c_custkey") % 3).alias("dx"),
        (F.col("c_acctbal") / 1000).alias("left")).filter("take < 45")
    made = film.take_summaries(frames, steps, ["take"])
    of = lambda s: F.coalesce(F.try_element_at("sources", F.lit(s)), F.lit(0)).alias(s if s == "direct" else "between_")
    return made.select("take", "start_frame", "end_frame", "frames_without", of("direct"), of("between"), "steps", "steps_changed", "steps_unsure",
        "step_left_max")


@query("q_timeline", """WITH p AS (SELECT o_orderkey, o_custkey % 20 AS game, o_orderkey * 1.0::DOUBLE AS a,
 o_orderkey + 10.5::DOUBLE + o_custkey % 7 AS b FROM orders), e AS (SELECT game, min(a) AS t0, max(b) AS t1 FROM p GROUP BY game)
SELECT o_orderkey, lane, round(40 + (l - t0) / (t1 - t0) * 920, 1) AS x,
 round(greatest((40 + (r - t0) / (t1 - t0) * 920) - (40 + (l - t0) / (t1 - t0) * 920), 1), 1) AS width FROM (SELECT p.*, 'sideline' AS lane, a AS l,
 a + 5 AS r FROM p UNION ALL SELECT p.*, 'endzone', a + 5, b FROM p) JOIN e USING (game)""")
def timeline(spark, sf):
    k = F.col("o_orderkey")
    plays = read(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("game"), k.cast("double").alias("start_s"),
        (k + 10.5 + F.col("o_custkey") % 7).alias("end_s"))
    spans = plays.withColumns({"sa": F.col("start_s"), "sb": F.col("start_s") + 5, "ea": F.col("start_s") + 5, "eb": F.col("end_s")})
    return film_room.timeline(spans, ["game"], {"sideline": ("sa", "sb"), "endzone": ("ea", "eb")}).select("o_orderkey", "lane", "x", "width")


@query("q_first_view", """WITH r AS (SELECT user_id, greatest(0.02, least(0.98, value / 60)) AS p, value / 60 AS raw, row_number()
 OVER (PARTITION BY user_id ORDER BY event_id) % 2 = 1 AS even FROM events),
s AS (SELECT user_id, sum(CASE WHEN even THEN ln(p) ELSE ln(1 - p) END) AS a, sum(CASE WHEN even THEN ln(1 - p) ELSE ln(p) END) AS b, avg(CASE
 WHEN even = (raw >= 0.5) THEN 1.0::DOUBLE ELSE 0 END) AS agree FROM r GROUP BY user_id) SELECT user_id, CASE WHEN a < b THEN 1
 ELSE 0 END AS first_view, CASE WHEN a >= b THEN agree ELSE 1 - agree END AS agreement FROM s""")
def first_view(spark, sf):
    return dynamic.best_first_view(read(spark, sf, "events").withColumn("p", F.col("value") / 60), ["user_id"], "event_id", "p")


@query("q_alternation_breaks", """WITH r AS (SELECT user_id, event_id, CASE WHEN (row_number() OVER w % 2 = 1) = (value >= 12) THEN 1.0::DOUBLE
 ELSE 0 END AS yes FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (SELECT *, CASE WHEN avg(yes)
 OVER (PARTITION BY user_id) >= 0.5 THEN yes ELSE 1 - yes END AS agree FROM r),
n AS (SELECT user_id, event_id, avg(agree) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS run FROM g)
 SELECT user_id, event_id, coalesce((run >= 0.5) <> (lag(run) OVER (PARTITION BY user_id ORDER BY event_id) >= 0.5), false) AS breaks FROM n""")
def alternation_breaks(spark, sf):
    rows = read(spark, sf, "events").select("user_id", "event_id", (F.col("value") / 24).alias("p"))
    return film.alternation_breaks(rows, ["user_id"], "event_id", "p").select("user_id", "event_id", "breaks")


@query("q_split_takes", """WITH t AS (SELECT user_id, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b, CASE WHEN user_id % 3 = 0 THEN 0.9
 ELSE 0.4 END AS p, CASE WHEN user_id % 2 = 0 THEN 0.1 ELSE 0.8 END AS q FROM events GROUP BY user_id), m AS (SELECT * FROM t
 WHERE (p - 0.5) * (q - 0.5) < 0 AND abs(p - 0.5) > 0.25 AND abs(q - 0.5) > 0.25 AND b - a > 4),
c AS (SELECT m.user_id, arg_max(epoch_us(e.ts), (e.value, -epoch_us(e.ts))) AS cut, max(e.value) AS top FROM m JOIN events e ON e.user_id = m.user_id
 AND epoch_us(e.ts) >= a + 2 AND epoch_us(e.ts) < b - 1 GROUP BY m.user_id), k AS (SELECT user_id, cut FROM c WHERE top >= 6)
SELECT t.user_id, 0 AS part, a AS start, coalesce(cut, b) AS "end" FROM t LEFT JOIN k USING (user_id) UNION ALL SELECT t.user_id, 1, cut, b FROM t
 JOIN k USING (user_id)""")
def split_takes(spark, sf):
    rows = events(spark, sf)
    p = F.when(F.col("user_id") % 3 == 0, 0.9).otherwise(0.4)
    q = F.when(F.col("user_id") % 2 == 0, 0.1).otherwise(0.8)
    takes = rows.groupBy("user_id").agg(F.min("t").alias("start"), F.max("t").alias("end")).withColumns({"take": F.lit(0), "p_first": p, "p_last": q})
    return film.split_takes(takes, rows.withColumnRenamed("value", "diff"), ["user_id"], step=1, width=86_400_000_000.0).select("user_id", "part",
        "start", "end")


@query("q_takes_in_window", """WITH l AS (SELECT o_orderkey * 1.0::DOUBLE AS start_s, o_orderkey + o_custkey % 9 * 1.0::DOUBLE AS end_s, CASE
 WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS view, o_custkey % 4 > 0 AS confident FROM orders), i AS (SELECT start_s, end_s, view FROM l
 WHERE confident AND end_s - start_s >= 4 AND start_s >= 50 AND end_s <= 9000),
r AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY start_s) - 1 AS k, count(*) OVER (PARTITION BY view) AS m FROM i) SELECT start_s, end_s,
 view FROM r WHERE m <= 5 OR k IN (0, (m - 1) // 4, 2 * (m - 1) // 4, 3 * (m - 1) // 4, m - 1)""")
def takes_in_window(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    labels = read(spark, sf, "orders").select(k.cast("double").alias("start_s"), (k + c % 9).cast("double").alias("end_s"),
        F.when(k % 2 == 0, "a").otherwise("b").alias("view"), (c % 4 > 0).alias("confident"))
    return film.takes_or_slices(labels, (50.0, 9000.0), 20)


@query("q_kernel_density",
    "SELECT s_suppkey, ln((exp(-0.5 * pow((a - 10) / 5, 2)) + exp(-0.5 * pow((a - 12.5) / 5, 2)) + exp(-0.5 * pow((a - 30) / 5, 2))) / (3 * 5 * sqrt(2 * pi())) + 1e-300) AS density FROM "
    + N_SQL)
def kernel_density(spark, sf):
    return numbers(spark, sf).select("s_suppkey", dynamic.kernel_log_density(F.col("a"), [10, 12.5, 30]).alias("density"))


@query("q_viterbi", """WITH RECURSIVE r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
 ln(0.02::DOUBLE + least(value / 60, 0.96)) AS a, ln(0.98::DOUBLE - least(value / 60, 0.96)) AS b FROM events),
v AS (SELECT user_id, i, ln(0.5::DOUBLE) + a AS sa, ln(0.5::DOUBLE) + b AS sb, 0 AS fa, 1 AS fb FROM r WHERE i = 1 UNION ALL
 SELECT r.user_id, r.i, greatest(v.sa + ln(0.1::DOUBLE), v.sb + ln(0.9::DOUBLE)) + r.a, greatest(v.sa + ln(0.9::DOUBLE),
 v.sb + ln(0.1::DOUBLE)) + r.b, CASE WHEN v.sa + ln(0.1::DOUBLE) >= v.sb + ln(0.9::DOUBLE) THEN 0 ELSE 1 END, CASE
 WHEN v.sa + ln(0.9::DOUBLE) >= v.sb + ln(0.1::DOUBLE) THEN 0 ELSE 1 END FROM v JOIN r ON r.user_id = v.user_id AND r.i = v.i + 1),
p AS (SELECT v.user_id, v.i, CASE WHEN sa >= sb THEN 0 ELSE 1 END AS state, CASE WHEN sa >= sb THEN fa ELSE fb END AS came FROM v
 WHERE i = (SELECT max(x.i) FROM r x WHERE x.user_id = v.user_id) UNION ALL SELECT v.user_id, v.i, p.came, CASE WHEN p.came = 0 THEN v.fa
 ELSE v.fb END FROM p JOIN v ON v.user_id = p.user_id AND v.i = p.i - 1)
SELECT r.user_id, r.event_id, p.state FROM p JOIN r USING (user_id, i)""")
def viterbi(spark, sf):
    rows = events(spark,
        sf).withColumns({"a": F.lit(0.02) + F.least(F.col("value") / 60, F.lit(0.96)),
        "b": F.lit(0.98) - F.least(F.col("value") / 60, F.lit(0.96))})
    return dynamic.most_likely_states(rows, ["user_id"], "event_id", "a", "b", logs=False)


# --- tracks

BOX_ROWS_SQL = """(SELECT user_id % 40 AS take, user_id AS track, event_id AS frame, value AS x, event_id % 30 * 1.0::DOUBLE AS y FROM events)"""
ENDS_SQL = f"""r AS (SELECT *, row_number() OVER (PARTITION BY take, track ORDER BY frame) AS up, row_number() OVER (PARTITION BY take, track
 ORDER BY frame DESC) AS down FROM {BOX_ROWS_SQL}),
e AS (SELECT take, track, min(frame) AS first, max(frame) AS last, max(x) FILTER (up = 1) AS sx, max(y) FILTER (up = 1) AS sy,
 max(x) FILTER (down = 1) AS fx, max(y) FILTER (down = 1) AS fy,
 CASE WHEN count(*) >= 3 THEN coalesce(regr_slope(x, frame) FILTER (up <= 10), 0) ELSE 0 END AS svx, CASE
 WHEN count(*) >= 3 THEN coalesce(regr_slope(y, frame) FILTER (up <= 10), 0) ELSE 0 END AS svy,
 CASE WHEN count(*) >= 3 THEN coalesce(regr_slope(x, frame) FILTER (down <= 10), 0) ELSE 0 END AS fvx, CASE
 WHEN count(*) >= 3 THEN coalesce(regr_slope(y, frame) FILTER (down <= 10), 0) ELSE 0 END AS fvy FROM r GROUP BY ALL)"""


def ends(spark, sf) -> DataFrame:
    """The ends of tracks made of each user's events: feet at (value, event_id % 30), boxes 10 by 20."""
    x, y = F.col("value"), (F.col("event_id") % 30).cast("double")
    rows = read(spark, sf, "events").select((F.col("user_id") % 40).alias("take"), F.col("user_id").alias("track"), F.col("event_id").alias("frame"),
        (x - 5).alias("x1"), (x + 5).alias("x2"), (y - 20).alias("y1"), y.alias("y2"))
    return tracks.track_ends(rows, ["take", "track"]).withColumn("team", (F.col("track") % 3 - 1).cast("int"))


@query("q_theta_links", f"""WITH {ENDS_SQL}, p AS (SELECT a.take, a.track AS earlier, b.track AS later, b.first - a.last AS gap,
 (sqrt((a.fx + a.fvx * (b.first - a.last) - b.sx) ** 2 + (a.fy + a.fvy * (b.first - a.last) - b.sy) ** 2) + sqrt((b.sx - b.svx * (b.first - a.last) - a.fx) ** 2 + (b.sy - b.svy * (b.first - a.last) - a.fy) ** 2)) / 40 AS miss
 FROM e a JOIN e b ON a.take = b.take AND b.first > a.last AND b.first - a.last <= 25 * 400 AND NOT (a.track % 3 >= 1 AND b.track % 3 >= 1
 AND a.track % 3 <> b.track % 3)) SELECT take, earlier, later, miss FROM p WHERE miss <= 0.6::DOUBLE + gap / 25.0::DOUBLE""")
def theta_links(spark, sf):
    """Pairs of tracks of a take that may be one, over gaps of up to 400 seconds at 25 frames each."""
    return tracks.link_candidates(ends(spark, sf), ["take"], "track", 25.0, most_gap_s=400.0)


@query("q_fragments",
    f"WITH {ENDS_SQL} SELECT b.take, b.track FROM e b WHERE EXISTS (SELECT 1 FROM e a WHERE a.take = b.take AND b.first > a.last AND b.first - a.last <= 2 * 2500 AND sqrt((a.fx - b.sx) ** 2 + (a.fy - b.sy) ** 2) <= 1.5 * 20)")
def fragments(spark, sf):
    return tracks.fragments(ends(spark, sf), ["take"], "track", 2500.0).select("take", "track")


@query("q_off_field",
    "SELECT user_id, count(*) FILTER (event_type IN ('error', 'view')) >= 2 AND count(*) FILTER (event_type IN ('error', 'view')) >= 0.5 * count(*) AS off_field FROM events GROUP BY user_id")
def off_field(spark, sf):
    return tracks.off_field_tracks(read(spark, sf, "events").select("user_id", F.col("event_type").isin("error", "view").alias("off")), ["user_id"])


@query("q_joined_teams", """WITH t AS (SELECT c_nationkey AS take, c_custkey AS track, c_custkey % 4 - 1 AS team, CASE
 WHEN c_custkey % 3 = 0 THEN c_custkey - c_custkey % 30 END AS root FROM customer)
SELECT take, coalesce(root, track) AS track_id, coalesce(arg_min(team, track) FILTER (team >= 0), -1) AS team FROM t GROUP BY ALL""")
def joined_teams(spark, sf):
    k = F.col("c_custkey")
    rows = read(spark, sf, "customer").select(F.col("c_nationkey").alias("take"), k.alias("track_id"), (k % 4 - 1).alias("team"))
    roots = read(spark, sf, "customer").filter(k % 3 == 0).select(F.col("c_nationkey").alias("take"), k.alias("track"), (k - k % 30).alias("root"))
    return tracks.joined_teams(roots, rows, ["take"]).withColumn("team", F.col("team").cast("long"))


@query("q_separation_series", """WITH d AS (SELECT user_id, event_id AS frame, event_type AS nearest, value AS distance, CASE
 WHEN event_type = lag(event_type) OVER w THEN (lag(value) OVER w - value) * 25 / (event_id - lag(event_id) OVER w) END AS closing FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, min(distance) AS least, avg(distance) AS mean, min(frame) FILTER (distance <= 2) AS first_close, max(closing) AS closing_speed FROM d
 GROUP BY user_id""")
def separation_series(spark, sf):
    rows = read(spark, sf, "events").select("user_id", F.col("event_id").alias("frame"), F.col("event_type").alias("nearest"),
        F.col("value").alias("distance"))
    return tracks.separation_summaries(rows, ["user_id"])


@query("q_moving_people", """WITH r AS (SELECT s_nationkey AS take, s_suppkey, s_suppkey % 2 = 0 AS off, s_suppkey % 4 - 1 AS team,
 (s_suppkey % 5 + 1) * 1.0::DOUBLE AS w, (s_suppkey % 7 + 1) * 1.0::DOUBLE AS h FROM supplier), p AS (SELECT * FROM r WHERE team >= 0 AND NOT off),
k AS (SELECT take FROM p GROUP BY take HAVING count(DISTINCT s_suppkey) >= 2 AND median(h / w) BETWEEN 0.5 AND 3) SELECT take, s_suppkey AS frame
 FROM p JOIN k USING (take)""")
def moving_people(spark, sf):
    k = F.col("s_suppkey")
    rows = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("take"), k.alias("frame"), F.lit("player").alias("label"),
        (k % 2 == 0).alias("off_field"), (k % 4 - 1).alias("team"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"),
        (k % 5 + 1).cast("double").alias("x2"), (k % 7 + 1).cast("double").alias("y2"))
    return tracks.moving_people(rows, ["take"], 2, (0.5, 3.0)).select("take", "frame")


@query("q_labels_redone", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0")
def labels_redone(spark, sf):
    rows = read(spark, sf, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_suppkey") % 3 == 0).alias("filled"), F.lit(1).alias("team"))
    return tracks.labels_redone(rows)


@query("q_median_cameras",
    f"SELECT s_suppkey % 30 AS take, CASE WHEN count(*) >= 4 THEN median(a) END AS x, CASE WHEN count(*) >= 4 THEN median(b) END AS y, CASE WHEN count(*) >= 4 THEN median(c) END AS z FROM {N_SQL} GROUP BY ALL")
def median_cameras(spark, sf):
    found = tracks.median_cameras(numbers(spark, sf).select((F.col("s_suppkey") % 30).alias("take"), F.array("a", "b", "c").alias("centre")),
        ["take"], least=4)
    return found.select("take", *(F.get("centre", k).alias(n) for k, n in enumerate("xyz")))


@query("q_club_of_team",
    f"SELECT s_suppkey % 10 AS game, CASE WHEN sum(abs(a - 20)) <= sum(abs(b - 20)) THEN 'away' ELSE 'home' END AS club, least(sum(abs(a - 20)), sum(abs(b - 20))) AS error FROM {N_SQL} GROUP BY ALL")
def club_of_team(spark, sf):
    return tracks.club_of_team(numbers(spark, sf).withColumn("game", F.col("s_suppkey") % 10), ["game"], F.col("a") - 20, F.col("b") - 20)


# --- boxes and reviews


@query("q_detections",
    f"SELECT frame, string_agg(label || CAST(x AS BIGINT), ' ' ORDER BY label, -score) AS boxes, sum(score) AS score FROM (SELECT * FROM {BOXED} WHERE score > CASE label WHEN 'a' THEN 1000 ELSE 3000 END) GROUP BY frame")
def detections(spark, sf):
    made = boxes.detections_document(boxed(spark, sf), ["frame"], {"a": 1000.0, "b": 3000.0}, "box_id")
    told = F.transform("boxes", lambda b: F.concat(b["label"], F.get(b["box"], 0).cast("long").cast("string")))
    # Sums depend on the order of their terms: this is the table's, as in the SQL.
    by_id = F.array_sort(F.transform("boxes", lambda b: F.struct(b["box_id"], b["score"].alias("score"))))
    return made.select("frame", F.array_join(told, " ").alias("boxes"), F.aggregate(by_id, F.lit(0.0), lambda s, b: s + b["score"]).alias("score"))


@query("q_plausible_balls", f"""WITH b AS (SELECT frame, box_id, CASE WHEN box_id % 5 = 0 THEN 'football' ELSE 'player' END AS label, x % 7 + 1 AS w,
 y % 30 + 1 AS h FROM {BOXED}), m AS (SELECT *, median(h) FILTER (label = 'player') OVER (PARTITION BY frame) AS m FROM b)
SELECT frame, box_id FROM m WHERE label <> 'football' OR (coalesce(h <= m / 3.0::DOUBLE, true) AND w <= 2.5 * h)""")
def plausible_balls(spark, sf):
    x, y = F.get("box", 0), F.get("box", 1)
    rows = boxed(spark, sf).withColumns(
        {"label": F.when(F.col("box_id") % 5 == 0, "football").otherwise("player"), "box": F.array(F.lit(0.0), F.lit(0.0), x % 7 + 1, y % 30 + 1)})
    return boxes.plausible_balls(rows, ["frame"]).select("frame", "box_id")


@query("q_weakest", f"SELECT frame, coalesce(min(coalesce(CASE WHEN box_id % 4 <> 0 THEN score / 10000 END, 1)), -1) AS weakest FROM {BOXED} GROUP BY frame UNION ALL SELECT 99, -1")
def weakest(spark, sf):
    score = F.when(F.col("box_id") % 4 != 0, F.col("score") / 10000)
    lists = boxed(spark, sf).groupBy("frame").agg(F.collect_list(F.struct(score.alias("s"))).alias("l")).select("frame",
        F.transform("l", lambda x: x["s"]).alias("l"))
    kind = lists.schema["frame"].dataType.simpleString()
    none = spark.createDataFrame([(99, [])], f"frame {kind}, l array<double>")
    return lists.union(none).select("frame", boxes.weakest(F.col("l")).alias("weakest"))


@query("q_most_disputed",
    "SELECT o_orderkey AS frame, o_orderkey % 11 AS disputed FROM orders WHERE o_orderkey % 11 > 0 AND o_orderkey NOT IN (SELECT c_custkey FROM customer) ORDER BY disputed DESC, frame LIMIT 40")
def most_disputed(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("frame"), (F.col("o_orderkey") % 11).alias("disputed"))
    return boxes.most_disputed(rows, read(spark, sf, "customer").select(F.col("c_custkey").alias("frame")), "frame", 40)


@query("q_review_lists",
    "SELECT o_custkey, array_to_string(list_sort(coalesce(list(o_orderkey) FILTER (o_orderkey % 3 = 0), [])), ' ') AS kept, array_to_string(list_sort(coalesce(list(o_orderkey) FILTER (o_orderkey % 3 = 1), [])), ' ') AS flagged, array_to_string(list_sort(coalesce(list(o_orderkey) FILTER (o_orderkey % 3 = 2), [])), ' ') AS dropped FROM orders GROUP BY o_custkey")
def review_lists(spark, sf):
    decision = pick(("keep", "flag", "drop"), F.col("o_orderkey"))
    made = boxes.review_lists(read(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("frame"), decision.alias("decision")),
        ["o_custkey"])
    return made.select("o_custkey", *(F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("kept", "flagged", "dropped")))


@query("q_reviewed_boxes",
    "SELECT frame, array_to_string([b FOR b, i IN boxes IF i - 1 NOT IN (1, 3)], ' ') AS boxes FROM (SELECT s_nationkey AS frame, list(s_suppkey ORDER BY s_suppkey) AS boxes FROM supplier GROUP BY s_nationkey)")
def reviewed_boxes(spark, sf):
    frames = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("frame")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("boxes"))
    return boxes.reviewed_boxes(frames.withColumn("removed", F.array(F.lit(1), F.lit(3)))).select("frame",
        F.array_join(F.col("boxes").cast("array<string>"), " ").alias("boxes"))


@query("q_off_suggestions",
    f"SELECT frame, box_id FROM (SELECT frame, box_id, y > 25 AS off, avg(CASE WHEN y > 25 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY frame) AS share FROM {BOXED}) WHERE off AND share <= 0.5")
def off_suggestions(spark, sf):
    return boxes.off_field_suggestions(boxed(spark, sf).withColumn("off", F.get("box", 1) > 25), ["frame"], "off").select("frame", "box_id")


@query("q_duplicate_boxes", f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY frame, label ORDER BY score DESC, box_id) AS i
 FROM {BOXED}), k AS (SELECT frame, label, 1::BIGINT AS i, [struct_pack(id := box_id, x := x, y := y)] AS kept FROM o WHERE i = 1 UNION ALL
 SELECT o.frame, o.label, o.i, CASE WHEN len(list_filter(k.kept, lambda b: greatest(0, 30 - abs(b.x - o.x)) * greatest(0,
 30 - abs(b.y - o.y)) / (1800 - greatest(0, 30 - abs(b.x - o.x)) * greatest(0, 30 - abs(b.y - o.y))) > 0.5)) > 0 THEN k.kept ELSE list_append(k.kept,
 struct_pack(id := o.box_id, x := o.x, y := o.y)) END FROM k JOIN o ON o.frame = k.frame AND o.label = k.label AND o.i = k.i + 1),
l AS (SELECT frame, label, arg_max(kept, i) AS kept FROM k GROUP BY ALL) SELECT frame, label, unnest(list_transform(kept, lambda b: b.id)) AS box_id
 FROM l""")
def duplicate_boxes(spark, sf):
    return boxes.without_duplicates(boxed(spark, sf), ["frame", "label"], most=0.5).select("frame", "label", "box_id")


@query("q_box_matching", f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY frame, label ORDER BY score DESC, x, y) AS i
 FROM {BOXED} WHERE box_id % 2 = 0), t AS (SELECT frame, label, list(struct_pack(x := x, y := y) ORDER BY x, y) AS free, count(*) AS n
 FROM {BOXED} WHERE box_id % 2 = 1 GROUP BY ALL),
k AS (SELECT f.frame, f.label, 0::BIGINT AS i, coalesce(any_value(t.free), []) AS free, 0 AS hit FROM f LEFT JOIN t USING (frame, label)
 GROUP BY ALL UNION ALL
 SELECT frame, label, i, CASE WHEN best.s >= 0.3 THEN free[1:best.p - 1] || free[best.p + 1:] ELSE free END, hit + CASE WHEN best.s >= 0.3 THEN 1
 ELSE 0 END FROM (SELECT f.frame, f.label, f.i, k.free, k.hit, list_max(list_transform(k.free, lambda b, p: struct_pack(s := greatest(0,
 30 - abs(b.x - f.x)) * greatest(0, 30 - abs(b.y - f.y)) / (1800 - greatest(0, 30 - abs(b.x - f.x)) * greatest(0, 30 - abs(b.y - f.y))), q := -p,
 p := p))) AS best FROM k JOIN f ON f.frame = k.frame AND f.label = k.label AND f.i = k.i + 1)),
m AS (SELECT frame, label, max(hit) AS hit FROM k GROUP BY ALL), n AS (SELECT frame, label, count(*) FILTER (box_id % 2 = 0) AS found,
 count(*) FILTER (box_id % 2 = 1) AS truth FROM {BOXED} GROUP BY ALL),
s AS (SELECT label, CAST(sum(coalesce(hit, 0)) AS BIGINT) AS hit, CAST(sum(found - coalesce(hit, 0)) AS BIGINT) AS wrong,
 CAST(sum(truth - coalesce(hit, 0)) AS BIGINT) AS missed FROM n LEFT JOIN m USING (frame, label) GROUP BY label)
SELECT *, hit / greatest(1, hit + wrong)::DOUBLE AS precision, hit / greatest(1, hit + missed)::DOUBLE AS recall FROM s""")
def box_matching(spark, sf):
    rows = boxed(spark, sf)
    return boxes.scores(boxes.matched(rows.filter("box_id % 2 = 0"), rows.filter("box_id % 2 = 1"), ["frame", "label"], 0.3), ["label"])


@query("q_tilt", """WITH s AS (SELECT event_type, value, radians(value % 180) * 2 AS a, quantile_cont(value, 0.85) OVER (PARTITION BY event_type) AS f
 FROM events) SELECT event_type, degrees(atan2(sum(value * sin(a)), sum(value * cos(a))) / 2) AS tilt FROM s WHERE value >= f GROUP BY event_type""")
def tilt(spark, sf):
    return models.dominant_orientation(read(spark, sf, "events").withColumn("angle", F.col("value") % 180), ["event_type"], "angle", "value")


_BINS_SQL = ", ".join(f"coalesce(sum(value) FILTER (k = {b}), 0) / sum(value) AS h{b}" for b in range(18))


@query("q_orientations", f"SELECT event_type, {_BINS_SQL} FROM (SELECT event_type, value, floor(value % 180 / 10) AS k FROM events) GROUP BY event_type")
def orientations(spark, sf):
    found = models.orientation_histogram(read(spark, sf, "events").withColumn("angle", F.col("value") % 180), ["event_type"], "angle", "value")
    return found.select("event_type", *(F.get("histogram", k).alias(f"h{k}") for k in range(18)))


@query("q_block_means", "SELECT c_nationkey, c_custkey % 40 // 8 AS bx, c_custkey % 27 // 9 AS by, avg(c_acctbal) AS mean FROM customer GROUP BY ALL")
def block_means(spark, sf):
    rows = read(spark, sf, "customer").select("c_nationkey", (F.col("c_custkey") % 40).alias("x"), (F.col("c_custkey") % 27).alias("y"), "c_acctbal")
    return models.block_means(rows, ["c_nationkey"], "x", "y", "c_acctbal", 8, 9)


# --- streams, runs, splits


@query("q_match_in_order",
    "WITH d AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'click'), o AS (SELECT user_id, event_id AS official, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'purchase') SELECT user_id, event_id, official FROM d LEFT JOIN o USING (user_id, n)")
def match_in_order(spark, sf):
    rows = read(spark, sf, "events")
    found = rows.filter("event_type = 'click'").select("user_id", "event_id")
    return stream.match_in_order(found, rows.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("official")), ["user_id"],
        "event_id", "official")


@query("q_since", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00'")
def since(spark, sf):
    rows = read(spark, sf, "events").select("event_id",
        F.struct(tables.utc_stamp(F.col("ts").cast("timestamp")).alias("at"), F.col("ts").alias("ts")).alias("generated"))
    return stream.since(rows, "2024-01-10T00:00:00Z").select("event_id")


@query("q_sliding", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS s FROM events) GROUP BY ALL")
def sliding(spark, sf):
    return stream.sliding(read(spark, sf, "events"), "ts", "6 hours", "3 hours", ["event_type"])


@query("q_action_counts", "SELECT o_orderstatus AS action, count(*) AS n FROM orders GROUP BY ALL")
def action_counts(spark, sf):
    return runner.action_counts(read(spark, sf, "orders").select(F.col("o_orderstatus").alias("action")))


@query("q_training_split",
    "WITH d AS (SELECT c_custkey AS frame FROM customer WHERE c_custkey % 3 = 0 UNION SELECT c_custkey + 1 FROM customer WHERE c_custkey % 7 = 0) SELECT o_orderkey AS frame, 'p' || (o_orderkey % 50) AS play_uid, CASE WHEN o_orderkey % 50 < 8 THEN 'val' ELSE 'train' END AS split FROM orders WHERE o_orderkey NOT IN (SELECT frame FROM d)")
def training_split(spark, sf):
    k = F.col("c_custkey")
    kept = F.when(k % 3 == 0, F.array(F.struct(k.alias("frame"), F.lit("x").alias("boxes"))))
    documents = read(spark, sf, "customer").select(k.alias("game"), kept.alias("kept"), F.when(k % 7 == 0, F.array(k + 1)).alias("flagged"),
        F.lit(None).cast("array<long>").alias("dropped"))
    documents = documents.withColumn("kept", F.coalesce("kept", F.array().cast("array<struct<frame:bigint,boxes:string>>")))
    frames = read(spark, sf, "orders").select(F.col("o_orderkey").alias("frame"))
    samples = frames.withColumn("play_uid", F.concat(F.lit("p"), (F.col("frame") % 50).cast("string")))
    return tables.training_split(frames, samples, tables.held_out_frames(documents), F.substring("play_uid", 2, 9).cast("int") < 8)


@query("q_labelled_frames", "SELECT c_nationkey AS game, c_custkey AS frame, c_mktsegment AS boxes FROM customer")
def labelled_frames(spark, sf):
    documents = read(spark, sf,
        "customer").groupBy(F.col("c_nationkey").alias("game")).agg(
        F.collect_list(F.struct(F.col("c_custkey").alias("frame"), F.col("c_mktsegment").alias("boxes"))).alias("kept"))
    return tables.labelled_frames(documents, "game")
