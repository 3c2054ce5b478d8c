"""The relational operators over the supplied tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import plays as P
from fieldglass.functions.geometry import anchor, line_x_facing, overlap, painted_number, snap_frame, through
from fieldglass.operators import boxes, joins, play_query, sampling, sequence, tracks
from fieldglass.operators.field import dash_window, scrimmage_lines
from fieldglass.plans.registry import events, query, read
from fieldglass.sources import tables
from fieldglass.streaming import film

# --- filters, metrics, ranking


@query("q_group_metrics", """
SELECT p_brand, p_type, count(*) AS n, avg(l_extendedprice) AS mean_value, avg(CASE WHEN l_extendedprice > 40000 THEN 1.0::DOUBLE
 ELSE 0 END) AS big_share, avg(l_quantity) AS mean_quantity
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.02 AND 0.08
GROUP BY ALL HAVING count(*) >= 5 ORDER BY mean_value DESC, p_brand, p_type LIMIT 40""")
def group_metrics(spark, sf):
    rows = read(spark, sf,
        "lineitem").filter((F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")) & F.col("l_discount").between(0.02, 0.08))
    joined = rows.select("l_partkey", "l_extendedprice", "l_quantity").join(read(spark, sf, "part").select("p_partkey", "p_brand", "p_type"),
        F.col("l_partkey") == F.col("p_partkey"))
    share = F.avg(F.when(F.col("l_extendedprice") > 40000, F.lit(1.0)).otherwise(F.lit(0.0)))
    groups = joined.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("mean_value"), share.alias("big_share"),
        F.avg("l_quantity").alias("mean_quantity")).filter("n >= 5")
    return groups.orderBy(F.desc("mean_value"), "p_brand", "p_type").limit(40)


def as_plays(spark, sf) -> DataFrame:
    """lineitem under the names of the query tools."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return read(spark, sf, "lineitem").select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("play_uid"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("play_index"),
        F.col("l_linenumber").alias("qtr"), (F.col("l_suppkey") % 4 + 1).alias("down"), F.col("l_quantity").cast("int").alias("ydstogo"),
        (F.col("l_partkey") % 100).alias("yardline_100"), F.col("l_returnflag").alias("play_type"), F.col("l_linestatus").alias("off_formation"),
        (F.col("l_extendedprice") - 25000).alias("epa"), F.col("l_quantity").alias("yards_gained"), flag(F.col("l_discount") > 0.05).alias("shotgun"))


PLAYS_SQL = """(SELECT l_orderkey || '_' || l_linenumber AS play_uid, l_orderkey * 8 + l_linenumber AS play_index, l_linenumber AS qtr,
 l_suppkey % 4 + 1 AS down, CAST(trunc(l_quantity) AS INTEGER) AS ydstogo, l_partkey % 100 AS yardline_100,
 l_returnflag AS play_type, l_linestatus AS off_formation, l_extendedprice - 25000 AS epa, l_quantity AS yards_gained, CASE
 WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END AS shotgun FROM lineitem)"""


@query("q_filter_count",
    f"SELECT count(*) AS count FROM {PLAYS_SQL} WHERE play_type = 'R' AND off_formation = 'F' AND down = 3 AND ydstogo >= 5 AND ydstogo <= 20 AND yardline_100 <= 20 AND shotgun = 1")
def filter_count(spark, sf):
    plays = as_plays(spark, sf)
    return plays.filter(play_query.predicate(plays.columns,
        {"play_type": "R", "off_formation": "f", "down": 3, "distance_min": 5, "distance_max": 20, "red_zone": True, "shotgun": True, "sack": True,
        "offense": "not a team"})).agg(F.count("*").alias("count"))


@query("q_filter_topk",
    f"SELECT play_uid, qtr, down, ydstogo, play_type, off_formation, yards_gained, epa FROM {PLAYS_SQL} WHERE down = 2 AND yardline_100 > 20 ORDER BY play_index, play_uid LIMIT 50")
def filter_topk(spark, sf):
    return play_query.matching_plays(as_plays(spark, sf), limit=50, down=2, red_zone=False)


@query("q_tri_state_flags",
    "SELECT lang, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS poor, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality IS NULL) AS unread FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def tri_state(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("poor"),
        F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality").isNull()).alias("unread"))


@query("q_histogram",
    "SELECT l_returnflag, CAST(b AS INTEGER) AS bin, count(l_quantity) AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) CROSS JOIN range(0, 9) t(b) LEFT JOIN (SELECT l_returnflag AS f, l_quantity, greatest(0, least(8, floor((l_quantity - 5) / 5))) AS k FROM lineitem) ON f = l_returnflag AND k = b GROUP BY ALL")
def histogram(spark, sf):
    return sampling.histogram(read(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", 5, 50, 5)


@query("q_grade_table",
    "SELECT lang AS bucket, count(*) FILTER (quality = 0) AS \"0\", count(*) FILTER (quality = 1) AS \"1\", count(*) FILTER (quality IS NULL) AS ungraded FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def grade_table(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return sampling.grade_table(rows, F.col("lang"), "quality", ["0", "1"])


# --- joins


@query("q_label_merge",
    "SELECT doc_id, lang AS lang_original, coalesce(CASE WHEN toxic = 1 THEN 'flagged' END, lang) AS lang, quality, CASE WHEN quality IS NOT NULL THEN 'merged' END AS labels_source FROM documents LEFT JOIN labels USING (doc_id)")
def label_merge(spark, sf):
    right = read(spark, sf, "labels").select(F.col("doc_id").alias("label_id"), "quality", F.when(F.col("toxic") == 1, "flagged").alias("lang"))
    return joins.label_merge(read(spark, sf, "documents").select("doc_id", "lang"), right, "doc_id", "label_id", ["quality"], "lang")


@query("q_resolve_alias",
    "SELECT s_suppkey, n_name, n.n_nationkey AS resolved, 1::BIGINT AS hits FROM supplier JOIN nation n ON s_nationkey = n.n_nationkey")
def resolve_alias(spark, sf):
    nations = read(spark, sf, "nation")
    asked = read(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return joins.resolve(asked, joins.alias_table(nations, "n_nationkey", "n_name"), "n_name")


@query("q_zip_join", """WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS ordinal
 FROM conversations WHERE role IN ('user', 'assistant'))
SELECT u.conv_id, u.ordinal, u.turn AS asked, a.turn AS answered FROM t u JOIN t a ON u.conv_id = a.conv_id AND u.ordinal = a.ordinal
 AND u.role = 'user' AND a.role = 'assistant'""")
def zip_join(spark, sf):
    turns = read(spark, sf, "conversations")
    of = lambda role, name: turns.filter(F.col("role") == role).select("conv_id", F.col("turn").alias(name))
    return joins.zip_join(of("user", "asked"), of("assistant", "answered"), ["conv_id"], "asked", "answered")


@query("q_interval_join", """WITH e AS (SELECT *, epoch_us(ts) AS t FROM events), s AS (SELECT event_id AS span_id, user_id, t AS a,
 t + 86400000000 AS b FROM e WHERE event_type = 'signup')
SELECT e.event_id, e.user_id, min(s.span_id) AS span_id FROM e JOIN s ON e.user_id = s.user_id AND e.t >= s.a AND e.t < s.b
 WHERE e.event_type = 'purchase' GROUP BY ALL""")
def interval_join(spark, sf):
    rows = events(spark, sf)
    spans = rows.filter("event_type = 'signup'").select(F.col("event_id").alias("span_id"), "user_id", F.col("t").alias("a"),
        (F.col("t") + 86_400_000_000).alias("b"))
    points = rows.filter("event_type = 'purchase'").select("event_id", "user_id", "t")
    return joins.interval_join(points, spans, ["user_id"], "t", "a", "b", 86_400_000_000.0, ["span_id"], ["event_id"]).select("event_id", "user_id",
        "span_id")


@query("q_asof_join",
    """WITH e AS (SELECT *, epoch_us(ts) AS t FROM events) SELECT l.event_id, l.user_id, (SELECT min(r.t) FROM e r WHERE r.user_id = l.user_id
 AND r.event_type = 'purchase' AND r.t >= l.t) AS matched_t FROM e l WHERE l.event_type = 'error'""")
def asof_join(spark, sf):
    rows = events(spark, sf)
    return joins.asof_join(rows.filter("event_type = 'error'").select("event_id", "user_id", "t"),
        rows.filter("event_type = 'purchase'").select("user_id", "t", "value"), ["user_id"], "t", "t", ["value"], forward=True).select("event_id",
        "user_id", "matched_t")


@query("q_anti_seen", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_seen(spark, sf):
    return joins.unseen(read(spark, sf, "documents").select("doc_id", "lang"), read(spark, sf, "labels"), ["doc_id"])


@query("q_nearest", """WITH n AS (SELECT s_suppkey AS k, s_nationkey AS r, s_acctbal AS x FROM supplier), p AS (SELECT a.r, a.k, b.k AS o,
 abs(a.x - b.x) AS d, row_number() OVER (PARTITION BY a.k ORDER BY abs(a.x - b.x), b.k) AS i FROM n a JOIN n b ON a.r = b.r AND a.k <> b.k)
SELECT r, k, o AS nearest_id, d AS distance FROM p WHERE i = 1""")
def nearest(spark, sf):
    rows = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("r"), F.col("s_acctbal").alias("x"))
    other = rows.select("r", F.col("k").alias("o"), F.col("x").alias("y"))
    found = joins.nearest(rows, other, ["r"], F.when(F.col("k") != F.col("o"), F.abs(F.col("x") - F.col("y"))).otherwise(F.lit(float("inf"))), ["k"],
        "o")
    return found.filter(F.col("distance") < float("inf"))


@query("q_upsert", "SELECT doc_id, quality, toxic FROM labels WHERE toxic = 0 UNION ALL SELECT doc_id, 0 AS quality, toxic FROM labels WHERE toxic = 1")
def upsert(spark, sf):
    old = read(spark, sf, "labels")
    return joins.upsert(old, old.filter("toxic = 1").withColumn("quality", F.lit(0)), ["doc_id"])


@query("q_layers", """WITH e AS (SELECT user_id, event_type, max(value) AS v FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY ALL)
SELECT user_id, coalesce(max(v) FILTER (event_type = 'error'), max(v) FILTER (event_type = 'click'), max(v) FILTER (event_type = 'view')) AS v FROM e
 GROUP BY user_id""")
def layers(spark, sf):
    rows = read(spark, sf, "events").filter(F.col("event_type").isin("view", "click", "error")).groupBy("user_id",
        F.col("event_type").alias("layer")).agg(F.max("value").alias("v"))
    return film.merged(rows, ["user_id"], ["v"], ("view", "click", "error"))


# --- sequences

ORDERED = ["t", "event_id"]


@query("q_conditional_index",
    "SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN CAST(count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS play_index FROM events")
def conditional_index(spark, sf):
    return sequence.numbered_where(events(spark, sf), ["user_id"], ORDERED, F.col("event_type") == "purchase").select("event_id", "user_id",
        "play_index")


@query("q_islands", """WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id
 ORDER BY ts, event_id) > 43200000000 THEN 1 ELSE 0 END AS c FROM events),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e)
SELECT user_id, CAST(island AS BIGINT) AS island, min(t) AS first, max(t) AS last, count(*) AS rows FROM i GROUP BY ALL""")
def islands(spark, sf):
    return tracks.count_islands(events(spark, sf), ["user_id"], "t", 43_200_000_000).withColumn("island", F.col("island").cast("long"))


@query("q_absorb_short", """WITH e AS (SELECT user_id, epoch_us(ts) AS t, value FROM events), c AS (SELECT *, CASE WHEN row_number() OVER w > 1
 AND value > 60 THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM c), s AS (SELECT user_id, run, min(t) AS start,
 max(t) - min(t) + 60 AS duration, count(*) AS samples FROM r GROUP BY ALL),
k AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY start) = 1 OR duration >= 86400000000 THEN 1 ELSE 0 END AS stays FROM s),
 h AS (SELECT *, sum(stays) OVER (PARTITION BY user_id ORDER BY start ROWS UNBOUNDED PRECEDING) - 1 AS shot_index FROM k)
SELECT user_id, CAST(shot_index AS BIGINT) AS shot_index, min(start) AS start, max(start + duration) - min(start) AS duration,
 CAST(sum(samples) AS BIGINT) AS samples FROM h GROUP BY ALL""")
def absorb_short(spark, sf):
    runs = sequence.islands(events(spark, sf), ["user_id"], ["t"], F.col("value") > 60, "run")
    shots = runs.groupBy("user_id", "run").agg(F.min("t").alias("start"), (F.max("t") - F.min("t") + 60).alias("duration"),
        F.count("*").alias("samples"))
    return sequence.absorb_short(shots, ["user_id"], "start", "duration", 86_400_000_000).withColumn("shot_index", F.col("shot_index").cast("long"))


@query("q_merge_runs", """WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS t, event_id FROM events), c AS (SELECT *, CASE
 WHEN event_type IS DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS c FROM e WINDOW w AS (PARTITION BY user_id
 ORDER BY t, event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT user_id,
 CAST(run AS BIGINT) AS run, event_type, min(t) AS first, max(t) AS last, count(*) AS rows FROM r GROUP BY ALL""")
def merge_runs(spark, sf):
    return sequence.merged_runs(events(spark, sf), ["user_id"], "t", "event_type").withColumn("run", F.col("run").cast("long"))


@query("q_pair_rows", """WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id, i // 2 AS pair, max(role) FILTER (i % 2 = 0) AS role_1, max(role) FILTER (i % 2 = 1) AS role_2,
 max(turn) FILTER (i % 2 = 0) AS turn_1, max(turn) FILTER (i % 2 = 1) AS turn_2 FROM r GROUP BY ALL HAVING count(*) = 2""")
def pair_rows(spark, sf):
    return sequence.paired(read(spark, sf, "conversations"), ["conv_id"], "turn", "role")




@query("q_spike_flags", """WITH n AS (SELECT event_id, user_id, value, row_number() OVER w AS i, list(value) OVER (PARTITION BY user_id ORDER BY ts,
 event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS a, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING
 AND 4 FOLLOWING) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, i > 1 AND value >= 8 AND value >= 2.5 * greatest(coalesce(list_median(list_concat(coalesce(a, []), coalesce(b, []))), 0),
 1) AS is_cut FROM n""")
def spike_flags(spark, sf):
    return sequence.spikes(events(spark, sf), ["user_id"], ORDERED, "value").select("event_id", "user_id", "is_cut")


@query("q_local_max", """WITH n AS (SELECT event_id, user_id, value, event_type = 'signup' AS known, row_number() OVER w AS i, max(value)
 OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS top, max(CASE WHEN event_type = 'signup' THEN 1
 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near,
 list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS a, list(value) OVER (PARTITION BY user_id
 ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id FROM n WHERE i > 1 AND near = 0 AND value = top AND value >= 4 AND value >= 2 * greatest(list_median(list_concat(coalesce(a,
 []), coalesce(b, []))), 0.000001)""")
def local_max(spark, sf):
    return sequence.local_jumps(events(spark, sf).withColumn("known", F.col("event_type") == "signup"), ["user_id"], ORDERED, "value",
        "known").filter("is_candidate").select("event_id", "user_id")


@query("q_longest_run", """WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type IN ('view',
 'click') AS f FROM events), g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY user_id ORDER BY i) > 2 THEN 1 ELSE 0 END AS c FROM f WHERE f),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM g), s AS (SELECT user_id, run, min(i) AS first,
 max(i) AS last FROM r GROUP BY ALL)
SELECT user_id, first, last, last - first + 1 AS length FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last - first DESC,
 first) = 1""")
def longest_run(spark, sf):
    return sequence.longest_run(events(spark, sf).withColumn("o", F.struct("t", "event_id")), ["user_id"], "o",
        F.col("event_type").isin("view", "click"), 1)


@query("q_rolling_mean_range",
    "SELECT event_id, user_id, avg(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 3600000000 RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS value_s FROM events")
def rolling_mean(spark, sf):
    return sequence.rolling_mean(events(spark, sf).withColumn("hour", F.floor(F.col("t") / 3_600_000_000)), ["user_id"], "hour",
        ["value"]).select("event_id", "user_id", "value_s")


@query("q_gap_fill", """WITH d AS (SELECT o_custkey AS k, o_orderdate::DATE - DATE '1990-01-01' AS day, sum(o_totalprice) AS v FROM orders
 GROUP BY ALL), n AS (SELECT *, lead(day) OVER (PARTITION BY k ORDER BY day) AS d2, lead(v) OVER (PARTITION BY k ORDER BY day) AS v2 FROM d)
SELECT k, day, v, false AS filled FROM d UNION ALL SELECT k, CAST(x AS BIGINT) AS day,
 v * (1 - (x - day) / (d2 - day)::DOUBLE) + v2 * ((x - day) / (d2 - day)::DOUBLE) AS v, true AS filled FROM n, unnest(range(day + 1, d2)) t(x)
 WHERE d2 - day > 1 AND d2 - day - 1 <= 10""")
def gap_fill(spark, sf):
    days = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"),
        F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long").alias("day")).agg(F.sum("o_totalprice").alias("v"))
    return sequence.filled_gaps(days, ["k"], "day", ["v"], 10)


@query("q_first_sustained", """WITH e AS (SELECT user_id, epoch_us(ts) AS t, value FROM events), f AS (SELECT *, CASE WHEN value > 20 THEN 1
 ELSE 0 END AS fast, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nxt FROM e),
h AS (SELECT *, min(fast) OVER w = 1 AND count(*) OVER w = 3 AS held FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW
 AND 2 FOLLOWING)), s AS (SELECT user_id, min(t) FILTER (held) AS sustained FROM h GROUP BY user_id)
SELECT s.user_id, sustained, (SELECT max(nxt) FROM h WHERE h.user_id = s.user_id AND h.value < 5 AND h.t < s.sustained) AS found FROM s""")
def first_sustained(spark, sf):
    return sequence.first_sustained(events(spark, sf), ["user_id"], "t", "value", 20.0, 3, 5.0)


@query("q_changes", "SELECT event_id, user_id, CAST(sum(CASE WHEN event_type <> 'view' AND event_type IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS drive FROM (SELECT *, last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)")
def changes(spark, sf):
    return sequence.changes_counted(events(spark, sf).withColumn("poss", F.when(F.col("event_type") != "view", F.col("event_type"))), ["user_id"],
        "t", "poss").select("event_id", "user_id", "drive")


@query("q_jump_flags",
    "SELECT event_id, user_id, value > greatest(12, 4 * coalesce(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), 0)) AS is_cut FROM events")
def jump_flags(spark, sf):
    return sequence.jump_flags(events(spark, sf), ["user_id"], "t", "value").select("event_id", "user_id", "is_cut")


@query("q_count_merge", """WITH s AS (SELECT conv_id, turn, role IN ('user', 'system') AS v, length(text) AS j FROM conversations), m AS (SELECT *,
 coalesce(v = lag(v) OVER (PARTITION BY conv_id ORDER BY turn), false) AS same, count(*) OVER (PARTITION BY conv_id) - 4 AS need FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, same ORDER BY j, turn) AS k FROM m) SELECT conv_id, turn, CAST(sum(CASE WHEN (same
 AND k <= need) OR i = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS home FROM (SELECT *,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM r)""")
def count_merge(spark, sf):
    turns = read(spark, sf, "conversations").select("conv_id", "turn", F.col("role").isin("user", "system").alias("v"), F.length("text").alias("j"),
        F.lit(4).alias("wanted"))
    return sequence.count_guided_merge(turns, ["conv_id"], "turn", "v", "j", "wanted").select("conv_id", "turn",
        F.col("home").cast("long").alias("home"))


@query("q_resampled", """WITH e AS (SELECT user_id, epoch_us(ts) / 3600000000.0::DOUBLE AS h, value, lead(epoch_us(ts) / 3600000000.0::DOUBLE)
 OVER w AS h2, lead(value) OVER w AS v2 FROM events WHERE user_id < 20 WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, CAST(k AS BIGINT) AS h, value + (v2 - value) * ((k - h) / (h2 - h)) AS value FROM e, unnest(range(CAST(ceil(h) AS BIGINT),
 CAST(ceil(h2) AS BIGINT))) t(k) WHERE h2 IS NOT NULL""")
def resampled(spark, sf):
    rows = events(spark, sf).filter("user_id < 20").select("user_id", (F.col("t") / F.lit(3_600_000_000.0)).alias("h"), "value")
    return sequence.resampled(rows, ["user_id"], "h", "value")


# --- tracks, votes, summaries


@query("q_vote_argmax",
    "SELECT user_id, event_type AS label, w AS weight FROM (SELECT user_id, event_type, sum(value) AS w FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY w DESC, event_type DESC) = 1")
def vote_argmax(spark, sf):
    return tracks.dominant(read(spark, sf, "events"), ["user_id"], "event_type", "value")


@query("q_track_summary", """WITH e AS (SELECT user_id, epoch_us(ts) // 3600000000 AS frame, avg(value) / 100 AS conf FROM events GROUP BY ALL),
 g AS (SELECT *, frame - lag(frame) OVER (PARTITION BY user_id ORDER BY frame) > 1 AS gap FROM e)
SELECT user_id, min(frame) AS first, max(frame) AS last, count(*) AS seen, count(*) FILTER (gap) AS gaps, avg(conf) AS mean_conf,
 count(*) / (max(frame) - min(frame) + 1)::DOUBLE AS coverage, avg(conf) * (count(*) / (max(frame) - min(frame) + 1)::DOUBLE) AS confidence FROM g
 GROUP BY user_id""")
def track_summary(spark, sf):
    rows = events(spark, sf).groupBy("user_id", F.floor(F.col("t") / 3_600_000_000).alias("frame")).agg((F.avg("value") / 100).alias("conf"))
    return tracks.track_summaries(rows, ["user_id"])


@query("q_track_ends", """WITH e AS (SELECT user_id, event_id AS frame, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS up,
 row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS down FROM events)
SELECT user_id, min(frame) AS first, max(frame) AS last, regr_slope(x, frame) FILTER (up <= 10) AS v_start, regr_slope(x,
 frame) FILTER (down <= 10) AS v_finish, max(x) FILTER (up = 1) AS x_start, max(x) FILTER (down = 1) AS x_finish FROM e GROUP BY user_id
 HAVING count(*) >= 3""")
def track_ends(spark, sf):
    x = F.col("value")
    rows = read(spark, sf, "events").select("user_id", F.col("event_id").alias("frame"), x.alias("x1"), x.alias("x2"), F.lit(0.0).alias("y1"),
        F.lit(10.0).alias("y2"))
    ends = tracks.track_ends(rows, ["user_id"])
    return ends.select("user_id", "first", "last", F.col("start.vx").alias("v_start"), F.col("finish.vx").alias("v_finish"),
        F.col("start.x").alias("x_start"), F.col("finish.x").alias("x_finish"))


@query("q_team_votes",
    "SELECT user_id, coalesce(CAST(median(value - 25) FILTER (abs(value - 25) >= 10) > 0 AS INTEGER), -1) AS team FROM events GROUP BY user_id")
def team_votes(spark, sf):
    rows = read(spark, sf, "events").select("user_id", (F.col("value") - 25).alias("margin"))
    return tracks.team_votes(rows, rows, ["user_id"], 10.0)


@query("q_modal_shift", """WITH e AS (SELECT user_id, round(value / 5) * 5 AS s, value AS r FROM events), c AS (SELECT user_id, s, count(*) AS n
 FROM e GROUP BY ALL), b AS (SELECT user_id, s FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s) = 1)
SELECT e.user_id, b.s AS shift, (SELECT count(*) FROM e x WHERE x.user_id = e.user_id) AS frames, count(*) / (SELECT count(*) FROM e x
 WHERE x.user_id = e.user_id)::DOUBLE AS agree, median(r) AS residual FROM e JOIN b USING (user_id, s) GROUP BY e.user_id, b.s""")
def modal_shift(spark, sf):
    rows = read(spark, sf, "events").select("user_id", (F.round(F.col("value") / 5) * 5).alias("s"), F.col("value").alias("r"))
    return tracks.modal_shift(rows, ["user_id"], "s", "r")


@query("q_kinematics",
    """WITH s AS (SELECT user_id, abs(value - lag(value) OVER w) AS d, event_id - lag(event_id) OVER w AS g FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, coalesce(sum(d), 0) AS distance, coalesce(max(d * 25.0::DOUBLE / g),
 0) AS top_speed FROM s GROUP BY user_id""")
def kinematics(spark, sf):
    return tracks.kinematics(read(spark, sf, "events").withColumn("y", F.lit(0.0)), ["user_id"], "event_id", "value", "y", 25.0)


@query("q_separation",
    """WITH p AS (SELECT s_nationkey AS frame, s_suppkey AS id, s_acctbal AS x FROM supplier), d AS (SELECT a.frame, a.id AS target, b.id AS nearest,
 abs(a.x - b.x) AS distance FROM p a JOIN p b ON a.frame = b.frame WHERE a.id % 2 = 0 AND b.id % 2 = 1) SELECT * FROM d QUALIFY row_number()
 OVER (PARTITION BY frame, target ORDER BY distance, nearest) = 1""")
def separation(spark, sf):
    rows = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("frame"), F.col("s_suppkey").alias("track_id"),
        F.col("s_acctbal").alias("x_yd"), F.lit(0.0).alias("y_yd"))
    return tracks.separations(rows, ["frame"], F.col("track_id") % 2 == 0, F.col("track_id") % 2 == 1)


@query("q_mode_median",
    "SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS middle, quantile_cont(l_quantity, 0.2) AS low, quantile_cont(l_quantity, 0.8) AS high, stddev_pop(l_quantity) AS deviation FROM lineitem GROUP BY ALL")
def mode_median(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.percentile("l_extendedprice", 0.5).alias("middle"),
        F.percentile("l_quantity", 0.2).alias("low"), F.percentile("l_quantity", 0.8).alias("high"), F.stddev_pop("l_quantity").alias("deviation"))


@query("q_windowed_shares",
    """WITH e AS (SELECT user_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
 SELECT user_id, i // 10 AS "window", avg(CASE WHEN i > 0 THEN CASE WHEN event_type = 'view' THEN 1.0::DOUBLE ELSE 0 END END) AS moving,
 median(value) AS median, stddev_pop(value) AS deviation, avg(value) AS mean FROM e GROUP BY ALL HAVING count(*) = 10""")
def windowed_shares(spark, sf):
    return sampling.windowed_shares(events(spark, sf), ["user_id"], "t", "value", F.col("event_type") == "view", 10)


@query("q_latency", "SELECT event_type, count(value) / sum(value) AS rate, avg(value) AS mean, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY ALL")
def latency(spark, sf):
    return sampling.latency_summary(read(spark, sf, "events"), ["event_type"], "value")


# --- boxes and matching

BOXED = """(SELECT s_nationkey AS frame, CASE WHEN s_suppkey % 3 = 0 THEN 'a' ELSE 'b' END AS label, s_suppkey AS box_id,
 (s_suppkey * 7 % 40)::DOUBLE AS x, (s_suppkey * 11 % 40)::DOUBLE AS y, s_acctbal AS score FROM supplier)"""


def boxed(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k * 7 % 40).cast("double"), (k * 11 % 40).cast("double")
    return read(spark, sf, "supplier").select(F.col("s_nationkey").alias("frame"), F.when(k % 3 == 0, "a").otherwise("b").alias("label"),
        k.alias("box_id"), F.array(x, y, x + 30, y + 30).alias("box"), F.col("s_acctbal").alias("score"))


@query("q_box_overlap",
    f"""SELECT a.frame, a.box_id, coalesce(max(greatest(0, 30 - abs(a.x - b.x)) * greatest(0,
 30 - abs(a.y - b.y)) / 900) FILTER (a.box_id <> b.box_id), 0) AS covered FROM {BOXED} a JOIN {BOXED} b ON a.frame = b.frame GROUP BY ALL""")
def box_overlap(spark, sf):
    return boxes.overlap_shares(boxed(spark, sf), ["frame"], "box_id")


@query("q_box_pairs",
    f"""SELECT a.frame, a.box_id, b.box_id AS other, i / (1800 - i) AS iou FROM {BOXED} a JOIN {BOXED} b ON a.frame = b.frame AND a.box_id < b.box_id,
 LATERAL (SELECT greatest(0, 30 - abs(a.x - b.x)) * greatest(0, 30 - abs(a.y - b.y)) AS i)""")
def box_pairs(spark, sf):
    a = boxed(spark, sf).select("frame", "box_id", "box")
    b = a.select("frame", F.col("box_id").alias("other"), F.col("box").alias("b"))
    sides = lambda c: [F.get(F.col(c), k) for k in range(4)]
    return a.join(b, "frame").filter("box_id < other").select("frame", "box_id", "other", overlap(sides("box"), sides("b")).alias("iou"))


@query("q_frame_order",
    "SELECT d.doc_id, coalesce(quality, 1) AS q, n_chars FROM documents d LEFT JOIN labels USING (doc_id) ORDER BY coalesce(toxic, 0) DESC, n_chars, d.doc_id")
def frame_order(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "n_chars").join(read(spark, sf, "labels"), "doc_id", "left").withColumn("disputed",
        F.coalesce("toxic", F.lit(0)))
    return boxes.review_order(rows, "disputed", "n_chars", "doc_id").select("doc_id", F.coalesce("quality", F.lit(1)).alias("q"), "n_chars")


@query("q_review_order",
    "SELECT d.doc_id, coalesce(quality, 1) AS q, n_chars FROM documents d LEFT JOIN labels USING (doc_id) ORDER BY coalesce(toxic, 0) DESC, n_chars, d.doc_id LIMIT 100")
def review_order(spark, sf):
    """The first page of q_frame_order, which has the whole order."""
    return frame_order(spark, sf).limit(100)


# --- text, hashes, keys, nested


@query("q_hash_split", """WITH h AS (SELECT doc_id, sha1(CAST(doc_id AS VARCHAR)) AS h FROM documents)
SELECT doc_id, CASE WHEN CAST('0x' || substr(h, 1, 8) AS BIGINT) / 4294967295.0::DOUBLE < 0.15 THEN 'val' ELSE 'train' END AS split,
 CAST(CAST('0x' || substr(h, 9, 8) AS BIGINT) % 2 AS INTEGER) AS fold FROM h""")
def hash_split(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"))
    return sampling.hash_split(rows, "key").drop("key")


@query("q_personnel", """WITH t AS (SELECT p_partkey, p_size % 3 AS rb, p_partkey % 4 AS te, p_partkey % 6 AS db FROM part)
SELECT p_partkey, (rb + 1) || '' || te AS off_grouping, 3 || '-' || 4 || '-' || (db + 2) AS def_front, CASE WHEN db + 2 <= 4 THEN 'base'
 WHEN db + 2 = 5 THEN 'nickel' WHEN db + 2 = 6 THEN 'dime' ELSE 'quarter' END AS def_package FROM t""")
def personnel(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey",
        F.concat((F.col("p_size") % 3).cast("string"), F.lit(" RB, 1 FB, "), (F.col("p_partkey") % 4).cast("string"), F.lit(" TE, 3 WR")).alias("o"),
        F.concat(F.lit("2 DE, 1 NT, 4 LB, 2 CB, "), (F.col("p_partkey") % 6).cast("string"), F.lit(" S")).alias("d"))
    s = P.play_summary(F.col("o"), F.col("d"), F.lit(None).cast("string"))
    return rows.withColumn("s", s).select("p_partkey", "s.off_grouping", "s.def_front", "s.def_package")


@query("q_narration", r"""SELECT doc_id, CASE WHEN regexp_matches(text, '\bkicks off\b|\bkickoff\b', 'i') THEN 'kickoff' WHEN regexp_matches(text,
 '\bpunts?\b', 'i') THEN 'punt'
 WHEN regexp_matches(text, '\bfield goal\b', 'i') THEN 'field_goal' WHEN regexp_matches(text, '\bextra point\b', 'i') THEN 'extra_point'
 WHEN regexp_matches(text, '\b(pass|sacked|scrambles|spike[sd]?)\b', 'i') THEN 'pass'
 WHEN regexp_matches(text, '\b(rush(?:es|ed)?|run[s]?|kneel[s]?|up the middle)\b', 'i') THEN 'run' END AS kind FROM documents""")
def narration(spark, sf):
    return read(spark, sf, "documents").select("doc_id", P.narrated_type(F.col("text")).alias("kind"))


@query("q_regex_classify",
    r"""SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '://(?:www\.|m\.|blog\.)?([^/]+)', 1) AS host,
 regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang, TRY_CAST(regexp_extract(url, '/(\d+)', 1) AS BIGINT) AS number FROM pages""")
def regex_classify(spark, sf):
    u = F.col("url")
    number = F.expr(r"try_cast(regexp_extract(url, '/(\\d+)', 1) as bigint)")
    return read(spark, sf, "pages").select("page_id", F.regexp_extract(u, "^(https?)://", 1).alias("scheme"),
        F.regexp_extract(u, r"://(?:www\.|m\.|blog\.)?([^/]+)", 1).alias("host"), F.regexp_extract(u, "/(en|fr|de|es)/", 1).alias("lang"),
        number.alias("number"))


@query("q_game_keys",
    "SELECT c_custkey, (2000 + c_custkey % 20) || '_wk' || lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') || '_' || upper(substr(c_mktsegment, 1, 3)) || '-HOU' AS key, (2000 + c_custkey % 20) || '_wk' || lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') || '_' || upper(substr(c_mktsegment, 1, 3)) || '-HOU_p' || CASE WHEN c_custkey < 100 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0') ELSE CAST(c_custkey AS VARCHAR) END AS uid FROM customer")
def game_keys(spark, sf):
    key = P.game_key(2000 + F.col("c_custkey") % 20, F.col("c_nationkey") + 1, F.substring("c_mktsegment", 1, 3), F.lit("hou"))
    return read(spark, sf, "customer").select("c_custkey", key.alias("key"), P.play_uid(key, F.col("c_custkey")).alias("uid"))


@query("q_geometry",
    """SELECT s_suppkey, CASE WHEN a > 0 THEN 110.0 - y ELSE 10.0 + y END AS los_x, 50 - abs(round_even(x - 10, 0) - 50) AS painted,
 (2 * x + y + 1) / (0.01 * x + 2) AS px, (x - y) / (0.01 * x + 2) AS py, CASE WHEN a > 0 THEN y - 20 ELSE 20 - y END AS lateral
 FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END AS a, (s_suppkey * 13 % 100)::DOUBLE AS y, (s_suppkey * 7 % 120)::DOUBLE AS x
 FROM supplier)""")
def geometry(spark, sf):
    k = F.col("s_suppkey")
    rows = read(spark, sf, "supplier").select("s_suppkey", F.when(k % 2 == 0, 1).otherwise(-1).alias("a"), (k * 13 % 100).cast("double").alias("y"),
        (k * 7 % 120).cast("double").alias("x"))
    h = F.array(*(F.lit(v) for v in (2.0, 1.0, 1.0, 1.0, -1.0, 0.0, 0.01, 0.0, 2.0)))
    p = through(h, F.col("x"), F.col("y"))
    side = snap_frame(F.col("x"), F.col("y"), F.lit(50.0), F.lit(20.0), F.when(F.col("a") > 0, "right").otherwise("left"))
    return rows.select("s_suppkey", line_x_facing(F.col("y"), F.col("a")).alias("los_x"), painted_number(F.col("x")).alias("painted"),
        p["x"].alias("px"), p["y"].alias("py"), side["lateral"].alias("lateral"))


@query("q_anchor", "SELECT s_suppkey, 5 * round_even((t - l) / 5, 0) AS shift, t - (l + 5 * round_even((t - l) / 5, 0)) AS residual, abs(t - (l + 5 * round_even((t - l) / 5, 0))) <= 1.5 AS ok FROM (SELECT s_suppkey, 110.0::DOUBLE - (s_suppkey * 13 % 100) AS t, (s_suppkey * 7 % 60) + 0.25::DOUBLE AS l FROM supplier)")
def anchored(spark, sf):
    k = F.col("s_suppkey")
    a = anchor((k * 7 % 60).cast("double") + 0.25, F.lit(1), (k * 13 % 100).cast("double"))
    return read(spark, sf, "supplier").select("s_suppkey", a["shift"].alias("shift"), a["residual"].alias("residual"), a["ok"].alias("ok"))


# --- samples, windows, formations


@query("q_stratified_sample",
    "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= 3")
def stratified(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "lang", "source")
    return sampling.quota_per_stratum(rows, ["lang", "source"], F.struct(F.md5(F.col("doc_id").cast("string")), "doc_id"), 3)


@query("q_evenly_spaced",
    "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS m FROM documents) SELECT doc_id, lang FROM r WHERE m <= 7 OR i IN (0, 1 * (m - 1) // 6, 2 * (m - 1) // 6, 3 * (m - 1) // 6, 4 * (m - 1) // 6, 5 * (m - 1) // 6, m - 1)")
def evenly_spaced(spark, sf):
    return sampling.evenly_spaced(read(spark, sf, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 7)


@query("q_tumbling",
    "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, sum(value) AS total, avg(value) AS mean FROM events GROUP BY ALL")
def tumbling(spark, sf):
    return film.tumbling(read(spark, sf, "events"), "ts", "6 hours", ["event_type"], "value")


@query("q_session", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR THEN 1
 ELSE 0 END AS c FROM events), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id,
 min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, s""")
def session(spark, sf):
    return film.sessions(read(spark, sf, "events"), "ts", "6 hours", ["user_id"])


@query("q_scrimmage", """WITH p AS (SELECT c_custkey % 25 AS frame, c_acctbal / 100 AS x, c_nationkey % 2 = 0 AS o FROM customer), z AS (SELECT frame,
 a AS attack, a * x AS z, o FROM p, (VALUES (1), (-1)) v(a)),
n AS (SELECT frame, attack, count(*) FILTER (o) AS off, min(z) AS low FROM z GROUP BY frame, attack HAVING count(*) FILTER (o) >= 3
 AND count(*) FILTER (NOT o) >= 3),
g AS (SELECT frame, attack, off AS wrong, low - 1 AS place FROM n UNION ALL SELECT i.frame, i.attack, (SELECT count(*) FROM z q
 WHERE q.frame = i.frame AND q.attack = i.attack AND ((q.o AND q.z > i.z) OR (NOT q.o AND q.z <= i.z))),
 coalesce((i.z + (SELECT min(q.z) FROM z q WHERE q.frame = i.frame AND q.attack = i.attack AND q.z > i.z)) / 2, i.z + 1) FROM z i JOIN n USING (frame,
 attack)),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY frame ORDER BY wrong, attack DESC, place) = 1),
f AS (SELECT b.frame, b.attack, b.wrong, z.o, z.z, row_number() OVER (PARTITION BY b.frame, z.o ORDER BY CASE WHEN z.o THEN -z.z ELSE z.z END) AS k
 FROM b JOIN z ON z.frame = b.frame AND z.attack = b.attack AND CASE WHEN z.o THEN z.z <= b.place ELSE z.z >= b.place END),
m AS (SELECT frame, attack, wrong, avg(z) FILTER (o) AS fo, avg(z) FILTER (NOT o) AS fd FROM f WHERE k <= 3 GROUP BY ALL) SELECT frame,
 attack * (fo + fd) / 2 AS line, attack, wrong AS misplaced, fd - fo AS gap FROM m WHERE fo IS NOT NULL AND fd IS NOT NULL""")
def scrimmage(spark, sf):
    rows = read(spark, sf, "customer").select((F.col("c_custkey") % 25).alias("frame"), (F.col("c_acctbal") / 100).alias("x_yd"),
        (F.col("c_nationkey") % 2 == 0).alias("offense"))
    return scrimmage_lines(rows, ["frame"])


@query("q_dash_window", """WITH o AS (SELECT DISTINCT c_nationkey, CAST(floor(c_custkey * 7 % 397 / 2) AS INTEGER) AS a FROM customer),
 p AS (SELECT x.c_nationkey, x.a, y.a AS b, (SELECT count(*) FROM o c WHERE c.c_nationkey = x.c_nationkey AND c.a BETWEEN x.a AND y.a) AS dashes
 FROM o x JOIN o y ON x.c_nationkey = y.c_nationkey AND y.a >= x.a)
SELECT c_nationkey, a AS low, b AS high, dashes FROM p WHERE dashes >= 0.5 * (b - a + 1) QUALIFY row_number() OVER (PARTITION BY c_nationkey
 ORDER BY b - a DESC, a) = 1""")
def dashes(spark, sf):
    return dash_window(read(spark, sf, "customer").select("c_nationkey", (F.col("c_custkey") * 7 % 397 / 2).alias("yard")), ["c_nationkey"], "yard")


@query("q_mix_of_tables",
    "SELECT n_name AS name, 'nation' AS kind, n_regionkey AS region FROM nation UNION ALL SELECT r_name AS name, 'region' AS kind, NULL AS region FROM region")
def union_by_name(spark, sf):
    return tables.union_tables(
        read(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"), F.col("n_regionkey").alias("region")),
        read(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind")))
