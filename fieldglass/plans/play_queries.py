"""Queries of the play operators: kinds, spots, keys, personnel, the query tools, labels and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import plays as P
from fieldglass.operators import film_room, formations, joins, play_query, sampling
from fieldglass.plans.queries import PLAYS_SQL, as_plays
from fieldglass.plans.registry import query, read
from fieldglass.sources import tables

KINDS = ("pass", "run", "punt", "no_play", "qb_kneel", "timeout", None, "field_goal", "extra_point", "kickoff", "qb_spike")
WORDS = (
    "(Shotgun) J.Smith pass short left to A.Lee for 9 yards", "PENALTY on NYJ, False Start, 5 yards, enforced",
    "(9:12) (No Huddle) D.Jones up the middle for 3 yards", "Timeout #2 by BUF at 01:10",
    "Two-Minute Warning", "END QUARTER 3", "M.Bates 44 yard field goal is GOOD", "T.Bass kicks off 65 yards to the end zone",
    "S.Martin punts 51 yards", "B.Cook left tackle for 2 yards (PENALTY declined)", "",
    "J.Allen kneels", "J.Allen spiked the ball", "TWO-POINT CONVERSION ATTEMPT. pass to S.Diggs",
    "J.Allen scrambles right end for 12 yards, TOUCHDOWN", "extra point is GOOD", "(15:00) PENALTY on BUF, Offside - No Play.", None,
)
CODES = ("PASS", "RUSH", "PENALTY", "TIMEOUT", "KICK_OFF", "PUNT", "FG", "XP_KICK", "SACK", "COMMENT", "", None, "END_GAME")


def pick(values: tuple, number: Column) -> Column:
    """The value at number modulo how many there are."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(number, F.lit(len(values))).cast("int"))


def pick_sql(values: tuple, number: str) -> str:
    told = ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values)
    return f"([{told}])[({number}) % {len(values)} + 1]"


# --- kinds of plays

SAID_SQL = f"(SELECT o_orderkey, {pick_sql(KINDS, 'o_orderkey')} AS kind, {pick_sql(WORDS, 'o_orderkey // 3')} AS text, {pick_sql(CODES, 'o_orderkey // 5')} AS code FROM orders)"


def said(spark, sf) -> DataFrame:
    """Orders with a play type, a description and a feed's code each."""
    k = F.col("o_orderkey")
    third, fifth = F.floor(k / 3), F.floor(k / 5)
    return read(spark, sf, "orders").select("o_orderkey", pick(KINDS, k).alias("kind"), pick(WORDS, third).alias("text"),
        pick(CODES, fifth).alias("code"))


SNAPPED_SQL = r"""(trim(regexp_replace(coalesce(text, ''), '^(\s*\([^)]*\))+\s*', '')) <> ''
 AND NOT starts_with(upper(ltrim(regexp_replace(coalesce(text, ''), '^(\s*\([^)]*\))+\s*', ''))), 'PENALTY'))"""
FILMED_SQL = "coalesce(kind IN ('pass', 'run', 'punt', 'field_goal', 'extra_point', 'kickoff', 'qb_kneel', 'qb_spike'), false)"
ADMIN_SQL = r"""(regexp_matches(coalesce(text, '') || ' ' || coalesce({code}, ''),
 '\btime\s?out\b|two[-\s]?minute warning|end of (quarter|half|game|regulation|period)|end quarter', 'i')
 AND NOT regexp_matches(coalesce(text, '') || ' ' || coalesce({code}, ''),
 '\b(pass|rush|scramble|sack|punt|kick|field goal|kneel|spike|handoff|intercept|fumble|lateral)\b', 'i'))"""


@query("q_film_kinds", f"""SELECT o_orderkey, {FILMED_SQL} AS filmable, {SNAPPED_SQL} AS snapped, {FILMED_SQL} OR (kind IS NOT DISTINCT FROM 'no_play'
 AND {SNAPPED_SQL}) AS on_film,
 kind IS NOT DISTINCT FROM 'qb_kneel' OR (kind IS NOT DISTINCT FROM 'no_play' AND NOT {SNAPPED_SQL} AND contains(upper(coalesce(text, '')),
 'PENALTY')) AS optional, {ADMIN_SQL.format(code='code')} AS admin,
 CASE kind WHEN 'kickoff' THEN 1 WHEN 'punt' THEN 2 WHEN 'field_goal' THEN 3 WHEN 'extra_point' THEN 4 ELSE 0 END AS class FROM {SAID_SQL}""")
def film_kinds(spark, sf):
    kind, text = F.col("kind"), F.col("text")
    return said(spark, sf).select(
        "o_orderkey", P.is_one_of(kind, P.FILMABLE_TYPES).alias("filmable"), P.snapped(text).alias("snapped"),
        P.on_film(kind, text).alias("on_film"), P.maybe_on_film(kind, text).alias("optional"),
        P.is_admin(text, F.col("code")).alias("admin"), P.type_class(kind).alias("class"))


@query("q_film_rows", f"""SELECT o_orderkey, kind, kind IS NOT DISTINCT FROM 'qb_kneel' OR (kind IS NOT DISTINCT FROM 'no_play'
 AND NOT {SNAPPED_SQL} AND contains(upper(coalesce(text, '')), 'PENALTY')) AS film_optional
 FROM {SAID_SQL} WHERE {FILMED_SQL} OR (kind IS NOT DISTINCT FROM 'no_play' AND ({SNAPPED_SQL} OR contains(upper(coalesce(text, '')), 'PENALTY')))""")
def film_rows(spark, sf):
    return film_room.film_rows(said(spark, sf), "kind", "text").select("o_orderkey", "kind", "film_optional")


@query("q_league_types", f"""WITH s AS (SELECT *, lower(coalesce(text, '')) AS d, upper(coalesce(code, '')) AS t FROM {SAID_SQL})
SELECT o_orderkey, CASE WHEN t IN ('GAME_START', 'END_QUARTER', 'END_HALF', 'END_GAME', 'TIMEOUT', 'TWO_MINUTE_WARNING',
 'COMMENT') OR {ADMIN_SQL.format(code='code')} THEN NULL
 WHEN contains(d, 'no play') AND contains(d, 'penalty') THEN 'no_play' WHEN contains(d, 'kicks off') OR contains(d, 'kickoff') OR contains(t,
 'KICK_OFF') OR t = 'KICKOFF' THEN 'kickoff' WHEN contains(d, 'punts') OR t = 'PUNT' THEN 'punt'
 WHEN contains(d, 'field goal') OR t IN ('FIELD_GOAL', 'FG') THEN 'field_goal' WHEN contains(d, 'extra point') OR t IN ('XP_KICK', 'EXTRA_POINT',
 'PAT') THEN 'extra_point' WHEN contains(d, 'kneels') THEN 'qb_kneel' WHEN contains(d, 'spiked') THEN 'qb_spike'
 WHEN contains(d, 'two-point') OR contains(d, 'two point') THEN CASE WHEN contains(d, 'pass') THEN 'pass' ELSE 'run' END WHEN contains(d,
 'scrambles') THEN 'run' WHEN contains(d, 'pass') OR contains(d, 'sacked') OR t IN ('PASS', 'SACK') THEN 'pass'
 WHEN t IN ('RUSH', 'RUN') OR regexp_matches(d, '\\b(left|right) (end|tackle|guard)\\b|up the middle') THEN 'run' WHEN t = 'PENALTY' OR contains(d,
 'penalty') THEN 'no_play' END AS kind FROM s""")
def league_types(spark, sf):
    return said(spark, sf).select("o_orderkey", P.league_type(F.col("code"), F.col("text")).alias("kind"))


NARRATED_SQL = r"""CASE WHEN regexp_matches(text, '\bkicks off\b|\bkickoff\b', 'i') THEN 'kickoff' WHEN regexp_matches(text, '\bpunts?\b',
 'i') THEN 'punt' WHEN regexp_matches(text, '\bfield goal\b', 'i') THEN 'field_goal'
 WHEN regexp_matches(text, '\bextra point\b', 'i') THEN 'extra_point' WHEN regexp_matches(text, '\b(pass|sacked|scrambles|spike[sd]?)\b',
 'i') THEN 'pass' WHEN regexp_matches(text, '\b(rush(?:es|ed)?|run[s]?|kneel[s]?|up the middle)\b', 'i') THEN 'run' END"""


@query("q_feed_types", f"""WITH s AS (SELECT *, o_orderkey % 60 AS id, {NARRATED_SQL} AS told FROM {SAID_SQL}), k AS (SELECT *, CASE WHEN id IN (1, 2,
 3, 9) THEN 'pass' WHEN id = 4 THEN 'run' WHEN id = 5 THEN 'kickoff' WHEN id = 7 THEN 'punt'
 WHEN id IN (10, 11) THEN 'penalty' WHEN id = 13 THEN 'two_minute_warning' WHEN id = 14 THEN 'fumble' WHEN id = 22 THEN 'extra_point'
 WHEN id = 42 THEN 'field_goal' WHEN id IN (57, 58) THEN 'timeout' END AS known FROM s),
p AS (SELECT *, known = 'penalty' AND regexp_matches(coalesce(text, ''), '^\\s*penalty\\s*:', 'i') AS dead FROM k), t AS (SELECT *, CASE
 WHEN dead THEN 'penalty' WHEN known IN ('fumble', 'penalty') THEN coalesce(told, known) ELSE known END AS play_type FROM p)
SELECT o_orderkey, play_type, coalesce(play_type IN ('pass', 'run'), false) AND NOT coalesce(dead, false) AS is_scrimmage
 FROM t""".replace("\\\\", "\\"))
def feed_types(spark, sf):
    kind = P.feed_type(F.col("o_orderkey") % 60, F.col("text"))
    return said(spark, sf).select("o_orderkey", kind["play_type"].alias("play_type"), kind["is_scrimmage"].alias("is_scrimmage"))


# --- spots, teams, uniforms, time

SPOTS = ("Chi37", "CHI 5", "LAR22", "LA 49", "50", "Chi50", "Jac 7", "nowhere", None, "GB 63", " Chi 12 ")
SIDES = ("CHI", "LA", "LAR", "", None, "JAX", "jac")


@query("q_spots", f"""WITH s AS (SELECT p_partkey, {pick_sql(SPOTS, 'p_partkey')} AS spot, {pick_sql(SIDES, 'p_partkey // 2')} AS team FROM part),
 x AS (SELECT *, trim(spot) AS t, nullif(regexp_extract(trim(spot), '^([A-Za-z]+)\\s*(\\d{{1,2}})$', 1), '') AS side,
 TRY_CAST(nullif(regexp_extract(trim(spot), '^([A-Za-z]+)\\s*(\\d{{1,2}})$', 2), '') AS INTEGER) AS yard FROM s), a AS (SELECT *, upper(side) AS up,
 CASE upper(side) WHEN 'LAR' THEN 'LA' ELSE upper(side) END AS feed_side,
 CASE upper(side) WHEN 'LAR' THEN 'LA' WHEN 'WSH' THEN 'WAS' WHEN 'JAC' THEN 'JAX' WHEN 'ARZ' THEN 'ARI' WHEN 'BLT' THEN 'BAL' WHEN 'CLV' THEN 'CLE'
 WHEN 'HST' THEN 'HOU' ELSE upper(side) END AS league_side,
 CASE upper(nullif(team, '')) WHEN 'LAR' THEN 'LA' WHEN 'JAC' THEN 'JAX' ELSE upper(nullif(team, '')) END AS code FROM x)
SELECT p_partkey, CASE WHEN side IS NOT NULL AND yard BETWEEN 0 AND 50 AND team <> '' THEN CASE WHEN feed_side = upper(team) THEN 100 - yard
 ELSE yard END END AS feed_yards,
 CASE WHEN t = '50' THEN 50 WHEN side IS NOT NULL THEN CASE WHEN coalesce(league_side = code, false) THEN 100 - yard
 ELSE yard END END AS league_yards, code FROM a""".replace("\\\\", "\\"))
def spots(spark, sf):
    k = F.col("p_partkey")
    rows = read(spark, sf, "part").select("p_partkey", pick(SPOTS, k).alias("spot"), pick(SIDES, F.floor(k / 2)).alias("team"))
    return rows.select("p_partkey", P.feed_yardline(F.col("spot"), F.col("team")).alias("feed_yards"),
        P.league_yardline(F.col("spot"), F.col("team")).alias("league_yards"), P.team_code(F.col("team")).alias("code"))


JERSEYS = ("04", "0", "00", "17", " 9", None, "007")
LOGOS = ("https://x/league/logos/CHI", "https://x/logos/LA?w=4", "https://x/logos/", None, "https://x/clubs/logos/NYJ/small")
CLOCKS = ("(9:12) J.Smith pass", "J.Smith pass (9:12)", "(15:00)  END QUARTER", None, "(123) pass")
DATES = ("2024-01-14T18:00:00", "2024-09-08", "2025-02-09T00:00:00", "soon", None)


@query("q_marks", f"""WITH s AS (SELECT p_partkey AS k, {pick_sql(JERSEYS, 'p_partkey')} AS jersey, {pick_sql(LOGOS, 'p_partkey')} AS logo,
 {pick_sql(CLOCKS, 'p_partkey')} AS said, {pick_sql(DATES, 'p_partkey')} AS day, p_partkey % 23 + 1 AS week, p_partkey % 5 + 1 AS qtr FROM part)
SELECT k, CASE WHEN regexp_replace(trim(jersey), '^0+', '') = '' THEN '0' ELSE regexp_replace(trim(jersey), '^0+', '') END AS jersey,
 nullif(regexp_extract(logo, '/logos/([A-Z]+)(?:[/?#]|$)', 1), '') AS team,
 nullif(regexp_extract(said, '^\\((\\d{{1,2}}:\\d{{2}})\\)\\s*', 1), '') AS clock, regexp_replace(said, '^\\((\\d{{1,2}}:\\d{{2}})\\)\\s*',
 '') AS said, CASE WHEN week <= 18 THEN 'REG' ELSE 'POST' END AS part, CAST(CASE WHEN week <= 18 THEN week ELSE week - 18 END AS BIGINT) AS week,
 CASE WHEN qtr <= 2 THEN 'first' ELSE 'second' END AS half, CASE WHEN TRY_CAST(day AS TIMESTAMP) IS NOT NULL THEN year(TRY_CAST(day AS TIMESTAMP)) -
 CASE WHEN month(TRY_CAST(day AS TIMESTAMP)) <= 2 THEN 1 ELSE 0 END END AS season,
 printf('%d_%02d_CHI_LA', 2000 + k % 30, week) AS game_id, sha256('key' || k || 'secret') AS signature FROM s""".replace("\\\\", "\\"))
def marks(spark, sf):
    k = F.col("p_partkey")
    rows = read(spark, sf, "part").select(k.alias("k"), pick(JERSEYS, k).alias("jersey"), pick(LOGOS, k).alias("logo"),
        pick(CLOCKS, k).alias("said"), pick(DATES, k).alias("day"), (k % 23 + 1).alias("week"), (k % 5 + 1).alias("qtr"))
    part = P.season_part(F.col("week"))
    return rows.select(
        "k", P.plain_uniform(F.col("jersey")).alias("jersey"), P.team_of_logo(F.col("logo")).alias("team"), P.clock_of(F.col("said")).alias("clock"),
        P.without_clock(F.col("said")).alias("said"),
        part["season_type"].alias("part"), part["week"].alias("week"), P.half_of(F.col("qtr")).alias("half"),
        P.season_of_date(F.col("day")).cast("long").alias("season"),
        P.season_game_id(2000 + F.col("k") % 30, F.col("week"), F.lit("chi"), F.lit("la")).alias("game_id"),
        P.request_signature(F.lit("key"), F.col("k").cast("string"), F.lit("secret")).alias("signature"))


@query("q_parsed_keys",
    "SELECT c_custkey, 2000 + c_custkey % 20 AS season, CAST(c_nationkey + 1 AS BIGINT) AS week, upper(substr(c_mktsegment, 1, 3)) AS away, 'HOU' AS home FROM customer")
def parsed_keys(spark, sf):
    key = P.game_key(2000 + F.col("c_custkey") % 20, F.col("c_nationkey") + 1, F.substring("c_mktsegment", 1, 3), F.lit("hou"))
    parsed = P.parse_game_key(key)
    return read(spark, sf, "customer").select("c_custkey",
        *(parsed[x].cast("long" if x in ("season", "week") else "string").alias(x) for x in ("season", "week", "away", "home")))


# --- personnel

TEAMS_OF = ("1 RB, 1 TE, 3 WR", "2 RB, 2 TE, 1 WR", "1 RB, 1 FB, 3 TE", "4 WR", None, "6 OL, 2 RB", "0 RB, 0 TE, 5 WR")
FRONTS_OF = ("4 DL, 3 LB, 4 DB", "2 DE, 1 NT, 4 OLB, 2 CB, 2 S", "1 EDGE, 2 ILB, 3 CB, 3 FS", None, "3 DL, 2 LB, 6 DB", "no one")


@query("q_personnel_counts", f"""WITH s AS (SELECT p_partkey, {pick_sql(TEAMS_OF, 'p_partkey')} AS o, {pick_sql(FRONTS_OF, 'p_partkey // 2')} AS d
 FROM part), x AS (SELECT p_partkey, CASE WHEN len(regexp_extract_all(o, '(\\d+)\\s+([A-Za-z]+)')) > 0 THEN true END AS known,
 CASE WHEN len(regexp_extract_all(d, '(\\d+)\\s+([A-Za-z]+)')) > 0 THEN true END AS known_d, list_transform(regexp_extract_all(o,
 '(\\d+)\\s+([A-Za-z]+)'), lambda t: [split_part(t, ' ', 1), split_part(t, ' ', 2)]) AS ot,
 list_transform(regexp_extract_all(d, '(\\d+)\\s+([A-Za-z]+)'), lambda t: [split_part(t, ' ', 1), split_part(t, ' ', 2)]) AS dt FROM s),
n AS (SELECT p_partkey, known, known_d, {', '.join(f"coalesce(list_sum(list_transform(list_filter({t}, lambda p: p[2] IN {p}), lambda p: CAST(p[1] AS INTEGER))), 0) AS {k}" for k, t, p in (('rb', 'ot', "('RB', 'FB', 'HB')"), ('te', 'ot', "('TE', '')"), ('wr', 'ot', "('WR', '')"), ('dl', 'dt', "('DE', 'DT', 'NT', 'DL', 'EDGE')"), ('lb', 'dt', "('ILB', 'OLB', 'MLB', 'LB', 'WLB', 'SLB')"), ('db', 'dt', "('CB', 'FS', 'SS', 'S', 'DB', 'NB')")))} FROM x)
SELECT p_partkey, CASE WHEN known THEN rb || '' || te END AS off_grouping, CAST(CASE WHEN known THEN wr END AS BIGINT) AS wr, CASE
 WHEN known_d THEN dl || '-' || lb || '-' || db END AS def_front, CASE WHEN known_d THEN CASE WHEN db <= 4 THEN 'base' WHEN db = 5 THEN 'nickel'
 WHEN db = 6 THEN 'dime' ELSE 'quarter' END END AS def_package FROM n""".replace("\\\\", "\\"))
def personnel_counts(spark, sf):
    k = F.col("p_partkey")
    rows = read(spark, sf, "part").select("p_partkey",
        P.play_summary(pick(TEAMS_OF, k), pick(FRONTS_OF, F.floor(k / 2)), F.lit("shotgun")).alias("s"))
    return rows.select("p_partkey", "s.off_grouping", F.col("s.wr").cast("long").alias("wr"), "s.def_front", "s.def_package")


# --- the query tools

METRICS_SQL = """count(*) AS n, round(avg(epa), 3) AS epa_per_play, round(avg(CASE WHEN epa > 0 THEN 1.0::DOUBLE ELSE 0 END), 3) AS success_rate,
 round(avg(yards_gained), 2) AS yards_per_play, round(avg(CASE WHEN yards_gained >= 15 THEN 1.0::DOUBLE ELSE 0 END), 3) AS explosive_rate"""


@query("q_ranked_groups",
    f"SELECT play_type, qtr, {METRICS_SQL} FROM {PLAYS_SQL} WHERE shotgun = 0 GROUP BY ALL HAVING count(*) >= 10 ORDER BY epa_per_play DESC, play_type, qtr LIMIT 50")
def ranked_groups(spark, sf):
    return play_query.ranked_groups(as_plays(spark, sf), ["play_type", "quarter", "nonsense"], min_plays=10, limit=99, shotgun=False)


@query("q_aggregate_plays",
    f"SELECT down, CAST(shotgun AS DOUBLE) AS shotgun, {METRICS_SQL} FROM {PLAYS_SQL} WHERE play_type = 'N' AND ydstogo <= 30 GROUP BY ALL ORDER BY explosive_rate DESC, down, shotgun LIMIT 5")
def aggregate_plays(spark, sf):
    plays = as_plays(spark, sf)
    told = play_query.aggregate_plays(plays,
        **play_query.allowed(
        {"group_by": ["down", "shotgun"], "sort_by": "explosive_rate", "limit": 5, "play_type": "N", "distance_max": 30, "drop_table": 1},
        play_query.AGGREGATE_ARGUMENTS))
    kinds = dict(plays.dtypes)
    return spark.createDataFrame(told["groups"],
        f"down {kinds['down']}, shotgun double, n long, epa_per_play double, success_rate double, yards_per_play double, explosive_rate double")


@query("q_query_plays",
    f"SELECT count(*) OVER () AS count, play_uid, qtr, down, epa FROM {PLAYS_SQL} WHERE down = 1 AND ydstogo >= 10 AND off_formation = 'O' AND yardline_100 <= 20 ORDER BY play_index, play_uid LIMIT 25")
def query_plays(spark, sf):
    plays = as_plays(spark, sf)
    told = play_query.query_plays(plays,
        **play_query.allowed({"down": 1, "distance_min": 10, "off_formation": "o", "red_zone": True, "sort_by": "epa"}, play_query.QUERY_ARGUMENTS))
    kinds = dict(plays.dtypes)
    rows = [(told["count"], *(p[c] for c in ("play_uid", "qtr", "down", "epa"))) for p in told["plays"]]
    return spark.createDataFrame(rows, f"count long, play_uid string, qtr {kinds['qtr']}, down {kinds['down']}, epa double")


# --- the film room

ROOM_SQL = f"""(SELECT o_orderkey, o_orderkey % 5 + 1 AS qtr, (o_orderkey // 2) % 4 + 1 AS down, (o_orderkey // 3) % 12 AS ydstogo,
 (o_orderkey * 7) % 100 AS yardline_100, printf('%d:%02d', o_orderkey % 15, o_orderkey % 60) AS clock, {pick_sql(WORDS, 'o_orderkey // 3')} AS text,
 {pick_sql(('Chi37', 'LA 5', None), 'o_orderkey')} AS yrdln, {pick_sql(('CHI', 'LA', None), 'o_orderkey // 4')} AS posteam,
 {pick_sql(('SHOTGUN', 'PISTOL', None), 'o_orderkey // 2')} AS formation, {pick_sql(KINDS, 'o_orderkey')} AS play_type,
 o_orderkey % 23 AS yards, o_orderkey % 17 = 0 AS touchdown, o_orderkey % 6 AS n_motions, o_orderkey % 9 = 0 AS play_action,
 printf('2024_wk05_BUF-NYJ_p%03d', o_orderkey % 1000) AS uid FROM orders)"""


def room(spark, sf) -> DataFrame:
    """Orders as the film room's rows."""
    k = F.col("o_orderkey")
    div = lambda n: F.floor(k / n)
    return read(spark, sf, "orders").select(
        "o_orderkey", (k % 5 + 1).alias("qtr"), (div(2) % 4 + 1).alias("down"), (div(3) % 12).alias("ydstogo"), (k * 7 % 100).alias("yardline_100"),
        F.format_string("%d:%02d", k % 15, k % 60).alias("clock"), pick(WORDS, div(3)).alias("text"),
        pick(("Chi37", "LA 5", None), k).alias("yrdln"), pick(("CHI", "LA", None), div(4)).alias("posteam"),
        pick(("SHOTGUN", "PISTOL", None), div(2)).alias("formation"), pick(KINDS, k).alias("play_type"),
        (k % 23).alias("yards"), (k % 17 == 0).alias("touchdown"), (k % 6).alias("n_motions"), (k % 9 == 0).alias("play_action"),
        F.format_string("2024_wk05_BUF-NYJ_p%03d", k % 1000).alias("uid"))


HAY_SQL = """lower(coalesce(text, '') || ' ' || coalesce(yrdln, '') || ' ' || coalesce(posteam, '') || ' ' || coalesce(formation,
 '') || ' ' || coalesce((['q1', 'q2', 'q3', 'q4', 'ot'])[qtr], ''))"""
#: Searches and the SQL of each.
SEARCHES = (
    ("3rd & long", "down = 3 AND ydstogo >= 7"), ("show me 4 and 2 plays", "down = 4 AND ydstogo = 2"),
    ("2nd and short", "down = 2 AND ydstogo <= 3"), ("1st & goal", "down = 1 AND yardline_100 <= ydstogo"), ("red zone plays", "yardline_100 <= 20"),
    ("the two-minute drill", "qtr IN (2, 4) AND CAST(split_part(clock, ':', 1) AS INTEGER) < 2"),
    ("q3 Smith chi", f"contains({HAY_SQL}, 'q3') AND contains({HAY_SQL}, 'smith') AND contains({HAY_SQL}, 'chi')"), ("", "true"),
)


@query("q_film_search", " UNION ALL ".join(f"SELECT '{text}' AS search, o_orderkey FROM {ROOM_SQL} WHERE {sql}" for text, sql in SEARCHES))
def film_search(spark, sf):
    rows, out = room(spark, sf), None
    for text, _ in SEARCHES:
        found = rows.filter(film_room.search(text)).select(F.lit(text).alias("search"), "o_orderkey")
        out = found if out is None else out.union(found)
    return out


@query("q_film_tags", f"""SELECT o_orderkey, o_orderkey % 1000 < 400 AS featured, touchdown AS td, yards >= 15 AS explosive,
 coalesce(formation = 'SHOTGUN', false) OR regexp_matches(coalesce(text, ''), '\\(shotgun', 'i') AS shotgun,
 n_motions > 4 AS motion, play_action AS pa FROM {ROOM_SQL}""".replace("\\\\", "\\"))
def film_tags(spark, sf):
    done = spark.range(400).select(F.format_string("2024_wk05_BUF-NYJ_p%03d", "id").alias("uid"))
    rows = film_room.with_featured(room(spark, sf), done, "uid").withColumn("motion", F.col("n_motions") > 4)
    return rows.select("o_orderkey", *(film_room.tag(t).alias(t) for t in film_room.TAGS))


@query("q_visible_plays",
    f"SELECT o_orderkey FROM {ROOM_SQL} WHERE qtr = 2 AND play_type = 'pass' AND yards >= 15 AND (coalesce(formation = 'SHOTGUN', false) OR regexp_matches(coalesce(text, ''), '\\(shotgun', 'i')) AND ydstogo >= 7 AND down = 3".replace(
    "\\\\", "\\"))
def visible_plays(spark, sf):
    return film_room.visible(room(spark, sf), quarter=2, kind="pass", tags=["explosive", "shotgun"], search_text="3rd & long").select("o_orderkey")


# --- labels, tables, records


@query("q_participation",
    "SELECT l_orderkey AS play_id, l_linenumber, p_size AS offense_formation FROM lineitem LEFT JOIN part ON p_partkey = l_orderkey")
def participation(spark, sf):
    game = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("play_id"), "l_linenumber", F.lit("old").alias("offense_formation"))
    labels = read(spark, sf, "part").select(F.col("p_partkey").alias("play_id"), F.col("p_size").alias("offense_formation"))
    twice = labels.union(labels.withColumn("offense_formation", F.col("offense_formation") + 1))
    return tables.with_participation(game, twice, ["offense_formation"])


@query("q_read_tables",
    "SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM (SELECT * FROM nation UNION ALL BY NAME SELECT * FROM region)")
def read_tables(spark, sf):
    """Files of two schemas as one table, by column name."""
    return tables.read_plays(spark, f"{sf}/nation.parquet", f"{sf}/region.parquet").select("n_nationkey", "n_name", "n_regionkey", "r_regionkey",
        "r_name")


@query("q_one_game",
    "SELECT qtr, down, play_type FROM (SELECT 2 AS qtr, l_linenumber AS down, l_returnflag AS play_type, l_orderkey % 50 AS g FROM lineitem) WHERE g = 7")
def one_game(spark, sf):
    season = read(spark, sf, "lineitem").select(F.lit(2).alias("qtr"), F.col("l_linenumber").alias("down"), F.col("l_returnflag").alias("play_type"),
        (F.col("l_orderkey") % 50).cast("string").alias("game_id"), "l_tax")
    return tables.one_game(season, "7", ("qtr", "down", "play_type", "not_there"))


@query("q_enriched",
    f"""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '11' WHEN 1 THEN '22' WHEN 2 THEN '23' WHEN 3 THEN '00' WHEN 5 THEN '20'
 WHEN 6 THEN '00' END AS off_grouping, upper(substr(p_brand, 1, 5)) AS off_formation FROM part WHERE p_size > 10""")
def enriched(spark, sf):
    k = F.col("p_partkey")
    rows = read(spark, sf, "part").select("p_partkey", pick(TEAMS_OF, k).alias("offense_personnel"),
        F.lower(F.substring("p_brand", 1, 5)).alias("offense_formation"), (F.col("p_size") > 10).alias("is_scrimmage"))
    return tables.enriched(rows).select("p_partkey", "off_grouping", "off_formation")


@query("q_without_nan", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS v FROM supplier")
def without_nan(spark, sf):
    return tables.without_nan(
        read(spark, sf, "supplier").select("s_suppkey",
        F.when(F.col("s_suppkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal")).alias("v")))


@query("q_strided", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000 AND (o_orderkey - 100) % 25 = 0")
def strided(spark, sf):
    return tables.strided(read(spark, sf, "orders").select("o_orderkey"), 100, 5000, 25, "o_orderkey")


@query("q_registry",
    "SELECT n_nationkey AS team_id, n_name AS abbreviation FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, lower(n_name) FROM nation WHERE n_nationkey >= 10")
def registry_(spark, sf):
    nations = read(spark, sf, "nation")
    live = nations.filter("n_nationkey < 10").select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("abbreviation"))
    return tables.registry(live, nations.select(F.col("n_nationkey").alias("team_id"), F.lower("n_name").alias("abbreviation")))


@query("q_overlay", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'x' ELSE lang END AS lang, source FROM documents LEFT JOIN labels USING (doc_id)")
def overlay(spark, sf):
    sidecar = read(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "x").alias("lang"))
    return joins.overlay(read(spark, sf, "documents").select("doc_id", "lang", "source"), sidecar, ["doc_id"], ["lang"])


@query("q_exported_lines",
    "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS value FROM nation ORDER BY n_nationkey")
def exported_lines(spark, sf):
    return tables.exported_lines(read(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query("q_training_lines", """WITH b AS (SELECT s_nationkey AS frame, s_suppkey, (s_suppkey * 7 % 40)::DOUBLE AS x,
 (s_suppkey * 11 % 40)::DOUBLE AS y, s_suppkey % 3 AS k FROM supplier)
SELECT CASE WHEN frame % 2 = 0 THEN 'train' ELSE 'val' END AS split, frame, string_agg(line, chr(10) ORDER BY line) AS labels, 'teacher' AS source
 FROM (
 SELECT frame, printf('%d %.6f %.6f %.6f %.6f', k, (x + least(x + 30, 60)) / 2 / 60, (y + least(y + 30, 50)) / 2 / 50, (least(x + 30, 60) - x) / 60,
 (least(y + 30, 50) - y) / 50) AS line FROM b WHERE k < 2) GROUP BY frame""")
def training_lines(spark, sf):
    from fieldglass.functions.geometry import box_line

    k = F.col("s_suppkey")
    x, y = (k * 7 % 40).cast("double"), (k * 11 % 40).cast("double")
    rows = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("frame"),
        box_line(F.when(k % 3 < 2, k % 3), [x, y, x + 30, y + 30], 60, 50).alias("l"))
    return tables.training_lines(rows, F.col("l"), F.when(F.col("frame") % 2 == 0, "train").otherwise("val"), "teacher")


# --- formations

_SLOTS = sorted({s for _, _, slots in formations.catalogue() for s in slots})
_CATALOGUE_SQL = ", ".join("({}, [{}])".format(i, ", ".join(f"'{s}'" for s in sorted(slots))) for i, _, slots in formations.catalogue())
_DRAWN_SQL = "list_distinct([" + ", ".join(f"s.names[(p_partkey * {k + 3} + {k * 7}) % {len(_SLOTS)} + 1]" for k in range(6)) + "])"


@query("q_formations", f"""WITH s AS (SELECT [{', '.join(f"'{x}'" for x in _SLOTS)}] AS names), c(id, slots) AS (VALUES {_CATALOGUE_SQL}),
 d AS (SELECT p_partkey, {_DRAWN_SQL} AS own FROM part, s),
m AS (SELECT p_partkey, id, len(slots) - len(list_intersect(own, slots)) AS n_missing, len(own) - len(list_intersect(own, slots)) AS n_extra FROM d,
 c)
SELECT p_partkey, id AS formation_id, n_missing + n_extra = 0 AS exact, n_missing, n_extra FROM m QUALIFY row_number() OVER (PARTITION BY p_partkey
 ORDER BY n_missing + n_extra, id) = 1""")
def formation_matches(spark, sf):
    """Formations by slots drawn from each part's number."""
    draw = lambda k: F.get(F.array(*map(F.lit, _SLOTS)), ((F.col("p_partkey") * (k + 3) + k * 7) % len(_SLOTS)).cast("int"))
    rows = read(spark, sf, "part").select("p_partkey", F.array_distinct(F.array(*(draw(k) for k in range(6)))).alias("slots"))
    size = lambda c: F.size(c).cast("long")
    return formations.matched_formations(rows, "slots").select("p_partkey", "formation_id", "exact", size("missing").alias("n_missing"),
        size("extra").alias("n_extra"))


_SIDE_SQL = "len(list_filter(slots, lambda s: ends_with(s, '{}') AND s[1] IN ('T', 'W')))"


@query("q_formation_attributes", f"""WITH c(id, slots) AS (VALUES {_CATALOGUE_SQL}),
n AS (SELECT *, len(list_filter(slots, lambda s: s IN ('RB', 'RBL', 'RBR'))) AS backs, {_SIDE_SQL.format('L')} AS lefts, {_SIDE_SQL.format('R')} AS rights,
 len(list_filter(slots, lambda s: s IN ('RB', 'RBL', 'RBR', 'FB', 'FBL', 'FBR'))) || '' || len(list_filter(slots, lambda s: starts_with(s, 'TE'))) AS grouping FROM c),
b AS (SELECT *, CASE WHEN list_has_any(slots, ['K', 'P']) THEN 'special_teams' WHEN list_contains(slots, 'FB') THEN 'i_form'
 WHEN list_contains(slots, 'FBL') THEN 'offset_i_left' WHEN list_contains(slots, 'FBR') THEN 'offset_i_right' WHEN backs >= 2 THEN 'split_backs'
 WHEN backs = 1 AND list_contains(slots, 'QBS') THEN 'shotgun_single' WHEN backs = 1 THEN 'single_back' ELSE 'empty' END AS backfield FROM n)
SELECT id AS formation_id, CASE WHEN list_contains(slots, 'QBS') THEN 'shotgun' WHEN list_contains(slots, 'QB') THEN 'under_center' END AS qb_depth, backfield,
 CASE WHEN backfield <> 'special_teams' THEN grouping END AS personnel,
 CASE WHEN lefts > rights THEN 'left' WHEN rights > lefts THEN 'right' ELSE 'balanced' END AS strength FROM b""")
def formation_attributes(spark, sf):
    return formations.formations(spark).select("formation_id", "qb_depth", "backfield", "personnel", "strength")


# --- samples of a film

INDEX_SQL = """(SELECT 'p' || o_orderkey AS play_uid, o_orderkey AS film_play_index, o_orderkey * 40.0::DOUBLE AS ss, o_orderkey * 40 + 12.0::DOUBLE AS se,
 o_orderkey * 40 + 14.0::DOUBLE AS es, o_orderkey * 40 + 27.0::DOUBLE AS ee, CASE WHEN o_orderkey % 4 + 1 <= 2 THEN 'first' ELSE 'second' END AS half
 FROM orders)"""


@query("q_sampled_frames", f"""WITH h(i, half) AS (VALUES (0, 'first'), (1, 'second')), a(j, angle) AS (VALUES (0, 'sideline'), (1, 'endzone')),
p(k, phase, low, high) AS (VALUES (0, 'pre_snap', 0.04::DOUBLE, 0.20::DOUBLE), (1, 'live', 0.35::DOUBLE, 0.65::DOUBLE), (2, 'post_whistle', 0.80::DOUBLE, 0.96::DOUBLE)),
s AS (SELECT i * 6 + j * 3 + k AS stratum, half, angle, phase, low, high, 2000 // 12 + CASE WHEN i * 6 + j * 3 + k < 2000 % 12 THEN 1 ELSE 0 END AS want FROM h, a, p),
x AS (SELECT *, row_number() OVER (PARTITION BY half ORDER BY film_play_index, play_uid) - 1 AS pos, count(*) OVER (PARTITION BY half) AS n FROM {INDEX_SQL}),
t AS (SELECT s.*, unnest(range(0, want)) AS turn FROM s), m AS (SELECT DISTINCT half, n FROM x),
c AS (SELECT t.*, m.n, CASE WHEN want < m.n THEN CAST(floor(turn * m.n / want::DOUBLE) AS BIGINT) ELSE turn % m.n END AS pos FROM t JOIN m USING (half)),
q AS (SELECT c.*, x.play_uid, x.film_play_index, CASE angle WHEN 'sideline' THEN ss ELSE es END AS a, CASE angle WHEN 'sideline' THEN se ELSE ee END AS b,
 low + CASE WHEN want < c.n THEN 0.5::DOUBLE ELSE (0.5::DOUBLE + (turn // c.n) * 0.6180339887498949::DOUBLE) % 1 END * (high - low) AS q FROM c JOIN x ON x.half = c.half AND x.pos = c.pos),
f AS (SELECT *, CAST(round_even((a + q * (b - a)) * 25, 0) AS BIGINT) AS frame FROM q)
SELECT play_uid, film_play_index, angle, phase AS phase_guess, half, frame FROM f QUALIFY row_number() OVER (PARTITION BY frame ORDER BY stratum, turn) = 1""")
def sampled_frames(spark, sf):
    k = F.col("o_orderkey")
    at = lambda more: (k * 40 + more).cast("double")
    index = read(spark, sf, "orders").select(
        F.concat(F.lit("p"), k.cast("string")).alias("play_uid"), k.alias("film_play_index"), at(0).alias("sideline_start_s"), at(12).alias("sideline_end_s"),
        at(14).alias("endzone_start_s"), at(27).alias("endzone_end_s"))
    quarters = read(spark, sf, "orders").select(F.concat(F.lit("p"), k.cast("string")).alias("play_uid"), (k % 4 + 1).alias("qtr"))
    return sampling.sampled_frames(index, quarters).select("play_uid", "film_play_index", "angle", "phase_guess", "half", "frame")
