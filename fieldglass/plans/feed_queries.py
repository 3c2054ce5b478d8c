"""Queries of the feed adapters, over payloads that nest the supplied tables as the feeds nest games, and of play records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import nested as N
from fieldglass.functions import plays as P
from fieldglass.operators import formations
from fieldglass.plans import records
from fieldglass.plans.play_queries import ADMIN_SQL, CLOCKS, CODES, JERSEYS, NARRATED_SQL, SPOTS, WORDS, pick, pick_sql
from fieldglass.plans.queries import PLAYS_SQL, as_plays
from fieldglass.plans.registry import query, read
from fieldglass.sources import feeds

IDS = tuple(feeds.TEAM_IDS)
ABBR_SQL = "CASE {} " + " ".join(f"WHEN {i} THEN '{'LA' if a == 'LAR' else a.upper()}'" for i, a in feeds.TEAM_IDS.items()) + " END"
NAME_SQL = "CASE {} " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in feeds.TEAM_IDS.items()) + " END"
DAYS = ("2024-01-14T18:00:00", "2024-09-08T17:00:00", "2025-02-09T00:00:00")


def team_id(number):
    return F.get(F.array(*map(F.lit, IDS)), F.pmod(number, F.lit(len(IDS))).cast("int"))


def team_id_sql(number: str) -> str:
    return f"([{', '.join(map(str, IDS))}])[({number}) % {len(IDS)} + 1]"


def statistics(spark, sf) -> DataFrame:
    """Each customer's orders as one payload of the statistics feed: an order is an event, its line items are plays."""
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    third = F.floor(F.col("l_partkey") / 3)
    person = F.struct((F.col("l_suppkey") % 9).cast("int").alias("playerInvolvedTypeId"), F.lit("helper").alias("playerInvolvedType"), F.struct(
        F.col("l_suppkey").cast("int").alias("playerId"), F.lit("A").alias("firstName"), F.col("l_suppkey").cast("string").alias("lastName"),
        (F.col("l_suppkey") % 99).cast("string").alias("uniform")).alias("player"))
    play = F.struct(
        n.cast("double").alias("playId"), F.floor(n / 3).cast("int").alias("driveId"), (n % 4 + 1).cast("int").alias("period"),
        F.lit("5:00").alias("time"), (F.col("l_suppkey") % 5).cast("string").alias("down"), F.lit("x").alias("distance"),
        pick(SPOTS, F.col("l_partkey")).alias("yardLine"), F.struct(team_id(k + n % 2 * 5).cast("int").alias("teamId")).alias("startPossession"),
        F.struct((F.col("l_partkey") % 60).cast("int").alias("playTypeId"), F.lit("t").alias("name")).alias("playType"),
        pick(WORDS, third).alias("playText"), F.col("l_quantity").cast("int").alias("yards"), F.lit(None).cast("string").alias("direction"),
        F.lit(None).cast("boolean").alias("isReview"), F.lit(None).cast("boolean").alias("isContinuation"), F.array(person).alias("playersInvolved"))
    lines = read(spark, sf,
        "lineitem").groupBy(k.alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct(n.alias("n"), "l_partkey", "l_suppkey", play.alias("p")))).alias("l")).select("o_orderkey",
        F.transform("l", lambda x: x["p"]).alias("pbp"))
    o = F.col("o_orderkey")
    side = lambda i, name: F.struct(i.cast("int").alias("teamId"), F.struct(F.lit(name).alias("name")).alias("teamLocationType"))
    dates = F.array(F.struct(F.lit("2020-05-05").alias("full"), F.lit("Local").alias("dateType")),
        F.struct(pick(DAYS, o).alias("full"), F.lit("UTC").alias("dateType")))
    event = F.struct(o.cast("long").alias("eventId"), (o % 18 + 1).cast("int").alias("week"), dates.alias("startDate"),
        F.array(side(team_id(o), "Home"), side(team_id(o + 5), "away")).alias("teams"), "pbp").cast(feeds.EVENT)
    games = read(spark, sf, "orders").join(lines, "o_orderkey").groupBy("o_custkey").agg(F.collect_list(event).alias("events"))
    twice = F.concat(F.col("events"), F.slice("events", 1, 1))
    season = F.when(F.col("o_custkey") % 3 > 0, (2000 + F.col("o_custkey") % 20).cast("int"))
    kind = F.struct(F.lit(1).alias("eventTypeId"), F.lit("Regular Season").alias("name"), twice.alias("events"))
    return games.select(F.array(
        F.struct(F.struct(F.struct(season.alias("season"), F.array(kind).alias("eventType")).alias("season")).alias("league"))).alias("apiResults"))


DATE_SEASON_SQL = "([2023, 2024, 2024])[o_orderkey % 3 + 1]"
FEED_SQL = f"""g AS (SELECT o_orderkey, o_orderkey % 18 + 1 AS week, CASE WHEN o_custkey % 3 > 0 THEN 2000 + o_custkey % 20
 ELSE {DATE_SEASON_SQL} END AS season, {team_id_sql('o_orderkey')} AS hid, {team_id_sql('o_orderkey + 5')} AS aid FROM orders),
h AS (SELECT *, {ABBR_SQL.format('hid')} AS home, {ABBR_SQL.format('aid')} AS away FROM g), r AS (SELECT h.*, l.*,
 {pick_sql(WORDS, 'l_partkey // 3')} AS text, {pick_sql(SPOTS, 'l_partkey')} AS spot, l_partkey % 60 AS id, CASE WHEN l_linenumber % 2 = 0 THEN home
 ELSE away END AS posteam FROM h JOIN lineitem l ON l_orderkey = o_orderkey),
k AS (SELECT *, printf('%d_wk%02d_%s-%s', season, week, away, home) AS game_key, CASE WHEN id IN (1, 2, 3, 9) THEN 'pass' WHEN id = 4 THEN 'run'
 WHEN id = 5 THEN 'kickoff' WHEN id = 7 THEN 'punt' WHEN id IN (10, 11) THEN 'penalty' WHEN id = 13 THEN 'two_minute_warning'
 WHEN id = 14 THEN 'fumble' WHEN id = 22 THEN 'extra_point' WHEN id = 42 THEN 'field_goal' WHEN id IN (57, 58) THEN 'timeout' END AS known,
 {NARRATED_SQL} AS told FROM r), d AS (SELECT *, known = 'penalty' AND regexp_matches(coalesce(text, ''), '^\\s*penalty\\s*:', 'i') AS dead FROM k),
 y AS (SELECT *, CASE WHEN dead THEN 'penalty' WHEN known IN ('fumble', 'penalty') THEN coalesce(told, known) ELSE known END AS play_type FROM d),
p AS (SELECT *, coalesce(play_type IN ('pass', 'run'), false) AND NOT coalesce(dead, false) AS is_scrimmage, regexp_extract(trim(spot),
 '^([A-Za-z]+)\\s*(\\d{{1,2}})$', 1) AS side, TRY_CAST(nullif(regexp_extract(trim(spot), '^([A-Za-z]+)\\s*(\\d{{1,2}})$', 2), '') AS INTEGER) AS yard
 FROM y),
i AS (SELECT *, CASE WHEN is_scrimmage THEN count(*) FILTER (is_scrimmage) OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey,
 l_suppkey ROWS UNBOUNDED PRECEDING) END AS play_index FROM p)""".replace("\\\\", "\\")


@query("q_feed_plays", f"""WITH {FEED_SQL} SELECT o_orderkey AS event_id, game_key, CAST(season AS BIGINT) AS season, CAST(week AS BIGINT) AS week,
 CAST(l_linenumber AS DOUBLE) AS play_id, CAST(l_suppkey % 5 AS BIGINT) AS down, posteam, CASE WHEN posteam = home THEN away
 WHEN posteam = away THEN home END AS defteam,
 CAST(CASE WHEN side <> '' AND yard BETWEEN 0 AND 50 THEN CASE WHEN CASE upper(side) WHEN 'LAR' THEN 'LA'
 ELSE upper(side) END = posteam THEN 100 - yard ELSE yard END END AS BIGINT) AS yardline_100, play_type, is_scrimmage,
 CAST(play_index AS BIGINT) AS play_index, game_key || printf('_p%03d', play_index) AS play_uid FROM i""")
def feed_plays(spark, sf):
    plays = feeds.feed_plays(feeds.events(statistics(spark, sf)), feeds.static_teams(spark))
    whole = [F.col(c).cast("long").alias(c) for c in ("season", "week", "down", "yardline_100", "play_index")]
    return plays.select("event_id", "game_key", *whole, "play_id", "posteam", "defteam", "play_type", "is_scrimmage", "play_uid")


@query("q_uniforms", f"""WITH {FEED_SQL}, u AS (SELECT game_key, CASE WHEN l_suppkey % 9 IN (1, 5, 6, 7) THEN posteam ELSE CASE
 WHEN posteam = home THEN away WHEN posteam = away THEN home END END AS team, CAST(l_suppkey % 99 AS VARCHAR) AS n FROM i)
SELECT game_key, team, array_to_string(list_sort(list(DISTINCT n)), ' ') AS numbers FROM u WHERE team IS NOT NULL GROUP BY ALL""")
def uniforms(spark, sf):
    found = feeds.uniforms(feeds.feed_plays(feeds.events(statistics(spark, sf))))
    return found.withColumn("numbers", F.array_join("numbers", " "))


@query("q_event_lines",
    f"""SELECT o_orderkey AS event_id, o_orderkey || '  week ' || (o_orderkey % 18 + 1) || '  ' || {NAME_SQL.format(team_id_sql('o_orderkey + 5'))} || ' @ ' || {NAME_SQL.format(team_id_sql('o_orderkey'))} || '  ' || {pick_sql(DAYS, 'o_orderkey')} AS line
 FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def event_lines(spark, sf):
    return feeds.event_lines(feeds.events(statistics(spark, sf)), feeds.static_teams(spark))


@query("q_found_events",
    f"SELECT o_orderkey AS event_id, array_to_string(list_sort([{team_id_sql('o_orderkey')}, {team_id_sql('o_orderkey + 5')}]), ' ') AS teams FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderkey % 18 + 1 = 7 AND 326 IN ({team_id_sql('o_orderkey')}, {team_id_sql('o_orderkey + 5')})")
def found_events(spark, sf):
    found = feeds.found_events(feeds.events(statistics(spark, sf)), 326, 7, "Regular Season")
    return found.select("event_id", F.array_join(F.array_sort(N.event_teams(F.col("e.teams"))).cast("array<string>"), " ").alias("teams"))


# --- the league's details


#: A play's id is its line's number times this, plus its part's times 1000, plus its supplier's: so ids are in order of the three.
LINE_IDS = 10**15


def details(spark, sf) -> DataFrame:
    """Each order as the league's detail of a game, its line items as plays."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    fifth, third = F.floor(p / 5), F.floor(p / 3)
    stat = F.struct((F.col("l_suppkey") % 130).cast("int").alias("statType"),
        F.when(F.col("l_suppkey") % 2 == 0, "H").otherwise("A").alias("teamId"), F.lit(3).alias("yards"),
        F.col("l_suppkey").cast("string").alias("gsisPlayerId"), F.lit("A.B").alias("gsisPlayerName"),
        pick(JERSEYS, F.col("l_suppkey")).alias("gsisPlayerJerseyNumber"))
    play = F.struct(
        F.when(p % 17 > 0, n.cast("long") * LINE_IDS + p * 1000 + F.col("l_suppkey") % 1000).alias("playId"),
        (n % 4 + 1).cast("int").alias("quarter"), F.lit(None).cast("string").alias("clockTime"), (n % 3).cast("int").alias("driveSequence"),
        (F.col("l_suppkey") % 5).cast("int").alias("down"), F.lit(8).alias("yardsRemaining"),
        pick(SPOTS, p).alias("yardLine"), pick(CODES, fifth).alias("playType"),
        F.concat(F.coalesce(pick(CLOCKS, p), F.lit("")), F.coalesce(pick(WORDS, third), F.lit(""))).alias("playDescription"),
        F.col("l_quantity").cast("int").alias("yardsGained"), (p % 2 == 0).alias("playScored"), (p % 13 == 0).alias("playDeleted"),
        F.array(stat).alias("stats"))
    lines = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(play).alias("plays"))
    o = F.col("o_orderkey")
    team = lambda i, logo: F.struct(F.lit(i).alias("id"), F.concat(F.lit("https://x/logos/"), F.lit(logo)).alias("currentLogo"),
        F.lit(i).alias("fullName"))
    drives = F.array(*(F.struct(F.lit(k).alias("sequence"), F.lit(t).alias("teamId")) for k, t in ((0, "H"), (1, "H"), (1, "A"))))
    ids = F.array(F.struct(F.lit("gsis").alias("source"), o.cast("string").alias("id")),
        F.struct(F.lit("slug").alias("source"), F.concat(F.lit("game-"), o.cast("string")).alias("id")))
    made = read(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey").select(
        F.concat(F.lit("g"), o.cast("string")).alias("id"), F.lit(None).cast("string").alias("time"), team("H", "WSH").alias("homeTeam"),
        team("A", "CHI").alias("awayTeam"), ids.alias("externalIds"), F.struct(F.lit("v").alias("name")).alias("venue"),
        F.struct(drives.alias("drives"), F.col("plays").alias("plays")).alias("driveChart"))
    schema = spark.createDataFrame([], feeds.DETAIL).schema
    return made.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


SAID_SQL = f"coalesce({pick_sql(CLOCKS, 'l_partkey')}, '') || coalesce({pick_sql(WORDS, 'l_partkey // 3')}, '')"
LEAGUE_SQL = f"""r AS (SELECT *, {SAID_SQL} AS said, {pick_sql(CODES, 'l_partkey // 5')} AS code, {pick_sql(SPOTS, 'l_partkey')} AS spot,
 CASE l_linenumber % 3 WHEN 0 THEN 'WAS' WHEN 1 THEN 'CHI' END AS posteam FROM lineitem WHERE l_partkey % 13 <> 0 AND l_partkey % 17 > 0),
x AS (SELECT *, regexp_replace(said, '^\\((\\d{{1,2}}:\\d{{2}})\\)\\s*', '') AS text, nullif(regexp_extract(said, '^\\((\\d{{1,2}}:\\d{{2}})\\)\\s*',
 1), '') AS clock, regexp_extract(trim(spot), '^([A-Za-z]+)\\s*(\\d{{1,2}})$', 1) AS side, TRY_CAST(nullif(regexp_extract(trim(spot),
 '^([A-Za-z]+)\\s*(\\d{{1,2}})$', 2), '') AS INTEGER) AS yard FROM r),
s AS (SELECT *, lower(text) AS d, upper(coalesce(code, '')) AS t FROM x),
k AS (SELECT *, CASE WHEN t IN ('GAME_START', 'END_QUARTER', 'END_HALF', 'END_GAME', 'TIMEOUT', 'TWO_MINUTE_WARNING',
 'COMMENT') OR {ADMIN_SQL.format(code='code')} THEN NULL
 WHEN contains(d, 'no play') AND contains(d, 'penalty') THEN 'no_play' WHEN contains(d, 'kicks off') OR contains(d, 'kickoff') OR contains(t,
 'KICK_OFF') OR t = 'KICKOFF' THEN 'kickoff' WHEN contains(d, 'punts') OR t = 'PUNT' THEN 'punt'
 WHEN contains(d, 'field goal') OR t IN ('FIELD_GOAL', 'FG') THEN 'field_goal' WHEN contains(d, 'extra point') OR t IN ('XP_KICK', 'EXTRA_POINT',
 'PAT') THEN 'extra_point' WHEN contains(d, 'kneels') THEN 'qb_kneel' WHEN contains(d, 'spiked') THEN 'qb_spike'
 WHEN contains(d, 'two-point') OR contains(d, 'two point') THEN CASE WHEN contains(d, 'pass') THEN 'pass' ELSE 'run' END WHEN contains(d,
 'scrambles') THEN 'run' WHEN contains(d, 'pass') OR contains(d, 'sacked') OR t IN ('PASS', 'SACK') THEN 'pass'
 WHEN t IN ('RUSH', 'RUN') OR regexp_matches(d, '\\b(left|right) (end|tackle|guard)\\b|up the middle') THEN 'run' WHEN t = 'PENALTY' OR contains(d,
 'penalty') THEN 'no_play' END AS play_type FROM s),
i AS (SELECT *, coalesce(play_type IN ('pass', 'run', 'punt', 'field_goal', 'extra_point', 'kickoff', 'qb_kneel', 'qb_spike'), false) AS film FROM k),
p AS (SELECT *, CASE WHEN film THEN count(*) FILTER (film) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
 l_suppkey % 1000 ROWS UNBOUNDED PRECEDING) END AS play_index, CASE upper(side) WHEN 'LAR' THEN 'LA' WHEN 'JAC' THEN 'JAX'
 ELSE upper(side) END AS sided,
 CASE posteam WHEN 'WAS' THEN 'WAS' ELSE posteam END AS code_of FROM i)""".replace("\\\\", "\\")


def league(spark, sf) -> DataFrame:
    return feeds.league_plays(details(spark, sf), F.lit(2024), F.lit(5))


@query("q_league_plays", f"""WITH {LEAGUE_SQL} SELECT CAST(l_linenumber * 200000000 + l_partkey * 1000 + l_suppkey % 1000 AS BIGINT) AS play,
 clock AS time, CAST(nullif(l_suppkey % 5, 0) AS BIGINT) AS down, CAST(CASE WHEN l_suppkey % 5 > 0 THEN 8 END AS BIGINT) AS ydstogo, posteam,
 CASE posteam WHEN 'WAS' THEN 'CHI' WHEN 'CHI' THEN 'WAS' END AS defteam, CAST(CASE WHEN trim(spot) = '50' THEN 50 WHEN side <> '' THEN CASE
 WHEN coalesce(sided = posteam, false) THEN 100 - yard ELSE yard END END AS BIGINT) AS yardline_100, play_type,
 CAST(play_index AS BIGINT) AS play_index,
 l_partkey % 2 = 0 AND contains(d, 'touchdown') AS touchdown FROM p""")
def league_plays(spark, sf):
    play = F.expr(f"nfl_play_id div {LINE_IDS} * 200000000 + nfl_play_id % {LINE_IDS}")
    rows = league(spark, sf).withColumn("nfl_play_id", play)
    whole = [F.col(c).cast("long").alias(n) for c,
        n in (("nfl_play_id", "play"), ("down", "down"), ("ydstogo", "ydstogo"), ("yardline_100", "yardline_100"), ("play_index", "play_index"))]
    return rows.select(*whole, "time", "posteam", "defteam", "play_type", "touchdown")


@query("q_slugs", "SELECT 'g' || o_orderkey AS id, 'game-' || o_orderkey AS slug FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def slugs(spark, sf):
    return feeds.slug_of(details(spark, sf))


# --- rosters and registries


def rosters(spark, sf) -> DataFrame:
    """Each nation's customers as a roster that lies two levels down."""
    k = F.col("c_custkey")
    person = F.struct(F.when(k % 10 > 0, k.cast("string")).alias("gsisId"), pick(JERSEYS, k).alias("jerseyNumber"),
        F.when(k % 3 > 0, F.col("c_name")).alias("displayName"), F.lit("Ann").alias("firstName"),
        F.when(k % 4 > 0, F.col("c_mktsegment")).alias("lastName"))
    lists = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), person.alias("p")))).alias("l"))
    pages = F.struct(F.when(F.col("c_nationkey") == 3, "more").alias("token"))
    return lists.select(F.struct(F.struct(F.transform("l", lambda x: x["p"]).alias("players")).alias("roster")).alias("data"),
        pages.alias("pagination"))


FORMS_SQL = """list_distinct(list_filter([CASE WHEN c_custkey % 3 > 0 THEN c_name END, CASE WHEN c_custkey % 4 > 0 THEN 'Ann ' || c_mktsegment
 ELSE 'Ann' END, CASE WHEN c_custkey % 4 > 0 THEN 'A.' || c_mktsegment END], lambda x: x IS NOT NULL))"""
JERSEY_SQL = f"CASE WHEN regexp_replace(trim({pick_sql(JERSEYS, 'c_custkey')}), '^0+', '') = '' THEN '0' ELSE regexp_replace(trim({pick_sql(JERSEYS, 'c_custkey')}), '^0+', '') END"


@query("q_roster", f"SELECT CASE WHEN c_custkey % 10 > 0 THEN CAST(c_custkey AS VARCHAR) END AS gsis_id, {JERSEY_SQL} AS jersey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name, array_to_string(list_sort({FORMS_SQL}), '; ') AS name_forms FROM customer")
def roster(spark, sf):
    return feeds.roster(rosters(spark, sf)).select("gsis_id", "jersey", "name", F.array_join(F.array_sort("name_forms"), "; ").alias("name_forms"))


@query("q_adapter_report", "SELECT count(*) AS entries, count(*) FILTER (c_custkey % 10 > 0) AS understood, true AS more_pages FROM customer")
def adapter_report(spark, sf):
    payload = rosters(spark, sf)
    return feeds.adapter_report(payload, feeds.roster(payload))


@query("q_jersey_players",
    f"SELECT c_nationkey, jersey, arg_max(c_name, c_custkey) AS name FROM (SELECT *, {JERSEY_SQL} AS jersey FROM customer) WHERE jersey IS NOT NULL GROUP BY ALL")
def jersey_players(spark, sf):
    rows = read(spark, sf, "customer").select("c_nationkey", P.plain_uniform(pick(JERSEYS, F.col("c_custkey"))).alias("jersey"),
        F.col("c_name").alias("name"), F.col("c_custkey").alias("place"))
    return feeds.jersey_players(rows, ("c_nationkey",))


@query("q_league_teams",
    "SELECT upper(substr(n_name, 1, 3)) AS abbreviation, arg_max(CAST(n_nationkey AS VARCHAR), n_nationkey) AS team_id, arg_max(n_name, n_nationkey) AS name FROM nation WHERE n_nationkey <> 4 GROUP BY ALL")
def league_teams(spark, sf):
    k = F.col("n_nationkey")
    team = F.struct(F.lower(F.substring("n_name", 1, 3)).alias("abbr"), F.when(k != 4, k.cast("string")).alias("teamId"),
        F.col("n_name").alias("fullName"))
    payload = read(spark, sf,
        "nation").groupBy().agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), team.alias("t")))).alias("l")).select(
        F.transform("l", lambda x: x["t"]).alias("teams"))
    return feeds.league_teams(payload)


@query("q_team_registry",
    "SELECT n_nationkey AS team_id, upper(substr(n_name, 1, 3)) AS abbreviation, n_name AS nickname, r_name AS location FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 6 <> 5")
def team_registry(spark, sf):
    k = F.col("n_nationkey")
    both = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    team = F.struct(k.alias("teamId"), F.upper(F.substring("n_name", 1, 3)).alias("abbreviation"),
        F.when(k % 6 != 5, F.col("n_name")).alias("nickname"), F.col("r_name").alias("location"))
    payload = both.groupBy("r_name").agg(F.collect_list(team).alias("teams")).groupBy().agg(F.collect_list(F.struct("teams")).alias("conferences"))
    return feeds.team_registry(payload, "conferences.teams")


@query("q_names_and_codes",
    """SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END), ''), c_name) AS filled, CASE c_custkey % 12
 WHEN 10 THEN 'rush' WHEN 11 THEN 'score' ELSE 'statType ' || (c_custkey % 12) END AS code, CASE WHEN c_custkey % 2 = 0 THEN 'H' ELSE 'x' END AS home
 FROM customer""")
def names_and_codes(spark, sf):
    k = F.col("c_custkey")
    teams = F.array(*(F.struct(F.lit(i).alias("teamId"),
        F.struct(F.when((k % 2 == 0) | (F.lit(i) == "x"), F.lit("Home")).otherwise("away").alias("name")).alias("teamLocationType"))
        for i in ("x", "H")))
    return read(spark, sf, "customer").select("c_custkey",
        N.first_filled(F.when(k % 3 == 0, " ").otherwise(F.col("c_mktsegment")), F.col("c_name")).alias("filled"),
        N.code_label({10: "rush", 11: "score"}, (k % 12).cast("int")).alias("code"), N.side_team(teams, "home").alias("home"))


@query("q_json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract(spark, sf):
    """A payload's number wherever its list lies: the list is found by its field's name."""
    made = read(spark, sf,
        "events").select(F.struct(F.array(F.struct("event_id", F.from_json("props", "k int")["k"].alias("k"))).alias("entries")).alias("body"))
    return N.exploded_candidates(made, ["k"]).select("item.event_id", "item.k")


# --- records and formations


@query("q_play_records",
    f"""SELECT printf('2024_wk05_BUF-NYJ_p%03d', play_index) AS play_uid, CAST(down AS INTEGER) AS down, 10.0::DOUBLE + (100 - yardline_100) AS los_x,
 CAST(trunc(yards_gained) AS INTEGER) AS yards_gained, 'official' AS source FROM {PLAYS_SQL}""")
def play_records(spark, sf):
    plays = as_plays(spark, sf).withColumn("play_uid", P.play_uid(F.lit("2024_wk05_BUF-NYJ"), F.col("play_index"))).withColumn("play_type",
        F.lit("pass"))
    made = records.play_records(plays, {"game_key": "2024_wk05_BUF-NYJ", "season": 2024, "week": 5, "away": "BUF", "home": "NYJ"},
        "2024-10-14T00:00:00Z")
    return records.checked(made).select("play_uid", "situation.down", "situation.los_x", "official.yards_gained", "official.labels.source")


@query("q_record_problems",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END + CASE
 WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS wrong FROM customer""")
def record_problems(spark, sf):
    k = F.col("c_custkey")
    uid = F.when(k % 3 == 0, "p1").otherwise(F.format_string("2024_wk05_BUF-NYJ_p%03d", k))
    rows = read(spark, sf, "customer").select(
        "c_custkey", F.lit("0.1.0").alias("schema_version"), uid.alias("play_uid"), F.lit("g").alias("game"),
        F.when(k % 7 != 0, "s").alias("situation"),
        F.struct(F.when(k % 5 == 0, "dance").otherwise("pass").alias("play_type"),
        F.struct(F.lit("cv").alias("source")).alias("labels")).alias("official"),
        F.struct(F.lit("reviewed").alias("status")).alias("review"), F.struct(F.lit("post").alias("pass")).alias("generated"))
    return rows.select("c_custkey", F.size(records.problems(rows)).alias("wrong"))


@query("q_game_documents",
    "SELECT o_custkey, '[' || string_agg('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}', ',' ORDER BY o_orderkey) || ']' AS plays, count(*) AS n FROM orders GROUP BY o_custkey")
def game_documents(spark, sf):
    return records.game_document(read(spark, sf, "orders"), ["o_custkey"], "o_orderkey", ["o_orderkey", "o_orderstatus"])


@query("q_nested_record",
    "SELECT o_orderkey, count(*) AS n, CAST(list(l_linenumber ORDER BY l_linenumber)[1] AS INTEGER) AS first_line, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def nested_record(spark, sf):
    """An order's lines as one document, read again."""
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber",
        "l_quantity").join(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    made = records.game_document(lines, ["o_orderkey"], "l_linenumber", ["l_linenumber", "l_quantity"])
    parsed = made.withColumn("l", F.from_json("plays", "array<struct<l_linenumber:int,l_quantity:double>>"))
    return parsed.select("o_orderkey", "n", F.get("l", 0)["l_linenumber"].alias("first_line"),
        F.aggregate("l", F.lit(0.0), lambda s, x: s + x["l_quantity"]).alias("quantity"))


@query("q_canonical_formations",
    "SELECT p_partkey, CASE p_partkey % 100 " + " ".join(f"WHEN {a} THEN {b}" for a, b in formations.ALIASES.items())
    + " ELSE p_partkey % 100 END AS formation_id FROM part")
def canonical_formations(spark, sf):
    return read(spark, sf, "part").select("p_partkey", formations.canonical_id(F.col("p_partkey") % 100).alias("formation_id"))


@query("q_set_algebra", """WITH w AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS own FROM benchmark), c(id,
 slots) AS (VALUES (1, ['the', 'of', 'and']), (2, ['a', 'in', 'to', 'is']), (3, ['de', 'la'])), m AS (SELECT item_id, id,
 len(slots) - len(list_intersect(own, slots)) AS missing, len(own) - len(list_intersect(own, slots)) AS extra FROM w, c)
SELECT item_id, id AS formation_id, missing, extra FROM m QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY missing + extra, id) = 1""")
def set_algebra(spark, sf):
    """The set of words of a small table that each text's own differs from least."""
    table = spark.createDataFrame([(1, ["the", "of", "and"]), (2, ["a", "in", "to", "is"]), (3, ["de", "la"])],
        "formation_id int, slots array<string>")
    rows = read(spark, sf, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("own"))
    found = formations.matched_formations(rows, "own", table)
    return found.select("item_id", "formation_id", F.size("missing").cast("long").alias("missing"), F.size("extra").cast("long").alias("extra"))
