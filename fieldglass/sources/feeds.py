"""The feeds' nested payloads as one row for each play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.functions import nested as N
from fieldglass.functions import plays as P
from fieldglass.operators.joins import first_rows

# Roles of the two feeds by code, and the ids of teams.
ROLES = {1: "player", 2: "tackler", 3: "assister", 4: "pass_defender", 5: "target", 6: "snapper", 7: "holder"}
STAT_ROLES = {
    10: "rusher", 11: "rusher", 12: "rusher", 13: "rusher", 14: "passer", 15: "passer", 16: "passer", 19: "passer", 20: "passer", 21: "receiver",
    22: "receiver", 23: "receiver", 24: "receiver", 25: "interceptor", 26: "interceptor", 29: "punter",
    33: "returner", 41: "kicker", 45: "returner", 52: "fumbler", 53: "fumbler", 69: "kicker", 70: "kicker", 72: "kicker", 73: "kicker",
    79: "tackler", 80: "tackler", 82: "tackler", 83: "sacker", 84: "sacker", 85: "pass_defender", 91: "forced_fumble",
    106: "fumbler", 110: "qb_hit", 115: "target", 120: "tackle_for_loss",
}
TEAM_IDS = {
    323: "Atl", 324: "Buf", 325: "Hou", 326: "Chi", 327: "Cin", 329: "Cle", 331: "Dal", 332: "Den", 334: "Det", 335: "GB", 336: "Ten", 338: "Ind",
    339: "KC", 341: "LV", 343: "LAR", 345: "Mia",
    347: "Min", 348: "NE", 350: "NO", 351: "NYG", 352: "NYJ", 354: "Phi", 355: "Ari", 356: "Pit", 357: "LAC", 359: "SF", 361: "Sea", 362: "TB",
    363: "Was", 364: "Car", 365: "Jax", 366: "Bal",
}
# The names under which a list of teams may keep their ids, codes and names.
TEAM_KEYS = ("id", "teamId", "guid")
TEAM_CODES = ("abbreviation", "abbr", "teamAbbr", "nickAbbr", "triCode")
TEAM_NAMES = ("fullName", "displayName", "name", "nickName")
#: A registry of teams becomes a constant of the plan, so its size is checked.
MOST_TEAMS = 1000
OFFENSE_ROLES = ("player", "target", "snapper", "holder")

PLAY = "struct<playId:double,driveId:int,period:int,time:string,down:string,distance:string,yardLine:string,startPossession:struct<teamId:int>,playType:struct<playTypeId:int,name:string>,playText:string,yards:int,direction:string,isReview:boolean,isContinuation:boolean,playersInvolved:" + N.INVOLVED + ">"
EVENT = f"struct<eventId:bigint,week:int,startDate:array<struct<full:string,dateType:string>>,teams:array<struct<teamId:int,teamLocationType:struct<name:string>>>,pbp:array<{PLAY}>>"
ENVELOPE = f"apiResults array<struct<league:struct<season:struct<season:int,eventType:array<struct<eventTypeId:int,name:string,events:array<{EVENT}>>>>>>>"
DETAIL = (
    "id string, time string, homeTeam struct<id:string,currentLogo:string,fullName:string>, awayTeam struct<id:string,currentLogo:string,fullName:string>, externalIds array<struct<source:string,id:string>>, venue struct<name:string>, "
    "driveChart struct<drives:array<struct<sequence:int,teamId:string>>,plays:array<struct<playId:bigint,quarter:int,clockTime:string,driveSequence:int,down:int,yardsRemaining:int,yardLine:string,playType:string,playDescription:string,yardsGained:int,playScored:boolean,playDeleted:boolean,"
    "stats:array<struct<statType:int,teamId:string,yards:int,gsisPlayerId:string,gsisPlayerName:string,gsisPlayerJerseyNumber:string>>>>>"
)


def static_teams(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEAM_IDS.items()), "team_id int, abbreviation string")


def events(payload: DataFrame) -> DataFrame:
    """One row for each event, the first of repeated ids in document order: event_type, season and the event's fields."""
    rows = payload.select(F.monotonically_increasing_id().alias("_d"), F.posexplode("apiResults").alias("_a", "r")).select("_d", "_a",
        F.col("r.league.season.season").alias("season"), F.posexplode("r.league.season.eventType").alias("_b", "t"))
    each = rows.select("_d", "_a", "_b", "season", F.col("t.name").alias("event_type"),
        F.posexplode("t.events").alias("_c", "e")).filter("e.eventId is not null")
    flat = each.select(F.col("e.eventId").alias("event_id"), "season", "event_type", "e", F.struct("_d", "_a", "_b", "_c").alias("_place"))
    return first_rows(flat, ["event_id"], F.col("_place")).drop("_place")


def found_events(all_events: DataFrame, team_id: int | None = None, week: int | None = None, event_type: str | None = None) -> DataFrame:
    out = all_events
    if team_id is not None:
        out = out.filter(F.array_contains(N.event_teams(F.col("e.teams")), team_id))
    if week is not None:
        out = out.filter(F.col("e.week") == week)
    return out.filter(F.col("event_type") == event_type) if event_type is not None else out


def one_event(all_events: DataFrame, event_id: int) -> DataFrame:
    rows = all_events.filter(F.col("event_id") == event_id)
    if rows.isEmpty():
        raise ValueError(f"no event {event_id}")
    return rows


def event_lines(all_events: DataFrame, teams: DataFrame) -> DataFrame:
    """event_id and a line that describes it."""
    name = lambda side, t: F.coalesce(t, F.lit("?")).alias(side)
    sides = all_events.withColumns({"_h": N.side_team(F.col("e.teams"), "home"), "_w": N.side_team(F.col("e.teams"), "away")})
    h, a = (teams.select(F.col("team_id").alias(f"_{k}_id"), F.col("abbreviation").alias(f"_{k}")) for k in ("hn", "an"))
    both = sides.join(h, F.col("_h") == F.col("_hn_id"), "left").join(a, F.col("_w") == F.col("_an_id"), "left").select("event_id", "e",
        "event_type", name("_home", F.col("_hn")), name("_away", F.col("_an")))
    return both.select("event_id",
        F.rtrim(F.format_string("%d  week %s  %s @ %s  %s", "event_id", F.coalesce(F.col("e.week").cast("string"), F.lit("?")), "_away", "_home",
        N.start_date(F.col("e.startDate")))).alias("line"))


def numbered_from_array(position: Column, counts: Column, keys: list[str]) -> Column:
    """1, 2, ... over the rows that count, by place in an array."""
    running = F.sum(F.coalesce(counts, F.lit(False)).cast("int")).over(
        Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    return F.when(counts, running)


def feed_plays(all_events: DataFrame, teams: DataFrame | None = None) -> DataFrame:
    """One row for each play of the statistics feed, numbered over plays from scrimmage."""
    table = TEAM_IDS if teams is None else {r["team_id"]: r["abbreviation"] for r in teams.limit(MOST_TEAMS + 1).collect()}
    if len(table) > MOST_TEAMS:
        raise ValueError(f"over {MOST_TEAMS} teams: this is no team registry")
    abbr = lambda c: P.team_code(P.mapped(table, c), P.FEED_ALIASES)
    head = all_events.withColumns({"_home": abbr(N.side_team(F.col("e.teams"), "home")), "_away": abbr(N.side_team(F.col("e.teams"), "away"))})
    head = head.withColumn("season", P.season_of_date(N.start_date(F.col("e.startDate")), F.col("season"))).withColumn("game_key",
        P.game_key(F.col("season"), F.col("e.week"), F.col("_away"), F.col("_home")))
    rows = head.select("event_id", "season", F.col("e.week").alias("week"), "game_key", "_home", "_away", F.posexplode("e.pbp").alias("_i", "p"))
    kind = P.feed_type(F.col("p.playType.playTypeId"), F.col("p.playText"))
    rows = rows.withColumns({"_k": kind, "posteam": abbr(F.col("p.startPossession.teamId"))})
    rows = rows.withColumn("defteam",
        F.when(F.col("posteam") == F.col("_home"), F.col("_away")).when(F.col("posteam") == F.col("_away"), F.col("_home")))
    rows = rows.withColumn("play_index", numbered_from_array(F.col("_i"), F.col("_k.is_scrimmage"), ["event_id"]))
    number = lambda c: F.expr(f"try_cast({c} as int)")
    return rows.select(
        "game_key", "event_id", "season", "week", F.col("p.playId").alias("play_id"), F.col("p.driveId").alias("drive_id"),
        F.col("p.period").alias("qtr"), F.col("p.time").alias("time"),
        number("p.down").alias("down"), number("p.distance").alias("ydstogo"), F.col("p.yardLine").alias("yrdln"),
        P.feed_yardline(F.col("p.yardLine"), F.col("posteam")).alias("yardline_100"),
        "posteam", "defteam", F.col("_k.play_type").alias("play_type"), F.col("_k.is_scrimmage").alias("is_scrimmage"),
        F.col("p.playText").alias("desc"), F.col("p.yards").alias("yards_gained"), F.col("p.direction").alias("direction"),
        F.coalesce("p.isReview", F.lit(False)).alias("is_review"), F.coalesce("p.isContinuation", F.lit(False)).alias("is_continuation"),
        N.flat_players(F.col("p.playersInvolved"), ROLES).alias("players"), F.col("play_index").cast("int").alias("play_index"),
        P.play_uid(F.col("game_key"), F.col("play_index")).alias("play_uid"))


def uniforms(plays: DataFrame, offense_roles=OFFENSE_ROLES) -> DataFrame:
    """The uniform numbers seen for each team, by the side of the ball that a role is on: game_key, team, numbers."""
    each = plays.select("game_key", "posteam", "defteam", F.explode("players").alias("p"))
    side = F.when(F.col("p.role").isin(*offense_roles), F.col("posteam")).otherwise(F.col("defteam"))
    return each.select("game_key", side.alias("team"),
        F.col("p.uniform").alias("n")).filter("team is not null and n is not null").groupBy("game_key",
        "team").agg(F.array_sort(F.collect_set("n")).alias("numbers"))


def league_plays(details: DataFrame, season: Column, week: Column) -> DataFrame:
    """One row for each play of the league's game details, in order of play id; deleted plays and those without an id are left out."""
    logo = lambda team: P.team_code(P.team_of_logo(F.col(f"{team}.currentLogo")))
    games = details.withColumns({"_home": logo("homeTeam"), "_away": logo("awayTeam")}).withColumn("game_key",
        P.game_key(season, week, F.col("_away"), F.col("_home")))
    team = lambda i: F.when(i == F.col("homeTeam.id"), F.col("_home")).when(i == F.col("awayTeam.id"), F.col("_away"))
    rows = games.select("*",
        F.explode("driveChart.plays").alias("p")).filter(~F.coalesce("p.playDeleted", F.lit(False)) & F.col("p.playId").isNotNull())
    drive = N.last_where(F.col("driveChart.drives"), lambda d: d["sequence"] == F.col("p.driveSequence"))["teamId"]
    text = F.coalesce("p.playDescription", F.lit(""))
    rows = rows.withColumns({"posteam": team(drive), "desc": P.without_clock(text), "_clock": F.coalesce("p.clockTime", P.clock_of(text))})
    rows = rows.withColumn("defteam",
        F.when(F.col("posteam") == F.col("_home"), F.col("_away")).when(F.col("posteam") == F.col("_away"), F.col("_home"))).withColumn("play_type",
        P.league_type(F.col("p.playType"), F.col("desc")))
    film = P.is_one_of(F.col("play_type"), P.FILMABLE_TYPES)
    rows = rows.withColumn("play_index", numbered_from_array(F.col("p.playId"), film, ["game_key", "id"]).cast("int"))
    players = F.transform(
        F.filter(F.coalesce("p.stats",
        F.expr("array()").cast(details.schema["driveChart"].dataType["plays"].dataType.elementType["stats"].dataType)),
        lambda s: P.mapped(STAT_ROLES, s["statType"]).isNotNull()), lambda s: F.struct(
        s["gsisPlayerId"].alias("gsis_id"), s["gsisPlayerName"].alias("name"), P.plain_uniform(s["gsisPlayerJerseyNumber"]).alias("jersey"),
        team(s["teamId"]).alias("team"), P.mapped(STAT_ROLES, s["statType"]).alias("role"), s["statType"].alias("stat_type"),
        s["yards"].alias("yards")))
    down = F.when(F.col("p.down") != 0, F.col("p.down"))
    return rows.select(
        "game_key", P.play_uid(F.col("game_key"), F.col("play_index")).alias("play_uid"), "play_index", F.col("p.playId").alias("nfl_play_id"),
        F.col("p.driveSequence").alias("drive_id"), F.col("p.quarter").alias("qtr"), F.col("_clock").alias("time"),
        down.alias("down"), F.when(down.isNotNull(), F.col("p.yardsRemaining")).alias("ydstogo"), F.col("p.yardLine").alias("yrdln"),
        P.league_yardline(F.col("p.yardLine"), F.col("posteam")).alias("yardline_100"), "posteam", "defteam", "play_type",
        F.col("p.playType").alias("nfl_play_type"), "desc", F.col("p.yardsGained").alias("yards_gained"),
        (F.coalesce("p.playScored", F.lit(False)) & F.contains(F.lower("desc"), F.lit("touchdown"))).alias("touchdown"),
        P.is_one_of(F.col("play_type"), P.SCRIMMAGE_TYPES).alias("is_scrimmage"), players.alias("players"))


def players_by_play(plays: DataFrame) -> DataFrame:
    """game_key and a map from play to its players."""
    return plays.filter("play_uid is not null").groupBy("game_key").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("play_uid", "players")))).alias("players"))


def slug_of(details: DataFrame) -> DataFrame:
    return details.select("id", N.first_where(F.col("externalIds"), lambda e: e["source"] == "slug")["id"].alias("slug"))


def roster(payload: DataFrame, fields: tuple[str, ...] = ("gsisId", "jerseyNumber", "displayName")) -> DataFrame:
    """Players wherever the payload keeps their list: gsis_id, jersey, name, name_forms; later entries of a number stand (jersey_players)."""
    items = N.exploded_candidates(payload, fields)
    have = set(items.schema["item"].dataType.names)
    get = lambda *names: N.first_filled(*(F.col(f"item.{n}") for n in names if n in have)) if have & set(names) else F.lit(None).cast(
        "string")
    display, first, last = get("displayName", "name", "fullName"), get("firstName", "footballName"), get("lastName")
    return items.select(get("gsisId", "gsis_id", "id").alias("gsis_id"), P.plain_uniform(get("jerseyNumber", "jersey", "uniform")).alias("jersey"),
        display.alias("name"),
                        N.name_forms(first, get("commonFirstName", "footballName", "firstName"), last, display).alias("name_forms"),
                        F.monotonically_increasing_id().alias("place"))


def jersey_players(players: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    rest = [c for c in players.columns if c not in (*keys, "jersey", "place")]
    return players.filter("jersey is not null").groupBy(*keys, "jersey").agg(F.max_by(F.struct(*rest), "place").alias("p")).select(*keys, "jersey",
        "p.*")


def team_registry(payload: DataFrame, list_path: str) -> DataFrame:
    """team_id, abbreviation, nickname, location from a nested payload, the first of each id; teams without a nickname are left out."""
    column, rows = F.col(list_path.split(".")[0]), payload
    for k, part in enumerate(list_path.split(".")):
        rows = rows.select(F.posexplode(column if k == 0 else F.col(f"x.{part}")).alias(f"i{k}", "x"))
    flat = rows.select(F.col("x.teamId").alias("team_id"), F.col("x.abbreviation").alias("abbreviation"), F.col("x.nickname").alias("nickname"),
        F.col("x.location").alias("location"), F.monotonically_increasing_id().alias("_o"))
    return first_rows(flat.filter("nickname is not null"), ["team_id"], F.col("_o")).drop("_o")


def adapter_report(payload: DataFrame, players: DataFrame, fields: tuple[str, ...] = ("gsisId", "jerseyNumber", "displayName")) -> DataFrame:
    """entries (how many the payload lists), understood (how many of them became players) and more_pages (whether its pagination
    names a further page), in one row."""
    entries = N.exploded_candidates(payload, fields).agg(F.count("*").alias("entries"))
    understood = players.filter("gsis_id is not null and size(name_forms) > 0").agg(F.count("*").alias("understood"))
    told = F.lit(False)
    if "pagination" in payload.columns:
        have = [n for n in ("token", "nextToken", "next") if n in payload.schema["pagination"].dataType.names]
        told = F.coalesce(*(F.bool_or(F.trim(F.col(f"pagination.{n}")) != "") for n in have), F.lit(False)) if have else told
    return entries.join(understood).join(payload.agg(told.alias("more_pages")))


def league_teams(payload: DataFrame, list_column: str = "teams") -> DataFrame:
    """abbreviation, team_id, name: the teams that a payload lists with an id and an abbreviation, the last of each abbreviation."""
    rows = payload.select(F.monotonically_increasing_id().alias("_d"), F.posexplode(list_column).alias("_i", "t"))
    have = set(rows.schema["t"].dataType.names)
    get = lambda *names: N.first_filled(*(F.col(f"t.{n}") for n in names if n in have)) if have & set(names) else F.lit(None).cast(
        "string")
    told = rows.select(F.upper(get(*TEAM_CODES)).alias("abbreviation"), get(*TEAM_KEYS).alias("team_id"), get(*TEAM_NAMES).alias("name"),
        F.struct("_d", "_i").alias("_o"))
    return told.filter("abbreviation is not null and team_id is not null").groupBy("abbreviation").agg(F.max_by("team_id", "_o").alias("team_id"),
        F.max_by("name", "_o").alias("name"))
