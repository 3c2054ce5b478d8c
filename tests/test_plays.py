"""Column functions and the query tools, on small play tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from fieldglass.functions import geometry as G
from fieldglass.functions import nested as N
from fieldglass.functions import plays as P
from fieldglass.operators import film_room, formations, play_query
from fieldglass.plans import feed_queries, records, registry  # noqa: F401  feed_queries registers
from fieldglass.sources import feeds, tables


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).collect()]


def column(spark, items, kind, make):
    return [r[0] for r in values(spark, [(x,) for x in items], f"x {kind}", make(F.col("x")))]


def test_keys(spark):
    got = values(spark, [(2024, 5, "buf", "NYJ", 7), (2024, 12, "LA", "sf", 1234)], "s int, w int, a string, h string, i int",
        P.game_key(F.col("s"), F.col("w"), F.col("a"), F.col("h")),
        P.play_uid(P.game_key(F.col("s"), F.col("w"), F.col("a"), F.col("h")), F.col("i")))
    assert got == [("2024_wk05_BUF-NYJ", "2024_wk05_BUF-NYJ_p007"), ("2024_wk12_LA-SF", "2024_wk12_LA-SF_p1234")]
    assert column(spark, ["2024_wk05_BUF-NYJ", None], "string", P.parse_game_key)[0].asDict() == {"season": 2024, "week": 5, "away": "BUF",
        "home": "NYJ"}
    with pytest.raises(Exception, match="not a game key"):
        column(spark, ["2024-05"], "string", P.parse_game_key)


@pytest.mark.parametrize(("kind", "desc", "film", "maybe"), [
    ("pass", None, True, False), ("no_play", "(4:22) (Shotgun) A.Smith pass. PENALTY on X", True, False),
    ("no_play", "(4:22) PENALTY on X, False Start", False, True),
    ("qb_kneel", "kneels", True, True), ("timeout", "Timeout", False, False), (None, None, False, False), ("no_play", "", False, False)])
def test_on_film(spark, kind, desc, film, maybe):
    assert values(spark, [(kind, desc)], "k string, d string", P.on_film(F.col("k"), F.col("d")),
        P.maybe_on_film(F.col("k"), F.col("d"))) == [(film, maybe)]


def test_personnel(spark):
    texts = ["1 C, 2 G, 1 QB, 1 RB, 2 T, 1 TE, 3 WR", "2 RB, 2 TE", "1 FB, 1 RB, 3 WR", "5 WR", "", None, "1 RB, 1 RB"]
    assert column(spark, texts, "string", P.offense_grouping) == ["11", "22", "20", "00", None, None, "20"]
    assert column(spark, texts, "string", P.record_personnel) == ["11", "22", "10", None, None, None, "10"]
    fronts = column(spark, ["4 DL, 3 LB, 4 DB", "2 CB, 2 DE, 2 DT, 1 FS, 1 ILB, 1 OLB, 2 SS", "6 DB", "7 S", None], "string",
        lambda c: P.defense_front(c))
    assert [(f.front, f.package) for f in fronts] == [("4-3-4", "base"), ("4-2-5", "nickel"), ("0-0-6", "dime"), ("0-0-7", "quarter"), (None, None)]


def test_league_types(spark):
    cases = {
        ("TIMEOUT", "Timeout #1"): None, ("PASS", "A pass. PENALTY - No Play."): "no_play", ("KICK_OFF", "X kicks 65"): "kickoff",
        ("PUNT", "X punts 40"): "punt", ("FIELD_GOAL", "41 yard field goal is GOOD"): "field_goal",
        ("XP_KICK", "extra point is GOOD"): "extra_point", ("RUSH", "X kneels"): "qb_kneel", ("PASS", "X spiked the ball"): "qb_spike",
        ("X", "TWO-POINT CONVERSION pass"): "pass", ("X", "two-point rush"): "run", ("PASS", "X scrambles"): "run",
        ("SACK", "X sacked"): "pass", ("RUSH", "X left end"): "run", ("PENALTY", "PENALTY on X"): "no_play", ("UNKNOWN", "something"): None,
        (None, None): None, ("COMMENT", "X pass"): None, ("X", "End of quarter"): None}
    assert values(spark, list(cases), "t string, d string", P.league_type(F.col("t"), F.col("d"))) == [(v,) for v in cases.values()]


def test_feed_types(spark):
    cases = {(4, "rushes"): ("run", True), (10, "Penalty: False start"): ("penalty", False), (10, "X pass. Penalty: holding"): ("pass", True),
        (14, "X punts, fumble"): ("punt", False), (14, "odd"): ("fumble", False), (99, "x"): (None, False), (5, "kicks off"): ("kickoff", False)}
    got = values(spark, list(cases), "t int, d string", P.feed_type(F.col("t"), F.col("d")))
    assert [tuple(r[0]) for r in got] == list(cases.values())


def test_spots_uniforms_logos(spark):
    spots = [("Chi37", "LA"), ("LAR35", "LA"), ("x", "LA"), ("Chi60", "LA"), ("Chi37", None), (None, "LA")]
    assert [r[0] for r in values(spark, spots, "s string, p string", P.feed_yardline(F.col("s"), F.col("p")))] == [37, 65, None, None, None, None]
    spots = [("CHI 37", "CHI"), ("LA 29", "CHI"), ("50", "CHI"), ("LAR 20", "LA"), ("CHI 37", None), ("", "CHI")]
    assert [r[0] for r in values(spark, spots, "s string, p string", P.league_yardline(F.col("s"), F.col("p")))] == [63, 29, 50, 80, 37, None]
    assert column(spark, ["04", "0", "00", None, " 12"], "string", P.plain_uniform) == ["4", "0", "0", None, "12"]
    assert column(spark, ["https://x/logos/KC?y", "https://x/logos/kc", None], "string", P.team_of_logo) == ["KC", None, None]
    assert column(spark, ["(4:22) pass", "pass"], "string", P.clock_of) == ["4:22", None] and column(spark, ["(4:22) pass"], "string",
        P.without_clock) == ["pass"]


def test_hash_split_is_sha1(spark):
    keys = [f"k{i}" for i in range(200)]
    share = column(spark, keys, "string", P.split_share)
    assert share == pytest.approx([int(hashlib.sha1(k.encode()).hexdigest()[:8], 16) / 0xFFFFFFFF for k in keys])
    assert column(spark, keys, "string", lambda c: P.fold_of(c, 3)) == [int(hashlib.sha1(k.encode()).hexdigest()[8:16], 16) % 3 for k in keys]


def test_geometry(spark):
    assert column(spark, [0, 20, 100], "int", G.line_x) == [110.0, 90.0, 10.0]
    with pytest.raises(Exception, match="0 to 100"):
        column(spark, [101], "int", G.line_x)
    assert column(spark, [10.0, 60.0, 110.0, 35.0], "double", G.painted_number) == [0.0, 50.0, 0.0, 25.0]
    got = values(spark, [(30.0, 20.0, "right"), (30.0, 20.0, "left")], "x double, y double, a string",
        G.snap_frame(F.col("x"), F.col("y"), F.lit(35.0), F.lit(26.0), F.col("a")))
    assert [tuple(r[0]) for r in got] == [(-6.0, 5.0), (6.0, -5.0)]
    boxes = [F.array(*map(F.lit, b)) for b in ((0.0, 0.0, 10.0, 10.0), (5.0, 0.0, 15.0, 10.0), (20.0, 0.0, 30.0, 10.0))]
    sides = lambda b: [F.get(b, k) for k in range(4)]
    assert values(spark, [(1,)], "x int", G.overlap(sides(boxes[0]), sides(boxes[1])),
        G.overlap(sides(boxes[0]), sides(boxes[2])))[0] == pytest.approx((1 / 3, 0.0))
    line = G.box_line(F.lit(0), [F.lit(v) for v in (-5.0, 10.0, 50.0, 60.0)], 100, 200)
    assert values(spark, [(1,)], "x int", line,
        G.box_line(F.lit(0), [F.lit(v) for v in (0.0, 0.0, 0.5, 9.0)], 100, 200)) == [("0 0.250000 0.175000 0.500000 0.250000", None)]


PLAYS = [
    ("a", 1, 1, 1, 10, 15, "KC", "11", "SHOTGUN", 0.5, 20, 1), ("b", 2, 1, 3, 2, 40, "KC", "11", "SHOTGUN", -0.2, 3, 0),
    ("c", 3, 2, 2, 7, 20, "KC", "12", "PISTOL", 1.0, 25, 1),
    ("d", 4, 3, 1, 10, None, "DET", "12", "PISTOL", None, 0, 0), ("e", 5, 4, 4, 1, 3, "DET", None, "EMPTY", 0.1, 1, None),
    ("f", 6, 4, 3, 12, 80, "DET", "11", "SHOTGUN", 0.3, 16, 1)]


@pytest.fixture(scope="module")
def plays(spark):
    return spark.createDataFrame(PLAYS,
        "play_uid string, play_index int, qtr int, down int, ydstogo int, yardline_100 int, posteam string, off_grouping string, off_formation string, epa double, yards_gained int, shotgun int")


def test_query_plays(plays):
    count = lambda **f: play_query.query_plays(plays, count_only=True, **f)["count"]
    assert count(offense="kc", off_grouping="11") == 2 and count(off_formation="shotgun") == 3 and count(distance_min=7, distance_max=10) == 3
    assert count(red_zone=True) == 3 and count(red_zone=False) == 2 and count(offense="nonsense!") == 6 and count(sack=True) == 6 and count(
        shotgun=False) == 2 and count(quarter=4) == 2
    got = play_query.query_plays(plays, limit=2)
    assert (got["count"], got["returned"], [p["play_uid"] for p in got["plays"]]) == (6, 2, ["a", "b"])
    assert play_query.clamp(0, 25, 100) == 25 and play_query.clamp(500, 25, 100) == 100


def test_aggregate_plays(plays):
    got = play_query.aggregate_plays(plays, group_by=["off_grouping", "unknown"])
    assert got["group_by"] == ["off_grouping"] and [(g["off_grouping"], g["n"], g["epa_per_play"], g["success_rate"], g["explosive_rate"])
        for g in got["groups"]] == [("12", 2, 1.0, 0.5, 0.5), ("11", 3, 0.2, 0.667, 0.667), (None, 1, 0.1, 1.0, 0.0)]
    assert "error" in play_query.aggregate_plays(plays, group_by=["unknown"])
    assert len(play_query.aggregate_plays(plays, group_by=["off_grouping"], min_plays=2)["groups"]) == 2
    assert play_query.aggregate_plays(plays.drop("epa"), group_by=["posteam"])["sort_by"] == "yards_per_play"


def test_search_words(plays):
    rows = plays.withColumns(
        {"text": F.concat_ws(" ", "posteam", "off_formation"), "yrdln": F.lit("CHI 37"), "formation": F.col("off_formation"), "clock": F.lit("1:59")})
    found = lambda q: sorted(r.play_uid for r in rows.filter(film_room.search(q)).collect())
    assert found("3rd & long") == found("plays on 3 and long") == ["f"] and found("3rd & short") == ["b"] and found("4th & 1") == ["e"] and found(
        "red zone") == found("the redzone") == ["a", "c", "e"]
    assert found("det shotgun") == ["f"] and found("two minute") == found("2-minute drill") == ["c", "e",
        "f"] and len(found("")) == rows.count() and found("nowhere") == []
    assert rows.withColumn("clock", F.lit("2:00")).filter(film_room.search("two minute")).count() == 0
    assert play_query.number_set("1-3,7, 9-9") == [1, 2, 3, 7, 9]


def test_catalogue(spark):
    table = formations.formations(spark).collect()
    assert len(table) == 83 and all(len(r.slots) == 6 for r in table) and len({tuple(r.slots) for r in table}) == 83
    by_id = {r.formation_id: r for r in table}
    assert (by_id[11].qb_depth, by_id[11].backfield, by_id[11].personnel, by_id[11].strength) == ("shotgun", "shotgun_single", "11", "balanced")
    assert by_id[52].backfield == "special_teams" and by_id[52].personnel is None and by_id[53].lookalikes == ["Punt Formation", "Fake Punt"]
    again = formations.matched_formations(formations.formations(spark), "slots").select("formation_id", "exact").collect()
    assert all(r.exact for r in again)
    rows = spark.createDataFrame([(1, ["QBS", "RB", "TER", "WRL", "WSL"]), (2, []), (3, None)], "id int, slots array<string>")
    got = {r.id: r for r in formations.matched_formations(rows, "slots").collect()}
    assert (got[1].formation_id, got[1].exact, got[1].missing, got[1].extra) == (11, False, ["WRR"], []) or got[1].missing
    assert got[2].formation_id is None and got[3].formation_id is None


def test_slots(spark):
    players = [(1, k, float(x), float(d), p) for k,
        (x, d, p) in enumerate(
        [(0, 0.5, "C"), (-1.5, 0.6, "LG"), (0, 5, "QB"), (1.0, 6, "RB"), (4.5, 0.8, "TE"), (-20, 0.9, "WR"), (-10, 2, "WR"), (18, 1.0, "WR")])]
    players += [(2, k, float(x), float(d), None) for k,
        (x, d) in enumerate([(0, 0.3), (-1.5, 0.3), (0, 1.8), (0.2, 4.0), (0.3, 7.0), (4.5, 0.5), (-22, 0.5), (20, 0.5)])]
    got = {r.play: r for r in formations.classified_plays(
        spark.createDataFrame(players, "play int, player_id int, lateral double, depth double, position string"), ["play"]).collect()}
    assert got[1].slots == ["QBS", "RB", "TER", "WRL", "WRR", "WSL"] and got[1].formation_id == 11 and got[1].exact
    assert got[2].slots == ["FB", "QB", "RB", "TER", "WRL", "WRR"] and got[2].formation_id == 3


def test_records(spark):
    rows = [("2023_wk01_DET-KC_p001", 1, 1, 1, 10.0, 63.0, "DET", "pass", "(14:55) A pass", 12.0, 1.0, "1 RB, 2 TE, 2 WR", float("nan")),
        (None, None, 1, None, None, None, None, None, "Timeout", None, None, None, None)]
    plays = spark.createDataFrame(rows,
        "play_uid string, play_index int, qtr int, down int, ydstogo double, yardline_100 double, posteam string, play_type string, desc string, yards_gained double, first_down double, offense_personnel string, touchdown double")
    made = records.play_records(plays, {"game_key": "2023_wk01_DET-KC", "season": 2023, "week": 1, "away": "DET", "home": "KC"}, "now")
    r = records.checked(made).collect()[0]
    assert (r.situation.clock, r.situation.los_x, r.situation.first_down_x, r.official.description, r.official.first_down,
        r.official.touchdown) == ("14:55", 47.0, 57.0, "A pass", True, False)
    assert (r.personnel.offense.grouping, r.personnel.offense.wr, r.official.labels.source, r.film) == ("12", 2, "nflverse", None)
    with pytest.raises(Exception, match="official.play_type is dance"):
        records.checked(records.play_records(plays.withColumn("play_type", F.lit("dance")), {}, "now").withColumn("game",
            F.struct(F.lit(1)))).collect()
    lines = [r.value for r in tables.exported_lines(made, "play_uid").collect()]
    assert spark.read.json(spark.sparkContext.parallelize(lines)).count() == 1


def test_feed_payloads(spark):
    play = lambda i, kind, text, team=1: {"playId": float(i), "period": 1, "down": "1", "distance": "10", "yardLine": "Chi37",
        "startPossession": {"teamId": team}, "playType": {"playTypeId": kind}, "playText": text, "yards": 3,
                                          "playersInvolved": [{"playerInvolvedTypeId": 5,
                                          "player": {"playerId": 9, "firstName": "A", "lastName": "B", "uniform": "4"}},
                                          {"playerInvolvedTypeId": 2, "player": {"playerId": 8, "firstName": "", "lastName": "C", "uniform": "55"}}]}
    event = {"eventId": 7, "week": 2, "startDate": [{"full": "2023-09-17T17:00:00", "dateType": "UTC"}],
        "teams": [{"teamId": 326, "teamLocationType": {"name": "home"}}, {"teamId": 343, "teamLocationType": {"name": "away"}}],
             "pbp": [play(1, 5, "kicks off"), play(2, 10, "Penalty: False start"), play(3, 1, "pass", 343), play(4, 4, "rushes", 343)]}
    payload = {"apiResults": [
        {"league": {"season": {"season": 2023, "eventType": [{"eventTypeId": 1, "name": "Regular", "events": [event, event]}]}}}]}
    found = feeds.events(spark.createDataFrame([payload], feeds.ENVELOPE))
    assert found.count() == 1 and feeds.found_events(found, team_id=326, week=2).count() == 1 and feeds.found_events(found, week=3).count() == 0
    assert feeds.event_lines(found, feeds.static_teams(spark)).collect()[0].line == "7  week 2  LAR @ Chi  2023-09-17T17:00:00"
    rows = feeds.feed_plays(found).orderBy("play_id").collect()
    assert [(r.play_type, r.play_index) for r in rows] == [("kickoff", None), ("penalty", None), ("pass", 1), ("run", 2)]
    assert (rows[2].play_uid, rows[2].posteam, rows[2].defteam, rows[2].yardline_100, rows[2].down) == ("2023_wk02_LA-CHI_p001", "LA", "CHI", 37, 1)
    assert rows[2].players[0].asDict() == {"role": "target", "player_id": 9, "name": "A B", "uniform": "4"} and rows[2].players[1].name == "C"
    assert {r.team: r.numbers for r in feeds.uniforms(feeds.feed_plays(found).filter("play_id > 2")).collect()} == {"LA": ["4"], "CHI": ["55"]}


def test_league_payload(spark):
    play = lambda i, **k: {"playId": i, "quarter": 1, "driveSequence": 1, "down": 1, "yardsRemaining": 10, "yardLine": "CHI 37", "playType": "PASS",
        "playDescription": "(4:22) A pass for 5", "yardsGained": 5, **k}
    plays = [play(30, playDescription="B rush touchdown", playType="RUSH", playScored=True), play(10), play(20, playDeleted=True), play(None),
        play(15, playType="TIMEOUT", playDescription="Timeout #1", down=0)]
    plays[1]["stats"] = [{"statType": 15, "teamId": "h", "yards": 5, "gsisPlayerId": "g", "gsisPlayerName": "A", "gsisPlayerJerseyNumber": "04"},
        {"statType": 999, "teamId": "h"}]
    detail = {"id": "x", "homeTeam": {"id": "h", "currentLogo": "u/logos/CHI"}, "awayTeam": {"id": "a", "currentLogo": "u/logos/LAR"},
        "externalIds": [{"source": "slug", "id": "s"}], "driveChart": {"drives": [{"sequence": 1, "teamId": "h"}], "plays": plays}}
    details = spark.createDataFrame([detail], feeds.DETAIL)
    rows = feeds.league_plays(details, F.lit(2024), F.lit(3)).orderBy("nfl_play_id").collect()
    assert [(r.nfl_play_id, r.play_type, r.play_index, r.down) for r in rows] == [(10, "pass", 1, 1), (15, None, None, None), (30, "run", 2, 1)]
    assert (rows[0].play_uid, rows[0].time, rows[0].desc, rows[0].yardline_100, rows[0].posteam, rows[0].defteam,
        rows[2].touchdown) == ("2024_wk03_LA-CHI_p001", "4:22", "A pass for 5", 63, "CHI", "LA", True)
    assert [p.asDict() for p in rows[0].players] == [
        {"gsis_id": "g", "name": "A", "jersey": "4", "team": "CHI", "role": "passer", "stat_type": 15, "yards": 5}]
    assert feeds.slug_of(details).collect()[0].slug == "s"


def test_rosters_and_registries(spark):
    payload = spark.createDataFrame(
        [({"players": [{"gsisId": "1", "jerseyNumber": "07", "displayName": "Al Bo", "firstName": "Albert", "lastName": "Bo"},
        {"gsisId": "2", "jerseyNumber": "7", "displayName": "Cy Do", "firstName": "Cy", "lastName": "Do"}]},)],
        "roster struct<players:array<struct<gsisId:string,jerseyNumber:string,displayName:string,firstName:string,lastName:string>>>")
    players = feeds.roster(payload)
    assert players.collect()[0].name_forms == ["Al Bo", "Albert Bo", "A.Bo"]
    assert [(r.jersey, r.gsis_id) for r in feeds.jersey_players(players).collect()] == [("7", "2")]
    nested = spark.createDataFrame(
        [([{"divisions": [{"teams": [{"teamId": 1, "abbreviation": "A", "nickname": "As", "location": "X"},
        {"teamId": 1, "abbreviation": "B", "nickname": "Bs", "location": "Y"},
        {"teamId": 2, "abbreviation": "C", "nickname": None, "location": "Z"}]}]}],)],
        "conferences array<struct<divisions:array<struct<teams:array<struct<teamId:int,abbreviation:string,nickname:string,location:string>>>>>>")
    assert [(r.team_id, r.abbreviation) for r in feeds.team_registry(nested, "conferences.divisions.teams").collect()] == [(1, "A")]
    assert "roster.players[].gsisId: string" in N.schema_outline(payload.schema)


def test_environment():
    assert tables.read_environment("# x\nA=1\nexport B='two'\n\nnothing") == {"A": "1", "B": "two"}


def test_large_play_ids(spark, tmp_path):
    """Ids over 31 bits, and parts so high that they count for more than a line in an id that leaves them 200 million."""
    play = {"playId": 3_000_000_007, "quarter": 1, "driveSequence": 1, "down": 1, "playType": "PASS", "playDescription": "A pass"}
    detail = {"id": "x", "homeTeam": {"id": "h", "currentLogo": "u/logos/CHI"}, "awayTeam": {"id": "a", "currentLogo": "u/logos/LAR"},
        "driveChart": {"drives": [], "plays": [play]}}
    assert feeds.league_plays(spark.createDataFrame([detail], feeds.DETAIL), F.lit(2024), F.lit(3)).collect()[0].nfl_play_id == 3_000_000_007
    lines = [(1, p, 1, n, 1.0) for n in (1, 2, 3, 4, 5, 6, 7) for p in range(2_500_000 - 300_000 * n, 2_500_010 - 300_000 * n)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.QUERIES["q_league_plays"](spark, str(tmp_path)).collect()
    assert {r.play for r in got} == {n * 200_000_000 + p * 1000 + 1 for _, p, _, n, _ in lines if p % 13 and p % 17}
    places = {n * 200_000_000 + p * 1000 + 1: (n, p) for _, p, _, n, _ in lines}
    film = sorted((r for r in got if r.play_index), key=lambda r: r.play_index)
    assert len(film) > 9 and [places[r.play] for r in film] == sorted(places[r.play] for r in film)
