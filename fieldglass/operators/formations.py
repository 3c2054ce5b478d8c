"""Named formations: slots of tracked players, and the catalogue entry that they fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ON_LINE, BACKFIELD, SHOTGUN, TACKLE_BOX, INLINE, OFFSET, SPLIT_GAP = 1.5, 3.0, 4.0, 4.0, 7.0, 1.5, 1.5

# The catalogue (id, name, six skill slots). An L or R ends each slot of one side.
CATALOGUE = (
    (1, "2 RB side-by-side, 1 TE, 2 WR", "QB RBL RBR TER WRL WRR"),
    (2, "1 RB, 2 TE, 2 WR", "QB RB TEL TER WRL WRR"),
    (3, "2 RB I-Formation", "QB FB RB TER WRL WRR"),
    (4, "2 RB Offset I", "QB FBR RB TER WRL WRR"),
    (5, "Both WR left (Normal)", "QB RBL RBR TER WRL WSL"),
    (6, "Both WR right (Normal)", "QB RBL RBR TEL WRR WSR"),
    (7, "Both WR left (I-Formation)", "QB FB RB TER WRL WSL"),
    (8, "Both WR right (I-Formation)", "QB FB RB TEL WRR WSR"),
    (9, "Both WR left (Offset I)", "QB FBR RB TER WRL WSL"),
    (10, "Both WR right (Offset I)", "QB FBR RB TEL WRR WSR"),
    (11, "3 WR (2 left), 1 RB", "QBS RB TER WRL WSL WRR"),
    (12, "3 WR (2 right), 1 RB", "QBS RB TEL WRL WRR WSR"),
    (13, "3 WR (all left), 1 RB", "QBS RB TER WRL WSL WS2L"),
    (14, "3 WR (all right), 1 RB", "QBS RB TEL WRR WSR WS2R"),
    (15, "2 TE, 3 WR (left)", "QBS TEL TER WRL WSL WS2L"),
    (16, "2 TE, 3 WR (right)", "QBS TEL TER WRR WSR WS2R"),
    (17, "3 WR (2 left), 2 RB", "QB RBL RBR WRL WSL WRR"),
    (18, "3 WR (2 right), 2 RB", "QB RBL RBR WRL WRR WSR"),
    (19, "3 WR (2 left), 2 RB (I)", "QB FB RB WRL WSL WRR"),
    (20, "3 WR (2 right), 2 RB (I)", "QB FB RB WRL WRR WSR"),
    (21, "3 WR (2 left), 2 RB (Offset I)", "QB FBR RB WRL WSL WRR"),
    (22, "3 WR (2 right), 2 RB (Offset I)", "QB FBL RB WRL WRR WSR"),
    (25, "3 WR (all left), 2 RB", "QB RBL RBR WRL WSL WS2L"),
    (26, "3 WR (all right), 2 RB", "QB RBL RBR WRR WSR WS2R"),
    (27, "3 WR (all left), 2 RB (I)", "QB FB RB WRL WSL WS2L"),
    (28, "3 WR (all right), 2 RB (I)", "QB FB RB WRR WSR WS2R"),
    (29, "3 WR (all left), 2 RB (Offset I)", "QB FBR RB WRL WSL WS2L"),
    (30, "3 WR (all right), 2 RB (Offset I)", "QB FBL RB WRR WSR WS2R"),
    (31, "2 TE, 1 WR (left), 2 RB", "QB RBL RBR TEL TER WRL"),
    (32, "2 TE, 1 WR (right), 2 RB", "QB RBL RBR TEL TER WRR"),
    (33, "2 TE, 1 WR (left), 2 RB (I)", "QB FB RB TEL TER WRL"),
    (34, "2 TE, 1 WR (right), 2 RB (I)", "QB FB RB TEL TER WRR"),
    (35, "2 TE, 1 WR (left), 2 RB (Offset I)", "QB FBR RB TEL TER WRL"),
    (36, "2 TE, 1 WR (right), 2 RB (Offset I)", "QB FBL RB TEL TER WRR"),
    (37, "3 TE, 1 WR (left), 1 RB", "QB RB TEL TER TE2R WRL"),
    (38, "3 TE, 1 WR (right), 1 RB", "QB RB TEL TER TE2L WRR"),
    (39, "3 TE, 2 WR", "QBS TEL TER TE2R WRL WRR"),
    (40, "4 WR (3 left), 1 RB", "QBS RB WRL WSL WS2L WRR"),
    (41, "4 WR (3 right), 1 RB", "QBS RB WRL WRR WSR WS2R"),
    (42, "4 WR (all left), 1 RB", "QBS RB WRL WSL WS2L WS3L"),
    (43, "4 WR (all right), 1 RB", "QBS RB WRR WSR WS2R WS3R"),
    (44, "1 TE, 4 WR (left)", "QBS TER WRL WSL WS2L WS3L"),
    (45, "1 TE, 4 WR (right)", "QBS TEL WRR WSR WS2R WS3R"),
    (46, "5 WR (3 left)", "QBS WRL WSL WS2L WRR WSR"),
    (47, "5 WR (3 right)", "QBS WRL WSL WRR WSR WS2R"),
    (48, "Goal Line (Normal)", "QB RBL RBR TEL TER TE2R"),
    (49, "Goal Line (I)", "QB FB RB TEL TER TE2R"),
    (50, "Goal Line (Offset I)", "QB FBR RB TEL TER TE2R"),
    (51, "Victory Formation", "QB RB RBL RBR TEL TER"),
    (52, "Field Goal", "H K TEL TER TE2L TE2R"),
    (53, "Punt Formation", "P PP WGL WGR WRL WRR"),
    (56, "2 TE, 3 WR (2 left)", "QBS TEL TER WRL WSL WRR"),
    (57, "2 TE, 3 WR (2 right)", "QBS TEL TER WRL WRR WSR"),
    (58, "3 RB, 1 TE, 1 WR (left)", "QB FB RBL RBR TER WRL"),
    (59, "3 RB, 1 TE, 1 WR (right)", "QB FB RBL RBR TEL WRR"),
    (60, "3 RB, 2 TE (Goal Line)", "QB FB RBL RBR TEL TER"),
    (61, "3 RB, 2 WR", "QB FB RBL RBR WRL WRR"),
    (62, "1 TE, 4 WR (2 each side)", "QBS TER WRL WSL WRR WSR"),
    (63, "1 TE, 4 WR (3 left)", "QBS TER WRL WSL WS2L WRR"),
    (64, "1 TE, 4 WR (3 right)", "QBS TEL WRL WRR WSR WS2R"),
    (65, "Goal Line, 4 TE, 1 RB", "QB RB TEL TER TE2L TE2R"),
    (66, "5 WR (4 left)", "QBS WRL WSL WS2L WS3L WRR"),
    (67, "5 WR (4 right)", "QBS WRL WRR WSR WS2R WS3R"),
    (68, "Offset I (Weak)", "QB FBL RB TER WRL WRR"),
    (70, "Both WR left (Offset I - Weak)", "QB FBL RB TER WRL WSL"),
    (72, "Both WR right (Offset I - Weak)", "QB FBL RB TEL WRR WSR"),
    (74, "3 WR (2 left), 2 RB (Offset I - Weak)", "QB FBL RB WRL WSL WRR"),
    (77, "3 WR (2 right), 2 RB (Offset I - Strong)", "QB FBR RB WRL WRR WSR"),
    (78, "3 WR (all left), 2 RB (Offset I - Weak)", "QB FBL RB WRL WSL WS2L"),
    (81, "3 WR (all right), 2 RB (Offset I - Strong)", "QB FBR RB WRR WSR WS2R"),
    (82, "2 TE, 1 WR (left), 2 RB (Offset I - Weak)", "QB FBL RB TEL TER WRL"),
    (85, "2 TE, 1 WR (right), 2 RB (Offset I - Strong)", "QB FBR RB TEL TER WRR"),
    (86, "Goal Line Offset I (Weak)", "QB FBL RB TEL TER TE2R"),
    (88, "3 RB, 2 WR (left)", "QB FB RBL RBR WRL WSL"),
    (89, "3 RB, 2 WR (right)", "QB FB RBL RBR WRR WSR"),
    (91, "Polecat", "QBS RBL RBR WRL WRR WSL"),
    (92, "Goal Line, 5 TE", "QB TEL TER TE2L TE2R TE3R"),
    (93, "Goal Line, 4 TE + 1 WR (right)", "QB TEL TER TE2L TE2R WRR"),
    (94, "Goal Line, 4 TE + 1 WR (left)", "QB TEL TER TE2L TE2R WRL"),
    (95, "5 WR (all left)", "QBS WRL WSL WS2L WS3L WS4L"),
    (96, "5 WR (all right)", "QBS WRR WSR WS2R WS3R WS4R"),
    (97, "3 TE, 2 WR (right)", "QBS TEL TER TE2R WRR WSR"),
    (98, "3 TE, 2 WR (left)", "QBS TEL TER TE2L WRL WSL"),
)
ALIASES = {69: 4, 71: 9, 73: 10, 75: 21, 76: 22, 79: 29, 80: 30, 83: 35, 84: 36, 87: 50, 90: 61, 54: 53, 55: 52}
LOOKALIKES = {52: ("Field Goal", "Fake Field Goal"), 53: ("Punt Formation", "Fake Punt")}
#: A caller's catalogue becomes a constant of the plan, so its size is checked.
MOST_FORMATIONS = 1000
LINEMEN, BACKS = ("C", "G", "T", "LG", "RG", "LT", "RT", "OL"), ("RB", "FB", "HB")
RECEIVER_SLOTS, END_SLOTS = ("WR", "WS", "WS2", "WS3", "WS4"), ("TE", "TE2", "TE3")


def catalogue() -> list[tuple[int, str, list[str]]]:
    return [(number, name, sorted(slots.split())) for number, name, slots in CATALOGUE]


def formations(spark: SparkSession) -> DataFrame:
    """formation_id, name, slots (sorted), qb_depth, backfield, personnel, strength, lookalikes."""
    rows = spark.createDataFrame(catalogue(), "formation_id int, name string, slots array<string>")
    has = lambda *s: F.arrays_overlap("slots", F.array(*map(F.lit, s)))
    count = lambda c: F.size(F.filter("slots", c))
    plain_backs = count(lambda s: s.isin("RB", "RBL", "RBR"))
    backfield = (
        F.when(has("K", "P"), "special_teams").when(has("FB"), "i_form").when(has("FBL"), "offset_i_left").when(has("FBR"), "offset_i_right")
        .when(plain_backs >= 2, "split_backs").when((plain_backs == 1) & has("QBS"), "shotgun_single").when(plain_backs == 1,
        "single_back").otherwise("empty")
    )
    side = lambda x: count(lambda s: F.endswith(s, F.lit(x)) & F.substring(s, 1, 1).isin("T", "W"))
    grouping = F.concat(count(lambda s: s.isin("RB", "RBL", "RBR", "FB", "FBL", "FBR")).cast("string"),
        count(lambda s: F.startswith(s, F.lit("TE"))).cast("string"))
    lookalikes = F.coalesce(*(F.when(F.col("formation_id") == k, F.array(*map(F.lit, v))) for k, v in LOOKALIKES.items()),
        F.array().cast("array<string>"))
    return rows.withColumns({
        "qb_depth": F.when(has("QBS"), "shotgun").when(has("QB"), "under_center"), "backfield": backfield,
        "personnel": F.when(backfield != "special_teams", grouping),
        "strength": F.when(side("L") > side("R"), "left").when(side("R") > side("L"), "right").otherwise("balanced"), "lookalikes": lookalikes,
    })


def canonical_id(formation_id: Column) -> Column:
    return F.coalesce(*(F.when(formation_id == k, F.lit(v)) for k, v in ALIASES.items()), formation_id)


def matched_formations(df: DataFrame, slots: str, table: DataFrame | None = None) -> DataFrame:
    """df with formation_id, exact, missing and extra: the entry with just these slots, else the one that differs in fewest,
    the least id of those. The catalogue, 83 rows or the caller's of up to MOST_FORMATIONS, is folded into one constant; no
    slots at all match nothing."""
    entries = [(i, s) for i, _, s in catalogue()]
    if table is not None:
        entries = [(r["formation_id"], r["slots"]) for r in table.select("formation_id", "slots").limit(MOST_FORMATIONS + 1).collect()]
    if len(entries) > MOST_FORMATIONS:
        raise ValueError(f"over {MOST_FORMATIONS} formations: this is no catalogue")
    constant = F.array(*(F.struct(F.lit(i).alias("id"), F.array(*map(F.lit, s)).alias("slots")) for i, s in entries))
    own = F.array_distinct(F.coalesce(F.col(slots), F.array().cast("array<string>")))
    scored = F.transform(constant,
        lambda e: F.struct((F.size(F.array_except(e["slots"], "_own")) + F.size(F.array_except("_own", e["slots"]))).alias("d"), e["id"].alias("id"),
        e["slots"].alias("slots")))
    best = F.when(F.size("_own") > 0, F.array_min(scored))
    return df.withColumn("_own", own).withColumn("_b", best).withColumns({
        "formation_id": F.col("_b.id"), "exact": F.coalesce(F.col("_b.d") == 0, F.lit(False)),
        "missing": F.array_sort(F.array_except(F.coalesce("_b.slots", F.array().cast("array<string>")), "_own")),
        "extra": F.array_sort(F.when(F.col("_b").isNotNull(), F.array_except("_own", F.col("_b.slots"))).otherwise(F.array().cast("array<string>"))),
    }).drop("_own", "_b")


def slots_of_players(players: DataFrame, play: list[str], order: str = "player_id") -> DataFrame:
    """players (lateral, depth, position or NULL) of each play -> their slots; linemen and players beyond the named slots have none.

    The quarterback is the one so named, or else the shallowest behind the line near the ball. Receivers on a side are numbered
    from outside in, attached ends from inside out, backs by depth.
    """
    p, x, d = F.upper("position"), F.col("lateral"), F.col("depth")
    known, on_line = F.col("position").isNotNull(), d <= ON_LINE
    w = Window.partitionBy(*play)
    any_qb = F.max((F.coalesce(p == "QB", F.lit(False))).cast("int")).over(w) == 1
    candidate = (F.abs(x) < OFFSET) & ~on_line
    marked = players.withColumn("_any", any_qb).withColumn("_cand", F.when(F.col("_any"), F.coalesce(p == "QB", F.lit(False))).otherwise(candidate))
    first = F.row_number().over(Window.partitionBy(*play, "_cand").orderBy(F.when(F.col("_any"), F.lit(0.0)).otherwise(d), order)) == 1
    qb = F.col("_cand") & first
    lineman = F.when(known, p.isin(*LINEMEN)).otherwise(on_line & (F.abs(x) <= TACKLE_BOX))
    back = F.when(known, p.isin(*BACKS)).otherwise(d >= BACKFIELD)
    role = F.when(F.col("_qb"), "qb").when(F.col("_any") & F.coalesce(p == "QB", F.lit(False)), "none").when(lineman, "none").when(back,
        "back").when(on_line & (F.abs(x) <= INLINE), "end").otherwise("receiver")
    roles = marked.withColumn("_qb", qb).withColumn("_role", role).withColumn("_side", F.when(x < 0, "L").otherwise("R"))
    mine = Window.partitionBy(*play, "_role")
    ranked = roles.withColumns({
        "_depth": F.row_number().over(mine.orderBy(d, order)), "_n": F.count("*").over(mine),
        "_gap": F.max(d).over(mine) - F.min(d).over(mine),
        "_out": F.row_number().over(
        Window.partitionBy(*play, "_role", "_side").orderBy(F.when(F.col("_role") == "receiver", -F.abs(x)).otherwise(F.abs(x)), order)),
    })
    pair = Window.partitionBy(*play, "_role", "_behind")
    ranked = ranked.withColumn("_behind", F.when(F.col("_n") >= 3, F.col("_depth") > 1).otherwise(F.lit(True)))
    ranked = ranked.withColumn("_left", F.row_number().over(pair.orderBy(x, order)))
    split = F.when(F.col("_left") == 1, "RBL").when(F.col("_left") == 2, "RBR")
    stacked = F.when(F.col("_depth") == 2, "RB").when(F.abs(x) < OFFSET, "FB").otherwise(F.when(x < 0, "FBL").otherwise("FBR"))
    backs = F.when(F.col("_n") == 1, "RB").when((F.col("_n") == 2) & (F.col("_gap") <= SPLIT_GAP), split).when(F.col("_n") == 2,
        stacked).when(F.col("_depth") == 1, "FB").otherwise(split)
    named = lambda names: F.concat(F.get(F.array(*map(F.lit, names)), F.col("_out") - 1), F.col("_side"))
    slot = F.when(F.col("_role") == "qb", F.when(d >= SHOTGUN, "QBS").otherwise("QB")).when(F.col("_role") == "back",
        backs).when(F.col("_role") == "end", named(END_SLOTS)).when(F.col("_role") == "receiver", named(RECEIVER_SLOTS))
    return ranked.withColumn("slot", slot).drop(*(c for c in ranked.columns if c.startswith("_")))


def classified_plays(players: DataFrame, play: list[str], order: str = "player_id") -> DataFrame:
    """Each play's slots and the formation that they fit."""
    slots = slots_of_players(players, play, order).groupBy(*play).agg(F.array_sort(F.collect_set("slot")).alias("slots"))
    return matched_formations(slots, "slots")
