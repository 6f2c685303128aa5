"""Landed JSON documents made from the adapter views, with faults set by rules on ids.

Documents are bounded by construction: a scoreboard response covers ten consecutive ids, a team list
twenty, and a box score the lines of one game.  No group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchday.functions.domain import KEY, REQUIRED_CATEGORIES


def hits(column, divisor, remainder=0):
    return column % divisor == remainder


def spoiled(body, short, twice, numbers):
    """A cut body, one with a second document behind it, or one whose named text fields are numbers."""
    out = F.when(short, F.substring(body, 1, 20)).when(twice, F.concat(body, F.lit('{"x":1}')))
    for which, name in numbers:
        out = out.when(which, F.regexp_replace(body, f'"{name}":"(\\d+)"', f'"{name}":$1'))
    return out.otherwise(body)


def scoreboards(games: DataFrame) -> DataFrame:
    n = F.col("game_id").cast("bigint")
    bucket = F.floor(n / 10)
    final = F.col("status") == "final"
    name = F.when(hits(n, 103), "STATUS_WEIRD").when(final, "STATUS_FINAL").when(
        F.col("status") == "scheduled", "STATUS_SCHEDULED").otherwise("STATUS_POSTPONED")
    state = F.when(hits(n, 103), "pre").when(final, "post").otherwise("pre")
    day = F.date_format("starts_at", "yyyy-MM-dd")
    date = F.when(hits(n, 101), "not-a-date").when(hits(n, 3), F.concat(day, F.lit("T02:00:00+02:00"))).when(
        hits(n, 3, 1), F.concat(day, F.lit("T00:00Z"))).otherwise(F.concat(day, F.lit("T00:00:00.000Z")))

    def side(role, team, score):
        points = F.when(hits(n, 107) & (F.lit(role) == "home"), "bad").when(
            hits(n, 149) & (F.lit(role) == "away"), F.lit(None)).otherwise(F.coalesce(F.col(score).cast("string"), F.lit("0")))
        return F.struct(
            F.when(hits(n, 109), "home").otherwise(role).alias("homeAway"),
            F.struct(F.when(hits(n, 131), "").otherwise(team).alias("id")).alias("team"), points.alias("score"))
    away = F.when(hits(n, 113), F.col("home")).otherwise(F.col("away"))
    sides = F.array(side("home", F.col("home"), "home_score"), side("away", away, "away_score"))
    competition = F.struct(
        F.struct(F.when(hits(n, 15, 5), "ALLSTAR").otherwise("STD").alias("abbreviation")).alias("type"), date.alias("date"),
        F.struct(F.struct(name.alias("name"), state.alias("state"), final.alias("completed")).alias("type")).alias("status"),
        F.when(hits(n, 127), F.slice(sides, 1, 1)).otherwise(sides).alias("competitors"))
    event = F.struct(
        F.col("game_id").alias("id"),
        F.struct(F.col("season").alias("year"), F.when(hits(n, 12), 1).otherwise(F.col("season_type")).alias("type")).alias("season"),
        F.struct(F.when(hits(n, 139), 0).otherwise(F.col("week")).alias("number")).alias("week"),
        F.when(hits(n, 151), F.array(competition, competition)).otherwise(F.array(competition)).alias("competitions"))
    doubled = games.select("league", bucket.alias("bucket"), "starts_at",
                           F.explode(F.when(hits(n, 137), F.array(event, event)).otherwise(F.array(event))).alias("event"))
    b = F.col("bucket")
    grouped = doubled.groupBy("league", "bucket").agg(
        F.collect_list("event").alias("events"), F.to_date(F.min("starts_at")).alias("import_date"))
    body = F.to_json(F.struct(
        F.array(F.struct(F.when(hits(b, 13), "XFL").otherwise(F.col("league")).alias("abbreviation"))).alias("leagues"),
        F.when(~hits(b, 17), F.col("events")).alias("events")))
    return grouped.select(
        F.concat_ws("-", "league", b.cast("string")).alias("response_id"), "league", "import_date",
        (F.col("import_date").cast("timestamp_ntz") + F.make_dt_interval(hours=(b % 24).cast("int"))).alias("observed_at"),
        spoiled(body, hits(b, 11), hits(b, 19), ((hits(b, 23), "id"), (hits(b, 29), "score"))).alias("body"))


def boxscores(items: DataFrame, games: DataFrame) -> DataFrame:
    g, p = F.col("game_id").cast("bigint"), F.col("part")
    benched = (F.col("line") == 6) & (F.col("category") == "general")
    nameless = (F.col("did_not_play") & hits(p, 3)) | (benched & ~hits(p, 3, 1))
    stats = F.when(F.col("did_not_play"), F.array().cast("array<string>")).when(
        benched, F.array(F.lit("--"), F.lit("0"), F.lit("0-0"))).otherwise(F.array(
            F.lit("30"), F.col("quantity").cast("string"),
            F.concat_ws("-", F.col("line").cast("string"), (F.col("line") + F.col("quantity")).cast("string"))))
    athlete = F.struct(
        F.struct(F.when(nameless, "").otherwise(p.cast("string")).alias("id"),
                 F.when(hits(p, 143), " ").otherwise(F.concat_ws(" ", F.lit("Player"), p.cast("string"))).alias("displayName"),
                 F.lit("7").alias("jersey"), F.struct(F.lit("G").alias("abbreviation")).alias("position")).alias("athlete"),
        F.when(benched, "COACH'S DECISION").otherwise("").alias("reason"), F.col("did_not_play").alias("didNotPlay"),
        "starter", F.when(hits(p, 47) & ~F.col("did_not_play"), F.slice(stats, 1, 2)).otherwise(stats).alias("stats"))
    keys = F.array(F.lit("minutes"), F.when(hits(g, 41), "minutes").otherwise("points"), F.lit("fieldGoalsMade-fieldGoalsAttempted"))
    by_category = items.groupBy(*KEY, "game_id", "home", "away", "team_id", "category").agg(
        F.collect_list(athlete).alias("athletes"))
    category = F.struct(
        F.when((F.col("category") == "general") & (F.col("league") == "NBA"), "").otherwise(F.col("category")).alias("name"),
        keys.alias("keys"), "athletes")
    per_team = by_category.groupBy(*KEY, "game_id", "home", "away").agg(
        F.filter(F.collect_list(F.when(F.col("team_id") == F.col("home"), category)), lambda c: c.isNotNull()).alias("h"),
        F.filter(F.collect_list(F.when(F.col("team_id") == F.col("away"), category)), lambda c: c.isNotNull()).alias("a"))
    nothing = F.filter("h", lambda c: F.lit(False))
    wanted = F.array(*[F.lit(c) for c in REQUIRED_CATEGORIES["NFL"]])

    def full(side):
        have = F.transform(side, lambda c: c["name"])
        lacking = F.filter(F.array_except(wanted, have), lambda c: ~(hits(g, 29) & (c == "punting")))
        extra = F.transform(lacking, lambda c: F.struct(
            c.alias("name"), keys.alias("keys"), F.get(F.transform(F.concat(F.col("h"), F.col("a")), lambda x: F.filter(
                x["athletes"], lambda y: F.lit(False))), F.lit(0)).alias("athletes")))
        return F.when(F.col("league") == "NFL", F.concat(side, extra)).otherwise(F.concat(side, nothing))

    team = lambda identity, cats: F.struct(F.struct(identity.alias("id")).alias("team"), cats.alias("statistics"))
    home, away = team(F.col("home"), full(F.col("h"))), team(
        F.when(hits(g, 59), F.col("home")).otherwise(F.col("away")), full(F.col("a")))
    body = F.to_json(F.struct(
        F.struct(F.col("game_id").alias("id"), F.struct(F.col("league").alias("abbreviation")).alias("league"),
                 F.struct(F.when(hits(g, 31), F.col("season") + 1).otherwise(F.col("season")).alias("year"),
                          F.col("season_type").alias("type")).alias("season"),
                 F.array(F.struct(F.struct(F.struct((~hits(g, 37)).alias("completed"), F.lit("post").alias("state")).alias("type")).alias("status"))).alias("competitions")).alias("header"),
        F.struct(F.when(hits(g, 53), F.array(home)).otherwise(F.array(home, away)).alias("players")).alias("boxscore")))
    return per_team.select(
        F.concat_ws("-", "league", "game_id").alias("response_id"), "league", "game_id",
        F.to_timestamp_ntz(F.lit("2026-01-01 00:00:00")).alias("observed_at"),
        spoiled(body, F.lit(False), hits(g, 43), ((hits(g, 61), "id"),)).alias("body"))


def team_lists(customer: DataFrame) -> DataFrame:
    n = F.col("c_custkey")
    team = F.struct(
        F.when(hits(n, 103), (n - 1).cast("string")).otherwise(n.cast("string")).alias("id"),
        F.when(hits(n, 101), " ").otherwise(F.col("c_name")).alias("displayName"),
        F.substring("c_mktsegment", 1, 3).alias("abbreviation"))
    grouped = customer.groupBy(F.floor(n / 20).alias("bucket")).agg(
        *[F.filter(F.collect_list(F.when(hits(n, 2, r), F.struct(team.alias("team")))), lambda t: t.isNotNull()).alias(f"t{r}")
          for r in (0, 1)])
    entry = lambda name, teams: F.struct(F.lit(name).alias("abbreviation"), F.col(teams).alias("teams"))
    body = F.to_json(F.struct(F.array(F.struct(F.array(entry("NBA", "t0"), entry("NFL", "t1")).alias("leagues"))).alias("sports")))
    league = F.explode(F.array(F.lit("NBA"), F.lit("NFL"))).alias("league")
    return grouped.select("bucket", body.alias("body"), league).select(
        F.concat_ws("-", "league", F.col("bucket").cast("string")).alias("response_id"), "league",
        spoiled(F.col("body"), F.lit(False), F.lit(False), ((hits(F.col("bucket"), 7, 3), "id"),)).alias("body"))
