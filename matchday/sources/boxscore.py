"""Raw box scores: one row per response, held against the stored game that it claims to describe.

Bodies are parsed and judged where they are read.  What meets the stored games is flat: either one narrow row per response
(its claims and the rules it breaks by itself) or its lines, each with the claims; no document is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchday.functions import expr
from matchday.functions.domain import DEFAULT_CATEGORY, REQUIRED_CATEGORIES, ZERO_PLACEHOLDERS
from matchday.sources.scoreboard import empty, with_document

SCHEMA = """
header struct<id: string, league: struct<abbreviation: string>, season: struct<year: int, type: int>,
  competitions: array<struct<status: struct<type: struct<completed: boolean, state: string>>>>>,
boxscore struct<players: array<struct<
  team: struct<id: string>,
  statistics: array<struct<name: string, keys: array<string>, athletes: array<struct<
    athlete: struct<id: string, displayName: string, jersey: string, position: struct<abbreviation: string>>,
    reason: string, didNotPlay: boolean, starter: boolean, stats: array<string>>>>>>>>
"""
GAME = ["league", "game_id"]


def placeholder(league: Column, athlete: Column, keys: Column) -> Column:
    """A benched NBA player without identity: no minutes and nothing but zeros."""
    stats = F.coalesce(athlete["stats"], F.array())
    pairs = F.arrays_zip(keys.alias("k"), stats.alias("v"))
    fine = lambda p: F.when(p["k"] == "minutes", p["v"] == "--").otherwise(p["v"].isin(*ZERO_PLACEHOLDERS))
    return (
        (league == "NBA") & (F.coalesce(athlete["starter"], F.lit(True)) == F.lit(False))
        & (F.coalesce(athlete["reason"], F.lit("")) == "COACH'S DECISION") & (F.size(keys) == F.size(stats))
        & F.array_contains(keys, "minutes") & F.coalesce(F.forall(pairs, fine), F.lit(False)))


def _line(league: Column, team: Column, category: Column, keys: Column):
    def line(a: Column) -> Column:
        stats = F.coalesce(a["stats"], F.array())
        dnp = F.coalesce(a["didNotPlay"], F.lit(False))
        player = F.coalesce(a["athlete"]["id"], F.lit(""))
        statless = dnp & (F.size(stats) == 0)
        excluded = (player == "") & (statless | placeholder(league, a, keys))
        reason = (
            F.when(excluded, F.lit(None))
            .when((player == "") | expr.blank(a["athlete"]["displayName"]), "missing_identity")
            .when((F.size(stats) != F.size(keys)) & ~statless, "alignment"))
        return F.struct(
            team.alias("team_id"), category.alias("category"), player.alias("player_id"),
            a["athlete"]["displayName"].alias("name"),
            F.coalesce(a["athlete"]["position"]["abbreviation"], F.lit("")).alias("position"),
            F.coalesce(a["athlete"]["jersey"], F.lit("")).alias("jersey"), dnp.alias("did_not_play"),
            a["starter"].alias("starter"), keys.alias("keys"), stats.alias("stats"),
            excluded.alias("excluded"), reason.alias("reason"))
    return line


CLAIMS = ["says_season", "says_type", "team_ids", "early", "late", "rules"]


def claimed(raw: DataFrame) -> DataFrame:
    """Responses with flat lines, what they claim, and the rules that they break by themselves.

    Rules are ordered: ``early`` comes before what the stored game decides, ``late`` and ``rules`` after it.
    """
    league = F.col("league")
    default = F.lit("")
    for name, category in DEFAULT_CATEGORY.items():
        default = F.when(league == name, category).otherwise(default)
    docs = with_document(raw, SCHEMA)

    def categories(team):
        return F.transform(F.coalesce(team["statistics"], F.array()), lambda c: F.struct(
            F.when(empty(c["name"]), default).otherwise(c["name"]).alias("name"),
            F.coalesce(c["keys"], F.array()).alias("keys"), F.coalesce(c["athletes"], F.array()).alias("athletes")))
    teams = F.transform(F.coalesce("doc.boxscore.players", F.array()), lambda t: F.struct(
        F.coalesce(t["team"]["id"], F.lit("")).alias("id"), categories(t).alias("cats")))
    lines = F.flatten(F.transform("teams", lambda t: F.flatten(F.transform(
        t["cats"], lambda c: F.transform(c["athletes"], _line(league, t["id"], c["name"], c["keys"]))))))

    h = F.col("doc.header")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    named = (h["id"] == F.col("game_id")) & (h["league"]["abbreviation"] == league)
    only = F.get(h["competitions"], F.lit(0))["status"]["type"]
    final = (F.size(h["competitions"]) == 1) & only["completed"] & (only["state"] == "post")
    ids = F.col("teams.id")
    bad_keys = lambda c: F.exists(c["keys"], expr.blank) | (F.size(F.array_distinct(c["keys"])) < F.size(c["keys"]))
    no_category = lambda c: (c["name"] == "") | (F.size(c["keys"]) == 0)
    names = lambda t: F.transform(t["cats"], lambda c: c["name"])
    repeated = lambda t: F.size(F.array_distinct(names(t))) < F.size(t["cats"])
    lacking = F.lit(False)
    for name, required in REQUIRED_CATEGORIES.items():
        wanted = F.array(*[F.lit(r) for r in required])
        lacking = lacking | ((league == name) & F.exists("teams", lambda t: F.size(F.array_except(wanted, names(t))) > 0))
    kept = F.filter("lines", lambda x: ~x["excluded"])
    identity = F.transform("kept", lambda x: F.concat_ws("/", x["player_id"], x["category"]))
    distinct = lambda f: F.size(F.array_distinct(F.transform("kept", f)))
    both = distinct(lambda x: F.concat_ws("/", x["player_id"], x["team_id"])) > distinct(lambda x: x["player_id"])
    idle = F.exists("teams", lambda t: ~F.exists("kept", lambda x: (
        (x["team_id"] == t["id"]) & ~x["did_not_play"] & (F.size(x["stats"]) > 0))))
    early = F.when(F.col("doc").isNull(), "bad_json").when(no(named), "identity_mismatch")
    late = F.when(no(final), "not_final").when(F.size("teams") != 2, "team_count").when(
        F.size(F.array_distinct(ids)) < F.size(ids), "unexpected_team")
    rules = F.array_compact(F.array(
        F.when(F.exists("teams", lambda t: F.exists(t["cats"], no_category) | repeated(t)), "category"),
        F.when(F.exists("teams", lambda t: F.exists(t["cats"], bad_keys)), "statistic_key"),
        F.when(F.size(F.array_distinct(identity)) < F.size("kept"), "duplicate_player"),
        F.when(both, "player_both_teams"), F.when(lacking, "missing_category"), F.when(idle, "no_played_rows")))
    line_reasons = F.array_distinct(F.filter(F.col("lines.reason"), lambda r: r.isNotNull()))
    return (
        docs.withColumn("teams", teams).withColumn("lines", lines).withColumn("kept", kept)
        .select("response_id", *GAME, "observed_at", h["season"]["year"].alias("says_season"), h["season"]["type"].alias("says_type"),
                F.slice(ids, 1, 3).alias("team_ids"), early.alias("early"), late.alias("late"), F.concat(rules, line_reasons).alias("rules"),
                "lines")
    )


def against_games(rows: DataFrame, games: DataFrame) -> DataFrame:
    """Adds the stored season and the reasons that reject a response (empty = accepted) to rows with its claims."""
    stored = games.select(*GAME, "season", "season_type", "home", "away")
    same = F.coalesce((F.col("says_season") == F.col("season")) & (F.col("says_type") == F.col("season_type")), F.lit(False))
    strange = F.exists("team_ids", lambda t: ~t.isin(F.col("home"), F.col("away")))
    whole = F.coalesce("early", F.when(~same, "identity_mismatch"), "late", F.when(strange, "unexpected_team"))
    reasons = F.when(whole.isNotNull(), F.array(whole)).otherwise(F.col("rules"))
    return rows.join(stored, GAME, "left").withColumn("reasons", reasons).drop("home", "away", *CLAIMS)


def sound(items: Column) -> Column:
    """An array of responses that break no rule by themselves, null for others."""
    return F.when(F.col("early").isNull() & F.col("late").isNull() & (F.size("rules") == 0), items)


def boxscore_decode(raw: DataFrame | None, games: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """One row per (game, team, category, athlete) of the accepted responses.  ``claims`` may give `claimed(raw)` as written."""
    flat = (claimed(raw) if claims is None else claims).select("response_id", *GAME, "observed_at", *CLAIMS, F.inline_outer(sound(F.col("lines")))).where(
        "category is not null and not excluded")
    rows = against_games(flat, games).where(F.size("reasons") == 0)
    stats = F.when(F.size("stats") > 0, F.to_json(F.map_from_arrays("keys", "stats"))).otherwise("{}")
    return rows.select("response_id", *GAME, "season", "season_type", "team_id", "player_id", "name", "category",
                       "position", "jersey", "did_not_play", "starter", stats.alias("stats_json"), "observed_at")


def boxscore_rejects(raw: DataFrame, games: DataFrame) -> DataFrame:
    narrow = claimed(raw).drop("lines", "observed_at")
    return against_games(narrow, games).select("response_id", *GAME, F.explode_outer("reasons").alias("reason")).where("reason is not null")


def placeholder_dnp(raw: DataFrame | None, games: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Excluded entries without identity, per accepted response.  ``claims`` as above."""
    n = F.size(F.filter("lines", lambda x: x["excluded"]))
    # an outer generator: a filter on a plain column would go below the parse and repeat it
    claims = claimed(raw) if claims is None else claims
    narrow = claims.select("response_id", *GAME, *CLAIMS, F.explode_outer(sound(F.array(n))).alias("excluded"))
    return against_games(narrow, games).where((F.size("reasons") == 0) & (F.col("excluded") > 0)).select("response_id", *GAME, "excluded")
