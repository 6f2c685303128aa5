"""Validation of exported text rows, as findings (report key, rule, detail).

Inputs keep every field as text, exactly as read from the files; ``report_league``, ``report_season``
and ``report_season_type`` say which export a row came from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchday.functions import expr
from matchday.functions.domain import KEY, LEAGUES, SEASON_RANGE, SEASON_TYPES

REPORT = ["report_league", "report_season", "report_season_type"]
GAME = [*REPORT, "game_id"]
ZONED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})\z"
DIGITS = r"^\d+\z"
RULES = ("V1", "V2", "V3", "V4", "V5", "V6", "V7", "V8", "V9", "V10", "V11")


def row_rules(df: DataFrame, rules: dict[str, object], detail, only: str | None = None) -> DataFrame:
    """Findings of every rule, or of ``only`` one: columns that no asked rule reads, and joins for them, are not planned."""
    if only is not None:
        return df.where(F.coalesce(rules[only], F.lit(False))).select(*REPORT, F.lit(only).alias("rule"), detail.alias("detail"))
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return df.select(*REPORT, F.explode_outer(found).alias("rule"), detail.alias("detail")).where("rule is not null")


def report_rules(reports: DataFrame) -> DataFrame:
    """V1: schema, readiness and scope."""
    low, high = SEASON_RANGE
    good = (
        F.col("schema_version").isin(3, 4) & F.col("ready_for_export") & (F.col("issues") == 0)
        & (F.col("missing_import_dates") == 0) & F.col("league").isin(*[l[1] for l in LEAGUES])
        & F.col("season_type").isin(*SEASON_TYPES) & F.col("season").between(low, high))
    named = reports.select("*", *[F.col(k).alias(r) for k, r in zip(KEY, REPORT)])
    return row_rules(named, {"V1": ~F.coalesce(good, F.lit(False))}, F.lit("report"))


def game_rules(games: DataFrame, reports: DataFrame) -> DataFrame:
    """V2-V5 on single rows.  A file without a week column is looked up by its report's version:
    optional in version 3, a fault in version 4.  An empty week is fine in both."""
    rows, unversioned = games, F.lit(False)
    if "week" not in games.columns or "week_present" in games.columns:
        versions = reports.select(*[F.col(k).alias(r) for k, r in zip(KEY, REPORT)], "schema_version")
        rows = games.join(versions, REPORT, "left")
        if "week" not in games.columns:
            rows = rows.withColumns({"week": F.lit(None).cast("string"), "week_present": F.lit(False)})
        unversioned = F.coalesce((F.col("schema_version") == 4) & ~F.col("week_present"), F.lit(False))
    mixed = (
        (F.col("league") != F.col("report_league")) | (F.col("season") != F.col("report_season").cast("string"))
        | (F.col("season_type") != F.col("report_season_type").cast("string"))
        | (F.col("player_import_complete") != "true"))
    week = F.coalesce("week", F.lit(""))
    time = (
        ~F.col("starts_at_utc").rlike(ZONED) | F.regexp_replace("starts_at_utc", r"^(.{16})([Z+-])", "$1:00$2").try_cast("timestamp").isNull() | ~F.coalesce("home_score", F.lit("")).rlike(DIGITS)
        | ~F.coalesce("away_score", F.lit("")).rlike(DIGITS)
        | unversioned
        | ((week != "") & ~(week.rlike(DIGITS) & ~week.rlike(r"^0+\z"))))
    home, away = F.coalesce("home_team_id", F.lit("")), F.coalesce("away_team_id", F.lit(""))
    identity = (F.coalesce("game_id", F.lit("")) == "") | (home == "") | (away == "") | (home == away)
    tied = (F.col("report_league") == "NBA") & (
        F.col("home_score").try_cast("decimal(38,0)") == F.col("away_score").try_cast("decimal(38,0)"))
    return row_rules(rows, {"V2": mixed, "V3": time, "V4": identity, "V5": tied}, F.coalesce("game_id", F.lit("")))


def key_rules(reports: DataFrame, games: DataFrame, players: DataFrame, only: str | None = None) -> DataFrame:
    """V4 and V8 duplicates, V6 counts and V11 teams, from one aggregation over keys; for ``only`` V4 or V8 at its own level.

    Reports, games and players become narrow rows of one set; grouping sets count them per player row key, per game and
    per report, with map-side combining, so each table is read once whatever the number of rules.
    """
    zero, none = F.lit(0), F.lit(None).cast("string")
    expected = ["final_games", "complete_player_games", "player_category_rows"]

    def rows(df, report=0, game=0, player=0):
        named = lambda c, on: (F.col(c) if on else none).alias(c)
        return df.select(
            *REPORT, named("game_id", game or player), *[named(c, player) for c in ("player_id", "category", "team_id")],
            F.lit(report).alias("report"), F.lit(game).alias("game"), F.lit(player).alias("player"),
            *[(F.col(c).cast("long") if report else F.lit(None).cast("long")).alias(c) for c in expected])

    headers = reports.select(*[F.col(k).alias(r) for k, r in zip(KEY, REPORT)], *expected)
    line, game, scope = [*GAME, "player_id", "category"], GAME, REPORT
    text = F.concat_ws("/", "game_id", "player_id", "category")
    if only in ("V4", "V8"):  # duplicates need the rows of one table at one level
        table, keys, detail = (games, game, F.coalesce("game_id", F.lit(""))) if only == "V4" else (players, line, text)
        return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(
            *REPORT, F.lit(only).alias("rule"), F.concat(F.lit("duplicate "), detail).alias("detail"))
    everything = rows(headers, report=1).unionByName(rows(games, game=1)).unionByName(rows(players, player=1))
    counted = everything.groupingSets([line, game, scope], *line).agg(
        F.grouping_id().alias("level"), F.sum("report").alias("reports"), F.sum("game").alias("games"),
        F.sum("player").alias("players"), F.min("team_id").alias("low"), F.max("team_id").alias("high"),
        *[f(c).alias(f"{n}_{c}") for c in expected for n, f in (("min", F.min), ("max", F.max))])
    is_line, is_game, is_scope = F.col("level") == 0, F.col("level") == 3, F.col("level") == 7
    stored = dict(zip(expected, ("games", "games", "players")))
    differs = reduce(lambda x, y: x | y, [
        ~(F.col(f"min_{c}").eqNullSafe(F.col(n)) & F.col(f"max_{c}").eqNullSafe(F.col(n))) for c, n in stored.items()])
    finding = lambda bad, rule, detail: F.when(bad, F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))
    one_sided = F.col("game_id").isNull() | F.col("low").isNull() | (F.col("low") == F.col("high"))
    found = F.array_compact(F.array(
        finding(is_game & (F.col("games") > 1), "V4", F.concat(F.lit("duplicate "), F.coalesce("game_id", F.lit("")))),
        finding(is_scope & (F.col("reports") > 0) & ((F.col("games") == zero) | differs), "V6", F.lit("counts")),
        finding(is_line & (F.col("players") > 1), "V8", F.concat(F.lit("duplicate "), text)),
        finding(is_game & (F.col("games") > 0) & one_sided, "V11", F.coalesce("game_id", F.lit("")))))
    return counted.select(*REPORT, F.inline(found))


def player_rules(players: DataFrame, games: DataFrame, only: str | None = None) -> DataFrame:
    """V7-V10 on single rows; participants come from one equi-join with the distinct games, which V7 alone needs."""
    rows, stranger = players, F.lit(False)
    if only in (None, "V7"):
        known = games.groupBy(*GAME).agg(F.max_by(F.struct("home_team_id", "away_team_id"), "starts_at_utc").alias("g"))
        rows = players.join(known, GAME, "left")
        stranger = F.col("g").isNull() | ~F.coalesce(
            F.col("team_id").isin(F.col("g.home_team_id"), F.col("g.away_team_id")), F.lit(False))
    rows = rows.withColumn("entries", expr.typed_stats(F.col("stats_json")))
    empty = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit("")) == "" for c in ("game_id", "player_id", "category")])
    identity = empty | expr.blank(F.col("player_name"))
    dnp, status = F.col("did_not_play"), F.col("participation_status")
    flags = (
        ~dnp.isin("true", "false") | ~F.coalesce("starter", F.lit("")).isin("", "true", "false")
        | ~status.isin("reported", "uncertain", "did_not_play") | ((status == "did_not_play") != (dnp == "true")))
    stats = ~F.coalesce(expr.strings_only(F.col("entries"), null_ok=False), F.lit(False))
    detail = F.concat_ws("/", "game_id", "player_id", "category")
    return row_rules(rows, {"V7": stranger, "V8": identity, "V9": flags, "V10": stats}, detail, only)


def export_violations(reports: DataFrame, games: DataFrame, players: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        report_rules(reports), game_rules(games, reports), player_rules(players, games), key_rules(reports, games, players)])


def by_rule(rule: str, reports: DataFrame, games: DataFrame, players: DataFrame) -> DataFrame:
    """Findings of one rule, planned without the passes that cannot produce it."""
    passes = {
        "V1": lambda: [report_rules(reports)],
        "V4": lambda: [game_rules(games, reports), key_rules(reports, games, players, "V4")],
        "V6": lambda: [key_rules(reports, games, players)],
        "V8": lambda: [player_rules(players, games, "V8"), key_rules(reports, games, players, "V8")],
        "V11": lambda: [key_rules(reports, games, players)]}
    for name in ("V2", "V3", "V5"):
        passes[name] = lambda: [game_rules(games, reports)]
    planned = passes.get(rule, lambda: [player_rules(players, games, rule)])()
    return reduce(DataFrame.unionByName, planned).where(F.col("rule") == rule)
