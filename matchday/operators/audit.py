"""Audit rules: every finding is a row (key, severity, code, detail)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchday.functions import expr
from matchday.functions.domain import KEY, LEAGUES, MAX_SCOPE_DAYS, REGULAR, SEASON_RANGE, SEASON_TYPES
from matchday.operators import completeness as done
from matchday.operators.completeness import GAME

ISSUE = [*KEY, "severity", "code", "detail"]
CODES = {
    "no_games": "issue", "missing_game_row": "issue", "non_final_game": "issue",
    "resolved_postponement": "warning", "missing_score": "issue", "missing_player_import": "issue",
    "invalid_player_stats": "issue", "uncertain_participation": "warning",
    "unavailable_adjusted_qbr": "warning", "missing_player_stat_value": "issue",
    "unchecked_dates": "issue", "missing_import_dates": "issue",
}


@dataclass
class AuditInput:
    """One consistent set of stored tables and the scopes to check."""

    scopes: DataFrame
    games: DataFrame
    lines: DataFrame
    headers: DataFrame
    ids: DataFrame
    complete: DataFrame
    replacements: DataFrame

    def scoped_games(self) -> DataFrame:
        inside = self.games.join(self.scopes.select(*KEY), KEY, "left_semi")
        return done.with_completeness(inside, self.complete)

    def scoped_lines(self) -> DataFrame:
        inside = self.lines.join(self.scopes.select(*KEY), KEY, "left_semi")
        return inside.join(self.complete.select(*GAME), GAME, "left_semi")


def finding(df: DataFrame, code: str, detail) -> DataFrame:
    return df.select(*KEY, F.lit(CODES[code]).alias("severity"), F.lit(code).alias("code"),
                     (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def no_games(a: AuditInput) -> DataFrame:
    empty = a.scopes.join(a.games.select(*KEY).distinct(), KEY, "left_anti")
    return finding(empty, "no_games", "No games stored for the requested season and season type.")


def missing_game_row(a: AuditInput) -> DataFrame:
    rows = done.missing_game_rows(a.scopes, a.ids, a.games)
    return finding(rows, "missing_game_row", F.concat(
        "game_id", F.lit(": present in an expected date import but absent from games")))


def resolved(a: AuditInput) -> DataFrame:
    """Postponed games whose listed replacement was played.  Only listed pairs count; both joins are on
    unique ids, so a pairing with many games costs nothing extra."""
    games = a.scoped_games()
    old = games.where((F.col("league") == "NBA") & (F.col("season_type") == REGULAR) & (F.col("status") == "postponed"))
    listed = old.join(a.replacements.withColumnRenamed("postponed_id", "game_id"), ["league", "season", "game_id"])
    played = games.where(
        "status = 'final' and home_score is not null and away_score is not null and players_complete"
    ).select(*KEY, F.col("game_id").alias("final_id"), "home", "away", F.col("starts_at").alias("final_start"))
    return (
        listed.join(played, [*KEY, "final_id", "home", "away"]).where("final_start > starts_at")
        .select(*KEY, "game_id", "final_id").dropDuplicates([*KEY, "game_id"])
    )


def resolved_postponement(a: AuditInput) -> DataFrame:
    return finding(resolved(a), "resolved_postponement", F.concat("game_id", F.lit(" -> "), "final_id"))


def game_findings(a: AuditInput) -> DataFrame:
    """Non-final, missing score and missing box score in one pass over games."""
    games = a.scoped_games().join(resolved(a).select(*KEY, "game_id", "final_id"), [*KEY, "game_id"], "left")
    final = F.col("status") == "final"
    def row(code, detail):
        return F.struct(F.lit(CODES[code]).alias("severity"), F.lit(code).alias("code"), detail.alias("detail"))
    found = F.array(
        F.when(~final & F.col("final_id").isNotNull(),
               row("resolved_postponement", F.concat("game_id", F.lit(" -> "), "final_id"))),
        F.when(~final & F.col("final_id").isNull(),
               row("non_final_game", F.concat("game_id", F.lit(": "), "status"))),
        F.when(final & (F.col("home_score").isNull() | F.col("away_score").isNull()),
               row("missing_score", F.col("game_id"))),
        F.when(final & ~F.col("players_complete"), row("missing_player_import", F.col("game_id"))))
    return games.select(*KEY, F.inline_outer(F.array_compact(found))).where("code is not null")


def line_findings(a: AuditInput) -> DataFrame:
    """All rules on player statistics in one pass: one JSON parse per line, no shuffle of its own."""
    base = F.concat_ws("/", "game_id", "player_id", "category")
    entries = F.col("entries")
    def row(code, detail):
        return F.struct(F.lit(CODES[code]).alias("severity"), F.lit(code).alias("code"), detail.alias("detail"))
    valid = expr.strings_only(entries, null_ok=True) & (F.size(entries) > 0)
    maybe = (F.col("league") == "NBA") & (F.col("category") == "general") & (F.col("starter") == F.lit(False))
    status = expr.participation(F.col("league"), F.col("category"), F.lit(False), F.col("starter"), F.col("stats"))
    def value_rule(e):
        path = F.concat(base, F.lit("/"), e["key"])
        no_qbr = ((F.col("league") == "NFL") & (F.col("category") == "passing")
                  & (e["key"] == "adjQBR") & (e["value"] == "--"))
        return F.when(no_qbr, row("unavailable_adjusted_qbr", path)).when(
            expr.missing_value(e["value"]), row("missing_player_stat_value", path))
    found = (
        F.when(~F.col("valid"), F.array(row("invalid_player_stats", base)))
        .when(F.col("status") == "uncertain",
              F.array(row("uncertain_participation", F.concat(base, F.lit("/minutes")))))
        .otherwise(F.array_compact(F.transform(entries, value_rule)))
    )
    return (
        a.scoped_lines().where(~F.col("did_not_play"))
        .withColumn("entries", expr.typed_stats(F.col("stats_json")))
        .withColumn("stats", F.when(maybe, expr.stats_map(F.col("stats_json"))))
        .withColumn("valid", valid)
        .withColumn("status", F.when(F.col("valid"), status))
        .select(*KEY, F.inline_outer(found)).where("code is not null")
    )


def unchecked_dates(a: AuditInput) -> DataFrame:
    return finding(a.scopes.where("date_from is null"), "unchecked_dates",
                   "Supply a date range to check expected import dates.")


def missing_date_counts(a: AuditInput) -> DataFrame:
    return done.missing_import_dates(a.scopes, a.headers).groupBy(*KEY).agg(F.count("*").alias("n"))


def missing_import_dates(a: AuditInput) -> DataFrame:
    return finding(missing_date_counts(a), "missing_import_dates", F.concat(
        F.col("n").cast("string"), F.lit(" expected dates have no successful scoreboard import")))


def audit_issues(a: AuditInput) -> DataFrame:
    parts = [no_games(a), missing_game_row(a), game_findings(a), line_findings(a), unchecked_dates(a),
             missing_import_dates(a)]
    return reduce(DataFrame.unionByName, parts)


def by_code(a: AuditInput, code: str) -> DataFrame:
    """Findings of one code; only the pass that can produce it is planned."""
    single = {"no_games": no_games, "missing_game_row": missing_game_row,
              "resolved_postponement": resolved_postponement, "unchecked_dates": unchecked_dates,
              "missing_import_dates": missing_import_dates}
    if code in single:
        return single[code](a)
    source = game_findings if code in ("non_final_game", "missing_score", "missing_player_import") else line_findings
    return source(a).where(F.col("code") == code)


def audit_report(a: AuditInput, issues: DataFrame | None = None) -> DataFrame:
    """One row per scope; warnings do not block."""
    issues = audit_issues(a) if issues is None else issues
    games = a.scoped_games().groupBy(*KEY).agg(
        F.count("*").alias("stored_games"), F.count_if(F.col("status") == "final").alias("final_games"),
        F.count_if((F.col("status") == "final") & F.col("players_complete")).alias("complete_player_games"))
    rows = a.scoped_lines().groupBy(*KEY).agg(F.count("*").alias("player_category_rows"))
    found = issues.groupBy(*KEY).agg(
        F.count_if(F.col("severity") == "issue").alias("issues"),
        F.count_if(F.col("severity") == "warning").alias("warnings"))
    dates = missing_date_counts(a).withColumnRenamed("n", "missing_import_dates")
    counts = ["stored_games", "final_games", "complete_player_games", "player_category_rows", "issues", "warnings",
              "missing_import_dates"]
    out = a.scopes.join(games, KEY, "left").join(rows, KEY, "left").join(found, KEY, "left").join(dates, KEY, "left")
    return out.select(*KEY, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts]).withColumn(
        "ready_for_export", F.col("issues") == 0)


def scope_valid(scopes: DataFrame) -> DataFrame:
    """``reason`` is the first broken rule, or null."""
    low, high = SEASON_RANGE
    dates = F.col("date_from").isNotNull() | F.col("date_to").isNotNull()
    span = F.datediff("date_to", "date_from")
    reason = (
        F.when(~F.col("league").isin(*[l[1] for l in LEAGUES]), "league")
        .when(~F.col("season").between(low, high), "season")
        .when(~F.col("season_type").isin(*SEASON_TYPES), "season_type")
        .when(dates & (span.isNull() | (span < 0) | (span > MAX_SCOPE_DAYS)), "dates")
    )
    return scopes.select(*KEY, "date_from", "date_to", reason.alias("reason"), reason.isNull().alias("valid"))
