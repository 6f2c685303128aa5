"""Import completeness and resume.

Manifests are kept flat, one row per (league, date, id), beside one header row per (league, date); a
date with any number of ids never becomes one array or one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchday.functions.domain import KEY

GAME = ["league", "game_id"]
DAY = ["league", "import_date"]


def date_complete(headers: DataFrame, ids: DataFrame, games: DataFrame) -> DataFrame:
    """A date is complete if its manifest has ids and each one is a final game with both scores."""
    good = games.where(
        "status = 'final' and home_score is not null and away_score is not null"
    ).select(*GAME, F.lit(True).alias("ok"))
    checked = ids.join(good, GAME, "left").groupBy(*DAY).agg(
        F.bool_and(F.coalesce("ok", F.lit(False))).alias("complete"))
    return headers.select(*DAY).join(checked, DAY, "left").select(
        *DAY, F.coalesce("complete", F.lit(False)).alias("complete"))


def teams_imported(manifest: DataFrame, teams: DataFrame) -> DataFrame:
    known = teams.select("league", "team_id", F.lit(True).alias("ok"))
    return manifest.join(known, ["league", "team_id"], "left").groupBy("league").agg(
        F.bool_and(F.coalesce("ok", F.lit(False))).alias("complete"))


def complete_games(games: DataFrame, imports: DataFrame, lines: DataFrame) -> DataFrame:
    """Final games whose box-score manifest still matches the game and the stored line count."""
    counts = lines.groupBy(*GAME).agg(F.count("*").alias("stored_lines"))
    copied = imports.select(*GAME, "line_count", *[F.col(c).alias(f"i_{c}") for c in ("season", "season_type", "home", "away")])
    same = "season = i_season and season_type = i_season_type and home = i_home and away = i_away"
    return (
        games.where("status = 'final'").join(copied, GAME).where(same)
        .join(counts, GAME).where("line_count = stored_lines").select(*games.columns)
    )


def with_completeness(games: DataFrame, complete: DataFrame) -> DataFrame:
    flags = complete.select(*GAME, F.lit(True).alias("players_complete"))
    return games.join(flags, GAME, "left").withColumn(
        "players_complete", F.coalesce("players_complete", F.lit(False)))


def expected_days(scopes: DataFrame) -> DataFrame:
    """Calendar days of each scope; at most a year per scope."""
    return scopes.where("date_from is not null and date_to is not null").select(
        *KEY, F.explode(F.sequence("date_from", "date_to")).alias("import_date"))


def missing_game_rows(scopes: DataFrame, ids: DataFrame, games: DataFrame) -> DataFrame:
    """Distinct manifest ids of the scope's days without a stored game.

    Days are matched by equality, and the stored games are removed before the (small) rest is matched
    to scopes.
    """
    orphans = ids.join(games.select(*GAME), GAME, "left_anti")
    return orphans.join(expected_days(scopes), DAY).select(*KEY, "game_id").distinct()


def missing_import_dates(scopes: DataFrame, headers: DataFrame) -> DataFrame:
    return expected_days(scopes).join(headers.select(*DAY), DAY, "left_anti").select(*KEY, "import_date")


def season_coverage(games: DataFrame, complete: DataFrame) -> DataFrame:
    finals = games.where("status = 'final'")
    return with_completeness(finals, complete).groupBy(*KEY).agg(
        F.count("*").alias("stored_final_games"), F.count_if("players_complete").alias("imported_player_games"))


def pending_dates(days: DataFrame, headers: DataFrame, ids: DataFrame, games: DataFrame, force: bool = False) -> DataFrame:
    """Dates still to fetch among ``days`` (league, import_date)."""
    wanted = days.select(*DAY).distinct()
    if force:
        return wanted
    done = date_complete(headers, ids, games).where("complete").select(*DAY)
    return wanted.join(done, DAY, "left_anti")


def pending_games(games: DataFrame, complete: DataFrame, force: bool = False) -> DataFrame:
    finals = games.where("status = 'final'").select(*KEY, "game_id", "starts_at", "home", "away")
    return finals if force else finals.join(complete.select(*GAME), GAME, "left_anti").select(*finals.columns)


def import_progress(headers: DataFrame, ids: DataFrame, games: DataFrame) -> DataFrame:
    """Per league: dates that would be fetched or skipped, and the games on fetched dates."""
    flags = date_complete(headers, ids, games)
    sizes = ids.groupBy(*DAY).agg(F.count("*").alias("n"))
    return flags.join(sizes, DAY, "left").groupBy("league").agg(
        F.count_if(~F.col("complete")).alias("dates_processed"), F.count_if("complete").alias("dates_skipped"),
        F.coalesce(F.sum(F.when(~F.col("complete"), F.col("n"))), F.lit(0)).alias("games_processed"))


def player_import_progress(games: DataFrame, complete: DataFrame, lines: DataFrame, excluded: DataFrame) -> DataFrame:
    """Per league: box scores fetched or skipped, their lines, and excluded entries without identity."""
    finals = with_completeness(games.where("status = 'final'"), complete).select(*GAME, "players_complete")
    counts = lines.groupBy(*GAME).agg(F.count("*").alias("n"))
    dropped = excluded.groupBy(*GAME).agg(F.sum("excluded").alias("dropped"))
    pending = ~F.col("players_complete")
    total = lambda c: F.coalesce(F.sum(F.when(pending, F.col(c))), F.lit(0))
    return finals.join(counts, GAME, "left").join(dropped, GAME, "left").groupBy("league").agg(
        F.count_if(pending).alias("games_processed"), F.count_if("players_complete").alias("games_skipped"),
        total("n").alias("lines_processed"), total("dropped").alias("unidentified_dnp"))
