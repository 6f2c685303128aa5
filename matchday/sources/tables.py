"""Reading stored tables for a set of scopes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from matchday.functions.domain import KEY, LEAGUES
from matchday.operators import completeness as done


def leagues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEAGUES), "name string, abbreviation string, sport string")


@dataclass
class Snapshot:
    games: DataFrame
    players: DataFrame
    import_dates: DataFrame
    missing_ids: DataFrame


def scope_read(games: DataFrame, lines: DataFrame, ids: DataFrame, headers: DataFrame, complete: DataFrame,
               scopes: DataFrame, players: DataFrame | None = None) -> Snapshot:
    """Everything stored for the scopes; player rows only of complete games, with names where players are given.

    Semi-joins on the key let dynamic partition pruning skip other partitions of stored tables.
    """
    keys = scopes.select(*KEY)
    inside = games.join(keys, KEY, "left_semi")
    columns = ["game_id", "starts_at", "home", "away", "status", "home_score", "away_score", "week", "players_complete"]
    rows = lines.join(keys, KEY, "left_semi").join(complete.select(*done.GAME), done.GAME, "left_semi")
    if players is not None:
        rows = rows.join(players.select("league", "player_id", "name"), ["league", "player_id"])
    known = [c for c in ("game_id", "player_id", "name", "team_id", "category", "position", "jersey", "did_not_play", "starter", "stats_json")
             if c in rows.columns]
    return Snapshot(
        games=done.with_completeness(inside, complete).select(*KEY, *columns),
        players=rows.select(*KEY, *known),
        import_dates=headers.join(scopes.select("league").distinct(), "league", "left_semi").select(*done.DAY),
        missing_ids=done.missing_game_rows(scopes, ids, games),
    )


ORDERS = {"games": [*KEY, "starts_at", "game_id"], "import_dates": ["league", "import_date"], "missing_ids": [*KEY, "game_id"]}


def ordered(snapshot: Snapshot) -> Snapshot:
    """The same in its fixed order: games by start, player rows by their game's start, then player and category."""
    starts = snapshot.games.select(*done.GAME, "starts_at")
    players = snapshot.players.join(starts, done.GAME).orderBy(*KEY, "starts_at", "game_id", "player_id", "category").drop("starts_at")
    return Snapshot(snapshot.games.orderBy(*ORDERS["games"]), players, snapshot.import_dates.orderBy(*ORDERS["import_dates"]),
                    snapshot.missing_ids.orderBy(*ORDERS["missing_ids"]))
