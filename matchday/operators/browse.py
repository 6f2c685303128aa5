"""Parameterised reporting queries.  Filters are bound values, never text spliced into SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchday.functions.domain import KEY, OFFSET_MAX, PAGE_DEFAULT, PAGE_MAX, REGULAR
from matchday.operators.completeness import GAME, with_completeness


def scoped(df: DataFrame, league=None, season=None, season_type=REGULAR) -> DataFrame:
    """Equality on the partition columns, so it prunes partitions; ``None`` leaves a column open."""
    for column, value in zip(KEY, (league, season, season_type)):
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def equals(df: DataFrame, **filters) -> DataFrame:
    for column, value in filters.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def browse_leagues(leagues: DataFrame) -> DataFrame:
    return leagues.select("name", "abbreviation", "sport").orderBy("abbreviation")


def browse_seasons(games: DataFrame, league=None) -> DataFrame:
    return scoped(games, league, None, None).groupBy(*KEY).agg(
        F.count("*").alias("games"), F.count_if(F.col("status") == "final").alias("final_games"),
        F.min("starts_at").alias("first_game"), F.max("starts_at").alias("last_game"))


def browse_teams(games: DataFrame, teams: DataFrame, league=None, season=None, season_type=REGULAR) -> DataFrame:
    """Teams with a game on either side.  Both sides are exploded to one key: no OR-join."""
    seen = scoped(games, league, season, season_type).select(
        *KEY, F.explode(F.array("home", "away")).alias("team_id")).distinct()
    return seen.join(teams.select("league", "team_id", "name"), ["league", "team_id"]).select(*KEY, "team_id", "name")


def browse_games(games: DataFrame, teams: DataFrame, complete: DataFrame, league=None, season=None,
                 season_type=REGULAR, team_id=None, status=None) -> DataFrame:
    chosen = equals(scoped(games, league, season, season_type), status=status)
    if team_id is not None:
        chosen = chosen.where((F.col("home") == F.lit(team_id)) | (F.col("away") == F.lit(team_id)))
    named = lambda side: teams.select("league", F.col("team_id").alias(side), F.col("name").alias(f"{side}_team"))
    return (
        with_completeness(chosen, complete).join(named("home"), ["league", "home"]).join(named("away"), ["league", "away"])
        .select(*KEY, "game_id", "starts_at", "status", "week", "home_team", "away_team", "home_score", "away_score",
                F.col("players_complete").alias("player_stats_complete"))
    )


def complete_lines(lines: DataFrame, complete: DataFrame, league=None, season=None, season_type=REGULAR, **filters) -> DataFrame:
    inside = equals(scoped(lines, league, season, season_type), **filters)
    return inside.join(complete.select(*GAME, "starts_at"), GAME)


def searched(players: DataFrame, search: str | None) -> DataFrame:
    if not search or not search.strip():
        return players
    return players.where(F.instr(F.lower("name"), F.lower(F.lit(search.strip()))) > 0)


def browse_players(lines: DataFrame, complete: DataFrame, teams: DataFrame, players: DataFrame, league=None,
                   season=None, season_type=REGULAR, team_id=None, player_id=None, game_id=None, category=None,
                   search=None) -> DataFrame:
    """Games and teams per player, over the lines that the filters leave.

    Two levels of plain aggregates replace the distinct count: first one row per (player, game), then
    per player.  The team lists are bounded by the number of teams of a league.
    """
    rows = complete_lines(lines, complete, league, season, season_type, team_id=team_id, player_id=player_id,
                          game_id=game_id, category=category)
    per_game = rows.groupBy(*KEY, "player_id", "game_id").agg(F.collect_set("team_id").alias("ids"))
    out = per_game.groupBy(*KEY, "player_id").agg(
        F.count("*").alias("games"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))
    names = out.select(*KEY, "player_id", F.explode("ids").alias("team_id")).join(
        teams.select("league", "team_id", "name"), ["league", "team_id"]).groupBy(
        *KEY, "player_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("teams"))
    found = searched(players, search).select("league", "player_id", "name")
    return out.join(names, [*KEY, "player_id"]).join(found, ["league", "player_id"]).select(
        *KEY, "player_id", "name", "games", "teams")


def browse_player_games(lines: DataFrame, complete: DataFrame, teams: DataFrame, players: DataFrame, league=None,
                        season=None, season_type=REGULAR, team_id=None, player_id=None, game_id=None,
                        category=None, search=None) -> DataFrame:
    """Lines of complete games; position and jersey are null where the stored lines have none."""
    rows = complete_lines(lines, complete, league, season, season_type, team_id=team_id, player_id=player_id,
                          game_id=game_id, category=category)
    more = [F.col(c) if c in lines.columns else F.lit(None).cast("string").alias(c) for c in ("position", "jersey")]
    return (
        rows.join(teams.select("league", "team_id", F.col("name").alias("team")), ["league", "team_id"])
        .join(searched(players, search).select("league", "player_id", F.col("name").alias("player")), ["league", "player_id"])
        .select(*KEY, "player_id", "player", "game_id", "starts_at", "team", "category", *more, "did_not_play", "starter",
                F.col("stats_json").alias("stats"))
    )


def browse_totals(totals: DataFrame, teams: DataFrame, players: DataFrame, league=None, season=None,
                  season_type=REGULAR, team_id=None, player_id=None, category=None) -> DataFrame:
    rows = equals(scoped(totals, league, season, season_type), team_id=team_id, player_id=player_id, category=category)
    return (
        rows.join(teams.select("league", "team_id", F.col("name").alias("team")), ["league", "team_id"])
        .join(players.select("league", "player_id", F.col("name").alias("player")), ["league", "player_id"])
        .select(*KEY, "player_id", "player", "team_id", "team", "category", "metric", "total", "games_with_metric")
    )


def page(df: DataFrame, order: list, limit: int = PAGE_DEFAULT, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(total of the whole result, ordered slice).  Two outputs: a past-the-end page still has its total."""
    if not 1 <= limit <= PAGE_MAX or not 0 <= offset <= OFFSET_MAX:
        raise ValueError(f"limit must be 1-{PAGE_MAX} and offset 0-{OFFSET_MAX}")
    return df.agg(F.count("*").alias("total")), df.orderBy(*order).offset(offset).limit(limit)


# The fixed order of each resource; the key comes last, for results of several scopes.
ORDERS = {
    "leagues": ["abbreviation"], "seasons": ["-season", "season_type", "league"], "teams": ["name", "team_id", *KEY],
    "games": ["-starts_at", "game_id", *KEY], "players": ["name", "player_id", *KEY],
    "player_games": ["-starts_at", "game_id", "player_id", "category", *KEY],
    "totals": ["player", "player_id", "team_id", "category", "metric", *KEY],
}


def resource_page(df: DataFrame, resource: str, limit: int = PAGE_DEFAULT, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of a browse result in its resource's own order."""
    return page(df, [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in ORDERS[resource]], limit, offset)
