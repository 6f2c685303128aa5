"""Newest-wins merges, full-replacement merges and integrity rejects as set operations.

Every merge takes the stored state and a batch and returns the full new state.  Writing it is the
caller's choice (a new version of the table, or dynamic overwrite of the touched partitions).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchday.functions import expr
from matchday.functions.domain import STATUSES
from matchday.operators.integrity import repeated_keys

GAME = ["league", "game_id"]


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order``.  A plain aggregate, so map tasks pre-reduce hot keys."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns])


def newest_wins(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Upsert whole rows; an update with an equal time replaces the stored row, an older one does not.

    Ties inside one batch go to the greatest ``order`` column after ``observed_at``.
    """
    order = order or ["observed_at"]
    both = target.withColumn("batch_seq", F.lit(0)).unionByName(updates.withColumn("batch_seq", F.lit(1)))
    return newest(both, keys, [order[0], "batch_seq", *order[1:]]).drop("batch_seq")


def team_upsert(target: DataFrame, updates: DataFrame, seq: str = "seq") -> DataFrame:
    """Last write wins; rows with a blank required field are rejected (see ``team_rejects``)."""
    keys = ["league", "team_id"]
    good = updates.where(~team_blank())
    both = target.withColumn(seq, F.lit(-1).cast("bigint")).unionByName(good.select(*target.columns, F.col(seq).cast("bigint").alias(seq)))
    return newest(both, keys, [seq, "name", "abbreviation"]).drop(seq)


def team_blank():
    return reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c) == "") for c in ("team_id", "name", "abbreviation")])


def team_rejects(updates: DataFrame) -> DataFrame:
    return updates.where(team_blank())


def player_dim_upsert(observations: DataFrame) -> DataFrame:
    """Name of the newest observation; the observation time never moves back."""
    return observations.groupBy("league", "player_id").agg(
        F.max_by("name", F.struct("observed_at", "seq", "name")).alias("name"),
        F.max("observed_at").alias("observed_at"))


def judged_boxscores(stored: DataFrame, new: DataFrame, games: DataFrame) -> DataFrame:
    """Each observation of a game's new lines with the first reason why they may not replace the stored ones.

    The game must be stored as final, and with the season and type that the lines give; no line may lack its player, name
    or category (of the columns that there are); both participants must have lines and nobody else may; and the stored lines
    must not be newer.  With only two admissible teams, "both present" is min <> max: no distinct count is shuffled.
    """
    sides = games.select(*GAME, "home", "away", F.col("status").alias("stored_status"), F.col("season").alias("stored_season"),
                         F.col("season_type").alias("stored_type"))
    blank = [expr.blank(F.col(c)) for c in ("player_id", "name", "category") if c in new.columns]
    same = [F.coalesce(F.col(c) == F.col(s), F.lit(False)) for c, s in (("season", "stored_season"), ("season_type", "stored_type"))
            if c in new.columns]
    checked = new.join(sides, GAME, "left").groupBy(*GAME, "observed_at").agg(
        F.max("stored_status").alias("stored_status"),
        F.bool_and(reduce(lambda a, b: a & b, same, F.lit(True))).alias("same"),
        F.bool_or(reduce(lambda a, b: a | b, blank, F.lit(False))).alias("invalid"),
        F.bool_and(F.coalesce(F.col("team_id").isin(F.col("home"), F.col("away")), F.lit(False))).alias("participants"),
        (F.min("team_id") != F.max("team_id")).alias("both"))
    previous = stored.groupBy(*GAME).agg(F.max("observed_at").alias("old_at"))
    reason = (
        F.when(F.col("stored_status").isNull(), "unknown_game").when(F.col("stored_status") != "final", "not_final")
        .when(~F.col("same"), "identity_changed").when(F.col("invalid"), "invalid_line")
        .when(~F.col("participants"), "foreign_team").when(~F.coalesce("both", F.lit(False)), "one_team")
        .when(F.col("old_at") > F.col("observed_at"), "older"))
    return checked.join(previous, GAME, "left").select(*GAME, "observed_at", reason.alias("reason"))


def accepted_boxscores(stored: DataFrame, new: DataFrame, games: DataFrame) -> DataFrame:
    """Games whose new lines may replace the stored ones, and the newest observation that may."""
    fine = judged_boxscores(stored, new, games).where("reason IS NULL")
    return fine.groupBy(*GAME).agg(F.max("observed_at").alias("observed_at"))


def boxscore_refusals(stored: DataFrame, new: DataFrame, games: DataFrame) -> DataFrame:
    """Observations whose lines are left out, with the reason."""
    return judged_boxscores(stored, new, games).where("reason IS NOT NULL")


def boxscore_replace(stored: DataFrame, new: DataFrame, games: DataFrame) -> DataFrame:
    """All lines of an accepted game are replaced together; a failed refresh keeps the old ones."""
    accepted = accepted_boxscores(stored, new, games)
    return stored.join(accepted, GAME, "left_anti").unionByName(new.join(accepted, [*GAME, "observed_at"], "left_semi"))


def import_manifest(stored: DataFrame, responses: DataFrame) -> DataFrame:
    """Newest response per (league, date).  ``ids`` is the id list of one response, whose length the
    decoder bounds; it is never collected across responses.  Empty responses are recorded too."""
    return newest_wins(stored, responses, ["league", "import_date"], ["observed_at", "response_id"])


def import_date(games: DataFrame):
    """The date a game was imported for, which the decoders emit; its UTC date where a table has none."""
    return F.col("import_date") if "import_date" in games.columns else F.to_date("starts_at")


def unknown_team_rejects(games: DataFrame, teams: DataFrame) -> DataFrame:
    """Games naming a team that the same league does not have; each rejects its import batch."""
    sides = games.select("league", import_date(games).alias("import_date"), "game_id",
                         F.explode(F.array("home", "away")).alias("team_id"))
    return sides.join(teams.select("league", "team_id"), ["league", "team_id"], "left_anti").select(
        "league", "import_date", "game_id", "team_id")


def accepted_games(games: DataFrame, teams: DataFrame) -> DataFrame:
    """Games of the batches without an unknown team."""
    bad = unknown_team_rejects(games, teams).select("league", "import_date").distinct()
    dated = games.withColumn("import_date", import_date(games))
    return dated.join(bad, ["league", "import_date"], "left_anti").select(*games.columns)


def constraint_violations(games: DataFrame, lines: DataFrame, imports: DataFrame, teams: DataFrame) -> DataFrame:
    """Every schema constraint as (rule, entity): row checks in one pass, keys by partial counts,
    references by anti-joins."""
    def rule(name, bad):
        return F.when(bad, F.lit(name))
    def check(df, entity, *rules):
        # A null condition passes, as it does in a CHECK constraint.
        return df.select(F.explode_outer(F.array_compact(F.array(*rules))).alias("rule"), entity.alias("entity")).where(
            "rule is not null")
    final = F.col("status") == "final"
    line_id = F.concat_ws("/", "game_id", "player_id", "category")
    game_rows = check(
        games, F.col("game_id"),
        rule("game_status", ~F.col("status").isin(*STATUSES)),
        rule("score_negative", (F.col("home_score") < 0) | (F.col("away_score") < 0)),
        rule("season_positive", F.col("season") <= 0), rule("season_type_positive", F.col("season_type") <= 0),
        rule("week_positive", F.col("week") <= 0), rule("teams_differ", F.col("home") == F.col("away")),
        rule("final_scores", final & (F.col("home_score").isNull() | F.col("away_score").isNull())))
    kind = F.when(F.col("stats_json").rlike(r"\}\s*\z"),
                  F.from_json("stats_json", "map<string,variant>", expr.STRICT_JSON))
    line_rows = check(lines, line_id, rule("category_empty", F.col("category") == ""), rule("stats_object", kind.isNull()))
    import_rows = check(imports, F.col("game_id"), rule("line_count_positive", F.col("line_count") <= 0))

    def duplicated(df, keys, name, entity):
        return repeated_keys(df, keys).select(F.lit(name).alias("rule"), entity.alias("entity"))
    unique_game = duplicated(games, GAME, "game_unique", F.col("game_id"))
    unique_line = duplicated(lines, [*GAME, "player_id", "category"], "line_unique", line_id)

    known_games = games.select(*GAME).distinct()
    line_game = lines.join(known_games, GAME, "left_anti").select(F.lit("line_game").alias("rule"), line_id.alias("entity"))
    import_game = imports.join(known_games, GAME, "left_anti").select(F.lit("import_game").alias("rule"), F.col("game_id").alias("entity"))
    sides = games.select("league", "game_id", F.explode(F.array("home", "away")).alias("team_id"))
    known_teams = teams.select("league", "team_id")
    game_team = sides.join(known_teams, ["league", "team_id"], "left_anti").select(
        F.lit("game_team").alias("rule"), F.col("game_id").alias("entity"))
    line_team = lines.join(known_teams, ["league", "team_id"], "left_anti").select(
        F.lit("line_team").alias("rule"), line_id.alias("entity"))
    return reduce(DataFrame.unionByName, [
        game_rows, line_rows, import_rows, unique_game, unique_line, line_game, import_game, game_team, line_team])
