"""Leakage-free features: a game sees only its teams' results on strictly earlier UTC dates.

The history of a team is reduced to one row per (key, team, date) before any window runs, with
map-side partial aggregation.  A window partition therefore holds at most one row per calendar day of
one season, however many games a team (or a hot key) has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchday.functions.domain import FEATURE_SETS, FEATURES, KEY, MINIMUM_GAMES, REGULAR

TEAM = [*KEY, "team"]
RECENT = 5
STATE = ["n", "win_rate", "mean_for", "mean_against", "mean_margin", "last5_win_rate", "last5_margin", "rest_days"]


def played(games: DataFrame) -> DataFrame:
    return games.where("status = 'final' and home_score is not null and away_score is not null")


def team_games(games: DataFrame) -> DataFrame:
    """Each final game once per side."""
    names = "'team', {}, 'opponent', {}, 'points_for', {}, 'points_against', {}"
    sides = ", ".join(f"named_struct({names.format(*side)})" for side in (
        ("home", "away", "home_score", "away_score"), ("away", "home", "away_score", "home_score")))
    return (
        played(games)
        .selectExpr(*KEY, "game_id", "starts_at", "to_date(starts_at) AS date", f"explode(array({sides})) AS s")
        .select(*KEY, "game_id", "starts_at", "date", "s.*")
    )


# Two for a win, one for a tie: keeps running sums exact integers.
HALF_WINS = "CASE WHEN points_for > points_against THEN 2 WHEN points_for = points_against THEN 1 ELSE 0 END"


def daily_totals(sides: DataFrame) -> DataFrame:
    return sides.groupBy(*TEAM, "date").agg(
        F.expr("count(*) AS games"), F.expr(f"sum({HALF_WINS}) AS half_wins"),
        F.expr("sum(points_for) AS points_for"), F.expr("sum(points_against) AS points_against"))


def daily_recent(sides: DataFrame) -> DataFrame:
    """The day's last five games in (start, id) order.

    The rank filter is planned as a group limit on the map side, so at most five rows per team-day
    and input partition are shuffled.
    """
    team_day = ", ".join([*TEAM, "date"])
    entry = f"struct(starts_at, game_id, {HALF_WINS} AS half_wins, points_for - points_against AS margin)"
    return (
        sides.selectExpr("*", f"row_number() OVER (PARTITION BY {team_day} ORDER BY starts_at DESC, game_id DESC) AS rank")
        .where(f"rank <= {RECENT}")
        .groupBy(*TEAM, "date").agg(F.expr(f"sort_array(collect_list({entry})) AS recent"))
    )


def team_state(games: DataFrame, ask: DataFrame | None = None) -> DataFrame:
    """State of each team before each of its dates (F2, F3, F4), one row per (key, team, date).

    ``ask`` adds (key, team, date) rows without results, e.g. dates of unplayed games.
    """
    sides = team_games(games)
    days = daily_totals(sides).join(daily_recent(sides), [*TEAM, "date"])
    if ask is not None:
        asked = ask.select(*TEAM, "date").distinct()
        days = days.join(asked, [*TEAM, "date"], "full_outer")
    team = ", ".join(TEAM)
    before = f"OVER (PARTITION BY {team} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    state = days.selectExpr(
        "*", f"coalesce(sum(games) {before}, 0) AS n", f"sum(half_wins) {before} AS half",
        f"sum(points_for) {before} AS pf", f"sum(points_against) {before} AS pa",
        f"max(CASE WHEN games IS NOT NULL THEN date END) {before} AS previous", f"count(games) {before} AS slot")
    # With asked dates the frame counts only dates with results, so that empty ones take no place in it.
    frame = "ORDER BY date ROWS" if ask is None else "ORDER BY slot RANGE"
    last_days = f"OVER (PARTITION BY {team} {frame} BETWEEN {RECENT} PRECEDING AND 1 PRECEDING)"
    state = state.selectExpr("*", f"slice(flatten(collect_list(recent) {last_days}), -{RECENT}, {RECENT}) AS last5")
    mean5 = lambda field, scale: (
        f"CASE WHEN size(last5) = {RECENT} THEN aggregate(last5.{field}, 0, (a, x) -> a + x) / {scale}D END")
    return state.selectExpr(
        *TEAM, "date", "n",
        "half / (2.0D * n) AS win_rate", "pf / n AS mean_for", "pa / n AS mean_against", "(pf - pa) / n AS mean_margin",
        f"{mean5('half_wins', 2.0 * RECENT)} AS last5_win_rate", f"{mean5('margin', 1.0 * RECENT)} AS last5_margin",
        "datediff(date, previous) AS rest_days")


def team_history(games: DataFrame) -> DataFrame:
    return team_state(games).select(*TEAM, "date", "n", "win_rate", "mean_for", "mean_against", "mean_margin")


def team_last5(games: DataFrame) -> DataFrame:
    return team_state(games).select(*TEAM, "date", "n", "last5_win_rate", "last5_margin")


def rest_days(games: DataFrame) -> DataFrame:
    return team_state(games).select(*TEAM, "date", "n", "rest_days")


def with_states(targets: DataFrame, state: DataFrame) -> DataFrame:
    """Attach home and away state.  ``state`` is unique per join key, so neither join multiplies rows;
    AQE broadcasts it when its measured size allows and splits hot team-days otherwise."""
    def side(prefix):
        return state.selectExpr(*KEY, f"team AS {prefix}", "date", *[f"{c} AS {prefix}_{c}" for c in STATE])
    return targets.join(side("home"), [*KEY, "home", "date"], "left").join(
        side("away"), [*KEY, "away", "date"], "left")


FEATURE_SQL = [f"CAST(home_{c} - away_{c} AS DOUBLE) AS {name}" for name, c in zip(FEATURES, STATE[1:])]
ENOUGH = f"least(home_n, away_n) >= {MINIMUM_GAMES}"


def classified(games: DataFrame) -> DataFrame:
    """Every final game with its fate: tie first, then warm-up, else eligible."""
    targets = played(games).withColumn("date", F.to_date("starts_at"))
    return with_states(targets, team_state(games)).selectExpr(
        "*", f"CASE WHEN home_score = away_score THEN 'tie' WHEN {ENOUGH} THEN 'eligible' ELSE 'warmup' END AS fate")


def examples(games: DataFrame) -> DataFrame:
    return classified(games).where("fate = 'eligible'").selectExpr(
        *KEY, "game_id", "date", "week", *FEATURE_SQL, "CAST(home_score > away_score AS INT) AS target")


def example_counts(games: DataFrame) -> DataFrame:
    fate = lambda value: F.expr(f"count_if(fate = '{value}')")
    return classified(games).groupBy(*KEY).agg(
        F.expr("count(*) AS input_games"), fate("tie").alias("excluded_ties"),
        fate("warmup").alias("excluded_warmup"), fate("eligible").alias("eligible_games"))


def newest_observation(history: DataFrame) -> DataFrame:
    if "observed_at" not in history.columns:
        return history
    from matchday.operators.upsert import newest
    # of equally late observations the later entry (``seq``) counts; the rest of the row makes the order total
    keys = ["league", "game_id", "observed_at"]
    return newest(history, keys[:2], ["observed_at", *sorted(c for c in history.columns if c not in keys and c == "seq"),
                                      *sorted(c for c in history.columns if c not in (*keys, "seq"))])


def asof_features(targets: DataFrame, history: DataFrame) -> DataFrame:
    """Features of unplayed targets from the newest observation of earlier regular-season finals."""
    past = newest_observation(history).where(F.col("season_type") == REGULAR)
    goals = targets.withColumn("date", F.to_date("starts_at"))
    own_type = goals.columns
    goals = goals.withColumn("own_type", F.col("season_type")).withColumn("season_type", F.lit(REGULAR))
    ask = goals.select(
        *KEY, "date", F.explode(F.array("home", "away")).alias("team"))
    joined = with_states(goals, team_state(past, ask))
    gated = [f"CASE WHEN {ENOUGH} THEN {sql.replace(' AS ' + name, '')} END AS {name}" for name, sql in zip(FEATURES, FEATURE_SQL)]
    return joined.selectExpr(
        *["own_type AS season_type" if c == "season_type" else c for c in own_type], *gated,
        "home_n AS n_home", "away_n AS n_away")


def feature_subset(frame: DataFrame, name: str) -> DataFrame:
    keep = FEATURE_SETS[name]
    return frame.drop(*[f for f in FEATURES if f not in keep])
