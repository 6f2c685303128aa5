"""Registered daily-forecast queries."""

from datetime import datetime

from pyspark.sql import functions as F

from matchday.operators import forecast as op
from matchday.plans.feature_plans import asof_sql
from matchday.plans.model_plans import VARIANTS, fixed_models
from matchday.plans.registry import query, view

ZONE = "America/Los_Angeles"
CLOCKS = (datetime(1997, 5, 31, 20), datetime(1998, 3, 1, 20))
DAYS = ("1997-06-01", "1998-03-02")  # UTC midnights that fall on the viewers' days of CLOCKS
NAMES, WEIGHTS, INTERCEPT = VARIANTS["all"]


def per_clock(fn):
    """The same job at two instants, one per league."""
    first, second = (fn(now) for now in CLOCKS)
    return first.unionByName(second)


def models(t):
    """One model per league: the fixed weights on its first season's statistics."""
    every = fixed_models(t).where("variant = 'all'")
    first = every.groupBy("league").agg(F.min("season").alias("season"))
    return every.join(first, ["league", "season"]).select(
        "league", F.concat(F.lit("all-"), "league").alias("model_id"), F.lit("1996-12-31").alias("trained_through"),
        "features", "mean", "scale", "coefficients", "intercept")


def ledger(t):
    """Earlier predictions of even ids; every fourth one was made for another start."""
    n = F.col("game_id").cast("bigint")
    moved = F.when(n % 4 == 2, F.col("starts_at") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("starts_at"))
    return t["games"].where(n % 2 == 0).select(
        F.concat(F.lit("all-"), "league").alias("model_id"), "league", "game_id", moved.alias("starts_at"),
        F.lit(0.625).alias("home_probability"), F.lit(0.375).alias("away_probability"),
        (F.col("starts_at") - F.expr("INTERVAL 1 HOUR")).alias("generated_at"),
        F.lit(6).cast("bigint").alias("home_history_games"), F.lit(7).cast("bigint").alias("away_history_games"))


def loads(t):
    """Every season loaded five minutes before each clock."""
    seasons = t["games"].select("league", "season").distinct()
    parts = [seasons.withColumn("loaded_at", op.instant(now) - F.expr("INTERVAL 5 MINUTES")) for now in CLOCKS]
    return parts[0].unionByName(parts[1]).withColumn("ok", F.lit(True))


@query("local_day_games", f"""
SELECT league, game_id, starts_at, status FROM games
WHERE CAST((starts_at AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}' AS DATE) IN (DATE '1997-05-31', DATE '1998-03-01')""")
def _(t):
    return per_clock(lambda now: op.local_day_games(t["games"], ZONE, now)).select("league", "game_id", "starts_at", "status")


view("day_games", f"SELECT * FROM games WHERE starts_at IN (TIMESTAMP '{DAYS[0]}', TIMESTAMP '{DAYS[1]}')")
view("serving", """
SELECT league, arg_min(season, game_id) AS season, starts_at AS day FROM day_games WHERE status = 'scheduled' GROUP BY league, starts_at""")


@query("serving_season", "SELECT league, season FROM serving")
def _(t):
    return per_clock(lambda now: op.serving_season(op.local_day_games(t["games"], ZONE, now), now))


# One load attempt per season, its outcome and age set by the season.
view("attempts", f"""
SELECT DISTINCT league, season, TIMESTAMP '1998-03-01 20:00:00' - to_minutes(CAST(CASE WHEN season = 1996 THEN 16 WHEN season = 1998 THEN 15 ELSE 3 END AS INT)) AS loaded_at,
  season <> 2000 AS ok FROM games WHERE season <> 1999""")


@query("history_status", """
SELECT g.league, g.season, CASE WHEN g.season = 1997 THEN 'not_needed' WHEN a.ok = false THEN 'unavailable' WHEN a.loaded_at IS NULL THEN 'warming'
  WHEN TIMESTAMP '1998-03-01 20:00:00' - a.loaded_at > INTERVAL 15 MINUTE THEN 'stale' ELSE 'ready' END AS history_status
FROM (SELECT DISTINCT concat(league, '-', season) AS league, season, league AS base FROM games) g
LEFT JOIN attempts a ON a.league = g.base AND a.season = g.season""")
def _(t):
    # Each stored season plays the part of one league, so that every status occurs.
    now = CLOCKS[1]
    seasons = t["games"].select(F.concat_ws("-", "league", F.col("season").cast("string")).alias("league"), "season").distinct()
    age = F.when(F.col("season") == 1996, 16).when(F.col("season") == 1998, 15).otherwise(3)
    attempts = seasons.where("season <> 1999").select(
        "league", "season", (op.instant(now) - F.make_dt_interval(mins=age)).alias("loaded_at"), (F.col("season") != 2000).alias("ok"))
    fitted = seasons.where("season <> 1997").select("league")
    return op.history_status(seasons.select("league"), seasons, fitted, attempts, now).withColumn(
        "season", F.coalesce("season", F.lit(None).cast("int")))


@query("team_names", """
SELECT g.league, g.game_id, coalesce(h.name, concat('Team ', g.home)) AS home_team, coalesce(a.name, concat('Team ', g.away)) AS away_team
FROM games g LEFT JOIN league_teams h ON h.league = g.league AND h.team_id = g.home LEFT JOIN league_teams a ON a.league = g.league AND a.team_id = g.away""")
def _(t):
    return op.team_names(t["games"], t["league_teams"]).select("league", "game_id", "home_team", "away_team")


# Refresh: stored history has old rows; NBA loads fail, NFL loads last ran 1998-05-10 except new seasons.
view("refresh_rows", """
SELECT *, CASE WHEN season < 1998 THEN DATE '1998-05-08' ELSE make_date(season, 7, 1) END AS lower FROM games
WHERE league = 'NFL' AND season_type = 2""")


@query("history_refresh", """
WITH fresh AS (SELECT * FROM refresh_rows WHERE CAST(starts_at AS DATE) BETWEEN
  CASE WHEN season = 1998 THEN DATE '1998-05-08' ELSE make_date(season, 7, 1) END AND DATE '1998-10-01')
SELECT league, game_id, season, season_type, starts_at, status, home_score FROM fresh
UNION ALL SELECT league, game_id, season, season_type, starts_at, 'scheduled', CAST(NULL AS INT) FROM games g
WHERE status = 'final' AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.game_id = g.game_id)""")
def _(t):
    games = t["games"].select("league", "game_id", "season", "season_type", "starts_at", "status", "home_score")
    stored = games.where("status = 'final'").withColumn("status", F.lit("scheduled")).withColumn("home_score", F.lit(None).cast("int"))
    last = F.when(F.col("season") == 1998, F.to_timestamp_ntz(F.lit("1998-05-10 09:00:00")))
    log = games.select("league", "season").distinct().select("league", "season", last.alias("last_load"), (F.col("league") == "NFL").alias("ok"))
    return op.history_refresh(stored, games, log, datetime(1998, 10, 1, 12))


Z = f"({INTERCEPT})::DOUBLE + " + " + ".join(
    f"(v.{f} - s.m{i}) / CASE WHEN s.s{i} = 0 THEN 1 ELSE s.s{i} END * ({w})::DOUBLE" for i, (f, w) in enumerate(zip(NAMES, WEIGHTS), 1))
FEATURE_SQL = "hw - aw AS win_rate_diff, hf - af AS points_for_diff, ha - aa AS points_against_diff, hm - am AS margin_diff, h5w - a5w AS last5_win_rate_diff, h5m - a5m AS last5_margin_diff, CAST(hr - ar AS DOUBLE) AS rest_days_diff"


@query("today_predictions", "WITH " + asof_sql("SELECT * FROM day_games").strip() + f""",
first_stats AS (SELECT * FROM model_stats m WHERE season = (SELECT min(season) FROM model_stats x WHERE x.league = m.league)),
v AS (SELECT game_id, n_home, n_away, {FEATURE_SQL} FROM prior),
scored AS (SELECT g.*, v.n_home, v.n_away, {Z} AS z FROM day_games g JOIN v ON v.game_id = g.game_id JOIN first_stats s ON s.league = g.league),
decided AS (SELECT *, CASE WHEN status <> 'scheduled' AND CAST(game_id AS BIGINT) % 4 = 0 AND status = 'final' THEN 'frozen'
   WHEN status <> 'scheduled' THEN 'no_pregame_prediction' WHEN least(n_home, n_away) < 5 THEN 'too_few_games' END AS decision FROM scored)
SELECT d.league, d.game_id, d.starts_at, d.status, h.name AS home_team, a.name AS away_team, concat('all-', d.league) AS model_id,
  CASE WHEN decision = 'frozen' THEN 0.625::DOUBLE WHEN decision IS NULL THEN round(1 / (1 + exp(-z)), 9) END AS home_probability,
  CASE WHEN decision = 'frozen' THEN 0.375::DOUBLE WHEN decision IS NULL THEN round(1 - 1 / (1 + exp(-z)), 9) END AS away_probability,
  CASE WHEN decision = 'frozen' THEN 6 WHEN decision IS NULL THEN n_home END AS home_history_games,
  CASE WHEN decision = 'frozen' THEN d.starts_at - INTERVAL 1 HOUR WHEN decision IS NULL THEN d.starts_at - INTERVAL 4 HOUR END AS generated_at,
  CASE WHEN decision <> 'frozen' THEN decision END AS unavailable
FROM decided d JOIN teams h ON h.team_id = d.home JOIN teams a ON a.team_id = d.away""")
def _(t):
    t.share("games")
    fitted, book, log = t.share("models", models(t)), ledger(t), loads(t)
    out = per_clock(lambda now: op.today_predictions(t["games"], t["teams_by_league"], fitted, book, log.where(F.col("loaded_at") <= op.instant(now)), ZONE, now))
    p = F.col("prediction")
    return out.select(
        "league", "game_id", "starts_at", "status", "home_team", "away_team", "model_id",
        F.round(p["home_probability"], 9).alias("home_probability"), F.round(p["away_probability"], 9).alias("away_probability"),
        p["home_history_games"].alias("home_history_games"), p["generated_at"].alias("generated_at"), "unavailable")


@query("availability", "WITH " + asof_sql("SELECT * FROM day_games").strip() + """
SELECT g.league, coalesce(CASE WHEN g.status = 'final' AND CAST(g.game_id AS BIGINT) % 4 = 0 THEN 'available' WHEN g.status <> 'scheduled' THEN 'no_pregame_prediction'
  WHEN g.league = 'NFL' THEN 'training_overlap' WHEN least(p.n_home, p.n_away) < 5 THEN 'too_few_games' END, 'available') AS reason, count(*) AS games
FROM day_games g JOIN prior p ON p.game_id = g.game_id GROUP BY ALL""")
def _(t):
    t.share("games")
    fitted = t.share("models", models(t)).withColumn("trained_through", F.when(F.col("league") == "NFL", "1998-03-02").otherwise("1996-12-31"))
    book, log = ledger(t), loads(t)
    out = per_clock(lambda now: op.today_predictions(t["games"], t["teams_by_league"], fitted, book, log.where(F.col("loaded_at") <= op.instant(now)), ZONE, now))
    return out.groupBy("league", F.coalesce("unavailable", F.lit("available")).alias("reason")).agg(F.count("*").alias("games"))
