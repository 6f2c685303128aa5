"""Registered sink queries (K1-K6, S10): frames as written and read back."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchday.functions.domain import FEATURES, KEY
from matchday.operators import audit, completeness, export_rules, sinks, splits
from matchday.plans.audit_plans import audit_input
from matchday.plans.completeness_plans import complete, stored
from matchday.plans.registry import query, view
from matchday.session import scratch_dir
from matchday.sources import exports

view("exported_games", """
SELECT game_id, league, season, season_type, concat(strftime(starts_at, '%Y-%m-%dT%H:%M:%S'), 'Z') AS starts_at_utc, home AS home_team_id, away AS away_team_id,
  CAST(home_score AS VARCHAR) AS home_score, CAST(away_score AS VARCHAR) AS away_score,
  CASE WHEN EXISTS (SELECT 1 FROM complete c WHERE c.game_id = g.game_id) THEN 'true' ELSE 'false' END AS player_import_complete, CAST(week AS VARCHAR) AS week
FROM games g WHERE status = 'final'""")
view("exported_players", """
SELECT l.league, l.season, l.season_type, l.game_id, l.player_id, concat('Player "', l.player_id, '", Jr.') AS player_name, l.team_id, l.category, 'G' AS position,
  CAST(NULL AS VARCHAR) AS jersey, CASE WHEN l.did_not_play THEN 'true' ELSE 'false' END AS did_not_play,
  CASE WHEN l.starter THEN 'true' WHEN NOT l.starter THEN 'false' END AS starter, l.stats_json, l.participation_status
FROM line_status l JOIN complete c ON c.game_id = l.game_id""")


def flagged_games(t):
    return completeness.with_completeness(stored(t, "games"), complete(t))


def full_lines(t):
    named = stored(t, "lines").withColumn("name", F.concat(F.lit('Player "'), "player_id", F.lit('", Jr.'))).withColumn(
        "position", F.lit("G")).withColumn("jersey", F.lit(""))
    return named.join(complete(t).select(*completeness.GAME), completeness.GAME, "left_semi")


def audited(t):
    """Report and findings of one audit: its rules run once, and the report counts the findings as written."""
    a = audit_input(t)
    issues = t.share("audited_issues", audit.audit_issues(a))
    return t.share("audited_report", audit.audit_report(a, issues)), issues


@query("export_games", "SELECT * FROM exported_games")
def _(t):
    path = scratch_dir(t.spark)
    sinks.write_keyed(sinks.export_games(flagged_games(t)), f"{path}/games", ["starts_at_utc", "game_id"])
    return exports.read_games(t.spark, path)


@query("export_players", "SELECT * FROM exported_players")
def _(t):
    path = scratch_dir(t.spark)
    sinks.write_keyed(sinks.export_players(full_lines(t)), f"{path}/players", ["game_id", "player_id", "category"])
    return exports.read_players(t.spark, path)


@query("export_report", "SELECT *, 4 AS schema_version FROM reports")
def _(t):
    path = scratch_dir(t.spark)
    report = audit.audit_report(audit_input(t))
    sinks.require_ready(report, allow_incomplete=True)
    sinks.write_keyed(report.withColumn("schema_version", F.lit(4)), f"{path}/report", [], kind="json")
    return exports.read_reports(t.spark, path)


@query("export_report_rules", """
SELECT league AS report_league, season AS report_season, season_type AS report_season_type, 'V1' AS rule, 'report' AS detail FROM reports
WHERE NOT (ready_for_export AND issues = 0 AND missing_import_dates = 0)""")
def _(t):
    """V1 on the reports as written and read again."""
    path = scratch_dir(t.spark)
    report = audit.audit_report(audit_input(t)).withColumn("schema_version", F.lit(4))
    sinks.write_keyed(report, f"{path}/report", [], kind="json")
    return export_rules.report_rules(exports.read_reports(t.spark, path))


@query("export_row_rules", """
SELECT league AS report_league, season AS report_season, season_type AS report_season_type, 'V2' AS rule, game_id AS detail
FROM exported_games WHERE player_import_complete <> 'true'
UNION ALL SELECT league, season, season_type, 'V5', game_id FROM exported_games WHERE league = 'NBA' AND home_score = away_score""")
def _(t):
    """V2 to V5 on the games as written and read again."""
    path = scratch_dir(t.spark)
    report = audit.audit_report(audit_input(t)).withColumn("schema_version", F.lit(4))
    sinks.write_keyed(sinks.export_games(flagged_games(t)), f"{path}/games", ["starts_at_utc", "game_id"])
    return export_rules.game_rules(exports.with_report_key(exports.read_games(t.spark, path, with_presence=True)), report)


@query("export_overwrite", """
SELECT game_id, league, season, season_type, starts_at_utc, home_team_id, away_team_id, home_score,
  CASE WHEN league = 'NFL' THEN '0' ELSE away_score END AS away_score, player_import_complete, week FROM exported_games""")
def _(t):
    """Rewriting the NFL keys leaves the NBA keys alone."""
    path, order = scratch_dir(t.spark), ["starts_at_utc", "game_id"]
    rows = sinks.export_games(flagged_games(t))
    sinks.write_keyed(rows, f"{path}/games", order)
    changed = rows.where("league = 'NFL'").withColumn("away_score", F.lit("0"))
    sinks.write_keyed(changed, f"{path}/games", order, overwrite=True)
    return exports.read_games(t.spark, path)


@query("read_export", "SELECT * FROM exported_games")
def _(t):
    path = scratch_dir(t.spark)
    report, issues = audited(t)
    sinks.write_export(path, flagged_games(t), full_lines(t), report, issues, allow_incomplete=True)
    return exports.read_games(t.spark, path)


@query("export_unit", """
SELECT league, season, season_type, 'games' AS part, count(*) AS rows FROM exported_games GROUP BY ALL
UNION ALL SELECT league, season, season_type, 'players', count(*) FROM exported_players GROUP BY ALL
UNION ALL SELECT league, season, season_type, 'report', count(*) FROM reports GROUP BY ALL
UNION ALL SELECT league, season, season_type, 'issues', count(*) FROM audit_all GROUP BY ALL""")
def _(t):
    """All four tables of an export that was written twice, the second time with the NFL scopes only."""
    path = scratch_dir(t.spark)
    report, issues = audited(t)
    sinks.write_export(path, flagged_games(t), full_lines(t), report, issues, allow_incomplete=True)
    nfl = "league = 'NFL'"
    sinks.write_export(path, flagged_games(t), full_lines(t), report.where(nfl), issues.where(nfl), overwrite=True, allow_incomplete=True)
    tables = {"games": exports.read_games(t.spark, path), "players": exports.read_players(t.spark, path),
              "report": exports.read_reports(t.spark, path), "issues": exports.read_issues(t.spark, path)}
    counts = [df.groupBy(*KEY).agg(F.count("*").alias("rows")).withColumn("part", F.lit(name)) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


@query("export_versions", """
SELECT game_id, league, season, season_type, starts_at_utc, home_team_id, away_team_id, home_score, away_score, player_import_complete,
  CASE WHEN league = 'NFL' THEN week END AS week, league = 'NFL' AS week_present FROM exported_games""")
def _(t):
    """Files of two versions side by side: without a week column, and with columns of another order and one more."""
    path = scratch_dir(t.spark)
    rows = sinks.export_games(flagged_games(t))
    sinks.write_keyed(rows.where("league <> 'NFL'").drop("week"), f"{path}/games", ["starts_at_utc", "game_id"])
    more = rows.where("league = 'NFL'").select(*reversed(rows.columns)).withColumn("venue", F.lit("x"))
    sinks.write_keyed(more, f"{path}/games", ["starts_at_utc", "game_id"])
    return exports.read_games(t.spark, path, with_presence=True)


@query("export_version_rules", """
SELECT league AS report_league, season AS report_season, season_type AS report_season_type, 'V3' AS rule, game_id AS detail
FROM exported_games WHERE league = 'NBA'""")
def _(t):
    """V3 where a file of version 4 lacks its week column; version 3 may."""
    path = scratch_dir(t.spark)
    rows = sinks.export_games(flagged_games(t))
    sinks.write_keyed(rows.drop("week"), f"{path}/games", ["starts_at_utc", "game_id"])
    version = F.when(F.col("league") == "NBA", 4).otherwise(3).alias("schema_version")
    report = rows.select(*KEY).distinct().select(*KEY, version)
    games = exports.with_report_key(exports.read_games(t.spark, path, with_presence=True))
    return export_rules.game_rules(games, report).where("rule = 'V3'")


@query("run_outputs", "SELECT league, season, season_type, split, game_id, date, target AS home_win, " + ", ".join(FEATURES) + " FROM s602020")
def _(t):
    path = scratch_dir(t.spark)
    split = splits.split_60_20_20(t["examples"])
    sinks.write_run(path, split, split.select(*KEY, "game_id"))
    return t.spark.read.parquet(f"{path}/features")


view("fingerprints", """
SELECT league, season, season_type, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31),
  away, coalesce(CAST(away_score AS VARCHAR), '\\N'), game_id, home, coalesce(CAST(home_score AS VARCHAR), '\\N'),
  strftime(starts_at, '%Y-%m-%d %H:%M:%S'), status, CAST(week AS VARCHAR))), 1, 15) AS BIGINT)) AS VARCHAR) AS fingerprint
FROM games GROUP BY league, season, season_type""")


@query("dataset_fingerprint", "SELECT * FROM fingerprints")
def _(t):
    return sinks.dataset_fingerprint(t["games"], KEY)
