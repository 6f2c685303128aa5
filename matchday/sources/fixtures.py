"""Test inputs with deliberate faults, derived from the adapter views over their whole rows.

The statements run unchanged in Spark and DuckDB; ``{name}`` is another view.  Faults are set by a
rule on ids, so every rule of the operators fires at every scale while no row is left out.
"""

FIXTURES = {
    "league_teams": """
SELECT 'NBA' AS league, team_id, name, concat('N', team_id) AS abbreviation FROM {teams}
UNION ALL
SELECT 'NFL', team_id, name, concat('N', team_id) FROM {teams} WHERE CAST(team_id AS INT) % 7 <> 3""",

    "team_manifest": """
SELECT league, home AS team_id FROM {games} UNION SELECT league, away FROM {games}""",

    "manifest_ids": """
SELECT league, import_date, game_id FROM {manifests}
UNION ALL
SELECT league, import_date, concat('x', game_id) FROM {manifests} WHERE CAST(game_id AS BIGINT) % 23 = 0""",

    "headers": "SELECT DISTINCT league, import_date FROM {manifests}",

    "stored_games": """
SELECT game_id, league, season, season_type, starts_at, home, away, status,
       CASE WHEN CAST(game_id AS BIGINT) % 71 = 0 THEN NULL ELSE home_score END AS home_score, away_score, week
FROM {games}""",

    "stored_lines": """
SELECT game_id, league, season, season_type, player_id, team_id, category, did_not_play, starter,
       CASE WHEN CAST(player_id AS BIGINT) % 37 = 0 THEN '[]'
            WHEN CAST(player_id AS BIGINT) % 41 = 0 THEN '{{"points":5}}'
            WHEN CAST(player_id AS BIGINT) % 43 = 0 THEN '{{}}'
            WHEN CAST(player_id AS BIGINT) % 47 = 0 THEN 'nope'
            WHEN CAST(player_id AS BIGINT) % 53 = 0 THEN '{{"points":null,"assists":" ","steals":"NaN"}}'
            ELSE stats_json END AS stats_json
FROM {lines}""",

    "broken_games": """
SELECT league, game_id, starts_at,
       CASE WHEN CAST(game_id AS BIGINT) % 97 = 0 THEN 'unknown' ELSE status END AS status,
       CASE WHEN CAST(game_id AS BIGINT) % 89 = 0 THEN -1 WHEN CAST(game_id AS BIGINT) % 71 = 0 THEN NULL ELSE home_score END AS home_score,
       away_score,
       CASE WHEN CAST(game_id AS BIGINT) % 83 = 0 THEN 0 ELSE season END AS season, season_type,
       CASE WHEN CAST(game_id AS BIGINT) % 79 = 0 THEN 0 ELSE week END AS week,
       home, CASE WHEN CAST(game_id AS BIGINT) % 73 = 0 THEN home ELSE away END AS away
FROM {games}
UNION ALL
SELECT league, game_id, starts_at, status, home_score, away_score, season, season_type, week, home, away
FROM {games} WHERE CAST(game_id AS BIGINT) % 67 = 0""",

    "broken_lines": """
SELECT league, game_id, player_id, team_id,
       CASE WHEN CAST(player_id AS BIGINT) % 61 = 0 THEN '' ELSE category END AS category, stats_json
FROM {stored_lines}
UNION ALL
SELECT league, concat('q', game_id), player_id, team_id, category, stats_json
FROM {stored_lines} WHERE CAST(player_id AS BIGINT) % 59 = 0""",

    "broken_imports": """
SELECT league, game_id, CAST(CASE WHEN CAST(game_id AS BIGINT) % 19 = 0 THEN 0 ELSE line_count END AS INT) AS line_count
FROM {player_imports}""",

    "team_updates": """
SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'NFL' ELSE 'NBA' END AS league, CAST(c_nationkey AS STRING) AS team_id,
       CASE WHEN c_acctbal < 0 THEN '' ELSE concat(c_mktsegment, ' ', CAST(c_nationkey AS STRING)) END AS name,
       substr(c_mktsegment, 1, 3) AS abbreviation, c_custkey AS seq
FROM {customer}""",

    "player_observations": """
SELECT CASE WHEN l_partkey % 2 = 0 THEN 'NFL' ELSE 'NBA' END AS league, CAST(l_partkey AS STRING) AS player_id,
       concat('Player ', l_returnflag, l_linestatus) AS name, l_shipdate AS observed_at, l_orderkey * 10 + l_linenumber AS seq
FROM {lineitem}""",

    "old_lines": """
SELECT l.league, l.game_id, l.player_id, l.team_id, 'Old name' AS name, l.season, l.season_type, l.category, l.stats_json, g.starts_at AS observed_at
FROM {lines} l JOIN {games} g ON g.league = l.league AND g.game_id = l.game_id""",

    "new_lines": """
SELECT l.league, l.game_id, l.player_id, CASE WHEN CAST(l.game_id AS BIGINT) % 5 = 0 THEN concat('z', l.team_id) ELSE l.team_id END AS team_id,
       CASE WHEN CAST(l.game_id AS BIGINT) % 17 = 0 THEN ' ' ELSE concat('Player ', l.player_id) END AS name,
       l.season + CASE WHEN CAST(l.game_id AS BIGINT) % 19 = 0 THEN 1 ELSE 0 END AS season, l.season_type,
       l.category, concat(l.stats_json, ' ') AS stats_json,
       CASE WHEN CAST(l.game_id AS BIGINT) % 3 = 0 THEN g.starts_at - INTERVAL 1 DAY WHEN CAST(l.game_id AS BIGINT) % 3 = 1 THEN g.starts_at
            ELSE g.starts_at + INTERVAL 1 DAY END AS observed_at
FROM {lines} l JOIN {games} g ON g.league = l.league AND g.game_id = l.game_id
WHERE l.category <> 'passing'""",

    # the stored games as they were when the lines came: some were not final yet
    "games_then": """
SELECT g.league, g.season, g.season_type, g.game_id, g.starts_at, g.home, g.away,
       CASE WHEN CAST(g.game_id AS BIGINT) % 23 = 0 THEN 'scheduled' ELSE g.status END AS status
FROM {games} g WHERE CAST(g.game_id AS BIGINT) % 29 <> 0""",

    "daily_games": """
SELECT CAST(floor((year(observed_at) * 366 + dayofyear(observed_at)) / 31) AS INT) AS window_id, game_id,
       CAST(observed_at AS DATE) AS import_date, seq, status, home_score
FROM {snapshots}""",

    "players": """
SELECT 'NBA' AS league, CAST(p_partkey AS STRING) AS player_id, concat(p_name, ' ', CAST(p_partkey AS STRING)) AS name FROM {part}
UNION ALL SELECT 'NFL', CAST(p_partkey AS STRING), concat(p_name, ' ', CAST(p_partkey AS STRING)) FROM {part}""",

    # Exported text rows with faults; ``report_*`` is the key of the export they belong to.
    "export_games": """
SELECT league AS report_league, season AS report_season, season_type AS report_season_type,
       CASE WHEN CAST(game_id AS BIGINT) % 47 = 0 THEN '' ELSE game_id END AS game_id, league,
       CAST(CASE WHEN CAST(game_id AS BIGINT) % 61 = 0 THEN season + 1 ELSE season END AS STRING) AS season,
       CAST(season_type AS STRING) AS season_type,
       concat(CAST(CAST(starts_at AS DATE) AS STRING), CASE WHEN CAST(game_id AS BIGINT) % 59 = 0 THEN 'T00:00:00' ELSE 'T00:00:00Z' END) AS starts_at_utc,
       home AS home_team_id, CASE WHEN CAST(game_id AS BIGINT) % 51 = 0 THEN home ELSE away END AS away_team_id,
       CASE WHEN CAST(game_id AS BIGINT) % 57 = 0 THEN '-3' ELSE CAST(home_score AS STRING) END AS home_score,
       CAST(away_score AS STRING) AS away_score,
       CASE WHEN CAST(game_id AS BIGINT) % 10 = 0 THEN 'false' ELSE 'true' END AS player_import_complete,
       CASE WHEN CAST(game_id AS BIGINT) % 53 = 0 THEN '0' WHEN CAST(game_id AS BIGINT) % 54 = 0 THEN '' ELSE CAST(week AS STRING) END AS week
FROM (SELECT * FROM {games} UNION ALL SELECT * FROM {games} WHERE CAST(game_id AS BIGINT) % 49 = 0) g
WHERE status = 'final'""",

    "export_players": """
SELECT league AS report_league, season AS report_season, season_type AS report_season_type,
       CASE WHEN CAST(player_id AS BIGINT) % 31 = 0 THEN concat('u', game_id) ELSE game_id END AS game_id, player_id,
       CASE WHEN CAST(player_id AS BIGINT) % 29 = 0 THEN ' ' ELSE concat('Player ', player_id) END AS player_name,
       CASE WHEN CAST(player_id AS BIGINT) % 28 = 0 THEN concat('t', team_id) ELSE team_id END AS team_id,
       category, CASE WHEN did_not_play THEN 'true' ELSE 'false' END AS did_not_play,
       CASE WHEN CAST(player_id AS BIGINT) % 26 = 0 THEN 'maybe' WHEN starter THEN 'true' WHEN NOT starter THEN 'false' ELSE '' END AS starter,
       stats_json,
       CASE WHEN CAST(player_id AS BIGINT) % 25 = 0 THEN 'did_not_play' WHEN CAST(player_id AS BIGINT) % 24 = 0 THEN 'absent'
            WHEN did_not_play THEN 'did_not_play' ELSE 'reported' END AS participation_status
FROM (SELECT * FROM {stored_lines} UNION ALL SELECT * FROM {stored_lines} WHERE CAST(player_id AS BIGINT) % 27 = 0) l""",

    "export_reports": """
SELECT k.league, k.season, k.season_type, CAST(CASE WHEN k.season = 1996 THEN 2 ELSE 4 END AS INT) AS schema_version,
       k.season <> 1997 AS ready_for_export, CAST(CASE WHEN k.season = 1998 THEN 3 ELSE 0 END AS INT) AS issues,
       CAST(CASE WHEN k.season = 1999 THEN 2 ELSE 0 END AS INT) AS missing_import_dates,
       k.n AS final_games, k.n AS complete_player_games, coalesce(l.n, 0) AS player_category_rows
FROM (SELECT league, season, season_type, count(*) AS n FROM {games} WHERE status = 'final' GROUP BY league, season, season_type) k
LEFT JOIN (SELECT league, season, season_type, count(*) AS n FROM {lines} GROUP BY league, season, season_type) l
  ON l.league = k.league AND l.season = k.season AND l.season_type = k.season_type""",

    # Standardisation of each key's examples; the weights of the fixed models are constants of the plans.
    "model_stats": """
SELECT league, season, season_type, max(date) AS last_date, round(avg(target), 6) AS rate,
       round(avg(win_rate_diff), 6) AS m1, round(avg(points_for_diff), 6) AS m2, round(avg(points_against_diff), 6) AS m3,
       round(avg(margin_diff), 6) AS m4, round(avg(last5_win_rate_diff), 6) AS m5, round(avg(last5_margin_diff), 6) AS m6,
       round(avg(rest_days_diff), 6) AS m7,
       round(stddev_pop(win_rate_diff), 6) AS s1, round(stddev_pop(points_for_diff), 6) AS s2, round(stddev_pop(points_against_diff), 6) AS s3,
       round(stddev_pop(margin_diff), 6) AS s4, round(stddev_pop(last5_win_rate_diff), 6) AS s5, round(stddev_pop(last5_margin_diff), 6) AS s6,
       round(stddev_pop(rest_days_diff), 6) AS s7
FROM {examples} GROUP BY league, season, season_type""",
}
