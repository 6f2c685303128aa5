"""Registered player-statistic queries."""

from pyspark.sql import functions as F

from matchday.functions.domain import ADDITIVE_KEYS, PAIR_KEYS, UNCERTAIN_KEYS
from matchday.operators import player_stats as op
from matchday.plans.completeness_plans import complete, stored
from matchday.plans.registry import query, view

NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
_keys = ", ".join(f"'{k}'" for k in ADDITIVE_KEYS)
_pairs = " UNION ALL ".join(
    f"SELECT '{raw}' AS raw, '{a}' AS first, '{b}' AS second, '{'/' if '/' in raw else '-'}' AS mark"
    for raw, (a, b) in PAIR_KEYS.items())

view("stat_entries", """
SELECT game_id, league, season, season_type, player_id, team_id, category, did_not_play, key,
       json_extract_string(stats_json, concat('$."', key, '"')) AS raw
FROM (SELECT *, unnest(json_keys(stats_json)) AS key FROM lines)""")

view("additive", f"""
SELECT game_id, league, season, season_type, player_id, team_id, category, key AS metric, CAST(raw AS DOUBLE) AS value
FROM stat_entries WHERE NOT did_not_play AND key IN ({_keys}) AND regexp_full_match(raw, '{NUMBER}')
UNION ALL
SELECT game_id, league, season, season_type, player_id, team_id, category, unnest([first, second]) AS metric,
       unnest([CAST(parts[1] AS DOUBLE), CAST(parts[2] AS DOUBLE)]) AS value
FROM (SELECT e.*, p.first, p.second, string_split(e.raw, p.mark) AS parts FROM stat_entries e JOIN ({_pairs}) p ON p.raw = e.key)
WHERE NOT did_not_play AND len(parts) = 2 AND regexp_full_match(parts[1], '{NUMBER}') AND regexp_full_match(parts[2], '{NUMBER}')
  AND TRY_CAST(parts[1] AS DOUBLE) >= 0 AND TRY_CAST(parts[2] AS DOUBLE) >= 0""")

view("line_status", """
SELECT league, season, season_type, game_id, player_id, team_id, category, did_not_play, starter, stats_json,
  CASE WHEN did_not_play THEN 'did_not_play'
       WHEN league = 'NBA' AND category = 'general' AND starter = false AND json_extract_string(stats_json, '$.minutes') = '--'
        AND len(json_keys(stats_json)) = 14 AND """ + " AND ".join(
    f"""json_extract_string(stats_json, '$."{k}"') = '{"0-0" if "-" in k else "0"}'""" for k in UNCERTAIN_KEYS) + """
       THEN 'uncertain' ELSE 'reported' END AS participation_status
FROM lines""")

view("season_totals", """
SELECT a.player_id, a.team_id, a.league, a.season, a.season_type, a.category, a.metric,
       CAST(sum(CAST(a.value AS DECIMAL(18,4))) AS DOUBLE) AS total, count(DISTINCT a.game_id) AS games_with_metric
FROM additive a JOIN complete c ON c.game_id = a.game_id GROUP BY ALL""")


@query("additive_stats", "SELECT league, game_id, player_id, team_id, category, metric, value FROM additive")
def _(t):
    return op.additive_stats(t["lines"])


@query("player_season_totals", "SELECT * FROM season_totals")
def _(t):
    return op.player_season_totals(stored(t, "lines"), complete(t))


# Lines with two keys of one metric: the dashed pair comes first, and counts where it gives numbers.
view("twice_lines", """
SELECT *, CAST(game_id AS BIGINT) % 5 AS m, json_extract_string(stats_json, '$."fieldGoalsMade-fieldGoalsAttempted"') AS dashed FROM lines WHERE NOT did_not_play""")
view("twice_entries", f"""
SELECT game_id, league, season, season_type, player_id, team_id, category, 'fieldGoalAttempts' AS metric, 9.0 AS value FROM twice_lines WHERE m < 3
UNION ALL SELECT game_id, league, season, season_type, player_id, team_id, category, 'fieldGoalsMade', 7.0 FROM twice_lines
WHERE m < 3 AND NOT EXISTS (SELECT 1 FROM additive a WHERE a.metric = 'fieldGoalsMade' AND a.league = twice_lines.league AND a.game_id = twice_lines.game_id
  AND a.player_id = twice_lines.player_id AND a.category = twice_lines.category)
UNION ALL SELECT game_id, league, season, season_type, player_id, team_id, category, metric, value FROM additive""")


@query("player_season_totals_repeated", """
SELECT a.player_id, a.team_id, a.league, a.season, a.season_type, a.category, a.metric,
       CAST(sum(CAST(a.value AS DECIMAL(18,4))) AS DOUBLE) AS total, count(DISTINCT a.game_id) AS games_with_metric
FROM twice_entries a JOIN complete c ON c.game_id = a.game_id GROUP BY ALL""")
def _(t):
    """Lines that give one metric under two keys: one value a line, and one game."""
    more = F.expr("CASE WHEN CAST(game_id AS BIGINT) % 5 < 3 AND stats_json LIKE '{%' THEN concat('{\"fieldGoalsMade/fieldGoalAttempts\":\"7/9\"', "
                  "CASE WHEN stats_json = '{}' THEN '' ELSE ',' END, substr(stats_json, 2)) ELSE stats_json END")
    return op.player_season_totals(stored(t, "lines").withColumn("stats_json", more), complete(t))


@query("player_season_teams", """
SELECT DISTINCT l.league, l.season, l.season_type, l.player_id, l.team_id FROM lines l JOIN complete c ON c.game_id = l.game_id""")
def _(t):
    return op.player_season_teams(stored(t, "lines"), complete(t))


@query("participation", """
SELECT league, game_id, player_id, category, participation_status FROM line_status""")
def _(t):
    return op.participation(t["lines"]).select("league", "game_id", "player_id", "category", "participation_status")
