"""Registered export-validation queries."""

from matchday.operators import export_rules as op
from matchday.plans.completeness_plans import stored
from matchday.plans.registry import query, view

R = "report_league, report_season, report_season_type"
ON = "{a}.report_league = {b}.report_league AND {a}.report_season = {b}.report_season AND {a}.report_season_type = {b}.report_season_type"
LINE = "concat(p.game_id, '/', p.player_id, '/', p.category)"
GAMES_ON = ON.format(a="g", b="p") + " AND g.game_id = p.game_id"

SQLS = {
    "V1": """
SELECT league AS report_league, season AS report_season, season_type AS report_season_type, 'report' AS detail FROM export_reports
WHERE NOT (schema_version IN (3, 4) AND ready_for_export AND issues = 0 AND missing_import_dates = 0)""",
    "V2": f"""
SELECT {R}, game_id AS detail FROM export_games
WHERE league <> report_league OR season <> CAST(report_season AS VARCHAR) OR season_type <> CAST(report_season_type AS VARCHAR)
   OR player_import_complete <> 'true'""",
    "V3": f"""
SELECT {R}, game_id AS detail FROM export_games
WHERE NOT ends_with(starts_at_utc, 'Z') OR NOT regexp_full_match(home_score, '[0-9]+') OR NOT regexp_full_match(away_score, '[0-9]+')
   OR (week <> '' AND NOT (regexp_full_match(week, '[0-9]+') AND CAST(week AS INT) > 0))""",
    "V4": f"""
SELECT {R}, game_id AS detail FROM export_games WHERE game_id = '' OR home_team_id = '' OR away_team_id = '' OR home_team_id = away_team_id
UNION ALL SELECT {R}, concat('duplicate ', game_id) FROM export_games GROUP BY {R}, game_id HAVING count(*) > 1""",
    "V5": f"SELECT {R}, game_id AS detail FROM export_games WHERE report_league = 'NBA' AND home_score = away_score",
    "V6": f"""
SELECT r.league AS report_league, r.season AS report_season, r.season_type AS report_season_type, 'counts' AS detail
FROM export_reports r
LEFT JOIN (SELECT {R}, count(*) AS n FROM export_games GROUP BY {R}) g ON g.report_league = r.league AND g.report_season = r.season AND g.report_season_type = r.season_type
LEFT JOIN (SELECT {R}, count(*) AS n FROM export_players GROUP BY {R}) p ON p.report_league = r.league AND p.report_season = r.season AND p.report_season_type = r.season_type
WHERE coalesce(g.n, 0) = 0 OR g.n <> r.final_games OR g.n <> r.complete_player_games OR coalesce(p.n, 0) <> r.player_category_rows""",
    "V7": f"""
SELECT {R}, {LINE} AS detail FROM export_players p
WHERE NOT EXISTS (SELECT 1 FROM export_games g WHERE {GAMES_ON} AND p.team_id IN (g.home_team_id, g.away_team_id))""",
    "V8": f"""
SELECT {R}, {LINE} AS detail FROM export_players p WHERE game_id = '' OR player_id = '' OR category = '' OR trim(player_name) = ''
UNION ALL SELECT {R}, concat('duplicate ', {LINE}) FROM export_players p GROUP BY {R}, game_id, player_id, category HAVING count(*) > 1""",
    "V9": f"""
SELECT {R}, {LINE} AS detail FROM export_players p
WHERE did_not_play NOT IN ('true', 'false') OR starter NOT IN ('', 'true', 'false')
   OR participation_status NOT IN ('reported', 'uncertain', 'did_not_play')
   OR (participation_status = 'did_not_play') <> (did_not_play = 'true')""",
    "V10": f"""
SELECT {R}, {LINE} AS detail FROM (SELECT *, CASE WHEN json_valid(stats_json) THEN json_type(stats_json) = 'OBJECT' ELSE false END AS obj FROM export_players) p
WHERE CASE WHEN obj THEN len(list_filter(json_keys(stats_json), lambda k: json_type(stats_json, concat('$."', k, '"')) <> 'VARCHAR')) > 0 ELSE true END""",
    "V11": f"""
SELECT {R}, game_id AS detail FROM (SELECT DISTINCT {R}, game_id FROM export_games) g
WHERE (SELECT count(DISTINCT p.team_id) FROM export_players p WHERE {GAMES_ON}) < 2""",
}


def exported(t, rule=None):
    """The three tables; rules that read no players leave the lines unwritten."""
    if rule not in ("V1", "V2", "V3", "V5"):
        stored(t, "games")
    return t["export_reports"], t["export_games"], t["export_players"]


for _rule, _sql in SQLS.items():
    view(f"rule_{_rule}", f"SELECT {R}, '{_rule}' AS rule, detail FROM ({_sql})")
    query(f"export_rule_{_rule}", f"SELECT * FROM rule_{_rule}")(
        lambda t, r=_rule: op.by_rule(r, *exported(t, r)))


@query("export_violations", " UNION ALL ".join(f"SELECT * FROM rule_{r}" for r in SQLS))
def _(t):
    return op.export_violations(*exported(t))
