"""Registered audit queries (Q1-Q14)."""

from pyspark.sql import functions as F

from matchday.operators import audit as op
from matchday.operators import completeness as done
from matchday.plans.completeness_plans import complete
from matchday.plans.player_plans import UNCERTAIN_KEYS
from matchday.plans.registry import query, view

K = "league, season, season_type"


def audit_input(t) -> op.AuditInput:
    """The stored tables, written once: every rule reads the same version of them."""
    t.share("games")
    t.share("lines")
    return op.AuditInput(t["scopes"], t["stored_games"], t["stored_lines"], t["headers"], t["manifest_ids"],
                         complete(t), t["replacements"])


view("resolved", """
SELECT o.league, o.season, o.season_type, o.game_id, f.game_id AS final_id
FROM stored_games o JOIN replacements r ON r.league = o.league AND r.season = o.season AND r.postponed_id = o.game_id
JOIN stored_games f ON f.game_id = r.final_id AND f.league = o.league AND f.season = o.season AND f.season_type = o.season_type
JOIN complete c ON c.game_id = f.game_id
WHERE o.league = 'NBA' AND o.season_type = 2 AND o.status = 'postponed' AND f.status = 'final' AND f.home = o.home
  AND f.away = o.away AND f.starts_at > o.starts_at AND f.home_score IS NOT NULL AND f.away_score IS NOT NULL""")

view("audit_lines", """
SELECT l.*, json_valid(l.stats_json) AND CASE WHEN json_valid(l.stats_json) THEN json_type(l.stats_json) = 'OBJECT' ELSE false END AS is_object,
       concat(l.game_id, '/', l.player_id, '/', l.category) AS base
FROM stored_lines l JOIN complete c ON c.game_id = l.game_id WHERE NOT l.did_not_play""")

view("audit_entries", """
SELECT *, json_type(stats_json, concat('$."', key, '"')) AS kind, json_extract_string(stats_json, concat('$."', key, '"')) AS raw
FROM (SELECT *, unnest(json_keys(stats_json)) AS key FROM audit_lines WHERE is_object)""")

view("bad_lines", """
SELECT league, season, season_type, base FROM audit_lines l
WHERE NOT is_object OR NOT EXISTS (SELECT 1 FROM audit_entries e WHERE e.base = l.base)
  OR EXISTS (SELECT 1 FROM audit_entries e WHERE e.base = l.base AND e.kind NOT IN ('VARCHAR', 'NULL'))""")

view("uncertain_lines", """
SELECT l.league, l.season, l.season_type, l.base FROM audit_lines l JOIN (
  SELECT base, count(*) AS n, count(*) FILTER (WHERE (key = 'minutes' AND raw = '--') OR (key IN (""" + ", ".join(
    f"'{k}'" for k in UNCERTAIN_KEYS) + """) AND raw = CASE WHEN contains(key, '-') THEN '0-0' ELSE '0' END)) AS hits
  FROM audit_entries GROUP BY base) e ON e.base = l.base
WHERE l.league = 'NBA' AND l.category = 'general' AND l.starter = false AND e.n = 14 AND e.hits = 14""")

CHECKED = """
FROM audit_entries e WHERE NOT EXISTS (SELECT 1 FROM bad_lines b WHERE b.base = e.base)
  AND NOT EXISTS (SELECT 1 FROM uncertain_lines u WHERE u.base = e.base)"""
QBR = "e.league = 'NFL' AND e.category = 'passing' AND e.key = 'adjQBR' AND e.raw = '--'"

SQLS = {
    "no_games": f"""
SELECT {K}, 'No games stored for the requested season and season type.' AS detail FROM scopes s
WHERE NOT EXISTS (SELECT 1 FROM stored_games g WHERE g.league = s.league AND g.season = s.season AND g.season_type = s.season_type)""",
    "missing_game_row": """
SELECT DISTINCT s.league, s.season, s.season_type, concat(m.game_id, ': present in an expected date import but absent from games') AS detail
FROM manifest_ids m JOIN scopes s ON s.league = m.league AND m.import_date BETWEEN s.date_from AND s.date_to
WHERE NOT EXISTS (SELECT 1 FROM stored_games g WHERE g.league = m.league AND g.game_id = m.game_id)""",
    "non_final_game": f"""
SELECT {K}, concat(game_id, ': ', status) AS detail FROM stored_games g
WHERE status <> 'final' AND NOT EXISTS (SELECT 1 FROM resolved r WHERE r.game_id = g.game_id)""",
    "resolved_postponement": f"SELECT {K}, concat(game_id, ' -> ', final_id) AS detail FROM resolved",
    "missing_score": f"""
SELECT {K}, game_id AS detail FROM stored_games WHERE status = 'final' AND (home_score IS NULL OR away_score IS NULL)""",
    "missing_player_import": f"""
SELECT {K}, game_id AS detail FROM stored_games g
WHERE status = 'final' AND NOT EXISTS (SELECT 1 FROM complete c WHERE c.game_id = g.game_id)""",
    "invalid_player_stats": f"SELECT {K}, base AS detail FROM bad_lines",
    "uncertain_participation": f"SELECT {K}, concat(base, '/minutes') AS detail FROM uncertain_lines",
    "unavailable_adjusted_qbr": f"SELECT {K}, concat(e.base, '/', e.key) AS detail {CHECKED} AND {QBR}",
    "missing_player_stat_value": f"""
SELECT {K}, concat(e.base, '/', e.key) AS detail {CHECKED} AND NOT coalesce({QBR}, false)
  AND (e.raw IS NULL OR trim(e.raw) = '' OR e.raw IN ('--', 'NaN', 'Infinity'))""",
    "unchecked_dates": f"""
SELECT {K}, 'Supply a date range to check expected import dates.' AS detail FROM scopes WHERE date_from IS NULL""",
    "missing_import_dates": f"""
SELECT {K}, concat(CAST(count(*) AS VARCHAR), ' expected dates have no successful scoreboard import') AS detail FROM scope_days d
WHERE NOT EXISTS (SELECT 1 FROM headers h WHERE h.league = d.league AND h.import_date = d.import_date) GROUP BY {K}""",
}

for _code, _sql in SQLS.items():
    view(f"audit_{_code}", f"SELECT {K}, '{op.CODES[_code]}' AS severity, '{_code}' AS code, detail FROM ({_sql})")
    query(f"audit_{_code}", f"SELECT * FROM audit_{_code}")(lambda t, c=_code: op.by_code(audit_input(t), c))

view("audit_all", " UNION ALL ".join(f"SELECT * FROM audit_{c}" for c in SQLS))


@query("audit_issues", "SELECT * FROM audit_all")
def _(t):
    return op.audit_issues(audit_input(t))


REPORT = f"""
SELECT s.league, s.season, s.season_type,
  coalesce(g.stored, 0) AS stored_games, coalesce(g.finals, 0) AS final_games, coalesce(g.complete, 0) AS complete_player_games,
  coalesce(l.n, 0) AS player_category_rows, coalesce(i.issues, 0) AS issues, coalesce(i.warnings, 0) AS warnings,
  coalesce(m.missing, 0) AS missing_import_dates, coalesce(i.issues, 0) = 0 AS ready_for_export
FROM scopes s
LEFT JOIN (SELECT g.league, g.season, g.season_type, count(*) AS stored, count(*) FILTER (WHERE g.status = 'final') AS finals,
           count(*) FILTER (WHERE g.status = 'final' AND c.game_id IS NOT NULL) AS complete
           FROM stored_games g LEFT JOIN complete c ON c.game_id = g.game_id GROUP BY ALL) g
  ON g.league = s.league AND g.season = s.season AND g.season_type = s.season_type
LEFT JOIN (SELECT l.league, l.season, l.season_type, count(*) AS n FROM stored_lines l JOIN complete c ON c.game_id = l.game_id GROUP BY ALL) l
  ON l.league = s.league AND l.season = s.season AND l.season_type = s.season_type
LEFT JOIN (SELECT {K}, count(*) FILTER (WHERE severity = 'issue') AS issues, count(*) FILTER (WHERE severity = 'warning') AS warnings
           FROM audit_all GROUP BY {K}) i
  ON i.league = s.league AND i.season = s.season AND i.season_type = s.season_type
LEFT JOIN (SELECT {K}, count(*) AS missing FROM scope_days d
           WHERE NOT EXISTS (SELECT 1 FROM headers h WHERE h.league = d.league AND h.import_date = d.import_date) GROUP BY {K}) m
  ON m.league = s.league AND m.season = s.season AND m.season_type = s.season_type"""
view("reports", REPORT)


@query("audit_report", "SELECT * FROM reports")
def _(t):
    return op.audit_report(audit_input(t))


# Scope requests with every kind of fault, one per stored game: the request asks for the game's week.
REQUESTS = """
SELECT DISTINCT CASE WHEN week = 7 THEN 'MLB' ELSE league END AS league,
       CAST(CASE WHEN week = 9 THEN season - 200 WHEN week = 11 THEN season + 300 ELSE season END AS INT) AS season,
       CAST(CASE WHEN week = 13 THEN 1 ELSE 2 + week % 2 END AS INT) AS season_type,
       CASE WHEN week <> 15 THEN make_date(season, 1, 1) END AS date_from,
       CASE WHEN week = 17 THEN make_date(season - 1, 12, 31) WHEN week = 19 THEN make_date(season + 1, 1, 3)
            WHEN week <> 21 THEN make_date(season, 12, 31) END AS date_to
FROM {games}"""
view("requests", REQUESTS.format(games="games"))


@query("scope_valid", """
SELECT *, reason IS NULL AS valid FROM (
SELECT *, CASE WHEN league NOT IN ('NBA', 'NFL') THEN 'league' WHEN season < 1900 OR season > 2200 THEN 'season'
  WHEN season_type NOT IN (2, 3) THEN 'season_type'
  WHEN (date_from IS NOT NULL OR date_to IS NOT NULL) AND (date_from IS NULL OR date_to IS NULL OR date_to < date_from OR date_to - date_from > 366) THEN 'dates' END AS reason
FROM requests)""")
def _(t):
    return op.scope_valid(t.spark.sql(REQUESTS, games=t["games"]))
