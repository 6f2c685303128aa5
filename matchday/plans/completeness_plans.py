"""Registered completeness queries."""

from matchday.operators import completeness as op
from matchday.plans.registry import query, view

view("date_flags", """
SELECT h.league, h.import_date,
       coalesce(bool_and(g.game_id IS NOT NULL AND g.status = 'final' AND g.home_score IS NOT NULL AND g.away_score IS NOT NULL)
                FILTER (WHERE m.game_id IS NOT NULL), false) AS complete
FROM headers h LEFT JOIN manifest_ids m ON m.league = h.league AND m.import_date = h.import_date
LEFT JOIN stored_games g ON g.league = m.league AND g.game_id = m.game_id
GROUP BY h.league, h.import_date""")

view("scope_days", """
SELECT league, season, season_type, CAST(unnest(generate_series(CAST(date_from AS TIMESTAMP), CAST(date_to AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS import_date
FROM scopes WHERE date_from IS NOT NULL""")

COMPLETE = "complete"


def stored(t, name):
    """A view over the games and lines as written; asked for before they are written, it would derive them again."""
    t.share("games")
    t.share("lines")
    return t[name]


def complete(t):
    """Complete games over the stored tables: games, lines and the complete games are read several times,
    so they are written once, as they would be in a deployment."""
    if "complete" not in t.shared:
        stored(t, "games")
        t.share("complete", op.complete_games(t["games"], t["player_imports"], t["lines"]))
    return t["complete"]


@query("date_complete", "SELECT * FROM date_flags")
def _(t):
    return op.date_complete(t["headers"], t["manifest_ids"], t["stored_games"])


@query("teams_imported", """
SELECT m.league, bool_and(k.team_id IS NOT NULL) AS complete
FROM team_manifest m LEFT JOIN league_teams k ON k.league = m.league AND k.team_id = m.team_id GROUP BY m.league""")
def _(t):
    return op.teams_imported(t["team_manifest"], t["league_teams"])


@query("complete_games", "SELECT league, season, season_type, game_id FROM complete")
def _(t):
    return complete(t).select("league", "season", "season_type", "game_id")


@query("missing_game_rows", """
SELECT DISTINCT s.league, s.season, s.season_type, m.game_id
FROM manifest_ids m JOIN scopes s ON s.league = m.league AND m.import_date BETWEEN s.date_from AND s.date_to
WHERE NOT EXISTS (SELECT 1 FROM games g WHERE g.league = m.league AND g.game_id = m.game_id)""")
def _(t):
    return op.missing_game_rows(t["scopes"], t["manifest_ids"], t["games"])


@query("missing_import_dates", """
SELECT d.* FROM scope_days d
WHERE NOT EXISTS (SELECT 1 FROM headers h WHERE h.league = d.league AND h.import_date = d.import_date)""")
def _(t):
    return op.missing_import_dates(t["scopes"], t["headers"])


@query("season_coverage", """
SELECT g.league, g.season, g.season_type, count(*) AS stored_final_games, count(c.game_id) AS imported_player_games
FROM games g LEFT JOIN complete c ON c.game_id = g.game_id WHERE g.status = 'final' GROUP BY ALL""")
def _(t):
    return op.season_coverage(stored(t, "games"), complete(t))


@query("pending_dates", """
SELECT DISTINCT d.league, d.import_date FROM scope_days d
WHERE NOT EXISTS (SELECT 1 FROM date_flags f WHERE f.league = d.league AND f.import_date = d.import_date AND f.complete)""")
def _(t):
    return op.pending_dates(op.expected_days(t["scopes"]), t["headers"], t["manifest_ids"], t["stored_games"])


@query("pending_games", """
SELECT g.league, g.season, g.season_type, g.game_id, g.starts_at, g.home, g.away FROM games g
WHERE g.status = 'final' AND NOT EXISTS (SELECT 1 FROM complete c WHERE c.game_id = g.game_id)""")
def _(t):
    return op.pending_games(stored(t, "games"), complete(t))


@query("import_progress", """
SELECT f.league, count(*) FILTER (WHERE NOT f.complete) AS dates_processed, count(*) FILTER (WHERE f.complete) AS dates_skipped,
       CAST(coalesce(sum(CASE WHEN NOT f.complete THEN n END), 0) AS BIGINT) AS games_processed
FROM date_flags f LEFT JOIN (SELECT league, import_date, count(*) AS n FROM manifest_ids GROUP BY ALL) m
  ON m.league = f.league AND m.import_date = f.import_date GROUP BY f.league""")
def _(t):
    return op.import_progress(t["headers"], t["manifest_ids"], t["stored_games"])
