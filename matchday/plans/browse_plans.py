"""Registered browse queries (R1-R8) and the scoped snapshot."""

from pyspark.sql import functions as F

from matchday.operators import browse as op
from matchday.operators import player_stats
from matchday.plans.completeness_plans import complete, stored
from matchday.plans.registry import query, view
from matchday.sources.tables import leagues, scope_read

SCOPE = {"league": "NFL", "season": 1998}

view("b_games", """
SELECT g.league, g.season, g.season_type, g.game_id, g.starts_at, g.status, g.week, h.name AS home_team, a.name AS away_team,
       g.home_score, g.away_score, EXISTS (SELECT 1 FROM complete c WHERE c.game_id = g.game_id) AS player_stats_complete, g.home, g.away
FROM games g JOIN teams h ON h.team_id = g.home JOIN teams a ON a.team_id = g.away""")
B_GAMES = "league, season, season_type, game_id, starts_at, status, week, home_team, away_team, home_score, away_score, player_stats_complete"

view("b_player_games", """
SELECT l.league, l.season, l.season_type, l.player_id, p.name AS player, l.game_id, c.starts_at, t.name AS team, l.category,
       'G' AS position, CAST(CAST(l.player_id AS BIGINT) % 90 AS VARCHAR) AS jersey, l.did_not_play, l.starter, l.stats_json AS stats, l.team_id
FROM lines l JOIN complete c ON c.league = l.league AND c.game_id = l.game_id
JOIN players p ON p.league = l.league AND p.player_id = l.player_id JOIN teams t ON t.team_id = l.team_id""")
B_PLAYER_GAMES = "league, season, season_type, player_id, player, game_id, starts_at, team, category, position, jersey, did_not_play, starter, stats"


def b_games(t, **f):
    return op.browse_games(stored(t, "games"), t["teams_by_league"], complete(t), **{"league": None, "season": None, "season_type": None, **f})


def worn(t):
    """Lines with the position and jersey that a box score gives."""
    return stored(t, "lines").withColumns({"position": F.lit("G"), "jersey": (F.col("player_id").cast("bigint") % 90).cast("string")})


def b_player_games(t, **f):
    return op.browse_player_games(worn(t), complete(t), t["teams_by_league"], t["players"],
                                  **{"league": None, "season": None, "season_type": None, **f})


def b_players(t, **f):
    return op.browse_players(stored(t, "lines"), complete(t), t["teams_by_league"], t["players"],
                             **{"league": None, "season": None, "season_type": None, **f})


@query("browse_leagues", """
SELECT * FROM (VALUES ('National Basketball Association', 'NBA', 'Basketball'), ('National Football League', 'NFL', 'Football')) v(name, abbreviation, sport)
WHERE abbreviation IN (SELECT league FROM games)""")
def _(t):
    # The league list is restricted to leagues with stored games.
    used = t["games"].select(F.col("league").alias("abbreviation")).distinct()
    return op.browse_leagues(leagues(t.spark).join(used, "abbreviation"))


@query("browse_seasons", """
SELECT league, season, season_type, count(*) AS games, count(*) FILTER (WHERE status = 'final') AS final_games,
       min(starts_at) AS first_game, max(starts_at) AS last_game FROM games GROUP BY ALL""")
def _(t):
    return op.browse_seasons(t["games"])


@query("browse_teams", """
SELECT DISTINCT g.league, g.season, g.season_type, t.team_id, t.name FROM games g JOIN teams t ON t.team_id = g.home OR t.team_id = g.away""")
def _(t):
    return op.browse_teams(t["games"], t["teams_by_league"], season_type=None)


@query("browse_games", f"SELECT {B_GAMES} FROM b_games")
def _(t):
    return b_games(t)


@query("browse_games_filtered", f"""
SELECT {B_GAMES} FROM b_games WHERE league = 'NFL' AND season = 1998 AND season_type = 2 AND status = 'final' AND (home = '7' OR away = '7')""")
def _(t):
    return b_games(t, **SCOPE, season_type=2, team_id="7", status="final")


PLAYERS = """
SELECT league, season, season_type, player_id, player AS name, count(DISTINCT game_id) AS games,
       string_agg(DISTINCT team, ', ' ORDER BY team) AS teams FROM b_player_games {where} GROUP BY ALL"""


@query("browse_players", PLAYERS.format(where=""))
def _(t):
    return b_players(t)


@query("browse_players_search", PLAYERS.format(where="WHERE contains(lower(player), lower('Blue'))"))
def _(t):
    return b_players(t, search="Blue ")


@query("browse_player_games", f"SELECT {B_PLAYER_GAMES} FROM b_player_games")
def _(t):
    return b_player_games(t)


FILTERED = "league = 'NFL' AND season = 1998 AND category = 'passing'"


@query("browse_players_filtered", PLAYERS.format(where=f"WHERE {FILTERED}"))
def _(t):
    return b_players(t, **SCOPE, category="passing")


@query("browse_player_games_filtered", f"""
SELECT {B_PLAYER_GAMES} FROM b_player_games WHERE {FILTERED} AND contains(lower(player), 'blue')""")
def _(t):
    return b_player_games(t, **SCOPE, category="passing", search=" BLUE")


@query("browse_player", f"SELECT {B_PLAYER_GAMES} FROM b_player_games WHERE player_id = '7'")
def _(t):
    return b_player_games(t, player_id="7")


@query("page_seasons", """
SELECT league, season, season_type, count(*) AS games, count(*) FILTER (WHERE status = 'final') AS final_games,
       min(starts_at) AS first_game, max(starts_at) AS last_game FROM games GROUP BY ALL ORDER BY season DESC, season_type, league LIMIT 5 OFFSET 2""")
def _(t):
    return op.resource_page(op.browse_seasons(t["games"]), "seasons", 5, 2)[1]


@query("page_teams", """
SELECT DISTINCT g.league, g.season, g.season_type, t.team_id, t.name FROM games g JOIN teams t ON t.team_id = g.home OR t.team_id = g.away
ORDER BY t.name, t.team_id, g.league, g.season, g.season_type LIMIT 20 OFFSET 11""")
def _(t):
    return op.resource_page(op.browse_teams(t["games"], t["teams_by_league"], season_type=None), "teams", 20, 11)[1]


@query("page_players", PLAYERS.format(where="") + " ORDER BY name, player_id, league, season, season_type LIMIT 25 OFFSET 40")
def _(t):
    return op.resource_page(b_players(t), "players", 25, 40)[1]


@query("page_player_games", f"""
SELECT {B_PLAYER_GAMES} FROM b_player_games ORDER BY starts_at DESC, game_id, player_id, category, league, season, season_type LIMIT 100 OFFSET 30""")
def _(t):
    return op.resource_page(b_player_games(t), "player_games", 100, 30)[1]


@query("browse_totals", """
SELECT v.league, v.season, v.season_type, v.player_id, p.name AS player, v.team_id, t.name AS team, v.category, v.metric, v.total, v.games_with_metric
FROM season_totals v JOIN players p ON p.league = v.league AND p.player_id = v.player_id JOIN teams t ON t.team_id = v.team_id""")
def _(t):
    totals = player_stats.player_season_totals(stored(t, "lines"), complete(t))
    return op.browse_totals(totals, t["teams_by_league"], t["players"], season_type=None)



def ordered_page(t, limit=25, offset=50):
    return op.page(b_games(t), [F.desc("starts_at"), F.asc("game_id")], limit, offset)


@query("page", f"SELECT {B_GAMES} FROM b_games ORDER BY starts_at DESC, game_id LIMIT 25 OFFSET 50")
def _(t):
    return ordered_page(t)[1]


@query("page_total", "SELECT count(*) AS total FROM b_games")
def _(t):
    return ordered_page(t)[0]


@query("page_past_end", f"SELECT {B_GAMES} FROM b_games ORDER BY starts_at DESC, game_id LIMIT 100 OFFSET 1000000")
def _(t):
    return ordered_page(t, 100, 1_000_000)[1]


def snapshot(t):
    return scope_read(stored(t, "games"), worn(t), t["manifest_ids"], t["headers"], complete(t), t["scopes"], t["players"])


@query("scope_read_games", """
SELECT g.league, g.season, g.season_type, g.game_id, g.starts_at, g.home, g.away, g.status, g.home_score, g.away_score, g.week,
       EXISTS (SELECT 1 FROM complete c WHERE c.game_id = g.game_id) AS players_complete FROM games g""")
def _(t):
    return snapshot(t).games


@query("scope_read_players", f"""
SELECT l.league, l.season, l.season_type, l.game_id, l.player_id, p.name, l.team_id, l.category, 'G' AS position,
       CAST(CAST(l.player_id AS BIGINT) % 90 AS VARCHAR) AS jersey, l.did_not_play, l.starter, l.stats_json
FROM lines l JOIN complete c ON c.league = l.league AND c.game_id = l.game_id JOIN players p ON p.league = l.league AND p.player_id = l.player_id""")
def _(t):
    return snapshot(t).players


@query("scope_read_dates", "SELECT league, import_date FROM headers h WHERE EXISTS (SELECT 1 FROM scopes s WHERE s.league = h.league)")
def _(t):
    return snapshot(t).import_dates


@query("scope_read_missing", """
SELECT DISTINCT s.league, s.season, s.season_type, m.game_id
FROM manifest_ids m JOIN scopes s ON s.league = m.league AND m.import_date BETWEEN s.date_from AND s.date_to
WHERE NOT EXISTS (SELECT 1 FROM games g WHERE g.league = m.league AND g.game_id = m.game_id)""")
def _(t):
    return snapshot(t).missing_ids
