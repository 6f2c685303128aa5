"""Registered upsert and integrity queries."""

from pyspark.sql import functions as F

from matchday.operators import integrity, keyed_store
from matchday.operators import upsert as op
from matchday.plans.completeness_plans import stored
from matchday.plans.registry import query, view
from matchday.session import scratch_dir
from matchday.sources.fixtures import FIXTURES  # noqa: F401
from matchday.sources.tables import leagues


@query("newest_wins", """
SELECT game_id, observed_at, seq, status, home_score FROM (
  SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY observed_at DESC, batch DESC, seq DESC) AS r
  FROM (SELECT *, CASE WHEN status IN ('scheduled', 'in_progress') THEN 0 ELSE 1 END AS batch FROM snapshots)) WHERE r = 1""")
def _(t):
    early = F.col("status").isin("scheduled", "in_progress")
    return op.newest_wins(t["snapshots"].where(early), t["snapshots"].where(~early), ["game_id"], ["observed_at", "seq"])


@query("team_upsert", """
SELECT league, team_id, name, abbreviation FROM (
  SELECT *, row_number() OVER (PARTITION BY league, team_id ORDER BY seq DESC, name DESC) AS r FROM (
    SELECT league, team_id, name, abbreviation, -1 AS seq FROM league_teams
    UNION ALL SELECT league, team_id, name, abbreviation, seq FROM team_updates WHERE name <> '')) WHERE r = 1""")
def _(t):
    return op.team_upsert(t["league_teams"], t["team_updates"])


@query("team_rejects", "SELECT * FROM team_updates WHERE name = ''")
def _(t):
    return op.team_rejects(t["team_updates"])


@query("player_dim_upsert", """
SELECT league, player_id, arg_max(name, (observed_at, seq, name)) AS name, max(observed_at) AS observed_at
FROM player_observations GROUP BY league, player_id""")
def _(t):
    return op.player_dim_upsert(t["player_observations"])


JUDGED = """
WITH checked AS (
  SELECT n.league, n.game_id, n.observed_at, max(g.status) AS status, bool_and(coalesce(n.season = g.season AND n.season_type = g.season_type, false)) AS same,
         bool_or(trim(n.name) = '') AS invalid, bool_and(coalesce(n.team_id IN (g.home, g.away), false)) AS fits, count(DISTINCT n.team_id) AS teams
  FROM new_lines n LEFT JOIN games_then g ON g.league = n.league AND g.game_id = n.game_id GROUP BY n.league, n.game_id, n.observed_at),
judged AS (SELECT league, game_id, observed_at, CASE WHEN status IS NULL THEN 'unknown_game' WHEN status <> 'final' THEN 'not_final' WHEN NOT same THEN 'identity_changed'
  WHEN invalid THEN 'invalid_line' WHEN NOT fits THEN 'foreign_team' WHEN teams <> 2 THEN 'one_team'
  WHEN EXISTS (SELECT 1 FROM old_lines o WHERE o.league = c.league AND o.game_id = c.game_id AND o.observed_at > c.observed_at) THEN 'older' END AS reason FROM checked c)"""


@query("boxscore_replace", JUDGED + """,
accepted AS (SELECT * FROM judged WHERE reason IS NULL)
SELECT * FROM old_lines o WHERE NOT EXISTS (SELECT 1 FROM accepted a WHERE a.league = o.league AND a.game_id = o.game_id)
UNION ALL BY NAME SELECT * FROM new_lines n WHERE EXISTS (SELECT 1 FROM accepted a WHERE a.league = n.league AND a.game_id = n.game_id)""")
def _(t):
    return op.boxscore_replace(t["old_lines"], t["new_lines"].select(t["old_lines"].columns), t["games_then"])


@query("boxscore_refusals", JUDGED + " SELECT * FROM judged WHERE reason IS NOT NULL")
def _(t):
    return op.boxscore_refusals(t["old_lines"], t["new_lines"], t["games_then"])


@query("unknown_team_rejects", """
SELECT g.league, CAST(g.starts_at AS DATE) AS import_date, g.game_id, g.team_id
FROM (SELECT league, starts_at, game_id, home AS team_id FROM games UNION ALL SELECT league, starts_at, game_id, away FROM games) g
WHERE NOT EXISTS (SELECT 1 FROM league_teams k WHERE k.league = g.league AND k.team_id = g.team_id)""")
def _(t):
    return op.unknown_team_rejects(t["games"], t["league_teams"])


@query("accepted_games", """
WITH bad AS (SELECT DISTINCT g.league, CAST(g.starts_at AS DATE) AS d FROM games g
  WHERE NOT EXISTS (SELECT 1 FROM league_teams k WHERE k.league = g.league AND k.team_id = g.home)
     OR NOT EXISTS (SELECT 1 FROM league_teams k WHERE k.league = g.league AND k.team_id = g.away))
SELECT g.* FROM games g WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.league = g.league AND b.d = CAST(g.starts_at AS DATE))""")
def _(t):
    return op.accepted_games(t["games"], t["league_teams"])


LINE = "concat(game_id, '/', player_id, '/', category)"


@query("constraint_violations", f"""
SELECT 'game_status' AS rule, game_id AS entity FROM broken_games WHERE status NOT IN ('scheduled','in_progress','final','postponed','canceled','suspended','delayed')
UNION ALL SELECT 'score_negative', game_id FROM broken_games WHERE home_score < 0 OR away_score < 0
UNION ALL SELECT 'season_positive', game_id FROM broken_games WHERE season <= 0
UNION ALL SELECT 'season_type_positive', game_id FROM broken_games WHERE season_type <= 0
UNION ALL SELECT 'week_positive', game_id FROM broken_games WHERE week <= 0
UNION ALL SELECT 'teams_differ', game_id FROM broken_games WHERE home = away
UNION ALL SELECT 'final_scores', game_id FROM broken_games WHERE status = 'final' AND (home_score IS NULL OR away_score IS NULL)
UNION ALL SELECT 'game_unique', game_id FROM broken_games GROUP BY league, game_id HAVING count(*) > 1
UNION ALL SELECT 'category_empty', {LINE} FROM broken_lines WHERE category = ''
UNION ALL SELECT 'stats_object', {LINE} FROM broken_lines WHERE NOT CASE WHEN json_valid(stats_json) THEN json_type(stats_json) = 'OBJECT' ELSE false END
UNION ALL SELECT 'line_unique', {LINE} FROM broken_lines GROUP BY league, game_id, player_id, category HAVING count(*) > 1
UNION ALL SELECT 'line_count_positive', game_id FROM broken_imports WHERE line_count <= 0
UNION ALL SELECT 'line_game', {LINE} FROM broken_lines l WHERE NOT EXISTS (SELECT 1 FROM broken_games g WHERE g.league = l.league AND g.game_id = l.game_id)
UNION ALL SELECT 'import_game', game_id FROM broken_imports i WHERE NOT EXISTS (SELECT 1 FROM broken_games g WHERE g.league = i.league AND g.game_id = i.game_id)
UNION ALL SELECT 'game_team', game_id FROM broken_games g WHERE NOT EXISTS (SELECT 1 FROM league_teams k WHERE k.league = g.league AND k.team_id = g.home)
UNION ALL SELECT 'game_team', game_id FROM broken_games g WHERE NOT EXISTS (SELECT 1 FROM league_teams k WHERE k.league = g.league AND k.team_id = g.away)
UNION ALL SELECT 'line_team', {LINE} FROM broken_lines l WHERE NOT EXISTS (SELECT 1 FROM league_teams k WHERE k.league = l.league AND k.team_id = l.team_id)""")
def _(t):
    return op.constraint_violations(stored(t, "broken_games"), t["broken_lines"], t["broken_imports"], t["league_teams"])


# The catalogue over tables with faults: repeated teams, missing players, a league and manifests that stand twice.
view("cat_teams", "SELECT league, team_id FROM team_updates")
view("cat_players", "SELECT league, player_id FROM players WHERE CAST(player_id AS BIGINT) % 11 <> 0 UNION ALL SELECT 'XFL', player_id FROM players WHERE CAST(player_id AS BIGINT) % 401 = 0")
view("cat_dates", "SELECT league, import_date FROM headers UNION ALL SELECT league, import_date FROM headers WHERE dayofmonth(import_date) = 3")
view("cat_imports", "SELECT league, game_id, home, away FROM player_imports")
view("cat_team_imports", "SELECT league, max(team_id) AS team_id FROM team_manifest GROUP BY league")


def repeated(table, columns, rule):
    return f"SELECT '{rule}' AS rule, concat_ws('/', {columns}) AS key, count(*) AS rows FROM {table} GROUP BY {columns} HAVING count(*) > 1"


def missing(table, columns, parent, parent_columns, rule):
    on = " AND ".join(f"p.{b.strip()} = c.{a.strip()}" for a, b in zip(columns.split(","), parent_columns.split(",")))
    picked = ", ".join(f"c.{a.strip()}" for a in columns.split(","))
    return (f"SELECT '{rule}' AS rule, concat_ws('/', {picked}) AS key, count(*) AS rows FROM {table} c "
            f"WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE {on}) GROUP BY {picked}")


SIDES = "(SELECT league, home AS team_id FROM {0} UNION ALL SELECT league, away FROM {0})"
LEAGUE_LIST = "(SELECT unnest(['NBA', 'NFL']) AS abbreviation)"


@query("catalogue_violations", " UNION ALL ".join([
    repeated("cat_teams", "league, team_id", "team_unique"), repeated("broken_games", "league, game_id", "game_unique"),
    repeated("cat_players", "league, player_id", "player_unique"), repeated("broken_lines", "league, game_id, player_id, category", "line_unique"),
    repeated("cat_imports", "league, game_id", "import_unique"), repeated("cat_dates", "league, import_date", "date_import_unique"),
    missing("cat_players", "league", LEAGUE_LIST, "abbreviation", "player_league"), missing("cat_teams", "league", LEAGUE_LIST, "abbreviation", "team_league"),
    missing(SIDES.format("broken_games"), "league, team_id", "cat_teams", "league, team_id", "game_team"),
    missing(SIDES.format("cat_imports"), "league, team_id", "cat_teams", "league, team_id", "import_team"),
    missing("broken_lines", "league, team_id", "cat_teams", "league, team_id", "line_team"),
    missing("broken_lines", "league, player_id", "cat_players", "league, player_id", "line_player"),
    missing("broken_lines", "league, game_id", "broken_games", "league, game_id", "line_game"),
    missing("cat_imports", "league, game_id", "broken_games", "league, game_id", "import_game"),
    "SELECT 'team_import_empty' AS rule, league AS key, 1::BIGINT AS rows FROM cat_team_imports WHERE league = 'NFL'"]))
def _(t):
    stored(t, "games")
    t.share("player_imports")  # four keys and references read it
    n = F.col("player_id").cast("bigint")
    players = t["players"].select("league", "player_id")
    dates = t["headers"].select("league", "import_date")
    manifests = t["team_manifest"].groupBy("league").agg(F.max("team_id").alias("team_id")).select(
        "league", F.when(F.col("league") == "NFL", F.array().cast("array<string>")).otherwise(F.array("team_id")).alias("external_ids"))
    return integrity.catalogue_violations({
        "leagues": leagues(t.spark), "teams": t["team_updates"], "games": t["broken_games"], "lines": t["broken_lines"],
        "players": players.where(n % 11 != 0).unionByName(players.where(n % 401 == 0).withColumn("league", F.lit("XFL"))),
        "imports": t["player_imports"], "team_imports": manifests,
        "date_imports": dates.unionByName(dates.where(F.dayofmonth("import_date") == 3))})


@query("stored_newest_wins", """
SELECT game_id, observed_at, seq, status, home_score FROM (
  SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY observed_at DESC, seq DESC) AS r FROM snapshots) WHERE r = 1""")
def _(t):
    """The snapshots in three batches, each merged into the stored buckets that it touches."""
    path, order = scratch_dir(t.spark), ["observed_at", "seq"]
    snapshots = t["snapshots"].select("game_id", "observed_at", "seq", "status", "home_score")
    for part in range(3):
        batch = snapshots.where(F.col("seq") % 3 == part)
        keyed_store.add(path, batch, keys=["game_id"], order=order, merge_every=1, buckets=8)
    return op.newest(keyed_store.read(t.spark, path), ["game_id"], order).drop("batch_id")


@query("range_dedup", """
SELECT window_id, game_id, import_date, status, home_score, CAST(first_seq AS BIGINT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY window_id, game_id ORDER BY import_date DESC, seq DESC) AS r,
         first_value(seq) OVER (PARTITION BY window_id, game_id ORDER BY import_date, seq) AS first_seq FROM daily_games) WHERE r = 1""")
def _(t):
    from matchday.sources.scoreboard import range_dedup
    return range_dedup(t["daily_games"], ["window_id", "game_id"]).select(
        "window_id", "game_id", "import_date", "status", "home_score", F.col("position.seq").alias("position"))
