"""Registered decoder queries (S1-S8), import manifests (U5) and box-score progress."""

from pyspark.sql import functions as F

from matchday.functions import expr
from matchday.functions.domain import KEY
from matchday.operators import completeness, upsert
from matchday.plans.completeness_plans import complete
from matchday.plans.registry import query, view
from matchday.sources import boxscore, raw_fixtures, scoreboard, team_list

view("sb_events", """
SELECT g.*, CAST(g.game_id AS BIGINT) AS n, CAST(g.game_id AS BIGINT) // 10 AS bucket,
       concat(g.league, '-', CAST(g.game_id AS BIGINT) // 10) AS response_id,
       CASE WHEN CAST(g.game_id AS BIGINT) % 15 = 5 THEN 'All-Star exhibition' WHEN CAST(g.game_id AS BIGINT) % 12 = 0 THEN 'preseason' END AS skip
FROM games g""")
view("sb_judged", """
SELECT *, CASE WHEN n % 151 = 0 THEN 'invalid_event' WHEN skip IS NOT NULL THEN NULL WHEN n % 101 = 0 THEN 'bad_start'
  WHEN n % 103 = 0 THEN 'unsupported_status' WHEN league = 'NFL' AND n % 139 = 0 THEN 'bad_week' WHEN n % 127 = 0 THEN 'competitor_count'
  WHEN n % 131 = 0 THEN 'missing_team' WHEN status = 'final' AND n % 107 = 0 THEN 'bad_score' WHEN status = 'final' AND n % 149 = 0 THEN 'final_score_missing'
  WHEN n % 109 = 0 THEN 'home_away' WHEN n % 113 = 0 THEN 'same_team' END AS reason
FROM sb_events""")
view("sb_responses", """
SELECT league, bucket, response_id, CAST(min(starts_at) AS DATE) AS import_date,
       CASE WHEN bucket % 11 = 0 OR bucket % 19 = 0 OR (bucket % 17 <> 0 AND (bucket % 23 = 0 OR bucket % 29 = 0 AND bool_or(n % 107 <> 0 OR n % 149 <> 0 AND n % 127 <> 0))) THEN 'bad_json' WHEN bucket % 13 = 0 THEN 'league_not_identified' WHEN bucket % 17 = 0 THEN 'events_missing'
            WHEN bool_or(n % 137 = 0) THEN 'duplicate_event' END AS whole, bool_or(reason IS NOT NULL) AS bad
FROM sb_judged GROUP BY league, bucket, response_id""")
view("sb_accepted", """
SELECT *, CAST(import_date AS TIMESTAMP) + to_hours(CAST(bucket % 24 AS INT)) AS observed_at FROM sb_responses WHERE whole IS NULL AND NOT bad""")


def raw_scoreboards(t):
    return raw_fixtures.scoreboards(t["games"])


@query("scoreboard_decode", """
SELECT e.league, e.game_id, e.season, e.season_type, e.starts_at, e.status,
       CASE WHEN e.league = 'NFL' THEN e.week END AS week, e.home, e.away, e.home_score, e.away_score, r.observed_at, r.import_date, e.response_id
FROM sb_judged e JOIN sb_accepted r ON r.response_id = e.response_id WHERE e.skip IS NULL""")
def _(t):
    return scoreboard.scoreboard_decode(raw_scoreboards(t))


@query("scoreboard_rejects", """
SELECT response_id, league, whole AS reason FROM sb_responses WHERE whole IS NOT NULL
UNION ALL SELECT DISTINCT e.response_id, e.league, e.reason FROM sb_judged e JOIN sb_responses r ON r.response_id = e.response_id
WHERE r.whole IS NULL AND e.reason IS NOT NULL""")
def _(t):
    return scoreboard.scoreboard_rejects(raw_scoreboards(t))


@query("exhibition_filter", """
SELECT e.response_id, e.league, e.game_id, e.skip AS reason FROM sb_judged e JOIN sb_responses r ON r.response_id = e.response_id,
  (SELECT unnest([1, 2]) AS copy) c
WHERE e.skip IS NOT NULL AND e.n % 151 <> 0 AND r.whole IS DISTINCT FROM 'bad_json' AND r.bucket % 17 <> 0 AND (copy = 1 OR e.n % 137 = 0)""")
def _(t):
    return scoreboard.exhibition_skips(raw_scoreboards(t))


STATUS = """
SELECT event_id, CASE WHEN name = 'STATUS_POSTPONED' THEN 'postponed' WHEN name IN ('STATUS_CANCELED', 'STATUS_CANCELLED') THEN 'canceled'
  WHEN name = 'STATUS_SUSPENDED' THEN 'suspended' WHEN name = 'STATUS_DELAYED' THEN 'delayed' WHEN completed AND state = 'post' THEN 'final'
  WHEN state = 'in' THEN 'in_progress' WHEN name = 'STATUS_SCHEDULED' AND state = 'pre' THEN 'scheduled' END AS status
FROM status_inputs"""
# The fixture cycles through names, states and completion by event id and type.
view("status_inputs", """
SELECT event_id, CASE event_type WHEN 'signup' THEN 'STATUS_SCHEDULED' WHEN 'view' THEN 'STATUS_POSTPONED' WHEN 'purchase' THEN 'STATUS_FINAL'
  WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'STATUS_CANCELED' WHEN 1 THEN 'STATUS_CANCELLED' WHEN 2 THEN 'STATUS_SUSPENDED' ELSE 'STATUS_DELAYED' END
  ELSE 'STATUS_OTHER' END AS name, CASE event_id % 3 WHEN 0 THEN 'pre' WHEN 1 THEN 'in' ELSE 'post' END AS state, event_id % 5 <> 0 AS completed FROM events""")


@query("game_status", STATUS)
def _(t):
    kind, n = F.col("event_type"), F.col("event_id")
    stopped = F.element_at(F.array(*[F.lit(f"STATUS_{s}") for s in ("CANCELED", "CANCELLED", "SUSPENDED", "DELAYED")]), (n % 4 + 1).cast("int"))
    name = F.when(kind == "signup", "STATUS_SCHEDULED").when(kind == "view", "STATUS_POSTPONED").when(
        kind == "purchase", "STATUS_FINAL").when(kind == "error", stopped).otherwise("STATUS_OTHER")
    state = F.when(n % 3 == 0, "pre").when(n % 3 == 1, "in").otherwise("post")
    return t["events"].select("event_id", expr.game_status(name, state, n % 5 != 0).alias("status"))


@query("import_manifest", """
SELECT league, import_date, response_id, observed_at, ids FROM (
SELECT r.league, r.import_date, r.response_id, r.observed_at,
       coalesce((SELECT string_agg(e.game_id, ',' ORDER BY e.game_id) FROM sb_judged e WHERE e.response_id = r.response_id AND e.skip IS NULL), '') AS ids,
       row_number() OVER (PARTITION BY r.league, r.import_date ORDER BY r.observed_at DESC, r.response_id DESC) AS k
FROM sb_accepted r) WHERE k = 1""")
def _(t):
    responses = scoreboard.manifest_responses(raw_scoreboards(t))
    noon = F.hour("observed_at") < 12
    stored = upsert.newest(responses.where(noon), ["league", "import_date"], ["observed_at", "response_id"])
    merged = upsert.import_manifest(stored, responses.where(~noon))
    return merged.withColumn("ids", F.array_join("ids", ","))


# --- box scores ------------------------------------------------------------------------------
view("bx_lines", """
SELECT g.league, g.season, g.season_type, g.game_id, CAST(g.game_id AS BIGINT) AS n, x.l_partkey AS part,
       g.home, g.away, CASE WHEN x.l_partkey % 2 = 0 THEN g.home ELSE g.away END AS team_id, x.category, (x.discount = 0) AS dnp,
       CASE WHEN x.linenumber <> 7 THEN x.linenumber <= 3 END AS starter, x.linenumber AS line, x.quantity,
       x.linenumber = 6 AND x.category = 'general' AS benched
FROM (SELECT l_orderkey, l_partkey, CASE l_returnflag WHEN 'A' THEN 'general' WHEN 'N' THEN 'passing' ELSE 'defensive' END AS category,
             min(l_linenumber) AS linenumber, CAST(min(l_quantity) AS INT) AS quantity, min(l_discount) AS discount
      FROM lineitem GROUP BY l_orderkey, l_partkey, l_returnflag) x
JOIN games g ON g.game_id = CAST(x.l_orderkey AS STRING) WHERE g.status = 'final'""")
view("bx_named", """
SELECT *, concat(league, '-', game_id) AS response_id, (dnp AND part % 3 = 0) OR (benched AND part % 3 <> 1) AS nameless FROM bx_lines""")
view("bx_judged", """
SELECT *, CASE WHEN nameless AND (dnp OR (league = 'NBA' AND benched AND part % 47 <> 0 AND n % 41 <> 0)) THEN true ELSE false END AS excluded FROM bx_named""")
view("bx_reasoned", """
SELECT *, CASE WHEN excluded THEN NULL WHEN nameless OR part % 143 = 0 THEN 'missing_identity' WHEN NOT dnp AND part % 47 = 0 THEN 'alignment' END AS reason
FROM bx_judged""")
view("bx_responses", """
SELECT response_id, league, game_id, max(n) AS n,
  CASE WHEN max(n) % 43 = 0 OR max(n) % 61 = 0 THEN 'bad_json' WHEN max(n) % 31 = 0 THEN 'identity_mismatch' WHEN max(n) % 37 = 0 THEN 'not_final' WHEN max(n) % 53 = 0 THEN 'team_count' WHEN max(n) % 59 = 0 THEN 'unexpected_team' END AS whole,
  max(n) % 41 = 0 AS bad_keys, league = 'NFL' AND max(n) % 29 = 0 AS lacking,
  count(*) - count(DISTINCT concat(part, '/', category)) + coalesce(greatest(count(*) FILTER (WHERE nameless AND NOT excluded AND category = 'general') - 1, 0), 0) > 0 AS repeated,
  count(*) FILTER (WHERE nameless AND NOT excluded AND team_id = home) > 0 AND count(*) FILTER (WHERE nameless AND NOT excluded AND team_id = away) > 0 AS mixed,
  count(*) FILTER (WHERE NOT excluded AND NOT dnp AND team_id = home) = 0 OR count(*) FILTER (WHERE NOT excluded AND NOT dnp AND team_id = away) = 0 AS idle
FROM bx_judged GROUP BY response_id, league, game_id""")
view("bx_rejects", """
SELECT response_id, league, game_id, whole AS reason FROM bx_responses WHERE whole IS NOT NULL
UNION ALL SELECT response_id, league, game_id, 'statistic_key' FROM bx_responses WHERE whole IS NULL AND bad_keys
UNION ALL SELECT response_id, league, game_id, 'duplicate_player' FROM bx_responses WHERE whole IS NULL AND repeated
UNION ALL SELECT response_id, league, game_id, 'player_both_teams' FROM bx_responses WHERE whole IS NULL AND mixed
UNION ALL SELECT response_id, league, game_id, 'missing_category' FROM bx_responses WHERE whole IS NULL AND lacking
UNION ALL SELECT response_id, league, game_id, 'no_played_rows' FROM bx_responses WHERE whole IS NULL AND idle
UNION ALL SELECT DISTINCT l.response_id, l.league, l.game_id, l.reason FROM bx_reasoned l JOIN bx_responses r ON r.response_id = l.response_id
WHERE r.whole IS NULL AND l.reason IS NOT NULL""")
ACCEPTED = "NOT EXISTS (SELECT 1 FROM bx_rejects r WHERE r.response_id = l.response_id)"


def raw_boxscores(t):
    t.share("games")
    return raw_fixtures.boxscores(t["line_items"], t["games"])


@query("boxscore_decode", f"""
SELECT response_id, league, game_id, season, season_type, team_id, CAST(part AS VARCHAR) AS player_id, concat('Player ', part) AS name, category,
       'G' AS position, '7' AS jersey, dnp AS did_not_play, starter,
       CASE WHEN dnp THEN '{{}}' WHEN benched THEN '{{"minutes":"--","points":"0","fieldGoalsMade-fieldGoalsAttempted":"0-0"}}'
         ELSE concat('{{"minutes":"30","points":"', quantity, '","fieldGoalsMade-fieldGoalsAttempted":"', line, '-', line + quantity, '"}}') END AS stats_json,
       TIMESTAMP '2026-01-01 00:00:00' AS observed_at
FROM bx_reasoned l WHERE {ACCEPTED} AND NOT excluded""")
def _(t):
    return boxscore.boxscore_decode(raw_boxscores(t), t["games"])


@query("boxscore_rejects", "SELECT * FROM bx_rejects")
def _(t):
    return boxscore.boxscore_rejects(raw_boxscores(t), t["games"])


@query("placeholder_dnp", f"""
SELECT response_id, league, game_id, CAST(count(*) AS INT) AS excluded FROM bx_reasoned l WHERE {ACCEPTED} AND excluded GROUP BY response_id, league, game_id""")
def _(t):
    return boxscore.placeholder_dnp(raw_boxscores(t), t["games"])


@query("player_import_progress", f"""
SELECT g.league, count(*) FILTER (WHERE NOT done) AS games_processed, count(*) FILTER (WHERE done) AS games_skipped,
       CAST(coalesce(sum(CASE WHEN NOT done THEN coalesce(n, 0) END), 0) AS BIGINT) AS lines_processed,
       CAST(coalesce(sum(CASE WHEN NOT done THEN coalesce(x, 0) END), 0) AS BIGINT) AS unidentified_dnp
FROM (SELECT g.league, g.game_id, EXISTS (SELECT 1 FROM complete c WHERE c.game_id = g.game_id) AS done,
        (SELECT count(*) FROM bx_reasoned l WHERE {ACCEPTED} AND NOT excluded AND l.game_id = g.game_id) AS n,
        (SELECT count(*) FROM bx_reasoned l WHERE {ACCEPTED} AND excluded AND l.game_id = g.game_id) AS x
      FROM games g WHERE g.status = 'final') g GROUP BY g.league""")
def _(t):
    claims = t.share("claimed", boxscore.claimed(raw_boxscores(t)))  # documents are parsed once for both
    return completeness.player_import_progress(
        t["games"], complete(t), boxscore.boxscore_decode(None, t["games"], claims),
        boxscore.placeholder_dnp(None, t["games"], claims))


# --- team lists ------------------------------------------------------------------------------
view("tl_teams", """
SELECT c_custkey // 20 AS bucket, CASE WHEN c_custkey % 2 = 0 THEN 'NBA' ELSE 'NFL' END AS league,
       concat(CASE WHEN c_custkey % 2 = 0 THEN 'NBA' ELSE 'NFL' END, '-', c_custkey // 20) AS response_id,
       CAST(CASE WHEN c_custkey % 103 = 0 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR) AS team_id,
       CASE WHEN c_custkey % 101 = 0 THEN ' ' ELSE c_name END AS name, substr(c_mktsegment, 1, 3) AS abbreviation FROM customer""")
view("tl_rejects", """
SELECT DISTINCT response_id, league, 'bad_json' AS reason FROM tl_teams WHERE bucket % 7 = 3
UNION ALL SELECT DISTINCT response_id, league, 'missing_field' FROM tl_teams WHERE trim(name) = '' AND bucket % 7 <> 3
UNION ALL SELECT DISTINCT response_id, league, 'duplicate_team' FROM (
  SELECT response_id, league, team_id FROM tl_teams WHERE bucket % 7 <> 3 GROUP BY ALL HAVING count(*) > 1)""")


def raw_team_lists(t):
    return raw_fixtures.team_lists(t["customer"])


@query("teams_decode", """
SELECT response_id, league, team_id, name, abbreviation FROM tl_teams t WHERE NOT EXISTS (SELECT 1 FROM tl_rejects r WHERE r.response_id = t.response_id)""")
def _(t):
    return team_list.teams_decode(raw_team_lists(t))


@query("teams_rejects", "SELECT * FROM tl_rejects")
def _(t):
    return team_list.teams_rejects(raw_team_lists(t))
