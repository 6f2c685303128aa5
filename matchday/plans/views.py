"""DuckDB form of the adapter views; prefixed to every oracle statement that uses them."""

from matchday.plans.registry import view
from matchday.sources.adapter import ZERO_LINE
from matchday.sources.fixtures import FIXTURES


class _Names(dict):
    def __missing__(self, key):
        return key


view("teams", "SELECT CAST(n_nationkey AS STRING) AS team_id, n_name AS name FROM nation")

view("games", """
SELECT CAST(o.o_orderkey AS STRING) AS game_id,
       CASE WHEN year(o.o_orderdate) % 2 = 0 THEN 'NFL' ELSE 'NBA' END AS league,
       CAST(year(o.o_orderdate) AS INT) AS season, 2 AS season_type, o.o_orderdate AS starts_at,
       CAST(c.c_nationkey AS STRING) AS home, CAST(s.s_nationkey AS STRING) AS away,
       CASE o.o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'scheduled' ELSE 'postponed' END AS status,
       CASE WHEN o.o_orderstatus = 'F' THEN CAST(CAST(floor(o.o_totalprice) AS BIGINT) % 41 + 80 AS INT) END AS home_score,
       CASE WHEN o.o_orderstatus = 'F' THEN CAST(CAST(floor(o.o_totalprice / 41) AS BIGINT) % 41 + 80 AS INT) END AS away_score,
       CAST(floor((dayofyear(o.o_orderdate) - 1) / 7) AS INT) + 1 AS week
FROM orders o
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN (SELECT l_orderkey, min(l_suppkey) AS suppkey FROM lineitem GROUP BY l_orderkey) a ON a.l_orderkey = o.o_orderkey
JOIN supplier s ON s.s_suppkey = a.suppkey
WHERE c.c_nationkey <> s.s_nationkey""")

view("lines", f"""
SELECT g.game_id, g.league, g.season, g.season_type, CAST(x.l_partkey AS STRING) AS player_id,
       CASE WHEN x.l_partkey % 2 = 0 THEN g.home ELSE g.away END AS team_id, x.category,
       (x.discount = 0) AS did_not_play,
       CASE WHEN x.linenumber = 7 THEN NULL ELSE x.linenumber <= 3 END AS starter,
       CASE WHEN x.linenumber = 6 AND x.category = 'general' THEN '{ZERO_LINE}'
            WHEN x.linenumber = 4 AND x.category = 'passing' THEN '{{"passingYards":"' || CAST(x.quantity AS STRING) || '","completions/passingAttempts":"1/2","adjQBR":"--"}}'
            ELSE '{{"points":"' || CAST(x.quantity AS STRING) || '","assists":"' || CASE WHEN x.linenumber = 5 THEN '--' ELSE CAST(x.linenumber AS STRING) END
              || '","fieldGoalsMade-fieldGoalsAttempted":"' || CAST(x.linenumber AS STRING) || '-' || CAST(x.linenumber + x.quantity AS STRING)
              || '","QBRating":"99.3"}}' END AS stats_json
FROM (SELECT l_orderkey, l_partkey, CASE l_returnflag WHEN 'A' THEN 'general' WHEN 'N' THEN 'passing' ELSE 'defensive' END AS category,
             min(l_linenumber) AS linenumber, CAST(min(l_quantity) AS INT) AS quantity, min(l_discount) AS discount
      FROM lineitem GROUP BY l_orderkey, l_partkey, l_returnflag) x
JOIN games g ON g.game_id = CAST(x.l_orderkey AS STRING) WHERE g.status = 'final'""")

view("snapshots", """
SELECT CAST(user_id AS STRING) AS game_id, ts AS observed_at, event_id AS seq,
       CASE event_type WHEN 'signup' THEN 'scheduled' WHEN 'view' THEN 'in_progress' WHEN 'purchase' THEN 'final' WHEN 'error' THEN 'postponed' ELSE 'delayed' END AS status,
       CASE WHEN event_type IN ('view','purchase') THEN CAST(floor(value) AS INT) END AS home_score
FROM events""")

view("manifests", "SELECT league, CAST(starts_at AS DATE) AS import_date, game_id FROM games")

view("replacements", """
SELECT p.league, p.season, p.game_id AS postponed_id, min(f.game_id) AS final_id
FROM games p JOIN games f ON f.league = p.league AND f.season = p.season AND f.home = p.home AND f.away = p.away AND f.starts_at > p.starts_at
WHERE p.status = 'postponed' AND f.status = 'final' AND CAST(p.game_id AS BIGINT) % 3 <> 0
GROUP BY p.league, p.season, p.game_id""")

view("line_counts", "SELECT game_id, CAST(count(*) AS INT) AS n FROM lines GROUP BY game_id")

view("player_imports", """
SELECT g.league, g.game_id, g.season, g.season_type, g.home, g.away,
       CAST(c.n + CASE WHEN CAST(g.game_id AS BIGINT) % 10 = 0 THEN 1 ELSE 0 END AS INT) AS line_count
FROM games g JOIN line_counts c ON c.game_id = g.game_id""")

view("complete", """
SELECT g.* FROM games g JOIN player_imports i ON i.game_id = g.game_id JOIN line_counts c ON c.game_id = g.game_id
WHERE g.status = 'final' AND g.season = i.season AND g.season_type = i.season_type AND g.home = i.home
  AND g.away = i.away AND i.line_count = c.n""")

view("scopes", """
SELECT league, season, season_type,
       CASE WHEN season <> 1999 THEN make_date(season, 1, 1) END AS date_from,
       CASE WHEN season <> 1999 THEN make_date(season, 12, 31) END AS date_to
FROM (SELECT DISTINCT league, season, season_type FROM games
      UNION ALL SELECT DISTINCT league, CAST(season + 100 AS INT), season_type FROM games)""")

# --- features ------------------------------------------------------------------------------
view("sides", """
SELECT league, season, season_type, game_id, starts_at, CAST(starts_at AS DATE) AS date, home AS team, away AS opponent,
       home_score AS points_for, away_score AS points_against FROM games WHERE status = 'final'
UNION ALL
SELECT league, season, season_type, game_id, starts_at, CAST(starts_at AS DATE), away, home, away_score, home_score
FROM games WHERE status = 'final'""")

# One row per team and day first, as in the query: over rows of one day, DuckDB's RANGE frame by an interval
# gives different values on large tables.
view("side_days", """
SELECT league, season, season_type, team, date, count(*) AS games,
       sum(CASE WHEN points_for > points_against THEN 2 WHEN points_for = points_against THEN 1 ELSE 0 END) AS half,
       sum(points_for) AS pf, sum(points_against) AS pa
FROM sides GROUP BY league, season, season_type, team, date""")

view("side_history", """
SELECT league, season, season_type, team, date, CAST(coalesce(sum(games) OVER w, 0) AS BIGINT) AS n,
       sum(half) OVER w AS half, sum(pf) OVER w AS pf, sum(pa) OVER w AS pa, max(date) OVER w AS previous
FROM side_days
WINDOW w AS (PARTITION BY league, season, season_type, team ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")

# The five latest earlier games: positions n-4 .. n of the team's own (start, id) order.
view("side_order", """
SELECT league, season, season_type, team,
       row_number() OVER (PARTITION BY league, season, season_type, team ORDER BY starts_at, game_id) AS position,
       CASE WHEN points_for > points_against THEN 2 WHEN points_for = points_against THEN 1 ELSE 0 END AS half,
       points_for - points_against AS margin
FROM sides""")

view("side_running", """
SELECT league, season, season_type, team, position,
       sum(half) OVER w AS half5, sum(margin) OVER w AS margin5
FROM side_order
WINDOW w AS (PARTITION BY league, season, season_type, team ORDER BY position ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")

view("state", """
SELECT h.league, h.season, h.season_type, h.team, h.date, max(h.n) AS n,
       max(CAST(h.half AS DOUBLE) / (2.0::DOUBLE * h.n)) AS win_rate,
       max(CAST(h.pf AS DOUBLE) / h.n) AS mean_for, max(CAST(h.pa AS DOUBLE) / h.n) AS mean_against,
       max(CAST(h.pf - h.pa AS DOUBLE) / h.n) AS mean_margin,
       max(CASE WHEN h.n >= 5 THEN CAST(r.half5 AS DOUBLE) / 10 END) AS last5_win_rate,
       max(CASE WHEN h.n >= 5 THEN CAST(r.margin5 AS DOUBLE) / 5 END) AS last5_margin,
       CAST(max(h.date - h.previous) AS INT) AS rest_days
FROM side_history h
LEFT JOIN side_running r ON r.league = h.league AND r.season = h.season AND r.season_type = h.season_type
  AND r.team = h.team AND r.position = h.n
GROUP BY h.league, h.season, h.season_type, h.team, h.date""")

view("classified", """
SELECT g.*, CAST(g.starts_at AS DATE) AS date, h.n AS home_n, a.n AS away_n,
       CASE WHEN g.home_score = g.away_score THEN 'tie' WHEN least(h.n, a.n) >= 5 THEN 'eligible' ELSE 'warmup' END AS fate,
       h.win_rate - a.win_rate AS win_rate_diff, h.mean_for - a.mean_for AS points_for_diff,
       h.mean_against - a.mean_against AS points_against_diff, h.mean_margin - a.mean_margin AS margin_diff,
       h.last5_win_rate - a.last5_win_rate AS last5_win_rate_diff, h.last5_margin - a.last5_margin AS last5_margin_diff,
       CAST(h.rest_days - a.rest_days AS DOUBLE) AS rest_days_diff
FROM games g
JOIN state h ON h.league = g.league AND h.season = g.season AND h.season_type = g.season_type AND h.team = g.home AND h.date = CAST(g.starts_at AS DATE)
JOIN state a ON a.league = g.league AND a.season = g.season AND a.season_type = g.season_type AND a.team = g.away AND a.date = CAST(g.starts_at AS DATE)
WHERE g.status = 'final'""")

view("examples", """
SELECT league, season, season_type, game_id, date, week, win_rate_diff, points_for_diff, points_against_diff, margin_diff,
       last5_win_rate_diff, last5_margin_diff, rest_days_diff, CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS target
FROM classified WHERE fate = 'eligible'""")

for _name, _sql in FIXTURES.items():
    view(_name, _sql.format_map(_Names()))
