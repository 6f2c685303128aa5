"""Registered split queries."""

from pyspark.sql import functions as F

from matchday.functions.domain import KEY
from matchday.operators import splits as op
from matchday.plans.registry import query, view

K = "league, season, season_type"
OUT = f"{K}, game_id, date, target"


def same(a, b, *more):
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in (*KEY, *more))


view("ex_dates", f"""
SELECT {K}, date, count(*) AS games, sum(target) AS wins,
       row_number() OVER (PARTITION BY {K} ORDER BY date) - 1 AS r, count(*) OVER (PARTITION BY {K}) AS n
FROM examples GROUP BY {K}, date""")
view("d602020", f"""
SELECT {K}, date, games, wins, n, CASE WHEN r < CAST(floor(n * 0.6::DOUBLE) AS INT) THEN 'train' WHEN r < CAST(floor(n * 0.8::DOUBLE) AS INT) THEN 'validation' ELSE 'test' END AS split
FROM ex_dates""")
view("bad602020", f"""
SELECT {K}, CASE WHEN max(n) < 5 THEN 'too_few_dates' ELSE 'one_class' END AS reason FROM d602020 GROUP BY {K}
HAVING max(n) < 5 OR coalesce(sum(wins) FILTER (WHERE split = 'train'), 0) IN (0, coalesce(sum(games) FILTER (WHERE split = 'train'), 0))""")
view("s602020", f"""
SELECT e.*, d.split FROM examples e JOIN d602020 d ON {same('e', 'd', 'date')}
WHERE NOT EXISTS (SELECT 1 FROM bad602020 b WHERE {same('b', 'e')})""")

view("dwf", f"""
SELECT {K}, date, games, wins, n, i + 1 AS window_no, CASE WHEN r < n * (4 + i) // 10 THEN 'train' WHEN r < n * (6 + i) // 10 THEN 'validation' WHEN r < n * (7 + i) // 10 THEN 'test' END AS split
FROM (SELECT *, unnest([0, 1, 2, 3]) AS i FROM ex_dates)""")
view("badwf", f"""
SELECT DISTINCT {K}, CASE WHEN m < 10 THEN 'too_few_dates' ELSE 'one_class' END AS reason FROM (
SELECT {K}, window_no, max(n) AS m FROM dwf GROUP BY {K}, window_no
HAVING max(n) < 10 OR coalesce(sum(wins) FILTER (WHERE split = 'train'), 0) IN (0, coalesce(sum(games) FILTER (WHERE split = 'train'), 0)))""")
view("swf", f"""
SELECT e.*, d.window_no, d.split FROM examples e JOIN dwf d ON {same('e', 'd', 'date')}
WHERE d.split IS NOT NULL AND NOT EXISTS (SELECT 1 FROM badwf b WHERE {same('b', 'e')})""")

view("ex_weeks", f"""
SELECT {K}, week, games, wins, r, n, top - low + 1 <> n AS gap, coalesce(last_date >= lead(first_date) OVER (PARTITION BY {K} ORDER BY week), false) AS clash
FROM (SELECT {K}, week, count(*) AS games, sum(target) AS wins, min(date) AS first_date, max(date) AS last_date,
        row_number() OVER (PARTITION BY {K} ORDER BY week) - 1 AS r, count(*) OVER (PARTITION BY {K}) AS n,
        min(week) OVER (PARTITION BY {K}) AS low, max(week) OVER (PARTITION BY {K}) AS top
      FROM examples WHERE league = 'NFL' GROUP BY {K}, week)""")
view("wk_windows", f"""
SELECT {K}, week, games, wins, (start - 6 - (n - 6) % 2) // 2 + 1 AS window_no,
       CASE WHEN r < start - 2 THEN 'train' WHEN r < start THEN 'validation' WHEN r < start + 2 THEN 'test' END AS split
FROM (SELECT *, unnest(generate_series(6 + (n - 6) % 2, n - 1, 2)) AS start FROM ex_weeks WHERE n >= 8)""")
view("badwk", f"""
SELECT {K}, CASE WHEN max(n) < 8 THEN 'too_few_weeks' WHEN bool_or(gap) THEN 'week_gap' ELSE 'date_overlap' END AS reason
FROM ex_weeks GROUP BY {K} HAVING max(n) < 8 OR bool_or(gap) OR bool_or(clash)
UNION
SELECT {K}, 'one_class' FROM (SELECT {K}, window_no FROM wk_windows GROUP BY ALL
  HAVING coalesce(sum(wins) FILTER (WHERE split = 'train'), 0) IN (0, coalesce(sum(games) FILTER (WHERE split = 'train'), 0)))""")
view("swk", f"""
SELECT e.*, d.window_no, d.split FROM examples e JOIN wk_windows d ON {same('e', 'd', 'week')}
WHERE d.split IS NOT NULL AND NOT EXISTS (SELECT 1 FROM badwk b WHERE {same('b', 'e')})""")

view("ex_slots", f"""
SELECT {K}, slot, games, wins, first_date, last_date, CASE WHEN r < n * 4 // 5 THEN 'train' ELSE 'validation' END AS split, n
FROM (SELECT {K}, slot, count(*) AS games, sum(target) AS wins, min(date) AS first_date, max(date) AS last_date,
        row_number() OVER (PARTITION BY {K} ORDER BY slot) - 1 AS r, count(*) OVER (PARTITION BY {K}) AS n
      FROM (SELECT *, CASE WHEN league = 'NFL' THEN week ELSE CAST(date - DATE '1970-01-01' AS INT) END AS slot FROM examples) GROUP BY {K}, slot)""")
view("bad_earlier", f"""
SELECT {K}, CASE WHEN max(n) < 5 THEN 'too_few_groups' WHEN max(last_date) FILTER (WHERE split = 'train') >= min(first_date) FILTER (WHERE split = 'validation') THEN 'date_overlap' ELSE 'one_class' END AS reason
FROM ex_slots GROUP BY {K}
HAVING max(n) < 5 OR max(last_date) FILTER (WHERE split = 'train') >= min(first_date) FILTER (WHERE split = 'validation')
  OR coalesce(sum(wins) FILTER (WHERE split = 'train'), 0) IN (0, coalesce(sum(games) FILTER (WHERE split = 'train'), 0))""")


@query("split_60_20_20", f"SELECT {OUT}, split FROM s602020")
def _(t):
    return op.split_60_20_20(t["examples"]).select(*KEY, "game_id", "date", "target", "split")


@query("split_60_20_20_violations", "SELECT * FROM bad602020")
def _(t):
    return op.violations(op.plan_60_20_20(t["examples"]))


@query("walk_forward", f'SELECT {OUT}, CAST(window_no AS INT) AS "window", split FROM swf')
def _(t):
    return op.walk_forward(t["examples"]).select(*KEY, "game_id", "date", "target", "window", "split")


@query("walk_forward_violations", "SELECT * FROM badwf")
def _(t):
    return op.violations(op.plan_walk_forward(t["examples"]))


def nfl(t):
    return t["examples"].where("league = 'NFL' and season_type = 2")


@query("weekly_windows", f'SELECT {OUT}, CAST(window_no AS INT) AS "window", split FROM swk')
def _(t):
    return op.weekly_windows(nfl(t)).select(*KEY, "game_id", "date", "target", "window", "split")


@query("weekly_windows_violations", "SELECT * FROM badwk")
def _(t):
    return op.violations(op.plan_weekly(nfl(t)))


@query("earlier_split", f"""
SELECT {OUT}, split FROM (SELECT *, CASE WHEN league = 'NFL' THEN week ELSE CAST(date - DATE '1970-01-01' AS INT) END AS slot FROM examples) e
JOIN (SELECT {K}, slot, split FROM ex_slots) d USING ({K}, slot)
WHERE NOT EXISTS (SELECT 1 FROM bad_earlier b WHERE {same('b', 'e')})""")
def _(t):
    return op.earlier_split(t["examples"]).select(*KEY, "game_id", "date", "target", "split")


@query("earlier_split_violations", "SELECT * FROM bad_earlier")
def _(t):
    return op.violations(op.plan_earlier(t["examples"]))


view("season_neighbours", """
SELECT league, season AS earlier, later, last_start AS earlier_last, later_first FROM (
SELECT league, season, last_start, lead(season) OVER (PARTITION BY league ORDER BY season) AS later, lead(first_start) OVER (PARTITION BY league ORDER BY season) AS later_first
FROM (SELECT league, season, min(starts_at) AS first_start, max(starts_at) AS last_start FROM games WHERE season_type = 2 AND status = 'final' GROUP BY league, season))
WHERE later IS NOT NULL""")
view("season_pairs", "SELECT * FROM season_neighbours WHERE earlier_last < later_first")


@query("cross_season_pairs", "SELECT * FROM season_pairs")
def _(t):
    return op.cross_season_pairs(t["games"])


CHOSEN = [("NBA", 1995, 2001), ("NBA", 1999, 1995), ("NFL", 1996, 2000), ("NFL", 1998, 2050)]


@query("cross_season_chosen_pairs", f"""
WITH s AS (SELECT league, season, min(starts_at) AS first_start, max(starts_at) AS last_start FROM games
  WHERE season_type = 2 AND status = 'final' GROUP BY league, season)
SELECT e.league, e.season AS earlier, l.season AS later, e.last_start AS earlier_last, l.first_start AS later_first
FROM (VALUES {', '.join(map(str, CHOSEN))}) c(league, earlier, later)
JOIN s e ON e.league = c.league AND e.season = c.earlier JOIN s l ON l.league = c.league AND l.season = c.later
WHERE e.last_start < l.first_start""")
def _(t):
    """Pairs a user names: one that runs backwards and one without a later season are none."""
    return op.cross_season_pairs(t["games"], CHOSEN)


view("bad_regular", """
SELECT league, season, min(reason) AS reason FROM bad_earlier WHERE season_type = 2 GROUP BY league, season""")
REFUSED = """
SELECT p.league, p.earlier, p.later, coalesce(p.reason, b.reason,
  CASE WHEN NOT EXISTS (SELECT 1 FROM examples e WHERE e.league = p.league AND e.season = p.earlier AND e.season_type = 2) THEN 'too_few_groups'
       WHEN NOT EXISTS (SELECT 1 FROM examples e WHERE e.league = p.league AND e.season = p.later AND e.season_type = 2) THEN 'no_later_games' END) AS why
FROM ({pairs}) p LEFT JOIN bad_regular b ON b.league = p.league AND b.season = p.earlier"""


@query("cross_season_violations", "SELECT league, earlier, later, why AS reason FROM (" + REFUSED.format(pairs="""
SELECT *, CASE WHEN earlier_last >= later_first THEN 'season_overlap' END AS reason FROM season_neighbours""") + ") WHERE why IS NOT NULL")
def _(t):
    return op.cross_season_violations(t["games"], t["examples"])


@query("cross_season_chosen_violations", f"""
WITH s AS (SELECT league, season, min(starts_at) AS first_start, max(starts_at) AS last_start FROM games
  WHERE season_type = 2 AND status = 'final' GROUP BY league, season)
SELECT league, earlier, later, why AS reason FROM (""" + REFUSED.format(pairs=f"""
SELECT c.*, CASE WHEN c.earlier >= c.later THEN 'season_order' WHEN e.season IS NULL OR l.season IS NULL THEN 'season_missing'
  WHEN e.last_start >= l.first_start THEN 'season_overlap' END AS reason
FROM (VALUES {', '.join(map(str, CHOSEN))}) c(league, earlier, later)
LEFT JOIN s e ON e.league = c.league AND e.season = c.earlier LEFT JOIN s l ON l.league = c.league AND l.season = c.later""") + ") WHERE why IS NOT NULL")
def _(t):
    """What becomes of the pairs of a user that are not run: together with the chosen pairs, all that were asked for."""
    return op.cross_season_violations(t["games"], t["examples"], CHOSEN)


# The NFL's holdout is its first season, so that nothing lies before it.
@query("season_inventory_violations", """
SELECT h.league, h.holdout, count(DISTINCT g.season) AS development_seasons
FROM (SELECT 'NBA' AS league, 2001 AS holdout UNION ALL SELECT 'NFL', 1990) h
LEFT JOIN games g ON g.league = h.league AND g.season < h.holdout AND g.season_type = 2
GROUP BY h.league, h.holdout HAVING count(DISTINCT g.season) < 2""")
def _(t):
    return op.season_inventory_violations(t["games"], {"NBA": 2001, "NFL": 1990})


view("inventory", f"""
SELECT {K}, count(*) AS input_games, count(*) FILTER (WHERE fate = 'tie') AS excluded_ties,
       count(*) FILTER (WHERE fate = 'warmup') AS excluded_warmup, count(*) FILTER (WHERE fate = 'eligible') AS eligible_games
FROM classified WHERE season_type = 2 AND ((league = 'NBA' AND season < 2001) OR (league = 'NFL' AND season < 2000)) GROUP BY {K}""")


@query("season_inventory", "SELECT * FROM inventory")
def _(t):
    return op.season_inventory(t["games"], {"NBA": 2001, "NFL": 2000})


@query("season_inventory_fingerprints", f"SELECT * FROM inventory JOIN fingerprints USING ({K})")
def _(t):
    return op.season_inventory(t.share("games"), {"NBA": 2001, "NFL": 2000}, fingerprints=True)


@query("split_summary", f"""
SELECT {K}, window_no AS "window", split, count(*) AS games, min(date) AS "from", max(date) AS "to", CAST(sum(target) AS BIGINT) AS home_wins,
       array_to_string(list_sort(list(DISTINCT week)), ',') AS weeks
FROM (SELECT * FROM swf WHERE league = 'NBA' UNION ALL SELECT * FROM swk) GROUP BY {K}, window_no, split""")
def _(t):
    parts = op.walk_forward(t["examples"].where("league = 'NBA'")).unionByName(op.weekly_windows(nfl(t)))
    return op.split_summary(parts, [*KEY, "window"]).withColumn(
        "weeks", F.array_join(F.transform("weeks", lambda w: w.cast("string")), ","))
