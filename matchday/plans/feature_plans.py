"""Registered feature queries (F1-F8)."""

from matchday.functions.domain import FEATURE_SETS, FEATURES
from matchday.operators import features as op
from matchday.plans.registry import query

STATE_KEY = "league, season, season_type, team, date, n"


@query("team_games", "SELECT * FROM sides")
def _(t):
    return op.team_games(t.games)


@query("team_history", f"SELECT {STATE_KEY}, win_rate, mean_for, mean_against, mean_margin FROM state")
def _(t):
    return op.team_history(t.games)


@query("team_last5", f"SELECT {STATE_KEY}, last5_win_rate, last5_margin FROM state")
def _(t):
    return op.team_last5(t.games)


@query("rest_days", f"SELECT {STATE_KEY}, rest_days FROM state")
def _(t):
    return op.rest_days(t.games)


@query("examples", "SELECT * FROM examples")
def _(t):
    return op.examples(t.games)


@query("example_counts", """
SELECT league, season, season_type, count(*) AS input_games, count(*) FILTER (WHERE fate = 'tie') AS excluded_ties,
       count(*) FILTER (WHERE fate = 'warmup') AS excluded_warmup, count(*) FILTER (WHERE fate = 'eligible') AS eligible_games
FROM classified GROUP BY ALL""")
def _(t):
    return op.example_counts(t.games)


ASOF = """
WITH_TARGETS
SELECT game_id, n_home, n_away,
       CASE WHEN least(n_home, n_away) >= 5 THEN hw - aw END AS win_rate_diff,
       CASE WHEN least(n_home, n_away) >= 5 THEN hf - af END AS points_for_diff,
       CASE WHEN least(n_home, n_away) >= 5 THEN ha - aa END AS points_against_diff,
       CASE WHEN least(n_home, n_away) >= 5 THEN hm - am END AS margin_diff,
       CASE WHEN least(n_home, n_away) >= 5 THEN h5w - a5w END AS last5_win_rate_diff,
       CASE WHEN least(n_home, n_away) >= 5 THEN h5m - a5m END AS last5_margin_diff,
       CASE WHEN least(n_home, n_away) >= 5 THEN CAST(hr - ar AS DOUBLE) END AS rest_days_diff
FROM prior"""


def asof_sql(targets: str) -> str:
    """As-of state by counting earlier sides, independent of the window form used in Spark."""
    def side(team):
        return f"""
SELECT t.game_id, count(s.game_id) AS n,
       CAST(sum(CASE WHEN s.points_for > s.points_against THEN 2 WHEN s.points_for = s.points_against THEN 1 ELSE 0 END) AS DOUBLE) / (2.0::DOUBLE * count(s.game_id)) AS w,
       CAST(sum(s.points_for) AS DOUBLE) / count(s.game_id) AS f, CAST(sum(s.points_against) AS DOUBLE) / count(s.game_id) AS a,
       CAST(sum(s.points_for - s.points_against) AS DOUBLE) / count(s.game_id) AS m,
       CAST(list_sum(list_slice(list(CASE WHEN s.points_for > s.points_against THEN 2 WHEN s.points_for = s.points_against THEN 1 ELSE 0 END ORDER BY s.starts_at, s.game_id), -5, -1)) AS DOUBLE) / 10 AS w5,
       CAST(list_sum(list_slice(list(s.points_for - s.points_against ORDER BY s.starts_at, s.game_id), -5, -1)) AS DOUBLE) / 5 AS m5,
       max(t.date) - max(s.date) AS r
FROM targets t LEFT JOIN sides s ON s.league = t.league AND s.season = t.season AND s.season_type = 2 AND s.team = t.{team} AND s.date < t.date
GROUP BY t.game_id"""
    return f"""
targets AS (SELECT *, CAST(starts_at AS DATE) AS date FROM ({targets})),
ahome AS ({side('home')}), aaway AS ({side('away')}),
prior AS (SELECT h.game_id, h.n AS n_home, a.n AS n_away, h.w AS hw, a.w AS aw, h.f AS hf, a.f AS af, h.a AS ha, a.a AS aa, h.m AS hm, a.m AS am,
                h.w5 AS h5w, a.w5 AS a5w, h.m5 AS h5m, a.m5 AS a5m, h.r AS hr, a.r AS ar
         FROM ahome h JOIN aaway a ON a.game_id = h.game_id)"""


@query("asof_features", "WITH " + asof_sql("SELECT * FROM games WHERE status <> 'final'").strip()
       + ASOF.replace("WITH_TARGETS", ""))
def _(t):
    targets = t.games.where("status <> 'final'")
    return op.asof_features(targets, t.games).select("game_id", "n_home", "n_away", *FEATURES)


for _name in FEATURE_SETS:
    _cols = ", ".join(FEATURE_SETS[_name])
    query(f"feature_subset_{_name}",
          f"SELECT league, season, season_type, game_id, date, week, target, {_cols} FROM examples")(
        lambda t, n=_name: op.feature_subset(op.examples(t.games), n))
