"""Registered fit, score and metric queries."""

from pyspark.sql import functions as F

from matchday.functions.domain import BASELINE, CANDIDATES, FEATURE_POLICY, FEATURES, KEY
from matchday.operators import fit, splits
from matchday.operators import metrics as op
from matchday.plans.registry import query, view
from matchday.session import materialize

K = "league, season, season_type"
# Fixed weights of the deterministic models: variant -> (features, coefficients, intercept).
VARIANTS = {
    "strength": (FEATURES[:4], (0.9, 0.4, -0.3, 0.8), 0.1),
    "all": (FEATURES, (0.5, 0.2, -0.2, 0.4, 0.3, 0.3, 0.05), -0.05),
    "bold": (FEATURES[3:6], (3.0, 1.5, 2.0), 0.2),
}
GROUP = [*KEY, "variant"]
V = f"{K}, variant"


def fixed_models(t, baseline=False):
    """One row per key and variant, from a single pass over the statistics."""
    def variant(name, names, weights, intercept):
        at = [FEATURES.index(f) + 1 for f in names]
        numbers = lambda values: F.array(*values).cast("array<double>")
        return F.struct(
            F.lit(name).alias("variant"), F.array(*[F.lit(f) for f in names]).cast("array<string>").alias("features"),
            numbers([F.col(f"m{i}") for i in at]).alias("mean"),
            numbers([F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}")) for i in at]).alias("scale"),
            numbers([F.lit(w) for w in weights]).alias("coefficients"), F.lit(intercept).alias("intercept"))
    rows = [variant(name, *v) for name, v in VARIANTS.items()]
    if baseline:
        rows.append(variant(BASELINE, (), (), 0.0))
    return t["model_stats"].select(*KEY, "last_date", "rate", F.inline(F.array(*rows)))


def predictions(t):
    """Fixed models plus the constant baseline, one row per game and variant.

    Examples feed both the statistics and the scoring, so they are written once and read back.
    """
    t.share("examples")
    scored = fit.score(fixed_models(t, baseline=True), t["examples"], KEY)
    p = F.when(F.col("variant") == BASELINE, F.col("rate")).otherwise(F.round("p", 9))
    return scored.select(*GROUP, "game_id", "date", "target", p.alias("p"))


def z_sql(names, weights, intercept):
    terms = [f"(e.{f} - s.m{FEATURES.index(f) + 1}) / CASE WHEN s.s{FEATURES.index(f) + 1} = 0 THEN 1 ELSE s.s{FEATURES.index(f) + 1} END * ({w})::DOUBLE"
             for f, w in zip(names, weights)]
    return f"({intercept})::DOUBLE + " + " + ".join(terms)


view("predictions", " UNION ALL ".join(
    f"""SELECT e.league, e.season, e.season_type, '{name}' AS variant, e.game_id, e.date, e.target,
 round(CASE WHEN {z} >= 0 THEN 1 / (1 + exp(-({z}))) ELSE exp({z}) / (1 + exp({z})) END, 9) AS p
FROM examples e JOIN model_stats s USING ({K})""" for name, z in ((n, z_sql(*v)) for n, v in VARIANTS.items())) + f"""
UNION ALL SELECT e.league, e.season, e.season_type, '{BASELINE}', e.game_id, e.date, e.target, s.rate FROM examples e JOIN model_stats s USING ({K})""")

METRICS = """count(*) AS games,
 round(avg(CASE WHEN target = 1 THEN -ln(least(greatest(p, power(2::DOUBLE, -52)), 1 - power(2::DOUBLE, -52))) ELSE -ln(1 - least(greatest(p, power(2::DOUBLE, -52)), 1 - power(2::DOUBLE, -52))) END), 9) AS log_loss,
 round(avg((p - target) * (p - target)), 9) AS brier_score, round(avg(CASE WHEN (p >= 0.5) = (target = 1) THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy"""


def rounded(df, *names, digits=9):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def round_metrics(df):
    return rounded(df, "log_loss", "brier_score", "accuracy")


@query("score", f"SELECT {V}, game_id, date, target, p FROM predictions WHERE variant <> '{BASELINE}'")
def _(t):
    return predictions(t).where(F.col("variant") != BASELINE)


@query("constant_baseline", f'SELECT {K}, window_no AS "window", round(avg(target), 9) AS rate FROM swf WHERE split = \'train\' GROUP BY {K}, window_no')
def _(t):
    return rounded(fit.constant_baseline(splits.walk_forward(t["examples"]), [*KEY, "window"]), "rate")


@query("standardize", f'SELECT {K}, window_no AS "window", count(*) AS n_train, round(avg(target), 9) AS rate, ' + ", ".join(
    f"round(avg({f}), 9) AS mean_{f}, round(CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END, 9) AS scale_{f}" for f in FEATURES)
    + f" FROM swf WHERE split = 'train' GROUP BY {K}, window_no")
def _(t):
    out = fit.standardize(splits.walk_forward(t["examples"]), [*KEY, "window"])
    return rounded(out, "rate", *[f"{p}_{f}" for p in ("mean", "scale") for f in FEATURES])


@query("fit_logistic")
def _(t):
    split = materialize(splits.split_60_20_20(t["examples"]), "split")
    return fit.fit_logistic(split, KEY, CANDIDATES)


CANDIDATE_SQL = " UNION ALL ".join(f"SELECT '{l}' AS league, '{c}' AS candidate" for l, names in CANDIDATES.items() for c in names)


@query("fit_violations", f"""
SELECT s.league, s.season, s.season_type, k.candidate, s.n_train, 'no_fit' AS reason
FROM (SELECT {K}, count(*) AS n_train FROM s602020 WHERE split = 'train' AND season % 3 = 0 GROUP BY {K}) s JOIN ({CANDIDATE_SQL}) k ON k.league = s.league""")
def _(t):
    """Seasons whose training targets were made all wins have no finite intercept; the others are fitted."""
    one = (F.col("split") == "train") & (F.col("season") % 3 == 0)
    split = splits.split_60_20_20(t["examples"]).withColumn("target", F.when(one, 1).otherwise(F.col("target")))
    split = materialize(split, "split")
    return fit.fit_violations(fit.fit_logistic(split, KEY, CANDIDATES), split, KEY, CANDIDATES)


@query("fit_logistic_gradient", f"""
SELECT s.league, s.season, s.season_type, k.candidate, c."C", s.n_train, 0.0::DOUBLE AS gradient
FROM (SELECT {K}, count(*) AS n_train FROM s602020 WHERE split = 'train' GROUP BY {K}) s JOIN ({CANDIDATE_SQL}) k ON k.league = s.league,
  (SELECT unnest([0.01::DOUBLE, 0.1::DOUBLE, 1.0::DOUBLE, 10.0::DOUBLE]) AS "C") c""")
def _(t):
    """Every fitted model sits where the gradient of its objective vanishes."""
    split = materialize(splits.split_60_20_20(t["examples"]), "split")
    found = fit.stationarity(fit.fit_logistic(split, KEY, CANDIDATES), split, KEY)
    return found.withColumn("gradient", F.abs(F.round("gradient", 5)))


@query("evaluate_summary", f"""
WITH w AS (SELECT * FROM swf WHERE league = 'NBA' UNION ALL SELECT * FROM swk),
t AS (SELECT {K}, window_no, count(*) AS games, CAST(sum(target) AS BIGINT) AS home_wins FROM w WHERE split = 'test' GROUP BY {K}, window_no),
b AS (SELECT {K}, window_no, avg(target) AS rate FROM w WHERE split = 'train' GROUP BY {K}, window_no)
SELECT t.league, t.season, t.season_type, t.window_no AS "window", k.candidate, t.games, t.home_wins,
       CASE WHEN k.candidate = '{BASELINE}' THEN round(b.rate, 9) END AS constant
FROM t JOIN b USING ({K}, window_no) JOIN ({CANDIDATE_SQL} UNION ALL SELECT 'NBA', '{BASELINE}' UNION ALL SELECT 'NFL', '{BASELINE}') k ON k.league = t.league""")
def _(t):
    """Each test game is predicted once per candidate of its league and window, and once by the baseline."""
    out = fit.evaluate(t["examples"])[1]
    constant = F.when(F.col("candidate") == BASELINE, F.round(F.max("p"), 9))
    return out.groupBy(*KEY, "window", "candidate").agg(
        F.count("*").alias("games"), F.sum("target").alias("home_wins"), constant.alias("constant"))


# Losses of the fixed variants stand in for a grid: the rule is the lowest loss, ties to the smaller C.
LOSS_GRID = f"""
SELECT {K}, 'fixed' AS candidate, CASE variant WHEN 'strength' THEN 0.1 WHEN 'all' THEN 1.0 WHEN 'bold' THEN 10.0 ELSE 0.01 END::DOUBLE AS "C",
       round(log_loss, 2) AS log_loss FROM (SELECT {V}, {METRICS} FROM predictions GROUP BY {V})"""


@query("select_c", f"""
SELECT {K}, candidate, "C", log_loss FROM (SELECT *, row_number() OVER (PARTITION BY {K}, candidate ORDER BY log_loss, "C") AS r FROM ({LOSS_GRID})) WHERE r = 1""")
def _(t):
    c = F.when(F.col("variant") == "strength", 0.1).when(F.col("variant") == "all", 1.0).when(F.col("variant") == "bold", 10.0).otherwise(0.01)
    losses = round_metrics(op.metrics(predictions(t), GROUP)).select(
        *KEY, F.lit("fixed").alias("candidate"), c.alias("C"), F.round("log_loss", 2).alias("log_loss"))
    return fit.select_c(losses, KEY)


view("artifacts", f"""
SELECT {K}, variant, CASE WHEN season = 1995 THEN '' ELSE concat(variant, '-', season) END AS model_id,
       CASE WHEN season = 1996 THEN 3 ELSE 2 END AS artifact_type, season = 1997 AS short, season = 1998 AS bad_scale, season = 1999 AS bad_day
FROM model_stats, (VALUES ('strength'), ('all'), ('bold')) v(variant)""")


def artifacts(t):
    """Artifacts of the fixed models with one fault per season."""
    season = F.col("season")
    models = fixed_models(t)
    return models.select(
        "league", season, "variant", F.lit(1).alias("schema_version"),
        F.when(season == 1995, "").otherwise(F.concat_ws("-", "variant", season.cast("string"))).alias("model_id"),
        F.when(season == 1996, 3).otherwise(2).alias("season_type"), F.lit(FEATURE_POLICY).alias("feature_policy"),
        F.lit(5).alias("minimum_games"),
        F.when(season == 1999, "1999-13-01").otherwise(F.col("last_date").cast("string")).alias("trained_through"),
        "features", F.when(season == 1997, F.slice("mean", 1, 2)).otherwise(F.col("mean")).alias("mean"),
        F.when(season == 1998, F.transform("scale", lambda s: -s)).otherwise(F.col("scale")).alias("scale"),
        "coefficients", "intercept")


@query("model_valid", """
SELECT *, reason IS NULL AS valid FROM (
SELECT league, season, variant, model_id, CASE WHEN model_id = '' OR artifact_type <> 2 THEN 'schema' WHEN short THEN 'shape'
 WHEN bad_day THEN 'trained_through' WHEN bad_scale THEN 'weights' END AS reason FROM artifacts)""")
def _(t):
    return fit.model_valid(artifacts(t)).select("league", "season", "variant", "model_id", "reason", "valid")


@query("model_artifact")
def _(t):
    split = materialize(splits.split_60_20_20(t["examples"]), "split")
    models = fit.select_models(fit.fit_logistic(split, KEY, CANDIDATES), split, KEY)
    return fit.model_artifact(models, split, KEY, F.concat_ws("-", "league", F.col("season").cast("string"), "candidate"))


@query("validation_candidates")
def _(t):
    """Validation loss of every fitted model of the C grid."""
    split = materialize(splits.split_60_20_20(t["examples"]), "split")
    return fit.validation_losses(fit.fit_logistic(split, KEY, CANDIDATES), split, KEY)


@query("validation_candidates_check", f"""
SELECT s.league, s.season, s.season_type, k.candidate, 4 AS grid, true AS finite, true AS least, true AS smallest_of_ties
FROM (SELECT DISTINCT {K} FROM s602020) s JOIN ({CANDIDATE_SQL}) k ON k.league = s.league""")
def _(t):
    """The selected C of every key and candidate, against the grid it was selected from."""
    split = materialize(splits.split_60_20_20(t["examples"]), "split")
    losses = materialize(fit.validation_losses(fit.fit_logistic(split, KEY, CANDIDATES), split, KEY), "losses")
    chosen = fit.select_c(losses, KEY).select(*KEY, "candidate", F.col("C").alias("chosen"), F.col("log_loss").alias("best"))
    return losses.join(chosen, [*KEY, "candidate"]).groupBy(*KEY, "candidate").agg(
        F.count("*").cast("int").alias("grid"), F.bool_and(F.expr("log_loss > 0 AND log_loss < 100")).alias("finite"),
        F.bool_and(F.expr("best <= log_loss")).alias("least"),
        F.bool_and(F.expr("log_loss > best OR C >= chosen")).alias("smallest_of_ties"))


@query("evaluate")
def _(t):
    return fit.evaluate(t["examples"])[1]


@query("cross_season")
def _(t):
    return fit.cross_season(t["games"])[1]


@query("cross_season_summary", f"""
WITH p AS (SELECT n.* FROM season_pairs n WHERE NOT EXISTS (
  SELECT 1 FROM bad_earlier b WHERE b.league = n.league AND b.season = n.earlier AND b.season_type = 2)),
c AS ({CANDIDATE_SQL} UNION ALL SELECT 'NBA', '{BASELINE}' UNION ALL SELECT 'NFL', '{BASELINE}'),
r AS (SELECT league, season, avg(target) AS rate FROM (
  SELECT *, CASE WHEN league = 'NFL' THEN week ELSE CAST(date - DATE '1970-01-01' AS INT) END AS slot FROM examples) e
  JOIN (SELECT {K}, slot, split FROM ex_slots) d USING ({K}, slot) WHERE split = 'train' GROUP BY league, season)
SELECT p.league, p.earlier, p.later, c.candidate, count(*) AS games, CAST(sum(e.target) AS BIGINT) AS home_wins,
  CAST(sum(g.home_score) AS BIGINT) AS home_points, CAST(sum(g.away_score) AS BIGINT) AS away_points,
  count(DISTINCT g.home) AS home_teams, count(DISTINCT g.away) AS away_teams,
  CASE WHEN c.candidate = '{BASELINE}' THEN round(any_value(r.rate), 9) END AS constant
FROM p JOIN examples e ON e.league = p.league AND e.season = p.later JOIN games g ON g.game_id = e.game_id
JOIN c ON c.league = p.league JOIN r ON r.league = p.league AND r.season = p.earlier
GROUP BY p.league, p.earlier, p.later, c.candidate""")
def _(t):
    """Each game of a later season is predicted once per candidate and by the baseline of the earlier one."""
    out = fit.cross_season(t["games"])[1]
    constant = F.when(F.col("candidate") == BASELINE, F.round(F.max("p"), 9))
    return out.groupBy("league", "earlier", "later", "candidate").agg(
        F.count("*").alias("games"), F.sum("target").cast("long").alias("home_wins"), F.sum("home_score").alias("home_points"),
        F.sum("away_score").alias("away_points"), F.countDistinct("home_team_id").alias("home_teams"),
        F.countDistinct("away_team_id").alias("away_teams"), constant.alias("constant"))


@query("baseline_run")
def _(t):
    return fit.baseline_run(t["examples"])[1]


@query("baseline_run_metrics", f"""
WITH rates AS (SELECT {K}, avg(target) AS p FROM s602020 WHERE split = 'train' GROUP BY {K}),
m AS (SELECT {K}, split, {METRICS}, CAST(sum(target) AS BIGINT) AS home_wins
  FROM s602020 JOIN rates USING ({K}) WHERE split <> 'train' GROUP BY {K}, split)
SELECT *, '{BASELINE}' AS candidate FROM m
UNION ALL SELECT {K}, split, games, NULL, NULL, NULL, home_wins, 'all' FROM m""")
def _(t):
    """Metrics of both models on both parts; fitted values, which SQL cannot recompute, are left out of the comparison."""
    out = fit.baseline_run(t["examples"])[1]
    by = [*KEY, "split", "candidate"]
    wins = out.groupBy(*by).agg(F.sum("target").cast("long").alias("home_wins"))
    found = round_metrics(op.metrics(out, by)).join(wins, by)
    constant = F.col("candidate") == BASELINE
    return found.select(*by, "games", "home_wins", *[F.when(constant, F.col(c)).alias(c) for c in ("log_loss", "brier_score", "accuracy")])


# --- metrics ---------------------------------------------------------------------------------
@query("metrics", f"SELECT {V}, {METRICS} FROM predictions GROUP BY {V}")
def _(t):
    return round_metrics(op.metrics(predictions(t), GROUP))


@query("metrics_by_date", f"SELECT {V}, date, {METRICS} FROM predictions GROUP BY {V}, date")
def _(t):
    return round_metrics(op.metrics_by_date(predictions(t), GROUP))


@query("pooled_metrics", f"SELECT league, variant, {METRICS} FROM predictions GROUP BY league, variant")
def _(t):
    return round_metrics(op.metrics(predictions(t), ["league", "variant"]))


view("bins", f"""
SELECT {V}, CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS games, avg(p) AS mean_probability, avg(target) AS observed_home_win_rate
FROM predictions GROUP BY ALL""")
view("full_bins", f"""
SELECT g.league, g.season, g.season_type, g.variant, g.bin, g.bin / 10.0::DOUBLE AS lower, (g.bin + 1) / 10.0::DOUBLE AS upper,
       coalesce(b.games, 0) AS games, round(b.mean_probability, 6) AS mean_probability, round(b.observed_home_win_rate, 6) AS observed_home_win_rate
FROM (SELECT *, CAST(unnest(range(10)) AS INT) AS bin FROM (SELECT DISTINCT {V} FROM predictions)) g LEFT JOIN bins b USING ({V}, bin)""")


@query("calibration_bins", "SELECT * FROM full_bins")
def _(t):
    return rounded(op.calibration_bins(predictions(t), GROUP), "mean_probability", "observed_home_win_rate", digits=6)


@query("calibration_gap", f"""
SELECT {V}, round(sum(games * abs(mean_probability - observed_home_win_rate)) / sum(games), 6) AS calibration_gap FROM bins GROUP BY {V}""")
def _(t):
    return rounded(op.calibration_gap(predictions(t), GROUP), "calibration_gap", digits=6)


@query("confident_predictions", f"""
SELECT {V}, count(*) FILTER (WHERE greatest(p, 1 - p) >= 0.8) AS confident,
       count(*) FILTER (WHERE greatest(p, 1 - p) >= 0.8 AND (p >= 0.5) = (target = 1)) AS correct FROM predictions GROUP BY {V}""")
def _(t):
    return op.confident_predictions(predictions(t), GROUP)


@query("confident_errors", f"""
SELECT {V}, CAST(r AS INT) AS rank, game_id, date, target, p, confidence FROM (
SELECT *, row_number() OVER (PARTITION BY {V} ORDER BY confidence DESC, date, game_id) AS r FROM (
SELECT *, greatest(p, 1 - p) AS confidence FROM predictions WHERE (p >= 0.5) <> (target = 1))) WHERE r <= 20""")
def _(t):
    return op.confident_errors(predictions(t), GROUP)


@query("invalid_probability", f"""
SELECT {V}, game_id, p FROM (SELECT {V}, game_id, p * 1.2::DOUBLE - 0.1::DOUBLE AS p FROM predictions) WHERE p < 0 OR p > 1""")
def _(t):
    stretched = predictions(t).withColumn("p", F.col("p") * 1.2 - 0.1)
    return op.invalid_probability(stretched).select(*GROUP, "game_id", "p")
