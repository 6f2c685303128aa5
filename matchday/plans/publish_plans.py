"""Registered publication queries."""

from pyspark.sql import functions as F

from matchday.functions.domain import BASELINE, KEY
from matchday.operators import fit, metrics, publish
from matchday.plans.model_plans import GROUP, METRICS, round_metrics, rounded
from matchday.plans.model_plans import predictions as scored
from matchday.plans.registry import query, view
from matchday.session import materialize

STAMP = "2026-01-01T00:00:00Z"
RUN = "concat(league, '-', CAST(season AS VARCHAR))"


def predictions(t):
    """Shared: a publication reads the same predictions for rows, metrics and calibration."""
    t.share("games")
    if "predictions" not in t.shared:
        t.share("predictions", scored(t))
    return t.shared["predictions"]


def run_id():
    return F.concat_ws("-", "league", F.col("season").cast("string"))


def runs(t):
    t.share("examples")
    keys = t.share("model_stats").select(*KEY).withColumn("report_id", run_id())
    single = keys.where("league = 'NBA'").withColumn("created_at", F.lit(STAMP))
    double = keys.where("league = 'NFL'").select(
        "report_id", "league", (F.col("season") - 2).alias("training_season"), F.col("season").alias("test_season"),
        F.lit(STAMP).alias("generated_at"))
    return single, double


def run_rows(t):
    rows = predictions(t).withColumn("report_id", run_id())
    single = rows.where("league = 'NBA'").select(
        "report_id", F.col("variant").alias("feature_set"), "game_id", "date", F.col("target").alias("home_win"),
        F.col("p").alias("home_probability"), F.lit("private").alias("note"))
    facts = t["games"].select(*KEY, "game_id", F.col("home").alias("home_team_id"), F.col("away").alias("away_team_id"),
                              "home_score", "away_score")
    double = rows.where("league = 'NFL'").join(facts, [*KEY, "game_id"]).select(
        "report_id", F.col("variant").alias("candidate"), "game_id", "date", F.col("target").alias("home_win"),
        F.col("p").alias("probability"), "home_team_id", "away_team_id", "home_score", "away_score", F.lit("private").alias("note"))
    return single, double


def run_metrics(t):
    return round_metrics(metrics.metrics(predictions(t), GROUP)).select(
        run_id().alias("report_id"), F.col("variant").alias("candidate"), *publish.METRIC_FIELDS)


def reports(t):
    return publish.public_reports(*runs(t))


view("pub_reports", f"""
SELECT {RUN} AS report_id, 1 AS schema_version, CASE league WHEN 'NBA' THEN 'walk_forward' ELSE 'cross_season' END AS kind, league,
  CASE league WHEN 'NBA' THEN concat(league, ' ', season, ' · walk-forward') ELSE concat(league, ' ', season - 2, ' → ', season) END AS title,
  '{STAMP}' AS generated_at, CASE league WHEN 'NFL' THEN season - 2 END AS training_season, season AS test_season FROM model_stats""")
view("pub_candidates", f"""
SELECT {RUN} AS report_id, variant AS candidate, games, log_loss, brier_score, accuracy
FROM (SELECT league, season, season_type, variant, {METRICS} FROM predictions GROUP BY league, season, season_type, variant)""")
view("pub_predictions", f"""
SELECT concat(p.league, '-', CAST(p.season AS VARCHAR)) AS report_id, p.variant AS candidate, p.game_id, p.date, p.target AS home_win, p.p AS probability,
  CASE WHEN p.league = 'NFL' THEN g.home END AS home_team_id, CASE WHEN p.league = 'NFL' THEN g.away END AS away_team_id,
  CASE WHEN p.league = 'NFL' THEN g.home_score END AS home_score, CASE WHEN p.league = 'NFL' THEN g.away_score END AS away_score
FROM predictions p JOIN games g ON g.game_id = p.game_id""")


@query("public_report", "SELECT r.*, c.candidate, c.games, c.log_loss, c.brier_score, c.accuracy FROM pub_reports r JOIN pub_candidates c ON c.report_id = r.report_id")
def _(t):
    return reports(t).join(publish.public_candidates(run_metrics(t)), "report_id")


@query("public_report_calibration", f"""
SELECT {RUN} AS report_id, variant AS candidate, lower, upper, games, mean_probability, observed_home_win_rate FROM full_bins""")
def _(t):
    bins = rounded(metrics.calibration_bins(predictions(t), GROUP), "mean_probability", "observed_home_win_rate", digits=6)
    return publish.public_calibration(bins.withColumn("report_id", run_id()).withColumnRenamed("variant", "candidate"))


@query("public_report_predictions", "SELECT * FROM pub_predictions")
def _(t):
    return publish.public_predictions(*run_rows(t))


view("bad_reports", """
SELECT CASE WHEN test_season = 1995 THEN concat('-', report_id) ELSE report_id END AS report_id, CASE WHEN test_season = 1996 THEN 2 ELSE 1 END AS schema_version,
  CASE WHEN test_season = 1998 THEN 'XFL' ELSE league END AS league, CASE WHEN test_season = 1997 THEN '' ELSE title END AS title
FROM pub_reports UNION ALL SELECT DISTINCT concat('empty-', league), 1, league, 'Empty' FROM pub_reports""")
view("bad_candidates", """
SELECT report_id, candidate, CASE WHEN candidate = 'all' AND contains(report_id, '1996') THEN 0 ELSE games END AS games, log_loss, brier_score,
  CASE WHEN candidate = 'bold' AND contains(report_id, '1999') THEN accuracy + 1 ELSE accuracy END AS accuracy FROM pub_candidates""")
view("bad_predictions", """
SELECT report_id, CASE WHEN contains(report_id, '2000') AND candidate = 'all' THEN 'ghost' ELSE candidate END AS candidate, game_id,
  CASE WHEN contains(report_id, '2001') AND home_win = 1 THEN 2 ELSE home_win END AS home_win, probability FROM pub_predictions""")


def broken(t):
    r, season = reports(t), F.col("test_season")
    faulty = r.select(
        F.when(season == 1995, F.concat(F.lit("-"), "report_id")).otherwise(F.col("report_id")).alias("report_id"),
        F.when(season == 1996, 2).otherwise(1).alias("schema_version"), F.when(season == 1998, "XFL").otherwise(F.col("league")).alias("league"),
        F.when(season == 1997, "").otherwise(F.col("title")).alias("title"))
    empty = r.select(F.concat(F.lit("empty-"), "league").alias("report_id"), F.lit(1).alias("schema_version"), "league", F.lit("Empty").alias("title")).distinct()
    has = lambda year: F.col("report_id").contains(year)
    candidates = run_metrics(t).withColumn("games", F.when((F.col("candidate") == "all") & has("1996"), 0).otherwise(F.col("games"))).withColumn(
        "accuracy", F.when((F.col("candidate") == "bold") & has("1999"), F.col("accuracy") + 1).otherwise(F.col("accuracy")))
    rows = publish.public_predictions(*run_rows(t)).withColumn(
        "candidate", F.when(has("2000") & (F.col("candidate") == "all"), "ghost").otherwise(F.col("candidate"))).withColumn(
        "home_win", F.when(has("2001") & (F.col("home_win") == 1), 2).otherwise(F.col("home_win")))
    return faulty.unionByName(empty), candidates, rows


@query("report_violations", """
SELECT report_id, 'id' AS rule FROM bad_reports WHERE NOT regexp_full_match(report_id, '[a-zA-Z0-9][a-zA-Z0-9_-]{0,79}')
UNION SELECT report_id, 'schema' FROM bad_reports WHERE schema_version <> 1
UNION SELECT report_id, 'league' FROM bad_reports WHERE league NOT IN ('NBA', 'NFL')
UNION SELECT report_id, 'title' FROM bad_reports WHERE title = ''
UNION SELECT report_id, 'metrics' FROM bad_candidates WHERE games <= 0 OR accuracy < 0 OR accuracy > 1 OR log_loss < 0 OR brier_score < 0 OR brier_score > 1
UNION SELECT report_id, 'prediction' FROM bad_predictions p WHERE probability < 0 OR probability > 1 OR home_win NOT IN (0, 1) OR game_id = ''
  OR NOT EXISTS (SELECT 1 FROM bad_candidates c WHERE c.report_id = p.report_id AND c.candidate = p.candidate)
UNION SELECT report_id, 'no_candidates' FROM bad_reports r WHERE NOT EXISTS (SELECT 1 FROM bad_candidates c WHERE c.report_id = r.report_id)
UNION SELECT report_id, 'no_predictions' FROM bad_reports r WHERE NOT EXISTS (SELECT 1 FROM bad_predictions c WHERE c.report_id = r.report_id)""")
def _(t):
    return publish.report_violations(*broken(t))


@query("report_upsert", """
SELECT report_id, schema_version, kind, league, CASE WHEN league = 'NFL' THEN title ELSE 'Old' END AS title, generated_at, training_season, test_season FROM pub_reports""")
def _(t):
    fresh = reports(t)
    stored = fresh.withColumn("title", F.lit("Old"))
    batch = fresh.where("league = 'NFL'")
    ids = batch.select("report_id")
    rows = publish.public_predictions(*run_rows(t)).join(ids, "report_id", "left_semi")
    found = publish.report_violations(batch, run_metrics(t).join(ids, "report_id", "left_semi"), rows)
    return publish.report_upsert(stored, batch, found)


def replaced(t):
    """Stored runs whose candidates have old names, and a batch that publishes the NFL's anew without one candidate."""
    old = F.concat(F.lit("old-"), "candidate").alias("candidate")
    bins = rounded(metrics.calibration_bins(predictions(t), GROUP), "mean_probability", "observed_home_win_rate", digits=6)
    fresh = {
        "reports": reports(t), "candidates": publish.public_candidates(run_metrics(t)),
        "calibration": publish.public_calibration(bins.withColumn("report_id", run_id()).withColumnRenamed("variant", "candidate")),
        "predictions": publish.public_predictions(*run_rows(t))}
    stored = {n: df if n == "reports" else df.select(*[old if c == "candidate" else F.col(c) for c in df.columns]) for n, df in fresh.items()}
    batch = {n: df.where("report_id LIKE 'NFL-%'") if n == "reports" else df.where("report_id LIKE 'NFL-%' AND candidate <> 'bold'")
             for n, df in fresh.items()}
    found = publish.report_violations(batch["reports"], batch["candidates"], batch["predictions"])
    return publish.replace_reports(stored, batch, found)


def replaced_sql(table):
    return f"""SELECT * REPLACE (concat('old-', candidate) AS candidate) FROM {table} WHERE report_id NOT LIKE 'NFL-%'
UNION ALL SELECT * FROM {table} WHERE report_id LIKE 'NFL-%' AND candidate <> 'bold'"""


view("pub_calibration", f"""
SELECT {RUN} AS report_id, variant AS candidate, lower, upper, games, mean_probability, observed_home_win_rate FROM full_bins""")
for _name in ("candidates", "calibration", "predictions"):
    query(f"report_replace_{_name}", replaced_sql(f"pub_{_name}"))(lambda t, n=_name: replaced(t)[n])


@query("fitted_publication", f"""
SELECT {RUN} AS report_id, candidate, count(*) AS games, CAST(sum(target) AS BIGINT) AS home_wins, 10 AS bins, 0 AS violations
FROM s602020, (SELECT unnest(['all', '{BASELINE}']) AS candidate) WHERE split = 'test' GROUP BY ALL""")
def _(t):
    """Fit, score, metrics and publication in one run: the test part of each season's split."""
    out = materialize(fit.baseline_run(t["examples"])[1].where("split = 'test'"), "fitted")
    rows = out.select(run_id().alias("report_id"), F.col("candidate").alias("feature_set"), "game_id", "date",
                      F.col("target").alias("home_win"), F.col("p").alias("home_probability"))
    keyed = out.withColumn("report_id", run_id())
    candidates = publish.public_candidates(metrics.metrics(keyed, ["report_id", "candidate"]))
    bins = publish.public_calibration(metrics.calibration_bins(keyed, ["report_id", "candidate"])).groupBy("report_id", "candidate").agg(
        F.count("*").cast("int").alias("bins"))
    double = rows.limit(0).select(*[F.lit(None).alias(c) if c not in rows.columns else F.col(c) for c in ("report_id", *publish.PREDICTION_FIELDS)])
    published = publish.public_predictions(rows, double)
    heads = out.select(*KEY).distinct().select(run_id().alias("report_id"), F.lit(1).alias("schema_version"), "league", F.lit("run").alias("title"))
    bad = publish.report_violations(heads, candidates, published).groupBy("report_id").agg(F.count("*").cast("int").alias("violations"))
    wins = published.groupBy("report_id", "candidate").agg(F.sum("home_win").cast("long").alias("home_wins"))
    return (candidates.select("report_id", "candidate", "games").join(wins, ["report_id", "candidate"])
            .join(bins, ["report_id", "candidate"]).join(bad, "report_id", "left").withColumn("violations", F.coalesce("violations", F.lit(0))))


@query("runs_list", "SELECT report_id, title, league, kind, generated_at FROM pub_reports ORDER BY report_id")
def _(t):
    return publish.runs_list(reports(t))


@query("run_predictions", """
SELECT * FROM pub_predictions WHERE report_id = 'NFL-1998' AND candidate = 'all' ORDER BY date, game_id LIMIT 200 OFFSET 100""")
def _(t):
    return publish.run_predictions(publish.public_predictions(*run_rows(t)), "NFL-1998", "all", 200, 100)[1]


@query("run_predictions_total", "SELECT count(*) AS total FROM pub_predictions WHERE report_id = 'NFL-1998'")
def _(t):
    return publish.run_predictions(publish.public_predictions(*run_rows(t)), "NFL-1998")[0]
