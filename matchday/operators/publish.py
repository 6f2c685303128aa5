"""Publication of evaluation runs as flat tables: reports, candidates, calibration and predictions.

A report document has a fixed, small part (candidates and ten bins each) and an unbounded one
(predictions).  They stay separate tables keyed by ``report_id``, so no report is ever one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchday.functions.domain import LEAGUES, OFFSET_MAX, REPORT_ID, RUN_PAGE_DEFAULT, RUN_PAGE_MAX

REPORT_FIELDS = ["report_id", "schema_version", "kind", "league", "title", "generated_at", "training_season", "test_season"]
METRIC_FIELDS = ["games", "log_loss", "brier_score", "accuracy"]
BIN_FIELDS = ["lower", "upper", "games", "mean_probability", "observed_home_win_rate"]
PREDICTION_FIELDS = ["candidate", "game_id", "date", "home_win", "probability", "home_team_id", "away_team_id",
                     "home_score", "away_score"]


def public_reports(walk_forward: DataFrame, cross_season: DataFrame) -> DataFrame:
    """Report headers of both run kinds under one schema; anything not listed stays private."""
    title = lambda *parts: F.concat(*parts)
    single = walk_forward.select(
        "report_id", F.lit(1).alias("schema_version"), F.lit("walk_forward").alias("kind"), "league",
        title("league", F.lit(" "), F.col("season").cast("string"), F.lit(" · walk-forward")).alias("title"),
        F.col("created_at").alias("generated_at"), F.col("season").alias("test_season"))
    double = cross_season.select(
        "report_id", F.lit(1).alias("schema_version"), F.lit("cross_season").alias("kind"), "league",
        title("league", F.lit(" "), F.col("training_season").cast("string"), F.lit(" → "),
              F.col("test_season").cast("string")).alias("title"),
        "generated_at", "training_season", "test_season")
    return single.unionByName(double, allowMissingColumns=True).select(*REPORT_FIELDS)


def public_candidates(metrics: DataFrame) -> DataFrame:
    return metrics.select("report_id", "candidate", *METRIC_FIELDS)


def public_calibration(bins: DataFrame) -> DataFrame:
    return bins.select("report_id", "candidate", *BIN_FIELDS)


def public_predictions(walk_forward: DataFrame, cross_season: DataFrame) -> DataFrame:
    single = walk_forward.select(
        "report_id", F.col("feature_set").alias("candidate"), "game_id", "date", "home_win",
        F.col("home_probability").alias("probability"))
    double = cross_season.select("report_id", *PREDICTION_FIELDS)
    return single.unionByName(double, allowMissingColumns=True).select("report_id", *PREDICTION_FIELDS)


def report_violations(reports: DataFrame, candidates: DataFrame, predictions: DataFrame) -> DataFrame:
    """(report_id, rule).  Predictions are reduced to flags per (report, candidate) on the map side
    before they meet the candidates."""
    def rules(df, **bad):
        found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in bad.items()]))
        return df.select("report_id", F.explode_outer(found).alias("rule")).where("rule is not null")
    header = rules(
        reports, id=~F.col("report_id").rlike(REPORT_ID), schema=F.col("schema_version") != 1,
        league=~F.col("league").isin(*[l[1] for l in LEAGUES]), title=F.coalesce("title", F.lit("")) == "")
    unit = lambda c: (F.col(c) < 0) | (F.col(c) > 1)
    metric = rules(candidates, metrics=(F.col("games") <= 0) | unit("accuracy") | (F.col("log_loss") < 0) | unit("brier_score"))
    p = F.col("probability")
    flags = predictions.groupBy("report_id", "candidate").agg(
        F.bool_or(F.coalesce((p < 0) | (p > 1) | F.isnan(p) | ~F.col("home_win").isin(0, 1)
                             | (F.coalesce("game_id", F.lit("")) == ""), F.lit(True))).alias("bad"))
    known = candidates.select("report_id", "candidate", F.lit(True).alias("known")).distinct()
    checked = flags.join(known, ["report_id", "candidate"], "left")
    prediction = rules(checked, prediction=F.col("bad") | F.col("known").isNull())
    ids = reports.select("report_id")
    no_candidates = ids.join(candidates.select("report_id").distinct(), "report_id", "left_anti").select(
        "report_id", F.lit("no_candidates").alias("rule"))
    no_predictions = ids.join(flags.select("report_id").distinct(), "report_id", "left_anti").select(
        "report_id", F.lit("no_predictions").alias("rule"))
    return reduce(DataFrame.unionByName, [header, metric, prediction, no_candidates, no_predictions]).distinct()


def report_upsert(stored: DataFrame, batch: DataFrame, violations: DataFrame) -> DataFrame:
    """Stored reports with the batch's rows in place of equal ids; any violation stops the whole batch."""
    first = violations.limit(1).collect()
    if first:
        raise ValueError(f"invalid report {first[0]['report_id']}: {first[0]['rule']}")
    return stored.join(batch.select("report_id"), "report_id", "left_anti").unionByName(batch)


def replace_reports(stored: dict[str, DataFrame], batch: dict[str, DataFrame], violations: DataFrame) -> dict[str, DataFrame]:
    """All tables of a publication (``reports`` among them): what a report of the batch had before is replaced whole, so a
    candidate, bin or prediction it no longer has does not stay.  Any violation stops the whole batch."""
    reports = report_upsert(stored["reports"], batch["reports"], violations)
    ids = batch["reports"].select("report_id").distinct()
    kept = {name: df.join(ids, "report_id", "left_anti") for name, df in stored.items() if name != "reports"}
    return {"reports": reports, **{name: df.unionByName(batch[name]) for name, df in kept.items()}}


def runs_list(reports: DataFrame) -> DataFrame:
    return reports.select("report_id", "title", "league", "kind", "generated_at").orderBy("report_id")


def run_predictions(predictions: DataFrame, report_id: str, candidate: str | None = None, limit: int = RUN_PAGE_DEFAULT,
                    offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(total, page) of one report's predictions in (candidate, date, game) order."""
    if not 1 <= limit <= RUN_PAGE_MAX or not 0 <= offset <= OFFSET_MAX:
        raise ValueError(f"limit must be 1-{RUN_PAGE_MAX}, offset 0-{OFFSET_MAX}")
    rows = predictions.where(F.col("report_id") == F.lit(report_id))
    if candidate is not None:
        rows = rows.where(F.col("candidate") == F.lit(candidate))
    return rows.agg(F.count("*").alias("total")), rows.orderBy("candidate", "date", "game_id").offset(offset).limit(limit)
