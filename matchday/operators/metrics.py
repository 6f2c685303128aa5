"""Metrics and diagnostics of predictions (columns: group..., game_id, date, target, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchday.functions import expr
from matchday.functions.domain import CALIBRATION_BINS, CONFIDENCE, CONFIDENT_ERRORS


def hit():
    return (F.col("p") >= 0.5).cast("int") == F.col("target")


def confidence():
    return F.greatest(F.col("p"), 1 - F.col("p"))


def metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Pooled over all rows of the group; works with a single outcome class."""
    return predictions.groupBy(*by).agg(
        F.count("*").alias("games"),
        F.avg(expr.log_loss(F.col("target"), F.col("p"))).alias("log_loss"),
        F.avg(F.pow(F.col("p") - F.col("target"), F.lit(2.0))).alias("brier_score"),
        F.avg(hit().cast("double")).alias("accuracy"))


def metrics_by_date(predictions: DataFrame, by: list[str]) -> DataFrame:
    return metrics(predictions, [*by, "date"])


def filled_bins(predictions: DataFrame, by: list[str]) -> DataFrame:
    index = F.least(F.floor(F.col("p") * CALIBRATION_BINS), F.lit(CALIBRATION_BINS - 1)).cast("int")
    return predictions.groupBy(*by, index.alias("bin")).agg(
        F.count("*").alias("games"), F.avg("p").alias("mean_probability"),
        F.avg("target").alias("observed_home_win_rate"))


def calibration_bins(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Ten equal bins per group; empty ones stay, with nulls.

    The pivot to one row per group and back keeps empty bins without a second scan or a join.
    """
    cells = F.struct("games", "mean_probability", "observed_home_win_rate")
    filled = filled_bins(predictions, by)
    per_group = filled.groupBy(*by).agg(*[
        F.max(F.when(F.col("bin") == i, cells)).alias(f"b{i}") for i in range(CALIBRATION_BINS)])
    bins = F.array(*[
        F.struct(F.lit(i).alias("bin"), F.lit(i / CALIBRATION_BINS).alias("lower"), F.lit((i + 1) / CALIBRATION_BINS).alias("upper"),
                 F.coalesce(F.col(f"b{i}.games"), F.lit(0)).alias("games"),
                 F.col(f"b{i}.mean_probability").alias("mean_probability"),
                 F.col(f"b{i}.observed_home_win_rate").alias("observed_home_win_rate"))
        for i in range(CALIBRATION_BINS)])
    return per_group.select(*by, F.inline(bins))


def calibration_gap(predictions: DataFrame, by: list[str]) -> DataFrame:
    weight = F.col("games") * F.abs(F.col("mean_probability") - F.col("observed_home_win_rate"))
    return filled_bins(predictions, by).groupBy(*by).agg((F.sum(weight) / F.sum("games")).alias("calibration_gap"))


def confident_predictions(predictions: DataFrame, by: list[str]) -> DataFrame:
    sure = confidence() >= CONFIDENCE
    return predictions.groupBy(*by).agg(
        F.count_if(sure).alias("confident"), F.count_if(sure & hit()).alias("correct"))


def confident_errors(predictions: DataFrame, by: list[str], limit: int = CONFIDENT_ERRORS) -> DataFrame:
    """The most confident wrong predictions of each group.  Planned with a map-side group limit, so at
    most ``limit`` rows per group and input partition are shuffled."""
    wrong = predictions.where(~hit()).withColumn("confidence", confidence())
    order = W.partitionBy(*by).orderBy(F.desc("confidence"), "date", "game_id")
    return wrong.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(
        *by, "rank", "game_id", "date", "target", "p", "confidence")


def invalid_probability(predictions: DataFrame) -> DataFrame:
    p = F.col("p")
    return predictions.where(p.isNull() | F.isnan(p) | (p < 0) | (p > 1))
