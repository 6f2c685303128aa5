"""Additive player statistics and season totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchday.functions import expr
from matchday.functions.domain import ADDITIVE_KEYS, KEY, PAIR_KEYS
from matchday.operators.completeness import GAME

LINE = ["league", "game_id", "player_id", "team_id", "category"]


SOURCES = {key: (key,) for key in ADDITIVE_KEYS} | PAIR_KEYS
COLLIDING = {m: [k for k, names in SOURCES.items() if m in names] for m in {n for names in SOURCES.values() for n in names}
             if sum(m in names for names in SOURCES.values()) > 1}


def usable(stats: Column, key: str) -> Column:
    """Whether a line's entry of this key gives numbers."""
    parts = expr.additive_parts(F.lit(key), stats[key])
    a, b = expr.number(F.get(parts, F.lit(0))), expr.number(F.get(parts, F.lit(1)))
    return F.coalesce((F.size(parts) == 2) & (a >= 0) & (b >= 0) if key in PAIR_KEYS else a.isNotNull(), F.lit(False))


def superseded(stats: Column) -> Column:
    """Whether an earlier key of the fixed order gives the row's metric in the same line: a line has one value per metric."""
    return reduce(lambda x, y: x | y, [
        (F.col("metric") == metric) & (F.col("key") == keys[j]) & reduce(lambda x, y: x | y, [usable(stats, k) for k in keys[:j]])
        for metric, keys in COLLIDING.items() for j in range(1, len(keys))], F.lit(False))


def repeats_metric(text: Column) -> Column:
    """True where a line may have two keys of one metric: few lines have, and only theirs are looked at again."""
    has = lambda k: text.contains(f'"{k}"').cast("int")
    return reduce(lambda x, y: x | y, [reduce(lambda x, y: x + y, map(has, keys)) > 1 for keys in COLLIDING.values()], F.lit(False))


def additive_stats(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per line and additive metric.  Row-local: no shuffle, nothing missing becomes zero.

    Where a line has several keys of one metric, the first in the fixed order that gives a number counts.
    """
    keep = keep or LINE
    key = F.col("key")
    pair = key.isin(*PAIR_KEYS)
    # Outer generators and late filters: the inner forms, and filters on computed columns, make the
    # optimizer copy the whole computation into a filter below, and every value is then parsed twice.
    numbers = (
        lines.where(~F.col("did_not_play"))
        .select(*keep, F.when(repeats_metric(F.col("stats_json")), F.col("stats_json")).alias("again"),
                F.explode_outer(expr.stats_map(F.col("stats_json"))).alias("key", "raw"))
        .where(key.isin(*ADDITIVE_KEYS, *PAIR_KEYS))
        .select(*keep, "key", "again", expr.additive_parts(key, F.col("raw")).alias("parts"))
        .select(*keep, "key", "again", F.size("parts").alias("n"), expr.number(F.get("parts", F.lit(0))).alias("a"),
                expr.number(F.get("parts", F.lit(1))).alias("b"))
    )
    both = (F.col("n") == 2) & (F.col("a") >= 0) & (F.col("b") >= 0)
    good = F.when(pair, both).otherwise(True)

    def metric(position, value):
        return F.struct(expr.pair_name(key, position).alias("metric"), F.when(good, F.col(value)).alias("value"))
    rows = numbers.select(*keep, "key", "again", F.inline_outer(F.array(metric(0, "a"), metric(1, "b"))))
    twice = F.when(F.col("again").isNotNull(), superseded(expr.stats_map(F.col("again")))).otherwise(False)
    return rows.where("metric is not null and value is not null").where(~twice).select(*keep, "metric", "value")


def player_season_totals(lines: DataFrame, complete: DataFrame) -> DataFrame:
    """Sum and number of games per player, team, key, category and metric over complete games.

    A line is unique per (game, player, category) by the table's key (checked by the constraint
    rules), so rows per group are games per group.  A player has at most a season's games.
    """
    group = [*KEY, "player_id", "team_id", "category"]
    # lines are dealt by player before they become one row per metric: a line is smaller than its metrics
    inside = lines.join(complete.select(*GAME), GAME, "left_semi").select(*group, "did_not_play", "stats_json").where(
        ~F.col("did_not_play")).repartition(*KEY, "player_id")
    return (
        additive_stats(inside, group).groupBy(*group, "metric")
        .agg(F.try_sum(F.col("value").try_cast("decimal(38,10)")).cast("double").alias("total"),
             F.count("*").alias("games_with_metric"))
    )


def player_season_teams(lines: DataFrame, complete: DataFrame) -> DataFrame:
    return lines.join(complete.select(*GAME), GAME, "left_semi").select(*KEY, "player_id", "team_id").distinct()


def participation(lines: DataFrame) -> DataFrame:
    parsed = lines.withColumn("stats", expr.stats_map(F.col("stats_json")))
    return parsed.withColumn("participation_status", expr.participation(
        F.col("league"), F.col("category"), F.col("did_not_play"), F.col("starter"), F.col("stats"))).drop("stats")
