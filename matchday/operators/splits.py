"""Time-ordered splits.

Examples are first reduced to one row per (key, date) or (key, week) with counts of games and home
wins.  Ranks, boundaries and every precondition are computed on that table, whose window partitions
are bounded by the days of a season; examples are then matched to it by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchday.functions.domain import KEY, REGULAR
from matchday.operators.features import example_counts
from matchday.operators.sinks import dataset_fingerprint

SLOT = [*KEY, "slot"]


def by_date() -> Column:
    return F.unix_date("date")


def by_week() -> Column:
    return F.col("week")


def by_league() -> Column:
    return F.when(F.col("league") == "NFL", F.col("week")).otherwise(F.unix_date("date"))


def slots(examples: DataFrame, slot: Column) -> DataFrame:
    """One row per key and slot with its rank and the number of slots ``n``."""
    reduced = examples.groupBy(*KEY, slot.alias("slot")).agg(
        F.count("*").alias("games"), F.sum("target").alias("wins"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    key = W.partitionBy(*KEY)
    return reduced.withColumn("rank", F.row_number().over(key.orderBy("slot")) - 1).withColumn(
        "n", F.count("*").over(key))


def one_class(group: list[str]) -> Column:
    """True where the group's training slots hold a single outcome class, or none."""
    part = W.partitionBy(*group)
    train = F.col("split") == "train"
    games = F.coalesce(F.sum(F.when(train, F.col("games"))).over(part), F.lit(0))
    wins = F.coalesce(F.sum(F.when(train, F.col("wins"))).over(part), F.lit(0))
    return (wins == 0) | (wins == games)


def overlap(group: list[str]) -> Column:
    """True where a training date is not before every validation date."""
    part = W.partitionBy(*group)
    last = F.max(F.when(F.col("split") == "train", F.col("last_date"))).over(part)
    first = F.min(F.when(F.col("split") == "validation", F.col("first_date"))).over(part)
    return F.coalesce(last >= first, F.lit(False))


def assign(examples: DataFrame, slot: Column, plan: DataFrame, columns: list[str]) -> DataFrame:
    """Attach split columns of a slot plan; the plan is unique per key, slot and window."""
    return examples.withColumn("slot", slot).join(plan.select(*SLOT, *columns), SLOT).drop("slot")


# --- 60/20/20 --------------------------------------------------------------------------------
def plan_60_20_20(examples: DataFrame) -> DataFrame:
    rank, n = F.col("rank"), F.col("n")
    split = F.when(rank < F.floor(n * 0.6), "train").when(rank < F.floor(n * 0.8), "validation").otherwise("test")
    plan = slots(examples, by_date()).withColumn("split", split)
    return plan.withColumn("reason", F.when(n < 5, "too_few_dates").when(one_class(KEY), "one_class"))


def split_60_20_20(examples: DataFrame) -> DataFrame:
    return assign(examples, by_date(), plan_60_20_20(examples).where("reason is null"), ["split"])


# --- walk forward ----------------------------------------------------------------------------
def plan_walk_forward(examples: DataFrame) -> DataFrame:
    rank, n, i = F.col("rank"), F.col("n"), F.col("window") - 1
    bound = lambda share: F.floor(n * (share + i) / 10)
    split = F.when(rank < bound(4), "train").when(rank < bound(6), "validation").when(rank < bound(7), "test")
    plan = slots(examples, by_date()).withColumn("window", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("split", split)
    return plan.withColumn("reason", F.when(n < 10, "too_few_dates").when(one_class([*KEY, "window"]), "one_class"))


def valid_windows(plan: DataFrame) -> DataFrame:
    """Slots of keys without any violation: one bad window rejects its whole key."""
    bad = F.max(F.col("reason").isNotNull()).over(W.partitionBy(*KEY))
    return plan.withColumn("bad", bad).where("not bad and split is not null")


def walk_forward(examples: DataFrame) -> DataFrame:
    return assign(examples, by_date(), valid_windows(plan_walk_forward(examples)), ["window", "split"])


# --- weekly windows --------------------------------------------------------------------------
def plan_weekly(examples: DataFrame) -> DataFrame:
    key = W.partitionBy(*KEY)
    base = slots(examples, by_week())
    rank, n = F.col("rank"), F.col("n")
    gaps = F.max("slot").over(key) - F.min("slot").over(key) + 1 != n
    flagged = (
        base.withColumn("clash", F.coalesce(F.col("last_date") >= F.lead("first_date").over(key.orderBy("slot")), F.lit(False)))
        .withColumn("reason", F.when(F.max(F.col("slot").isNull()).over(key), "missing_week").when(n < 8, "too_few_weeks")
                    .when(gaps, "week_gap").when(F.max("clash").over(key), "date_overlap"))
    )
    first = 6 + (n - 6) % 2
    starts = F.when(n >= 8, F.sequence(first, n - 1, F.lit(2).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    start = F.col("start")
    split = F.when(rank < start - 2, "train").when(rank < start, "validation").when(rank < start + 2, "test")
    plan = flagged.withColumn("start", F.explode(starts)).withColumn("split", split).withColumn(
        "window", F.when(n >= 8, ((start - first) / 2 + 1).cast("int")).otherwise(1))
    return plan.withColumn("reason", F.coalesce("reason", F.when(one_class([*KEY, "window"]), "one_class")))


def weekly_windows(examples: DataFrame) -> DataFrame:
    return assign(examples, by_week(), valid_windows(plan_weekly(examples)), ["window", "split"])


# --- earlier season --------------------------------------------------------------------------
def plan_earlier(examples: DataFrame) -> DataFrame:
    n = F.col("n")
    split = F.when(F.col("rank") < F.floor(n * 4 / 5), "train").otherwise("validation")
    plan = slots(examples, by_league()).withColumn("split", split)
    missing = F.max(F.col("slot").isNull()).over(W.partitionBy(*KEY))
    return plan.withColumn("reason", F.when(missing, "missing_week").when(n < 5, "too_few_groups")
                           .when(overlap(KEY), "date_overlap").when(one_class(KEY), "one_class"))


def earlier_split(examples: DataFrame) -> DataFrame:
    return assign(examples, by_league(), plan_earlier(examples).where("reason is null"), ["split"])


def violations(plan: DataFrame) -> DataFrame:
    """Keys a plan refuses, with the first reason found."""
    return plan.where("reason is not null").groupBy(*KEY).agg(F.min("reason").alias("reason"))


# --- seasons ---------------------------------------------------------------------------------
def neighbours(games: DataFrame) -> DataFrame:
    """Each regular season with the next stored one of its league."""
    seasons = games.where((F.col("season_type") == REGULAR) & (F.col("status") == "final")).groupBy("league", "season").agg(
        F.min("starts_at").alias("first"), F.max("starts_at").alias("last"))
    order = W.partitionBy("league").orderBy("season")
    return (
        seasons.withColumn("later", F.lead("season").over(order)).withColumn("later_first", F.lead("first").over(order))
        .where("later is not null")
        .select("league", F.col("season").alias("earlier"), "later", F.col("last").alias("earlier_last"), "later_first")
    )


def chosen_seasons(games: DataFrame, chosen: list[tuple[str, int, int]]) -> DataFrame:
    """The given (league, earlier, later) seasons with the dates that decide whether they are a pair; null where none is stored."""
    dates = games.where((F.col("season_type") == REGULAR) & (F.col("status") == "final")).groupBy("league", "season").agg(
        F.min("starts_at").alias("first"), F.max("starts_at").alias("last"))
    asked = games.sparkSession.createDataFrame(chosen, "league string, earlier int, later int").distinct()
    return (asked.join(dates.select("league", F.col("season").alias("earlier"), F.col("last").alias("earlier_last")), ["league", "earlier"], "left")
            .join(dates.select("league", F.col("season").alias("later"), F.col("first").alias("later_first")), ["league", "later"], "left")
            .select("league", "earlier", "later", "earlier_last", "later_first"))


def judged_pairs(games: DataFrame, chosen: list[tuple[str, int, int]] | None) -> DataFrame:
    """The given seasons, or all neighbours of a league, with the first reason why they are no pair."""
    found = neighbours(games) if chosen is None else chosen_seasons(games, chosen)
    reason = (F.when(F.col("earlier") >= F.col("later"), "season_order")
              .when(F.col("earlier_last").isNull() | F.col("later_first").isNull(), "season_missing")
              .when(F.col("earlier_last") >= F.col("later_first"), "season_overlap"))
    return found.withColumn("reason", reason)


def cross_season_pairs(games: DataFrame, chosen: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """Regular seasons, the earlier one first, whose dates do not overlap."""
    return judged_pairs(games, chosen).where("reason IS NULL").drop("reason")


def cross_season_violations(games: DataFrame, examples: DataFrame, chosen: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """Every given (or neighbouring) pair that is not run, with the first reason: the seasons' order, a season that is not
    stored, dates that overlap, an earlier season that cannot be split, a later one without eligible games."""
    pair = ["league", "earlier", "later"]
    judged = judged_pairs(games, chosen).select(*pair, "reason")
    regular = examples.where(F.col("season_type") == REGULAR)
    known = regular.select("league", "season").distinct()
    refused = violations(plan_earlier(regular)).select("league", F.col("season").alias("earlier"), F.col("reason").alias("split_reason"))
    dated = (judged.join(refused, ["league", "earlier"], "left")
             .join(known.select("league", F.col("season").alias("earlier"), F.lit(True).alias("has_earlier")), ["league", "earlier"], "left")
             .join(known.select("league", F.col("season").alias("later"), F.lit(True).alias("has_later")), ["league", "later"], "left"))
    whole = F.coalesce("reason", "split_reason", F.when(F.col("has_earlier").isNull(), "too_few_groups"),
                       F.when(F.col("has_later").isNull(), "no_later_games"))
    return dated.select(*pair, whole.alias("reason")).where("reason IS NOT NULL")


def before_holdout(games: DataFrame, holdouts: dict[str, int]) -> DataFrame:
    inside = F.lit(False)
    for league, season in sorted(holdouts.items()):
        inside = inside | ((F.col("league") == league) & (F.col("season") < season))
    return games.where(inside & (F.col("season_type") == REGULAR))


def season_inventory_violations(games: DataFrame, holdouts: dict[str, int]) -> DataFrame:
    """Leagues that the inventory leaves out: fewer than two development seasons, or none, before the holdout."""
    found = before_holdout(games, holdouts).select("league", "season").distinct().groupBy("league").agg(
        F.count("*").alias("development_seasons"))
    asked = games.sparkSession.createDataFrame(sorted(holdouts.items()), "league string, holdout int")
    return asked.join(found, "league", "left").select(
        "league", "holdout", F.coalesce("development_seasons", F.lit(0)).alias("development_seasons")).where(
        "development_seasons < 2")


def season_inventory(games: DataFrame, holdouts: dict[str, int], fingerprints: bool = False) -> DataFrame:
    """Counts of development seasons strictly before each league's holdout.

    The filter is on partition columns only, so holdout partitions are never opened.
    """
    development = before_holdout(games, holdouts)
    counts = example_counts(development)
    inventory = counts.withColumn("development_seasons", F.count("*").over(W.partitionBy("league"))).where(
        "development_seasons >= 2").drop("development_seasons")
    return inventory.join(dataset_fingerprint(development, KEY), KEY) if fingerprints else inventory


def split_summary(split: DataFrame, by: list[str]) -> DataFrame:
    return split.groupBy(*by, "split").agg(
        F.count("*").alias("games"), F.min("date").alias("from"), F.max("date").alias("to"),
        F.sum("target").alias("home_wins"), F.sort_array(F.collect_set("week")).alias("weeks"))
