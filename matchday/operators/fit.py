"""Fitting, selecting and scoring home-win models.

All models of a run (key x window x candidate x C) are fitted together.  One Newton pass is one
distributed aggregation: every training row adds to the loss, gradient and curvature sums of the
models it trains, map tasks combine those sums, and what comes back is one fixed-size row per model.
The number of passes does not grow with the number of models up to MODELS_PER_PASS, and no group of
rows is ever gathered in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchday.functions import expr
from matchday.functions.domain import (
    BASELINE, C_GRID, CANDIDATES, FEATURE_POLICY, FEATURE_SETS, FEATURES, KEY, LEAGUES, MAX_ITERATIONS,
    MINIMUM_GAMES, REGULAR)
from matchday.session import materialize

WIDTH = len(FEATURES)
TOLERANCE = 1e-10
# Bounds what one pass sends to the executors and brings back: about a megabyte each way.
MODELS_PER_PASS = 5000


def constant_baseline(split: DataFrame, by: list[str]) -> DataFrame:
    return split.where("split = 'train'").groupBy(*by).agg(F.avg("target").alias("rate"))


def standardize(split: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation of the training rows; a constant feature keeps scale one."""
    stats = []
    for name in FEATURES:
        sd = F.stddev_pop(name)
        stats += [F.avg(name).alias(f"mean_{name}"), F.when(sd == 0, 1.0).otherwise(sd).alias(f"scale_{name}")]
    return split.where("split = 'train'").groupBy(*by).agg(
        F.count("*").alias("n_train"), F.avg("target").alias("rate"), *stats)


def _pass(train: DataFrame, by: list[str], spark: SparkSession, stats: dict, models: list[dict]) -> dict:
    """Loss, gradient and curvature sums at the models' current weights."""
    types = {f.name: f.dataType.simpleString() for f in train.schema.fields}
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in by], "model_id int", "b double",
                        *[f"w{j} double" for j in range(WIDTH)],
                        *[f"m{j} double" for j in range(WIDTH)], *[f"s{j} double" for j in range(WIDTH)]])
    rows = [
        (*m["group"], i, *map(float, m["trial"]), *stats[m["group"]]["mean"], *stats[m["group"]]["scale"])
        for i, m in models
    ]
    # A driver-built table of one short row per model: its size is known before it is sent.
    weights = F.broadcast(spark.createDataFrame(rows, schema))
    scaled = train.join(weights, by).selectExpr(
        "model_id", "target", "b", *[f"w{j}" for j in range(WIDTH)],
        *[f"({name} - m{j}) / s{j} AS x{j}" for j, name in enumerate(FEATURES)])
    z = " + ".join(["b", *[f"w{j} * x{j}" for j in range(WIDTH)]])
    scored = (
        scaled.selectExpr("*", f"{z} AS z").selectExpr("*", "exp(-abs(z)) AS e")
        .selectExpr("*", "CASE WHEN z >= 0 THEN 1 / (1 + e) ELSE e / (1 + e) END AS p")
        # log(1 + exp(z)) - y z, without overflow
        .selectExpr("*", "greatest(z, 0.0D) + log1p(e) - target * z AS loss", "p - target AS r", "p * (1 - p) AS v")
    )
    x = ["1.0D", *[f"x{j}" for j in range(WIDTH)]]
    sums = ["sum(loss) AS loss", *[f"sum(r * {x[j]}) AS g{j}" for j in range(WIDTH + 1)],
            *[f"sum(v * {x[j]} * {x[k]}) AS h{j}_{k}" for j in range(WIDTH + 1) for k in range(j + 1)]]
    return {row["model_id"]: row for row in scored.groupBy("model_id").agg(*map(F.expr, sums)).collect()}


def fit_logistic(split: DataFrame, by: list[str], candidates: dict[str, tuple], grid=C_GRID,
                 max_iterations: int = MAX_ITERATIONS, stats: DataFrame | None = None) -> DataFrame:
    """L2 logistic regressions, intercept unpenalised: minimise C * sum(loss) + |w|^2 / 2 on
    standardised features.  ``candidates`` maps a league to its feature-set names.

    A model fails alone: one that does not converge, or whose equations have no single finite solution, is left out, with the
    other C of its group and candidate, since C could not be chosen fairly among the rest.  ``fit_violations`` lists them.
    The training rows are written once, clustered by group, and every pass reads them there.
    """
    spark = split.sparkSession
    train = split.where("split = 'train'").select(*by, "target", *FEATURES)
    train = materialize(train.repartitionByRange(*by).sortWithinPartitions(*by), "train")
    # One short row per (key, window): bounded by seasons times windows, not by games.
    stats_rows = (standardize(split, by) if stats is None else stats).collect()
    info = {
        tuple(r[c] for c in by): {
            "n": r["n_train"], "rate": r["rate"], "league": r["league"],
            "mean": [r[f"mean_{f}"] for f in FEATURES], "scale": [r[f"scale_{f}"] for f in FEATURES]}
        for r in stats_rows
    }
    models = []
    for group, s in info.items():
        for name in candidates[s["league"]]:
            used = np.array([0] + [1 + FEATURES.index(f) for f in FEATURE_SETS[name]])
            for c in grid:
                models.append({"group": group, "candidate": name, "C": c, "used": used, "iterations": 0,
                               "trial": np.zeros(WIDTH + 1), "base": None, "value": np.inf, "done": s["rate"] in (0, 1),
                               "failed": "one_class" if s["rate"] in (0, 1) else None})
    for _ in range(max_iterations):
        active = [(i, m) for i, m in enumerate(models) if not m["done"]]
        if not active:
            break
        # models of a group at equal weights, as all are at first, have equal sums: these are computed once
        place = {i: (m["group"], m["trial"].tobytes()) for i, m in active}
        once = list({place[i]: (i, m) for i, m in reversed(active)}.values())
        sums = {}
        for start in range(0, len(once), MODELS_PER_PASS):
            sums.update(_pass(train, by, spark, info, once[start:start + MODELS_PER_PASS]))
        sums = {place[i]: row for i, row in sums.items()}
        results = {i: sums.get(place[i]) for i, _ in active}
        for i, m in active:
            row, u = results.get(i), m["used"]
            if row is None or not np.isfinite(row["loss"] if row["loss"] is not None else np.nan):
                m["failed"], m["done"] = "not_finite", True
                continue
            m["iterations"] += 1
            w = m["trial"][u]
            penalty = np.ones(len(u))
            penalty[0] = 0.0
            value = m["C"] * row["loss"] + 0.5 * float((penalty * w) @ w)
            if m["base"] is not None and value > m["value"] + 1e-12 * abs(m["value"]):
                m["trial"] = (m["trial"] + m["base"]) / 2  # overshoot: halve the step
                m["done"] = bool(np.max(np.abs(m["trial"] - m["base"])) < TOLERANCE)
                continue
            gradient = m["C"] * np.array([row[f"g{j}"] for j in u]) + penalty * w
            curvature = m["C"] * np.array([[row[f"h{max(j, k)}_{min(j, k)}"] for k in u] for j in u]) + np.diag(penalty)
            if np.linalg.cond(curvature) > 1 / np.finfo(float).eps:
                m["failed"], m["done"] = "singular", True
                continue
            step = np.linalg.solve(curvature, gradient)
            m["base"], m["value"] = m["trial"], value
            m["trial"] = m["trial"].copy()
            m["trial"][u] -= step
            m["done"] = bool(np.max(np.abs(step)) < TOLERANCE)
    failed = {(m["group"], m["candidate"]) for m in models if m["failed"] or not m["done"]}
    types = {f.name: f.dataType.simpleString() for f in split.schema.fields}
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in by],
                        "candidate string, C double, features array<string>, mean array<double>, scale array<double>, "
                        "coefficients array<double>, intercept double, iterations int, n_train bigint, rate double"])
    rows = []
    for m in models:
        if (m["group"], m["candidate"]) in failed:
            continue
        s, u = info[m["group"]], m["used"][1:] - 1
        rows.append((*m["group"], m["candidate"], m["C"], [FEATURES[j] for j in u], [s["mean"][j] for j in u],
                     [s["scale"][j] for j in u], [float(v) for v in m["trial"][m["used"]][1:]],
                     float(m["trial"][0]), m["iterations"], s["n"], s["rate"]))
    return spark.createDataFrame(rows, schema)


def fit_violations(models: DataFrame, split: DataFrame, by: list[str], candidates: dict[str, tuple]) -> DataFrame:
    """Groups with training rows and candidates that have no model, because a fit failed."""
    spark = split.sparkSession
    names = spark.createDataFrame([(league, name) for league, own in candidates.items() for name in own], "league string, candidate string")
    groups = split.where("split = 'train'").groupBy(*by).agg(F.count("*").alias("n_train"))
    asked = groups.join(names, "league")
    have = models.select(*by, "candidate").distinct()
    return asked.join(have, [*by, "candidate"], "left_anti").select(*by, "candidate", "n_train", F.lit("no_fit").alias("reason"))


def stationarity(models: DataFrame, split: DataFrame, by: list[str]) -> DataFrame:
    """Greatest absolute gradient component of the objective at each model's weights; zero at the optimum."""
    rows = split.where("split = 'train'").select(*by, "target", *FEATURES)
    keys = [*by, "candidate", "C"]
    residual = score(models.drop("rate", "n_train", "iterations"), rows, by).selectExpr("*", "p - target AS r")
    sums = residual.groupBy(*keys).agg(
        F.count("*").alias("n_train"), F.expr("sum(r) AS g"), *[F.expr(f"sum(r * {f}) AS g_{f}") for f in FEATURES])
    joined = models.drop("n_train").join(sums, keys)
    value = F.map_from_arrays(F.array(*[F.lit(f) for f in FEATURES]), F.array(*[F.col(f"g_{f}") for f in FEATURES]))
    parts = F.transform(F.sequence(F.lit(1), F.size("features")), lambda i: F.abs(
        F.col("C") * (F.element_at(value, F.element_at("features", i)) - F.element_at("mean", i) * F.col("g")) / F.element_at("scale", i)
        + F.element_at("coefficients", i)))
    worst = F.greatest(F.array_max(parts), F.abs(F.col("C") * F.col("g")))
    return joined.select(*keys, "n_train", worst.alias("gradient"))


def score(models: DataFrame, features: DataFrame, on: list[str]) -> DataFrame:
    """Probability of every model of a row's group; an absent feature counts as zero.

    The model's arrays are turned into one slope per known feature before the join, so scoring a row
    is plain arithmetic inside generated code.
    """
    at = "array_position(features, '{}')"
    pick = "CASE WHEN {at} > 0 THEN element_at({part}, CAST(greatest({at}, 1) AS INT)) ELSE {default}D END AS {part}_{name}"
    slopes = [pick.format(at=at.format(name), part=part, default=default, name=name) for name in FEATURES
              for part, default in (("mean", 0.0), ("scale", 1.0), ("coefficients", 0.0))]
    rest = [c for c in models.columns if c not in ("features", "mean", "scale", "coefficients")]
    joined = features.join(models.selectExpr(*rest, *slopes), on)
    terms = [
        f"({f'coalesce({n}, 0.0D)' if n in features.columns else '0.0D'} - mean_{n}) / scale_{n} * coefficients_{n}"
        for n in FEATURES]
    keep = [*features.columns, *[c for c in rest if c not in on and c != "intercept"]]
    z = " + ".join(["intercept", *terms])
    # exp(-|z|) is computed once per row; both branches are stable.
    return (
        joined.selectExpr(*[f"`{c}`" for c in keep], f"{z} AS z").selectExpr("*", "exp(-abs(z)) AS e")
        .selectExpr(*[f"`{c}`" for c in keep], "CASE WHEN z >= 0 THEN 1 / (1 + e) ELSE e / (1 + e) END AS p")
    )


def validation_losses(models: DataFrame, split: DataFrame, by: list[str]) -> DataFrame:
    held = split.where("split = 'validation'").select(*by, "target", *FEATURES)
    return score(models, held, by).groupBy(*by, "candidate", "C").agg(
        F.avg(expr.log_loss(F.col("target"), F.col("p"))).alias("log_loss"))


def select_c(losses: DataFrame, by: list[str]) -> DataFrame:
    """Lowest validation log loss; a tie goes to the smaller C."""
    return losses.groupBy(*by, "candidate").agg(
        F.min_by("C", F.struct("log_loss", "C")).alias("C"), F.min("log_loss").alias("log_loss"))


def select_models(models: DataFrame, split: DataFrame, by: list[str]) -> DataFrame:
    chosen = select_c(validation_losses(models, split, by), by).drop("log_loss")
    return models.join(chosen, [*by, "candidate", "C"], "left_semi")


def predict(models: DataFrame, split: DataFrame, by: list[str], parts: tuple = ("test",)) -> DataFrame:
    """Predictions of the selected models, and of the constant baseline once per group."""
    rows = split.where(F.col("split").isin(*parts)).select(*by, "split", "game_id", "date", "target", *FEATURES)
    base = models.groupBy(*by).agg(F.max("rate").alias("p"))
    columns = [*by, "split", "candidate", "game_id", "date", "target", "p"]
    fitted = score(models, rows, by).select(*columns)
    constant = rows.join(base, by).withColumn("candidate", F.lit(BASELINE)).select(*columns)
    return fitted.unionByName(constant)


def fit_and_predict(split: DataFrame, by: list[str], candidates: dict[str, tuple] | None = None,
                    parts: tuple = ("test",)) -> tuple[DataFrame, DataFrame]:
    """(selected models, predictions).  No refit after selection; test rows are only scored."""
    models = fit_logistic(split, by, candidates or CANDIDATES)
    selected = select_models(models, split, by)
    return selected, predict(selected, split, by, parts)


def evaluate(examples: DataFrame, candidates: dict[str, tuple] | None = None) -> tuple[DataFrame, DataFrame]:
    """Every window of every season: weekly windows for the NFL, date windows otherwise."""
    from matchday.operators import splits

    examples = materialize(examples, "examples")
    weekly = examples.where("league = 'NFL'")
    plans = splits.valid_windows(splits.plan_walk_forward(examples.where("league <> 'NFL'"))).select(
        *splits.SLOT, "window", "split").unionByName(
        splits.valid_windows(splits.plan_weekly(weekly)).select(*splits.SLOT, "window", "split"))
    plan = materialize(plans, "plan")  # days and weeks of each season: small and reused by every pass
    split = splits.assign(examples, splits.by_league(), plan, ["window", "split"])
    return fit_and_predict(split, [*KEY, "window"], candidates)


def cross_season(games: DataFrame, candidates: dict[str, tuple] | None = None,
                 chosen: list[tuple[str, int, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Tune on an earlier season, test on a later one; history restarts with each season.

    ``chosen`` names (league, earlier, later) seasons; without it every season is paired with its next one.
    """
    from matchday.operators import features, splits

    rows = materialize(features.examples(games), "examples")
    pairs = splits.cross_season_pairs(games, chosen)
    pair = [*KEY, "earlier", "later"]
    earlier = splits.earlier_split(rows).join(
        pairs.select("league", F.col("earlier").alias("season"), "earlier", "later"), ["league", "season"])
    later = rows.withColumn("split", F.lit("test")).join(
        pairs.select("league", F.col("later").alias("season"), "earlier", "later"), ["league", "season"])
    columns = ["league", "season_type", "earlier", "later", "split", "game_id", "date", "week", "target", *FEATURES]
    # Only pairs whose earlier season could be split are tested.
    usable = earlier.select("league", "earlier", "later").intersect(later.select("league", "earlier", "later"))
    split = materialize(earlier.join(usable, ["league", "earlier", "later"], "left_semi").select(*columns).unionByName(
        later.join(usable, ["league", "earlier", "later"], "left_semi").select(*columns)), "split")
    models, predictions = fit_and_predict(split, [c for c in pair if c != "season"], candidates)
    facts = games.select("league", F.col("season").alias("later"), "game_id", F.col("home").alias("home_team_id"),
                         F.col("away").alias("away_team_id"), "home_score", "away_score")
    return models, predictions.join(facts, ["league", "later", "game_id"])


def baseline_run(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One 60/20/20 split per season with all features: predictions on validation and test."""
    from matchday.operators import splits

    split = materialize(splits.split_60_20_20(examples), "split")
    every = {league: ("all",) for _, league, _ in LEAGUES}
    return fit_and_predict(split, KEY, every, ("validation", "test"))


def model_artifact(models: DataFrame, split: DataFrame, by: list[str], model_id) -> DataFrame:
    """Portable rows of fitted models, cut off at the last validation date."""
    cutoff = split.where("split = 'validation'").groupBy(*by).agg(F.max("date").cast("string").alias("trained_through"))
    return models.join(cutoff, by).select(
        *by, F.lit(1).alias("schema_version"), model_id.alias("model_id"), F.lit(FEATURE_POLICY).alias("feature_policy"),
        F.lit(MINIMUM_GAMES).alias("minimum_games"), "trained_through", "features", "mean", "scale", "coefficients",
        "intercept", "candidate", "C")


def model_valid(models: DataFrame) -> DataFrame:
    """``reason`` is the first broken rule of an artifact, or null."""
    n = F.size("features")
    all_finite = lambda name: F.forall(name, expr.finite)
    identity = (
        (F.col("schema_version") != 1) | (F.coalesce("model_id", F.lit("")) == "") | (F.length("model_id") > 100)
        | ~F.col("league").isin(*[l[1] for l in LEAGUES]) | (F.col("season_type") != REGULAR)
        | (F.col("feature_policy") != FEATURE_POLICY) | (F.col("minimum_games") != MINIMUM_GAMES))
    shape = (n < 1) | (n > WIDTH) | (F.size("mean") != n) | (F.size("scale") != n) | (F.size("coefficients") != n)
    known = F.array(*[F.lit(f) for f in FEATURES])
    weights = (
        (F.size(F.array_except("features", known)) > 0) | (F.size(F.array_distinct("features")) != n)
        | ~F.forall("scale", lambda s: s > 0) | ~all_finite("scale") | ~all_finite("mean") | ~all_finite("coefficients"))
    day = F.when(F.col("trained_through").rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.col("trained_through").try_cast("date"))
    broken = lambda c: F.coalesce(c, F.lit(True))
    reason = (
        F.when(broken(identity), "schema").when(broken(shape), "shape").when(day.isNull(), "trained_through")
        .when(broken(weights), "weights").when(~broken(expr.finite(F.col("intercept"))), "intercept"))
    return models.withColumn("reason", reason).withColumn("valid", reason.isNull())
