"""Splits, fits, scoring and metrics."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler

from conftest import as_dicts
from matchday.functions.domain import FEATURES, KEY
from matchday.operators import fit, metrics, splits

EXAMPLES = ("league string, season int, season_type int, game_id string, date date, week int, "
            + ", ".join(f"{f} double" for f in FEATURES) + ", target int")


def example_rows(n, league="NBA", season=2026, week=lambda i: i // 7 + 1, seed=0, start=date(2025, 10, 1)):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(FEATURES))) * [0.2, 5, 5, 7, 0.3, 8, 2] + 1
    p = 1 / (1 + np.exp(-(0.8 * x[:, 0] + 0.1 * x[:, 3] - 0.5)))
    y = (rng.random(n) < p).astype(int)
    y[:2] = [0, 1]
    return [(league, season, 2, f"{league}{season}-{i:04d}", start + timedelta(days=i), week(i), *map(float, x[i]), int(y[i])) for i in range(n)]


@pytest.fixture
def examples(spark):
    return lambda rows: spark.createDataFrame(rows, EXAMPLES)


def newton(x, y, c):
    """Plain single-machine minimiser of C * loss + |w|^2 / 2, intercept free."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(a.shape[1]), np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve(c * (a * (p * (1 - p))[:, None]).T @ a + ridge, c * a.T @ (p - y) + ridge @ w)
        w = w - step
    return w


def test_batched_fit_matches_newton_and_ml(spark, examples):
    rows = example_rows(150)
    split = splits.split_60_20_20(examples(rows)).cache()
    models = fit.fit_logistic(split, KEY, {"NBA": ("all", "rest")}).collect()
    train = [r for r in rows if r[4] < date(2025, 10, 1) + timedelta(days=90)]
    x, y = np.array([r[6:13] for r in train]), np.array([r[13] for r in train])
    for m in models:
        used = [FEATURES.index(f) for f in m.features]
        z = (x[:, used] - x[:, used].mean(0)) / x[:, used].std(0)
        want = newton(z, y, m.C)
        assert np.allclose([m.intercept, *m.coefficients], want, atol=1e-8)
        assert np.allclose(m.mean, x[:, used].mean(0)) and np.allclose(m.scale, x[:, used].std(0))
    (one,) = [m for m in models if m.candidate == "all" and m.C == 1.0]
    z = (x - x.mean(0)) / x.std(0)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(z, y)], [*FEATURES, "label"])
    ml = LogisticRegression(regParam=1 / len(y), elasticNetParam=0.0, standardization=False, tol=1e-12, maxIter=2000).fit(
        VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df))
    assert np.allclose(one.coefficients, ml.coefficients.toArray(), atol=1e-6)
    assert len(models) == 8 and max(m.iterations for m in models) < 20


def test_constant_feature_keeps_scale_one(examples):
    rows = [r[:12] + (3.0,) + r[13:] for r in example_rows(60)]
    (s,) = fit.standardize(splits.split_60_20_20(examples(rows)), KEY).collect()
    assert s.scale_rest_days_diff == 1.0 and s.mean_rest_days_diff == 3.0


def test_too_few_iterations_leave_no_model_and_are_listed(examples):
    split, names = splits.split_60_20_20(examples(example_rows(60))), {"NBA": ("all",)}
    models = fit.fit_logistic(split, KEY, names, max_iterations=2)
    assert models.count() == 0
    assert [(r.candidate, r.reason) for r in fit.fit_violations(models, split, KEY, names).collect()] == [("all", "no_fit")]


@pytest.mark.parametrize("fault", ["one_class", "not_finite"])
def test_a_group_that_cannot_be_fitted_leaves_the_others_alone(examples, fault):
    names = {"NBA": ("all", "strength")}
    good = splits.split_60_20_20(examples(example_rows(60)))
    bad = good.withColumn("season", F.col("season") + 1)
    bad = bad.withColumn("target", F.lit(1)) if fault == "one_class" else bad.withColumn(FEATURES[0], F.lit(float("nan")))
    both = good.unionByName(bad)
    fitted = lambda df: sorted((r.season, r.candidate, r.C, [round(c, 8) for c in r.coefficients]) for r in fit.fit_logistic(df, KEY, names).collect())
    alone = fitted(good)
    assert len(alone) == 8 and fitted(both) == alone
    listed = fit.fit_violations(fit.fit_logistic(both, KEY, names), both, KEY, names).collect()
    season = alone[0][0]
    assert {(r.season, r.candidate) for r in listed} == {(season + 1, "all"), (season + 1, "strength")}


def test_tie_goes_to_the_smaller_c(spark):
    losses = spark.createDataFrame([("k", "a", 10.0, 0.5), ("k", "a", 0.1, 0.5), ("k", "a", 1.0, 0.6)], "g string, candidate string, C double, log_loss double")
    assert fit.select_c(losses, ["g"]).first().C == 0.1


def test_test_labels_change_nothing_but_the_test_metrics(examples):
    rows = example_rows(120)
    flipped = [r[:13] + (1 - r[13],) if i >= 96 else r for i, r in enumerate(rows)]
    fitted = [sorted((m.candidate, m.C, round(m.intercept, 9)) for m in fit.baseline_run(examples(r))[0].collect()) for r in (rows, flipped)]
    assert fitted[0] == fitted[1]


def test_scoring_parity(spark):
    # A published artifact and its expected probability.
    model = dict(
        mean=[0.08333333333333333, 2.8333333333333335, 0.0, 2.8333333333333335, 0.06666666666666667, 1.8333333333333333, 0.3333333333333333],
        scale=[0.21147629234082535, 4.058598553961973, 2.3804761428476167, 6.148622248565572, 0.2494438257849294, 5.177408189003023, 1.247219128924647],
        coefficients=[0.15423342146062743, 0.13253911549675992, -0.11748818993225153, 0.1329730243046498, 0.14358861865429332, 0.1404456938369941, 0.03432004799384156])
    models = spark.createDataFrame([("NBA", list(FEATURES), model["mean"], model["scale"], model["coefficients"], -0.0035982366284999408)],
                                   "league string, features array<string>, mean array<double>, scale array<double>, coefficients array<double>, intercept double")
    rows = spark.createDataFrame([("NBA", 0.1, 3.0, 1.0, 2.0, 0.2, 4.0, 1.0)], ["league", *FEATURES])
    assert abs(fit.score(models, rows, ["league"]).first().p - 0.5251022246856282) < 1e-12
    partial = fit.score(models, rows.select("league", "win_rate_diff"), ["league"]).first().p
    z = -0.0035982366284999408 + sum((v - m) / s * c for v, m, s, c in zip([0.1] + [0.0] * 6, model["mean"], model["scale"], model["coefficients"]))
    assert abs(partial - 1 / (1 + math.exp(-z))) < 1e-12


def weekly(weeks=range(1, 14), gap=None, clash=False):
    rows = []
    for w in weeks:
        day = date(2025, 9, 1) + timedelta(days=7 * w - (8 if clash and w == 5 else 0))
        for k in range(2):
            rows.append(("NFL", 2025, 2, f"{w}-{k}", day + timedelta(days=k), None if w == gap else w, *([float(w)] * 7), k))
    return rows


def test_weekly_windows_are_disjoint_and_reach_the_end(examples):
    out = as_dicts(splits.weekly_windows(examples(weekly())))
    tests = {}
    for r in out:
        if r["split"] == "test":
            tests.setdefault(r["window"], set()).add(r["week"])
    assert tests == {1: {8, 9}, 2: {10, 11}, 3: {12, 13}}
    for w, weeks in tests.items():
        train = {r["week"] for r in out if r["window"] == w and r["split"] == "train"}
        assert train == set(range(1, min(weeks) - 2))


@pytest.mark.parametrize("rows, reason", [
    (weekly(range(1, 8)), "too_few_weeks"), (weekly(gap=6), "missing_week"), (weekly([*range(1, 6), *range(7, 14)]), "week_gap"),
    (weekly(clash=True), "date_overlap")])
def test_weekly_faults(examples, rows, reason):
    plan = splits.plan_weekly(examples(rows))
    assert [r.reason for r in splits.violations(plan).collect()] == [reason]
    assert splits.weekly_windows(examples(rows)).count() == 0


def test_walk_forward_shares(examples):
    out = as_dicts(splits.walk_forward(examples(example_rows(20))))
    sizes = {(w, s): sum(1 for r in out if (r["window"], r["split"]) == (w, s)) for w in range(1, 5) for s in ("train", "validation", "test")}
    assert [sizes[w, "train"] for w in range(1, 5)] == [8, 10, 12, 14]
    assert all(sizes[w, "validation"] == 4 and sizes[w, "test"] == 2 for w in range(1, 5))


def test_one_class_and_too_few(examples):
    ones = [r[:13] + (1,) for r in example_rows(20)]
    assert splits.violations(splits.plan_60_20_20(examples(ones))).first().reason == "one_class"
    assert splits.violations(splits.plan_60_20_20(examples(example_rows(4)))).first().reason == "too_few_dates"


def test_constant_half_metrics(spark):
    df = spark.createDataFrame([("m", f"g{i}", date(2026, 1, 1), 1, 0.5) for i in range(4)], "v string, game_id string, date date, target int, p double")
    m = metrics.metrics(df, ["v"]).first()
    assert m.brier_score == 0.25 and abs(m.log_loss - 0.69314718056) < 1e-11 and m.accuracy == 1.0


def test_diagnostics_edges(spark):
    data = [("m", "a", 1, 0.0), ("m", "b", 0, 1.0), ("m", "c", 1, 0.5), ("m", "d", 0, 0.2)]
    df = spark.createDataFrame([(v, g, date(2026, 1, 1), y, p) for v, g, y, p in data], "v string, game_id string, date date, target int, p double")
    bins = {r.bin: r for r in metrics.calibration_bins(df, ["v"]).collect()}
    assert len(bins) == 10 and bins[0].observed_home_win_rate == 1 and bins[9].games == 1
    assert bins[3].games == 0 and bins[3].mean_probability is None
    errors = metrics.confident_errors(df, ["v"]).orderBy("rank").collect()
    assert [e.game_id for e in errors] == ["a", "b"] and errors[0].confidence == 1
    assert metrics.invalid_probability(df).count() == 0
    assert math.isfinite(metrics.metrics(df, ["v"]).first().log_loss)


def test_cross_season_pairs_and_reset(games):
    from conftest import season_rows
    from matchday.functions.domain import CANDIDATES
    first, second = season_rows(), season_rows()
    for i, r in enumerate(second):
        r[1], r[3], r[4] = 2027, "n" + r[3], r[4] + timedelta(days=365)
    for r in [*first, *second]:
        if int(r[3][-2:]) % 4 == 0:
            r[8] = 40
    models, predictions = fit.cross_season(games(first + second))
    out = predictions.collect()
    assert {r.candidate for r in out} == {"constant_home_rate", *CANDIDATES["NBA"]}
    assert {r.game_id for r in out} == {f"ng{i:02d}" for i in range(5, 40)}
    changed = [list(r) for r in second]
    for r in changed:
        r[8], r[9] = 90, 10
    again, _ = fit.cross_season(games(first + changed))
    key = lambda df: sorted((m.candidate, m.C, round(m.intercept, 9)) for m in df.collect())
    assert key(models) == key(again)


def test_models_at_equal_weights_share_their_sums(examples, monkeypatch):
    """all models start at zero, so the first pass has one set of sums a group."""
    asked, plain = [], fit._pass
    monkeypatch.setattr(fit, "_pass", lambda train, by, spark, stats, models: asked.append(len(models)) or plain(train, by, spark, stats, models))
    split = splits.split_60_20_20(examples(example_rows(60) + example_rows(60, season=2025, seed=1, start=date(2024, 10, 1))))
    models = fit.fit_logistic(split, KEY, {"NBA": ("all", "strength")}, grid=(0.1, 1.0))
    assert models.count() == 8 and asked[0] == 2 and asked[1] == 8
