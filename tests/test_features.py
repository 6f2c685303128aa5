"""Leakage-free features: exact first row, counts, and metamorphic checks."""

from datetime import datetime, timedelta

from conftest import as_dicts, season_rows
from matchday.functions.domain import FEATURES
from matchday.operators import features as op


def thirty_twenty():
    rows = season_rows()
    for r in rows:
        r[8], r[9] = 30, 20
    return rows


def vectors(df):
    return {r["game_id"]: [r[f] for f in FEATURES] for r in df.collect()}


def test_first_eligible_row(games):
    out = sorted(op.examples(games(thirty_twenty())).collect(), key=lambda r: r["date"])
    assert len(out) == 35
    assert [out[0][f] for f in FEATURES] == [1, 10, -10, 20, 1, 20, 0]


def test_counts_and_ties(games):
    rows = thirty_twenty()
    rows[8][8] = rows[8][9] = 24
    (counts,) = as_dicts(op.example_counts(games(rows)))
    assert (counts["input_games"], counts["excluded_ties"], counts["excluded_warmup"], counts["eligible_games"]) == (40, 1, 5, 34)


def test_future_results_do_not_change_earlier_rows(games):
    base = vectors(op.examples(games(season_rows())))
    changed = season_rows()
    for r in changed[15:]:
        r[8] = 999
    after = vectors(op.examples(games(changed)))
    for i in range(5, 16):
        assert after[f"g{i:02d}"] == base[f"g{i:02d}"]


def test_same_day_game_neither_sees_nor_feeds_the_day(games):
    rows = season_rows()
    extra = list(rows[12])
    extra[3], extra[4], extra[8] = "extra", extra[4] + timedelta(hours=1), 800
    mixed = vectors(op.examples(games([extra, *reversed(rows)])))
    assert mixed["extra"] == mixed["g12"] == vectors(op.examples(games(rows)))["g12"]


def test_last_five_spans_games_of_one_date(games):
    rows = season_rows(8)
    rows += [["NBA", 2026, 2, f"x{i}", datetime(2025, 9, 8, 19 + i), "a", "b", "final", 50 + i, 24, 2] for i in range(3)]
    rows.append(["NBA", 2026, 2, "target", datetime(2025, 9, 9, 18), "a", "b", "final", 30, 20, 2])
    (row,) = [r for r in op.team_last5(games(rows)).collect() if r["team"] == "a" and r["date"].isoformat() == "2025-09-09"]
    margins = [25 - 24, 20 + (7 % 3) * 5 - 24, 26, 27, 28]  # the day of game 7 has four games
    assert row["n"] == 11 and row["last5_margin"] == sum([20 + (6 % 3) * 5 - 24, *margins[1:]]) / 5


def test_seasons_do_not_share_history(games):
    first, second = season_rows(6), season_rows(6)
    for r in second:
        r[1], r[3], r[4] = 2027, "n" + r[3], r[4] + timedelta(days=365)
    assert {r["game_id"] for r in op.examples(games(first + second)).collect()} == {"g05", "ng05"}


def history():
    return [["NBA", 2026, 2, str(i), datetime(2026, 1, 1 + i, 12), "h", "a", "final", 100 + i, 95, None] for i in range(6)]


TARGET = ["NBA", 2026, 2, "today", datetime(2026, 1, 9, 20), "h", "a", "scheduled", None, None, None]


def test_asof_features(games):
    (row,) = op.asof_features(games([TARGET]), games(history())).collect()
    assert (row.n_home, row.n_away) == (6, 6)
    assert (row.win_rate_diff, row.margin_diff, row.last5_margin_diff, row.rest_days_diff) == (1, 15, 16, 0)


def test_asof_ignores_same_day_future_and_other_seasons(games, spark):
    same, future, old = (list(history()[0]) for _ in range(3))
    same[3], same[4] = "same", datetime(2026, 1, 9, 10)
    future[3], future[4] = "future", datetime(2026, 1, 10, 20)
    old[3], old[1] = "old", 2025
    past = games([*history(), same, future, old])
    (row,) = op.asof_features(games([TARGET]), past).collect()
    assert row.margin_diff == 15 and row.n_home == 6


def test_asof_uses_the_newest_observation(games, spark):
    from pyspark.sql import functions as F
    stamp = lambda rows, at: games(rows).withColumn("observed_at", F.to_timestamp_ntz(F.lit(at)))
    wrong = history()
    for r in wrong:
        r[8] = 0
    both = stamp(wrong, "2026-01-07 00:00:00").unionByName(stamp(history(), "2026-01-08 00:00:00"))
    (row,) = op.asof_features(games([TARGET]), both).collect()
    assert row.margin_diff == 15


def test_asof_needs_five_games(games):
    (row,) = op.asof_features(games([TARGET]), games(history()[:4])).collect()
    assert row.n_home == 4 and row.win_rate_diff is None


def test_asof_last_five_over_sparse_dates(games):
    far = list(TARGET)
    far[3], far[4] = "later", datetime(2026, 2, 9, 20)
    rows = {r.game_id: r for r in op.asof_features(games([TARGET, far]), games(history())).collect()}
    assert rows["later"].last5_margin_diff == 16 and rows["later"].n_home == 6
