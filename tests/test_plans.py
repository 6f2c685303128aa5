"""Plan shape at scale, and agreement with SQL on the driver tables."""

import os

import pytest

import __spark_entry__ as entry
from matchday.operators import features, metrics
from matchday.operators.forecast import local_day_games
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
SHAPES = ["examples", "team_last5", "asof_features", "player_season_totals", "complete_games", "missing_game_rows", "constraint_violations",
          "boxscore_replace", "browse_teams", "browse_games", "scoreboard_decode", "boxscore_rejects", "export_rule_V11", "walk_forward",
          "weekly_windows", "history_refresh", "prediction_ledger", "range_dedup"]
AGREE = ["examples", "example_counts", "asof_features", "player_season_totals", "participation", "audit_report", "newest_wins",
         "import_manifest", "constraint_violations", "export_violations", "browse_players", "weekly_windows_violations",
         "walk_forward", "score", "metrics", "confident_errors", "scoreboard_decode", "boxscore_decode", "report_violations",
         "today_predictions", "stream_newest_wins", "stream_prediction_ledger", "export_players", "export_overwrite"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", SHAPES)
def test_no_pairwise_joins_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert bad not in text, bad
    for line in text.splitlines():
        # A window without partitioning would move every row to one task.
        assert not (" Window [" in line and "windowspecdefinition(ROWS" in line), line


def test_top_rows_are_limited_before_the_shuffle(spark, games):
    from conftest import season_rows
    text = plan(features.daily_recent(features.team_games(games(season_rows()))))
    partial = text.index("WindowGroupLimit", text.index("WindowGroupLimit") + 1)
    assert "Partial" in text[partial:] and text.index("Exchange") < partial
    df = games(season_rows()).selectExpr("league as v", "game_id", "to_date(starts_at) as date", "1 as target", "0.1D as p")
    assert "WindowGroupLimit" in plan(metrics.confident_errors(df, ["v"]))


def test_day_bounds_reach_the_scan(spark, games, tmp_path):
    from datetime import datetime
    from conftest import season_rows
    games(season_rows()).write.partitionBy("league", "season", "season_type").parquet(str(tmp_path / "games"))
    stored = spark.read.parquet(str(tmp_path / "games"))
    text = plan(local_day_games(stored.where("league = 'NBA' and season = 2026"), "UTC", datetime(2025, 9, 5)))
    assert "GreaterThanOrEqual(starts_at" in text and "PartitionFilters: [isnotnull(league" in text


def test_holdout_partitions_are_pruned(spark, games, tmp_path):
    from conftest import season_rows
    from matchday.operators.splits import season_inventory
    games(season_rows()).write.partitionBy("league", "season", "season_type").parquet(str(tmp_path / "games"))
    text = plan(season_inventory(spark.read.parquet(str(tmp_path / "games")), {"NBA": 2026}))
    assert "season" in text.split("PartitionFilters: [")[1].split("]")[0]


@needs_data
@pytest.mark.parametrize("name", AGREE)
def test_agrees_with_sql(spark, name):
    n, verdict = compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert verdict == "ok", verdict


@needs_data
def test_entry_runs(spark):
    assert entry.entry(spark).count() == 84


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
