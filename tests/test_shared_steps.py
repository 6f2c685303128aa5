"""Steps that several queries share run once, and rows are dealt once."""
import re

import pytest

from matchday.functions.domain import KEY
from matchday.operators import player_stats, sinks
from matchday.plans import catalog
from matchday.plans.completeness_plans import complete, stored
from matchday.plans.registry import QUERIES
from matchday.sources import adapter

SF = "/root/testdata/sf0.001"


def shuffles(df):
    """The hash shuffles of a plan."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture
def t(spark):
    catalog.all_queries()
    return adapter.Tables(spark, SF)


def test_lines_are_dealt_by_game_once(t):
    assert not [s for s in shuffles(t["line_items"]) if "l_partkey" in s]


def test_complete_games_are_written_once(t):
    complete(t)
    assert "complete" in t.shared and complete(t) is t.shared["complete"]


def test_lines_are_dealt_by_player_before_their_metrics(t):
    totals = player_stats.player_season_totals(stored(t, "lines"), complete(t))
    assert not [s for s in shuffles(totals) if "metric" in s]


def test_plans_read_the_lines_as_written(t):
    for name in ("player_season_totals", "browse_players", "scope_read_players", "constraint_violations", "catalogue_violations"):
        plan = QUERIES[name](t)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_partkey" not in plan, name


def test_documents_are_parsed_once(t):
    QUERIES["player_import_progress"](t)
    assert "claimed" in t.shared


def test_export_reads_its_report_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    key = "league string, season int, season_type int"
    report = spark.createDataFrame([("NBA", 2026, 2, False)], f"{key}, ready_for_export boolean")
    games = spark.createDataFrame([("NBA", 2026, 2, "g1", None, "a", "b", "final", 1, 2, True, 1)],
                                  f"{key}, game_id string, starts_at timestamp_ntz, home string, away string, status string, "
                                  "home_score int, away_score int, players_complete boolean, week int")
    players = spark.createDataFrame([], f"{key}, game_id string, player_id string, name string, team_id string, category string, "
                                    "position string, jersey string, did_not_play boolean, starter boolean, stats_json string")
    issues = report.select(*KEY).selectExpr("*", "'no_games' AS code", "'x' AS detail")
    sinks.write_export(str(tmp_path), games, players, report.mapInArrow(counted, report.schema), issues, allow_incomplete=True)
    assert seen.value == 1


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_items_of_other_games_are_dropped_before_they_are_grouped(t):
    """Numbers are dealt and grouped, and only those of final games."""
    t.share("games")
    plan = plan_of(t["line_items"])
    assert plan.index("Aggregate") < plan.index("LeftSemi") and "cast(l_orderkey" not in plan
    assert adapter.Tables(t.spark, SF)["lines"].exceptAll(t["lines"]).isEmpty() and not t["lines"].isEmpty()


def test_one_export_rule_plans_its_own_work_only(t):
    """V8 needs neither the games nor the statistics."""
    from matchday.operators import export_rules
    from matchday.plans.export_rule_plans import exported

    tables = exported(t)
    plan = plan_of(export_rules.by_rule("V8", *tables))
    assert "Join" not in plan and "from_json" not in plan and "Expand" not in plan
    for rule in ("V4", "V7", "V8", "V9", "V10"):
        alone, among = export_rules.by_rule(rule, *tables), export_rules.export_violations(*tables).where(f"rule = '{rule}'")
        assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, among.collect())), rule


def test_repeated_keys_are_found_by_numbers_and_checked_by_text(spark):
    """the first grouping holds a number for each key; nulls equal each other and keep their place."""
    from matchday.operators import integrity, upsert

    rows = [("a", "b"), ("a", "b"), ("ab", ""), ("", "ab"), (None, "x"), (None, "x"), ("x", None), (None, None)]
    df = spark.createDataFrame(rows, "k string, v string")
    assert sorted(map(tuple, integrity.repeated_keys(df, ["k", "v"]).collect()), key=str) == [("a", "b", 2), (None, "x", 2)]
    schema = "league string, game_id string, player_id string, team_id string, category string, stats_json string"
    lines = spark.createDataFrame([("NBA", "g", "p", "t", "c", "{}")] * 2 + [("NBA", "g", "q", "t", "c", "{}")], schema)
    games = spark.createDataFrame([("NBA", "g", "final", 1, 2, 2020, 2, 1, "t", "u")], "league string, game_id string, status string, "
                                  "home_score int, away_score int, season int, season_type int, week int, home string, away string")
    imports, teams = games.selectExpr("league", "game_id", "1 AS line_count"), spark.createDataFrame([("NBA", "t"), ("NBA", "u")], "league string, team_id string")
    found = upsert.constraint_violations(games, lines, imports, teams)
    assert [tuple(r) for r in found.collect()] == [("line_unique", "g/p/c")]
    assert plan_of(found).count("key_hash") > 0
