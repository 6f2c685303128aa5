"""Player statistics, participation and audit rules on the small fixtures."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import GAMES, as_dicts
from matchday.functions.domain import NBA_REPLACEMENTS, UNCERTAIN_KEYS
from matchday.operators import audit, completeness, player_stats

LINES = ("league string, season int, season_type int, game_id string, player_id string, team_id string, category string, "
         "did_not_play boolean, starter boolean, stats_json string")


def lines(spark, *rows):
    base = {"league": "NBA", "season": 2026, "season_type": 2, "game_id": "g1", "player_id": "p1", "team_id": "1",
            "category": "general", "did_not_play": False, "starter": False, "stats_json": '{"points":"0"}'}
    names = [c.split()[0] for c in LINES.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], LINES)


def zero_line():
    stats = {k: "0-0" if "-" in k else "0" for k in UNCERTAIN_KEYS}
    return {**stats, "minutes": "--"}


def test_additive_stats(spark):
    stats = {"points": "0", "plusMinus": "-14", "fieldGoalsMade-fieldGoalsAttempted": "3-8", "completions/passingAttempts": "17/32",
             "sacks-sackYardsLost": "1-8", "yardsPerPassAttempt": "5.2", "QBRating": "99.3", "longReception": "50",
             "assists": "--", "rebounds": "NaN", "steals": "5D", "blocks": " 5", "fouls": "Infinity",
             "freeThrowsMade-freeThrowsAttempted": "1-2-3"}
    df = lines(spark, {"stats_json": json.dumps(stats)}, {"player_id": "p2", "did_not_play": True, "stats_json": json.dumps(stats)})
    got = {r.metric: r.value for r in player_stats.additive_stats(df).collect()}
    assert got == {"points": 0, "plusMinus": -14, "fieldGoalsMade": 3, "fieldGoalsAttempted": 8, "completions": 17,
                   "passingAttempts": 32, "sacksTaken": 1, "sackYardsLost": 8}


def test_totals_keep_trades_apart_and_skip_incomplete_games(spark, games):
    df = lines(spark, {"stats_json": '{"points":"4"}'}, {"game_id": "g2", "stats_json": '{"points":"6"}'},
               {"game_id": "g3", "team_id": "2", "stats_json": '{"points":"10"}'}, {"game_id": "g4", "stats_json": '{"points":"99"}'})
    complete = spark.createDataFrame([("NBA", g) for g in ("g1", "g2", "g3")], "league string, game_id string")
    got = {(r.team_id, r.total, r.games_with_metric) for r in player_stats.player_season_totals(df, complete).collect()}
    assert got == {("1", 10.0, 2), ("2", 10.0, 1)}


@pytest.mark.parametrize("change, row", [
    ({}, {"starter": True}), ({}, {"starter": None}), ({"points": "1"}, {}), ({"rebounds": "--"}, {}), ({"points": "0-0"}, {}),
    ({"blocks": None}, {}), ({"newStat": "0"}, {}), ({}, {"league": "NFL"}), ({}, {"category": "passing"})])
def test_participation_variants_stay_reported(spark, change, row):
    stats = {k: v for k, v in {**zero_line(), **change}.items() if v is not None}
    (got,) = player_stats.participation(lines(spark, {"stats_json": json.dumps(stats), **row})).collect()
    assert got.participation_status == "reported"


def test_participation_uncertain_and_dnp(spark):
    df = lines(spark, {"stats_json": json.dumps(zero_line())}, {"player_id": "p2", "did_not_play": True})
    assert {r.player_id: r.participation_status for r in player_stats.participation(df).collect()} == {"p1": "uncertain", "p2": "did_not_play"}


def snapshot(spark, game_rows=None, line_rows=({},), dates=("2026-01-01", "2026-01-02"), complete=("g1",), pairs=(), scope=None):
    game_rows = [["NBA", 2026, 2, "g1", datetime(2026, 1, 1, 12), "1", "2", "final", 0, 0, None]] if game_rows is None else game_rows
    day = lambda s: datetime.fromisoformat(s).date()
    scope = scope or ("NBA", 2026, 2, day("2026-01-01"), day("2026-01-02"))
    return audit.AuditInput(
        scopes=spark.createDataFrame([scope], "league string, season int, season_type int, date_from date, date_to date"),
        games=spark.createDataFrame([tuple(r) for r in game_rows], GAMES), lines=lines(spark, *line_rows),
        headers=spark.createDataFrame([("NBA", day(d)) for d in dates], "league string, import_date date"),
        ids=spark.createDataFrame([("NBA", day("2026-01-01"), g[3]) for g in game_rows], "league string, import_date date, game_id string"),
        complete=spark.createDataFrame([("NBA", g) for g in complete], "league string, game_id string"),
        replacements=spark.createDataFrame(list(pairs), "league string, season int, postponed_id string, final_id string"))


def codes(a):
    return sorted((r.severity, r.code) for r in audit.audit_issues(a).collect())


G1 = ["NBA", 2026, 2, "g1", datetime(2026, 1, 1, 12), "1", "2", "final", 0, 0, None]


def changed(index, value):
    row = list(G1)
    row[index] = value
    return [row]


@pytest.mark.parametrize("change, code", [
    ({"game_rows": []}, "no_games"), ({"dates": ("2026-01-01",)}, "missing_import_dates"), ({"complete": ()}, "missing_player_import"),
    ({"game_rows": changed(8, None)}, "missing_score"), ({"game_rows": changed(7, "scheduled")}, "non_final_game"),
    ({"line_rows": ({"stats_json": "{"},)}, "invalid_player_stats"), ({"line_rows": ({"stats_json": '{"points":5}'},)}, "invalid_player_stats"),
    ({"line_rows": ({"stats_json": '{"points":"--"}'},)}, "missing_player_stat_value"),
    ({"line_rows": ({"stats_json": '{"points":null}'},)}, "missing_player_stat_value"),
    ({"scope": ("NBA", 2026, 2, None, None)}, "unchecked_dates")])
def test_each_fault_gives_its_code(spark, change, code):
    a = snapshot(spark, **change)
    assert ("issue", code) in codes(a)
    (report,) = audit.audit_report(a).collect()
    assert not report.ready_for_export


def test_clean_snapshot_is_ready(spark):
    a = snapshot(spark, line_rows=({}, {"player_id": "p2", "did_not_play": True, "stats_json": "{}"}))
    assert codes(a) == []
    (report,) = audit.audit_report(a).collect()
    assert report.ready_for_export and report.player_category_rows == 2


def test_uncertain_row_warns_and_hides_nothing_else(spark):
    a = snapshot(spark, line_rows=({"stats_json": json.dumps(zero_line())},))
    assert codes(a) == [("warning", "uncertain_participation")]


def pair_games(season, old_id, new_id, **edit):
    final = list(G1)
    final[1], final[3] = season, new_id
    postponed = list(final)
    postponed[3], postponed[4], postponed[7] = old_id, G1[4] - timedelta(days=1), "postponed"
    for index, value in edit.get("final", {}).items():
        final[index] = value
    for index, value in edit.get("old", {}).items():
        postponed[index] = value
    return [postponed] + ([] if edit.get("drop") else [final])


def test_listed_replacements_resolve(spark):
    for season, old, new in (NBA_REPLACEMENTS[0], NBA_REPLACEMENTS[-1]):
        day = datetime(2026, 1, 1).date()
        a = snapshot(spark, pair_games(season, old, new), (), complete=(new,), pairs=[("NBA", s, o, f) for s, o, f in NBA_REPLACEMENTS],
                     scope=("NBA", season, 2, day, day))
        assert [(r.code, r.detail) for r in audit.audit_issues(a).collect()] == [("resolved_postponement", f"{old} -> {new}")]


@pytest.mark.parametrize("edit, complete", [
    ({"drop": True}, True), ({"final": {5: "other"}}, True), ({"final": {7: "scheduled"}}, True), ({}, False), ({"final": {8: None}}, True),
    ({"final": {4: G1[4] - timedelta(days=2)}}, True), ({"old": {3: "unverified"}}, True), ({"old": {7: "scheduled"}}, True)])
def test_unverified_replacements_block(spark, edit, complete):
    season, old, new = NBA_REPLACEMENTS[0]
    day = datetime(2026, 1, 1).date()
    a = snapshot(spark, pair_games(season, old, new, **edit), (), complete=(new,) if complete else (),
                 pairs=[("NBA", s, o, f) for s, o, f in NBA_REPLACEMENTS], scope=("NBA", season, 2, day, day))
    assert any(severity == "issue" for severity, _ in codes(a))


def test_deleted_line_makes_a_game_incomplete(spark, games):
    stored = games([G1])
    imports = spark.createDataFrame([("NBA", "g1", 2026, 2, "1", "2", 2)],
                                    "league string, game_id string, season int, season_type int, home string, away string, line_count int")
    two = lines(spark, {}, {"player_id": "p2", "team_id": "2"})
    assert completeness.complete_games(stored, imports, two).count() == 1
    assert completeness.complete_games(stored, imports, two.where("player_id = 'p1'")).count() == 0
    assert completeness.complete_games(stored, imports.withColumn("home", F.lit("9")), two).count() == 0


def test_empty_manifest_is_never_complete(spark, games):
    a = snapshot(spark)
    flags = {str(r.import_date): r.complete for r in completeness.date_complete(a.headers, a.ids, a.games).collect()}
    assert flags == {"2026-01-01": True, "2026-01-02": False}


def test_scope_valid(spark):
    day = lambda s: datetime.fromisoformat(s).date()
    rows = [("MLB", 2026, 2, None, None), ("NBA", 1899, 2, None, None), ("NBA", 2026, 1, None, None), ("NBA", 2026, 2, day("2026-01-02"), day("2026-01-01")),
            ("NFL", 2026, 3, day("2025-01-01"), day("2026-01-02")), ("NFL", 2026, 3, day("2025-01-01"), day("2026-01-03"))]
    df = spark.createDataFrame(rows, "league string, season int, season_type int, date_from date, date_to date")
    assert [r.reason for r in audit.scope_valid(df).collect()] == ["league", "season", "season_type", "dates", None, "dates"]
