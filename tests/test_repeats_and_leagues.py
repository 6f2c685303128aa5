"""Ids shared by two leagues, several observations of one game, and values beyond their type."""
from datetime import datetime

from conftest import as_dicts

from matchday.operators import browse, export_rules, forecast, player_stats, upsert

TEAMS = [("NBA", "1", "Celtics"), ("NBA", "2", "Bulls"), ("NFL", "1", "Falcons"), ("NFL", "2", "Bills"), ("NFL", "3", "Bears")]
AT = datetime(2026, 1, 9, 18)


def game(games, league="NBA", home="1", away="2"):
    return games([(league, 2026, 2, "g1", AT, home, away, "final", 100, 90, 1)])


def test_teams_of_the_other_league_stay_out(spark, games):
    teams = spark.createDataFrame(TEAMS, "league string, team_id string, name string")
    one = game(games)
    assert sorted(r["name"] for r in as_dicts(browse.browse_teams(one, teams))) == ["Bulls", "Celtics"]
    assert [(r["home_team"], r["away_team"]) for r in as_dicts(forecast.team_names(one, teams))] == [("Celtics", "Bulls")]
    foreign = as_dicts(forecast.team_names(game(games, away="3"), teams))
    assert [r["away_team"] for r in foreign] == ["Team 3"]


def test_newest_valid_observation_replaces_a_box_score(spark, games):
    kind = "league string, game_id string, team_id string, player_id string, observed_at timestamp_ntz"
    rows = [("NBA", "g1", t, p, datetime(2026, 1, 10, h)) for h in (1, 2) for t, p in (("1", "a"), ("2", "b"))]
    rows += [("NBA", "g1", "1", "a", datetime(2026, 1, 10, 3))]  # the other side is missing
    new = spark.createDataFrame(rows, kind)
    out = as_dicts(upsert.boxscore_replace(new.limit(0), new, game(games)))
    assert len(out) == 2 and {r["observed_at"].hour for r in out} == {2}


def test_a_game_read_twice_is_stored_once(spark, games):
    row = ("NBA", 2026, 2, "g1", AT, "1", "2", "final", 100, 90, 1)
    loads = spark.createDataFrame([("NBA", 2026, datetime(2026, 1, 9), True)],
                                  "league string, season int, last_load timestamp_ntz, ok boolean")
    out = forecast.history_refresh(games([row]), games([row, row]), loads, datetime(2026, 1, 10))
    assert out.count() == 1


def test_totals_of_huge_values_do_not_fail(spark, games):
    lines = spark.createDataFrame(
        [("NBA", 2026, 2, "g1", "p", "1", "general", False, '{"points":"1e20"}'), ("NBA", 2026, 2, "g1", "q", "1", "general", False, '{"points":"0.123456"}')],
        "league string, season int, season_type int, game_id string, player_id string, team_id string, category string, did_not_play boolean, stats_json string")
    out = {r["player_id"]: r["total"] for r in as_dicts(player_stats.player_season_totals(lines, game(games)))}
    assert out["p"] == 1e20 and abs(out["q"] - 0.123456) < 1e-12


def test_scores_are_compared_as_numbers_and_dates_must_exist(spark):
    kind = ("report_league string, report_season int, report_season_type int, league string, season string, season_type string, game_id string, "
            "starts_at_utc string, home_team_id string, away_team_id string, home_score string, away_score string, week string, player_import_complete string")
    row = ["NBA", 2026, 2, "NBA", "2026", "2", "g1", "2026-01-09T18:00:00Z", "1", "2", "090", "90", "1", "true"]
    late = [*row[:6], "g2", "2025-13-45T99:00:00Z", "1", "2", "91", "90", "1", "true"]
    fine = [*row[:6], "g3", "2026-01-09T18:00+02:00", "1", "2", "91", "90", "1", "true"]
    rows = spark.createDataFrame([row, late, fine], kind)
    found = {(r["rule"], r["detail"]) for r in as_dicts(export_rules.game_rules(rows, rows))}
    assert found == {("V5", "g1"), ("V3", "g2")}
