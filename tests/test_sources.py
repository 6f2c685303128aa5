"""Decoders: good documents decode, each corruption rejects the whole response."""

import copy
import json
from datetime import date, datetime

import pytest

from conftest import GAMES
from matchday.sources import boxscore, scoreboard, team_list

RAW = "response_id string, league string, import_date date, observed_at timestamp_ntz, body string"


def event(i, name="STATUS_FINAL", state="post", completed=True, scores=("20", "0"), when="2025-09-07T17:00Z", **more):
    sides = [{"homeAway": h, "team": {"id": t}, "score": s} for h, t, s in zip(("home", "away"), ("1", "2"), scores)]
    return {"id": f"e{i}", "season": {"year": 2025, "type": 2}, "week": {"number": 1}, "competitions": [
        {"type": {"abbreviation": "STD"}, "date": when, "status": {"type": {"name": name, "state": state, "completed": completed}},
         "competitors": sides}], **more}


def document(*events, league="NFL"):
    return {"leagues": [{"abbreviation": league}], "events": list(events)}


def raw(spark, *bodies, league="NFL"):
    rows = [(f"r{i}", league, date(2025, 9, 7), datetime(2025, 9, 8), b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, RAW)


def test_statuses_scores_and_times(spark):
    doc = document(
        event(0, "STATUS_SCHEDULED", "pre", False, ("0", "0")), event(1, scores=("0", "3"), when="2025-09-07T19:00:00+02:00"),
        event(2, "STATUS_POSTPONED", "pre", False), event(3, "STATUS_CANCELED", "pre", False), event(4, "STATUS_IN", "in", False, ("7", None)),
        event(5, "STATUS_SUSPENDED", "in", False), event(6, "STATUS_DELAYED", "in", False), league="NBA")
    rows = {r.game_id: r for r in scoreboard.scoreboard_decode(raw(spark, doc, league="NBA")).collect()}
    assert [rows[f"e{i}"].status for i in range(7)] == ["scheduled", "final", "postponed", "canceled", "in_progress", "suspended", "delayed"]
    assert rows["e0"].home_score is None and rows["e2"].home_score is None
    assert rows["e1"].home_score == 0 and rows["e1"].away_score == 3
    assert rows["e4"].home_score == 7 and rows["e4"].away_score is None
    assert rows["e0"].starts_at == rows["e1"].starts_at == datetime(2025, 9, 7, 17)
    assert all(r.week is None for r in rows.values())  # weeks belong to the NFL


def corrupt(change):
    doc = document(event(0), event(1))
    change(doc, doc["events"][0]["competitions"][0])
    return doc


CORRUPTIONS = {
    "league_not_identified": lambda d, c: d["leagues"].clear(),
    "events_missing": lambda d, c: d.update(events=None),
    "duplicate_event": lambda d, c: d["events"][1].update(id="e0"),
    "invalid_event": lambda d, c: d["events"][0].update(competitions=[]),
    "bad_start": lambda d, c: c.update(date="2025-09-07"),
    "unsupported_status": lambda d, c: c["status"]["type"].update(name="STATUS_X", state="pre", completed=False),
    "bad_week": lambda d, c: d["events"][0].update(week={"number": 0}),
    "competitor_count": lambda d, c: c["competitors"].pop(),
    "missing_team": lambda d, c: c["competitors"][0]["team"].update(id=""),
    "bad_score": lambda d, c: c["competitors"][0].update(score="-1"),
    "final_score_missing": lambda d, c: c["competitors"][0].update(score=None),
    "home_away": lambda d, c: c["competitors"][1].update(homeAway="home"),
    "same_team": lambda d, c: c["competitors"][1]["team"].update(id="1"),
    "too_many_events": lambda d, c: d.update(events=[{**d["events"][0], "id": str(i)} for i in range(1000)]),
}


def test_each_corruption_rejects_the_response(spark):
    names = [*CORRUPTIONS, "bad_json"]
    docs = raw(spark, *[corrupt(CORRUPTIONS[n]) for n in CORRUPTIONS], '{"leagues": [', document(), document(event(0)))
    got = {r.response_id: r.reason for r in scoreboard.scoreboard_rejects(docs).collect()}
    assert got == {f"r{i}": n for i, n in enumerate(names)}
    # an empty day is fine and a good response is kept
    assert {r.response_id for r in scoreboard.scoreboard_decode(docs).collect()} == {f"r{len(names) + 1}"}
    manifest = {r.response_id: r.ids for r in scoreboard.manifest_responses(docs).collect()}
    assert manifest == {f"r{len(names)}": [], f"r{len(names) + 1}": ["e0"]}


def test_exhibitions_skip_validation(spark):
    star = {"id": "star", "season": {"year": 2026, "type": 1}, "competitions": [{"type": {"abbreviation": "ALLSTAR"}, "competitors": [{"team": {"id": "9"}}]}]}
    pre = {"id": "pre", "season": {"year": 2026, "type": 1}, "competitions": [{"competitors": []}]}
    docs = raw(spark, document(star, pre, event(0)))
    assert [r.game_id for r in scoreboard.scoreboard_decode(docs).collect()] == ["e0"]
    assert {r.game_id: r.reason for r in scoreboard.exhibition_skips(docs).collect()} == {"star": "All-Star exhibition", "pre": "preseason"}


def athlete(i, stats=("30", "5", "4-8"), **more):
    return {"athlete": {"id": i, "displayName": f"P{i}", "jersey": "7", "position": {"abbreviation": "G"}}, "starter": True,
            "didNotPlay": False, "reason": "", "stats": list(stats), **more}


KEYS = ["minutes", "points", "fieldGoalsMade-fieldGoalsAttempted"]


def box(*teams, **header):
    players = [{"team": {"id": t}, "statistics": [{"name": "", "keys": list(KEYS), "athletes": a}]} for t, a in teams]
    return {"header": {"id": "g1", "league": {"abbreviation": "NBA"}, "season": {"year": 2026, "type": 2},
                       "competitions": [{"status": {"type": {"completed": True, "state": "post"}}}], **header}, "boxscore": {"players": players}}


def good_box():
    bench = athlete("", ("--", "0", "0-0"), starter=False, reason="COACH'S DECISION")
    return box(("1", [athlete("10"), athlete("11", (), didNotPlay=True), bench]), ("2", [athlete("20"), athlete("", (), didNotPlay=True)]))


def boxes(spark, *bodies):
    rows = [(f"r{i}", "NBA", "g1", datetime(2026, 1, 2), b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "response_id string, league string, game_id string, observed_at timestamp_ntz, body string")


@pytest.fixture
def stored(spark):
    return spark.createDataFrame([("NBA", 2026, 2, "g1", datetime(2026, 1, 1), "1", "2", "final", 1, 0, None)], GAMES)


def test_boxscore_lines_and_placeholders(spark, stored):
    docs = boxes(spark, good_box())
    rows = {r.player_id: r for r in boxscore.boxscore_decode(docs, stored).collect()}
    assert set(rows) == {"10", "11", "20"} and rows["10"].category == "general"
    assert json.loads(rows["10"].stats_json) == {"minutes": "30", "points": "5", "fieldGoalsMade-fieldGoalsAttempted": "4-8"}
    assert rows["11"].did_not_play and rows["11"].stats_json == "{}"
    assert boxscore.placeholder_dnp(docs, stored).first().excluded == 2


def broken_box(change):
    doc = copy.deepcopy(good_box())
    change(doc, doc["boxscore"]["players"])
    return doc


BOX = {
    "identity_mismatch": lambda d, p: d["header"].update(id="other"),
    "not_final": lambda d, p: d["header"].update(competitions=[]),
    "team_count": lambda d, p: p.pop(),
    "unexpected_team": lambda d, p: p[1]["team"].update(id="3"),
    "category": lambda d, p: p[0]["statistics"].append(copy.deepcopy({**p[0]["statistics"][0], "athletes": []})),
    "statistic_key": lambda d, p: p[0]["statistics"][0].update(keys=["minutes", " ", "x"]),
    "missing_identity": lambda d, p: p[0]["statistics"][0]["athletes"][2].update(starter=True),
    "duplicate_player": lambda d, p: p[0]["statistics"][0]["athletes"].append(athlete("10")),
    "player_both_teams": lambda d, p: p[1]["statistics"].append({"name": "extra", "keys": KEYS, "athletes": [athlete("10")]}),
    "alignment": lambda d, p: p[0]["statistics"][0]["athletes"][0].update(stats=["1"]),
    "no_played_rows": lambda d, p: p[1]["statistics"][0].update(athletes=[]),
}


def test_each_box_corruption_rejects(spark, stored):
    docs = boxes(spark, *[broken_box(c) for c in BOX.values()], "{")
    got = {}
    for r in boxscore.boxscore_rejects(docs, stored).collect():
        got.setdefault(r.response_id, set()).add(r.reason)
    for i, name in enumerate([*BOX, "bad_json"]):
        assert name in got[f"r{i}"], name
    assert boxscore.boxscore_decode(docs, stored).count() == 0


def test_nfl_needs_its_categories(spark, stored):
    doc = good_box()
    doc["header"]["league"]["abbreviation"] = "NFL"
    for team in doc["boxscore"]["players"]:
        team["statistics"][0].update(name="passing", athletes=[athlete(f"q{team['team']['id']}")])
    from pyspark.sql import functions as F
    docs = boxes(spark, doc).withColumn("league", F.lit("NFL"))
    got = [r.reason for r in boxscore.boxscore_rejects(docs, stored.withColumn("league", F.lit("NFL"))).collect()]
    assert got == ["missing_category"]


def test_team_lists(spark):
    def doc(*teams):
        return json.dumps({"sports": [{"leagues": [{"abbreviation": "NBA", "teams": [{"team": t} for t in teams]}, {"abbreviation": "NFL", "teams": []}]}]})
    one, two = {"id": "1", "displayName": "A", "abbreviation": "A"}, {"id": "2", "displayName": "B", "abbreviation": "B"}
    rows = [("ok", "NBA", doc(one, two)), ("none", "NFL", doc(one)), ("blank", "NBA", doc({**one, "displayName": " "})), ("twice", "NBA", doc(one, one)), ("json", "NBA", "[")]
    df = spark.createDataFrame(rows, "response_id string, league string, body string")
    assert {r.response_id: r.reason for r in team_list.teams_rejects(df).collect()} == {
        "none": "no_teams", "blank": "missing_field", "twice": "duplicate_team", "json": "bad_json"}
    assert {r.team_id for r in team_list.teams_decode(df).collect()} == {"1", "2"}


def test_range_keeps_the_last_occurrence(spark):
    rows = [("NBA", "a", date(2026, 1, 1), 1, "scheduled"), ("NBA", "a", date(2026, 1, 2), 2, "final"), ("NBA", "b", date(2026, 2, 5), 3, "final")]
    df = spark.createDataFrame(rows, "league string, game_id string, import_date date, seq int, status string")
    (got,) = scoreboard.games_in_range(df, date(2026, 1, 1), date(2026, 1, 31)).collect()
    assert got.status == "final" and got.position.seq == 1
    for first, last in ((date(2026, 1, 2), date(2026, 1, 1)), (date(2026, 1, 1), date(2026, 2, 1))):
        with pytest.raises(ValueError):
            scoreboard.games_in_range(df, first, last)
