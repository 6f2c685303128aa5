"""Merges, forecast, publication, sinks and streams."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import GAMES, season_rows
from matchday.functions.domain import FEATURES
from matchday.operators import browse, commits, export_rules, forecast, keyed_store, publish, sinks, upsert
from matchday.sources import exports
from matchday.streaming import jobs

SNAP = "league string, game_id string, observed_at timestamp_ntz, status string"
T = datetime(2026, 1, 1)


def snaps(spark, *rows):
    return spark.createDataFrame([("NBA", g, T + timedelta(hours=h), s) for g, h, s in rows], SNAP)


def test_newest_wins(spark):
    out = upsert.newest_wins(snaps(spark, ("a", 2, "old"), ("b", 2, "old"), ("c", 2, "old"), ("keep", 0, "old")),
                             snaps(spark, ("a", 1, "stale"), ("b", 2, "equal"), ("c", 3, "new"), ("d", 0, "first")), ["league", "game_id"])
    assert {r.game_id: r.status for r in out.collect()} == {"a": "old", "b": "equal", "c": "new", "keep": "old", "d": "first"}


def test_boxscore_replace(spark, games):
    stored_games = games([["NBA", 2026, 2, g, T, "1", "2", "final", 1, 0, None] for g in "abcd"])
    schema = "league string, game_id string, team_id string, player_id string, observed_at timestamp_ntz"
    def rows(*items):
        return spark.createDataFrame([("NBA", g, t, p, T + timedelta(hours=h)) for g, t, p, h in items], schema)
    stored = rows(*[(g, t, f"old{t}", 2) for g in "abc" for t in "12"])
    new = rows(("a", "1", "n1", 3), ("a", "2", "n2", 3), ("b", "1", "n1", 1), ("b", "2", "n2", 1), ("c", "1", "n1", 3), ("c", "3", "n3", 3), ("d", "1", "n1", 3))
    got = {}
    for r in upsert.boxscore_replace(stored, new, stored_games).collect():
        got.setdefault(r.game_id, set()).add(r.player_id)
    assert got == {"a": {"n1", "n2"}, "b": {"old1", "old2"}, "c": {"old1", "old2"}}


def test_page_bounds(spark):
    df = spark.range(30)
    total, rows = browse.page(df, ["id"], 10, 25)
    assert total.first().total == 30 and [r.id for r in rows.collect()] == [25, 26, 27, 28, 29]
    total, rows = browse.page(df, ["id"], 10, 1000)
    assert total.first().total == 30 and rows.count() == 0
    for limit, offset in ((0, 0), (101, 0), (10, -1), (10, 1_000_001)):
        with pytest.raises(ValueError):
            browse.page(df, ["id"], limit, offset)


def test_filters_are_values_not_sql(spark, games):
    df = games(season_rows(3))
    assert browse.scoped(df, "NBA' OR '1'='1", 2026).count() == 0
    assert browse.scoped(df, "NBA", 2026).count() == 3


def forecast_inputs(spark, games, now, status="scheduled", trained="2025-06-01", history=6, ledger=(), loaded=1, season_type=2):
    rows = [["NBA", 2026, 2, str(i), datetime(2026, 1, 1 + i, 12), "h", "a", "final", 100 + i, 95, None] for i in range(history)]
    rows.append(["NBA", 2026, season_type, "today", datetime(2026, 1, 10, 4), "h", "zz", status, None, None, None])
    for r in rows[:-1]:
        r[6] = "zz"
    models = spark.createDataFrame(
        [("NBA", "m", trained, ["win_rate_diff"], [0.0], [1.0], [1.0], 0.0)],
        "league string, model_id string, trained_through string, features array<string>, mean array<double>, scale array<double>, coefficients array<double>, intercept double")
    book = spark.createDataFrame(list(ledger), "model_id string, league string, game_id string, starts_at timestamp_ntz, home_probability double, "
                                 "away_probability double, generated_at timestamp_ntz, home_history_games bigint, away_history_games bigint")
    loads = spark.createDataFrame([("NBA", 2026, now - timedelta(minutes=loaded), True)] if loaded else [],
                                  "league string, season int, loaded_at timestamp_ntz, ok boolean")
    teams = spark.createDataFrame([("NBA", "h", "Home")], "league string, team_id string, name string")
    return games(rows), teams, models, book, loads


def today(spark, games, now=datetime(2026, 1, 10, 2), zone="America/Los_Angeles", models=None, **more):
    g, teams, m, book, loads = forecast_inputs(spark, games, now, **more)
    return forecast.today_predictions(g, teams, m if models is None else m.limit(0), book, loads, zone, now)


def test_zone_names_and_fresh_prediction(spark, games):
    (row,) = today(spark, games).collect()  # 04:00Z is the evening of January 9 in Los Angeles
    assert row.home_team == "Home" and row.away_team == "Team zz" and row.unavailable is None
    p = row.prediction
    assert abs(p.home_probability - 1 / (1 + 2.718281828459045 ** -1)) < 1e-12 and abs(p.home_probability + p.away_probability - 1) < 1e-15
    assert p.home_history_games == 6 and p.generated_at == datetime(2026, 1, 10, 2)
    assert today(spark, games, zone="UTC").count() == 1
    assert today(spark, games, now=datetime(2026, 1, 11, 2)).count() == 0
    (entry,) = forecast.ledger_updates(today(spark, games), datetime(2026, 1, 10, 2)).collect()
    assert entry.model_id == "m" and entry.starts_at == datetime(2026, 1, 10, 4)


@pytest.mark.parametrize("more, reason", [
    ({"models": "none"}, "no_model"), ({"season_type": 3}, "not_regular_season"), ({"status": "final"}, "no_pregame_prediction"),
    ({"trained": "2026-01-10"}, "training_overlap"), ({"loaded": 16}, "history_not_ready"), ({"loaded": 0}, "history_not_ready"),
    ({"history": 4}, "too_few_games")])
def test_availability(spark, games, more, reason):
    (row,) = today(spark, games, **more).collect()
    assert row.unavailable == reason and row.prediction is None


def test_frozen_prediction_needs_the_same_start(spark, games):
    start, made = datetime(2026, 1, 10, 4), datetime(2026, 1, 10, 2)
    entry = lambda at: [("m", "NBA", "today", at, 0.7, 0.3, made, 6, 6)]
    after = datetime(2026, 1, 10, 5)
    (row,) = today(spark, games, now=after, status="final", ledger=entry(start)).collect()
    assert row.prediction.home_probability == 0.7 and row.unavailable is None
    for more in ({"status": "final", "ledger": entry(start + timedelta(hours=1))}, {"status": "postponed", "ledger": entry(start)}):
        (row,) = today(spark, games, now=after, **more).collect()
        assert row.unavailable == "no_pregame_prediction"


def test_report_batch_is_all_or_nothing(spark):
    stored = spark.createDataFrame([("a", "old"), ("b", "old")], "report_id string, title string")
    batch = spark.createDataFrame([("b", "new"), ("c", "new")], "report_id string, title string")
    none = spark.createDataFrame([], "report_id string, rule string")
    out = {r.report_id: r.title for r in publish.report_upsert(stored, batch, none).collect()}
    assert out == {"a": "old", "b": "new", "c": "new"}
    with pytest.raises(ValueError):
        publish.report_upsert(stored, batch, spark.createDataFrame([("c", "id")], "report_id string, rule string"))


@pytest.fixture
def flagged(games):
    def build(rows):
        return games(rows).withColumn("players_complete", F.lit(True))
    return build


def test_export_round_trip_and_overwrite(spark, flagged, tmp_path):
    path, order = str(tmp_path / "x"), ["starts_at_utc", "game_id"]
    nba, nfl = season_rows(4), season_rows(4)
    for r in nfl:
        r[0] = "NFL"
    nba[0][8] = None
    nba[1][4] = datetime(2025, 9, 2, 18, 0, 0, 250000)
    sinks.write_keyed(sinks.export_games(flagged(nba + nfl)), f"{path}/games", order)
    with pytest.raises(ValueError):
        sinks.write_keyed(sinks.export_games(flagged(nba)), f"{path}/games", order)
    sinks.write_keyed(sinks.export_games(flagged(nba[:2])), f"{path}/games", order, overwrite=True)
    rows = exports.read_games(spark, path).collect()
    assert sum(r.league == "NFL" for r in rows) == 4
    mine = {r.game_id: r for r in rows if r.league == "NBA"}
    assert set(mine) == {"g00", "g01"} and mine["g00"].home_score is None
    assert mine["g00"].starts_at_utc == "2025-09-01T18:00:00Z" and mine["g01"].starts_at_utc == "2025-09-02T18:00:00.25Z"


HEADER = ",".join(exports.GAME_COLUMNS)


def game_file(tmp_path, name, text, season=2026):
    folder = tmp_path / name / "games" / "league=NBA" / f"season={season}" / "season_type=2"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"part-{len(list(folder.iterdir()))}.csv").write_text(text)
    return str(tmp_path / name)


FAULTY = {"ragged": f"{HEADER}\n1,2,3,4,5,6,true,7,extra\n", "short": f"{HEADER}\n1,2,3,4,5,6,true\n",
          "renamed": HEADER.replace("home_score", "hs") + "\n1,2,3,4,5,6,true,7\n", "repeated": f"{HEADER},week\n1,2,3,4,5,6,true,7,8\n",
          "extra and ragged": f"{HEADER},venue\n1,2,3,4,5,6,true,7\n", "empty": ""}


@pytest.mark.parametrize("name", FAULTY)
def test_faulty_files_fail(spark, tmp_path, name):
    with pytest.raises(Exception):
        exports.read_games(spark, game_file(tmp_path, name, FAULTY[name])).collect()


def test_files_are_read_by_their_own_header(spark, tmp_path):
    path = game_file(tmp_path, "x", f"{HEADER}\n1,2,3,4,5,6,true,7\n")
    game_file(tmp_path, "x", "venue,away_score," + HEADER.replace("away_score,", "").replace(",week", "") + "\nv,6,2,2,3,4,5,true\n", 2025)
    rows = {r.game_id: r for r in exports.read_games(spark, path, with_presence=True).collect()}
    assert (rows["1"].week, rows["1"].week_present, rows["1"].season) == ("7", True, 2026)
    assert (rows["2"].week, rows["2"].week_present, rows["2"].away_score, rows["2"].season) == (None, False, "6", 2025)
    game_file(tmp_path, "x", HEADER.replace("home_team_id,away_team_id", "away_team_id,home_team_id") + "\n3,2,3,4,5,6,true,7\n")
    with pytest.raises(Exception):  # two files of one key must agree
        exports.read_games(spark, path).collect()


def unit(spark, flagged, rows, ready=True):
    games = flagged(rows)
    key = sorted({(r[0], r[1], r[2]) for r in rows})
    players = spark.createDataFrame([(*k, "g00", "p", "P", "a", "general", "G", "7", False, True, "{}", None, None) for k in key],
                                    "league string, season int, season_type int, game_id string, player_id string, name string, team_id string, category string, "
                                    "position string, jersey string, did_not_play boolean, starter boolean, stats_json string, additive_stats map<string,double>, x string")
    report = spark.createDataFrame([(*k, ready, len(rows), 0) for k in key], "league string, season int, season_type int, ready_for_export boolean, stored_games long, issues long")
    issues = spark.createDataFrame([(*key[0], "c", "warning", "g", "d")], "league string, season int, season_type int, code string, severity string, game_id string, detail string")
    return games, players, report, issues


def test_an_export_switches_as_one_unit(spark, flagged, tmp_path, monkeypatch):
    path = str(tmp_path / "x")
    both = [list(r) for r in season_rows(4)] + [[*r[:1], 2027, *r[2:]] for r in season_rows(3)]
    sinks.write_export(path, *unit(spark, flagged, both))
    read = lambda: [len(f(spark, path).collect()) for f in (exports.read_games, exports.read_players, exports.read_reports, exports.read_issues)]
    assert read() == [7, 2, 2, 1]
    less = [list(r) for r in season_rows(2)]
    with pytest.raises(ValueError):
        sinks.write_export(path, *unit(spark, flagged, less))
    written = []

    def failing(df, to, *rest, **more):
        written.append(to)
        if to.endswith("report"):
            raise OSError("disk")
        return whole(df, to, *rest, **more)
    whole = sinks.write_keyed
    with monkeypatch.context() as m:
        m.setattr(sinks, "write_keyed", failing)
        with pytest.raises(OSError):
            sinks.write_export(path, *unit(spark, flagged, less), overwrite=True)
    assert len(written) == 3 and read() == [7, 2, 2, 1]  # the old export is whole
    sinks.write_export(path, *unit(spark, flagged, less), overwrite=True)
    assert read() == [5, 2, 2, 1]
    assert {r.season: r.stored_games for r in exports.read_reports(spark, path).collect()} == {2026: 2, 2027: 7}


def test_unready_export_is_refused(spark):
    report = spark.createDataFrame([("NBA", False)], "league string, ready_for_export boolean")
    with pytest.raises(ValueError):
        sinks.require_ready(report, allow_incomplete=False)
    sinks.require_ready(report, allow_incomplete=True)


def test_run_is_never_replaced(spark, tmp_path):
    frame = spark.createDataFrame([("NBA", 2026, 2, "train", "g", date(2026, 1, 1), 1, *([0.0] * 7))],
                                  "league string, season int, season_type int, split string, game_id string, date date, target int, "
                                  + ", ".join(f"{f} double" for f in FEATURES))
    sinks.write_run(str(tmp_path / "run"), frame, frame)
    with pytest.raises(Exception):
        sinks.write_run(str(tmp_path / "run"), frame, frame)


def test_fingerprint_ignores_order_but_not_content(games):
    rows = season_rows(10)
    one = sinks.dataset_fingerprint(games(rows), ["league"]).first()
    assert one == sinks.dataset_fingerprint(games(rows[::-1]).repartition(3), ["league"]).first()
    rows[0][8] += 1
    assert one.fingerprint != sinks.dataset_fingerprint(games(rows), ["league"]).first().fingerprint


def test_clean_export_has_no_violations_and_each_fault_is_found(spark):
    def frames(game=None, player=None, report=None):
        g = {"game_id": "g1", "league": "NBA", "season": "2026", "season_type": "2", "starts_at_utc": "2026-01-01T00:00:00Z", "home_team_id": "1",
             "away_team_id": "2", "home_score": "1", "away_score": "0", "player_import_complete": "true", "week": None, **(game or {})}
        base = {"game_id": "g1", "player_id": "p1", "player_name": "A", "team_id": "1", "category": "general", "did_not_play": "false", "starter": None,
                "stats_json": '{"points":"1"}', "participation_status": "reported"}
        ps = [{**base, **(player or {})}, {**base, "player_id": "p2", "team_id": "2"}]
        r = {"league": "NBA", "season": 2026, "season_type": 2, "schema_version": 4, "ready_for_export": True, "issues": 0, "missing_import_dates": 0,
             "final_games": 1, "complete_player_games": 1, "player_category_rows": 2, **(report or {})}
        key = {"report_league": "NBA", "report_season": 2026, "report_season_type": 2}
        types = lambda d: ", ".join(f"{k} {'int' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in d.items())
        make = lambda ds: spark.createDataFrame([tuple(d.values()) for d in ds], types(ds[0]))
        return make([r]), make([{**key, **g}]), make([{**key, **p} for p in ps])
    rules = lambda **k: {r.rule for r in export_rules.export_violations(*frames(**k)).collect()}
    assert rules() == set()
    for fault, rule in (({"report": {"ready_for_export": False}}, "V1"), ({"game": {"season": "2025"}}, "V2"), ({"game": {"starts_at_utc": "2026-01-01T00:00:00"}}, "V3"),
                        ({"game": {"home_score": "1", "away_score": "1"}}, "V5"), ({"report": {"final_games": 2}}, "V6"), ({"player": {"team_id": "9"}}, "V7"),
                        ({"player": {"player_name": " "}}, "V8"), ({"player": {"participation_status": "did_not_play"}}, "V9"),
                        ({"player": {"stats_json": '{"points":null}'}}, "V10"), ({"player": {"team_id": "2"}}, "V11")):
        assert rule in rules(**fault), rule
    assert "V4" in rules(game={"away_team_id": "1"})


def stream_dir(spark, tmp_path, parts):
    for i, df in enumerate(parts):
        df.coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def finish(query):
    query.awaitTermination()


def test_stream_equals_batch_out_of_order(spark, tmp_path):
    parts = [snaps(spark, ("a", 5, "new"), ("b", 1, "x")), snaps(spark, ("a", 2, "stale"), ("b", 3, "y")), snaps(spark, ("c", 0, "z"), ("b", 2, "late"))]
    source = stream_dir(spark, tmp_path, parts)
    finish(jobs.start_upserts(jobs.stream_newest_wins(source, ["league", "game_id"], ["observed_at"]), f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True))
    got = jobs.read_upserts(spark, f"{tmp_path}/out", ["league", "game_id"])
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    want = upsert.newest(whole, ["league", "game_id"], ["observed_at"])
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())


def made(spark, *rows):
    return spark.createDataFrame([("m", g, T + timedelta(hours=s), T + timedelta(hours=a), p) for g, s, a, p in rows],
                                 "model_id string, game_id string, starts_at timestamp_ntz, generated_at timestamp_ntz, p double")


def test_ledger_freezes_moves_and_quarantines(spark, tmp_path):
    parts = [made(spark, ("a", 24, 1, 0.1), ("a", 24, 20, 0.2)), made(spark, ("a", 24, 25, 0.9), ("a", 30, 3, 0.4), ("far", 99, 1, 0.5))]
    source = stream_dir(spark, tmp_path, parts)
    finish(jobs.start_upserts(jobs.prediction_ledger(source), f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True))
    got = {(r.game_id, r.starts_at): r.p for r in jobs.read_upserts(spark, f"{tmp_path}/out", jobs.LEDGER_KEY).collect()}
    assert got == {("a", T + timedelta(hours=24)): 0.2, ("a", T + timedelta(hours=30)): 0.4}
    batch = jobs.prediction_ledger(parts[0].unionByName(parts[1]))
    assert {(r.game_id, r.starts_at): r.p for r in batch.collect()} == got
    assert [r.game_id for r in jobs.quarantined(parts[1]).collect()] == ["far"]


def test_ledger_drops_rows_behind_the_watermark(spark, tmp_path):
    parts = [made(spark, ("a", 24, 1, 0.1)), made(spark, ("b", 200, 190, 0.2)), made(spark, ("c", 201, 190, 0.3)),
             made(spark, ("a", 24, 20, 0.9)), made(spark, ("d", 202, 190, 0.4))]
    for i, df in enumerate(parts):  # the file source reads by modification time
        df.coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    source = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    finish(jobs.start_upserts(jobs.prediction_ledger(source), f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True))
    got = {r.game_id: r.p for r in jobs.read_upserts(spark, f"{tmp_path}/out", jobs.LEDGER_KEY).collect()}
    assert got == {"a": 0.1, "b": 0.2, "c": 0.3, "d": 0.4}


def test_merged_ledger_stores_what_it_refuses(spark, tmp_path):
    parts = [made(spark, ("a", 24, 1, 0.1)), made(spark, ("b", 200, 190, 0.2)), made(spark, ("a", 24, 20, 0.9), ("b", 200, 195, 0.5))]
    for df in parts:  # restarted for every part
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        finish(jobs.start_ledger(source, f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True, compact_every=2))
    assert {r.game_id: r.p for r in jobs.read_ledger(spark, f"{tmp_path}/out").collect()} == {"a": 0.1, "b": 0.5}
    assert [(r.game_id, r.p) for r in jobs.read_late(spark, f"{tmp_path}/out").collect()] == [("a", 0.9)]
    record = commits.latest(spark, f"{tmp_path}/out")[1]
    assert record["since"] == 2 and set(record["buckets"]) == {-1, 1}  # folded once, into the touched buckets


KEYS = ["league", "game_id"]


def upserts(spark, tmp_path, *parts, fresh="cp", every=2):
    """The parts one after the other, with a restart for each."""
    for rows in parts:
        snaps(spark, *rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run_upserts(spark, tmp_path, fresh, every)


def run_upserts(spark, tmp_path, fresh="cp", every=2):
    source = spark.readStream.schema(snaps(spark, ("a", 0, "x")).schema).parquet(f"{tmp_path}/in")
    finish(jobs.start_upserts(jobs.stream_newest_wins(source, KEYS, ["observed_at"]), f"{tmp_path}/out", f"{tmp_path}/{fresh}",
                              available_now=True, keys=KEYS, compact_every=every, buckets=8))


def stored(spark, tmp_path):
    return sorted(map(str, jobs.read_upserts(spark, f"{tmp_path}/out", KEYS).collect()))


PARTS = [[("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z"), ("c", 1, "w")], [("d", 1, "v")], [("b", 5, "u")]]


def test_a_replayed_folding_batch_loses_nothing(spark, tmp_path):
    """The driver ends after the sink's commit and before Spark's: the batch is written again, state and all."""
    upserts(spark, tmp_path, *PARTS[:2])
    before = stored(spark, tmp_path)
    assert len(before) == 3 and commits.latest(spark, f"{tmp_path}/out")[1]["since"] == 2
    for name in ("1", ".1.crc"):
        (tmp_path / "cp" / "commits" / name).unlink()
    run_upserts(spark, tmp_path)
    assert stored(spark, tmp_path) == before
    upserts(spark, tmp_path, *PARTS[2:])
    whole = snaps(spark, *[r for p in PARTS for r in p])
    want = upsert.newest(whole, KEYS, ["observed_at"])
    assert stored(spark, tmp_path) == sorted(map(str, want.select(*jobs.read_upserts(spark, f"{tmp_path}/out", KEYS).columns).collect()))


def test_a_fold_that_ends_before_its_commit_is_repeated(spark, tmp_path, monkeypatch):
    upserts(spark, tmp_path, PARTS[0])
    before = stored(spark, tmp_path)
    with monkeypatch.context() as m:
        def lost(*_):
            raise OSError("driver lost")
        m.setattr(commits, "publish", lost)
        with pytest.raises(Exception):
            upserts(spark, tmp_path, PARTS[1])
    assert stored(spark, tmp_path) == before  # what the attempt wrote is not seen
    run_upserts(spark, tmp_path)
    after = jobs.read_upserts(spark, f"{tmp_path}/out", KEYS).collect()
    assert {r.game_id: r.status for r in after} == {"a": "z", "b": "y", "c": "w"}


def test_a_new_checkpoint_does_not_pass_for_a_replay(spark, tmp_path):
    upserts(spark, tmp_path, PARTS[0])
    upserts(spark, tmp_path, PARTS[3], fresh="cp2")  # its batches are numbered from zero again
    assert {r.game_id: r.status for r in jobs.read_upserts(spark, f"{tmp_path}/out", KEYS).collect()} == {"a": "x", "b": "u"}


def test_a_merge_rewrites_the_touched_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(200).selectExpr("concat('k', id) AS k", "id AS v")
    keyed_store.add(path, rows, keys=["k"], merge_every=1, buckets=16)
    names = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "state").glob("_commit=*/_bucket=*/*.parquet")}
    first = names()
    assert len(first) == 16
    keyed_store.add(path, spark.createDataFrame([("k7", 1000)], "k string, v long"), keys=["k"], merge_every=1, buckets=16)
    second = names()
    assert len([f for f in first if f in second and first[f] == second[f]]) == 16 and len(second) == 17  # the old one stays for readers
    got = {r.k: r.v for r in upsert.newest(keyed_store.read(spark, path), ["k"], ["batch_id"]).collect()}
    assert got == {**{f"k{i}": i for i in range(200)}, "k7": 1000}
    keyed_store.add(path, spark.createDataFrame([("k7", 1001)], "k string, v long"), keys=["k"], merge_every=1, buckets=16)
    assert len(names()) == 17 and keyed_store.read(spark, path).where("k = 'k7'").first().v == 1001


def test_two_writers_cannot_make_the_same_commit(spark, tmp_path):
    commits.publish(spark, str(tmp_path), 0, {"a": 1})
    with pytest.raises(Exception):
        commits.publish(spark, str(tmp_path), 0, {"a": 2})
    assert commits.latest(spark, str(tmp_path)) == (0, {"a": 1})
