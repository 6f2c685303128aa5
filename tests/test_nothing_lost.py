"""Refused rows are listed, replaced scopes leave nothing behind, and documents are parsed once and strictly."""

from pyspark.sql import functions as F  # noqa: I001
from datetime import datetime, timedelta

from conftest import as_dicts, season_rows
from matchday.functions.domain import KEY
from matchday.operators import sinks, splits
from matchday.sources import boxscore, scoreboard, team_list
from matchday.streaming import jobs

RAW = "response_id string, league string, game_id string, import_date date, observed_at timestamp_ntz, body string"
STORED = "league string, game_id string, season int, season_type int, home string, away string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_document_is_parsed_once(spark, tmp_path):
    spark.createDataFrame([], RAW).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    stored = spark.createDataFrame([], STORED)
    for df in (scoreboard.scoreboard_decode(raw), scoreboard.manifest_responses(raw), boxscore.boxscore_decode(raw, stored),
               boxscore.boxscore_rejects(raw, stored), boxscore.placeholder_dnp(raw, stored), team_list.teams_decode(raw)):
        assert plan(df).count("from_json") == 1


def test_documents_stay_out_of_the_shuffle(spark, tmp_path):
    """What is sorted or dealt holds flat columns: no body, no document, no nested lines."""
    spark.createDataFrame([], RAW).write.parquet(str(tmp_path / "raw"))
    raw, stored = spark.read.parquet(str(tmp_path / "raw")), spark.createDataFrame([], STORED)
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (boxscore.boxscore_decode(raw, stored), boxscore.boxscore_rejects(raw, stored)):
            nodes = df._jdf.queryExecution().executedPlan().toString().splitlines()
            text = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            dealt = [part.split("Input [", 1)[1].split("]: ", 1)[1].splitlines()[0] for part in text.split("\n\n")
                     if part.lstrip().startswith("(") and " Exchange" in part.splitlines()[0] and "Input [" in part]
            assert len(dealt) == 2 and nodes
            assert not any(name + "#" in x for x in dealt for name in ("body", "wrapped", "doc", "lines", "teams", "kept"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_text_after_a_document_and_single_quotes_reject_it(spark):
    good = '{"leagues":[{"abbreviation":"NBA"}],"events":[]}'
    bodies = {"good": good, "spaced": good + " \n", "trailing": good + " more", "quotes": good.replace('"', "'"), "empty": "", "null": None}
    raw = spark.createDataFrame([(k, "NBA", "g", datetime(2026, 1, 1).date(), datetime(2026, 1, 1), b) for k, b in bodies.items()], RAW)
    bad = {r["response_id"]: r["reason"] for r in as_dicts(scoreboard.scoreboard_rejects(raw))}
    assert bad == {k: "bad_json" for k in ("trailing", "quotes", "empty", "null")}


def test_leaves_of_another_type_reject_a_document(spark):
    from matchday.functions import documents
    schema = "id string, week struct<number: int>, ok boolean, stats array<string>"
    fine = ['{"id":"a"}', '{"id":null}', '{"week":{"number":3}} ', '{"stats":["1",null]}', '{"id":"a","id":"b"}', '{"other":[1,{"x":2}]}', "{}"]
    wrong = ['{"id":1}', '{"id":{}}', '{"week":{"number":"3"}}', '{"week":{"number":3.0}}', '{"week":5}', '{"ok":"true"}', '{"stats":["1",2]}',
             '{"id":NaN}', '{"id":"a"}{"x":1}', '{"id":"a"},"digest":"0"}', '{"id":"a"}]', "[]", "null", "", "5", '{"id":"a"', None]
    df = spark.createDataFrame([(b,) for b in fine + wrong], "body string").withColumn("w", documents.parsed(F.col("body"), schema))
    got = [r.body for r in df.where(documents.valid(F.col("w"), F.col("body"), schema)).select("body").collect()]
    assert got == fine
    ids = [r.id for r in df.limit(5).select(documents.content(F.col("w"), schema).alias("c")).select("c.id").collect()]
    assert ids == ["a", None, None, None, "b"]


def test_numeric_scores_reject_a_response(spark):
    event = ('{"leagues":[{"abbreviation":"NBA"}],"events":[{"id":"g","season":{"year":2026,"type":2},"competitions":[{"type":{"abbreviation":"STD"},'
             '"date":"2026-01-01T00:00:00Z","status":{"type":{"name":"STATUS_FINAL","state":"post","completed":true}},"competitors":['
             '{"homeAway":"home","team":{"id":"1"},"score":SCORE},{"homeAway":"away","team":{"id":"2"},"score":"3"}]}]}]}')
    bodies = {"text": '"4"', "number": "4"}
    raw = spark.createDataFrame([(k, "NBA", "g", datetime(2026, 1, 1).date(), datetime(2026, 1, 1), event.replace("SCORE", v)) for k, v in bodies.items()], RAW)
    assert {r["response_id"]: r["reason"] for r in as_dicts(scoreboard.scoreboard_rejects(raw))} == {"number": "bad_json"}
    assert [r["response_id"] for r in as_dicts(scoreboard.scoreboard_decode(raw))] == ["text"]


def test_refused_season_pairs_and_leagues_are_listed(games):
    later = [[*r[:1], 2027, *r[2:3], "h" + r[3], r[4] + timedelta(days=10), *r[5:]] for r in season_rows()]
    apart = [[*r[:1], 2028, *r[2:3], "i" + r[3], r[4] + timedelta(days=400), *r[5:]] for r in season_rows()]
    df = games(season_rows() + later + apart)
    from matchday.operators.features import examples
    found = as_dicts(splits.cross_season_violations(df, examples(df)))
    assert {(r["earlier"], r["later"], r["reason"]) for r in found} >= {(2026, 2027, "season_overlap")}
    assert [(r["earlier"], r["later"]) for r in as_dicts(splits.cross_season_pairs(df))] == [(2027, 2028)]
    few = as_dicts(splits.season_inventory_violations(df, {"NBA": 2027, "NFL": 2027}))
    assert {(r["league"], r["development_seasons"]) for r in few} == {("NBA", 1), ("NFL", 0)}
    assert not as_dicts(splits.season_inventory_violations(df, {"NBA": 2028}))


def test_the_horizon_of_the_ledger_is_a_parameter(spark):
    start = datetime(2026, 1, 5)
    rows = [("m", f"g{h}", start, start - timedelta(hours=h), 0.5) for h in (-1, 0, 1, 48, 49, 90)]
    df = spark.createDataFrame(rows, "model_id string, game_id string, starts_at timestamp_ntz, generated_at timestamp_ntz, p double")
    ids = lambda x: {r["game_id"] for r in as_dicts(x)}
    assert ids(jobs.admissible(df)) == {"g1", "g48"} and ids(jobs.quarantined(df)) == {"g49", "g90"}
    assert ids(jobs.prediction_ledger(df, 72)) == {"g1", "g48", "g49"} and ids(jobs.quarantined(df, 72)) == {"g90"}


def test_a_scope_that_became_clean_keeps_no_old_rows(spark, tmp_path):
    path = str(tmp_path / "issues")
    schema = "league string, season int, season_type int, code string, detail string"
    rows = [("NBA", 2026, 2, "old", "a"), ("NBA", 2027, 2, "old", "b"), ("NFL", 2026, 2, "old", "c")]
    scopes = spark.createDataFrame([r[:3] for r in rows[:2]], "league string, season int, season_type int")
    sinks.write_keyed(spark.createDataFrame(rows, schema), path, ["code"], kind="json")
    fresh = spark.createDataFrame([("NBA", 2027, 2, "new", "d")], schema)
    sinks.write_keyed(fresh, path, ["code"], kind="json", overwrite=True, scopes=scopes)
    spark.catalog.clearCache()
    left = {(*(r[k] for k in KEY), r["code"]) for r in as_dicts(spark.read.json(path))}
    assert left == {("NBA", 2027, 2, "new"), ("NFL", 2026, 2, "old")}
