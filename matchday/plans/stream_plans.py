"""Registered streaming queries (X1-X3).  Each runs the stream to its end and returns the sink's state."""

from pyspark.sql import functions as F

from matchday.operators import keyed_store
from matchday.plans.registry import SQL, query, view
from matchday.plans.raw_plans import raw_scoreboards
from matchday.session import scratch_dir
from matchday.sources.adapter import Tables
from matchday.streaming import jobs


def event_batches(t, base, files=3):
    """The events as a stream of one micro-batch per file, in no order of time."""
    t["events"].repartition(files).write.parquet(f"{base}/events")
    schema = t.spark.read.parquet(f"{base}/events").schema
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/events")


def run(start, *args, **options):
    jobs_query = start(*args, available_now=True, **options)
    jobs_query.awaitTermination()


@query("stream_newest_wins", """
SELECT game_id, observed_at, seq, status, home_score FROM (
  SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY observed_at DESC, seq DESC) AS r FROM snapshots) WHERE r = 1""")
def _(t):
    scored = F.col("event_type").isin("view", "purchase")
    base = scratch_dir(t.spark)
    source = event_batches(t, base).select(*Tables.snapshot_columns(scored))
    run(jobs.start_upserts, jobs.stream_newest_wins(source, ["game_id"], ["observed_at", "seq"]), f"{base}/out", f"{base}/checkpoint",
        keys=["game_id"], compact_every=2)
    return jobs.read_upserts(t.spark, f"{base}/out", ["game_id"]).select("game_id", "observed_at", "seq", "status", "home_score")


def made(events):
    """Predictions for each user's next midnight; purchases look three days ahead and are quarantined."""
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    ahead = F.when(F.col("event_type") == "purchase", F.expr("INTERVAL 3 DAYS")).when(
        F.col("event_type") == "error", F.expr("INTERVAL 0 DAYS")).otherwise(F.expr("INTERVAL 1 DAYS"))
    return events.select(
        F.col("event_type").alias("model_id"), F.col("user_id").cast("string").alias("game_id"),
        (day + ahead).alias("starts_at"), F.col("ts").alias("generated_at"), (F.col("value") / 1000).alias("p"))


view("made", """
SELECT event_type AS model_id, CAST(user_id AS STRING) AS game_id,
  date_trunc('day', ts) + to_days(CASE event_type WHEN 'purchase' THEN 3 WHEN 'error' THEN 0 ELSE 1 END) AS starts_at, ts AS generated_at, value / 1000 AS p FROM events""")
LEDGER = """
SELECT model_id, game_id, starts_at, max(generated_at) AS generated_at, arg_max(p, generated_at) AS p FROM made
WHERE generated_at < starts_at AND starts_at <= generated_at + INTERVAL 48 HOUR GROUP BY model_id, game_id, starts_at"""


@query("prediction_ledger", LEDGER)
def _(t):
    return jobs.prediction_ledger(made(t["events"])).select(*jobs.LEDGER_KEY, "generated_at", "p")


@query("stream_prediction_ledger", LEDGER)
def _(t):
    """The form with a state store, over the events as one batch."""
    base = scratch_dir(t.spark)
    source = t.spark.readStream.schema(t.raw("events").schema).option("maxFilesPerTrigger", 64).parquet(f"{t.sf_dir}/events*.parquet")
    run(jobs.start_upserts, jobs.prediction_ledger(made(source)), f"{base}/out", f"{base}/checkpoint", keys=jobs.LEDGER_KEY,
        compact_every=1)
    return jobs.read_upserts(t.spark, f"{base}/out", jobs.LEDGER_KEY).select(*jobs.LEDGER_KEY, "generated_at", "p")


view("halves", """
SELECT event_id % 2 AS half, event_type AS model_id, CAST(user_id AS STRING) AS game_id,
  date_trunc('day', ts) + to_days(CASE event_type WHEN 'purchase' THEN 3 WHEN 'error' THEN 0 ELSE 1 END) AS starts_at, ts AS generated_at, value / 1000 AS p FROM events""")
view("in_order", """
SELECT *, half = 1 AND starts_at < (SELECT max(starts_at) FROM halves WHERE half = 0 AND generated_at < starts_at
  AND starts_at <= generated_at + INTERVAL 48 HOUR) - INTERVAL 72 HOUR AS late
FROM halves WHERE generated_at < starts_at AND starts_at <= generated_at + INTERVAL 48 HOUR""")


def ledger_in_halves(t):
    """The even events, then the odd ones after a restart: most of the second half comes too late."""
    base = scratch_dir(t.spark)
    for half in (0, 1):
        t["events"].where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{base}/events")
        source = t.spark.readStream.schema(t["events"].schema).parquet(f"{base}/events")
        run(jobs.start_ledger, made(source), f"{base}/out", f"{base}/checkpoint", compact_every=2)
    return f"{base}/out"


@query("stream_ledger_merge", """
SELECT model_id, game_id, starts_at, max(generated_at) AS generated_at, arg_max(p, generated_at) AS p FROM in_order
WHERE NOT late GROUP BY model_id, game_id, starts_at""")
def _(t):
    return jobs.read_ledger(t.spark, ledger_in_halves(t)).select(*jobs.LEDGER_KEY, "generated_at", "p")


@query("stream_late_predictions", "SELECT model_id, game_id, starts_at, generated_at, p FROM in_order WHERE late")
def _(t):
    return jobs.read_late(t.spark, ledger_in_halves(t))


QUARANTINE = "SELECT * FROM made WHERE starts_at > generated_at + INTERVAL 48 HOUR"


@query("prediction_quarantine", QUARANTINE)
def _(t):
    return jobs.quarantined(made(t["events"]))


@query("stream_prediction_quarantine", QUARANTINE)
def _(t):
    base = scratch_dir(t.spark)
    source = made(event_batches(t, base))
    run(jobs.start_quarantine, source, f"{base}/out", f"{base}/checkpoint")
    return t.spark.read.schema(source.schema).parquet(f"{base}/out")


def quality(t):
    base = scratch_dir(t.spark)
    raw_scoreboards(t).write.parquet(f"{base}/raw")
    stored = t.spark.read.parquet(f"{base}/raw")
    source = t.spark.readStream.schema(stored.schema).parquet(f"{base}/raw")
    run(jobs.start_quality, source, f"{base}/out", f"{base}/checkpoint")
    return f"{base}/out"


@query("stream_quality", """
SELECT league, reason, count(*) AS responses FROM (
SELECT response_id, league, whole AS reason FROM sb_responses WHERE whole IS NOT NULL
UNION ALL SELECT DISTINCT e.response_id, e.league, e.reason FROM sb_judged e JOIN sb_responses r ON r.response_id = e.response_id
WHERE r.whole IS NULL AND e.reason IS NOT NULL) GROUP BY league, reason""")
def _(t):
    return jobs.read_quality(t.spark, quality(t))


@query("stream_quality_skips", SQL["exhibition_filter"])
def _(t):
    return keyed_store.read_output(t.spark, quality(t), "skips")
