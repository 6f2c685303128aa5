"""Continuous forms of the merges, with file-backed sinks that a restarted job can replay."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from matchday.functions.domain import LEDGER_HOURS
from matchday.operators import commits, keyed_store
from matchday.operators.upsert import newest
from matchday.sources import scoreboard

LEDGER_KEY = ["model_id", "game_id", "starts_at"]
AHEAD_HOURS = 48


def stream_newest_wins(source: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key seen so far; an older snapshot that arrives late changes nothing.

    The state is one row per key, kept by the state store; each micro-batch is pre-aggregated.
    """
    rest = [c for c in source.columns if c not in keys]
    return source.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(
        *[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in source.columns])


def horizon(hours: int):
    return F.col("generated_at") + F.make_dt_interval(hours=F.lit(hours))


def admissible(predictions: DataFrame, ahead_hours: int = AHEAD_HOURS) -> DataFrame:
    """Made before the start and not too far ahead: one absurd start must not move the watermark."""
    return predictions.where(
        (F.col("generated_at") < F.col("starts_at")) & (F.col("starts_at") <= horizon(ahead_hours)))


def quarantined(predictions: DataFrame, ahead_hours: int = AHEAD_HOURS) -> DataFrame:
    """What ``admissible`` leaves out for being too far ahead; ``start_quarantine`` stores it."""
    return predictions.where(F.col("starts_at") > horizon(ahead_hours))


def prediction_ledger(predictions: DataFrame, ahead_hours: int = AHEAD_HOURS) -> DataFrame:
    """Last prediction made before each (model, game, start): frozen after the start, and a moved
    start is a new entry.  Streaming input expires 72 hours behind the greatest start seen."""
    rows = admissible(predictions, ahead_hours)
    if predictions.isStreaming:
        # Watermarks need a zoned timestamp; the session zone is UTC, so the instant is the same.
        rows = rows.withColumn("starts_at", F.col("starts_at").cast("timestamp")).withWatermark(
            "starts_at", f"{LEDGER_HOURS} hours")
    rest = [c for c in predictions.columns if c not in LEDGER_KEY]
    kept = rows.groupBy(*LEDGER_KEY).agg(
        F.max_by(F.struct(*rest), F.struct("generated_at", *[c for c in rest if c != "generated_at"])).alias("row"))
    return kept.select("model_id", "game_id", F.col("starts_at").cast("timestamp_ntz").alias("starts_at"), "row.*")


def started(writer, available_now: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def writer_id(spark: SparkSession, checkpoint: str) -> str:
    """The stream's own id, which Spark keeps in its checkpoint: a new checkpoint numbers its batches from zero again."""
    return json.loads(commits.read_text(spark, f"{checkpoint}/metadata"))["id"]


def start_upserts(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False,
                  keys: list[str] | None = None, compact_every: int = 20, buckets: int = keyed_store.BUCKETS) -> StreamingQuery:
    """Add each batch's changed rows to a keyed store; a replayed batch that was committed is not written again.

    With ``keys`` every ``compact_every``-th batch is merged into the buckets that it and its predecessors touch.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        keyed_store.add(path, batch, batch=(writer_id(batch.sparkSession, checkpoint), batch_id), keys=keys,
                        merge_every=compact_every, buckets=buckets)
    writer = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return started(writer, available_now)


def read_upserts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current state of an upsert sink: per key the row of the latest batch."""
    return newest(keyed_store.read(spark, path), keys, ["batch_id"]).drop("batch_id")


def ledger_order(columns: list[str]) -> list[str]:
    return ["generated_at", *[c for c in columns if c not in (*LEDGER_KEY, "generated_at", "batch_id")]]


def start_ledger(predictions: DataFrame, path: str, checkpoint: str, available_now: bool = False,
                 ahead_hours: int = AHEAD_HOURS, compact_every: int = 20, buckets: int = keyed_store.BUCKETS) -> StreamingQuery:
    """The ledger as a merge against its stored form, which needs no state store and loses no row.

    Each batch is reduced to one row per key.  A row that starts more than 72 hours before the greatest start of the earlier
    batches is refused and stored as late.  Rows, late rows and the greatest start are one commit, so that a replayed batch
    is either there whole or judged as it was the first time.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = admissible(batch, ahead_hours).persist()
        seen = commits.latest(spark, path)[1].get("notes", {}).get("seen")
        bound = F.lit(seen).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(LEDGER_HOURS))
        late = F.coalesce(F.col("starts_at") < bound, F.lit(False))
        greatest = rows.agg(F.max("starts_at").cast("string")).first()[0]
        keyed_store.add(
            path, newest(rows.where(~late), LEDGER_KEY, ledger_order(batch.columns)), keys=LEDGER_KEY,
            batch=(writer_id(spark, checkpoint), batch_id), order=ledger_order(batch.columns), merge_every=compact_every,
            buckets=buckets, outputs={"late": rows.where(late)}, notes={"seen": max(filter(None, (seen, greatest)), default=None)})
        rows.unpersist()
    return started(predictions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), available_now)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    rows = keyed_store.read(spark, path)
    return newest(rows, LEDGER_KEY, ledger_order(rows.columns)).drop("batch_id")


def read_late(spark: SparkSession, path: str) -> DataFrame:
    return keyed_store.read_output(spark, path, "late")


def start_quarantine(predictions: DataFrame, path: str, checkpoint: str, available_now: bool = False,
                     ahead_hours: int = AHEAD_HOURS) -> StreamingQuery:
    """Append the predictions that the ledger refuses for their horizon, from the ledger's own source."""
    writer = quarantined(predictions, ahead_hours).writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint)
    return started(writer, available_now)


def start_quality(raw: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Counts of rejected responses by reason, and skipped exhibition events, per batch; a batch is parsed once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        verdicts = scoreboard.judged(batch).persist()
        rejects = scoreboard.rejects(verdicts).groupBy("league", "reason").agg(F.count("*").alias("responses"))
        keyed_store.add(path, rejects, batch=(writer_id(batch.sparkSession, checkpoint), batch_id),
                        outputs={"skips": scoreboard.skips(verdicts)})
        verdicts.unpersist()
    return started(raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), available_now)


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    """Rejected responses by league and reason, over all batches."""
    return keyed_store.read(spark, path).groupBy("league", "reason").agg(F.sum("responses").alias("responses"))
