"""A table of one row per key, kept in buckets of its keys' hash, to which batches are added and merged.

`path`/data/_commit=N holds the rows of commit N, `path`/state/_commit=N/_bucket=B the rows of a bucket as merged by commit N.  A
commit names for each bucket the merge that is current, and the first batch not merged yet; so a merge reads and writes
the buckets that its batches touch, and every other file keeps its place.  What the last commit but one names is kept for
readers that are still at it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchday.operators import commits
from matchday.operators.upsert import newest

BUCKETS = 64


def bucket_of(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")


def read_data(spark: SparkSession, path: str, first: int, last: int) -> DataFrame | None:
    """Rows of the batches `first` to `last`, with their number as batch_id."""
    paths = [f"{path}/data/_commit={n}" for n in range(first, last + 1)]
    if not paths:
        return None
    return spark.read.option("basePath", f"{path}/data").parquet(*paths).withColumnRenamed("_commit", "batch_id")


def read_state(spark: SparkSession, path: str, record: dict, wanted: list[int] | None = None) -> DataFrame | None:
    """Rows of the merged buckets (of the wanted ones), which count as older than any batch."""
    current = record.get("buckets", [])
    paths = [f"{path}/state/_commit={n}/_bucket={b}" for b, n in enumerate(current) if n >= 0 and (wanted is None or b in wanted)]
    if not paths:
        return None
    rows = spark.read.option("basePath", f"{path}/state").parquet(*paths)
    return rows.drop("_commit", "_bucket").withColumn("batch_id", F.lit(-1))


def united(*parts: DataFrame | None) -> DataFrame | None:
    there = [p for p in parts if p is not None]
    return there[0] if len(there) == 1 else there[0].unionByName(there[1]) if there else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows that the last commit names, with a batch_id that orders batches; several may have one key."""
    number, record = commits.latest(spark, path)
    if number < 0:
        raise FileNotFoundError(f"nothing was committed at {path}")
    return united(read_state(spark, path, record), read_data(spark, path, record["since"], number))


def read_output(spark: SparkSession, path: str, name: str) -> DataFrame:
    """What the committed batches wrote to a further output."""
    number, _ = commits.latest(spark, path)
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").where(F.col("_commit") <= number).drop("_commit")


def merge(spark: SparkSession, path: str, record: dict, number: int, keys: list[str], order: list[str]) -> list[int]:
    """Merge the batches up to `number` into the buckets they touch; the merge that is current for each bucket."""
    current = list(record["buckets"])
    rows = read_data(spark, path, record["since"], number).withColumn("_bucket", bucket_of(keys, len(current)))
    touched = [r._bucket for r in rows.select("_bucket").distinct().collect()]
    if not touched:
        return current
    stored = read_state(spark, path, record, touched)
    if stored is not None:
        rows = rows.unionByName(stored.withColumn("_bucket", bucket_of(keys, len(current))))
    # one exchange: grouping by bucket and keys is satisfied by rows dealt by bucket
    merged = newest(rows.repartition(len(touched), "_bucket"), ["_bucket", *keys], order).drop("batch_id")
    merged.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/state/_commit={number}")
    for b in touched:
        current[b] = number
    return current


def clean(spark: SparkSession, path: str, before: dict, now: dict) -> None:
    """Delete what neither of two commits names."""
    for folder in commits.folders(spark, f"{path}/data/_commit=*"):
        if int(folder.rsplit("=", 1)[1]) < before.get("since", 0):
            commits.remove(spark, folder)
    named = {(n, b) for record in (before, now) for b, n in enumerate(record.get("buckets", []))}
    for folder in commits.folders(spark, f"{path}/state/_commit=*/_bucket=*"):
        number, bucket = (int(x.split("=")[1]) for x in folder.split("/")[-2:])
        if (number, bucket) not in named:
            commits.remove(spark, folder)


def add(path: str, rows: DataFrame, *, batch: tuple[str, int] | None = None, keys: list[str] | None = None,
        order: list[str] | None = None, merge_every: int = 20, buckets: int = BUCKETS, outputs: dict[str, DataFrame] | None = None,
        notes: dict | None = None) -> bool:
    """Add rows, and further outputs, as one commit; with keys, every merge_every-th batch is followed by a merge.

    `batch` is a writer and the number of its batch: one that is committed already is not added again, and False is returned.
    """
    spark = rows.sparkSession
    last, before = commits.latest(spark, path)
    batches = dict(before.get("batches", {}))
    if batch and batches.get(batch[0], -1) >= batch[1]:
        for df in (rows, *(outputs or {}).values()):  # computed all the same: operators above keep their state by it
            df.write.format("noop").mode("overwrite").save()
        return False
    number = last + 1
    now = {"since": 0, "buckets": [-1] * buckets, "notes": {}, **before, "batches": batches}
    if batch:
        batches[batch[0]] = batch[1]
    now["notes"] = {**now["notes"], **(notes or {})}
    # number is not committed, so whatever these folders hold was left by an attempt that ended early
    rows.write.mode("overwrite").parquet(f"{path}/data/_commit={number}")
    for name, df in (outputs or {}).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/_commit={number}")
    merging = bool(keys) and number - now["since"] + 1 >= merge_every
    if merging:
        now["buckets"] = merge(spark, path, now, number, keys, order or ["batch_id"])
        now["since"] = number + 1
    commits.publish(spark, path, number, now)
    if merging:
        clean(spark, path, before, now)
    return True
