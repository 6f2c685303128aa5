"""What the operators share: column picking, word patterns, written tables."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchday.session import configure, materialize

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only.

    Columns are matched by exact name and position, so further columns, also such as differ in case alone, cannot make a
    reference ambiguous.
    """
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names)])


def words(text):
    """Array of the words of a string column: maximal runs without white space."""
    one = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(one, " "), "")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by a table below spark.checkpoint.dir."""
    return materialize(df, label)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for what runs inside: long texts then take little memory outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
