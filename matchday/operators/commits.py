"""Numbered commits: one small file says what readers of a folder see.

Data folders carry the number of the commit that names them and are never written again once it exists, so a step that is
repeated after a crash finds its commit and does nothing, and readers see the state before or after a step, never between.
A commit is written aside and renamed, and renaming fails where the number is taken: of two writers one stops.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from matchday.session import hadoop

KEPT = 10


def _folder(path: str) -> str:
    return f"{path}/_commits"


def numbers(spark: SparkSession, path: str) -> list[int]:
    files, glob = hadoop(spark, f"{_folder(path)}/*.json")
    return sorted(int(s.getPath().getName().removesuffix(".json")) for s in files.globStatus(glob) or [])


def read_text(spark: SparkSession, path: str) -> str:
    files, at = hadoop(spark, path)
    stream = files.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def latest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the last commit; -1 and an empty record where there is none."""
    found = numbers(spark, path)
    return (found[-1], json.loads(read_text(spark, f"{_folder(path)}/{found[-1]:020d}.json"))) if found else (-1, {})


def publish(spark: SparkSession, path: str, number: int, record: dict) -> None:
    """Make `number` the last commit.  Fails if another writer was first."""
    aside = f"{_folder(path)}/.{uuid.uuid4().hex}"
    files, source = hadoop(spark, aside)
    _, target = hadoop(spark, f"{_folder(path)}/{number:020d}.json")
    out = files.create(source)
    out.write(bytearray(json.dumps(record).encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(source, target, spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0))
    for old in numbers(spark, path)[:-KEPT]:
        remove(spark, f"{_folder(path)}/{old:020d}.json")


def remove(spark: SparkSession, path: str) -> None:
    files, at = hadoop(spark, path)
    files.delete(at, True)


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match, as paths."""
    files, glob = hadoop(spark, pattern)
    return [s.getPath().toString() for s in files.globStatus(glob) or []]
