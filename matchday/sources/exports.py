"""Reading exports back as strict text.

A table is a folder partitioned by key, or the folders that the last commit of an export names.  CSV files are read by their
own header: columns are found by name, further ones are left out, a missing or repeated one is a fault, but for columns that
older versions do not have.  One header is looked at per key, of which there are as many as seasons; the reader holds every
other file of the key against it, and refuses ragged rows.
"""

from __future__ import annotations

import csv
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchday.functions.domain import KEY
from matchday.operators import commits, sinks
from matchday.operators.export_rules import REPORT
from matchday.session import hadoop

GAME_COLUMNS = ["game_id", "starts_at_utc", "home_team_id", "away_team_id", "home_score", "away_score",
                "player_import_complete", "week"]
PLAYER_COLUMNS = ["game_id", "player_id", "player_name", "team_id", "category", "position", "jersey", "did_not_play",
                  "starter", "stats_json", "participation_status"]
OPTIONAL = {"week", "position", "jersey"}
KEY_TYPES = ["league string", "season int", "season_type int"]


class HeaderFault(ValueError):
    """A file whose header lacks a declared column or has one twice."""


def table_folders(spark: SparkSession, path: str, name: str) -> tuple[str, list[str]]:
    """Base path and key folders of a table."""
    if commits.latest(spark, path)[0] >= 0:
        return f"{path}/versions", sinks.export_folders(spark, path, name)
    return f"{path}/{name}", commits.folders(spark, "/".join([path, name, *(f"{k}=*" for k in KEY)]))


def header_of(spark: SparkSession, folder: str) -> tuple[str, ...]:
    """The header of the first file of a folder."""
    files, at = hadoop(spark, folder)
    names = sorted(s.getPath().toString() for s in files.listStatus(at) if s.getPath().getName()[0] not in "_.")
    if not names:
        return ()
    java = spark._jvm.java.io
    reader = java.BufferedReader(java.InputStreamReader(files.open(hadoop(spark, names[0])[1]), "UTF-8"))
    try:
        return tuple(next(csv.reader([reader.readLine() or ""]), []))
    finally:
        reader.close()


def read_csv(spark: SparkSession, folders: list[str], header: tuple[str, ...], columns: list[str]) -> DataFrame:
    lack = [c for c in columns if c not in header and c not in OPTIONAL]
    twice = [c for c in header if header.count(c) > 1]
    if lack or twice:
        raise HeaderFault(f"{folders[0]}: missing {lack}, repeated {twice}")
    schema = ", ".join(f"`{c}` string" for c in header)
    rows = (
        spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
        .option("columnPruning", False).option("quote", '"').option("escape", '"').option("nullValue", "").csv(folders))
    key = F.split(F.regexp_extract("_metadata.file_path", "/league=([^/]*/season=[^/]*/season_type=[^/]*)/", 1), "/")
    part = lambda i: F.url_decode(F.substring_index(F.get(key, F.lit(i)), "=", -1))
    return rows.select(
        *[F.col(c) if c in header else F.lit(None).cast("string").alias(c) for c in columns], part(0).alias("league"),
        part(1).cast("int").alias("season"), part(2).cast("int").alias("season_type"), F.lit("week" in header).alias("week_present"))


def read_table(spark: SparkSession, path: str, name: str, columns: list[str]) -> DataFrame:
    """The declared columns of a table, the key, and whether its file has a week column.  One read per different header."""
    _, folders = table_folders(spark, path, name)
    if not folders:
        return spark.createDataFrame([], ", ".join([*(f"{c} string" for c in columns), *KEY_TYPES, "week_present boolean"]))
    by_header = sorted(((header_of(spark, f), f) for f in folders), key=lambda x: x[0])
    groups = [(header, [f for _, f in group]) for header, group in groupby(by_header, key=lambda x: x[0])]
    return reduce(DataFrame.unionByName, [read_csv(spark, fs, header, columns) for header, fs in groups])


def with_report_key(df: DataFrame) -> DataFrame:
    """Rows of an export as the export rules take them: the partition's key, and the key fields as text."""
    return df.select("*", *[F.col(k).alias(r) for k, r in zip(KEY, REPORT)]).withColumn(
        "season", F.col("season").cast("string")).withColumn("season_type", F.col("season_type").cast("string"))


def read_games(spark: SparkSession, path: str, with_presence: bool = False) -> DataFrame:
    """``week`` is null where a file has no such column; ``with_presence`` tells that from an empty field."""
    rows = read_table(spark, path, "games", GAME_COLUMNS)
    return rows if with_presence else rows.drop("week_present")


def read_players(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "players", PLAYER_COLUMNS).drop("week_present")


def read_json(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    base, folders = table_folders(spark, path, name)
    whole = f"{schema}, {', '.join(KEY_TYPES)}"
    if not folders:
        return spark.createDataFrame([], whole)
    # the key is read from the folder names: versions of an export lie side by side
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(folders)
    key = [F.regexp_extract("_metadata.file_path", f"/{k}=([^/]*)/", 1) for k in KEY]
    return rows.select("*", F.url_decode(key[0]).alias("league"), key[1].cast("int").alias("season"), key[2].cast("int").alias("season_type"))


REPORT_COLUMNS = ("schema_version int, stored_games bigint, final_games bigint, complete_player_games bigint, "
                  "player_category_rows bigint, issues bigint, warnings bigint, missing_import_dates bigint, ready_for_export boolean")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, "report", REPORT_COLUMNS)


def read_issues(spark: SparkSession, path: str, columns: str = "code string, severity string, game_id string, detail string") -> DataFrame:
    return read_json(spark, path, "issues", columns)
