"""Exports, run outputs and dataset fingerprints."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchday.functions.domain import FEATURES, KEY
from matchday.operators import commits
from matchday.operators.player_stats import participation
from matchday.session import hadoop, materialize

CSV = {"header": True, "quote": '"', "escape": '"', "nullValue": "", "emptyValue": ""}


def rfc3339(time: Column) -> Column:
    fraction = F.regexp_replace(F.date_format(time, ".SSSSSS"), r"\.?0+$", "")
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def export_games(games: DataFrame) -> DataFrame:
    """Final games as text; nulls become empty fields."""
    return games.where("status = 'final'").select(
        "game_id", *KEY, rfc3339(F.col("starts_at")).alias("starts_at_utc"), F.col("home").alias("home_team_id"),
        F.col("away").alias("away_team_id"), text("home_score"), text("away_score"),
        F.col("players_complete").cast("string").alias("player_import_complete"), text("week"))


def export_players(lines: DataFrame) -> DataFrame:
    """Player rows with raw statistics untouched and the participation status beside them."""
    return participation(lines).select(
        *KEY, "game_id", "player_id", F.col("name").alias("player_name"), "team_id", "category", "position", "jersey",
        text("did_not_play"), text("starter"), "stats_json", "participation_status")


def stored_keys(spark, path: str) -> DataFrame | None:
    """Keys that have a partition folder: the folder names are read, not the rows.  There are as many as seasons."""
    files, glob = hadoop(spark, "/".join([path, *(f"{k}=*" for k in KEY)]))
    keys = []
    for status in files.globStatus(glob) or []:
        values = status.getPath().toString().split("/")[-len(KEY):]
        league, season, season_type = (unquote(v.split("=", 1)[1]) for v in values)
        keys.append((league, int(season), int(season_type)))
    return spark.createDataFrame(keys, "league string, season int, season_type int") if keys else None


def remove_keys(spark, path: str, keys: list) -> None:
    """Delete the partition folders of the given keys."""
    for key in keys:
        files, folder = hadoop(spark, "/".join([path, *(f"{k}={key[k]}" for k in KEY)]))
        files.delete(folder, True)


def write_keyed(df: DataFrame, path: str, order: list[str], *, overwrite: bool = False, kind: str = "csv",
                scopes: DataFrame | None = None) -> None:
    """Partitioned by key.  Existing keys are replaced only on request, and no other key is touched.

    ``scopes`` names the keys an export stands for.  A stored key among them that has no rows now is removed after the
    write; there are as many keys as seasons, so their list is small.

    Range partitioning on (key, order) spreads a large key over many tasks and files that are sorted
    one after the other; hash partitioning on the key would write it from a single task.
    """
    existing = stored_keys(df.sparkSession, path)
    stale = []
    if existing is not None and scopes is not None and overwrite:
        gone = existing.join(scopes.select(*KEY).distinct(), KEY, "left_semi").join(df.select(*KEY).distinct(), KEY, "left_anti")
        stale = gone.collect()
    if existing is not None and not overwrite:
        clash = (df if scopes is None else scopes).select(*KEY).distinct().join(existing, KEY, "left_semi").limit(1).collect()
        if clash:
            raise ValueError(f"export of {tuple(clash[0])} already exists; pass overwrite=True to replace it")
    ordered = df.repartitionByRange(*KEY, *order).sortWithinPartitions(*KEY, *order)
    writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEY)
    (writer.options(**CSV).csv(path) if kind == "csv" else writer.format(kind).save(path))
    remove_keys(df.sparkSession, path, stale)


def require_ready(report: DataFrame, allow_incomplete: bool) -> None:
    if not allow_incomplete and report.where(~F.col("ready_for_export")).limit(1).collect():
        raise ValueError("quality checks failed; inspect the report or pass allow_incomplete=True")


EXPORT = {"games": ["starts_at_utc", "game_id"], "players": ["game_id", "player_id", "category"], "report": [], "issues": ["code", "detail"]}


def scope_name(key) -> str:
    return "/".join(f"{k}={key[k]}" for k in KEY)


def write_export(path: str, games: DataFrame, players: DataFrame, report: DataFrame, issues: DataFrame, *,
                 overwrite: bool = False, allow_incomplete: bool = False) -> int:
    """Games, players, report and findings of every scope in ``report``, as one unit; the number of its commit.

    Scopes that are stored already are refused before anything is written, unless they are to be replaced.  The four tables
    are written to a version of their own, which no reader sees until one commit names it for its scopes; what fails on the
    way leaves the stored export whole.  A scope is replaced with all that it had.  There are as many scopes as seasons.
    """
    spark = report.sparkSession
    # written once: every step below reads these rows, and sorting into ranges reads what it sorts twice
    report = materialize(report, "report")
    require_ready(report, allow_incomplete)
    last, before = commits.latest(spark, path)
    stored = before.get("scopes", {})
    keys = report.select(*KEY).distinct().collect()
    scopes = [scope_name(r) for r in keys]
    clash = sorted(set(scopes) & set(stored))
    if clash and not overwrite:
        raise ValueError(f"export of {clash[0]} already exists; pass overwrite=True to replace it")
    number = last + 1
    version = f"{path}/versions/{number:020d}"
    commits.remove(spark, version)  # left by an attempt that ended early
    mine = spark.createDataFrame(keys, report.select(*KEY).schema)
    tables = {"games": export_games(games), "players": export_players(players),
              "report": report.withColumn("schema_version", F.lit(4)), "issues": issues}
    for name, df in tables.items():
        kind = "csv" if name in ("games", "players") else "json"
        rows = df.join(mine, KEY, "left_semi")
        write_keyed(materialize(rows, name) if kind == "csv" else rows, f"{version}/{name}", EXPORT[name], kind=kind)
    now = {**stored, **{s: number for s in scopes}}
    commits.publish(spark, path, number, {"scopes": now})
    named = {*now.values(), *stored.values()}  # readers may still be at the commit before
    for folder in commits.folders(spark, f"{path}/versions/*"):
        if int(folder.rsplit("/", 1)[1]) not in named:
            commits.remove(spark, folder)
    return number


def export_folders(spark, path: str, name: str) -> list[str]:
    """Folders of one table of an export, one per scope that has rows in it, as the last commit names them."""
    _, record = commits.latest(spark, path)
    found = []
    for version in sorted(set(record.get("scopes", {}).values())):
        base = f"{path}/versions/{version:020d}/{name}"
        there = stored_keys(spark, base)
        if there is not None:
            found += [f"{base}/{scope_name(r)}" for r in there.collect() if record["scopes"].get(scope_name(r)) == version]
    return found


def run_features(split: DataFrame) -> DataFrame:
    return split.select(*KEY, "split", "game_id", "date", F.col("target").alias("home_win"), *FEATURES)


def write_run(path: str, split: DataFrame, predictions: DataFrame) -> None:
    """A run is written once and never replaced."""
    run_features(split).write.mode("errorifexists").parquet(f"{path}/features")
    predictions.write.mode("errorifexists").parquet(f"{path}/predictions")


def dataset_fingerprint(df: DataFrame, by: list[str]) -> DataFrame:
    """Identity of a set of rows that ignores their order; combines on the map side.

    A row's digest is the MD5 of its values as text in column order by name, a null written as \\N and values kept apart
    by a unit separator, so any engine with MD5 can recompute it.  The first 15 hex digits of the digests are added up.
    """
    columns = sorted(c for c in df.columns if c not in by)
    canonical = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    digest = F.conv(F.substring(F.md5(canonical), 1, 15), 16, 10).cast("decimal(28,0)")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(digest).cast("string").alias("fingerprint"))
