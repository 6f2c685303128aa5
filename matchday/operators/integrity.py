"""Keys and references of the stored tables, declared once; each key is checked with all that refer to it in one pass.

The rows of a table and of the tables that refer to it are reduced to the key and counted by where they come from, with
map-side combining: a key that two rows of its table have is not unique, one that only referring rows have is missing.  No
key needs its rows in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Key:
    """A table's key, and (rule, table, columns) of what refers to it."""

    table: str
    columns: tuple[str, ...]
    rule: str
    references: tuple[tuple[str, str, tuple[str, ...]], ...] = field(default=())


CATALOGUE = (
    Key("leagues", ("abbreviation",), "league_unique", (
        ("team_league", "teams", ("league",)), ("player_league", "players", ("league",)), ("game_league", "games", ("league",)),
        ("team_import_league", "team_imports", ("league",)), ("date_import_league", "date_imports", ("league",)))),
    Key("teams", ("league", "team_id"), "team_unique", (
        ("game_team", "games", ("league", "home")), ("game_team", "games", ("league", "away")),
        ("import_team", "imports", ("league", "home")), ("import_team", "imports", ("league", "away")),
        ("line_team", "lines", ("league", "team_id")))),
    Key("players", ("league", "player_id"), "player_unique", (("line_player", "lines", ("league", "player_id")),)),
    Key("games", ("league", "game_id"), "game_unique", (
        ("line_game", "lines", ("league", "game_id")), ("import_game", "imports", ("league", "game_id")))),
    Key("lines", ("league", "game_id", "player_id", "category"), "line_unique"),
    Key("imports", ("league", "game_id"), "import_unique"),
    Key("team_imports", ("league",), "team_import_unique"),
    Key("date_imports", ("league", "import_date"), "date_import_unique"),
)


def repeated_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """The keys that stand more than once, and their ``rows``.

    Nearly all keys of a sound table stand once, so counting them by their own text would hold every key of a task's rows.
    Counting 64-bit hashes holds a number for each; only rows whose hash stands twice are then grouped by the key itself.
    """
    # the columns' own grouping: null equals null, and values are kept apart from their neighbours by position
    hashed = df.select(*columns, F.xxhash64(*columns).alias("key_hash"))
    twice = hashed.groupBy("key_hash").agg(F.count("*").alias("n")).where("n > 1").select("key_hash")
    return hashed.join(twice, "key_hash", "left_semi").groupBy(*columns).agg(F.count("*").alias("rows")).where("rows > 1")


def key_pass(key: Key, tables: dict[str, DataFrame]) -> DataFrame:
    """rule, key and rows: repeated keys of one table, and keys that rows refer to and that it lacks."""
    names = [f"k{i}" for i in range(len(key.columns))]

    def rows(table: str, columns: tuple[str, ...], place: int) -> DataFrame:
        return tables[table].select(*[F.col(c).cast("string").alias(n) for c, n in zip(columns, names)], F.lit(place).alias("place"))
    if not any(table in tables for _, table, _ in key.references):
        own = rows(key.table, key.columns, 0).where(" AND ".join(f"{n} IS NOT NULL" for n in names))
        return repeated_keys(own, names).select(F.lit(key.rule).alias("rule"), F.concat_ws("/", *names).alias("key"), "rows")
    asked = [(rule, table, columns) for rule, table, columns in key.references if table in tables]
    rules = list(dict.fromkeys(rule for rule, _, _ in asked))
    parts = [rows(key.table, key.columns, 0), *[rows(table, columns, 1 + rules.index(rule)) for rule, table, columns in asked]]
    counted = reduce(DataFrame.unionByName, parts).where(" AND ".join(f"{n} IS NOT NULL" for n in names)).groupBy(*names).agg(
        F.count_if(F.col("place") == 0).alias("own"), *[F.count_if(F.col("place") == i + 1).alias(f"n{i}") for i in range(len(rules))])
    found = [F.when(F.col("own") > 1, F.struct(F.lit(key.rule).alias("rule"), F.col("own").alias("rows")))]
    found += [F.when((F.col("own") == 0) & (F.col(f"n{i}") > 0), F.struct(F.lit(rule).alias("rule"), F.col(f"n{i}").alias("rows")))
              for i, rule in enumerate(rules)]
    return counted.select(F.concat_ws("/", *names).alias("key"), F.inline_outer(F.array_compact(F.array(*found)))).where(
        "rule IS NOT NULL").select("rule", "key", "rows")


def catalogue_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Every key and reference of the tables that are given.  Empty team manifests, which no key shows, are listed as well."""
    found = [key_pass(key, tables) for key in CATALOGUE if key.table in tables]
    if "team_imports" in tables and "external_ids" in tables["team_imports"].columns:
        empty = tables["team_imports"].where(F.coalesce(F.size("external_ids"), F.lit(0)) < 1)
        found.append(empty.select(F.lit("team_import_empty").alias("rule"), F.col("league").alias("key"), F.lit(1).cast("bigint").alias("rows")))
    return reduce(DataFrame.unionByName, found)
