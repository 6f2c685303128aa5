"""Raw team lists: nested sports, leagues and teams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchday.functions import expr
from matchday.sources.scoreboard import accepted, with_document

SCHEMA = """
sports array<struct<leagues: array<struct<abbreviation: string, teams: array<struct<
  team: struct<id: string, displayName: string, abbreviation: string>>>>>>>
"""


def judged(raw: DataFrame) -> DataFrame:
    league = F.col("league")
    nested = F.flatten(F.transform(F.coalesce("doc.sports", F.array()), lambda s: F.flatten(F.transform(
        F.filter(F.coalesce(s["leagues"], F.array()), lambda g: g["abbreviation"] == league),
        lambda g: F.coalesce(g["teams"], F.array())))))
    teams = F.transform(nested, lambda t: F.struct(
        t["team"]["id"].alias("team_id"), t["team"]["displayName"].alias("name"), t["team"]["abbreviation"].alias("abbreviation")))
    ids = F.col("teams.team_id")
    lack = lambda t: expr.blank(t["team_id"]) | expr.blank(t["name"]) | expr.blank(t["abbreviation"])
    reasons = F.when(F.col("doc").isNull(), F.array(F.lit("bad_json"))).otherwise(
        F.array_compact(F.array(
            F.when(F.size("teams") == 0, "no_teams"), F.when(F.exists("teams", lack), "missing_field"),
            F.when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate_team"))))
    return with_document(raw, SCHEMA).withColumn("teams", teams).withColumn(
        "reasons", reasons).select("response_id", "league", "teams", "reasons")


def teams_decode(raw: DataFrame) -> DataFrame:
    return judged(raw).select("response_id", "league", F.inline_outer(accepted(F.col("teams")))).where("team_id is not null")


def teams_rejects(raw: DataFrame) -> DataFrame:
    return judged(raw).select("response_id", "league", F.explode_outer("reasons").alias("reason")).where("reason is not null")
