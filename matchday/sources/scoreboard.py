"""Raw scoreboard responses: one row per response, decoded without any shuffle.

A response is rejected as a whole by one bad event.  Its events are one bounded array (the protocol
limits a response to fewer than a thousand), so all rules run inside the row; only accepted games
leave it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchday.functions import documents, expr
from matchday.functions.domain import (
    EXHIBITION_COMPETITION, EXHIBITION_SEASON_TYPE, MAX_EVENTS, SCORED_STATUSES)

SCHEMA = """
leagues array<struct<abbreviation: string>>,
events array<struct<
  id: string, season: struct<year: int, type: int>, week: struct<number: int>,
  competitions: array<struct<
    type: struct<abbreviation: string>, date: string,
    status: struct<type: struct<name: string, state: string, completed: boolean>>,
    competitors: array<struct<homeAway: string, team: struct<id: string>, score: string>>>>>>
"""
ID = ["response_id", "league", "import_date", "observed_at"]


def empty(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def with_document(raw: DataFrame, schema: str) -> DataFrame:
    """Adds `doc`, null where the body is not one whole object with leaves of the declared types.  Parsed once."""
    wrapped = raw.withColumn("wrapped", documents.parsed(F.col("body"), schema))
    good = documents.valid(F.col("wrapped"), F.col("body"), schema)
    return wrapped.withColumn("doc", F.when(good, documents.content(F.col("wrapped"), schema))).drop("wrapped", "body")


def accepted(items: Column) -> Column:
    """An array of accepted responses, null for rejected ones.

    For outer generators.  A filter on the verdict would be pushed below it, and each of its reasons would parse the
    body once more.
    """
    return F.when(F.size("reasons") == 0, items)


def _facts(e: Column) -> Column:
    """Typed facts of one raw event."""
    c = F.get(e["competitions"], F.lit(0))
    state = c["status"]["type"]
    status = expr.game_status(
        F.coalesce(state["name"], F.lit("")), F.coalesce(state["state"], F.lit("")), F.coalesce(state["completed"], F.lit(False)))
    return F.struct(
        e["id"].alias("id"), e["season"]["year"].alias("season"), e["season"]["type"].alias("season_type"),
        F.coalesce(F.size(e["competitions"]), F.lit(0)).alias("n"),
        F.when(c["type"]["abbreviation"] == EXHIBITION_COMPETITION, "All-Star exhibition")
        .when(e["season"]["type"] == EXHIBITION_SEASON_TYPE, "preseason").alias("skip"),
        expr.utc_time(c["date"]).alias("starts_at"), status.alias("status"),
        e["week"].isNotNull().alias("has_week"), F.coalesce(e["week"]["number"], F.lit(0)).alias("week"),
        F.coalesce(c["competitors"], F.array()).alias("sides"))


def _verdict(league: Column):
    """Adds the first broken rule of an event, and its home and away sides."""
    def verdict(f: Column) -> Column:
        sides, status = f["sides"], f["status"]
        scored = status.isin(*SCORED_STATUSES)
        side = lambda name: F.get(F.filter(sides, lambda s: s["homeAway"] == name), F.lit(0))
        home, away = side("home"), side("away")
        bad_score = lambda s: s["score"].isNotNull() & (F.coalesce(expr.integer(s["score"]), F.lit(-1)).between(0, 2**31 - 1) == F.lit(False))
        kept = F.when(league == "NFL", F.when(f["has_week"], f["week"]))
        identity = empty(f["id"]) | (f["n"] != 1) | (F.coalesce(f["season"], F.lit(0)) <= 0) | (F.coalesce(f["season_type"], F.lit(0)) <= 0)
        reason = (
            F.when(identity, "invalid_event")
            .when(f["skip"].isNotNull(), F.lit(None))
            .when(f["starts_at"].isNull(), "bad_start").when(status.isNull(), "unsupported_status")
            .when(kept <= 0, "bad_week").when(F.size(sides) != 2, "competitor_count")
            .when(F.exists(sides, lambda s: empty(s["team"]["id"])), "missing_team")
            .when(scored & F.exists(sides, bad_score), "bad_score")
            .when((status == "final") & F.exists(sides, lambda s: s["score"].isNull()), "final_score_missing")
            .when(home.isNull() | away.isNull(), "home_away")
            .when(home["team"]["id"] == away["team"]["id"], "same_team"))
        points = lambda s: F.when(scored, expr.integer(s["score"])).try_cast("int")
        return F.struct(
            f["id"].alias("game_id"), f["season"].alias("season"), f["season_type"].alias("season_type"),
            f["starts_at"].alias("starts_at"), status.alias("status"), kept.alias("week"),
            home["team"]["id"].alias("home"), away["team"]["id"].alias("away"),
            points(home).alias("home_score"), points(away).alias("away_score"),
            F.when(~identity, f["skip"]).alias("skip"), reason.alias("reason"))
    return verdict


def judged(raw: DataFrame) -> DataFrame:
    """Responses with typed events and the list of reasons that reject them (empty = accepted)."""
    league = F.col("league")
    events = F.coalesce("doc.events", F.array())
    ids = F.col("events.game_id")
    whole = (
        F.when(F.col("doc").isNull(), "bad_json")
        .when(~F.coalesce(F.exists("doc.leagues", lambda x: x["abbreviation"] == league), F.lit(False)), "league_not_identified")
        .when(F.col("doc.events").isNull(), "events_missing")
        .when(F.size("doc.events") >= MAX_EVENTS, "too_many_events")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate_event"))
    return (
        with_document(raw, SCHEMA)
        .withColumn("facts", F.transform(events, _facts))
        .withColumn("events", F.transform("facts", _verdict(league)))
        .withColumn("reasons", F.when(whole.isNotNull(), F.array(whole)).otherwise(
            F.array_distinct(F.filter(F.col("events.reason"), lambda r: r.isNotNull()))))
        .select(*ID, "events", "reasons")
    )


def scoreboard_decode(raw: DataFrame) -> DataFrame:
    """Games of the accepted responses."""
    return (
        judged(raw).select(*ID, F.inline_outer(accepted(F.col("events")))).where("game_id is not null and skip is null")
        .select("league", "game_id", "season", "season_type", "starts_at", "status", "week", "home", "away",
                "home_score", "away_score", "observed_at", "import_date", "response_id")
    )


def scoreboard_rejects(raw: DataFrame) -> DataFrame:
    return rejects(judged(raw))


def rejects(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("response_id", "league", F.explode_outer("reasons").alias("reason")).where("reason is not null")


def exhibition_skips(raw: DataFrame) -> DataFrame:
    """Events left out as exhibitions, with the reason; identity checks come first."""
    return skips(judged(raw))


def skips(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("response_id", "league", F.inline_outer("events")).where("skip is not null").select(
        "response_id", "league", "game_id", F.col("skip").alias("reason"))


def manifest_responses(raw: DataFrame) -> DataFrame:
    """One manifest row per accepted response; the id list is the response's own bounded array."""
    ids = F.transform(F.filter("events", lambda e: e["skip"].isNull()), lambda e: e["game_id"])
    row = F.array(F.struct(F.sort_array(ids).alias("ids")))
    return judged(raw).select(*ID, F.inline_outer(accepted(row))).where("ids is not null")


def games_in_range(daily: DataFrame, first: date, last: date) -> DataFrame:
    """Games of the daily responses between two dates, 1 to 31 days apart inclusive."""
    if not 0 <= (last - first).days <= 30:
        raise ValueError("a range spans 1 to 31 dates")
    return range_dedup(daily.where(F.col("import_date").between(first, last)), ["league", "game_id"])


def range_dedup(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Union of daily responses: the last occurrence of an id wins and keeps the first one's place."""
    rest = [c for c in daily.columns if c not in keys]
    order = F.struct("import_date", "seq")
    return daily.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), order).alias("row"), F.min(order).alias("position")
    ).select(*keys, "row.*", "position")
