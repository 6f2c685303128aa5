"""Column expressions shared by the operators.  All are built-in functions; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchday.functions.domain import (
    ADDITIVE_KEYS, LOG_LOSS_EPSILON, MISSING_VALUES, PAIR_KEYS, UNCERTAIN_KEYS)

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
MINUTE_PRECISION = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2})(Z|[+-]\d{2}:\d{2})\z"
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"
INTEGER = r"^[+-]?\d{1,18}\z"
STRICT_JSON = {"allowSingleQuotes": "false"}


def blank(value: Column) -> Column:
    return value.isNull() | value.rlike(r"^\s*\z")


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def number(text: Column) -> Column:
    """Finite double, or null.  The guard keeps suffixed, padded and symbolic numbers out; what it lets
    through can only be infinite by overflow."""
    value = text.try_cast("double")
    return F.when(text.rlike(NUMBER) & (F.abs(value) < float("inf")), value)


def integer(text: Column) -> Column:
    return F.when(text.rlike(INTEGER), text.try_cast("bigint"))


def utc_time(text: Column) -> Column:
    """RFC 3339 or minute-precision time as a zone-less UTC timestamp, or null."""
    full = F.regexp_replace(text, MINUTE_PRECISION, "$1:00$2")
    return F.when(full.rlike(RFC3339), full.try_cast("timestamp")).cast("timestamp_ntz")


def game_status(name: Column, state: Column, completed: Column) -> Column:
    """Named interruptions first, then the provider's state; null rejects."""
    return (
        F.when(name == "STATUS_POSTPONED", "postponed")
        .when(name.isin("STATUS_CANCELED", "STATUS_CANCELLED"), "canceled")
        .when(name == "STATUS_SUSPENDED", "suspended")
        .when(name == "STATUS_DELAYED", "delayed")
        .when(completed & (state == "post"), "final")
        .when(state == "in", "in_progress")
        .when((name == "STATUS_SCHEDULED") & (state == "pre"), "scheduled")
    )


def stats_map(text: Column) -> Column:
    return F.from_json(text, "map<string,string>", STRICT_JSON)


def typed_stats(text: Column) -> Column:
    """Entries ``(key, kind, value)`` of a JSON object in key order; null if it is no object.

    One parse gives both the values and their JSON types, which a map of strings would hide.
    """
    parsed = F.when(text.rlike(r"\}\s*\z"), F.from_json(text, "map<string,variant>", STRICT_JSON))
    return F.sort_array(F.transform(F.map_entries(parsed), lambda e: F.struct(
        e["key"].alias("key"),
        F.schema_of_variant(e["value"]).alias("kind"),
        F.try_variant_get(e["value"], "$", "string").alias("value"))))


def strings_only(entries: Column, null_ok: bool) -> Column:
    kinds = ("STRING", "VOID") if null_ok else ("STRING",)
    return entries.isNotNull() & F.forall(entries, lambda e: e["kind"].isin(*kinds))


def participation(league: Column, category: Column, did_not_play: Column, starter: Column, stats: Column) -> Column:
    """``stats`` is the parsed string map.  Uncertain needs every listed zero and nothing else."""
    zeros = F.lit(True)
    for key in UNCERTAIN_KEYS:
        zeros = zeros & (F.coalesce(stats[key], F.lit("")) == ("0-0" if "-" in key else "0"))
    uncertain = (
        (league == "NBA") & (category == "general") & (F.coalesce(starter, F.lit(True)) == F.lit(False))
        & (F.coalesce(stats["minutes"], F.lit("")) == "--")
        & (F.size(stats) == len(UNCERTAIN_KEYS) + 1) & zeros
    )
    return F.when(did_not_play, "did_not_play").when(uncertain, "uncertain").otherwise("reported")


def missing_value(value: Column) -> Column:
    return blank(value) | value.isin(*MISSING_VALUES)


def additive_parts(key: Column, value: Column) -> Column:
    """``[text, text]`` of a made-attempted pair, ``[text]`` of a single statistic, else null."""
    slash = [k for k in PAIR_KEYS if "/" in k]
    dash = [k for k in PAIR_KEYS if "/" not in k]
    return (
        F.when(key.isin(*slash), F.split(value, "/")).when(key.isin(*dash), F.split(value, "-"))
        .when(key.isin(*ADDITIVE_KEYS), F.array(value))
    )


def pair_name(key: Column, position: int) -> Column:
    named = F.when(F.lit(False), F.lit(None).cast("string"))
    for raw, names in PAIR_KEYS.items():
        named = named.when(key == raw, names[position])
    return named.otherwise(key) if position == 0 else named


def sigmoid(z: Column) -> Column:
    """Stable for both signs."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def log_loss(target: Column, p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(LOG_LOSS_EPSILON)), F.lit(1 - LOG_LOSS_EPSILON))
    return F.when(target == 1, -F.log(clipped)).otherwise(-F.log(1 - clipped))
