"""Loads every family of registered queries."""

from matchday.plans import views  # noqa: F401
from matchday.plans import feature_plans, completeness_plans, player_plans, audit_plans, upsert_plans, export_rule_plans, browse_plans, split_plans, model_plans, raw_plans, publish_plans, forecast_plans, stream_plans, sink_plans  # noqa: F401
from matchday.plans.registry import QUERIES, SQL, runnable, with_views


def all_queries():
    return {name: runnable(fn) for name, fn in QUERIES.items()}


def all_sql():
    return {name: with_views(sql) for name, sql in SQL.items()}
