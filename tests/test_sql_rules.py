"""The reference SQL states the same rule as the query, also on rows that only large tables hold."""

from datetime import datetime

import duckdb
import pyarrow as pa

import __spark_entry__  # noqa: F401
from conftest import season_rows
from matchday.plans import registry
from matchday.sources import raw_fixtures, scoreboard


def stored(monkeypatch, columns, rows):
    """DuckDB with `games` read from these rows."""
    con = duckdb.connect()
    table = pa.Table.from_pylist([dict(zip(columns, r)) for r in rows])
    con.register("given_games", table)
    monkeypatch.setitem(registry.VIEWS, "games", "SELECT * FROM given_games")
    return con


def test_scores_that_are_no_numbers_cannot_be_spoiled(spark, games, monkeypatch):
    """A response whose only event has neither a numeric home nor a numeric away score stays valid JSON."""
    n = next(n for n in range(107 * 127, 10**9, 107 * 127) if n // 10 % 29 == 0 and n % 12 and n % 15 != 5
             and all(n // 10 % p for p in (11, 13, 17, 19, 23)) and all(n % p for p in (151, 101, 103, 139, 131, 137)))
    row = ["NBA", 2026, 2, str(n), datetime(2025, 9, 1), "1", "2", "final", 90, 91, 3]
    df = games([row])
    con = stored(monkeypatch, df.columns, [row])
    want = con.execute(registry.with_views(registry.SQL["scoreboard_rejects"])).fetchall()
    got = [(r.response_id, r.league, r.reason) for r in scoreboard.scoreboard_rejects(raw_fixtures.scoreboards(df)).collect()]
    assert got == want == [(f"NBA-{n // 10}", "NBA", "competitor_count")]


def test_history_sql_counts_all_earlier_days(spark, games, monkeypatch):
    rows = [[*r[:3], f"{r[3]}-{i}", *r[4:]] for r in season_rows(60) for i in range(60)]
    con = stored(monkeypatch, games([rows[0]]).columns, rows)
    found = con.execute(registry.with_views("SELECT team, date, n FROM state ORDER BY team, date")).fetchall()
    assert [n for team, _, n in found if team == "a"] == [60 * day for day in range(60)]
    assert "RANGE" not in registry.VIEWS["side_history"]


def test_page_past_end_reads_the_stated_page():
    assert "OFFSET 1000000" in registry.SQL["page_past_end"]
