import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from matchday.session import build_session, configure  # noqa: E402

GAMES = ("league string, season int, season_type int, game_id string, starts_at timestamp_ntz, home string, away string, "
         "status string, home_score int, away_score int, week int")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "2", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


def season_rows(n=40):
    """One game a day between the same two teams; the home side alternates 20, 25 and 30 against 24."""
    start = datetime(2025, 9, 1, 18)
    return [["NBA", 2026, 2, f"g{i:02d}", start + timedelta(days=i), "a", "b", "final", 20 + (i % 3) * 5, 24, i // 7 + 1]
            for i in range(n)]


@pytest.fixture
def games(spark):
    return lambda rows: spark.createDataFrame([tuple(r) for r in rows], GAMES)


def as_dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]
