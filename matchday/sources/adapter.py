"""Maps the star-schema test tables to the competition domain.

One lazily built DataFrame per view.  Nothing is cached or collected here: a query pays only for the
views it uses, and Catalyst prunes their columns down to the Parquet scans.
"""

from __future__ import annotations

from functools import cached_property
from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchday.functions.domain import KEY
from matchday.operators import features
from matchday.operators.completeness import GAME
from matchday.session import configure, materialize
from matchday.sources.fixtures import FIXTURES

ZERO_LINE = (
    '{"minutes":"--","fouls":"0","blocks":"0","points":"0","steals":"0","assists":"0","rebounds":"0",'
    '"plusMinus":"0","turnovers":"0","defensiveRebounds":"0","offensiveRebounds":"0",'
    '"fieldGoalsMade-fieldGoalsAttempted":"0-0","freeThrowsMade-freeThrowsAttempted":"0-0",'
    '"threePointFieldGoalsMade-threePointFieldGoalsAttempted":"0-0"}'
)

SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir
        self._views: dict[str, DataFrame] = {}
        self.shared: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        """A view by name: a property of this class, or one of the shared SQL fixtures."""
        if name not in self._views:
            if name in FIXTURES:
                text = FIXTURES[name]
                used = {f for _, f, _, _ in Formatter().parse(text) if f}
                self._views[name] = self.spark.sql(text, **{u: self[u] for u in used})
            elif isinstance(getattr(type(self), name, None), cached_property):
                self._views[name] = getattr(self, name)
            else:
                self._views[name] = self.raw(name)
        return self._views[name]

    def share(self, name: str, df: DataFrame | None = None) -> DataFrame:
        """Write a view that a plan uses several times once, and read it back from then on."""
        if name not in self.shared:
            self._views[name] = self.shared[name] = materialize(self[name] if df is None else df, name)
        return self.shared[name]

    def raw(self, name: str) -> DataFrame:
        """A driver table.  The declared schema saves the footer-reading job of schema inference."""
        reader = self.spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else self.spark.read
        return reader.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- dimensions ------------------------------------------------------------------------
    @cached_property
    def teams(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").cast("string").alias("team_id"), F.col("n_name").alias("name"))

    @cached_property
    def teams_by_league(self) -> DataFrame:
        """Every team in both leagues: ids are unique within a league only."""
        return self["teams"].select(F.explode(F.array(F.lit("NBA"), F.lit("NFL"))).alias("league"), "team_id", "name")

    # --- games -----------------------------------------------------------------------------
    @cached_property
    def games(self) -> DataFrame:
        first_supplier = self.raw("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s_suppkey"))
        score = "CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(floor({}) AS BIGINT) % 41 + 80 AS INT) END AS {}"
        return (
            self.raw("orders").withColumnRenamed("o_custkey", "c_custkey").join(self.raw("customer"), "c_custkey")
            .withColumnRenamed("o_orderkey", "l_orderkey").join(first_supplier, "l_orderkey")
            .join(self.raw("supplier"), "s_suppkey")
            .where("c_nationkey <> s_nationkey")
            .selectExpr(
                "CAST(l_orderkey AS STRING) AS game_id",
                "CASE WHEN year(o_orderdate) % 2 = 0 THEN 'NFL' ELSE 'NBA' END AS league",
                "year(o_orderdate) AS season", "2 AS season_type", "o_orderdate AS starts_at",
                "CAST(c_nationkey AS STRING) AS home", "CAST(s_nationkey AS STRING) AS away",
                "CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'scheduled' ELSE 'postponed' END AS status",
                score.format("o_totalprice", "home_score"), score.format("o_totalprice / 41", "away_score"),
                "CAST(floor((dayofyear(o_orderdate) - 1) / 7) AS INT) + 1 AS week")
        )

    # --- player lines ----------------------------------------------------------------------
    @cached_property
    def line_items(self) -> DataFrame:
        """One row per (game, part, category) of final games, with the values lines are made of."""
        # dealt by game before the grouping, so that neither it nor the joins need another shuffle; keys stay numbers until then
        kind = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
        item = self.raw("lineitem").select(
            "l_orderkey", "l_partkey", kind.alias("kind"), "l_linenumber", "l_quantity", "l_discount").repartition("l_orderkey")
        finals = self["games"].where(F.col("status") == "final").select(
            F.col("game_id").cast("bigint").alias("l_orderkey"), "game_id", *KEY, "home", "away")
        if "games" in self.shared:  # written games cost little to read again, and two thirds of the items need no grouping
            item = item.join(finals.select("l_orderkey").hint("shuffle_hash"), "l_orderkey", "left_semi")
        item = item.groupBy("l_orderkey", "l_partkey", "kind").agg(
            F.min("l_linenumber").alias("line"), F.min("l_quantity").cast("int").alias("quantity"), F.min("l_discount").alias("discount"))
        return item.join(finals, "l_orderkey").select(
            "game_id", *KEY, "home", "away", F.col("l_partkey").alias("part"),
            F.when(F.col("kind") == 0, "general").when(F.col("kind") == 1, "passing").otherwise("defensive").alias("category"),
            "line", "quantity",
            (F.col("discount") == 0).alias("did_not_play"),
            F.when(F.col("l_partkey") % 2 == 0, F.col("home")).otherwise(F.col("away")).alias("team_id"),
            F.when(F.col("line") != 7, F.col("line") <= 3).alias("starter"))

    @cached_property
    def lines(self) -> DataFrame:
        line, quantity = F.col("line").cast("string"), F.col("quantity").cast("string")
        general = F.concat(
            F.lit('{"points":"'), quantity,
            F.lit('","assists":"'), F.when(F.col("line") == 5, "--").otherwise(line),
            F.lit('","fieldGoalsMade-fieldGoalsAttempted":"'), line, F.lit("-"),
            (F.col("line") + F.col("quantity")).cast("string"), F.lit('","QBRating":"99.3"}'))
        passing = F.concat(
            F.lit('{"passingYards":"'), quantity,
            F.lit('","completions/passingAttempts":"1/2","adjQBR":"--"}'))
        return self["line_items"].select(
            "game_id", *KEY, F.col("part").cast("string").alias("player_id"), "team_id", "category", "did_not_play",
            "starter",
            F.when((F.col("line") == 6) & (F.col("category") == "general"), ZERO_LINE)
            .when((F.col("line") == 4) & (F.col("category") == "passing"), passing)
            .otherwise(general).alias("stats_json"))

    @cached_property
    def examples(self) -> DataFrame:
        return features.examples(self["games"])

    # --- observations over time ------------------------------------------------------------
    @cached_property
    def snapshots(self) -> DataFrame:
        scored = F.col("event_type").isin("view", "purchase")
        return self.raw("events").select(*self.snapshot_columns(scored))

    @staticmethod
    def snapshot_columns(scored):
        kind = F.col("event_type")
        return [
            F.col("user_id").cast("string").alias("game_id"), F.col("ts").alias("observed_at"),
            F.col("event_id").alias("seq"),
            F.when(kind == "signup", "scheduled").when(kind == "view", "in_progress")
            .when(kind == "purchase", "final").when(kind == "error", "postponed")
            .otherwise("delayed").alias("status"),
            F.when(scored, F.floor("value").cast("int")).alias("home_score"),
        ]

    @cached_property
    def manifests(self) -> DataFrame:
        return self["games"].select("league", F.to_date("starts_at").alias("import_date"), "game_id")

    @cached_property
    def manifest_dates(self) -> DataFrame:
        return self["manifests"].select("league", "import_date").distinct()

    @cached_property
    def replacements(self) -> DataFrame:
        """For each listed postponed game the smallest id among later finals of the same pairing.

        A suffix minimum over one row per distinct start time, so no pair of games is ever built.
        """
        pairing = [*KEY[:2], "home", "away"]
        slots = self["games"].groupBy(*pairing, "starts_at").agg(
            F.min(F.when(F.col("status") == "final", F.col("game_id"))).alias("first_final"))
        later = W.partitionBy(*pairing).orderBy("starts_at").rowsBetween(1, W.unboundedFollowing)
        best = slots.withColumn("final_id", F.min("first_final").over(later)).where("final_id is not null")
        postponed = self["games"].where((F.col("status") == "postponed") & (F.col("game_id").cast("bigint") % 3 != 0))
        return postponed.join(best, [*pairing, "starts_at"]).select(
            "league", "season", F.col("game_id").alias("postponed_id"), "final_id")

    @cached_property
    def player_imports(self) -> DataFrame:
        """Box-score manifests; every tenth game's count is wrong so that incompleteness occurs."""
        # counted and joined by the key of completeness.complete_games, which can then use the same counts and join order
        counts = self["lines"].groupBy(*GAME).agg(F.count("*").alias("stored_lines"))
        off = F.when(F.col("game_id").cast("bigint") % 10 == 0, 1).otherwise(0)
        return self["games"].where(F.col("status") == "final").join(counts, GAME).select(  # only these have lines
            "league", "game_id", "season", "season_type", "home", "away",
            (F.col("stored_lines").cast("int") + off).alias("line_count"))

    @cached_property
    def scopes(self) -> DataFrame:
        """Audit scopes: every stored key with a calendar-year range (one without), plus empty keys."""
        stored = self["games"].select(*KEY).distinct()
        empty = stored.withColumn("season", F.col("season") + 100)
        year = F.col("season").cast("string")
        return stored.unionByName(empty).select(
            *KEY,
            F.when(F.col("season") != 1999, F.to_date(F.concat(year, F.lit("-01-01")))).alias("date_from"),
            F.when(F.col("season") != 1999, F.to_date(F.concat(year, F.lit("-12-31")))).alias("date_to"))
