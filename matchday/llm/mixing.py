"""Mixing sources to target weights by capped water-filling, as DataFrame operations only.

1. Sizes (words) are counted once per document and written as a narrow table; every later step reads that.
2. Sources are ranked in code-point order by a range partitioning and per-partition offsets, never by one task.
3. The water level is found by rounds of one small aggregation: sources above their cap are clamped and their excess is
   shared anew among the others by weight, until none is above.
4. A source's target becomes whole repetitions of all its documents and a remainder.  The remainder is a seeded sample:
   documents are dealt by an MD5 digest into 2**24 cells of the source, the cells below a boundary are taken whole, and
   the documents of the boundary cell share what is still missing.  The boundary is found by two aggregations of at most
   4,096 rows a source, so a source with a third of all rows is never gathered in one task.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null doc_id is sampled by
its text; equal rows share a cell and are taken alike; an empty table gives an empty result; a source without words has
target 0.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchday.llm.common import WORD, pick, table, written

LEVEL_BITS = 12


def source_key(source):
    """'1...' for named sources and '2' for null: null sorts last and joins as any other key."""
    return F.when(source.isNull(), "2").otherwise(F.concat(F.lit("1"), source))


def cell_of(doc_id, text, seed: int):
    ident = F.coalesce(doc_id.cast("string"), F.md5(text.cast("binary")), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), ident)), 1, 6), 16, 10).cast("int")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    cell = cell_of(F.col("doc_id"), F.col("text"), seed)
    return pick(docs, "doc_id", "text", "source").select(
        "doc_id",
        source_key(F.col("source")).alias("k"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), cell.alias("cell"))


def weighted(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """One row per source: size, and the weight that falls to its rank in code-point order."""
    ranged = (sizes.groupBy("k").agg(F.sum("size").alias("source_size"))
              .repartitionByRange("k").withColumn("part", F.spark_partition_id()))
    ranged = written(ranged, "sources")  # the partition ids below must be those of one evaluation
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy("k")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights)).cast("int") + 1)
    return ranged.join(before, "part").select("k", "source_size", weight.cast("long").alias("weight"))


def water_level(sources: DataFrame, share: float, epochs: int) -> float:
    """The level at which least(weight * level, cap) adds up to the budget.

    Each round clamps the sources above their cap and shares the rest anew; rounds end when no further source is clamped.
    """
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return 0.0
    budget, level, clamped = share * total, share * total / weight, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("source_size") * epochs
        n, caps, free = sources.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("source_size") * epochs)), F.lit(0)),
            F.sum(F.when(~above, F.col("weight")))).first()
        if n == clamped or not free:
            return level
        clamped, level = n, (budget - caps) / free


def boundaries(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per source the cell in which the running sum of sizes reaches the remainder."""
    high = F.shiftright("cell", LEVEL_BITS)
    running = F.sum("n").over(W.partitionBy("k").orderBy("at")) - F.col("n")

    def reached(cells: DataFrame, rest: DataFrame) -> DataFrame:
        sums = cells.where("n > 0").withColumn("before", running)
        return sums.join(rest, "k").where("before <= rest AND rest < before + n")

    coarse = sizes.groupBy("k", high.alias("at")).agg(F.sum("size").alias("n"))
    first = reached(coarse, wanted.select("k", "rest")).select(
        "k", F.col("at").alias("high"), (F.col("rest") - F.col("before")).alias("rest"))
    fine = (sizes.withColumn("high", high).join(first.select("k", "high"), ["k", "high"])
            .groupBy("k", F.col("cell").alias("at")).agg(F.sum("size").alias("n")))
    return reached(fine, first.select("k", "rest")).select(
        "k", F.col("at").alias("edge"), (F.col("rest") - F.col("before")).alias("need"), F.col("n").alias("edge_size"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Sizes per document, and per source its target, whole repetitions and the boundary of the sampled remainder."""
    sizes = written(sized(docs, seed), "sizes")
    sources = written(weighted(sizes, weights), "weighted")
    level = water_level(sources, share, max_epochs)
    target = F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(float(max_epochs)))
    want = F.floor(target + 0.5).cast("long")
    wanted = (sources.withColumn("target", target).withColumn("want", want)
              .withColumn("whole", F.expr("CASE WHEN source_size = 0 THEN 0 ELSE want div source_size END"))
              .withColumn("rest", F.expr("want - whole * source_size")))
    return sizes, written(wanted.join(boundaries(sizes, wanted), "k", "left"), "plan")


REPEATS = "whole + CASE WHEN cell < edge OR (cell = edge AND 2 * need >= edge_size) THEN 1 ELSE 0 END"


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2,
        seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target (its source's), taken (words) and repeats (whole documents), per document.

    `taken` meets each source's target to the word but for rounding in one cell; `repeats` rounds the boundary cell's
    documents to whole ones.
    """
    sizes, plan = mix_plan(docs, weights, share, max_epochs, seed)
    return sizes.join(plan, "k").select(
        "doc_id", "size", "source_size", "target",
        F.expr("size * whole + CASE WHEN cell < edge THEN size WHEN cell = edge THEN (size * need) div edge_size "
               "ELSE 0 END").alias("taken"), F.expr(REPEATS).alias("repeats"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2,
             seed: int = 17) -> DataFrame:
    """The rows of `docs`, with all their columns, each as often as the mix takes it: whole documents only."""
    _, plan = mix_plan(docs, weights, share, max_epochs, seed)
    at = {n: F.col(f"c{docs.columns.index(n)}") for n in ("doc_id", "text", "source")}
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    keyed = plain.withColumns({"k": source_key(at["source"]), "cell": cell_of(at["doc_id"], at["text"], seed)})
    times = keyed.join(plan, "k").withColumn("times", F.expr(REPEATS).cast("int")).where("times > 0")
    return times.select(*plain.columns, F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop(
        "copy").toDF(*docs.columns)


def op1_source_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '2' ELSE '1' || source END AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 6) AS BIGINT) AS cell
  FROM documents),
sources AS (
  SELECT k, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY k),
ordered AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS ratio,
         sum(2 * source_size) OVER w AS caps, sum(weight) OVER w AS used,
         lead(2.0::DOUBLE * source_size / weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, k) AS next_ratio
  FROM sources WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, k)),
totals AS (SELECT CAST(sum(source_size) AS DOUBLE) * 1.5 AS budget, sum(weight) AS weights FROM sources),
levels AS (
  SELECT budget / weights AS level FROM totals, (SELECT min(ratio) AS least FROM ordered) WHERE budget / weights <= least
  UNION ALL
  SELECT (budget - caps) / (weights - used) FROM ordered, totals WHERE weights > used
    AND (budget - caps) / (weights - used) > ratio AND (budget - caps) / (weights - used) <= next_ratio),
wanted AS (
  SELECT s.*, least(weight * level, 2.0::DOUBLE * source_size) AS target,
         CAST(floor(least(weight * level, 2.0::DOUBLE * source_size) + 0.5) AS BIGINT) AS want
  FROM sources s, (SELECT min(level) AS level FROM levels)),
parts AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE want // source_size END AS whole,
                 CASE WHEN source_size = 0 THEN 0 ELSE want % source_size END AS rest FROM wanted),
cells AS (SELECT k, cell, CAST(sum(size) AS BIGINT) AS n FROM sized GROUP BY k, cell HAVING sum(size) > 0),
running AS (SELECT *, CAST(sum(n) OVER (PARTITION BY k ORDER BY cell) AS BIGINT) - n AS before FROM cells),
edges AS (SELECT k, cell AS edge, n AS edge_size, rest - before AS need FROM running JOIN parts USING (k)
          WHERE before <= rest AND rest < before + n)
SELECT doc_id, size, source_size, target,
       CAST(size * whole + CASE WHEN cell < edge THEN size WHEN cell = edge THEN (size * need) // edge_size ELSE 0 END
            AS BIGINT) AS taken,
       CAST(whole + CASE WHEN cell < edge OR (cell = edge AND 2 * need >= edge_size) THEN 1 ELSE 0 END AS BIGINT) AS repeats
FROM sized JOIN parts USING (k) LEFT JOIN edges USING (k)
"""
