"""Quality rules under weak supervision, as DataFrame operations only.

Each rule votes good (1), bad (-1) or abstains (0).  Expectation-maximisation over the counts of vote patterns (at most
3 ** rules rows, whatever the size of the corpus) estimates each rule's accuracy among good and among bad documents; a
document is kept if its posterior probability of being good is at least one half and no base rule failed.  A rule that
finds one kind of defect passes most bad documents, so the two accuracies are estimated apart.  Both are free between 0.01
and 0.99 but for one constraint: a bad vote is at least as likely from a bad document as from a good one.
`symbols` and `noise` are two thresholds of one count and both speak.

Repeated eight-word windows are found inside the row by sorting window hashes with their positions, in n log n, so
neither a shuffle nor a long text costs more than its length.

Defined cases: a null or wordless text has no words and fails the base rules; repeated rows get equal results; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchday.llm.common import LOWER, SPACES, UPPER, pick, table, words, written

# name -> SQL of the vote over the features below
RULES = {
    "word_length": "CASE WHEN n_words = 0 THEN 0 WHEN word_chars BETWEEN 2.5 * n_words AND 12 * n_words THEN 1 ELSE -1 END",
    "symbols": "CASE WHEN n_words = 0 THEN 0 WHEN n_symbols > 0.1 * n_words THEN -1 WHEN n_symbols <= 0.02 * n_words THEN 1 ELSE 0 END",
    "noise": "CASE WHEN n_words = 0 THEN 0 WHEN n_symbols > 0.3 * n_words THEN -1 WHEN n_symbols <= 0.05 * n_words THEN 1 ELSE 0 END",
    "lines": "CASE WHEN n_dup_lines > 0.5 * n_lines THEN -1 WHEN n_lines >= 3 AND n_dup_lines = 0 THEN 1 ELSE 0 END",
    "windows": "CASE WHEN n_words < 8 THEN 0 WHEN n_repeat_words > 0.25 * n_words THEN -1 WHEN n_repeat_words <= 0.02 * n_words THEN 1 ELSE 0 END",
    "length": "CASE WHEN n_words < 20 THEN -1 WHEN n_words >= 50 THEN 1 ELSE 0 END",
    "capitals": "CASE WHEN n_upper + n_lower = 0 THEN 0 WHEN n_upper > 0.5 * (n_upper + n_lower) THEN -1 WHEN n_upper < 0.2 * (n_upper + n_lower) THEN 1 ELSE 0 END",
    "shouting": "CASE WHEN n_words = 0 THEN 0 WHEN n_marks > 0.2 * n_words THEN -1 WHEN n_marks <= 0.05 * n_words THEN 1 ELSE 0 END",
}
ROUNDS, STEP = 100, 1e-4  # the rounds end when no estimate moves by more than STEP
GOOD_START, BAD_START, PRIOR_START = 0.9, 0.3, 0.7  # P(good vote | good document), P(bad vote | bad one), P(good document)
ACCURACY_RANGE, PRIOR_RANGE = (0.01, 0.99), (0.05, 0.95)
SMOOTH = 2  # votes at the starting values that are added to each count

# Positions of windows whose hash occurs twice, then the words those windows cover.  `s` is bound by the outer transform,
# so the sorted array is made once and not again for each element.
REPEATED = """
CASE WHEN size(hashes) = size(array_distinct(hashes)) THEN 0 ELSE aggregate(
  transform(array(sort_array(transform(hashes, (h, i) -> struct(h AS h, i AS i)))),
    s -> sort_array(transform(filter(s, (x, k) -> get(s, k - 1).h = x.h OR get(s, k + 1).h = x.h), x -> x.i)))[0],
  struct(-8 AS last, 0 AS n), (a, p) -> struct(p AS last, a.n + least(8, p - a.last) AS n), a -> a.n) END
"""


def features(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    split = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", words(text).alias("words"), lines.alias("lines"))
    hashed = split.select(
        "doc_id", "text", "lines", F.size("words").alias("n_words"),
        F.expr("CASE WHEN size(words) < 8 THEN CAST(array() AS ARRAY<BIGINT>) "
               "ELSE transform(sequence(1, size(words) - 7), i -> xxhash64(slice(words, i, 8))) END").alias("hashes"))
    return hashed.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(REPEATED).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), without(UPPER).alias("n_upper"), without(LOWER).alias("n_lower"),
        without("!?").alias("n_marks"))


Accuracies = dict[str, tuple[float, float]]


def posterior(accuracy: Accuracies, prior: float):
    """Probability of a good document given its votes, as a column."""
    score = F.lit(math.log(prior / (1 - prior)))
    for name, (good, bad) in accuracy.items():
        score = score + (F.when(F.col(name) == 1, math.log(good / (1 - bad)))
                         .when(F.col(name) == -1, math.log((1 - good) / bad)).otherwise(0.0))
    return 1 / (1 + F.exp(-score))


def fit(votes: DataFrame) -> tuple[Accuracies, float]:
    """Accuracies and prior by expectation-maximisation; one small aggregation a round, four sums a rule."""
    patterns = written(votes.groupBy(*RULES).agg(F.count("*").alias("n")), "patterns").coalesce(1)
    accuracy, prior = dict.fromkeys(RULES, (GOOD_START, BAD_START)), PRIOR_START
    within = lambda right, total, start, limits: min(max((right + SMOOTH * start) / (total + SMOOTH), limits[0]), limits[1])
    for _ in range(ROUNDS):
        shares = patterns.withColumn("g", posterior(accuracy, prior) * F.col("n")).withColumn("b", F.col("n") - F.col("g"))
        over = lambda vote, weight: F.coalesce(F.sum(F.when(vote, F.col(weight))), F.lit(0.0))
        sums = shares.agg(F.sum("n").alias("n"), F.sum("g").alias("g"), *[
            over(vote, weight).alias(f"{r}_{kind}_{weight}") for r in RULES for weight, right in (("g", 1), ("b", -1))
            for kind, vote in (("right", F.col(r) == right), ("cast", F.col(r) != 0))]).first()
        if not sums["n"]:
            break
        new = {}
        for r in RULES:
            good = within(sums[f"{r}_right_g"], sums[f"{r}_cast_g"], GOOD_START, ACCURACY_RANGE)
            bad = within(sums[f"{r}_right_b"], sums[f"{r}_cast_b"], BAD_START, ACCURACY_RANGE)
            new[r] = good, max(bad, 1 - good)  # a bad vote never speaks for a document: the classes keep their names
        share = within(sums["g"], sums["n"], PRIOR_START, PRIOR_RANGE)
        change = max(abs(share - prior), *(abs(x - y) for r in RULES for x, y in zip(new[r], accuracy[r])))
        accuracy, prior = new, share
        if change < STEP:
            break
    return accuracy, prior


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, the votes and the posterior probability `quality`, per document."""
    counts = written(features(docs), "counts")
    votes = counts.withColumns({name: F.expr(sql) for name, sql in RULES.items()})
    accuracy, prior = fit(votes)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    quality = posterior(accuracy, prior)
    return votes.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (quality >= 0.5)).alias("kept"), quality.alias("quality"), *RULES)


def op4_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents")).drop(*RULES)
