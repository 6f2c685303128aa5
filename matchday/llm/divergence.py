"""How far the sources of a language are from each other and from the language, by their smoothed term shares.

A group is a (lang, source); its vector holds one share per kept term of its language.  Shares are whole numbers (parts of
a thousand million, rounded down), so every sum is exact.

1. Terms are counted in the tasks, merged per (lang, source, term) with map-side combining, and kept where enough documents
   of the language have them.  A group or term of any size is only ever summed.
2. Gustavson row accumulation: the counts of a language are dealt into blocks of terms.  A task holds a block as a
   term-major index (the groups of each term, with their shares) and takes its groups one by one: a group's terms are
   scattered through the index into a dense accumulator with one cell per peer.  No pair of postings becomes a row; a block
   gives one row per group and peer.
3. Zero baselines: a term that one group has and its peer has not counts with the peer's share at count zero.  The accumulator
   starts with the distance of the group's terms from each peer's zero share (one sorted prefix sum answers it for all
   peers), and a posting that is met replaces that part.  Terms that neither has are added once, V times the distance of
   both zero shares.

A task holds at most about BLOCK counts of one language and gives at most ROWS groups' accumulators; the result itself has the
square of a language's sources.

Defined cases: null texts, languages and sources are ''; a group without kept terms is a peer with count zero everywhere; a
language without kept terms has distance 0 and no term rows; repeated rows count as often as they stand; ties in value are
ranked by item in UTF-8 order; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchday.llm.common import LOWER, UPPER, pick, table, written

MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
BLOCK, ROWS, CHUNK, FLUSH = 1 << 16, 1024, 1 << 20, 500_000
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).translate(
    bytes.maketrans(UPPER.encode(), LOWER.encode()))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); one row with a null term per group."""

    def rows(counts, having, groups):
        at = [g for g, own in counts.items() for _ in range(len(own))] + list(groups)
        spare = [0] * len(groups)
        return pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g in at], pa.string()), pa.array([g[1] for g in at], pa.string()),
             pa.array([*chain.from_iterable(counts.values()), *[None] * len(groups)], pa.binary()),
             pa.array([*chain.from_iterable(own.values() for own in counts.values()), *spare], pa.int64()),
             pa.array([*chain.from_iterable(map(having[g].__getitem__, own) for g, own in counts.items()), *spare], pa.int64())],
            ["lang", "source", "term", "n", "docs"])

    def per_batch(batches):
        counts, having, groups, held = defaultdict(Counter), defaultdict(Counter), set(), 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                groups.add((lang, source))
                own, docs_of = counts[lang, source], having[lang, source]
                before, terms = len(own), text.as_py().translate(LETTERS).split()
                own.update(terms)
                docs_of.update(set(terms))
                held += len(own) - before
                if held > FLUSH:
                    yield rows(counts, having, groups)
                    counts, having, groups, held = defaultdict(Counter), defaultdict(Counter), set(), 0
        yield rows(counts, having, groups)

    found = docs.mapInArrow(per_batch, "lang string, source string, term binary, n bigint, docs bigint")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str) -> str:
    """p of a count in a vector with this total over V terms; null where the language keeps none."""
    return (f"CASE WHEN v > 0 THEN 1 + ({SCALE} * CAST({count} + {SMOOTH} AS DECIMAL(27, 0))) "
            f"div CAST({total} + {SMOOTH} * v AS DECIMAL(38, 0)) END")


def scatter(counts: pa.Table, peers: pa.Table) -> pa.Table:
    """One block of a language: the accumulators of the groups of this part, as (lang, a, b, value) with a < b."""
    peers = peers.sort_by("at")
    zero = peers["zero"].fill_null(0).to_numpy()
    size, (lang, block, part, parts, v) = len(zero), [peers[c][0].as_py() for c in ("lang", "block", "part", "parts", "v")]
    owner, share_of = counts["at"].to_numpy(), counts["p"].to_numpy()
    term = counts["term"].combine_chunks().dictionary_encode().indices.to_numpy() if len(owner) else np.zeros(0, np.int64)
    by_term = np.lexsort((owner, term))
    post_owner, post_share = owner[by_term], share_of[by_term]
    starts = np.searchsorted(term[by_term], np.arange(len(np.unique(term)) + 1))
    by_owner = np.argsort(owner, kind="stable")
    edges = np.searchsorted(owner[by_owner], np.arange(size + 1))
    left, right, values = [], [], []
    for g in range(part, size, parts):
        mine = by_owner[edges[g]:edges[g + 1]]
        if not len(mine) and block:
            continue
        terms, own = term[mine], share_of[mine]
        ordered = np.sort(own)
        sums = np.concatenate([[0], np.cumsum(ordered)])
        below = np.searchsorted(ordered, zero)
        acc = zero * (2 * below - len(own)) + sums[-1] - 2 * sums[below] - len(own) * np.abs(zero - zero[g])
        if not block:
            acc[g + 1:] += v * np.abs(zero[g + 1:] - zero[g])
        lengths = starts[terms + 1] - starts[terms]
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // CHUNK)) + 1
        for some in np.split(np.arange(len(terms)), cuts):
            n = lengths[some]
            at = np.repeat(starts[terms[some]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            peer, theirs, ours = post_owner[at], post_share[at], np.repeat(own[some], n)
            later = peer > g
            peer, theirs, ours = peer[later], theirs[later], ours[later]
            np.add.at(acc, peer, np.abs(ours - theirs) - np.abs(ours - zero[peer]) - np.abs(zero[g] - theirs)
                      + np.abs(zero[g] - zero[peer]))
        others = np.delete(np.arange(size), g)
        left.append(np.minimum(others, g))
        right.append(np.maximum(others, g))
        values.append(acc[others])
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, values)]
    return pa.table({"lang": pa.array([lang] * len(joined[0]), pa.string()),
                     **{n: pa.array(x.astype(np.int64)) for n, x in zip(("a", "b", "value"), joined)}})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """lang, source, part, item, value and rank: the distances to the other sources and the most over-used terms."""
    texts = pick(docs, "lang", "source", "text").selectExpr(
        "coalesce(lang, '') AS lang", "coalesce(source, '') AS source", "CAST(coalesce(text, '') AS BINARY) AS text")
    terms = written(term_counts(texts), "terms")
    kept = written(terms.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"))
                   .where(F.col("docs") >= min_docs).drop("docs"), "kept")
    counts = written(terms.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all"), "counts")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("entries"))
    groups = (terms.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left")
              .join(langs, "lang", "left").na.fill(0, ["total", "entries", "v", "lang_total"]))
    per_lang = Window.partitionBy("lang")
    groups = written(groups.select(
        "lang", "source", "total", "v", "lang_total", F.expr(share("0", "total")).alias("zero"),
        (F.row_number().over(per_lang.orderBy("source")) - 1).alias("at"),
        F.expr(f"CAST(sum(entries) OVER (PARTITION BY lang) div {block} + 1 AS INT)").alias("blocks"),
        F.expr(f"CAST((count(*) OVER (PARTITION BY lang) - 1) div {rows} + 1 AS INT)").alias("parts")), "groups")
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", F.expr(share("n", "total")))

    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = (shares.withColumn("q", F.expr(share("all", "lang_total"))).where("p > q")
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
            .withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top))

    # every part of a block's groups sees the whole block; parts is 1 up to ROWS sources a language
    spread = F.explode(F.expr("sequence(0, parts - 1)")).alias("part")
    left = shares.select("lang", F.expr("CAST(pmod(xxhash64(term), blocks) AS INT)").alias("block"), spread, "at", "term", "p").toDF(
        "lang", "block", "part", "at", "term", "p")
    right = (groups.select("lang", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "parts", "at", "zero", "v")
             .select("lang", "block", spread, "parts", "at", "zero", "v").toDF("lang", "block", "part", "parts", "at", "zero", "v"))
    keys = ["lang", "block", "part"]
    pairs = (left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scatter, "lang string, a bigint, b bigint, value bigint")
             .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = pairs.select("lang", "value", F.explode(F.expr("array(struct(a AS at, b AS peer), struct(b AS at, a AS peer))")).alias("x"))
    named = groups.select("lang", "at", "source")
    far = (both.select("lang", "value", "x.at", "x.peer").join(named, ["lang", "at"])
           .join(named.select("lang", F.col("at").alias("peer"), F.col("source").alias("item")), ["lang", "peer"])
           .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
           .withColumn("rank", F.row_number().over(by_rank)))
    return far.unionByName(over)


def op13_source_divergence(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
found AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (
  SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(l.total, 0) AS lang_total,
         coalesce((SELECT sum(n) FROM own o WHERE o.lang = g.lang AND o.source = g.source), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l USING (lang)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 5)) // (g.total + 5 * g.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (g.lang_total + 5 * g.v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
