"""Phrases whose words stand together more often than their parts suggest, per language, by the stripes pattern.

A stripe belongs to a prefix of one to four words and is an associative counter: next word -> how often it follows.  Merged
stripes give everything: an entry is the count of the phrase "prefix next"; the two parts of a cut are a word, or an entry of a
shorter prefix's stripe; the greatest entry of a phrase's own stripe, and of the stripes in which it is the end, say whether
it only occurs inside a longer phrase.

1. Words are counted (the stripe of the empty prefix, spread by word).
2. Stripes of one-word prefixes over frequent words.
3. Stripes of two-word prefixes, for runs in which each two neighbouring words are frequent together.
4. Stripes of prefixes of three and four words, for runs in which each three neighbouring words are.

Every part of a frequent phrase is frequent, so 2 to 4 lose no phrase.  What is frequent reaches the tasks as a bitmap of
hashes, whose size follows the count up to MAX_CELLS bits (16 MB): beyond that it lets more stripes pass, which the exact
counts then drop.  A task adds up the stripes of some FLUSH words before it emits them, in at most BUNDLES rows a language
and prefix length: a row has the stripes of all prefixes whose hash falls to its bundle.  A stripe of a heavy prefix is cut
by the next word's hash into slots of about 1/HEAVY of the language's words, at most HEAVY heavy prefixes a language, which
go to bundles of their own; so no bundle has much more than its share.  A reducer adds up a bundle's rows elementwise, MERGE
entries at a time.

Defined cases: null texts are empty, a null language is `und`; repeated rows count as often as they stand; ties are ranked by
count and then by phrase in UTF-8 order, cuts with equal scores by the shorter first part; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from itertools import count, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchday.llm.bitmaps import bitmap, cells_for, tester
from matchday.llm.common import LOWER, UPPER, pick, table, written

MIN_COUNT, LONGEST, TOP, PERCENT = 100, 5, 2000, 100
FLUSH, HEAVY, BUNDLES, MERGE = 1 << 22, 2000, 1 << 10, 1 << 20
MIN_CELLS, MAX_CELLS, CELLS_EACH = 1 << 20, 1 << 27, 64
ENDS = ".,;:!?\n\x0b\x0c\r"
LETTERS = bytes.maketrans((UPPER + ENDS + "\t").encode(), (LOWER + "\n" * len(ENDS) + " ").encode())
GAP, END = 0, 1  # local numbers of the empty word and of the end of a piece
STRIPE = "lang string, k int, bundle int, prefixes binary, widths array<int>, nexts binary, counts array<int>"


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\n" + word)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first * np.uint64(0x9E3779B97F4A7C15) ^ (second + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ mixed >> np.uint64(29)


def encoded(batches):
    """(lang, words, numbers) for some FLUSH words of a language: local word numbers, END after each piece."""
    ids, parts, held = {}, defaultdict(list), 0

    def out():
        for lang, arrays in parts.items():
            numbers = np.concatenate([*arrays, np.full(LONGEST + 1, END, np.int32)])
            yield lang, list(ids[lang]), numbers
        ids.clear(), parts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if lang not in ids:
                ids[lang] = defaultdict(count().__next__, {})
                ids[lang][b""], ids[lang][b"\n"]
            tokens = (text.as_py().translate(LETTERS) + b"\n").replace(b"\n", b" \n ").split(b" ")
            numbers = np.fromiter(map(ids[lang].__getitem__, tokens), np.int32, len(tokens))
            parts[lang].append(numbers[numbers != GAP])
            held += len(tokens)
            if held >= FLUSH:
                yield from out()
                held = 0
    yield from out()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n."""

    def per_batch(batches):
        for lang, words, numbers in encoded(batches):
            n = np.bincount(numbers, minlength=len(words))[END + 1:]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(words[END + 1:], pa.binary()),
                                              pa.array(n, pa.int64())], ["lang", "word", "n"])

    return docs.mapInArrow(per_batch, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def marked(phrases: DataFrame):
    """A broadcast bitmap of the hashes of phrases of equal length (columns lang, phrase): MAX_CELLS bits at most."""
    cells = cells_for(phrases.count(), CELLS_EACH, MIN_CELLS, MAX_CELLS)

    def mark(batches):
        for batch in batches:
            h = [[word_hash(lang, w) for w in phrase.split(b" ")] for lang, phrase in
                 zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            if h:
                at = reduce(pair_hash, np.array(h, np.uint64).T) & np.uint64(cells - 1)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], ["at"])

    return phrases.sparkSession.sparkContext.broadcast((bitmap(phrases.mapInArrow(mark, "at bigint"), cells), cells))


def heavy(phrases: DataFrame, sizes: DataFrame) -> dict[tuple[str, bytes], int]:
    """Slots of the phrases with at least 1/HEAVY of their language's words: at most HEAVY a language."""
    rows = phrases.join(sizes, "lang").where(f"a * {HEAVY} >= total").selectExpr(
        "lang", "CAST(phrase AS BINARY) AS phrase", f"CAST(1 + a * {HEAVY} div total AS INT) AS slots")
    return {(r.lang, bytes(r.phrase)): r.slots for r in rows.collect()}


def stripes_of(lang, k, names, slots, prefix, following, words, hashes) -> pa.RecordBatch:
    """Stripes of the given (prefix, next) occurrences, a row per bundle: its prefixes, how many entries each has, and these."""
    pairs, n = np.unique(prefix.astype(np.int64) * len(words) + following, return_counts=True)
    used, prefix = np.unique(pairs // len(words), return_inverse=True)
    following, used = pairs % len(words), used.tolist()
    slot = (hashes[following] >> np.uint64(20)) % slots[used][prefix].astype(np.uint64)
    home = np.fromiter((word_hash(lang, names[i]) for i in used), np.uint64, len(used))
    bundle = (pair_hash(home[prefix], slot) % np.uint64(BUNDLES)).astype(np.int64)
    order = np.lexsort((prefix, bundle))
    prefix, bundle, following, n = prefix[order], bundle[order], following[order], n[order]
    rows = np.flatnonzero(np.diff(bundle, prepend=-1))
    stripes = np.flatnonzero(np.diff(bundle, prepend=-1) | np.diff(prefix, prepend=-1))
    bounds, inner = np.append(rows, len(n)).tolist(), np.append(np.searchsorted(stripes, rows), len(stripes)).tolist()
    texts, heads = [words[i] for i in following.tolist()], [names[used[i]] for i in prefix[stripes].tolist()]
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(rows), pa.string()), pa.array(np.full(len(rows), k), pa.int32()), pa.array(bundle[rows], pa.int32()),
         pa.array([b"\n".join(heads[a:b]) for a, b in zip(inner, inner[1:])], pa.binary()),
         pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(np.diff(stripes, append=len(n)), pa.int32())),
         pa.array([b" ".join(texts[a:b]) for a, b in zip(bounds, bounds[1:])], pa.binary()),
         pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(n, pa.int32()))],
        ["lang", "k", "bundle", "prefixes", "widths", "nexts", "counts"])


def short_stripes(docs: DataFrame, bits, cuts: dict) -> DataFrame:
    """Stripes of one-word prefixes."""

    def per_batch(batches):
        frequent = tester(*bits.value)
        for lang, words, numbers in encoded(batches):
            hashes = np.fromiter((word_hash(lang, w) for w in words), np.uint64, len(words))
            good = frequent(hashes)
            good[:END + 1] = False
            at = np.flatnonzero(good[numbers[:-1]] & good[numbers[1:]])
            slots = np.fromiter((cuts.get((lang, w), 1) for w in words), np.int64, len(words))
            yield stripes_of(lang, 1, words, slots, numbers[at], numbers[at + 1], words, hashes)

    return docs.mapInArrow(per_batch, STRIPE)


def long_stripes(docs: DataFrame, bits, cuts: dict, least: int, most: int) -> DataFrame:
    """Stripes of prefixes of least to most words, two or more, in runs whose phrases of `least` words are all marked."""

    def per_batch(batches):
        frequent = tester(*bits.value)
        for lang, words, numbers in encoded(batches):
            hashes = np.fromiter((word_hash(lang, w) for w in words), np.uint64, len(words))
            runs = [numbers[i:len(numbers) - least + 1 + i] for i in range(least)]
            linked = frequent(reduce(pair_hash, [hashes[r] for r in runs])) & np.logical_and.reduce([r > END for r in runs])
            at = np.flatnonzero(linked)
            names, slots, code = words, None, numbers[at].astype(np.int64)
            for k in range(2, most + 1):
                found, code = np.unique(code * len(words) + numbers[at + k - 1], return_inverse=True)
                before, last = (found // len(words)).tolist(), (found % len(words)).tolist()
                names = [names[i] + b" " + words[j] for i, j in zip(before, last)]
                slots = np.array([cuts.get((lang, x), 1) for x in names], np.int64) if slots is None else slots[before]
                if k >= least:
                    on = linked[at + k - least + 1]
                    at, code = at[on], code[on]
                    yield stripes_of(lang, k, names, slots, code, numbers[at + k], words, hashes)

    return docs.mapInArrow(per_batch, STRIPE)


def added(rows: list) -> tuple:
    """Rows of one bundle added up: prefixes, words, and for each entry its prefix, word and count; ordered by prefix."""
    prefixes, widths, nexts, counts = zip(*rows)
    names = pa.array(b"\n".join(prefixes).split(b"\n"), pa.binary()).dictionary_encode()
    words = pa.array(b" ".join(nexts).split(b" "), pa.binary()).dictionary_encode()
    code = (np.repeat(names.indices.to_numpy().astype(np.int64), np.concatenate(widths)) * len(words.dictionary)
            + words.indices.to_numpy())
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    return (names.dictionary.to_pylist(), words.dictionary.to_pylist(), code[starts] // len(words.dictionary),
            code[starts] % len(words.dictionary), np.add.reduceat(np.concatenate(counts)[order], starts))


def stripe_bounds(prefix: np.ndarray) -> list[int]:
    return np.append(np.flatnonzero(np.diff(prefix, prepend=-1)), len(prefix)).tolist()


def merged(stripes: DataFrame, min_count: int) -> DataFrame:
    """Stripes of equal key added elementwise: the entries that are frequent."""

    def rows(batches):
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for key, prefixes, widths, nexts, counts in zip(keys, *(batch.column(i) for i in range(3, 7))):
                yield key, (prefixes.as_py(), widths.values.to_numpy(), nexts.as_py(), counts.values.to_numpy().astype(np.int64))

    def total(group):
        held, size = [], 0
        for row in group:
            held.append(row)
            size += len(row[3])
            if size >= MERGE and len(held) > 1:  # what is held becomes one row
                names, words, prefix, word, n = added(held)
                bounds = stripe_bounds(prefix)
                held = [(b"\n".join(names[i] for i in prefix[bounds[:-1]].tolist()), np.diff(bounds),
                         b" ".join(words[i] for i in word.tolist()), n)]
                size = 0
        return added(held)

    def out(found):
        return pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in found], t) for i, t in enumerate(
                (pa.string(), pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64())))],
            ["lang", "prefix", "k", "nexts", "counts"])

    def merge(batches):
        found = []
        for (lang, k, _), group in groupby(rows(batches), key=lambda r: r[0]):
            names, words, prefix, word, n = total(row for _, row in group)
            often = n >= min_count
            prefix, texts, n = prefix[often], [words[i] for i in word[often].tolist()], n[often].tolist()
            bounds = stripe_bounds(prefix)
            found += [(lang, names[prefix[a]], k, texts[a:b], n[a:b]) for a, b in zip(bounds, bounds[1:])]
            if len(found) >= 4096:
                yield out(found)
                found = []
        yield out(found)

    keys = ["lang", "k", "bundle"]
    return stripes.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        merge, "lang string, prefix binary, k int, nexts array<binary>, counts array<bigint>")


def entries(stripes: DataFrame) -> DataFrame:
    """lang, phrase, m (words), a: the frequent phrases of merged stripes."""
    return stripes.select("lang", "prefix", "k", F.explode(F.arrays_zip("nexts", "counts")).alias("x")).selectExpr(
        "lang", "CAST(prefix AS STRING) AS prefix", "k + 1 AS m", "x.counts AS a",
        "concat(CAST(prefix AS STRING), ' ', CAST(x.nexts AS STRING)) AS phrase")


def best_cuts(phrases: DataFrame, totals: DataFrame, sizes: DataFrame) -> DataFrame:
    """The lowest score over the cuts of each phrase, with the counts of its two parts."""
    cut = phrases.join(sizes, "lang").select(
        "lang", "phrase", "a", F.col("total").alias("n"), F.split("phrase", " ").alias("w"), F.expr("explode(sequence(1, m - 1))").alias("k"))
    parts = cut.selectExpr("lang", "phrase", "a", "n", "k", "array_join(slice(w, 1, k), ' ') AS first",
                           "array_join(slice(w, k + 1, size(w) - k), ' ') AS rest")
    scored = (parts.join(totals.toDF("lang", "first", "l"), ["lang", "first"]).join(totals.toDF("lang", "rest", "r"), ["lang", "rest"])
              .withColumn("score", F.expr("1000 * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0)) "
                                          "div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")))
    return scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))


def mine(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, percent: int = PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each language."""
    texts = pick(docs, "lang", "text").selectExpr("coalesce(lang, 'und') AS lang", "CAST(coalesce(text, '') AS BINARY) AS text")
    words = written(word_counts(texts), "words")
    sizes = written(words.groupBy("lang").agg(F.sum("n").alias("total")), "sizes")
    frequent = words.where(F.col("n") >= min_count).select("lang", F.col("word").alias("phrase"), F.col("n").alias("a"))
    short = written(merged(short_stripes(texts, marked(frequent.select("lang", "phrase")), heavy(frequent, sizes)), min_count), "short")
    pairs = entries(short)
    cuts, bits = heavy(pairs, sizes), marked(pairs.selectExpr("lang", "CAST(phrase AS BINARY) AS phrase"))
    middle = written(merged(long_stripes(texts, bits, cuts, 2, 2), min_count), "middle")
    bits = marked(entries(middle).selectExpr("lang", "CAST(phrase AS BINARY) AS phrase"))
    stripes = short.unionByName(middle).unionByName(written(merged(long_stripes(texts, bits, cuts, 3, LONGEST - 1), min_count), "long"))

    phrases = written(entries(stripes), "phrases")
    totals = frequent.selectExpr("lang", "CAST(phrase AS STRING) AS phrase", "a AS f").unionByName(phrases.selectExpr("lang", "phrase", "a AS f"))
    beyond = (phrases.select("lang", F.col("prefix").alias("phrase"), "a")
              .unionByName(phrases.select("lang", F.expr("substr(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "a"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = phrases.join(beyond, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {percent} * a").drop("longer")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (best_cuts(kept, totals, sizes).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def op11_phrase_stripes(spark, sf_dir):
    return mine(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM lists GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM starts, (VALUES (1), (2), (3), (4), (5)) v(m)
          WHERE i + m - 1 <= len(w)),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, m, phrase, f AS a, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS w FROM counts WHERE m > 1),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, x.f AS l, y.f AS r, s.n,
         CAST((1000::HUGEINT * c.a * s.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN sizes s USING (lang)
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT DISTINCT c.lang, array_to_string(string_split(c.phrase, ' ')[i:j], ' ') AS phrase, c.f
  FROM counts c, range(1, 6) a(i), range(1, 6) b(j) WHERE i <= j AND j <= c.m AND j - i + 1 < c.m),
gone AS (SELECT DISTINCT p.lang, p.phrase FROM inner_parts p JOIN counts c USING (lang, phrase) WHERE 100 * p.f >= 100 * c.f),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.lang = best.lang AND g.phrase = best.phrase))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked WHERE rank <= 2000
"""
