"""Phrases by stripes, substring dedup by suffix arrays and the source audit, against brute force and on the defined cases."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import as_dicts
from hypothesis import given, settings
from hypothesis import strategies as st

from matchday.llm import bitmaps, collocations, divergence, suffixes

KIND = "doc_id long, text string, lang string, source string, Text string, rank int"
rng = random.Random(5)
WORDS = ["the", "of", "New", "york", "a", "É", "naïve", "x1", "b-c", "de", "la", "zz"]


def chatter(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(WORDS[:6] if r.random() < 0.7 else WORDS) + r.choice([" ", " ", " ", " ", "  ", "\t", ", ", ".\n", "!"]) for _ in range(n))


LONG = chatter(30_000, 77)
TEXTS = [(i, chatter(rng.randint(1, 120), i), ["en", "fr", None][i % 3], ["b", "a", None, "ä", ""][i % 5]) for i in range(80)]
TEXTS += [(100, None, "en", "a"), (101, "", "de", "only"), (102, " .\n,\t", None, None), (103, LONG, "en", "a"), (104, "the of " * 9000, "fr", "b"),
          (105, TEXTS[3][1], "en", "a"), (105, TEXTS[3][1], "en", "a"), (None, TEXTS[4][1], "en", "b"), (106, "New york " * 30, "", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*row, "clash", 7) for row in TEXTS], KIND).repartition(5).cache()


def lowered(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute_phrases(rows, least, top, percent=100):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                f[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1)
                if j - i < len(p) and 100 * a >= percent * found.get(p[i:j], 10 ** 18)}
        rows = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least, top, percent", [(100, 2000, 100), (8, 40, 100), (5, 5000, 60)])
def test_phrases_equal_brute_force(docs, least, top, percent):
    got = collocations.mine(docs, min_count=least, top=top, percent=percent)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(TEXTS, least, top, percent)


def test_phrases_where_stripes_are_cut_and_flushed_often(docs, monkeypatch):
    """Small flushes, many slots and a bitmap that lets everything pass change nothing."""
    for name, value in (("FLUSH", 500), ("HEAVY", 40), ("MIN_CELLS", 1 << 15), ("MAX_CELLS", 1 << 15)):
        monkeypatch.setattr(collocations, name, value)
    assert sorted(tuple(r) for r in collocations.mine(docs, min_count=8, top=60).collect()) == brute_phrases(TEXTS, 8, 60)


def test_stripe_rows_are_bounded_by_bundles_and_long_ones_need_frequent_parts(spark, monkeypatch):
    """Every pair of these words is frequent and no three are: a task emits a row per bundle, and no stripe of three words."""
    monkeypatch.setattr(collocations, "BUNDLES", 16, raising=False)
    r, seen, merged = random.Random(9), Counter(), collocations.merged
    docs = spark.createDataFrame([(i, " ".join(f"w{r.randrange(60)}" for _ in range(400)), "en") for i in range(100)], "doc_id long, text string, lang string")

    def watched(stripes, least):
        for row in stripes.selectExpr("k", "size(counts) AS n").collect():
            seen[row.k, "rows"] += 1
            seen[row.k, "entries"] += row.n
        return merged(stripes, least)

    monkeypatch.setattr(collocations, "merged", watched)
    rows = [(x.doc_id, x.text, x.lang) for x in docs.collect()]
    assert sorted(tuple(x) for x in collocations.mine(docs.coalesce(1), min_count=6).collect()) == brute_phrases(
        [(i, text, lang, None) for i, text, lang in rows], 6, 2000)
    assert seen[1, "entries"] > 3000 and seen[1, "rows"] <= 16 and seen[2, "rows"] <= 16
    assert seen[3, "entries"] < 100 and seen[4, "entries"] < 100


def test_bundles_larger_than_a_merge_step(docs, monkeypatch):
    for name, value in (("FLUSH", 700), ("BUNDLES", 3), ("MERGE", 50)):
        monkeypatch.setattr(collocations, name, value, raising=False)
    assert sorted(tuple(r) for r in collocations.mine(docs, min_count=8, top=60).collect()) == brute_phrases(TEXTS, 8, 60)


def test_phrase_scores_beyond_64_bits(spark):
    """Counts as of a very large corpus: 1000 * a * n passes 64 bits."""
    a, n, left, right = 3 * 10 ** 12, 10 ** 16 + 7, 5 * 10 ** 12, 4 * 10 ** 12
    phrases = spark.createDataFrame([("en", "p q", "p", 2, a)], "lang string, phrase string, prefix string, m int, a long")
    totals = spark.createDataFrame([("en", "p", left), ("en", "q", right)], "lang string, phrase string, f long")
    sizes = spark.createDataFrame([("en", n)], "lang string, total long")
    assert collocations.best_cuts(phrases, totals, sizes).first().best.score == 1000 * a * n // (left * right)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert collocations.mine(none).count() == 0 and suffixes.remove_repeats(none).count() == 0 and divergence.audit(none).count() == 0


def brute_audit(rows, least, top):
    groups, having = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        groups[lang or "", source or ""].update(terms)
        having[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in having[lang].items() if n >= least]
        own = {s: {t: c[t] for t in kept} for (of, s), c in groups.items() if of == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def shares(counts):
            total = sum(counts.values()) + 5 * len(kept)
            return {t: 1 + 10 ** 9 * (counts[t] + 5) // total for t in kept}
        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            far = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s]
            over = [(q[t] - p[s][t], t.encode()) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", sorted(far)), ("term", sorted(over)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(items, 1)]
    return sorted(out)


@pytest.mark.parametrize("least, top, block, rows", [(30, 50, 1 << 16, 1024), (3, 4, 5, 2), (1, 50, 40, 1), (10 ** 6, 50, 9, 3)])
def test_audit_equals_brute_force(docs, least, top, block, rows):
    got = divergence.audit(docs, min_docs=least, top=top, block=block, rows=rows)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(TEXTS, least, top)


def test_shares_are_exact_for_counts_of_a_very_large_corpus(spark):
    n, total, v = 3 * 10 ** 13 + 11, 7 * 10 ** 15 + 13, 10 ** 7
    row = spark.sql(f"SELECT {n}L AS n, {total}L AS total, {v}L AS v").selectExpr(divergence.share("n", "total") + " AS p").first()
    assert row.p == 1 + 10 ** 9 * (n + 5) // (total + 5 * v)


strings = st.lists(st.text(alphabet="ab", max_size=30) | st.text(alphabet="abcd", max_size=20) | st.sampled_from(["a" * 25, "ab" * 12, "ba" * 9 + "b"]),
                   max_size=8)


@settings(max_examples=150, deadline=None)
@given(strings)
def test_suffix_arrays_equal_sorting(texts):
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    slots = suffixes.suffix_arrays(np.frombuffer(b"".join(raw), np.uint8).astype(np.int16), bounds)
    for t, a, b in zip(raw, bounds, bounds[1:]):
        assert (slots[a:b] - a).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def brute_bytes(rows, width=50):
    least = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - width + 1):
            if d is not None:
                least[raw[i:i + width]] = min(d, least.get(raw[i:i + width], d))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - width + 1):
            if d is not None and least[raw[i:i + width]] < d:
                gone[i:i + width] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int(np.diff(gone.astype(int), prepend=0).clip(0).sum())
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeats():
    r = random.Random(3)
    mixed = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    passage = mixed("abcdefgh é", 120)
    rows = [(d, t) for d, t, *_ in TEXTS if d is None or d < 90 or d > 104]
    rows += [(1000 + i, mixed("abcd efgh", 60) + passage + mixed("xyz w", 40)) for i in range(150)]  # one passage, other edges
    rows += [(2000, "a" * 400), (2001, "a" * 300), (2002, "ab" * 100), (2003, "b" + "ab" * 90), (2004, None), (2005, ""), (2006, "a" * 49),
             (2007, "a" * 50), (None, "a" * 100), (2001, passage), (2001, passage), (2008, "é" * 40), (2009, "x" + "é" * 40 + "y")]
    rows += [(3000 + i, mixed("abcdefghijklmnop", 300)) for i in range(3)]
    return rows + [(3100 + i, rows[-1 - i % 3][1]) for i in range(20)]  # copies


@pytest.mark.parametrize("more", [{}, {"hot": 20}, {"most_cells": 0}, {"hot": 20, "most_cells": 0}])
def test_removed_bytes_equal_brute_force(spark, more):
    """Anchors of many texts, and anchors too many for a bitmap, take other ways to the same result."""
    rows = repeats()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, Doc_ID string").repartition(5)
    got = suffixes.remove_repeats(df, **more)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_bytes(rows)


@pytest.mark.parametrize("hot, by_window", [(20, 0), (3, 1)])
def test_windows_of_crowded_anchors_are_the_last_resort(spark, monkeypatch, hot, by_window):
    """Different segments of one anchor make a suffix array, or those of their finer anchors do, before windows become rows."""
    phrase = "the text that all of them have"  # 30 bytes: no window lies in it whole
    r = random.Random(5)
    mixed = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    rows = [(i, mixed(60) + phrase + mixed(60)) for i in range(150)]
    passage, before, after = mixed(200), [mixed(60) for _ in range(5)], [mixed(60) for _ in range(7)]
    rows += [(500 + i, before[i % 5] + passage + after[i % 7]) for i in range(35)]
    rows += [(1000 + i, rows[i][1][20:130]) for i in range(0, 150, 3)]
    seen, real = [], suffixes.grouped_windows
    monkeypatch.setattr(suffixes, "grouped_windows", lambda different: seen.append(different.count()) or real(different))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffixes.remove_repeats(df, hot=hot)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_bytes(rows)
    assert len(seen) == by_window


def test_long_texts_with_one_shared_passage(spark):
    shared = chatter(400, 9)
    rows = [(1, LONG + shared), (2, shared + LONG[::-1]), (3, LONG[5000:60_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in as_dicts(suffixes.remove_repeats(df))}
    assert out[1]["n_removed"] == 0 and out[2]["n_removed"] >= len(shared.encode()) - 1
    assert out[3]["n_removed"] == out[3]["n_bytes"] and out[3]["n_spans"] == 1


def test_bitmaps_never_say_no_wrongly(spark):
    marks = spark.range(3000).selectExpr("xxhash64(id) AS h")
    cells = bitmaps.cells_for(3000, 8, 1 << 15, 1 << 20)
    passes = bitmaps.tester(bitmaps.bitmap(marks.selectExpr(f"h & {cells - 1}L AS at"), cells), cells)
    own = np.array([r.h for r in marks.collect()], np.int64).view(np.uint64)
    other = np.array([r.h for r in spark.range(10_000, 13_000).selectExpr("xxhash64(id) AS h").collect()], np.int64).view(np.uint64)
    assert passes(own).all() and passes(other).mean() < 0.4


def test_segments_are_found_in_small_pieces(monkeypatch):
    """Memory of a task follows a bounded piece of its texts, however many it has."""
    pieces, real = [], suffixes.anchors
    monkeypatch.setattr(suffixes, "anchors", lambda data: pieces.append(len(data)) or real(data))
    texts = [bytes([65 + i % 26, 97 + i // 26 % 26]) * 500 for i in range(2000)]
    found = sum(len(text) for text, *_ in suffixes.segments(texts))
    assert found >= len(texts) and len(pieces) > 4 and max(pieces) <= 300_000
