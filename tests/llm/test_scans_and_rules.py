"""License containment and counts, and the estimates of the quality rules, against brute force and planted values."""

import random
import re
import time

import numpy as np
import pytest

from matchday.llm import license_scan, rules


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    at, labels = [], set()
    for phrase, label in license_scan.BASE:
        own = phrase.split()
        for i in range(len(words)):
            if words[i:i + len(own)] == own:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("seed", range(20))
def test_base_columns_by_brute_force(seed):
    r, scanner = random.Random(seed), license_scan.Scanner()
    bits = ["mit license", "cc by", "Apache License,", "GNU general\npublic license", "mit", "license", "by", "café", "x9", "-", "cc"]
    text = " ".join(r.choice(bits) for _ in range(r.randint(0, 60)))
    assert license_scan.scan_text(text.encode(), scanner)[:5] == brute_base(text)


def test_a_long_text_of_base_phrases():
    started = time.time()
    row = license_scan.scan_text(b"MIT License\n" * 175_000, license_scan.Scanner())
    assert row[:4] == (350_000, 175_000, 0, 349_998) and time.time() - started < 5


def test_containment_by_brute_force():
    ranked = [license_scan.Rule(p, str(p), "", ".", 0.0) for p in range(1, 7)]
    for seed in range(500):
        r = random.Random(seed)
        spans = {(s, s + r.randint(1, 8), r.randrange(6)) for s in (r.randint(0, 10) for _ in range(r.randint(0, 12)))}
        found = [(s, e, k, ranked[k]) for s, e, k in spans]
        inside = lambda a, b: a != b and b[0] <= a[0] and a[1] <= b[1] and b[2] <= a[2]
        want = {a for a in spans if not any(inside(a, b) for b in spans)}
        assert {(s, e, rule.priority - 1) for s, e, rule in license_scan.contained_removed(found)} == want


def test_estimates_find_planted_accuracies(spark):
    r, n, prior = np.random.default_rng(4), 40_000, 0.7
    good = dict(zip(rules.RULES, (0.95, 0.9, 0.85, 0.92, 0.8, 0.97, 0.88, 0.75)))
    bad = dict(zip(rules.RULES, (0.6, 0.75, 0.8, 0.55, 0.7, 0.5, 0.85, 0.65)))
    is_good = r.random(n) < prior
    votes = {}
    for name in rules.RULES:
        right = np.where(is_good, np.where(r.random(n) < good[name], 1, -1), np.where(r.random(n) < bad[name], -1, 1))
        votes[name] = np.where(r.random(n) < 0.1, 0, right)
    rows = [tuple(int(votes[name][i]) for name in rules.RULES) for i in range(n)]
    accuracy, share = rules.fit(spark.createDataFrame(rows, ", ".join(f"{name} int" for name in rules.RULES)))
    assert abs(share - prior) < 0.05
    for name, (g, b) in accuracy.items():
        assert abs(g - good[name]) < 0.05 and abs(b - bad[name]) < 0.05, name


def test_a_rule_that_is_noise_does_not_reject(spark):
    """A rule that votes bad at random in good documents loses its weight; one that only bad documents fail keeps it."""
    names = list(rules.RULES)
    r = random.Random(7)
    rows = []
    for _ in range(4000):
        fine = r.random() < 0.8
        row = [1 if fine or r.random() < 0.2 else -1 for _ in names]
        row[0] = 1 if r.random() < 0.6 else -1
        rows.append(tuple(row))
    accuracy, prior = rules.fit(spark.createDataFrame(rows, ", ".join(f"{name} int" for name in names)))
    one = spark.createDataFrame([tuple([-1] + [1] * 7), tuple([1] + [-1] * 3 + [1] * 4)], ", ".join(f"{name} int" for name in names))
    noisy, failing = [x[0] for x in one.select(rules.posterior(accuracy, prior)).collect()]
    assert noisy > 0.9 and failing < 0.1
