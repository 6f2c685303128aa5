"""Every operator against a brute-force version, and the defined cases: nulls, empty, long, repeated, clashing columns."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import as_dicts

from matchday.llm import classifier, components, html_text, license_scan, mixing, packing, pivots, rules, secret_scan, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long, Text string, n_words long"
rng = random.Random(7)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(70, 99)
TEXTS = [None, "", "  \n\t ", "one", "two words", prose(120, 1), prose(120, 1), prose(120, 1).replace(" ", "\n", 3), prose(60, 2) + " " + PASSAGE,
         PASSAGE + " " + prose(80, 3), prose(40, 4) + " " + PASSAGE + " " + prose(40, 5), "word " * 900, prose(3000, 6), "ÄÖ é ☃ " * 40,
         "Released under the MIT License. password = 'x7Kp92mQzLw4'", "GNU General\nPublic License, version 3. pwd: Zr8!kQ2vLm", prose(20, 8)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["b", "a", None, "ä"][i % 4], 1, "clash", 5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, prose(50, 9), "en", "a", 1, None, None)], KIND)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_mixing_meets_targets(docs, empty):
    out = as_dicts(mixing.mix(docs))
    sums = defaultdict(lambda: [0, 0.0, 0])
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        key = (r["source_size"], r["target"])
        sums[key][0] += r["taken"]
    assert all(abs(taken - target) <= 2 for (_, target), (taken, _, _) in sums.items())
    assert abs(sum(t for _, t in sums) - 1.5 * sum(r["size"] for r in out)) < 1e-6
    assert sorted(map(str, out)) == sorted(map(str, as_dicts(mixing.mix(docs))))
    assert mixing.mix(empty).count() == 0 and mixing.repeated(empty).count() == 0
    assert mixing.repeated(docs).columns == docs.columns


def brute_rules(text):
    w = WORD.findall(text or "")
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    gone = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(gone)


def test_rules(docs, empty):
    for r in as_dicts(rules.judge(docs)):
        want = brute_rules(TEXTS[r["doc_id"]] if r["doc_id"] is not None else prose(50, 9))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert rules.judge(empty).count() == 0


def brute_fingerprint(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, empty):
    out = as_dicts(simhash.near_duplicates(docs))
    assert all(r["fp"] % 2 ** 64 == brute_fingerprint(TEXTS[r["doc_id"]]) for r in out if r["doc_id"] is not None)
    by = {r["doc_id"]: r["component_id"] for r in out}
    assert by[0] == by[1] == by[2] == 0 and by[5] == by[6] == by[7] == 5
    kept = [r["doc_id"] for r in as_dicts(simhash.keep_one(docs))]
    assert kept.count(5) == 1 and 6 not in kept and simhash.keep_one(docs).columns == docs.columns
    assert simhash.near_duplicates(empty).count() == 0


def test_full_shards_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MAX_SHARD", 3)
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(5)]
    marks = sorted({b ^ (1 << i) ^ (1 << j) for b in base for i in range(8) for j in range(8)})
    signed = [m - 2 ** 64 if m >= 2 ** 63 else m for m in marks]
    rows = simhash.shards(spark.createDataFrame([(m,) for m in signed], "fp long"))
    met = defaultdict(set)
    for x in rows.collect():
        met[x["shard"]].add(x["fp"] % 2 ** 64)
    together = {(a, b) for own in met.values() for a in own for b in own}
    assert all((a, b) in together for a in marks for b in marks if (a ^ b).bit_count() <= 2)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    out = {r["node"]: r["root"] for r in as_dicts(components.components(spark.createDataFrame(edges, "a long, b long")))}
    assert out == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_packing(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers
    theirs = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = as_dicts(packing.pack(docs, with_ids=True))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(TEXTS):
        want = [*theirs.encode(text or "", add_special_tokens=False).ids, 1]
        own = [x for p in sorted(pieces[i], key=lambda p: p["start"]) for x in p["ids"]]
        assert own == want * (2 if i == 5 else 1) or i == 5 and Counter(own) == Counter(want * 2)
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= packing.MAX_TOKENS
    assert packing.pack(empty).count() == 0
    encode = packing.encoder()
    for text in ("a<|endoftext|>b", "​ x y﻿", "１２３ ① ²", "🙂 é\x00\x85", "''s S it's\r\n\t x"):
        assert encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_cutting_stock_is_near_its_bound():
    r = random.Random(3)
    histogram = {s: r.randint(1000, 5000) for s in range(3, 120)}
    plan = packing.plan(histogram, 128)
    held = Counter()
    for content, times in plan:
        assert sum(s * n for s, n in content.items()) <= 128
        for s, n in content.items():
            held[s] += n * times
    used, bound = sum(t for _, t in plan), max(sum(s * n for s, n in histogram.items()) / 128, sum(n for s, n in histogram.items() if s > 64))
    assert held == histogram and used <= 1.1 * bound


def test_secrets(docs, empty):
    by = {r["doc_id"]: r for r in as_dicts(secret_scan.scan(docs))}
    assert by[14]["n_assign"] == 1 and by[15]["n_guess"] == 1 and by[15]["n_assign"] == 0
    assert by[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and by[0]["spans"] == ""
    start = TEXTS[14].index("password")
    assert by[14]["spans"] == f"assign:{start}:{len(TEXTS[14]) - 1}"
    assert by[12]["spans"] == "" and secret_scan.scan(empty).count() == 0
    assert secret_scan.guess_cost("password123") < 3 < secret_scan.guess_cost("qwerty19850412") < 10 < secret_scan.guess_cost("x7Kp92mQzL")
    texts = {r["doc_id"]: r["text"] for r in as_dicts(secret_scan.redacted(docs))}
    assert "x7Kp" not in texts[14] and "Zr8" not in texts[15] and texts[12] == TEXTS[12] and texts[0] is None


@pytest.mark.parametrize("text, value", [
    ("password: vq!zk@wl#rx$tb", "vq!zk@wl#rx$tb"), ("DB_PASSWORD=Zr8!kQ2vLm", "Zr8!kQ2vLm"), ("db.pin = 83015529460177", "83015529460177"),
    ("aws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY")])
def test_guess_cost_decides_after_separators(text, value):
    start = text.index(value)
    assert secret_scan.spans(f"{text} end") == [(start, 3, start + len(value))]
    assert secret_scan.redact(text) == text[:start] + "<SECRET>"
    assert not secret_scan.spans("the password is somethingordinary") and not secret_scan.spans("my_password: password123")


def test_licenses(docs, empty):
    by = {r["doc_id"]: r for r in as_dicts(license_scan.scan(docs))}
    assert (by[14]["base_labels"], by[14]["n_base"], by[14]["first_word"]) == ("mit", 1, 3)
    assert by[15]["labels"] == "gpl,gpl-3" and by[15]["score"] > 0.8
    assert (by[0]["n_words"], by[0]["labels"], by[0]["first_word"], by[0]["score"]) == (0, "", None, 0.0)
    assert license_scan.scan(empty).count() == 0 and len(license_scan.rules()) > 200


def example(pattern, seed):
    """A random text that the pattern matches."""
    r = random.Random(seed)

    def made(parsed):
        return "".join(one(str(op), value) for op, value in parsed)

    def one(op, value):
        if op == "LITERAL":
            return chr(value)
        if op == "IN":
            kind, first = value[0]
            return chr(first) if str(kind) == "LITERAL" else chr(first[0]) if str(kind) == "RANGE" else "w"
        if op in ("MAX_REPEAT", "MIN_REPEAT"):
            return "".join(made(value[2]) for _ in range(r.randint(value[0], min(int(value[1]), value[0] + 2))))
        if op == "SUBPATTERN":
            return made(value[3])
        if op == "BRANCH":
            return made(r.choice(value[1]))
        assert op == "AT", op
        return ""

    return made(re._parser.parse(pattern))


def test_every_license_rule_passes_its_gate():
    scanner = license_scan.Scanner()
    for rule in license_scan.rules():
        for seed in range(8):
            text = f" {example(rule.pattern, seed)} "
            keys = {key for _, key in scanner.automaton.iter(text)}
            assert rule.keyword in keys, (rule, text)
    for text, label in ((" gplv3 ", "gpl-3"), (" mpl2 0 ", "mpl-2.0"), (" redistribution and use in source and binary forms ", "bsd"),
                        (" permission is hereby granted free of charge to any person obtaining a copy ", "mit")):
        assert [r.label for _, _, r in scanner.detections(text)] == [label]


def test_contained_detections_are_suppressed():
    scanner = license_scan.Scanner()
    found = scanner.detections(" licensed under the gnu lesser general public license version 3 ")
    assert [r.label for _, _, r in found] == ["lgpl-3"]


def test_substrings(docs, empty):
    seen, want = {}, {}
    for i, text in enumerate(TEXTS):
        w = (text or "").encode().split()
        windows = [b" ".join(w[j:j + 50]) for j in range(len(w) - 49)]
        gone = {k for j, x in enumerate(windows) if x in seen for k in range(j, j + 50)}
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
        for x in windows:
            seen.setdefault(x, i)
    out = as_dicts(substrings.remove_repeats(docs))
    assert len(out) == len(TEXTS) + 2
    assert all(want[r["doc_id"]] == (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out if r["doc_id"] is not None)
    assert want[9][1] == 70 and want[11][1] == 0 and substrings.remove_repeats(empty).count() == 0


def test_classifier(spark, docs, empty):
    rows = [(i, prose(80, i) if i % 3 else " ".join(w + "###" for w in prose(80, i).split()), i % 3 and 1) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    out = as_dicts(classifier.classify(table, table.select("doc_id", "quality")).join(table.drop("text"), "doc_id"))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held) > 0
    none = table.select("doc_id", "quality").limit(0)
    assert {r["score"] for r in as_dicts(classifier.classify(docs, none))} == {0.5}
    assert classifier.classify(empty, none).count() == 0


def test_factorisation_machine_identity():
    machine = classifier.FactorisationMachine(np.zeros((classifier.STATISTICS, classifier.BINS - 1)), 0.5)
    machine.v = np.random.default_rng(0).normal(0, 0.3, machine.v.shape)
    at, x = np.array([3, 17, 4001]), np.array([0.5, -1.0, 2.0])
    pairs = sum(machine.v[at[i]] @ machine.v[at[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert abs(machine.score(at, x) - 1 / (1 + math.exp(-pairs))) < 1e-12


def test_pivots(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(300, 32))
    near = base[:60] + r.normal(scale=0.15, size=(60, 32))
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(np.concatenate([base, near, base[:5], 3 * base[5:8]]).astype(np.float32))]
    bad = [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [None] + [1.0] * 31, 1), (904, [1.0, 0.0], 1), (905, [2.0, 0.0], 1)]
    out = {x["vec_id"]: x for x in as_dicts(pivots.near_duplicates(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")))}
    unit = np.array([v for _, v, _ in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    links = (unit @ unit.T >= 0.95) & ~np.eye(len(unit), dtype=bool)
    found, true = sum(out[i]["n_links"] for i in range(len(unit))), int(links.sum())
    assert 0.9 * true <= found <= true and all(out[i]["n_links"] <= links[i].sum() for i in range(len(unit)))
    assert all((out[i]["n_links"], out[i]["component_id"]) == (0, i) for i in (900, 901, 902, 903))
    assert out[905]["component_id"] == 904 and not out[905]["kept"] and out[365]["component_id"] == min(5, out[5]["component_id"])


def test_pivots_in_a_large_cluster(spark):
    r = np.random.default_rng(5)
    n, hot = 20000, 6600
    values = r.normal(size=(n, 64))
    values /= np.linalg.norm(values, axis=1)[:, None]
    noise = r.uniform(0.1, 0.2, size=(hot, 1)) * values[:hot]
    values[:hot] = values[-1] + noise
    values[hot:hot + 500] = values[hot + 500:hot + 1000] + 0.2 * values[:500]
    values = values.astype(np.float32)
    out = pivots.near_duplicates(spark.createDataFrame(
        [(i, v) for i, v in enumerate(values.tolist())], "vec_id long, embedding array<float>")).toPandas()
    near = out.sort_values("vec_id")["n_links"].to_numpy()
    unit = values.astype(np.float64) / np.linalg.norm(values.astype(np.float64), axis=1)[:, None]
    true = np.concatenate([(unit[i:i + 2000] @ unit.T >= 0.95).sum(axis=1) - 1 for i in range(0, n, 2000)])
    assert true[:hot].mean() > 5000 and (near <= true).all()
    assert near[:hot].sum() >= 0.99 * true[:hot].sum() and near[hot:].sum() >= 0.9 * true[hot:].sum() > 0


PAGE = ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div>"
        "<article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b> part of {n}<br>goes\n on &lt;here&gt; &am</p><aside>Ad</aside>{}"
        "<div class=comments><p>Nice!</p></div></article><form>Subscribe<input></form><footer>&copy; x</footer><script>var a='</p>'</script>")


def test_html(spark):
    share = "<p>Share this article with all your friends on every network today please</p>"
    rows = [(i, f"http://a.example/{i}", PAGE.replace("{}", f"<p>Body {prose(12, i)}</p>" + share).replace("{n}", f"n{i}"), "x") for i in range(12)]
    rows += [(50, None, None, "x"), (51, "", "", "x"), (52, "http://b.example/", PAGE.replace("{}", "<p>unclosed"), "x"),
             (53, "http://c.example/", "<body><div>Plain text page</div><ul><li><a href=x>Link only</a></li></ul></body>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    by = {r["page_id"]: r for r in as_dicts(html_text.extract(pages))}
    head = "Title & more\n\nFirst bold part of {n} goes on <here> &am"
    assert by[3]["text"] == f"{head.replace('{n}', 'n3')}\n\nBody {prose(12, 3)}"  # the sharing line is on all pages of the host
    assert (by[50]["text"], by[51]["text"], by[50]["n_chars"]) == ("", "", 0)
    assert by[52]["text"] == f"{head}\n\nunclosed" and by[53]["text"] == "Plain text page"
    assert html_text.extract(pages.limit(0)).count() == 0
