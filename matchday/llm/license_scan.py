"""License scans by ordered signature rules.

A text is reduced to its lower-cased words joined by one space, and every rule is matched on that.  Rules are ordered by
priority: full notices before names, names before abbreviations.  A rule is tried only if its keyword, a word or start of
a word that each of its matches contains, occurs in the text: one automaton finds all keywords in one pass.  Detections are then resolved by
interval containment: a detection inside one of a rule of the same or a higher priority is suppressed, and of equal
intervals the earliest rule stays.

Counting and containment are linear and n log n in the text, so a text made of base phrases only costs what any other does.

The rules are made from families (names, versions, spellings) and a few sentence forms, so that a new license is one line.

Base phrases are counted apart, and their labels always stay.

Defined cases: a null or empty text has no words and no labels (empty strings), null positions and score 0; equal rows
give equal results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchday.llm.common import pick, table

BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# A byte to a space if it separates words, capitals to small letters, everything beyond ASCII unchanged.
WORD_BYTES = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

# label, keyword, pattern of the name, versions
FAMILIES = (
    ("gpl", "general", r"gnu general public licen[cs]e", ("1", "2", "3")),
    ("lgpl", "lesser", r"gnu lesser general public licen[cs]e", ("2 1", "3")),
    ("lgpl", "library", r"gnu library general public licen[cs]e", ("2",)),
    ("agpl", "affero", r"gnu affero general public licen[cs]e", ("3",)),
    ("gfdl", "documentation", r"gnu free documentation licen[cs]e", ("1 1", "1 2", "1 3")),
    ("apache", "apache", r"apache (?:software )?licen[cs]e", ("1 0", "1 1", "2 0", "2")),
    ("mit", "mit", r"mit licen[cs]e", ()),
    ("bsd", "bsd", r"(?:new |modified |simplified |revised )?bsd (?:[234] clause )?licen[cs]e", ()),
    ("isc", "isc", r"isc licen[cs]e", ()),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", r"eclipse public licen[cs]e", ("1 0", "2 0")),
    ("cddl", "distribution", r"common development and distribution licen[cs]e", ("1 0", "1 1")),
    ("cpl", "common", r"common public licen[cs]e", ("1 0",)),
    ("eupl", "european", r"european union public licen[cs]e", ("1 1", "1 2")),
    ("artistic", "artistic", r"artistic licen[cs]e", ("1 0", "2 0")),
    ("zlib", "zlib", r"zlib (?:libpng )?licen[cs]e", ()),
    ("boost", "boost", r"boost software licen[cs]e", ("1 0",)),
    ("unlicense", "unlicense", r"unlicense", ()),
    ("wtfpl", "wtfpl", r"wtfpl", ("2",)),
    ("ofl", "font", r"(?:sil )?open font licen[cs]e", ("1 0", "1 1")),
    ("odbl", "database", r"open database licen[cs]e", ("1 0",)),
    ("psf", "python", r"python software foundation licen[cs]e", ("2",)),
    ("openrail", "openrail", r"(?:creativeml )?openrail(?: m)?", ()),
)
CC_PARTS = (("cc-by", "by"), ("cc-by-sa", "by sa"), ("cc-by-nc", "by nc"), ("cc-by-nd", "by nd"), ("cc-by-nc-sa", "by nc sa"),
            ("cc-by-nc-nd", "by nc nd"))
CC_NAMES = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
TAGS = {"gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "apache": "apache", "mpl": "mpl", "epl": "epl", "eupl": "eupl",
        "artistic": "artistic", "boost": "bsl", "ofl": "ofl", "cddl": "cddl"}
GRANTS = r"(?:(?:re)?licen[cs]ed|released|distributed|available|published|provided|redistribut\w+|free software) (?:\w+ ){0,6}?"
UNDER = r"(?:under|with|by) (?:the )?(?:terms of )?(?:the )?"


@dataclass(frozen=True)
class Rule:
    priority: int  # smaller is stronger
    label: str
    keyword: str
    pattern: str
    score: float


def rules() -> list[Rule]:
    out = []
    for label, key, name, versions in FAMILIES:
        out.append(Rule(2, label, key, GRANTS + UNDER + name, 0.9))
        out.append(Rule(4, label, key, name, 0.7))
        for v in versions:
            spelled = rf"{name}(?: as published by \w+(?: \w+){{0,4}}?)? (?:either )?(?:version |v ?){v}\b"
            out.append(Rule(1, f"{label}-{v.replace(' ', '.')}", key, GRANTS + UNDER + spelled, 1.0))
            out.append(Rule(3, f"{label}-{v.replace(' ', '.')}", key, spelled, 0.85))
        for v in versions if label in TAGS else ():
            tag = TAGS[label]
            out.append(Rule(1, f"{label}-{v.replace(' ', '.')}", tag, rf"spdx license identifier {tag} {v}(?: only| or later)?\b", 1.0))
            out.append(Rule(5, f"{label}-{v.replace(' ', '.')}", tag, rf"\b{tag} ?v?{v}\b", 0.6))
    for label, parts in CC_PARTS:
        named = "creative commons " + " ".join(CC_NAMES[p] for p in parts.split())
        for form, key, score in ((rf"cc {parts}", "cc", 0.8), (named, "creative", 0.85)):
            out.append(Rule(2, label, key, GRANTS + UNDER + form + r"\b", score + 0.1))
            out.append(Rule(4, label, key, form + r"\b", score))
            for v in CC_VERSIONS:
                out.append(Rule(1, f"{label}-{v.replace(' ', '.')}", key, GRANTS + UNDER + rf"(?:a )?{form}(?: international)? {v}\b", 1.0))
                out.append(Rule(3, f"{label}-{v.replace(' ', '.')}", key, rf"{form} {v}\b", score + 0.05))
    out.append(Rule(2, "cc0", "cc0", r"\bcc0(?: 1 0)?\b", 0.9))
    out.append(Rule(3, "public-domain", "domain", r"(?:in(?:to)?|to) the public domain", 0.6))
    out.append(Rule(3, "mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 1.0))
    out.append(Rule(3, "bsd", "redistribution", r"redistribution and use in source and binary forms", 1.0))
    out.append(Rule(3, "isc", "purpose", r"permission to use copy modify and or distribute this software for any purpose", 1.0))
    out.append(Rule(6, "proprietary", "reserved", r"all rights reserved", 0.3))
    return sorted(out, key=lambda r: r.priority)  # stable: within a priority the order above


class Scanner:
    """The compiled rules; made once in each Python worker task."""

    def __init__(self):
        import ahocorasick

        self.rules = [(r, re.compile(r" " + r.pattern.removeprefix(r"\b") + r"(?= )")) for r in rules()]
        self.by_keyword: dict[str, list[int]] = {}
        for i, (r, _) in enumerate(self.rules):
            self.by_keyword.setdefault(r.keyword, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for key in self.by_keyword:
            self.automaton.add_word(f" {key}", key)  # the start of a word: "gplv3" has the keyword gpl
        self.automaton.make_automaton()

    def detections(self, text: str) -> list[tuple[int, int, Rule]]:
        """Surviving (start, end, rule) over the joined words, by start."""
        keys = {key for _, key in self.automaton.iter(text)}
        found = []
        for i in sorted(i for key in keys for i in self.by_keyword[key]):
            rule, pattern = self.rules[i]
            found += [(m.start(), m.end(), i, rule) for m in pattern.finditer(text)]
        return contained_removed(found)


def contained_removed(found: list[tuple[int, int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Drop every detection inside another of the same or a higher priority: one sweep over the sorted intervals.

    An interval comes after all that can contain it: those that start before it, longer ones of its start, and of equal
    ones the stronger.  So it is contained if one of them, of its priority or a stronger one, ends no earlier.
    """
    out, reach = [], [-1] * (1 + max((f[3].priority for f in found), default=0))
    for s, e, _, rule in sorted(found, key=lambda f: (f[0], -f[1], f[3].priority, f[2])):
        if max(reach[:rule.priority + 1]) < e:
            out.append((s, e, rule))
            reach[rule.priority] = e
    return out


def scan_text(text: bytes | None, scanner: Scanner):
    """n_words, n_base, first_word, last_word, base labels, all labels, score."""
    words = (text or b"").translate(WORD_BYTES).split()
    joined = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in BASE:
        needle = b" " + phrase.encode() + b" "
        at = joined.find(needle)
        while at >= 0:
            places.append(at)
            base.add(label)
            at = joined.find(needle, at + 1)
    first, last = (joined.count(b" ", 0, at(places)) for at in (min, max)) if places else (None, None)
    found = scanner.detections(joined.decode("utf-8", "replace"))
    labels = base | {rule.label for _, _, rule in found}
    score = max([0.7 if base else 0.0, *(rule.score for _, _, rule in found)])
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan(docs: DataFrame) -> DataFrame:
    def per_partition(batches):
        scanner = Scanner()
        for batch in batches:
            rows = [scan_text(t.as_py(), scanner) for t in batch.column(1)]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [
                "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        per_partition, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                       "base_labels string, labels string, score double")


def op3_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
