"""Secret scans: fixed patterns, and password guess costs in credential contexts.

Base kinds: `assign` (a credential name, a separator and a value of 12 or more characters), `access` (a cloud access key)
and `hex` (a run of 16 or more hex digits).  The method adds kind `guess`: a value behind a wider set of credential names
whose cheapest explanation costs at least MIN_LOG10 guesses.  The cost is the minimum over all segmentations of the value
into dictionary words, dates, repeats, sequences, keyboard walks and brute-force spans, found by dynamic programming over
its positions: cost(j) = min over i of cost(i) + cost of the span i..j.  A `guess` value that overlaps a base span is that
span already and is not reported again.  A credential name may have a prefix that ends in an underscore, hyphen or dot.
After ':' or '=' the cost alone decides; after " is " the value must also mix small letters, capitals and digits (two of
the three), because any word of a sentence can stand there.

A text is scanned as a whole, in one row, and a value is cut at MAX_VALUE characters only for its cost (a longer value
cannot be cheaper than its start), never for its span.

Defined cases: a null or empty text has no spans; equal rows give equal spans; offsets are code points, ends exclusive;
an empty table gives an empty result; further columns are ignored by the scan and kept by the redaction.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchday.llm.common import pick, table

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{16,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT_NAMES = ("passphrase", "password", "passwd", "pass", "pwd", "pin", "secret", "token", "credential", "credentials",
                 "auth", "api_key", "apikey", "access_key", "private_key", "client_secret", "login", "bearer")
CONTEXT = re.compile(r"""(?<![A-Za-z0-9])(?:%s)["']?(?:\x20*([:=])\x20*|\x20is\x20)["']?([^\s"'<>]{6,})"""
                     % "|".join(sorted(CONTEXT_NAMES, key=len, reverse=True)), re.IGNORECASE | re.ASCII)
GATE = re.compile("pass|pwd|pin|secret|token|credential|auth|key|login|bearer", re.IGNORECASE | re.ASCII)
MIN_LOG10, MAX_VALUE, REDACTED = 9.0, 64, "<SECRET>"

WORDS = ("password secret admin login welcome letmein monkey dragon master shadow sunshine princess football baseball "
         "qwerty abc love hello freedom whatever trust summer winter spring autumn test user root guest default change "
         "example none null true false string value token key pass the and for with that this from have not you are was "
         "your required optional hidden field reset forgot enter invalid please time house money computer internet").split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
KEY_AT = {c: (x, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|"
                  r"(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)?\d\d")
LEET = str.maketrans("4310$57@!", "aeiosstai")


def alphabet(text: str) -> int:
    """Size of the character classes a brute-force search of this span would need."""
    size = 26 * any("a" <= c <= "z" for c in text) + 26 * any("A" <= c <= "Z" for c in text)
    return max(10, size + 10 * any("0" <= c <= "9" for c in text) + 33 * any(not c.isalnum() for c in text))


def adjacent(a: str, b: str) -> bool:
    (x, y), (u, v) = KEY_AT.get(a, (-9, -9)), KEY_AT.get(b, (99, 99))
    return abs(x - u) <= 1 and abs(y - v) <= 1 and (x, y) != (u, v)


def patterns(value: str) -> list[tuple[int, int, float]]:
    """(start, end, log10 guesses) of every cheap explanation of a span."""
    low, n, found = value.lower(), len(value), []
    plain = low.translate(LEET)
    for i in range(n):
        for j in range(i + 3, min(n, i + 12) + 1):
            rank = RANK.get(low[i:j]) or (RANK.get(plain[i:j], 0) * 4)
            if rank:
                capital = 2 if value[i:j] != low[i:j] else 1
                found.append((i, j, math.log10(rank * capital)))
        for name, step in (("repeat", 0), ("up", 1), ("down", -1)):
            j = i + 1
            while j < n and ord(low[j]) - ord(low[j - 1]) == step:
                j += 1
            found.extend((i, k, math.log10(alphabet(low[i]) * (k - i))) for k in range(i + 3, j + 1))
        j = i + 1
        while j < n and adjacent(low[j - 1], low[j]):
            j += 1
        found.extend((i, k, math.log10(47 * 4 ** min(6, (k - i) // 2) * (k - i))) for k in range(i + 4, j + 1))
        date = DATE.match(value, i)
        if date:
            found.append((i, date.end(), math.log10(365.0 * 120)))
        for width in range(2, (n - i) // 2 + 1):  # repeated blocks
            if value[i:i + width] == value[i + width:i + 2 * width]:
                found.append((i, i + 2 * width, width * math.log10(alphabet(value[i:i + width])) + math.log10(2)))
    return found


def guess_cost(value: str) -> float:
    """log10 of the guesses needed for a value: the cheapest segmentation, by dynamic programming."""
    value = value[:MAX_VALUE]
    n = len(value)
    digit = math.log10(alphabet(value))
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, cost in patterns(value):
        ending[j].append((i, cost))
    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        best[j] = min([best[j - 1] + digit, *(best[i] + cost for i, cost in ending[j])])
    return best[n]


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, position of the kind, end) of all spans, in order."""
    text = text or ""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if GATE.search(text):
        low = text.lower()
        if any(name in low for name in NAMES):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        base = sorted(found)
        at = 0
        for m in CONTEXT.finditer(text):
            start, end = m.span(2)
            end -= len(text[start:end]) - len(text[start:end].rstrip(".,;:!?)]}#$%&*"))
            while at < len(base) and base[at][2] <= start:
                at += 1
            covered = any(b[0] < end and start < b[2] for b in base[at:at + 3])
            if (not covered and end - start >= 6 and guess_cost(text[start:end]) >= MIN_LOG10
                    and (m[1] or varied(text[start:end]))):
                found.append((start, 3, end))
    return sorted(found)


def varied(value: str) -> bool:
    """Ordinary words after "is" are letters of one case; a secret in a sentence mixes kinds of characters."""
    kinds = [any(c.islower() for c in value), any(c.isupper() for c in value[1:]), any(c.isdigit() for c in value)]
    return sum(kinds) >= 2


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def redact(text: str | None) -> str | None:
    """Every span replaced; overlapping spans become one."""
    found = spans(text)
    if not found:
        return text
    out, at = [], 0
    for start, _, end in found:
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256 and spans, per document."""
    def per_batch(batches):
        for batch in batches:
            found = [spans(t.as_py()) for t in batch.column(1)]
            counts = [pa.array([sum(k == kind for _, k, _ in f) for f in found], pa.int64()) for kind in range(4)]
            base = [hashlib.sha256(listed([x for x in f if x[1] < 3]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(base, pa.string()), pa.array(map(listed, found), pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    return pick(docs, "doc_id", "text").mapInArrow(
        per_batch, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """The same rows and columns with every secret in `text` replaced."""
    at = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]

    def per_batch(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([redact(t.as_py()) for t in columns[at]], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    plain = docs.toDF(*names)
    return plain.mapInArrow(per_batch, plain.schema).toDF(*docs.columns)


def op7_secret_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
