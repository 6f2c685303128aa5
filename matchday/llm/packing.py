"""Packing documents into sequences by cutting-stock column generation.

1. Texts become token ids in place and are cut into pieces: whole sequences, and one shorter rest.  A piece carries its
   place, its length and the CRC-32 of its ids (and the ids on request); nothing else is moved.
2. Lengths fall into classes of UNIT tokens.  The histogram, at most MAX_TOKENS / UNIT rows, is all the driver sees.
3. The driver solves the linear program "cover every class's count with as few patterns as possible": the simplex method
   prices new patterns by a knapsack dynamic program over the dual values until none improves.  Patterns are rounded down,
   and what is left (less than one sequence a class) is packed first-fit in decreasing size.
4. Pieces are ranked within their class by salted groups with offsets, so that a class with most of the pieces is not one
   task, and each rank finds its pattern by a binary search in a table of a few thousand entries at most.

Ids are those of the `tokenizers` file; the same vocabulary in `tiktoken` form gives equal ids (tested) several times
faster.  The text of the special token counts as that token, as in the former.

Defined cases: a null text is empty and is one piece holding the end id alone; repeated rows are packed once each; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchday.llm.common import pick, table, written

MAX_TOKENS, UNIT, END_ID = 2048, 16, 1
RANKS_FILE, SPECIAL = "byte_bpe_50k.tiktoken", {"<|endoftext|>": 50256}
GAP = 1e-3
ROWS_PER_SALT, MIN_SALTS = 50_000, 64


def encoder(path: str | None = None):
    """Text to token ids; `path` names a vocabulary in tiktoken form."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(RANKS_FILE), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def encode(text: str) -> list[int]:
        if any(s in text for s in SPECIAL):
            return own.encode(text, allowed_special="all")
        return own.encode_ordinary(text)

    return encode


def pieces(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids

    def per_partition(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            owner, start, length, crc, total, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                own = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                for s in range(0, len(own), MAX_TOKENS):
                    part = own[s:s + MAX_TOKENS]
                    owner.append(i), start.append(s), length.append(len(part)), total.append(len(own))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return pick(docs, "doc_id", "text").mapInArrow(per_partition, schema)


def best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes (ascending) within the capacity: unbounded knapsack."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = fitting[c]
        if k:
            worth = best[c - sizes[:k]] + value[:k]
            i = int(worth.argmax())
            if worth[i] > best[c] + 1e-12:
                best[c], taken[c] = worth[i], i
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            pattern[taken[c]] += 1
            c -= int(sizes[taken[c]])
    return float(best[capacity]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Basic patterns (columns) and their real multiplicities in a solution of the covering program.

    The objective divided by the best pattern's worth is a lower bound, so pricing stops within GAP of the optimum.
    """
    patterns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(patterns))
    x = inverse @ demand
    for _ in range(20 * len(sizes) + 100):
        value, new = best_pattern(sizes, np.maximum(inverse.sum(axis=0), 0), capacity)
        if value <= 1 + GAP:
            break
        direction = inverse @ new
        ratio = np.full(len(x), np.inf)
        np.divide(x, direction, out=ratio, where=direction > 1e-6)
        r = int(ratio.argmin())
        step_size = max(ratio[r], 0.0)
        x = np.maximum(x - step_size * direction, 0)
        x[r] = step_size
        patterns[:, r] = new
        row = inverse[r] / direction[r]
        inverse -= np.outer(direction, row)
        inverse[r] = row
    return patterns, x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(size class -> pieces, number of sequences) that hold exactly the histogram's pieces."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    left = np.array([histogram[s] for s in sizes.tolist()])
    patterns, x = column_generation(sizes, left.astype(float), capacity)
    out = []
    for p in np.argsort(-x, kind="stable").tolist():
        a = patterns[:, p].astype(int)
        times = int(min(np.floor(x[p] + 1e-6), *(left[i] // a[i] for i in np.flatnonzero(a))))
        if times:
            left = left - times * a
            out.append(({int(sizes[i]): int(a[i]) for i in np.flatnonzero(a)}, times))
    # what rounding left over: first fit, largest first, many equal pieces at a time
    bins: list[tuple[int, dict[int, int]]] = []
    for i in reversed(range(len(sizes))):
        size, n = int(sizes[i]), int(left[i])
        for b, (room, content) in enumerate(bins):
            k = min(n, room // size)
            if k:
                content[size] = content.get(size, 0) + k
                bins[b], n = (room - k * size, content), n - k
        while n:
            k = min(n, capacity // size)
            if n >= k and k * size + size > capacity:  # whole bins of this size at once
                times = n // k
                if times > 1:
                    out.append(({size: k}, times - 1))
                    n -= (times - 1) * k
            k = min(n, capacity // size)
            bins.append((capacity - k * size, {size: k}))
            n -= k
    return out + [(content, 1) for _, content in bins]


@dataclass
class Places:
    """For one size class: rank ranges, pieces a sequence, first sequence and first slot."""
    upto: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    slot: np.ndarray


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, Places]:
    rows: dict[int, list[tuple[int, int, int, int, int]]] = {}
    sequence = 0
    for content, times in patterns:
        slot = 0
        for size, each in sorted(content.items(), reverse=True):
            own = rows.setdefault(size, [])
            first = own[-1][0] if own else 0
            own.append((first + times * each, first, each, sequence, slot))
            slot += each
        sequence += times
    return {size: Places(*map(np.array, zip(*own))) for size, own in rows.items()}


def ranked(cut: DataFrame) -> DataFrame:
    """Pieces with their rank within their size class."""
    salts = max(MIN_SALTS, cut.count() // ROWS_PER_SALT)
    keyed = cut.withColumn("size", F.ceil(F.col("length") / UNIT).cast("int")).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = keyed.groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = counts.select("size", "salt", (F.sum("n").over(W.partitionBy("size").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("size", "salt").orderBy("doc_id", "start", "ids_crc32"))
    return keyed.withColumn("own", own).join(before, ["size", "salt"]).withColumn(
        "rank", F.col("before") + F.col("own") - 1).drop("salt", "own", "before")


def pack(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset (and ids), per piece."""
    cut = written(pieces(docs, tokenizer, with_ids), "pieces")
    names = cut.columns
    histogram = {r["size"]: r["n"] for r in cut.groupBy(F.ceil(F.col("length") / UNIT).cast("int").alias("size"))
                 .agg(F.count("*").alias("n")).collect()}  # at most MAX_TOKENS / UNIT rows
    where = places(plan(histogram, MAX_TOKENS // UNIT))

    def assign(batches):
        for batch in batches:
            sizes, ranks = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes).tolist():
                at, p = np.flatnonzero(sizes == size), where[size]
                i = np.searchsorted(p.upto, ranks[at], side="right")
                inside = ranks[at] - p.first[i]
                sequence[at] = p.sequence[i] + inside // p.each[i]
                slot[at] = p.slot[i] + inside % p.each[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(slot)],
                                             [*names, "sequence_id", "slot"])

    schema = cut.schema.add("sequence_id", "long").add("slot", "long")
    dealt = ranked(cut).select(*names, "size", "rank").mapInArrow(assign, schema)
    filled = F.sum("length").over(W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1))
    return dealt.withColumn("offset", F.coalesce(filled, F.lit(0))).drop("slot")


def op6_cutting_stock(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
