"""SimHash near-duplicates with BK-trees.

1. A fingerprint per document: the bitwise majority of the XXH64 hashes of its three-word shingles, made inside the row.
2. Only distinct fingerprints go on; copies are one row each from here, whatever their number.
3. Fingerprints at Hamming distance two or less agree in at least two of four 16-bit blocks.  Each fingerprint is sent to
   the six shards named by two of its blocks; a shard with more than MAX_SHARD members is divided once more by two of
   four 8-bit blocks of the other 32 bits, which loses no pair for the same reason.
4. Each shard is a BK-tree: a node's children are keyed by their integer distance to it, and a search follows only edges
   within the radius.  Trees are made where the shuffle brings the shard together instead of being broadcast, because
   their total size grows with the data and no bound for a broadcast could be given.  A shard gives a spanning forest of
   its links, never all pairs.
5. Links become components by star contraction, and components get their smallest doc_id.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; a text of one or two words is
one shingle; repeated rows fall in one component; rows without doc_id join a component without naming it (its id is null
only if no member has one); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchday.llm.common import LOWER, UPPER, pick, table, written
from matchday.llm.components import components

SHINGLE, RADIUS, SEED, MAX_SHARD = 3, 2, 42, 4096
PAIRS = list(combinations(range(4), 2))
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    planes = hashes.view(np.uint8).reshape(len(hashes), 8)
    # votes per bit, from a histogram of each of the eight bytes
    votes = np.concatenate([np.bincount(planes[:, i], minlength=256) @ BITS for i in range(8)])
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").translate(LOWERED).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    count = len(words) - width + 1
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:count].tolist(), ends[width - 1:].tolist())),
                         np.uint64, count)
    return majority(hashes)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text hash and signed 64-bit fingerprint, per row."""
    rows = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"),
                                               F.col("text").cast("binary").alias("text"))

    def per_batch(batches):
        for batch in batches:
            marks = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks.view(np.int64))],
                                             ["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(per_batch, "doc_id bigint, text_hash bigint, fp bigint")


class BkTree:
    """Nodes hold their children by distance, so that a search skips every subtree outside the radius."""

    def __init__(self, radius: int):
        self.radius, self.marks, self.children = radius, [], []

    def add(self, mark: int) -> list[int]:
        """Insert, and return the positions of earlier marks within the radius."""
        marks, children, radius = self.marks, self.children, self.radius
        found, stack = [], [0] if marks else []
        while stack:
            at = stack.pop()
            d = (marks[at] ^ mark).bit_count()
            if d <= radius:
                found.append(at)
            for key, child in children[at].items():
                if d - radius <= key <= d + radius:
                    stack.append(child)
        at = 0
        while marks:
            d = (marks[at] ^ mark).bit_count()
            if d not in children[at]:
                children[at][d] = len(marks)
                break
            at = children[at][d]
        marks.append(mark)
        children.append({})
        return found


def forest(marks: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the marks within the radius of each other."""
    tree, parent, links = BkTree(RADIUS), [], []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, mark in enumerate(marks.view(np.uint64).tolist()):
        parent.append(i)
        for j in tree.add(mark):
            a, b = find(i), find(j)
            if a != b:
                parent[a] = b
                links.append((i, j))
    return links


def runs(batches, key: str):
    """Whole runs of equal keys of a sorted stream, as lists of tables; a run may span batches."""
    held = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        if held is not None:
            part = pa.concat_tables([held, part])
        keys = part.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if last:
            yield part.slice(0, last)
        held = part.slice(last)
    if held is not None and held.num_rows:
        yield held


def shard_links(batches):
    """Links within each shard, from (shard, fp) rows sorted by shard."""
    for part in runs(batches, "shard"):
        shards, marks = part.column("shard").to_numpy(), part.column("fp").to_numpy()
        cuts = np.flatnonzero(np.diff(shards)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(shards)]])
        a, b = [], []
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            own = marks[s:e]
            for i, j in forest(own):
                a.append(own[i])
                b.append(own[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def shards(marks: DataFrame) -> DataFrame:
    """(shard, fp) rows: two equal 16-bit blocks name a shard; full shards are divided by 8-bit blocks of the rest."""
    block = lambda i, width, base=0: f"(shiftrightunsigned(fp, {base + i * width}) & {2 ** width - 1})"
    first = ", ".join(f"shiftleft({n}L, 32) | shiftleft({block(i, 16)}, 16) | {block(j, 16)}" for n, (i, j) in enumerate(PAIRS))
    level = marks.selectExpr("fp", f"explode(array({first})) AS shard")
    full = level.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > MAX_SHARD).select("shard")

    def divided() -> DataFrame:
        rest = {n: [k for k in range(4) if k not in pair] for n, pair in enumerate(PAIRS)}
        bytes_of = {n: [block(h, 8, 16 * k) for k in rest[n] for h in range(2)] for n in rest}
        pieces = lambda n: ", ".join(
            f"xxhash64(shard, {m}, {bytes_of[n][i]}, {bytes_of[n][j]})" for m, (i, j) in enumerate(PAIRS))
        cases = " ".join(f"WHEN {n} THEN array({pieces(n)})" for n in rest)
        return level.join(full, "shard", "left_semi").selectExpr(
            "fp", f"explode(CASE shiftright(shard, 32) {cases} END) AS shard")

    return level.join(full, "shard", "left_anti").select("shard", "fp").unionByName(divided().select("shard", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp and component_id, per row."""
    marked = written(fingerprints(docs), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    keyed = shards(distinct.select("fp")).repartition("shard").sortWithinPartitions("shard")
    roots = components(keyed.mapInArrow(shard_links, "a bigint, b bigint"))
    members = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    names = members.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = members.join(names, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp")


def keep_one(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row of each component, with all columns of `docs`: the smallest doc_id, then the smallest text hash.

    `found` has doc_id, text_hash and root per row; without it, components are those of the fingerprints.
    """
    found = near_duplicates(docs) if found is None else found
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    chosen = written(found.groupBy("root").agg(F.min(order).alias("o")).select(
        F.col("o.doc_id").alias("id"), F.col("o.text_hash").alias("hash")), "chosen")
    at = {name: f"c{docs.columns.index(name)}" for name in ("doc_id", "text")}
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    keyed = plain.withColumns({"id": F.col(at["doc_id"]), "hash": F.xxhash64(at["text"])})
    same = keyed["id"].eqNullSafe(chosen["id"]) & (keyed["hash"] == chosen["hash"])
    kept = keyed.join(chosen, same, "left_semi").dropDuplicates(["id", "hash"])  # equal rows with equal ids
    return kept.drop("id", "hash").toDF(*docs.columns)


def op5_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    mark = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", mark.alias("fingerprint"), "component_id")
