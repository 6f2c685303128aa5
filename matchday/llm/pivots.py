"""Embedding near-duplicates by a pivot-permutation index.

1. Vectors without a usable direction (null, zero, null or non-finite components) are set aside; equal vectors become one
   class with a count, so a group of copies of any size is one row.
2. Pivots are reference vectors drawn from a bounded sample and thinned until no two are close, so that a dense cluster
   has one pivot and its members do not pick independent ones.  A vector is described by its NEAREST nearest pivots; the
   pivots are the only thing sent to every task.
3. A pivot that stands for several sampled vectors is a hub.  A vector within COVER of a hub belongs to its nearest hub, and
   every vector that can be a partner of such a vector is in that hub's list too (the angles add up), so pairs with a
   vector at a hub are found without loss.  A pair is taken up only in the list of its smaller hub.
4. Vectors at no hub are compared by shared pivots.  Inverted lists are kept per pair of shared pivots, so being retrieved means sharing at least two pivots.  A list holds
   its vectors; a list with more than BLOCK members is divided into blocks and each pair of blocks is a task of its own.
5. Within a list the shared-pivot counts of all members come from one product of their pivot indicators.  A pair is
   taken up only in the list of its two smallest shared pivots, then verified by its cosine in double precision.
6. A list returns each member's number of verified partners and a spanning forest of its links, never the pairs.

Vectors at no hub whose dimension has too few pivots form one list of that dimension and are compared exactly, in blocks.

Defined cases: unusable vectors have no links and are components of their own; a null vec_id has no links, component or
kept; copies link with each other; rows repeating a vec_id count as vectors but share its component; an empty table gives
an empty result; further columns are ignored.  No vector is dropped: recall off the hubs depends on NEAREST and is measured in tests.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchday.llm.common import pick, table, written
from matchday.llm.components import components
from matchday.llm.simhash import runs

THRESHOLD = 0.95
NEAREST, MIN_PIVOTS, MAX_PIVOTS, BLOCK, SEED = 9, 64, 4096, 2048, 11
THIN = (0.8, 0.9)  # no two pivots are closer; the second if the first leaves too few pivots to rank
COVER, HUB = 0.93, 3  # cosine to a hub of the vectors that belong to it, and its members in the sample at least
EXACT = 0xFFFFF  # list of the vectors without ranked pivots
ENTRY = "list bigint, part long, cls bigint, n long, vec array<float>, near array<int>"


def classes(vectors: DataFrame) -> DataFrame:
    """vec_id, and for usable vectors their class key and values."""
    v = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(
        v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return pick(vectors, "vec_id", "embedding").select(
        "vec_id", F.coalesce(usable, F.lit(False)).alias("usable"), v.cast("array<float>").alias("vec"),
        F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(SEED), v).alias("h2"))


def thinned(sample: np.ndarray, most: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pivots of a sample of unit vectors, no two closer than `limit`, and which of them are hubs."""
    free, chosen = np.ones(len(sample), bool), []
    for i in range(len(sample)):
        if free[i] and len(chosen) < most:
            chosen.append(i)
            free &= sample @ sample[i] < limit
    own = sample @ sample[chosen].T
    members = np.bincount(own.argmax(axis=1)[own.max(axis=1) >= COVER], minlength=len(chosen))
    return sample[chosen], np.flatnonzero(members >= HUB)


def draw_pivots(distinct: DataFrame, n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Pivots and hubs by dimension, from a bounded sample by hash order; their number follows the root of the row count."""
    want = int(min(MAX_PIVOTS, max(MIN_PIVOTS, 1.5 * n ** 0.5)))
    rows = distinct.select("vec").orderBy(F.xxhash64(F.lit(SEED), "h1")).limit(min(MAX_PIVOTS, 4 * want)).collect()
    by_size = defaultdict(list)
    for (vec,) in rows:
        by_size[len(vec)].append(vec)
    out = {}
    for d, x in by_size.items():
        sample = np.array(x, np.float64)
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        for limit in THIN:
            out[d] = thinned(sample, want, limit)
            if len(out[d][0]) > NEAREST:
                break
    return out


def matrix(column, rows: int) -> np.ndarray:
    """A list column whose lists have one length, as an array of `rows` rows."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in chunks])
    return flat.reshape(rows, -1) if len(flat) else np.zeros((rows, 0))


def index_entries(pivots: dict[int, tuple[np.ndarray, np.ndarray]], threshold: float):
    """Rows of the lists of each vector: of the hubs in reach, and of its pairs of near pivots if it is at no hub."""
    pairs = np.array(list(combinations(range(NEAREST), 2)))
    # a vector at a hub and its partner: their angles to the hub differ by no more than the angle between them
    reach = math.cos(min(math.pi, math.acos(COVER) + math.acos(max(-1.0, min(1.0, threshold))))) - 1e-6

    def entries(batch, rows, lists, near):
        take = batch.take(pa.array(rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(lists, pa.int64()), pa.array(np.zeros(len(rows), np.int64)), take.column(0), take.column(1),
             take.column(2).cast(pa.list_(pa.float32())),
             pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * near.shape[1], near.astype(np.int32).ravel())],
            ["list", "part", "cls", "n", "vec", "near"])

    def per_batch(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_numpy()
            for size in np.unique(sizes).tolist():
                at, base = np.flatnonzero(sizes == size), size << 40
                marks, hubs = pivots.get(size, (np.zeros((0, size)), np.zeros(0, np.int64)))
                if len(marks):
                    values = matrix(batch.column(2).take(pa.array(at)), len(at)).astype(np.float64)
                    cosines = values @ marks.T / np.linalg.norm(values, axis=1)[:, None]
                if len(hubs):
                    best = cosines[:, hubs].argmax(axis=1)
                    home = np.where(cosines[np.arange(len(at)), hubs[best]] >= COVER, hubs[best], -1)
                    row, hub = np.nonzero(cosines[:, hubs] >= reach)
                    yield entries(batch, at[row], base + (hubs[hub] << 20) + hubs[hub], home[row][:, None])
                    at, cosines = at[home < 0], cosines[home < 0]
                if not len(at):
                    continue
                if len(marks) > NEAREST:
                    near = np.sort(np.argpartition(-cosines, NEAREST, axis=1)[:, :NEAREST], axis=1)
                    lists = base + (near[:, pairs[:, 0]] << 20) + near[:, pairs[:, 1]]
                else:
                    near, lists = np.zeros((len(at), 0), int), np.full((len(at), 1), base + EXACT)
                yield entries(batch, np.repeat(at, lists.shape[1]), lists.ravel(), np.repeat(near, lists.shape[1], axis=0))

    return per_batch


def spanning(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph between two blocks; each member's row is looked at once."""
    same = left is right
    rows = (hit, hit if same else np.ascontiguousarray(hit.T))
    names = (left, right)
    fresh = [np.ones(len(left), bool), np.ones(len(right), bool)]
    if same:
        fresh[1] = fresh[0]
    links = []
    for start in np.flatnonzero(hit.any(axis=1)).tolist():
        if not fresh[0][start]:
            continue
        fresh[0][start] = False
        stack = [(0, start)]
        while stack:
            side, i = stack.pop()
            new = np.flatnonzero(rows[side][i] & fresh[1 - side])
            fresh[1 - side][new] = False
            own, others = int(names[side][i]), names[1 - side][new].tolist()
            links.extend((own, j) for j in others)
            stack.extend((0 if same else 1 - side, j) for j in new.tolist())
    return links


def compare(lists: int, cls, n, vecs, near, left: np.ndarray, right: np.ndarray, threshold: float):
    """Partner counts and forest links between two blocks of one list (or within one, if both are the same)."""
    same = left is right
    unit = vecs / np.sqrt((vecs * vecs).sum(axis=1))[:, None]
    hit = (unit[left] @ unit[right].T) >= threshold
    if same:
        np.fill_diagonal(hit, False)
    p, q = (lists >> 20) & 0xFFFFF, lists & 0xFFFFF
    if near.shape[1] == 1:
        home = np.where(near[:, 0] < 0, EXACT, near[:, 0])
        hit &= np.minimum(home[left][:, None], home[right][None, :]) == p  # else the pair belongs to another hub, or to none
    elif near.shape[1]:
        before = np.where((near < q) & (near != p), near, -1)
        names, coded = np.unique(before, return_inverse=True)
        marks = np.zeros((len(vecs), len(names)), np.float32)
        np.put_along_axis(marks, coded.reshape(before.shape), 1, axis=1)
        marks[:, names == -1] = 0
        hit &= (marks[left] @ marks[right].T) == 0  # else the pair belongs to a list of smaller pivots
    counts = defaultdict(int)
    for i, x in zip(left.tolist(), (hit @ n[right]).tolist()):
        counts[i] += x
    if not same:
        for i, x in zip(right.tolist(), (hit.T @ n[left]).tolist()):
            counts[i] += x
    return [(cls[i], x) for i, x in counts.items() if x], [(cls[i], cls[j]) for i, j in spanning(hit, left, right)]


def list_links(threshold: float):
    """(cls, other, n): partner counts have no `other`, links have no `n`."""
    def per_partition(batches):
        for part in runs(batches, "list"):
            lists, tasks = part.column("list").to_numpy(), part.column("part").to_numpy()
            block = part.column("block").to_numpy()
            cuts = np.flatnonzero((np.diff(lists) != 0) | (np.diff(tasks) != 0)) + 1
            a, b, c = [], [], []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lists)]):
                if e - s < 2:
                    continue
                own = part.slice(s, e - s)
                cls, n = own.column("cls").to_numpy(), own.column("n").to_numpy().astype(np.float64)
                vecs = matrix(own.column("vec"), e - s).astype(np.float64)
                near = matrix(own.column("near"), e - s).astype(np.int64)
                kinds = np.unique(block[s:e])
                left = np.flatnonzero(block[s:e] == kinds[0])
                low, high = tasks[s] >> 20, tasks[s] & 0xFFFFF
                if low != high and len(kinds) < 2:
                    continue
                right = left if low == high else np.flatnonzero(block[s:e] == kinds[1])
                counts, links = compare(int(lists[s]), cls, n, vecs, near, left, right, threshold)
                for x, y in counts:
                    a.append(x), b.append(None), c.append(int(round(y)))
                for x, y in links:
                    a.append(x), b.append(y), c.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())],
                                             ["cls", "other", "n"])

    return per_partition


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept, per row."""
    rows = classes(vectors)
    distinct = written(rows.where("usable").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("cls"), F.count("*").alias("n"), F.first("vec").alias("vec")), "vectors")
    pivots = draw_pivots(distinct, distinct.count())
    entries = distinct.select("cls", "n", "vec").mapInArrow(index_entries(pivots, threshold), ENTRY)
    # lists with more than BLOCK members: each pair of blocks is compared apart; a member goes to the tasks of its block
    long_lists = (entries.groupBy("list")
                  .agg(F.count("*").alias("m")).where(F.col("m") > BLOCK)
                  .select("list", F.ceil(F.col("m") / BLOCK).cast("long").alias("blocks")))
    dealt = (entries.drop("part").join(written(long_lists, "long_lists"), "list", "left")
             .withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
             .withColumn("block", F.expr("pmod(xxhash64(cls), blocks)"))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .withColumn("part", F.expr("shiftleft(least(block, other), 20) | greatest(block, other)"))
             .drop("blocks", "other"))
    keyed = dealt.repartition("list", "part").sortWithinPartitions("list", "part")
    found = written(keyed.select("list", "part", "block", "cls", "n", "vec", "near")
                    .mapInArrow(list_links(threshold), "cls bigint, other bigint, n bigint"), "links")
    partners = found.where("n IS NOT NULL").groupBy("cls").agg(F.sum("n").alias("partners"))
    roots = components(found.where("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    named = (distinct.select("h1", "h2", "cls", "n").join(partners, "cls", "left")
             .join(roots.withColumnRenamed("node", "cls"), "cls", "left")
             .select("h1", "h2", (F.col("n") - 1 + F.coalesce("partners", F.lit(0))).alias("links"),
                     F.coalesce("root", "cls").alias("root")))
    good = rows.where("usable").select("vec_id", "h1", "h2").join(named, ["h1", "h2"])
    rest = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("root"))
    return good.select("vec_id", "links", "root").unionByName(rest).select(
        "vec_id", F.col("links").alias("n_links"), F.col("root").alias("component_id"),
        (F.col("vec_id") == F.col("root")).alias("kept"))


def op10_pivot_permutation(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
