"""Substring dedup with a count-min prefilter.

A window is WINDOW consecutive words.  Every window is represented by its anchor: the GRAM-word sequence with the smallest
hash inside it.  Equal windows have equal anchors, so a window cannot occur in more documents than its anchor does.

1. Per document: its distinct anchors, in the row.  Documents that equal an earlier one word for word are copies: wholly
   covered, and left out of the counts, so a group of copies of any size adds nothing to them.
2. Count-min sketch: each anchor counts once a document in DEPTH rows of cells.  Partition sketches are merged by an
   aggregation with map-side combining; only whether a cell's count reached two is kept, as a bitmap of a bounded size
   (at most DEPTH * MAX_CELLS / 8 bytes), which is what the next pass gets.  Counts are never underestimated.
3. Second pass: only windows whose anchor is estimated repeated are emitted, as segments: runs of windows with one anchor.
   Segments are grouped exactly, and a segment that a smaller doc_id has too is removed as a whole.  A window can differ in
   its segment between two documents only where a match begins or ends, so only anchors with several different segments
   have their windows grouped one by one, each different segment once.  Keys are two 64-bit hashes of different texts.
4. Documents with removed windows are joined with their texts once more and cut.  All others take their result from step 1.

The sketch's width follows the number of anchors up to MAX_CELLS.  Beyond that it passes more windows to the exact step
and stays right.

Defined cases: null and short texts have no windows and keep all words; rows without doc_id neither remove nor lose words;
rows with equal doc_id do not remove each other's words; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchday.llm.common import pick, table, written

WINDOW, GRAM = 50, 20
DEPTH, CELLS_PER_ANCHOR, MIN_CELLS, MAX_CELLS, CHUNK = 2, 8, 1 << 16, 1 << 28, 1 << 15
SLICE = 4096  # windows handled at once, so that a very long text needs little memory


def spans_of(words: list[bytes]) -> tuple[bytes, list[int], list[int]]:
    """The words joined by single spaces, and where each starts and ends."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), (ends - lengths).tolist(), ends.tolist()


def anchors(words: list[bytes]) -> np.ndarray:
    """The anchor hash of every window, as signed 64-bit numbers."""
    joined, starts, ends = spans_of(words)
    digest = xxhash.xxh3_64_intdigest
    n = len(words) - GRAM + 1
    grams = np.fromiter((digest(joined[a:b]) for a, b in zip(starts[:n], ends[GRAM - 1:])), np.uint64, n)
    width = WINDOW - GRAM + 1
    slides = np.lib.stride_tricks.sliding_window_view(grams, width)
    return np.concatenate([slides[i:i + SLICE].min(axis=1) for i in range(0, len(slides), SLICE)]).view(np.int64)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, hash of the words, their number, SHA-256 of the joined words, distinct anchors."""
    schema = "doc_id bigint, text_hash bigint, h1 bigint, h2 bigint, n_words bigint, sha string, anchors array<bigint>"

    def per_batch(batches):
        for batch in batches:
            n, sha, marks, h = [], [], [], np.zeros((batch.num_rows, 2), np.uint64)
            for i, text in enumerate(batch.column(2)):
                words = (text.as_py() or b"").split()
                joined = b" ".join(words)
                whole = xxhash.xxh3_128_intdigest(joined)
                h[i] = whole >> 64, whole & 0xFFFFFFFFFFFFFFFF
                n.append(len(words))
                sha.append(hashlib.sha256(joined).hexdigest())
                marks.append(np.unique(anchors(words)) if len(words) >= WINDOW else np.zeros(0, np.int64))
            h = h.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(n, pa.int64()),
                 pa.array(sha, pa.string()), pa.array(marks, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "h1", "h2", "n_words", "sha", "anchors"])

    return docs.mapInArrow(per_batch, schema)


def cell_expr(row: int, cells: int) -> str:
    """Cell of an anchor in a row of the sketch.  Anchors are hashes already, so a row takes other bits of them."""
    return f"(shiftrightunsigned(anchor, {row * 32}) & {cells - 1}L)"


def sketch(marks: DataFrame, cells: int) -> list[bytes]:
    """One bitmap per row of the sketch: cells whose count is two or more.  Bounded: `cells` bits each."""
    rows = ", ".join(f"{r * cells}L + {cell_expr(r, cells)}" for r in range(DEPTH))
    repeated = (marks.selectExpr(f"explode(array({rows})) AS cell").groupBy("cell").agg(F.count("*").alias("n"))
                .where("n >= 2").selectExpr(f"cell div {CHUNK} AS chunk", f"CAST(cell % {CHUNK} AS INT) AS at"))

    def pack(batches):
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            owner, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(owner, kind="stable")
            names, first = np.unique(owner[order], return_index=True)
            for name, own in zip(names.tolist(), np.split(at[order], first[1:])):
                if name not in chunks:
                    chunks[name] = np.zeros(CHUNK, bool)
                chunks[name][own] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(chunks), pa.int64()), pa.array([np.packbits(b).tobytes() for b in chunks.values()], pa.binary())],
            ["chunk", "bits"])

    # a partition's share of the chunks is unpacked at once: few enough that it stays in some tens of MB
    parts = max(1, DEPTH * cells // CHUNK // 512)
    found = repeated.repartition(parts, "chunk").mapInArrow(pack, "chunk bigint, bits binary").toArrow()
    per_row = cells // CHUNK
    bitmap = np.zeros((DEPTH * per_row, CHUNK // 8), np.uint8)
    for chunk, bits in zip(found["chunk"].to_pylist(), found["bits"]):
        bitmap[chunk] = np.frombuffer(bits.as_buffer(), np.uint8)
    return [bitmap[r * per_row:(r + 1) * per_row].tobytes() for r in range(DEPTH)]


def candidates(docs: DataFrame, test) -> DataFrame:
    """Segments of windows whose anchor is estimated repeated: place, anchor, hash of the words, hash of each window."""
    schema = "doc_id bigint, text_hash bigint, at int, anchor bigint, segment bigint, windows array<bigint>"

    def per_batch(batches):
        digest = xxhash.xxh3_64_intdigest
        passes = test()
        for batch in batches:
            owner, places, marks, whole, each = [], [], [], [], []
            for i, text in enumerate(batch.column(2)):
                words = (text.as_py() or b"").split()
                if len(words) < WINDOW:
                    continue
                own = anchors(words)
                firsts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
                lasts = np.concatenate([firsts[1:], [len(own)]])
                ok = passes(own[firsts])
                if not ok.any():
                    continue
                joined, starts, ends = spans_of(words)
                for s, e in zip(firsts[ok].tolist(), lasts[ok].tolist()):
                    owner.append(i), places.append(s), marks.append(own[s])
                    whole.append(digest(joined[starts[s]:ends[e + WINDOW - 2]]))
                    each.append(np.array([digest(joined[a:b]) for a, b in zip(starts[s:e], ends[s + WINDOW - 1:e + WINDOW - 1])],
                                         np.uint64).view(np.int64))
            rows = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(places, pa.int32()),
                 pa.array(marks, pa.int64()), pa.array(np.array(whole, np.uint64).view(np.int64)),
                 pa.array(each, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "at", "anchor", "segment", "windows"])

    return docs.mapInArrow(per_batch, schema)


def covered(found: DataFrame) -> DataFrame:
    """doc_id, text_hash, at, n: n windows from at on that also start in a document with a smaller doc_id."""
    segments = written(found.groupBy("anchor", "segment").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")),
                       "segments")
    whole = (found.join(segments.where("least < most").drop("most"), ["anchor", "segment"]).where("least < doc_id")
             .select("doc_id", "text_hash", "at", F.size("windows").alias("n")))
    contested = segments.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    chosen = segments.join(contested, "anchor", "left_semi").select("anchor", "segment", F.col("least").alias("doc_id"))
    single = written(found.join(chosen, ["anchor", "segment", "doc_id"]).select(
        "doc_id", "text_hash", "at", "anchor", F.posexplode("windows").alias("step", "window")), "windows")
    least = (single.groupBy("anchor", "window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
             .where("least < most").drop("most"))
    rest = (single.join(least, ["anchor", "window"]).where("least < doc_id")
            .select("doc_id", "text_hash", (F.col("at") + F.col("step")).alias("at"), F.lit(1).alias("n")))
    return whole.unionByName(rest)


def cut_text(batches):
    """The words that no removed window covers: their number removed and the SHA-256 of the rest."""
    for batch in batches:
        total, removed, sha = [], [], []
        for text, at in zip(batch.column(1), batch.column(2)):
            words = (text.as_py() or b"").split()
            edge = np.zeros(len(words) + 1, np.int64)
            places = at.values.flatten()
            starts = np.asarray(places[0], np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + np.asarray(places[1], np.int64) + WINDOW - 1, -1)
            gone = np.cumsum(edge)[:-1] > 0
            total.append(len(words))
            removed.append(int(gone.sum()))
            sha.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist()) if not g)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, per document."""
    rows = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"),
                                               F.col("text").cast("binary").alias("text"))
    known = written(described(rows), "described")
    long = known.where(f"n_words >= {WINDOW} AND doc_id IS NOT NULL")
    firsts = long.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    flagged = long.join(firsts, ["h1", "h2"])
    marks = flagged.where("doc_id = first").select(F.explode("anchors").alias("anchor"))
    total = known.agg(F.sum(F.size("anchors"))).first()[0] or 0
    cells = min(MAX_CELLS, max(MIN_CELLS, 1 << max(1, CELLS_PER_ANCHOR * total).bit_length() - 1))
    shared = docs.sparkSession.sparkContext.broadcast(sketch(marks, cells))  # bounded by MAX_CELLS

    def test():
        rows_of = [np.frombuffer(x, np.uint8) for x in shared.value]

        def passes(own: np.ndarray) -> np.ndarray:
            ok = np.ones(len(own), bool)
            for r, bits in enumerate(rows_of):
                h = ((own.view(np.uint64) >> np.uint64(32 * r)) & np.uint64(cells - 1)).astype(np.int64)
                ok &= (bits[h >> 3] >> (7 - (h & 7)).astype(np.uint8)) & 1 == 1
            return ok

        return passes

    found = written(candidates(rows.where("doc_id IS NOT NULL"), test), "candidates")
    places = covered(found).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("at", "n")).alias("at"))
    copies = flagged.where("first < doc_id").select("doc_id", "text_hash").distinct().withColumn("copy", F.lit(True))
    touched = written(places.join(copies, ["doc_id", "text_hash"], "full").withColumn("copy", F.coalesce("copy", F.lit(False))),
                      "touched")
    partly = touched.where("NOT copy").select("doc_id", "text_hash", "at")
    cut = rows.join(partly, ["doc_id", "text_hash"]).select("doc_id", "text", "at").mapInArrow(
        cut_text, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    keys = touched.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "copy")
    whole = known.join(keys, known["doc_id"].eqNullSafe(keys["id"]) & (known["text_hash"] == keys["hash"]), "left")
    plain = whole.where("copy IS NULL OR copy").select(
        "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(0).alias("n_removed"),
        F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha")).alias("kept_sha256"))
    return plain.unionByName(cut)


def op8_count_min(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
