"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pairwise term is computed in linear time as
half of |sum_i v_i x_i|^2 - sum_i |v_i x_i|^2.  Inputs are hashed words (log frequency a slot, unit length) and statistics of the
text's structure, each cut into ten bins at quantiles of the training sample.  Language, source, ids and labels are never
inputs.

The model is fitted on at most MAX_TRAIN labelled rows (a documented bound: those with the smallest hash of their doc_id
among the rows that are not held out).  Their ids are the only thing sent to the join with the documents, so no text is
shuffled; every document of the corpus is scored on its whole text.

Defined cases: a null text is an empty one, and gets a score like any other; a null doc_id is not held out and not used
for training; a doc_id with several labels counts with the smallest; without labels of both kinds every score is the share
of label 1 (one half if there are none); repeated rows get equal scores; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq, methodcaller

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchday.llm.common import pick, table

MAX_TRAIN = 6000
HASH_BITS, FACTORS, BINS = 12, 6, 10
EPOCHS, RATE, DECAY, BATCH, SEED = 12, 0.15, 2e-4, 64, 5
THRESHOLD = 0.7
HELD_OUT = "coalesce(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2, false)"
SYMBOLS = list(b"#*$%&|<>")
SPACE, ODD = np.zeros(256, bool), np.zeros(256, bool)
SPACE[list(b" \t\n\x0b\f\r")] = True
ODD[33:127] = [not (chr(c).isalnum() or chr(c) in ".,;:") for c in range(33, 127)]
ENCODE = methodcaller("encode", "utf-8", "replace")
STATISTICS = 14


def describe(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Structure statistics, hashed word positions and their weights."""
    words = text.split()
    n, counts = len(words), Counter(text.lower().split())
    lines = [x for x in text.split("\n") if x.strip()]
    raw = np.frombuffer(text.encode("utf-8", "replace") + b" ", np.uint8)
    seen = np.bincount(raw, minlength=256)
    upper, lower, digits = int(seen[65:91].sum()), int(seen[97:123].sum()), int(seen[48:58].sum())
    letters = upper + lower + int(seen[192:].sum())  # a lead byte stands for a letter beyond ASCII
    lengths, same = len(text) - int(seen[SPACE].sum()) + 1, sum(map(eq, words, words[1:]))
    odd = int((ODD[raw[:-1]] & SPACE[raw[1:]]).sum())  # words that end in an unusual sign
    many, chars = max(1, n), max(1, len(text))
    stats = np.array([
        np.log1p(n), lengths / many, int(seen[SYMBOLS].sum()) / many, upper / max(1, letters), digits / chars,
        int(seen[33] + seen[63]) / many, len(counts) / many, max(counts.values(), default=0) / many,
        1 - len(set(lines)) / max(1, len(lines)), len(lines) / many, odd / many, same / max(1, n - 1), letters / chars,
        int(seen[124]) / many])
    crc, mask = zlib.crc32, (1 << HASH_BITS) - 1
    slots = np.fromiter((crc(w) & mask for w in map(ENCODE, counts)), np.int64, len(counts))
    total = np.bincount(slots, np.fromiter(counts.values(), np.float64, len(counts)), minlength=1 << HASH_BITS)
    at = np.flatnonzero(total)  # at most 2 ** HASH_BITS inputs, however long the text
    weight = np.log1p(total[at])
    norm = np.sqrt((weight * weight).sum())
    return stats, at, weight / norm if norm else weight


class FactorisationMachine:
    def __init__(self, edges: np.ndarray, prior: float):
        self.edges = edges  # STATISTICS x (BINS - 1)
        size = (1 << HASH_BITS) + STATISTICS * BINS
        rng = np.random.default_rng(SEED)
        self.bias, self.w = float(np.log(prior / (1 - prior))), np.zeros(size)
        self.v = rng.normal(0, 0.05, (size, FACTORS))

    def inputs(self, stats, at, weight):
        bins = np.array([np.searchsorted(e, x) for e, x in zip(self.edges, stats)])
        return np.concatenate([(1 << HASH_BITS) + np.arange(STATISTICS) * BINS + bins, at]), np.concatenate(
            [np.full(STATISTICS, 0.5), weight])

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        total = vx.sum(axis=0)
        margin = self.bias + self.w[at] @ x + 0.5 * ((total * total).sum() - (vx * vx).sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> FactorisationMachine:
        """Mini-batches of logistic loss with per-weight step sizes (AdaGrad); the order is seeded."""
        rng = np.random.default_rng(SEED)
        size = len(self.w)
        sum_w, sum_v, sum_b = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for s in range(0, len(order), BATCH):
                picked = order[s:s + BATCH]
                at = np.concatenate([rows[i][0] for i in picked])
                x = np.concatenate([rows[i][1] for i in picked])
                cut = np.cumsum([0, *[len(rows[i][0]) for i in picked[:-1]]])
                doc = np.repeat(np.arange(len(picked)), [len(rows[i][0]) for i in picked])
                vx = self.v[at] * x[:, None]
                total = np.add.reduceat(vx, cut)
                square = np.add.reduceat((vx * vx).sum(axis=1), cut)
                margin = self.bias + np.add.reduceat(self.w[at] * x, cut) + 0.5 * ((total * total).sum(axis=1) - square)
                slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[picked]) / len(picked)
                gx = slope[doc] * x
                touched, where = np.unique(at, return_inverse=True)
                gw = np.bincount(where, gx) + DECAY * self.w[touched]
                gv = np.stack([np.bincount(where, gx * (total[doc, f] - vx[:, f])) for f in range(FACTORS)], axis=1)
                gv += DECAY * self.v[touched]
                sum_w[touched] += gw * gw
                sum_v[touched] += gv * gv
                sum_b += slope.sum() ** 2
                self.w[touched] -= RATE * gw / np.sqrt(sum_w[touched])
                self.v[touched] -= RATE * gv / np.sqrt(sum_v[touched])
                self.bias -= RATE * slope.sum() / np.sqrt(sum_b)
        return self


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Label and description of at most MAX_TRAIN documents that are not held out."""
    order = F.xxhash64(F.lit(SEED), "doc_id")
    chosen = (pick(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)").where(f"NOT {HELD_OUT}")
              .groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(order, "doc_id").limit(MAX_TRAIN))
    texts = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most MAX_TRAIN ids

    def per_batch(batches):
        for batch in batches:
            found = [describe(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0].tolist() for f in found], pa.list_(pa.float64())),
                 pa.array([f[1].tolist() for f in found], pa.list_(pa.int32())),
                 pa.array([f[2].tolist() for f in found], pa.list_(pa.float32()))], ["doc_id", "y", "stats", "at", "x"])

    described = texts.select("doc_id", F.col("quality").cast("double").alias("y"), "text").mapInArrow(
        per_batch, "doc_id bigint, y double, stats array<double>, at array<int>, x array<float>")
    return described.orderBy(order, "doc_id", "y").limit(MAX_TRAIN)  # repeated ids cannot exceed the bound


def fit(docs: DataFrame, labels: DataFrame) -> FactorisationMachine | float:
    """The machine, or the share of label 1 where the labels cannot tell anything apart."""
    rows = training_rows(docs, labels).toArrow()
    y = np.asarray(rows["y"])
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    stats = np.array(rows["stats"].to_pylist())
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    for e, column in zip(edges, stats.T):  # defects are rare, so the upper end gets finer bins
        e[-3:] = np.quantile(column, [0.9, 0.96, 0.99])
    machine = FactorisationMachine(np.sort(edges, axis=1), float(np.clip(y.mean(), 0.01, 0.99)))
    inputs = [machine.inputs(s, np.asarray(a, np.int64), np.asarray(x, np.float64))
              for s, a, x in zip(stats, rows["at"].to_pylist(), rows["x"].to_pylist())]
    return machine.fit(inputs, y)


def scored(texts: DataFrame, model: FactorisationMachine | float) -> DataFrame:
    """All columns of `texts` but the last, which is the text, and the score."""
    width = len(texts.columns) - 1

    def per_batch(batches):
        for batch in batches:
            if isinstance(model, float):
                scores = np.full(batch.num_rows, model)
            else:
                scores = np.fromiter((model.score(*model.inputs(*describe(t.as_py() or ""))) for t in batch.column(width)),
                                     np.float64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(scores)], [*batch.schema.names[:width], "score"])

    kept = texts.select(texts.columns[:width]).schema.add("score", "double")
    return texts.mapInArrow(per_batch, kept)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, per document."""
    model = fit(docs, labels)
    rows = pick(docs, "doc_id", "text").select("doc_id", F.expr(HELD_OUT).alias("held_out"), "text")
    return scored(rows, model).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier accepts, with all their columns."""
    model = fit(docs, labels)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    good = scored(plain.withColumn("text", F.col(f"c{docs.columns.index('text')}")), model)
    return good.where(F.col("score") >= THRESHOLD).drop("score").toDF(*docs.columns)


def op9_factorisation_machine(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
