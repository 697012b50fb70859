"""Operator 10, quality classifier: a factorisation machine over hashed words, structure and size.

A text becomes a sparse vector: its distinct words and their shapes, hashed; statistics of its structure;
and metadata of the text itself (its size and its share of plain ASCII). The machine scores
w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, where the pair sum is found in linear time as half of
sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). It is trained with AdaGrad on at most TRAIN_ROWS labelled
documents of at most TRAIN_FEATURES features, chosen by the hash of their ids; every document is scored
where it lies.
"""

from __future__ import annotations

import re
from math import log1p, sqrt
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, map_rows, release
from .quality_rules import COUNTS, text_counts

BUCKETS, RANK, EPOCHS, BATCH = 1 << 15, 4, 10, 128
#: Labelled documents that the machine learns from: at most so many, the smallest by hash of their ids,
#: with at most so many features together (8 bytes each, on the driver).
TRAIN_ROWS, TRAIN_FEATURES = 12_000, 12_000_000
#: Every FOLDS-th document by checksum of its id is held out.
FOLDS = 5
THRESHOLD = 0.3
STATS = 16
WIDTH = BUCKETS + STATS
_LETTERS, _FIGURES = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+")
_CACHE = 300_000


class Buckets(dict):
    """Word -> the buckets of the word and of its shape (letters and digits collapsed)."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= _CACHE:
            self.clear()
        low = word.lower()
        shape = _FIGURES.sub(b"9", _LETTERS.sub(b"a", low))
        if word.isupper():
            shape = shape.upper()
        self[word] = pair = crc32(low) % BUCKETS, crc32(b"\0" + shape) % BUCKETS
        return pair


def vector(text: str | None, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text; an empty one has its statistics alone."""
    text = text or ""
    counts = dict(zip(COUNTS, text_counts(text), strict=True))
    data = text.encode()
    words = data.split()
    pairs = [buckets[w] for w in set(words)]
    hashed = np.unique(np.array(pairs, np.int64).ravel()) if pairs else np.zeros(0, np.int64)
    n, chars, lines = max(1, counts["n_words"]), max(1, counts["word_chars"]), max(1, counts["n_lines"])
    stats = [
        min(1.0, 2 * counts["n_symbols"] / chars),
        min(1.0, counts["n_marks"] / n),
        counts["n_capitals"] / chars,
        counts["n_dup_lines"] / lines,
        counts["n_repeat_words"] / n,
        counts["n_doubles"] / n,
        len(set(words)) / n,
        min(1.0, chars / n / 20),
        min(1.0, log1p(n) / 10),
        min(1.0, log1p(lines) / 6),
        min(1.0, n / lines / 200),
        float(n < 10),
        float(not words),
        min(1.0, log1p(len(data)) / 14),  # metadata: size
        len(text) / max(1, len(data)),  # metadata: share of one-byte characters
        min(1.0, text.count("|") * 4 / n),
    ]
    index = np.concatenate((hashed, np.arange(BUCKETS, WIDTH)))
    return index, np.concatenate((np.full(len(hashed), 1 / sqrt(max(1, len(hashed)))), stats)).astype(np.float32)


class Machine:
    """The factorisation machine's parameters; predict() and its gradient share forward()."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(WIDTH, np.float32)
        self.v = rng.normal(0, 0.05, (WIDTH, RANK)).astype(np.float32)

    def forward(self, rows: list) -> tuple:
        index = np.concatenate([r[0] for r in rows])
        x = np.concatenate([r[1] for r in rows])
        starts = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
        vx = self.v[index] * x[:, None]
        s = np.add.reduceat(vx, starts)
        y = self.w0 + np.add.reduceat(self.w[index] * x, starts) + 0.5 * (s * s - np.add.reduceat(vx * vx, starts)).sum(1)
        return index, x, vx, s, 1 / (1 + np.exp(-np.clip(y.astype(np.float64), -30, 30)))

    def predict(self, rows: list) -> np.ndarray:
        return self.forward(rows)[-1] if rows else np.zeros(0)

    def fit(self, rows: list, labels: np.ndarray, rate: float = 0.1, penalty: float = 1e-5, seed: int = 7) -> Machine:
        if not rows:
            return self
        rng = np.random.default_rng(seed)
        gw0, gw, gv = 1e-6, np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                take = order[at : at + BATCH]
                batch = [rows[i] for i in take]
                index, x, vx, s, p = self.forward(batch)
                g = (p - labels[take]) / len(take)
                each = np.repeat(np.arange(len(batch)), [len(r[0]) for r in batch])
                e = (g[each] * x).astype(np.float32)
                used, place = np.unique(index, return_inverse=True)
                dw = np.bincount(place, e, len(used)) + penalty * self.w[used]
                pull = e[:, None] * (s[each] - vx)
                dv = np.stack([np.bincount(place, pull[:, f], len(used)) for f in range(RANK)], 1) + penalty * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
                gw0 += g.sum() ** 2
                self.w0 -= rate * g.sum() / sqrt(gw0)
        return self


def held_out(doc_id) -> F.Column:
    """Whether a document is held out; a null id is not (and never has a label)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, features: int = TRAIN_FEATURES, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Learn from the labelled documents that aren't held out, at most `most` of them.

    Labels without a quality are left out; of repeated labels the lowest counts, and of the rows of a repeated id
    the text of the lowest checksum. Whole texts are learnt from, in the order of the hash of their
    ids, as long as their features together stay within the bound. Without any label the machine scores its start, about a half.
    """
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("_quality")).withColumn("_rank", F.xxhash64("doc_id"))
    chosen = chosen.orderBy("_rank", "doc_id").limit(most)  # at most 24 bytes a row
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "doc_id")
    fields = [("_rank", T.LongType()), ("_quality", T.IntegerType()), ("_crc", T.LongType()), ("_index", T.ArrayType(T.IntegerType())), ("_x", T.ArrayType(T.FloatType()))]

    def make():
        buckets = Buckets()

        def fn(rank, quality, text):
            rows = [vector(t, buckets) for t in text]
            return rank, [int(q > 0) for q in quality], [crc32((t or "").encode()) for t in text], [r[0].astype(np.int32) for r in rows], [r[1] for r in rows]

        return fn

    made = durable(map_rows(texts, ["_rank", "_quality", "_text"], make, T.StructType([T.StructField(*f) for f in fields])), "quality-vectors")
    one = made.groupBy("_rank").agg(F.min(F.struct("_crc", F.size("_index").alias("_n"))).alias("_least"))  # a row for each chosen label
    so_far = F.sum("_least._n").over(Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0))
    one = one.withColumn("_sum", so_far).where(F.col("_sum") <= features).select("_rank", "_least._crc")
    table = made.join(F.broadcast(one), ["_rank", "_crc"]).dropDuplicates(["_rank", "_crc"]).toArrow()
    order = np.argsort(table["_rank"].to_numpy())  # the same order on any cluster
    index, x = table["_index"].combine_chunks(), table["_x"].combine_chunks()
    rows = [(index[i].values.to_numpy().astype(np.int64), x[i].values.to_numpy()) for i in order.tolist()]
    release(made)
    return Machine().fit(rows, table["_quality"].to_numpy()[order].astype(np.float64))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row's whole text; null and empty texts score alike.

    Only the text is an input. Ids may be null or repeated; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))  # WIDTH * (RANK + 1) floats
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def make():
        buckets, model = Buckets(), Machine.__new__(Machine)
        model.w0, model.w, model.v = sent.value

        def fn(ids, texts):
            scores = []
            for at in range(0, len(texts), 32):
                scores += model.predict([vector(t, buckets) for t in texts[at : at + 32]]).tolist()
            return ids, scores

        return fn

    return map_rows(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), ["_id", "_text"], make, schema)


def classify(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, by a machine trained on the labels."""
    scored = score(docs, train(docs, labels, most))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
