"""Operator 3: quality classifier, a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Learned
filters of eight bytes slide over a chunk in steps of four; each filter's largest
response is the chunk's feature.  The mean and the maximum of those features over all
chunks of a document are combined into one probability.

Training uses at most about ``TRAIN_DOCS`` labelled documents, chosen by a hash of the
id, and all chunks of each, so that the maximum is learnt over as many chunks as it is
applied to; if their texts have more than ``TRAIN_BYTES`` together, fewer documents are
taken, in the order of the hash (and none that is longer by itself).  Rows whose
crc32(doc_id) mod 3 is 1 are never among them.  The driver holds only that sample and
the weights (a few kB).  Scoring is a map over every document and every byte.

Defined cases: a null or empty text is one chunk of padding; no labels, or labels of one
kind, score every text with their mean (0.5 if there are none); conflicting labels of a
repeated id count as 1 if any is 1; repeated rows and null ids are scored as rows of their
own (a null id is not held out); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescore.llm import arrays
from framescore.llm.tables import stored

CHUNK, STEP = 512, 384
WIDTH, STRIDE = 8, 4
DIMS, FILTERS = 8, 32
PAD = 256
TRAIN_DOCS, TRAIN_BYTES = 3000, 64 << 20
EPOCHS, BATCH, RATE = 10, 64, 4e-3
BLOCK_BYTES = 4 << 20
GROUP = 64


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def chunks_of(lengths: np.ndarray) -> np.ndarray:
    """How many chunks cover each length."""
    return np.maximum(1, -(-(lengths - (CHUNK - STEP)) // STEP))


def chunk_bounds(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts between ``off``: each one's first chunk, each chunk's start and its text's end."""
    counts = chunks_of(np.diff(off))
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return first, off[doc] + (np.arange(len(doc)) - first[doc]) * STEP, off[doc + 1]


def codes_of(padded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes of the chunks, ``PAD`` behind their texts' ends; ``padded`` has a byte more than the texts."""
    at = start[:, None] + np.arange(CHUNK)
    inside = at < end[:, None]
    return np.where(inside, padded[np.where(inside, at, 0)], np.int16(PAD))


class ByteCnn:
    """Weights and both passes; all arrays are float32."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {
            "emb": rng.normal(0, 0.5, (PAD + 1, DIMS)), "conv": rng.normal(0, 0.12, (WIDTH * DIMS, FILTERS)),
            "bias": np.zeros(FILTERS), "mean": rng.normal(0, 0.1, FILTERS),
            "max": rng.normal(0, 0.1, FILTERS), "out": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def pooled(self, codes: np.ndarray, where: bool = False):
        """Largest response of each filter in each chunk of ``codes`` (and its window)."""
        g, half = len(codes), STRIDE * DIMS
        x = self.p["emb"][codes].reshape(g, CHUNK // STRIDE, half)
        both = np.concatenate([self.p["conv"][:half], self.p["conv"][half:]], axis=1)
        y = (x.reshape(-1, half) @ both).reshape(g, CHUNK // STRIDE, 2 * FILTERS)
        z = y[:, :-1, :FILTERS] + y[:, 1:, FILTERS:]
        if not where:
            return np.maximum(z.max(axis=1) + self.p["bias"], 0)
        at = z.argmax(axis=1)
        top = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0] + self.p["bias"]
        return np.maximum(top, 0), at

    def combine(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of each document from its chunks' features (first chunk of each)."""
        counts = np.diff(np.append(first, len(pooled)))[:, None]
        mean = np.add.reduceat(pooled, first) / counts
        high = np.maximum.reduceat(pooled, first)
        z = mean @ self.p["mean"] + high @ self.p["max"] + self.p["out"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))

    def gradients(self, codes: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict:
        parts = [self.pooled(codes[lo:lo + GROUP], where=True) for lo in range(0, len(codes), GROUP)]
        pooled, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        counts = np.diff(np.append(first, len(pooled)))
        doc = np.repeat(np.arange(len(first)), counts)
        miss = ((self.combine(pooled, first) - labels) / len(labels)).astype(np.float32)
        high = np.maximum.reduceat(pooled, first)
        grad = {"mean": (np.add.reduceat(pooled, first) / counts[:, None]).T @ miss,
                "max": high.T @ miss, "out": miss.sum(keepdims=True)}
        winner = (pooled == high[doc])
        share = winner / np.maximum(np.add.reduceat(winner, first), 1)[doc]
        dp = miss[doc][:, None] * (self.p["mean"] / counts[doc][:, None] + self.p["max"] * share)
        dp = (dp * (pooled > 0)).astype(np.float32)
        grad["bias"] = dp.sum(axis=0)
        weights = self.p["conv"].T
        conv, emb = np.zeros_like(weights), np.zeros_like(self.p["emb"])
        for lo in range(0, len(codes), GROUP):
            own, g = codes[lo:lo + GROUP], dp[lo:lo + GROUP]
            byte = own[np.arange(len(own))[:, None, None],
                       at[lo:lo + GROUP, :, None] * STRIDE + np.arange(WIDTH)]
            conv += np.einsum("gf,gfk->fk", g, self.p["emb"][byte].reshape(*g.shape, -1))
            back = (weights * g[:, :, None]).reshape(-1, DIMS)
            for k in range(DIMS):
                emb[:, k] += np.bincount(byte.ravel(), back[:, k], PAD + 1)
        grad["conv"] = conv.T
        emb[PAD] = 0
        return grad | {"emb": emb}

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> ByteCnn:
        """Adam over documents, all chunks of each."""
        self.p["emb"][PAD] = 0
        rng = np.random.default_rng(11)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                own = order[lo:lo + BATCH]
                off = np.cumsum([0, *[len(texts[i]) for i in own]])
                padded = np.frombuffer(b"".join([texts[i] for i in own]) + b"\0", np.uint8)
                first, start, end = chunk_bounds(off)
                grad = self.gradients(codes_of(padded, start, end), first, labels[own])
                step += 1
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability of each text of a block, over all its bytes."""
        first, start, end = chunk_bounds(off)
        padded = np.append(data, np.uint8(0))
        pooled = np.empty((len(start), FILTERS), np.float32)
        for lo in range(0, len(start), GROUP):
            pooled[lo:lo + GROUP] = self.pooled(codes_of(padded, start[lo:lo + GROUP], end[lo:lo + GROUP]))
        return self.combine(pooled, first)


def sample(docs: DataFrame, labels: DataFrame, bound: int) -> tuple[list[bytes], np.ndarray]:
    """Whole texts and labels of at most about ``bound`` training documents."""
    known = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
             .agg(F.max("quality").cast("int").alias("quality"))
             .withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))))
    share = min(1.0, bound / max(1, known.count()))
    chosen = known.filter(F.col("place") < int(share * (1 << 30)))
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    bytes_of = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), raw.alias("raw"))
    rows = stored(bytes_of.join(F.broadcast(chosen), "doc_id")    # about TRAIN_DOCS rows
                  .filter(F.octet_length("raw") <= TRAIN_BYTES).dropDuplicates(["doc_id"]), "cnn-sample")
    sizes = sorted(rows.select("place", "doc_id", F.octet_length("raw")).collect())
    fit = np.cumsum([n for *_, n in sizes]) <= TRAIN_BYTES
    if not fit.all():
        rows = rows.filter(F.col("doc_id").isin([d for (_, d, _), own in zip(sizes, fit, strict=True) if own]))
    found = sorted((r["doc_id"], r["quality"], bytes(r["raw"])) for r in rows.collect())
    return [text for *_, text in found], np.array([y for _, y, _ in found], np.float64)


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> ByteCnn | float:
    """The fitted network, or the labels' mean where there is only one kind of them."""
    texts, y = sample(docs, labels, bound)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    epochs = min(60, EPOCHS * max(1, round(TRAIN_DOCS / len(y))))      # as many steps on few labels
    return ByteCnn().fit(texts, y, epochs)


def _score(model: ByteCnn | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in arrays.blocks(batches, "text", BLOCK_BYTES):
            p = np.full(rows.num_rows, model) if isinstance(model, float) else model.score(data, off)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(p, pa.float64())],
                                             names=["doc_id", "score"])
    return run


def score(docs: DataFrame, model: ByteCnn | float, id_col: str = "doc_id", text_col: str = "text"
          ) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                        F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_score(model), "doc_id bigint, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def _keep(model: ByteCnn | float, threshold: float, text_col: str, schema: pa.Schema | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in arrays.blocks(batches, text_col, BLOCK_BYTES):
            p = np.full(rows.num_rows, model) if isinstance(model, float) else model.score(data, off)
            yield rows.filter(pa.array(p >= threshold))
    return run


def keep(docs: DataFrame, model: ByteCnn | float, threshold: float = 0.5, text_col: str = "text"
         ) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    return docs.mapInArrow(_keep(model, threshold, text_col, None), docs.schema)
