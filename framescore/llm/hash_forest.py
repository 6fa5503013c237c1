"""Operator 10: approximate nearest neighbours with a hash-prefix forest.

Every row is indexed.  Rows are dealt into shards of about ``SHARD_ROWS``; a shard holds
``TREES`` sorted arrays of long hash strings (a bit per random direction, about the
shard's mean).  A query descends every tree to its longest matching prefixes by binary
search, then all trees ascend together, one bit at a time, until their prefix ranges
together hold ``SHARE`` times as many rows as the shard has vectors (the trees repeat each
other, so fewer are opened); the union of the ranges is compared exactly, and each shard's ten
best meet in one top-k per query.

Queries (a stated set) meet all shards in packed blocks, so a task holds one shard and
one block.  Rows are dealt by their place in the input, so a repeated id or vector
cannot fill a shard; equal vectors are one entry of a tree and share its distance.

How much must be opened depends on the vectors: with no structure in them, as in
uniformly random directions, near neighbours share few bits, and only a large share
finds nine of ten; recall is measured against brute force (tests, README).

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do vectors whose length is not the table's most frequent one; rows with
a null id take no part; rows that repeat an id are rows, but never neighbours of a query with
that id; a repeated query counts once (its least vector); ties go to the smaller id; fewer
than k candidates give them all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framescore.llm.tables import shuffle_width

SHARD_ROWS = 8192
QUERY_BLOCK = 512
TREES, BITS = 64, 24
SHARE = 0.8
SEED = 17
_PACKED = "shard bigint, kind int, block bigint, ids binary, vectors binary"


class Forest:
    """One shard: distinct vectors, and for each tree their hash strings in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = SEED):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        self.ids, self.first = ids, np.append(np.flatnonzero(new), len(ids))
        self.vectors = vectors[new]
        self.center = self.vectors.mean(axis=0)
        rng = np.random.default_rng(seed)
        self.planes = rng.normal(size=(vectors.shape[1], TREES * BITS))
        keys = self.keys(self.vectors)
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.sorted = np.take_along_axis(keys, self.order, axis=0)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(n, trees) hash strings as numbers, first bit highest."""
        bits = (vectors - self.center) @ self.planes > 0
        weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        return bits.reshape(len(vectors), TREES, BITS) @ weights

    def ranges(self, queries: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query and tree the rows that share the prefix at which the trees stop."""
        keys = self.keys(queries)
        lo = np.zeros(keys.shape, np.int64)
        hi = np.zeros(keys.shape, np.int64)
        climbing = np.arange(len(queries))
        for length in range(BITS, -1, -1):                # all trees ascend together
            shift = BITS - length
            for t in range(TREES):
                head = keys[climbing, t] >> shift
                lo[climbing, t] = np.searchsorted(self.sorted[:, t], head << shift)
                hi[climbing, t] = np.searchsorted(self.sorted[:, t], (head + 1) << shift)
            others = np.maximum((hi - lo)[climbing] - 1, 0)    # a query of this shard matches itself
            climbing = climbing[others.sum(axis=1) < wanted]
            if not len(climbing):
                break
        return lo, hi

    def open(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The union of the trees' ranges."""
        opened = np.zeros(len(self.vectors), bool)
        for t in range(TREES):
            opened[self.order[lo[t]:hi[t], t]] = True
        return np.flatnonzero(opened)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float = SHARE):
        """Best k rows of the shard among the opened ones: (query ids, row ids, distances)."""
        n = len(self.vectors)
        wanted = int(np.ceil(share * n))
        lo, hi = self.ranges(queries, wanted)
        out = []
        for q in range(len(queries)):
            rows, more = self.open(lo[q], hi[q]), wanted
            while len(rows) < min(n, 4 * k):              # all trees hold the same few: climb on
                more = 2 * more + 1
                low, high = self.ranges(queries[q:q + 1], more)
                rows = self.open(low[0], high[0])
            # squared distances pick the near ones; the measure itself is then computed in full
            rough = ((self.vectors[rows] - queries[q]) ** 2).sum(axis=1)
            if len(rows) > 4 * k:
                cut = np.partition(rough, 2 * k)[2 * k]
                rows = rows[rough <= cut]
            dist = np.sqrt(((self.vectors[rows] - queries[q]) ** 2).sum(axis=1))
            copies = self.first[rows + 1] - self.first[rows]
            taken = np.minimum(copies, k + 1)             # a vector's ids are in order
            at = np.repeat(self.first[rows] - (np.cumsum(taken) - taken), taken) + np.arange(taken.sum())
            ids, d = self.ids[at], np.repeat(dist, taken)
            own = ids != query_ids[q]
            ids, d = ids[own], d[own]
            best = np.lexsort((ids, d))[:k]
            out.append((np.full(len(best), query_ids[q]), ids[best], d[best]))
        return [np.concatenate(c) for c in zip(*out, strict=True)]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and its vector (doubles), where it takes part."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter("""vec_id IS NOT NULL AND size(v) > 0 AND exists(v, x -> x <> 0D)
        AND forall(v, x -> coalesce(x = x AND abs(x) < double('infinity'), false))""")


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("v")
    return (batch.column("vec_id").to_numpy(zero_copy_only=False),
            column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))


def _rows(shard: int, kind: int, block: int, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int64()), pa.array([kind], pa.int32()), pa.array([block], pa.int64()),
         pa.array([ids.astype("<i8").tobytes()]), pa.array([vectors.astype("<f8").tobytes()])],
        names=["shard", "kind", "block", "ids", "vectors"])


def _pack(shards: int, kind: int, block_rows: int):
    """Blocks of rows, dealt round the shards by their place in the input (kind 0), or of
    queries (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        block = part << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, block_rows):
                ids, vectors = _matrix(batch.slice(lo, block_rows))
                if kind:
                    yield _rows(-1, 1, block, ids, vectors)
                    block += 1
                    continue
                step = min(shards, -(-len(ids) // 64))    # pieces of 64 rows or more
                for s in range(step):
                    shard = (part * 7919 + block + s) % shards
                    yield _rows(shard, 0, block + s, ids[s::step], vectors[s::step])
                block += step
    return run


def _search(k: int, dims: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, vectors, forest = None, [], [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    shard, ids, vectors, forest = row["shard"], [], [], None
                own = np.frombuffer(row["ids"], "<i8")
                v = np.frombuffer(row["vectors"], "<f8").reshape(-1, dims)
                if row["kind"] == 0:
                    ids.append(own)
                    vectors.append(v)
                elif ids:
                    if forest is None:
                        forest = Forest(np.concatenate(ids), np.concatenate(vectors))
                        vectors = []
                    q, found, d = forest.search(own, v, k, share)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(found, pa.int64()),
                                                      pa.array(d, pa.float64())],
                                                     names=["query_id", "vec_id", "score"])
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
            vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if lengths is None:
        return spark.createDataFrame([], result)
    dims, shards = lengths["d"], max(1, -(-lengths["count"] // shard_rows))
    width = max(shuffle_width(spark), 1)
    data = rows.filter(F.size("v") == dims).mapInArrow(_pack(shards, 0, 4096), _PACKED)
    asked = (usable(queries, id_col, vector_col).filter(F.size("v") == dims)
             .groupBy("vec_id").agg(F.min("v").alias("v"))
             .mapInArrow(_pack(shards, 1, QUERY_BLOCK), _PACKED)
             .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))))
    met = data.unionByName(asked).repartition(width, "shard").sortWithinPartitions("shard", "kind", "block")
    found = met.mapInArrow(_search(k, dims, share), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
