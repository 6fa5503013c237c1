"""Operator 12: hard negatives by an inverted multi-index.

Vectors are split into two halves; each half has its codebook (k-means over a bounded sample), and a
row's cell is the pair of its codes.  Every row is indexed: rows are ranged by cell and packed into
blocks.  A query's inner product with any row of a cell is at most the sum of two half-score bounds,
``q1.c1 + |q1| r1`` and ``q2.c2 + |q2| r2`` with the codes' radii r, so a heap over the two sorted
lists (multi-sequence) visits the cells by falling bound.  What it has seen is certified once the
next bound is below every score that is still wanted.

Four passes, each a shuffle of packed queries to the blocks they open:

1. the first cells, until they hold ``FIRST_ROWS`` rows: some positives of each anchor;
2. every further cell whose bound reaches the fifth of them: the positives are certified;
3. the cells opened so far again, now for negatives in the windows that the positives set;
4. every further cell whose bound reaches the third negative of a window, or the window's floor
   where three were not found: the windows are certified.

The result is exact.  What must be opened depends on the vectors: without structure in them, as in
uniformly random directions, the bounds are wide and most cells are opened, and the work is that of
the stated query set against all rows in blocks.  A cell of any size is many blocks; a task holds one
block and the queries of one query block.  Asked queries meet their blocks in a shuffle, whatever
Spark takes their size for.  The driver holds the codebooks, radii and the directory of
cells and blocks, at most ``MAX_CODES`` ** 2 + 2 * ``MAX_BLOCKS`` entries whatever the table's size.

Defined cases: rows with a null id, label or vector, a null or non-finite component, a component of
``MAX_COMPONENT`` or more once quantised (its scores would not fit a long), or whose length is not the
table's most frequent one (ties: the longer) take no part; a repeated id's rows are candidates of their
own, but never of an anchor with that id; of a repeated anchor the row with the least label and vector
counts; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framescore.llm.tables import shuffle_width, stored

POSITIVES, NEGATIVES = 5, 3
#: A negative scores between LOW and HIGH hundredths of its positive.
LOW, HIGH = 50, 95
SCALE = 256
MAX_COMPONENT = 1 << 24

SAMPLE_ROWS = 16_384          # the codebooks are fitted on so many rows, those of the least id hashes
CELL_ROWS = 64                # codes per half: the square root of rows / CELL_ROWS, at most MAX_CODES
MAX_CODES = 1024
ROUNDS = 8
BLOCK_ROWS = 2048
MAX_BLOCKS = 1 << 18          # beyond BLOCK_ROWS * MAX_BLOCKS rows, blocks grow
QUERY_BLOCK = 256
FIRST_ROWS = 1024
SEED = 23

_ROWS = "vec_id bigint, label bigint, vector binary, cell bigint, d1 double, d2 double"
_BLOCK = "block bigint, cells array<bigint>, counts array<bigint>, ids binary, labels binary, vectors binary"
_FOUND = "query bigint, slot int, score bigint, vec_id bigint"


# ------------------------------------------------------------------ rows

def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, label (after the damage) and the integer vector of the rows that take part."""
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
                     & (F.abs(F.lit(float(SCALE)) * c.cast("double")) < float(MAX_COMPONENT - 1)))
    label = F.col("label").cast("bigint")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    return rows.where((F.size("embedding") > 0) & whole).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        x.cast("array<int>").alias("vector"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int32).reshape(-1, dims)


# ------------------------------------------------------------------ the index

def codebook(points: np.ndarray, codes: int, seed: int = SEED) -> np.ndarray:
    """Centres of ``codes`` clusters (fewer, if there are fewer distinct points) by Lloyd's rounds."""
    distinct = np.unique(points, axis=0).astype(float)
    rng = np.random.default_rng(seed)
    centres = distinct[np.sort(rng.choice(len(distinct), min(codes, len(distinct)), replace=False))]
    for _ in range(ROUNDS):
        code, _ = nearest_code(points, centres)
        size = np.bincount(code, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, code, points)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def nearest_code(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, distance to its centre) of every point."""
    points = points.astype(float)
    code = (-2 * points @ centres.T + (centres ** 2).sum(axis=1)).argmin(axis=1)
    return code, np.sqrt(((points - centres[code]) ** 2).sum(axis=1))


class Index:
    """Codebooks, radii, and which blocks hold the rows of a cell."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.centres = (first, second)
        self.half = first.shape[1]
        self.radii = (np.zeros(len(first)), np.zeros(len(second)))
        self.blocks: dict[int, list[int]] = {}
        self.counts: dict[int, int] = {}

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[:, :self.half], vectors[:, self.half:]

    def visits(self, query: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) of every cell by falling bound; cells may be empty."""
        lists = []
        for part, centres, radii in zip((query[:self.half], query[self.half:]), self.centres, self.radii, strict=True):
            bounds = centres @ part + np.sqrt((part.astype(float) ** 2).sum()) * radii
            order = np.argsort(-bounds, kind="stable")
            lists.append((bounds[order].tolist(), order.tolist()))
        (u, i_code), (v, j_code) = lists
        slack = 1e-9 * (abs(u[0]) + abs(v[0]) + abs(u[-1]) + abs(v[-1])) + 1e-6      # above any rounding
        width = len(v)
        heap = [(-(u[0] + v[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            yield slack - bound, i_code[i] * width + j_code[j]
            if j + 1 < width:
                heapq.heappush(heap, (-(u[i] + v[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(u):
                heapq.heappush(heap, (-(u[i + 1] + v[0]), i + 1, 0))

    def first(self, query: np.ndarray) -> set[int]:
        """Blocks of the first cells, until those hold ``FIRST_ROWS`` rows."""
        opened, rows = set(), 0
        for _, cell in self.visits(query):
            if rows >= FIRST_ROWS:
                break
            opened.update(self.blocks.get(cell, ()))
            rows += self.counts.get(cell, 0)
        return opened

    def reaching(self, query: np.ndarray, score: float) -> set[int]:
        """Blocks of the cells that may hold a row of at least that score."""
        opened = set()
        for bound, cell in self.visits(query):
            if bound < score:
                break
            opened.update(self.blocks.get(cell, ()))
        return opened


def _assign(index: Index, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vectors = _matrix(b.column("vector"), dims)
            (a, d1), (c, d2) = (nearest_code(h, m) for h, m in zip(index.halves(vectors), index.centres, strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), _packed_rows(vectors), pa.array(a * len(index.centres[1]) + c, pa.int64()),
                 pa.array(d1), pa.array(d2)], ["vec_id", "label", "vector", "cell", "d1", "d2"])
    return run


def _packed_rows(vectors: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in np.ascontiguousarray(vectors, np.int32)], pa.binary())


def _pack(block_rows: int):
    """Runs of rows in order of cell and id -> blocks."""
    names = [c.split()[0] for c in _BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n, count = TaskContext.get().partitionId(), [], 0, 0

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal n
            cells, counts = np.unique(rows.column("cell").to_numpy(), return_counts=True)
            n += 1
            values = [(part << 32) | n, cells.tolist(), counts.tolist(),
                      *(rows.column(c).to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "label")),
                      b"".join(rows.column("vector").to_pylist())]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], names)
        for b in batches:
            held.append(b)
            count += b.num_rows
            while count >= block_rows:
                rows = pa.Table.from_batches(held)
                yield block(rows.slice(0, block_rows))
                rest = rows.slice(block_rows)
                held, count = rest.to_batches(), rest.num_rows
        if count:
            yield block(pa.Table.from_batches(held))
    return run


# ------------------------------------------------------------------ passes

def window(positive: int) -> tuple[int, int]:
    """Least and greatest score of a negative of that positive."""
    return -((-LOW * positive) // 100), (HIGH * positive) // 100


def wanted_score(positives: list[int], negatives: dict[int, list[int]]) -> float:
    """The least score that may still belong to a window's first ``NEGATIVES`` (infinite: none may)."""
    least = float("inf")
    for slot, score in enumerate(positives):
        low, high = window(score)
        found = negatives.get(slot, [])
        if low <= high:
            least = min(least, sorted(found)[-NEGATIVES] if len(found) >= NEGATIVES else low)
    return least


def _opened(index: Index, which: int, query: np.ndarray, positives: list[int], negatives: dict[int, list[int]]) -> set[int]:
    """The blocks that a query opens in a pass."""
    if which == 1:
        return index.first(query)
    fifth = positives[-1] if len(positives) == POSITIVES else float("-inf")
    if which == 2:
        return index.reaching(query, fifth) - index.first(query)
    if not positives:
        return set()
    certified = index.first(query) | index.reaching(query, fifth)
    if which == 3:
        return certified
    return index.reaching(query, wanted_score(positives, negatives)) - certified


def _open(shipped, which: int, dims: int):
    """Query blocks -> (block, the queries that open it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for b in batches:
            for r in b.to_pylist():
                vectors = np.frombuffer(r["vectors"], np.int32).reshape(-1, dims)
                ids, labels = (np.frombuffer(r[c], np.int64) for c in ("ids", "labels"))
                positives = [[] for _ in ids]
                negatives = [{} for _ in ids]
                for p in sorted(r.get("positives") or (), key=lambda p: p["slot"]):
                    positives[p["at"]].append(p["score"])
                for p in r.get("negatives") or ():
                    negatives[p["at"]].setdefault(p["slot"], []).append(p["score"])
                asked: dict[int, list[int]] = {}
                for at, q in enumerate(vectors):
                    for block in _opened(index, which, q, positives[at], negatives[at]):
                        asked.setdefault(block, []).append(at)
                out = []
                for block, ats in asked.items():
                    scores = np.full((len(ats), POSITIVES), np.iinfo(np.int64).min, np.int64)
                    for k, at in enumerate(ats):
                        scores[k, :len(positives[at])] = positives[at]
                    queries = (r["block"] << 12) + np.array(ats, np.int64)
                    out.append((block, queries.tobytes(), ids[ats].tobytes(), labels[ats].tobytes(), vectors[ats].tobytes(),
                                scores.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(zip(*out, strict=True))],
                        ["block", "queries", "query_ids", "query_labels", "query_vectors", "positive_scores"])
    return run


_ASKED = "block bigint, queries binary, query_ids binary, query_labels binary, query_vectors binary, positive_scores binary"


def inner_products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where these hold them, else in 64-bit integers."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    kind = np.float64 if most < 2 ** 53 else np.int64
    return (queries.astype(kind) @ rows.astype(kind).T).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _score(negative: bool, dims: int):
    """Opened blocks -> each query's best positives (slot 0), or negatives of every window (slot)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, labels, q, q_ids, q_labels = (np.frombuffer(r[c], np.int64) for c in (
                    "ids", "labels", "queries", "query_ids", "query_labels"))
                scores = inner_products(np.frombuffer(r["query_vectors"], np.int32).reshape(-1, dims),
                                        np.frombuffer(r["vectors"], np.int32).reshape(-1, dims))
                wins = np.frombuffer(r["positive_scores"], np.int64).reshape(-1, POSITIVES)
                out = []
                for k in range(len(q)):
                    own = (labels == q_labels[k]) & (ids != q_ids[k]) if not negative else (
                        labels != q_labels[k]) & (ids != q_ids[k])
                    rows = np.flatnonzero(own)
                    line = scores[k, rows]
                    if not negative:
                        out += [(int(q[k]), 0, int(line[j]), int(ids[rows[j]])) for j in best(line, ids[rows], POSITIVES)]
                        continue
                    for slot, positive in enumerate(wins[k].tolist()):
                        if positive == np.iinfo(np.int64).min:
                            break
                        low, high = window(positive)
                        inside = rows[(line >= low) & (line <= high)]
                        out += [(int(q[k]), slot, int(scores[k, j]), int(ids[j]))
                                for j in inside[best(scores[k, inside], ids[inside], NEGATIVES)]]
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                                     ["query", "slot", "score", "vec_id"])
    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _state(found: DataFrame, name: str, slot: str) -> DataFrame:
    """Per query block what its queries have found, at most QUERY_BLOCK x POSITIVES x NEGATIVES entries."""
    return found.groupBy(F.shiftright("query", 12).alias("block")).agg(F.collect_list(F.struct(
        F.col("query").bitwiseAND(F.lit((1 << 12) - 1)).cast("int").alias("at"), F.col(slot).cast("int").alias("slot"),
        "score")).alias(name))


def met(asked: DataFrame, packed: DataFrame) -> DataFrame:
    """Asking queries beside the block that they open, both dealt by block.

    A query is asked once per block that it opens, so the asking rows grow with queries times blocks, which
    Spark can't see: it takes them for about as small as the queries and would broadcast them through the
    driver.  The hint keeps both sides shuffled."""
    return asked.join(packed.hint("merge"), "block").drop("block")


def hard_negatives(rows: DataFrame, every: int = 50, query_block: int = QUERY_BLOCK, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` (vec_id, label, vector of integers): for each anchor (``vec_id`` divisible by ``every``)
    and each of its positives the hardest negatives of the positive's window."""
    spark = rows.sparkSession
    size = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims, n = (size[0]["dims"], size[0]["count"]) if size else (1, 0)
    rows = rows.where(F.size("vector") == dims)

    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE_ROWS).select("vector").toArrow()
    points = np.array(sample.column("vector").to_pylist(), np.int32).reshape(-1, dims)
    if not len(points):
        points = np.zeros((1, dims), np.int32)
    codes = int(min(MAX_CODES, max(1, np.ceil(np.sqrt(n / CELL_ROWS)))))
    half = (dims + 1) // 2
    index = Index(codebook(points[:, :half], codes), codebook(points[:, half:], codes))

    coded = stored(rows.mapInArrow(_assign(index, dims), _ROWS), "index-rows")
    width = len(index.centres[1])
    for which, (code, distance) in enumerate(((F.floor(F.col("cell") / width), "d1"), (F.col("cell") % width, "d2"))):
        for r in coded.groupBy(code.cast("int").alias("code")).agg(F.max(distance).alias("r")).collect():   # a row a code
            index.radii[which][r["code"]] = r["r"]
    partitions = shuffle_width(spark)
    blocks = stored(coded.select("vec_id", "label", "vector", "cell").repartitionByRange(partitions, "cell", "vec_id")
                    .sortWithinPartitions("cell", "vec_id", "label", "vector")
                    .mapInArrow(_pack(max(block_rows, -(-n // MAX_BLOCKS))), _BLOCK), "index-blocks")
    for r in blocks.select("block", "cells", "counts").toLocalIterator():
        for cell, count in zip(r["cells"], r["counts"], strict=True):
            index.blocks.setdefault(cell, []).append(r["block"])
            index.counts[cell] = index.counts.get(cell, 0) + count
    shipped = spark.sparkContext.broadcast(index)

    anchors = coded.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(
        F.min(F.struct("label", "vector", "cell")).alias("r")).select("vec_id", "r.*")
    queries = stored(anchors.repartitionByRange(partitions, "cell", "vec_id").sortWithinPartitions("cell", "vec_id")
                     .mapInArrow(_pack(query_block), _BLOCK).drop("cells", "counts"), "index-queries")
    packed = blocks.drop("cells", "counts")

    def visit(asking: DataFrame, which: int) -> DataFrame:
        asked = asking.mapInArrow(_open(shipped, which, dims), _ASKED)
        found = met(asked, packed).mapInArrow(_score(which > 2, dims), _FOUND)
        return _top(found, NEGATIVES if which > 2 else POSITIVES).drop("rank")

    some = stored(visit(queries, 1), "index-positives-1")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    known = some.withColumn("at", F.row_number().over(ranked))
    more = visit(queries.join(_state(known, "positives", "at"), "block", "left"), 2)
    positives = stored(_top(some.unionByName(more), POSITIVES), "index-positives")
    asking = queries.join(_state(positives, "positives", "rank"), "block", "left")
    near = stored(visit(asking, 3), "index-negatives-3")
    rest = visit(asking.join(_state(near, "negatives", "slot"), "block", "left"), 4)
    negatives = _top(near.unionByName(rest), NEGATIVES)

    named = queries.mapInArrow(_names, "query bigint, anchor_id bigint")
    chosen = positives.select("query", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"),
                              F.col("score").alias("positive_score"))
    return negatives.join(chosen, ["query", "slot"]).join(named, "query").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, ids in zip(b.column("block").to_pylist(), b.column("ids").to_pylist(), strict=True):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((block << 12) + np.arange(len(ids)), pa.int64()), pa.array(ids)],
                                             ["query", "anchor_id"])


#: The contract's rows in DuckDB's SQL, all anchors against all rows.
ORACLE = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= {NEGATIVES}
"""
