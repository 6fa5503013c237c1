"""Operator 12 against all anchors times all rows, and the parts of its index."""

from __future__ import annotations

import math

import numpy as np
import pytest

from framescore.llm import multi_index as mi

SCHEMA = "vec_id bigint, embedding array<double>, label int, query string, block int"


def _quantise(v):
    if v is None or not v or any(x is None or not math.isfinite(x) for x in v):
        return None
    q = [math.floor(256 * x) for x in v]
    return None if max(map(abs, q)) >= mi.MAX_COMPONENT - 1 else q


def _brute(rows, every, dims):
    use = []
    for vec_id, v, label, *_ in rows:
        q = _quantise(v)
        if vec_id is not None and label is not None and q and len(q) == dims:
            use.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, q))
    anchors = {}
    for vec_id, label, q in use:
        if vec_id % every == 0:
            key = (label, np.array(q, np.int32).tobytes())
            if vec_id not in anchors or key < anchors[vec_id][0]:
                anchors[vec_id] = (key, label, q)
    out = []
    for a, (_, label, q) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(q, r, strict=True)), i, lab) for i, lab, r in use if i != a)
        same = [(i, -s) for s, i, lab in scored if lab == label][:5]
        for i, p in same:
            inside = [(j, -s) for s, j, lab in scored if lab != label and 50 * p <= -100 * s <= 95 * p][:3]
            out += [(a, i, k + 1, j, p, s) for k, (j, s) in enumerate(inside)]
    return sorted(out)


def _rows(seed, n, dims=6, clusters=None):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters or 1, dims)) * (2 if clusters else 0)
    v = centres[rng.integers(0, clusters or 1, n)] + rng.normal(size=(n, dims)) * (0.1 if clusters else 0.3)
    return [(i, [float(x) for x in row], int(rng.integers(0, 10)), "own", 1) for i, row in enumerate(v)]


def _run(df, **how):
    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in cols) for r in mi.hard_negatives(mi.quantised(df), **how).collect())


def test_equals_all_pairs(spark):
    rows = _rows(3, 300) + [
        (1000, None, 1, "o", 1), (1005, [1.0] * 6, None, "o", 1), (1010, [math.nan] + [0.1] * 5, 1, "o", 1),
        (1015, [math.inf] + [0.1] * 5, 1, "o", 1), (1020, [None] + [0.1] * 5, 1, "o", 1), (1025, [0.5] * 5, 1, "o", 1),
        (1030, [1e6] * 6, 1, "o", 1), (1035, [], 1, "o", 1), (None, [0.3] * 6, 1, "o", 1), (1040, [0.0] * 6, 1, "o", 1),
        (-5, [0.4] * 6, 2, "o", 1), (1045, [9000.0] * 6, 2, "o", 1), (1046, [-9000.0] * 6, 2, "o", 1)]
    rows += [rows[10], rows[10], (10, [0.2] * 6, 3, "other vector", 1)]                  # an anchor three times
    rows += [(2000 + i, [0.25, -0.5, 0.125, 0.5, 0.75, 0.0], 4 + i % 2, "hot", 1) for i in range(150)]   # a third are ties
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = _brute(rows, 5, 6)
    assert _run(df, every=5, query_block=7, block_rows=16) == want
    assert len(want) > 300 and {r[0] for r in want} >= {10, 2000}


def test_structured_vectors_and_small_tables(spark):
    rows = _rows(9, 2500, clusters=12)
    assert _run(spark.createDataFrame(rows, SCHEMA), block_rows=64) == _brute(rows, 50, 6)
    assert _run(spark.createDataFrame([], SCHEMA)) == []
    for few in (_rows(1, 1), _rows(1, 4, dims=1), [(0, [1.0], 1, "", 1), (1, [1.0], 1, "", 1), (2, [0.9], 2, "", 1)]):
        assert _run(spark.createDataFrame(few, SCHEMA)) == _brute(few, 50, len(few[0][1]))


def _index(vectors, codes):
    half = (vectors.shape[1] + 1) // 2
    index = mi.Index(mi.codebook(vectors[:, :half], codes), mi.codebook(vectors[:, half:], codes))
    found = [mi.nearest_code(h, c) for h, c in zip(index.halves(vectors), index.centres, strict=True)]
    for k, (code, d) in enumerate(found):
        np.maximum.at(index.radii[k], code, d)
    cells = found[0][0] * len(index.centres[1]) + found[1][0]
    for cell in np.unique(cells).tolist():                                 # a block a cell
        index.blocks[cell], index.counts[cell] = [cell], int((cells == cell).sum())
    return index, cells


def test_asking_queries_are_not_broadcast(spark):
    """They grow with queries times blocks, whatever Spark takes their size for: a broadcast would put them in the driver."""
    df = mi.hard_negatives(mi.quantised(spark.createDataFrame(_rows(11, 300), SCHEMA)), every=5, query_block=16, block_rows=64)
    plan = df._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [block#" in line and " Inner" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_visits_fall_and_bound_their_cells():
    vectors = np.floor(256 * np.array([r[1] for r in _rows(4, 600, clusters=9)])).astype(np.int32)
    index, cells = _index(vectors, 8)
    for q in vectors[:20]:
        seen = list(index.visits(q))
        bounds = [b for b, _ in seen]
        assert bounds == sorted(bounds, reverse=True)
        assert sorted(c for _, c in seen) == list(range(len(index.centres[0]) * len(index.centres[1])))
        bound = dict((c, b) for b, c in seen)
        scores = mi.inner_products(q[None], vectors)[0]
        assert all(bound[c] >= s for c, s in zip(cells.tolist(), scores.tolist(), strict=True))


def test_structure_leaves_most_rows_closed():
    """On clustered vectors the certified window of the best rows is a small share of the table."""
    vectors = np.floor(256 * np.array([r[1] for r in _rows(4, 6000, dims=8, clusters=60)])).astype(np.int32)
    index, _ = _index(vectors, 60)
    opened = []
    for q in vectors[:40]:
        fifth = np.sort(mi.inner_products(q[None], vectors)[0])[-5]
        opened.append(sum(index.counts[c] for c in index.reaching(q, fifth)) / len(vectors))
    assert np.mean(opened) < 0.25


def test_products_are_exact_beyond_doubles():
    big = mi.MAX_COMPONENT - 2
    q, r = np.full((1, 600), big, np.int32), np.full((1, 600), big, np.int32)
    assert mi.inner_products(q, r)[0, 0] == 600 * big * big


@pytest.mark.parametrize("positive", [-301, -3, -1, 0, 1, 2, 3, 99, 100, 101, 12345])
def test_window(positive):
    low, high = mi.window(positive)
    assert [s for s in range(-400, 13000) if 50 * positive <= 100 * s <= 95 * positive] == list(range(low, high + 1))
