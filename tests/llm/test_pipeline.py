"""The pipeline's stages on the small tables: each on what its predecessor kept."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from framescore.llm import ngram_join, pii, quality_rules
from framescore.llm.queries import QUERIES
from test_operators import _brute_components, _measures, _pii_base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_stages_return_documents(outputs):
    for df in outputs[1:-1]:
        assert df.columns == outputs[0].columns
    counts = [df.count() for df in outputs[:-1]]
    assert counts[0] > counts[1] >= counts[2] > counts[3] == counts[4]


def test_classifier_keeps_good_documents(spark, outputs):
    kept = {r["doc_id"] for r in outputs[1].collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [r["doc_id"] in kept for r in labels if r["quality"] == 1]
    bad = [r["doc_id"] in kept for r in labels if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2


def test_rules_stage(outputs):
    """Every kept text passes the base rules; what is dropped fails a rule of the ledger."""
    kept = {r["doc_id"] for r in outputs[2].collect()}
    failed = {r["doc_id"]: r["failed"] for r in quality_rules.ledger(outputs[1]).collect()}
    assert kept == {d for d, f in failed.items() if not f}
    for r in outputs[2].collect():
        n, _, _, _, repeat = _measures(r["text"])
        assert n >= 20 and 100 * repeat <= 30 * n


def test_one_of_each_group_stays(outputs):
    rows = [(r["doc_id"], r["text"]) for r in outputs[2].collect()]
    want = {c for _, c in _brute_components(rows).values()}
    assert {r["doc_id"] for r in outputs[3].collect()} == want


def test_personal_data_is_replaced(outputs):
    before = {r["doc_id"]: r["text"] for r in outputs[3].collect()}
    hit = 0
    for r in outputs[4].collect():
        spans = _pii_base(before[r["doc_id"]])
        hit += len(spans)
        assert not _pii_base(r["text"]) and r["n_chars"] == len(r["text"])
        assert spans or r["text"] == before[r["doc_id"]]
    assert hit


def test_packed_pieces_cover_the_texts(outputs):
    ids = {r["doc_id"] for r in outputs[4].collect()}
    pieces = outputs[5].collect()
    assert {r["doc_id"] for r in pieces} == ids
    total = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert sum(r["length"] for r in pieces) == sum(total.values())


def test_run_equals_the_stages(spark, outputs):
    got = queries()["pipeline"](spark, SF)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in outputs[5].collect())


def test_empty_documents_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_representatives_keep_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1), (None, None, 2), (3, "a b c d e f", 3), (3, "a b c d e f", 3),
                                (5, "a b c d e f", 4)], "doc_id bigint, text string, component_id int")
    assert sorted(r["component_id"] for r in ngram_join.representatives(df).collect()) == [1, 2, 3]
    assert pii.redact(df).count() == 5


def test_representatives_of_repeated_ids(spark):
    """One row a group also where an id has several texts: linked ones, or one of them in another group."""
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long), (2, long + " end"), (2, "alone in its own group of words"),   # of id 2 only the lone text stays
            (7, "x y z u v w " + long[::-1]), (7, "x y z u v w " + long[::-1] + " end"), (7, "q r s t u v w"),
            (8, "Same words in a row"), (8, "same  words in a row"), (9, ""), (9, " "), (9, ""), (9, None), (None, long)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in ngram_join.representatives(df).collect()]
    assert len(got) == 9 and (None, long) in got and (1, long) in got
    assert [t for d, t in got if d == 2] == ["alone in its own group of words"]
    assert sorted(t[0] for d, t in got if d == 7) == ["q", "x"]
    assert sum(d == 8 for d, _ in got) == 1
    assert {t for d, t in got if d == 9} == {"", " ", None}


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) & set(QUERIES)))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    df = queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == want
