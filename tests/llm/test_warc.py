"""Operator 11 against a plain reading of its rule, and the archives byte by byte."""

from __future__ import annotations

import base64
import hashlib
import io

import pytest

from framescore.llm import warc
from framescore.session import shared_path

TRICKY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
HOT = "the same page for everybody " * 5


def _sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _brute(rows):
    """(page_id, bytes, digest, type, refers to), from pairs (page_id, html)."""
    groups, out = {}, []
    for page_id, html in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i))
        for k, i in enumerate(ids):
            out.append((i, len(payload), _sha1(payload), "revisit" if k else "response", ids[0] if k else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(7, "http://a/x", TRICKY), (3, "http://a/y", TRICKY), (9, None, None), (4, "http://b", ""), (5, "u\r\nX: y", "é中𝒳"),
            (None, "http://n", "only here"), (None, "http://n", "twice"), (None, "http://n", "twice"), (2, "http://n", "\n\n"),
            (11, "z", "null id loses"), (None, "z", "null id loses"), (6, "dup", "row"), (6, "dup", "row"), (8, "l", "x" * 300_000)]
    rows += [(100 + i, f"http://hot/{i}", HOT) for i in range(60)]
    return spark.createDataFrame([(*r, "own", 1) for r in rows],
                                 "page_id bigint, url string, html string, digest string, file int").repartition(5)


def test_round_trip_equals_the_rule(pages):
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    assert got == _brute([(r["page_id"], r["html"]) for r in pages.collect()])


def _records(spark, path):
    out = []
    for (name,) in spark.read.format("binaryFile").load(path).select("path").collect():
        with warc._open(name) as stream:
            out += list(warc.parse(stream))
    return out


def test_archives_hold_each_payload_once(spark, pages):
    raw = warc.capture(pages, shared_path(spark, "test-warc-raw"))
    out = warc.deduplicate(spark, raw, shared_path(spark, "test-warc"))
    before, after = _records(spark, raw), _records(spark, out)
    assert len(before) == len(after) == pages.count()
    ids = {f["warc-record-id"] for f, _ in after}
    assert len(ids) == len(after) and not ids & {f["warc-record-id"] for f, _ in before}
    payloads, by_id = [], {f["warc-record-id"]: f for f, _ in after}
    for f, block in after:
        http, payload = warc.split_block(f, block)
        assert f["warc-block-digest"] == "sha1:" + _sha1(block) and f["warc-date"].endswith("Z")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and http.endswith(b"\r\n\r\n")
        if f["warc-type"] == "response":
            payloads.append(payload)
            assert f["warc-payload-digest"] == "sha1:" + _sha1(payload) and "warc-profile" not in f
        else:
            first = by_id[f["warc-refers-to"]]
            assert payload == b"" and f["warc-profile"] == warc.REVISIT_PROFILE and first["warc-type"] == "response"
            assert first["warc-payload-digest"] == f["warc-payload-digest"]
            assert first.get("warc-target-uri") == f.get("warc-refers-to-target-uri")
    assert sorted(payloads) == sorted({(r["html"] or "").encode() for r in pages.collect()})
    assert any(f.get("warc-target-uri") == "u%0D%0AX: y" for f, _ in after)


def test_revisits_of_earlier_archives(spark):
    """Archives that are deduplicated already come out with the same meaning; one joined to more loses its copies."""
    a = spark.createDataFrame([(5, "u5", "p"), (6, "u6", "p"), (7, "u7", "q")], "page_id bigint, url string, html string")
    b = spark.createDataFrame([(1, "u1", "p"), (9, "u9", "r")], "page_id bigint, url string, html string")
    folder = shared_path(spark, "test-warc-two")
    warc.deduplicate(spark, warc.capture(a, shared_path(spark, "test-warc-a")), f"{folder}/a")
    warc.capture(b, f"{folder}/b")
    got = warc.restored(spark, warc.deduplicate(spark, folder, shared_path(spark, "test-warc-both"))).collect()
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)) == [
        (1, "response", None, 1), (5, "revisit", 1, 1), (6, "revisit", 1, 1), (7, "response", None, 1), (9, "response", None, 1)]


def test_a_revisit_without_its_response_stays(spark):
    a = spark.createDataFrame([(5, "u5", "p"), (6, "u6", "p")], "page_id bigint, url string, html string")
    found = warc.headers(spark, warc.deduplicate(spark, warc.capture(a, shared_path(spark, "test-warc-o")),
                                                 shared_path(spark, "test-warc-o2")))
    lone = [r for r in warc.resolve(found.where("record_type = 'revisit'")).collect()]
    assert [(r["page_id"], r["kept_type"], r["first_id"] == r["refers_to_id"]) for r in lone] == [("6", "revisit", True)]


def test_empty_table_and_broken_archives(pages, spark):
    assert warc.round_trip(spark.createDataFrame([], pages.schema)).collect() == []
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n"
    with pytest.raises(ValueError, match="block"):
        list(warc.parse(io.BytesIO(head + b"abc")))
    with pytest.raises(ValueError, match="header"):
        list(warc.parse(io.BytesIO(head[:-2])))
    with pytest.raises(ValueError, match="no record"):
        list(warc.parse(io.BytesIO(head + b"abcde!\r\n\r\n")))
    assert len(list(warc.parse(io.BytesIO(head + b"abcde\r\n\r\n" + head + b"abcde")))) == 2


def test_frequent_digests_meet_in_a_broadcast(spark):
    rows = spark.range(5000).selectExpr("if(id < 2000, 'hot', cast(id as string)) AS k", "id")
    firsts = rows.groupBy("k").agg({"id": "min"}).withColumnRenamed("min(id)", "first")
    got = warc._join_first(rows, firsts, "k").collect()
    assert len(got) == 5000 and all(r["first"] == (0 if r["k"] == "hot" else r["id"]) for r in got)
