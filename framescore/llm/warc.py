"""Operator 11: WARC archives without repeated payloads (revisit resolution).

``capture`` writes one response record per row of a table of pages, in one pass.  ``headers``
reads what archives hold, without their payloads.  ``resolve`` shuffles those headers by payload
digest: of the responses with one digest the first (least page id, then place) stays a response
and every other record becomes a revisit of it; revisits that came with the archives are joined
to the same response.  ``deduplicate`` sends the decisions to the files they are about and writes
every record anew, in the order of its file, with fresh headers (record id, date, lengths, block
digest); a revisit keeps its HTTP header and leaves out its payload.  ``restored`` reads such an
archive and joins each revisit to the response that it names, which gives its payload's size.

Only headers are shuffled, never payloads.  A digest may belong to any share of the records:
its first response is a partial aggregate, and records of frequent digests (over a thousandth of
all, so under a thousand digests) meet it in a broadcast, all others in a join of small groups.
Archives are written by Spark's text sink, whose commit drops what a lost task has written; a
record's end is the sink's line separator.  Reading frames records by ``Content-Length``, so a
payload may hold blank lines or record headers.  A file is read as a stream of records by one task.

Defined cases: a null payload is empty, and an empty payload is a payload like any other; null
page ids come after all others and a revisit of such a response refers to null; repeated rows are
records of their own; a null url leaves its header out, and control characters in a url are
percent-encoded; a revisit whose response is in no archive stays one, with null size; an empty
table makes an empty archive.  Other columns of the table are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.llm.tables import shuffle_width, stored
from framescore.session import _filesystem, shared_path

# Names and formats of WARC 1.1.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
RECORD_END = CRLF * 2
HTTP_BLOCK = "application/http;msgtype=response"

#: A file holds at most so many records.
FILE_RECORDS = 50_000
#: A record's digest counts as frequent above this share of all records.
FREQUENT = 1000
_BATCH_BYTES = 8 << 20

HEADERS = ("file string, pos bigint, record_type string, record_id string, page_id string, uri string, date string, "
           "digest string, payload_bytes bigint, refers_to_id string")


# ------------------------------------------------------------------ columns

def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: ten hex digits are eight of base 32."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), digits, BASE32)


def _header(name: str, value: Column) -> Column:
    """One header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit(""))


def _urn(*parts: Column) -> Column:
    """A record id that follows from the parts."""
    h = F.md5(F.concat_ws("\x1f", *parts).cast("binary"))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def _http(length: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    length.cast("string"), F.lit(CRLF * 2))


def _clean_uri(url: str) -> Column:
    """Control characters would end a header line: they become %XX."""
    code = "if(i = 32, 127, i)"
    out = F.expr("aggregate(sequence(0, 32), `url`, (u, i) -> replace(u, char(CODE), concat('%', lpad(hex(CODE), 2, '0'))))"
                 .replace("CODE", code).replace("`url`", url))
    return F.when(F.col(url).rlike(r"[\x00-\x1F\x7F]"), out).otherwise(F.col(url))


# ------------------------------------------------------------------ writing

def _write(records: DataFrame, path: str) -> str:
    (records.select("value").write.option("lineSep", RECORD_END).option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))
    return path


def capture(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
            ) -> str:
    """Write a response record per row; returns the archive's folder."""
    rows = pages.select(
        F.col(id_col).cast("string").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
        F.monotonically_increasing_id().alias("place"))
    rows = rows.select("page_id", "url", "payload", "place", base32_sha1(F.col("payload")).alias("digest"),
                       _http(F.octet_length("payload")).alias("http"))
    head = F.concat(
        F.lit(VERSION + CRLF), F.lit("WARC-Type: response" + CRLF),
        _header("WARC-Record-ID", _urn(F.lit("capture"), F.col("place").cast("string"), F.col("page_id"), F.col("digest"))),
        _header("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                                           "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _header("WARC-Target-URI", _clean_uri("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _header("Page-Id", F.col("page_id")), F.lit(f"Content-Type: {HTTP_BLOCK}{CRLF}"),
        _header("Content-Length", (F.octet_length("http") + F.octet_length("payload")).cast("string")), F.lit(CRLF))
    # bytes pass through a string column unchanged, whatever they are
    return _write(rows.select(F.concat(head, "http", F.col("payload").cast("string")).alias("value")), path)


# ------------------------------------------------------------------ reading

def parse(stream) -> Iterator[tuple[dict, bytes]]:
    """(header fields by lower-case name, block) of every record of a decompressed stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts here: {line[:40]!r}")
        fields = {}
        for line in iter(stream.readline, b"\r\n"):
            if not line:
                raise ValueError("an archive ends inside a record's header")
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("an archive ends inside a record's block")
        yield fields, block


def split_block(fields: dict, block: bytes) -> tuple[bytes, bytes]:
    """(HTTP header with its blank line, payload)."""
    if not fields.get("content-type", "").startswith("application/http"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[:end + 4], block[end + 4:])


def _open(path: str):
    fs, p = _filesystem(path)
    return io.BufferedReader(fs.open_input_stream(p, compression="gzip" if p.endswith(".gz") else None), 1 << 20)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in HEADERS.split(", ")]
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows = []
            with _open(path) as stream:
                for pos, (f, block) in enumerate(parse(stream)):
                    kind = f.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    stated = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    _, payload = split_block(f, block)
                    whole = kind == "response"
                    rows.append((path, pos, kind, f.get("warc-record-id"), f.get("page-id"), f.get("warc-target-uri"),
                                 f.get("warc-date"), _digest(payload) if whole else stated,
                                 len(payload) if whole else None, f.get("warc-refers-to")))
                    if len(rows) >= 20_000:
                        yield _batch(names, rows)
                        rows = []
            if rows:
                yield _batch(names, rows)


def _batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if n in ("pos", "payload_bytes") else pa.string() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The archive's files, a few to a task."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return listed.repartition(shuffle_width(spark), "path")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """A row per response and revisit of the archives below ``path``; a response's digest and size
    are computed from its payload, a revisit states its digest."""
    return _files(spark, path).mapInArrow(_header_rows, HEADERS)


# ------------------------------------------------------------------ resolving

def _join_first(rows: DataFrame, firsts: DataFrame, key: str) -> DataFrame:
    """Left join with ``firsts``, one row a key, where a key may hold any share of ``rows``."""
    total = rows.count()
    frequent = (rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
                .where(F.col("_n") * FREQUENT > total).select(key))          # fewer than FREQUENT keys
    often = rows.join(F.broadcast(frequent), key, "left_semi").join(
        F.broadcast(firsts.join(F.broadcast(frequent), key, "left_semi")), key, "left")
    rest = rows.join(F.broadcast(frequent), key, "left_anti").join(firsts, key, "left")
    return often.unionByName(rest)


def resolve(found: DataFrame) -> DataFrame:
    """``headers`` with ``kept_type`` (response or revisit) and, for revisits, the response's
    ``first_id``, ``first_uri`` and ``first_date``.  ``found`` is read three times: store it first."""
    rank = F.struct(F.col("page_id").cast("bigint").isNull().alias("none"), F.col("page_id").cast("bigint").alias("page"),
                    F.col("file"), F.col("pos"))
    firsts = (found.where("record_type = 'response'").groupBy("digest")
              .agg(F.min_by(F.struct("file", "pos", "record_id", "uri", "date"), rank).alias("first")))
    joined = _join_first(found, firsts, "digest")
    is_first = F.coalesce((F.col("first.file") == F.col("file")) & (F.col("first.pos") == F.col("pos")), F.lit(False))
    revisit = F.when(~is_first, F.lit(True))
    return joined.select(
        *found.columns, F.when(is_first, "response").otherwise("revisit").alias("kept_type"),
        F.when(revisit, F.coalesce("first.record_id", "refers_to_id")).alias("first_id"),
        F.when(revisit, F.col("first.uri")).alias("first_uri"), F.when(revisit, F.col("first.date")).alias("first_date"))


def _fresh_id(record_id: str) -> str:
    """Of a record in the new archive: follows from the old one, so that references can be written at once."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'deduplicated:' + record_id)}>"


def fresh_record(fields: dict, block: bytes, decision: dict, date: str) -> bytes:
    """The record under its decision, without the separator that follows it."""
    http, payload = split_block(fields, block)
    revisit = decision["kept_type"] == "revisit"
    body = http if revisit else block
    lines = [VERSION, f"WARC-Type: {decision['kept_type']}", f"WARC-Record-ID: {_fresh_id(fields['warc-record-id'])}",
             f"WARC-Date: {date}"]
    if decision["uri"] is not None:
        lines.append(f"WARC-Target-URI: {decision['uri']}")
    lines.append(f"WARC-Payload-Digest: sha1:{decision['digest']}")
    lines.append(f"WARC-Block-Digest: sha1:{_digest(body)}")
    if revisit:
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
        for name, key in (("WARC-Refers-To", "first_id"), ("WARC-Refers-To-Target-URI", "first_uri"),
                          ("WARC-Refers-To-Date", "first_date")):
            if decision[key] is not None:
                lines.append(f"{name}: {_fresh_id(decision[key]) if key == 'first_id' else decision[key]}")
    if decision["page_id"] is not None:
        lines.append(f"Page-Id: {decision['page_id']}")
    lines += [f"Content-Type: {fields.get('content-type', HTTP_BLOCK)}", f"Content-Length: {len(body)}", "", ""]
    return CRLF.join(lines).encode() + body


def _fresh_records(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stream, records, at = None, None, None, -1
        out, size = [], 0
        for batch in batches:
            for d in batch.to_pylist():                       # in the order of file and place
                if d["file"] != path:
                    if stream is not None:
                        stream.close()
                    path, stream = d["file"], _open(d["file"])
                    records, at = parse(stream), -1
                while at < d["pos"]:
                    fields, block = next(records)
                    at += 1
                out.append(fresh_record(fields, block, d, date))
                size += len(out[-1])
                if size >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.large_binary())], ["value"])
                    out, size = [], 0
        if stream is not None:
            stream.close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.large_binary())], ["value"])
    return run


def deduplicate(spark: SparkSession, path: str, out: str) -> str:
    """Write the archives below ``path`` anew to ``out``, each payload once; returns ``out``."""
    decided = resolve(stored(headers(spark, path), "warc-headers"))
    date = decided.select(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                                        "yyyy-MM-dd'T'HH:mm:ss'Z'")).limit(1).collect()
    by_file = (decided.select("file", "pos", "page_id", "uri", "digest", "kept_type", "first_id", "first_uri", "first_date")
               .repartition(shuffle_width(spark), "file").sortWithinPartitions("file", "pos"))
    fresh = by_file.mapInArrow(_fresh_records(date[0][0] if date else ""), "value binary")
    return _write(fresh.select(F.col("value").cast("string").alias("value")), out)


def restored(spark: SparkSession, path: str) -> DataFrame:
    """The records of a deduplicated archive, each revisit joined to the response that it names:
    its page id and payload size."""
    found = stored(headers(spark, path), "warc-fresh-headers")
    named = found.where("record_type = 'revisit'").select(F.col("refers_to_id").alias("id")).distinct()
    firsts = found.where("record_type = 'response'").join(named, F.col("record_id") == F.col("id"), "left_semi").groupBy(
        F.col("record_id").alias("refers_to_id")).agg(
        F.min_by(F.struct("page_id", "payload_bytes"), F.struct("file", "pos")).alias("first"))
    revisits = _join_first(found.where("record_type = 'revisit'"), firsts, "refers_to_id")
    whole = found.where("record_type = 'response'").withColumn("first", F.lit(None).cast(revisits.schema["first"].dataType))
    both = whole.unionByName(revisits)
    return both.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.coalesce("payload_bytes", "first.payload_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type", F.col("first.page_id").cast("bigint").alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written as archives, deduplicated, and read back."""
    spark = pages.sparkSession
    raw = capture(pages, shared_path(spark, "llm-warc-captured"))
    return restored(spark, deduplicate(spark, raw, shared_path(spark, "llm-warc")))


#: The contract's rows in DuckDB's SQL.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY page_id NULLS LAST) AS i,
        first_value(page_id) OVER (PARTITION BY x ORDER BY page_id NULLS LAST) AS first FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', 1 + ((
         ('0x' || substr(x, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN i = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN i > 1 THEN first END AS refers_to
FROM o
"""
