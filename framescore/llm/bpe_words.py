"""Operator 7: byte-level BPE encoding and decoding by a global distinct-word shuffle.

A pre-token ("word") always has the same ids, so every distinct word of the
corpus is encoded once:

1. *Explode.*  Each task splits blocks of texts into words (arrays, no Python
   object per word).  A block keeps its words as positions in its own list of
   distinct words; that list is dealt out by the words' hash.
2. *Encode.*  All blocks' copies of a word meet in one task, which encodes it once
   and sends its ids back to the blocks that hold it.
3. *Reassemble.*  A block puts the ids in the order of its positions.  Decoding
   joins the ids with the token-byte table in the same way.

Exploding whole occurrences would shuffle every word of the corpus twice; a block
ships each of its distinct words once, and one packed row per (block, word
bucket).  A very common word is one entry per block, so no key is hot.

Defined cases: a null or empty text has no ids and decodes to nothing; repeated
rows and null ids are rows of their own; a text of one huge word is one word; an
empty table gives an empty result.  Columns of the input other than the two named
ones are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescore.llm import arrays
from framescore.llm.tables import shuffle_width

BLOCK_BYTES = 8 << 20
_PACKED = "block bigint, part int, ids array<bigint>, a binary, b binary, c binary"
_PACKED_ARROW = pa.schema([("block", pa.int64()), ("part", pa.int32()),
                           ("ids", pa.list_(pa.int64())), ("a", pa.binary()), ("b", pa.binary()),
                           ("c", pa.binary())])
ENCODED = "doc_id bigint, n_tokens bigint, ids binary, decoded binary"


@lru_cache(maxsize=2)
def _encoding(ranks_path: str):
    """(encoder of one word, flat token bytes, offsets of each token in them)."""
    import tiktoken
    from public_tokenizers import PATTERN
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(tok): int(rank) for tok, rank in (x.split() for x in f if x.strip())}
    enc = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(ranks.values()) + 1)
    for tok, rank in ranks.items():
        tokens[rank] = tok
    off = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum([len(t) for t in tokens], out=off[1:])
    return enc._encode_single_piece, np.frombuffer(b"".join(tokens), np.uint8), off


def _squeeze(values: np.ndarray) -> bytes:
    """uint32 values as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _stretch(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = pa.decompress(raw[8:], 4 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").ravel()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _PACKED_ARROW]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(cols, _PACKED_ARROW, strict=True)], schema=_PACKED_ARROW)


def _explode(parts: int, block_bytes: int):
    """Task of step 1: a row (part -1) of positions, and a row of words per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        for rows, data, off in arrays.blocks(batches, "text", block_bytes):
            starts = arrays.pretokens(data, off)
            ends = np.append(starts[1:], len(data))
            hashes = arrays.hash_slices(data, starts, ends)
            at, rank = arrays.distinct(hashes)
            first = np.searchsorted(starts, off)
            out = [(block, -1, rows.column("doc_id").to_pylist(),
                    np.diff(first).astype("<u4").tobytes(), _squeeze(rank), None)]
            bucket = (hashes[at] >> np.uint64(16)) % np.uint64(parts)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(parts + 1, dtype=np.uint64))
            lens = (ends - starts)[at]
            for p in range(parts):
                own = order[cut[p]:cut[p + 1]]
                if len(own):
                    out.append((block, p, None, own.astype("<u4").tobytes(),
                                lens[own].astype("<u4").tobytes(),
                                arrays.gather(data, starts[at[own]], lens[own]).tobytes()))
            yield _rows(out)
            block += 1
    return run


def _encode(ranks_path: str):
    """Task of step 2: each distinct word of a bucket is encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks_path)[0]
        known: dict[bytes, bytes] = {}
        current = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != current:
                    known, current = {}, row["part"]
                ends = np.cumsum(np.frombuffer(row["b"], "<u4").astype(np.int64)).tolist()
                got, lo, raw = [], 0, row["c"]
                for hi in ends:
                    word = raw[lo:hi]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.asarray(encode(word), "<u4").tobytes()
                    got.append(ids)
                    lo = hi
                lens = np.fromiter(map(len, got), np.int64, len(got)) // 4
                yield _rows([(row["block"], current, None, row["a"], _squeeze(lens),
                              _squeeze(np.frombuffer(b"".join(got), "<u4")))])
    return run


def _reassemble(ranks_path: str):
    """Task of step 3: a block's ids in the order of its positions, and their bytes."""
    def finish(doc_ids, counts, rank, pieces) -> pa.RecordBatch:
        _, token_bytes, token_off = _encoding(ranks_path)
        size = int(rank.max()) + 1 if len(rank) else 0
        lens, starts = np.zeros(size, np.int64), np.zeros(size, np.int64)
        flat, base = [np.zeros(0, np.uint32)], 0
        for own, n, ids in pieces:
            lens[own] = n
            starts[own] = base + np.cumsum(n) - n
            flat.append(ids)
            base += len(ids)
        words = lens[rank]
        ids = arrays.gather(np.concatenate(flat), starts[rank], words).astype("<u4")
        at_word = np.concatenate([[0], np.cumsum(counts)])
        at_id = np.concatenate([[0], np.cumsum(words)])[at_word]
        width = (token_off[1:] - token_off[:-1])[ids]
        text = arrays.gather(token_bytes, token_off[ids], width)
        at_byte = np.concatenate([[0], np.cumsum(width)])[at_id]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(np.diff(at_id), pa.int64()),
             arrays.binary_array(ids, at_id).cast(pa.binary()),
             arrays.binary_array(text, at_byte).cast(pa.binary())],
            names=["doc_id", "n_tokens", "ids", "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] < 0:
                    if held:
                        yield finish(*held)
                    counts = np.frombuffer(row["a"], "<u4").astype(np.int64)
                    held = (row["ids"], counts, _stretch(row["b"]).astype(np.int64), [])
                else:
                    held[3].append((np.frombuffer(row["a"], "<u4"),
                                    _stretch(row["b"]).astype(np.int64), _stretch(row["c"])))
        if held:
            yield finish(*held)
    return run


def encode_decode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text",
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned
    32-bit) and ``decoded`` (the bytes the ids stand for)."""
    parts = shuffle_width(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                        F.col(text_col).cast("string").alias("text"))
    exploded = texts.mapInArrow(_explode(parts, block_bytes), _PACKED)
    words = exploded.filter("part >= 0").repartition(parts, "part").sortWithinPartitions("part")
    encoded = words.mapInArrow(_encode(ranks_path), _PACKED)
    joined = (exploded.filter("part < 0").unionByName(encoded)
              .repartition(parts, "block").sortWithinPartitions("block", "part"))
    return joined.mapInArrow(_reassemble(ranks_path), ENCODED)


def digests(encoded: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's ids and texts."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
