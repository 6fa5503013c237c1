"""Operator 8: cost-balanced packing of token ids into sequences of at most ``capacity``.

A sequence's cost is estimated as ``linear * length + quadratic * length ** 2``
summed over the documents in it (attention stays within a document).  Texts are
encoded and packed block by block in the task that reads them, so nothing is
shuffled and a lost task repeats its own blocks only:

* a document's full chunks of ``capacity`` ids are sequences of their own;
* the rests, in descending order, each go to the lowest-cost sequence that still
  has room.  A block opens exactly the room its rests need: full sequences, and
  for what is left over one sequence for each power of two in its binary form;
* a rest that fits nowhere whole is cut over the room that is left, lowest cost
  first, so every sequence ends exactly full and needs no padding.

Defined cases: a null or empty text is the end id alone; repeated rows and null
ids are documents of their own; an empty table gives no pieces; a document longer
than a block is a block.  ``<|endoftext|>`` in a text is ordinary text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescore.llm import arrays

CAPACITY = 2048
END_ID = 1
BLOCK_BYTES = 8 << 20
#: Words a worker remembers between blocks (bounds its memory, not the result).
REMEMBERED = 1_000_000
#: And the ids of those, together.
REMEMBERED_IDS = 6 * REMEMBERED
#: Texts of a block encoded at a time (bounds a worker's memory, not the result).
STRETCH_BYTES = 1 << 19
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
PIECES = ("doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, sequence_length bigint, cost double")


class Words:
    """Ids of the words a worker remembers: sorted hashes, and where each word's ids lie in one growing buffer."""

    def __init__(self, vocabulary: int):
        self.hashes, self.used = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.starts, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.size = np.zeros(0, np.uint16 if vocabulary <= 1 << 16 else np.uint32), 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it known, its place or the place to put it) of ascending hashes."""
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        return known, at

    def add(self, hashes: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> None:
        """Ascending hashes of new words and their ids, one word's after another's."""
        at = np.searchsorted(self.hashes, hashes)
        end = self.size + len(flat)
        if end > len(self.flat):
            grown = np.empty(max(end, min(2 * len(self.flat), REMEMBERED_IDS)), self.flat.dtype)
            grown[:self.size] = self.flat[:self.size]
            self.flat = grown
        self.flat[self.size:end] = flat
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts = np.insert(self.starts, at, self.size + np.cumsum(lens) - lens)
        self.lens = np.insert(self.lens, at, lens)
        self.used = np.insert(self.used, at, False)
        self.size = end

    def forget(self, needed: np.ndarray) -> None:
        """Keep the words at places ``needed`` and, where these fill at most half, those used since the last time."""
        keep = self.used
        keep[needed] = True
        if 2 * int(keep.sum()) > REMEMBERED or 2 * int(self.lens[keep].sum()) > REMEMBERED_IDS:
            keep = np.zeros(len(self.hashes), bool)
            keep[needed] = True
        self.hashes, lens = self.hashes[keep], self.lens[keep]
        self.flat = arrays.gather(self.flat, self.starts[keep], lens)
        self.starts, self.lens = np.cumsum(lens, dtype=np.int32) - lens, lens
        self.size, self.used = len(self.flat), np.zeros(len(lens), bool)


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    newline = tok.encode("\n", add_special_tokens=False).ids
    return tok, newline[0] if len(newline) == 1 else None, Words(max(tok.get_vocab(True).values()) + 1)


def encode_words(path: str, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the words, how many each has).  Words are encoded many at a time, a line each: a newline
    is a word and an id of its own, and no word but white space holds one."""
    tok, newline, _ = _tokenizer(path)
    joined = np.full(int(lens.sum()) + len(lens), 0x0A, np.uint8)
    joined[np.arange(int(lens.sum())) + np.repeat(np.arange(len(lens)), lens)] = arrays.gather(data, starts, lens)
    ends = np.cumsum(lens + 1)
    cls, _ = arrays.byte_classes(joined)
    lone = cls[ends - 2] == arrays.SPACE                 # white space: encoded by itself
    if newline is None:
        lone[:] = True
    raw, begins = joined.tobytes(), ends - lens - 1
    plain = np.flatnonzero(~lone)
    parts, counts = [], np.zeros(len(lens), np.int64)
    for lo in range(0, len(plain), 4096):
        which = plain[lo:lo + 4096]
        text = arrays.gather(joined, begins[which], lens[which] + 1).tobytes().decode()
        ids = np.asarray(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        line = np.flatnonzero(ids == newline)
        counts[which] = np.diff(line, prepend=-1) - 1
        parts.append(ids[ids != newline])
    for k in np.flatnonzero(lone).tolist():
        ids = tok.encode(raw[begins[k]:begins[k] + lens[k]].decode(), add_special_tokens=False).ids
        counts[k] = len(ids)
        parts.append(np.asarray(ids, np.uint32))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    order = np.concatenate([plain, np.flatnonzero(lone)])  # as encoded; back to the order given
    at = np.empty(len(lens), np.int64)
    at[order] = np.cumsum(counts[order]) - counts[order]
    return arrays.gather(flat, at, counts), counts


def encode_block(path: str, data: np.ndarray, off: np.ndarray, end_id: int | None
                 ) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts of the block, each with ``end_id`` after it; offsets).

    The arrays per byte, word and id, many times the text's size, are those of one stretch of it."""
    parts, counts = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
    for lo, hi in arrays.runs(off, STRETCH_BYTES):
        ids, n = _encode_stretch(path, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], end_id)
        parts.append(ids)
        counts.append(n)
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def _encode_stretch(path: str, data: np.ndarray, off: np.ndarray, end_id: int | None
                    ) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the texts, each with ``end_id`` after it; how many each has)."""
    known = _tokenizer(path)[2]
    starts = arrays.pretokens(data, off)
    ends = np.append(starts[1:], len(data))
    hashes, at, rank = np.unique(arrays.hash_slices(data, starts, ends), return_index=True, return_inverse=True)
    hit, place = known.find(hashes)
    new = at[~hit]
    if len(new):
        fresh, lens = encode_words(path, data, starts[new], (ends - starts)[new])
        if len(known.hashes) + len(new) > REMEMBERED or known.size + len(fresh) > REMEMBERED_IDS:
            known.forget(place[hit])
        known.add(hashes[~hit], fresh, lens)
        place = known.find(hashes)[1]
    known.used[place[hit]] = True
    n_words = known.lens[place].astype(np.int64)[rank]
    ids = arrays.gather(known.flat, known.starts[place].astype(np.int64)[rank], n_words).astype(np.uint32)
    at_id = np.concatenate([[0], np.cumsum(n_words)])[np.searchsorted(starts, off)]
    if end_id is None:
        return ids, np.diff(at_id)
    return np.insert(ids, at_id[1:], np.uint32(end_id)), np.diff(at_id) + 1


def pack_lengths(lengths: np.ndarray, capacity: int, linear: float = LINEAR,
                 quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[float]]:
    """Pieces (document, start, length, sequence, offset) and the cost of each sequence."""
    def cost(n: int) -> float:
        return linear * n + quadratic * n * n

    pieces, costs, room, used = [], [], [], []
    for doc in np.flatnonzero(lengths >= capacity).tolist():
        for start in range(0, int(lengths[doc]) - capacity + 1, capacity):
            pieces.append((doc, start, capacity, len(costs), 0))
            costs.append(cost(capacity))
            room.append(0)
            used.append(capacity)
    rest = lengths % capacity
    total = int(rest.sum())
    sizes = [capacity] * (total // capacity)
    sizes += [1 << k for k in range(capacity.bit_length()) if (total % capacity) >> k & 1]
    active, parked = [], []
    for size in sizes:
        heapq.heappush(active, (0.0, len(costs)))
        costs.append(0.0)
        room.append(size)
        used.append(0)

    def put(doc: int, start: int, n: int, seq: int) -> None:
        pieces.append((doc, start, n, seq, used[seq]))
        used[seq] += n
        room[seq] -= n
        costs[seq] += cost(n)

    cut = []
    order = np.argsort(-rest, kind="stable")
    for doc in order[:int((rest > 0).sum())].tolist():
        n = int(rest[doc])
        while parked and -parked[0][0] >= n:
            seq = heapq.heappop(parked)[1]
            heapq.heappush(active, (costs[seq], seq))
        while active:
            seq = heapq.heappop(active)[1]
            if room[seq] >= n:
                put(doc, int(lengths[doc]) - n, n, seq)
                if room[seq]:
                    heapq.heappush(active, (costs[seq], seq))
                break
            heapq.heappush(parked, (-room[seq], seq))
        else:
            cut.append(doc)
    left = sorted((seq for seq in range(len(room)) if room[seq]), key=lambda s: (-costs[s], s))
    for doc in cut:
        n = int(rest[doc])
        start = int(lengths[doc]) - n
        while n:
            step = min(n, room[left[-1]])
            put(doc, start, step, left[-1])
            start, n = start + step, n - step
            if not room[left[-1]]:
                left.pop()
    return pieces, costs


def _pack(path: str, end_id: int, capacity: int, block_bytes: int, linear: float, quadratic: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        sequence = TaskContext.get().partitionId() << 36
        for rows, data, off in arrays.blocks(batches, "text", block_bytes):
            ids, at = encode_block(path, data, off, end_id)
            lengths = np.diff(at)
            pieces, costs = pack_lengths(lengths, capacity, linear, quadratic)
            doc, start, n, seq, offset = np.array(pieces, np.int64).reshape(-1, 5).T
            order = np.lexsort((start, doc))                # pieces of a text lie one after another
            doc, start, n, seq, offset = (x[order] for x in (doc, start, n, seq, offset))
            full = np.bincount(seq, weights=n, minlength=len(costs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(n),
                 arrays.binary_array(ids.astype("<u4", copy=False), np.append(at[doc] + start, len(ids))
                                     ).cast(pa.binary()),
                 pa.array(lengths[doc]), pa.array(sequence + seq), pa.array(offset),
                 pa.array(full[seq]), pa.array(np.array(costs)[seq])],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset",
                       "sequence_length", "cost"])
            sequence += len(costs)
    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         end_id: int = END_ID, capacity: int = CAPACITY, block_bytes: int = BLOCK_BYTES,
         linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """One row per piece, with its ids; ``capacity`` must be a power of two."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                        F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_pack(tokenizer_path, end_id, capacity, block_bytes, linear, quadratic),
                            PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    """The contract's columns first, then the sequence's length and estimated cost."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "sequence_length", "cost")
