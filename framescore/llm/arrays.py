"""Text columns as flat numpy arrays: what the Arrow tasks of this subpackage share.

A column of strings reaches a task as one UTF-8 buffer plus offsets.  The
helpers below split, hash and gather on that buffer without a Python object per
word, so the cost of a task is a few passes over its bytes.  Nulls are empty
texts.  A *block* is a run of whole rows of about ``max_bytes`` of text; memory
of a task is a small multiple of the larger of that and its longest document.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The white space of the words `[^\x20\x09-\x0D]+`.
WORD_BREAKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
# Unicode White_Space, the `\s` of the tokenizer patterns.
UNICODE_SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002,
                  0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029,
                  0x202F, 0x205F, 0x3000)

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_HASH_BYTES = 1 << 17


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, int64 offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if binary else "")
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int
           ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut the batches into runs of whole rows: (rows, bytes, offsets)."""
    for batch in batches:
        data, off = text_bytes(batch.column(column))
        for lo, hi in runs(off, max_bytes):
            yield batch.slice(lo, hi - lo), data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        release()


def release() -> None:
    """Give back what the allocators hold but nobody uses: a worker stays between tasks, and its free memory
    counts as its executor's."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()               # numpy's, too


def runs(offsets: np.ndarray, max_bytes: int) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of runs of whole rows of at most ``max_bytes``, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def binary_array(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """large_binary column of the slices of a flat array (offsets in elements)."""
    raw = np.ascontiguousarray(flat)
    off = np.ascontiguousarray(offsets, np.int64) * raw.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1,
                                 [None, pa.py_buffer(off), pa.py_buffer(raw)])


@lru_cache(maxsize=1)
def _hash_tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240601)
    full = np.iinfo(np.uint64).max
    return (rng.integers(0, full, 256, dtype=np.uint64),
            rng.integers(0, full, 8192, dtype=np.uint64) | np.uint64(1))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift multiply) of an array of hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hash_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                fold: bool = False) -> np.ndarray:
    """64-bit multilinear hash of each non-empty slice; ``fold``: A-Z equal a-z.

    The slices must be disjoint and ascending.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    byte, weight = _hash_tables()
    if fold:
        byte = byte.copy()
        byte[65:91] = byte[97:123]
    lens = ends - starts
    total = np.cumsum(lens)
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):                                # runs of slices whose arrays stay in the cache
        hi = int(np.searchsorted(total, total[lo] - lens[lo] + _HASH_BYTES, side="right"))
        hi = max(hi, lo + 1)
        out[lo:hi] = _hash_run(data, starts[lo:hi], ends[lo:hi], lens[lo:hi], byte, weight)
        lo = hi
    return out


def _hash_run(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lens: np.ndarray, byte: np.ndarray,
              weight: np.ndarray) -> np.ndarray:
    before = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum()), dtype=np.int32 if lens.sum() < 1 << 31 else np.int64)
    pos -= np.repeat(before.astype(pos.dtype), lens)
    if (starts[1:] == ends[:-1]).all():
        terms = byte[data[starts[0]:ends[-1]]]
    else:
        terms = byte[data[np.repeat(starts, lens) + pos]]
    if int(lens.max()) > len(weight):
        terms *= weight[pos % len(weight)] + (pos // len(weight)).astype(np.uint64) * np.uint64(2)
    else:
        terms *= weight[pos]
    return mix(np.add.reduceat(terms, before) + lens.astype(np.uint64) * weight[7])


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row plus the total) of `[^\\x20\\x09-\\x0D]+`."""
    table = np.ones(256, bool)
    table[list(WORD_BREAKS)] = False
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)          # a row's edge ends a word, too
    edge[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, offsets)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, from the general categories."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for cp in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(cp))[0]
        if major == "L":
            table[cp] = LETTER
        elif major == "N":
            table[cp] = NUMBER
    table[list(UNICODE_SPACES)] = SPACE
    return table


def byte_classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of the character each byte belongs to, is it the character's first byte)."""
    table = _classes()
    cls = table[:256][data]
    lead = (data & 0xC0) != 0x80
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        padded = np.concatenate([data, np.zeros(4, np.uint8)])
        b0, b1, b2, b3 = (padded[wide + k].astype(np.uint32) for k in range(4))
        two = ((b0 & 31) << 6) | (b1 & 63)
        three = ((b0 & 15) << 12) | ((b1 & 63) << 6) | (b2 & 63)
        four = ((b0 & 7) << 18) | ((b1 & 63) << 12) | ((b2 & 63) << 6) | (b3 & 63)
        cp = np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four))
        kind = table[np.minimum(cp, sys.maxunicode)]
        cls[wide] = kind
        length = np.where(b0 < 0xE0, 2, np.where(b0 < 0xF0, 3, 4))
        for k in (1, 2, 3):
            at = wide[length > k] + k
            ok = at < len(data)
            cls[at[ok]] = kind[length > k][ok]
    return cls, lead


def pretokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of every match of the byte-level pattern, in all rows at once.

    The pattern is "contraction | optional space + letters | optional space +
    numbers | optional space + others | white space".  Matches tile a row, so a
    match ends where the next one (or the next row) starts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    cls, lead = byte_classes(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True                                   # first byte of a row (or its end)
    change = np.ones(n, bool)
    change[1:] = cls[1:] != cls[:-1]
    run = lead & (change | first[:n])
    space = cls == SPACE
    start = run.copy()
    glued = np.zeros(n, bool)                               # a plain space stands before, same row
    glued[1:] = data[:-1] == 0x20
    glued &= ~first[:n]
    start[run & ~space & glued] = False
    # the last white space before a word is a match of its own or the word's first character
    tail = np.flatnonzero(run & ~space & ~first[:n])
    tail = tail[space[tail - 1]]
    last = tail - 1
    while len(last):
        cont = ~lead[last]
        start[last[~cont]] = True
        last = last[cont] - 1
    # contractions: an apostrophe that begins a match, then s t m d re ve ll
    quote = np.flatnonzero((data == 0x27) & start)
    if len(quote):
        pad = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two = pad[quote + 1], pad[quote + 2]
        same1 = ~first[np.minimum(quote + 1, n)]
        same2 = same1 & ~first[np.minimum(quote + 2, n)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & same1
        long = (((one == 114) & (two == 101)) | ((one == 118) & (two == 101))
                | ((one == 108) & (two == 108))) & same2
        for hit, width in ((short, 2), (long, 3)):
            at = quote[hit]
            start[at + 1] = False
            nxt = at + width
            nxt = nxt[nxt < n]
            start[nxt] = True
    return np.flatnonzero(start)


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of flat[starts[i]:starts[i] + lens[i]]."""
    total = int(lens.sum())
    if not total:
        return flat[:0]
    before = np.cumsum(lens) - lens
    return flat[np.arange(total, dtype=np.int64) + np.repeat(starts - before, lens)]


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of one row of each value, most frequent first; rank of each row)."""
    _, at, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True,
                                       return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return at[order], rank[inverse]
