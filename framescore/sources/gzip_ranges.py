"""Restart points in gzip files, so that one file is read by many tasks.

A first pass streams a file once and notes, about every ``every`` bytes of output, a place
where decompression can start again: the beginning of a deflate block (byte and bit) with the
32 KB of output before it, or the beginning of a gzip member.  A second pass reads the ranges
between such points in parallel (``read_range``).

A block's beginning is found from outside: near a wanted point the stream is fed byte by byte,
and the code tables at the head of a block are the only long run of bytes that give no output.
Each bit position around the run's start is tried, and one is taken only when decompressing from
there gives the same output as the stream itself.  To start between two bytes, the decompressor
is first given whole empty blocks whose bits end at the wanted bit (``_lead_in``), so the rest
needs no shifting and stored blocks keep their byte alignment.

Ranges cover the output without gaps whatever points are found; a file without any (stored or
fixed code blocks only) is one range.  Every range carries the CRC of its output, which the
reader checks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

WINDOW = 1 << 15
FEED = 1 << 16
#: bytes without output that announce a block with code tables; symbols alone take 6 at most
QUIET = 10
#: compressed bytes searched for a block's beginning before the wanted point is given up
SEARCH = 1 << 18
#: compressed bytes decompressed from a beginning, and the output they must give at least,
#: before it is taken
AHEAD, AGREE = 1 << 13, 1 << 12
#: bytes around the end of the last output in which a block may begin
AROUND = 4
#: CRC and length behind a member's blocks
TRAILER = 8
MEMBER = -1
RAW, GZIP = -15, 31


class Range(NamedTuple):
    """Output bytes [start, end): decompression starts at ``byte`` and ``bit`` (``MEMBER``: a
    gzip header) after the output ``window``."""
    byte: int
    bit: int
    window: bytes
    start: int
    end: int
    crc: int


def _bits(*fields: tuple[int, int]) -> list[int]:
    """Bits of (value, width) fields, least significant bit first."""
    return [(value >> i) & 1 for value, width in fields for i in range(width)]


# An empty block of fixed codes: not the last, type 1, end-of-block code of seven zeros: 10 bits.
_EVEN = _bits((0, 1), (1, 2), (0, 7))
# An empty block with code tables of its own: 257 literal codes and one distance code; of the 18
# code length codes (order 16 17 18 0 8 ... 14 1) 18 has two bits, 0 one, 1 two, so their codes
# are 0 = 0, 1 = 10, 18 = 11.  256 lengths of nought (138 + 118), a one for end of block, a
# nought for the distance, then the end of block itself: 93 bits.
_ODD = (_bits((0, 1), (2, 2), (0, 5), (0, 5), (14, 4))
        + _bits(*[(length, 3) for length in (0, 0, 2, 1, *[0] * 13, 2)])
        + [1, 1] + _bits((138 - 11, 7)) + [1, 1] + _bits((118 - 11, 7)) + [1, 0] + [0] + [0])


def _lead_in(bit: int) -> tuple[bytes, int]:
    """Whole bytes of empty blocks and the low ``bit`` bits of the byte in which they end."""
    bits = list(_ODD) if bit % 2 else []
    while len(bits) % 8 != bit:
        bits += _EVEN
    packed = bytes(sum(b << i for i, b in enumerate(bits[j:j + 8])) for j in range(0, len(bits), 8))
    return (packed[:-1], packed[-1]) if bit else (packed, 0)


LEAD_IN = [_lead_in(bit) for bit in range(8)]


def _restarted(bit: int, window: bytes, first: bytes) -> tuple[zlib._Decompress, bytes]:
    """A decompressor at a restart point, and its output for the bytes from there (one at least)."""
    if bit == MEMBER:
        d = zlib.decompressobj(GZIP)
        return d, d.decompress(first)
    d = zlib.decompressobj(RAW, zdict=window) if window else zlib.decompressobj(RAW)
    whole, low = LEAD_IN[bit]
    high = first[0] & (0xFF << bit) & 0xFF
    return d, d.decompress(whole + bytes([high | low]) + first[1:])


def _begins(near: bytes, window: bytes, truth: bytes) -> tuple[int, int] | None:
    """The (byte, bit) in ``near`` at which a block with code tables begins; ``truth`` is the
    output after ``window`` that the whole of ``near`` gives."""
    for place in range(8 * AROUND):
        byte, bit = divmod(place, 8)
        head = int.from_bytes(near[byte:byte + 2], "little") >> bit
        if head & 0b110 != 0b100:                       # the type of a block with code tables
            continue
        try:
            _, got = _restarted(bit, window, near[byte:])
        except zlib.error:
            continue
        if got == truth:
            return byte, bit
    return None


class _Output:
    """What the stream has given: its last bytes, its length, the CRC of the open range."""

    def __init__(self, sink):
        self.length, self.tail, self.crc, self.sink = 0, bytearray(), 0, sink

    def add(self, data: bytes) -> None:
        if data:
            self.length += len(data)
            self.crc = zlib.crc32(data, self.crc)
            self.tail += data[-WINDOW:]
            if len(self.tail) > 4 * WINDOW:
                del self.tail[:-WINDOW]
            if self.sink:
                self.sink(data)

    def window(self) -> bytes:
        return bytes(self.tail[-WINDOW:])


def ranges(stream, every: int, sink=None) -> Iterator[Range]:
    """Ranges of about ``every`` bytes of output that cover a gzip stream (``stream.read(n)``).

    ``sink`` is called with the output as it comes.  Memory is a few ``FEED``, whatever the
    file's size.  Damaged input raises ``zlib.error``, a truncated member ``EOFError``."""
    out = _Output(sink)
    begin = (0, MEMBER, b"", 0)                         # of the range that is being filled

    def cut(byte: int, bit: int, window: bytes) -> Range:
        nonlocal begin
        done = Range(*begin, out.length, out.crc)
        begin, out.crc = (byte, bit, window, out.length), 0
        return done

    d, held, at, ended = None, b"", 0, False            # ``held`` is compressed input from ``at`` on
    goal, tried = every, 0                              # where to look next, and bytes looked at
    while True:
        if len(held) < 2 * FEED and not ended:
            more = stream.read(FEED)
            held, ended = held + more, not more
            continue
        if d is None:
            rest = held.lstrip(b"\0") if at else held   # zeros may follow a member
            at, held = at + len(held) - len(rest), rest
            if not held and ended:
                break
            if not held:
                continue
            if out.length >= goal:
                yield cut(at, MEMBER, b"")
                goal, tried = out.length + every, 0
            d = zlib.decompressobj(GZIP)
        if not held:
            raise EOFError("gzip file ends inside a member")
        if out.length < goal:
            out.add(d.decompress(held, goal - out.length))
            left = d.unused_data if d.eof else d.unconsumed_tail
        else:
            used, quiet = 0, 0
            limit = len(held) if ended else len(held) - FEED
            while used < limit and quiet < QUIET and not d.eof:
                data = d.decompress(held[used:used + 1])
                used, quiet = used + 1, 0 if data else quiet + 1
                out.add(data)
            tried += used
            if quiet == QUIET and used > quiet and not d.eof:
                ahead = held[used:used + AHEAD]
                truth, first = d.copy().decompress(ahead), used - quiet - 1
                window = out.window()
                found = _begins(held[first:used] + ahead, window, truth) if len(truth) >= AGREE else None
                if found:
                    yield cut(at + first + found[0], found[1], window)
                    goal, tried = out.length + every, 0
            if tried >= SEARCH:
                goal, tried = out.length + every, 0
            left = d.unused_data if d.eof else held[used:]
            if d.eof:
                left += held[used:]
        at, held = at + len(held) - len(left), left
        if d.eof:
            d = None
    yield cut(at, MEMBER, b"")


def read_range(stream, r: Range, size: int = 1 << 20) -> Iterator[bytes]:
    """Output from ``r.start`` on, as far as it is asked for, in parts of ``size`` at most;
    ``stream`` stands at ``r.byte``.  ``ValueError`` if the range's own bytes lack its CRC."""
    bit, at, crc = r.bit, r.start, 0
    d, held = None, stream.read(FEED)
    while held:
        if d is None and bit == MEMBER:
            held = held.lstrip(b"\0")
            if not held:
                held = stream.read(FEED)
                continue
        if d is None:
            d, data = _restarted(bit, r.window, held)
        else:
            data = d.decompress(held)
        for j in range(0, len(data), size):
            part = data[j:j + size]
            if at < r.end:
                crc = zlib.crc32(part[:r.end - at], crc)
                if at + len(part) >= r.end and crc != r.crc:
                    raise ValueError("a gzip range does not give the output that was indexed")
            at += len(part)
            yield part
        held = d.unused_data if d.eof else b""
        if d.eof:
            while bit != MEMBER and len(held) < TRAILER:
                more = stream.read(FEED)
                if not more:
                    break
                held += more
            held = held[0 if bit == MEMBER else TRAILER:]
            d, bit = None, MEMBER
        held = held or stream.read(FEED)
