import gzip
import io
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescore.sources import gzip_ranges
from framescore.sources.gzip_ranges import LEAD_IN, read_range, ranges
from framescore.sources.idx import idx_images, idx_index, idx_labels

RNG = np.random.default_rng(3)
SPARSE = np.where(RNG.random(2_500_000) < 0.8, 0, RNG.integers(0, 255, 2_500_000)).astype(np.uint8).tobytes()


def _fixed(data):
    c = zlib.compressobj(9, zlib.DEFLATED, 31, 9, zlib.Z_FIXED)
    return c.compress(data) + c.flush()


# name -> gzip bytes, and the least number of ranges of 200,000 bytes to be found
FILES = {
    "level9": (gzip.compress(SPARSE, 9), 9),
    "level1": (gzip.compress(SPARSE, 1), 9),
    "noise": (gzip.compress(np.clip(RNG.normal(128, 20, 2_000_000), 0, 255).astype(np.uint8).tobytes()), 8),
    "stored among others": (gzip.compress(SPARSE[:900_000] + RNG.bytes(300_000) + SPARSE[900_000:]), 9),
    "stored": (gzip.compress(RNG.bytes(600_000)), 1),
    "fixed codes": (_fixed(SPARSE[:600_000]), 1),
    "members": (gzip.compress(SPARSE[:900_000]) + bytes(700) + gzip.compress(SPARSE[900_000:1_000_000])
                + gzip.compress(b"") + gzip.compress(SPARSE[1_000_000:]), 9),
    "small members": (b"".join(gzip.compress(SPARSE[i:i + 5_000]) for i in range(0, 1_000_000, 5_000)), 4),
    "zeros": (gzip.compress(bytes(3_000_000)), 1),
    "empty": (gzip.compress(b""), 1),
}


@pytest.mark.parametrize("bit", range(8))
def test_lead_in_is_empty_and_ends_at_the_bit(bit):
    whole, low = LEAD_IN[bit]
    d = zlib.decompressobj(-15)
    # an empty last block of fixed codes follows at the bit: 1 10 0000000
    end = (low | 0b011 << bit).to_bytes(3, "little")
    assert d.decompress(whole + end) == b"" and d.eof


@pytest.mark.parametrize("name", FILES)
def test_ranges_cover_and_restart(name):
    packed, least = FILES[name]
    want = gzip.decompress(packed)
    seen = []
    got = list(ranges(io.BytesIO(packed), 200_000, lambda x: seen.append(x)))
    assert b"".join(seen) == want and len(got) >= least
    assert [r.start for r in got] == [0] + [r.end for r in got[:-1]] and got[-1].end == len(want)
    for r in got:
        stream, out = io.BytesIO(packed), b""
        stream.seek(r.byte)
        for part in read_range(stream, r, 30_000):
            out += part
            if len(out) > r.end - r.start + 40_000:         # reading on beyond the range's end
                break
        assert out == want[r.start:r.start + len(out)] and len(out) >= r.end - r.start


def test_every_bit_place_is_met():
    got = ranges(io.BytesIO(FILES["level9"][0]), 40_000)
    assert {r.bit for r in got} >= set(range(8))


def test_damaged_input_is_told():
    packed = FILES["level9"][0]
    with pytest.raises(EOFError):
        list(ranges(io.BytesIO(packed[:-500]), 200_000))
    with pytest.raises(zlib.error):
        list(ranges(io.BytesIO(packed[:-8] + bytes(8)), 200_000))
    r = list(ranges(io.BytesIO(packed), 200_000))[1]
    stream = io.BytesIO(packed)
    stream.seek(r.byte)
    with pytest.raises(ValueError, match="indexed"):
        list(read_range(stream, r._replace(crc=r.crc ^ 1)))


def test_memory_does_not_grow_with_the_file(monkeypatch):
    asked = []

    class Stream(io.BytesIO):
        def read(self, n=-1):
            asked.append(n)
            return super().read(n)

    list(ranges(Stream(FILES["level9"][0]), 200_000))
    assert set(asked) == {gzip_ranges.FEED}


def _pair(folder, count, h, w, name="big"):
    pixels = (SPARSE * 2)[:count * h * w]
    labels = bytes(i % 251 for i in range(count))
    for suffix, data in (("images-idx3-ubyte.gz", struct.pack(">iiii", 2051, count, h, w) + pixels),
                         ("labels-idx1-ubyte.gz", struct.pack(">ii", 2049, count) + labels)):
        with open(os.path.join(folder, f"{name}-{suffix}"), "wb") as fh:
            fh.write(gzip.compress(data))
    return pixels, labels


@pytest.mark.parametrize("h,w", [(28, 28), (3, 5), (300, 301)])
def test_one_file_is_read_by_several_tasks_as_by_one(spark, scratch, h, w):
    count = 2_400_000 // (h * w)
    pixels, labels = _pair(scratch, count, h, w)
    one = idx_images(spark, scratch)
    many = idx_images(spark, scratch, split_bytes=150_000, chunk=1000)
    assert many.schema == one.schema and many.count() == count
    assert many.exceptAll(one).isEmpty() and one.exceptAll(many).isEmpty()
    tasks = many.select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks >= 4
    split = idx_labels(spark, scratch, split_bytes=1024)
    assert [r["label"] for r in split.orderBy("pos").collect()] == list(labels)


def test_records_of_edges(spark, scratch):
    _pair(scratch, 0, 28, 28, "none")
    _pair(scratch, 1, 28, 28, "single")
    _pair(scratch, 5, 0, 28, "flat")
    got = sorted((r["source"], r["pos"]) for r in idx_images(spark, scratch, split_bytes=4096).collect())
    assert got == [*[("flat", i) for i in range(5)], ("single", 0)]
    assert idx_images(spark, scratch, glob="nothing*", split_bytes=4096).count() == 0
    with pytest.raises(ValueError):
        idx_images(spark, scratch, split_bytes=10)


def test_truncated_file_fails(spark, scratch):
    with open(os.path.join(scratch, "cut-images-idx3-ubyte.gz"), "wb") as fh:
        fh.write(gzip.compress(struct.pack(">iiii", 2051, 10, 28, 28) + bytes(784 * 9)))
    with pytest.raises(Exception, match="truncated IDX file"):
        idx_images(spark, scratch, split_bytes=4096).count()


def test_index_is_small_and_read_again(spark, scratch):
    count = 3000
    _pair(scratch, count, 28, 28)
    index = idx_index(spark, scratch, "images", "*images-idx3-ubyte.gz", 500_000)
    rows = index.orderBy("start").collect()
    assert len(rows) >= 4 and rows[-1]["end"] == 16 + count * 784
    assert all(len(r["window"]) <= 1 << 15 for r in rows)
