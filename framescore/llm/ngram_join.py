"""Operator 6: exact n-gram Jaccard join with a token-group matrix, and its components.

A document's tokens are its distinct five-word shingles.  Equal sets are one *class*.

1. *Order.*  A fixed-size table of counts (all documents, ``SLOTS`` slots) gives each
   token a frequency level; tokens are ordered by (level, hash), rare ones first.  Any
   order is exact, so slots that share tokens cost time only.
2. *Lists.*  Of every class only a prefix in that order is posted: two classes that link
   share at least ``k`` tokens of their prefixes (k = 4, or all that must be shared if
   fewer).  Postings travel as packed arrays by token bucket; a bucket keeps the classes of
   each token that several hold.  Very long lists are dealt into salted parts.
   A class whose tokens from its first listed one on are too few for any overlap that links
   leaves the lists at once, so heavily edited copies of a large group form no pairs.
3. *Groups.*  Similar classes are partitioned into groups: in each round a class is
   compared with one partner, the leading class of the lists they share most of, and linked
   classes become one group.
   Groups and classes that are joined by the leading class they share most with are one *family*
   of similar documents.
4. *Matrix.*  The token-group matrix holds which families hold which posted token (the union
   over the members).  The tokens of a class's prefix in another family's union bound its overlap
   with every member; only families that reach k are opened.  An opened family's classes, and its own
   outside the largest group, are compared in blocks, as products of 0/1 token matrices of whole
   sets; only links leave a block, so pairs are never rows.
5. Links between groups and the groups themselves give the connected components.

Comparisons are exact on the whole sets: 100 * intersection >= 75 * union.  Tokens are
64-bit hashes (48 bits in comparisons of two sets); class ids are 64-bit.

Skew: a token's list meets the matrix in salted parts; copies are one class before anything is compared, and are posted once per task; a group
that holds a third of all rows costs one comparison per class and round, dealt over salted
tasks.  The driver sees counts, the level table (``SLOTS`` bytes) and a bitmap of fixed size.

Defined cases: null or empty texts and texts without words have no shingles and link with
nothing; fewer than five words are one shingle; rows that repeat an id are documents of their
own; rows with a null id are counted but join nothing and have a null component; an empty table gives an empty result.  Only the two named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescore.llm import arrays
from framescore.llm.components import components
from framescore.llm.tables import dropped, shuffle_width, stored

WORDS = 5
PERCENT = 75
SHARED = 4
SLOT_BITS = 21
SLOT_CHUNKS = 64
BITMAP_BITS = 24
POSTINGS_PER_BUCKET = 1 << 20
LIST_LIMIT = 1 << 18
ROUNDS = 1
#: Classes of a family in a block; a family is compared block by block.
BLOCK_CLASSES = 1024
BLOCK_TOKENS = 4096
BLOCK_BYTES = 2 << 20
#: Texts of a block whose words and shingles are held at a time (bounds a worker's memory, not the result).
STRETCH_BYTES = 1 << 18
#: Rows of a batch that are looked at together where only some of them are wanted.
SLICE_ROWS = 1024
#: From so many tokens on the unary form of a set is the shorter one.
UNARY_TOKENS = 48
#: Wanted sets (id, partner, salt: some 40 bytes a row) up to which their table is broadcast.
BROADCAST_ROWS = 200_000
#: Parts of a token's list that meet the matrix apart.
SALTS = 16
_ASKS, _ASKED = 1, 2


def needed(n):
    """Least overlap with which a set of n tokens can link to anything."""
    return (PERCENT * n + 99) // 100


def prefix_length(n):
    return n - needed(n) + np.minimum(SHARED, needed(n))


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle of every row, first shingle of each row plus the total)."""
    starts, ends, first = arrays.words_of(data, off)
    words = arrays.hash_slices(data, starts, ends, fold=True)
    n = np.diff(first)
    counts = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    cut = np.concatenate([[0], np.cumsum(counts)])
    begin = np.repeat(first[:-1] - cut[:-1], counts) + np.arange(cut[-1])
    size = np.repeat(np.minimum(n, WORDS), counts)
    total = size.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    for k in range(WORDS):
        weight = np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) & 0xFFFFFFFFFFFFFFFF | 1)
        part = arrays.mix(padded[begin + k] * weight + np.uint64(k + 1))
        total += np.where(size > k, part, np.uint64(0))
    return arrays.mix(total), cut


def sets_of(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct tokens of each row of a block."""
    for lo, hi in arrays.runs(off, STRETCH_BYTES):
        hashes, cut = shingles(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        for k in range(len(cut) - 1):
            own = np.sort(hashes[cut[k]:cut[k + 1]])
            yield own[np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))] if len(own) else own


def identity(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set of tokens."""
    one = int(arrays.mix(tokens).sum(dtype=np.uint64))
    two = int(arrays.mix(tokens ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64))
    return tuple((x ^ (x >> 31)) - (1 << 64) if x >= 1 << 63 else x for x in (one, two))


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


_STATS = "kind int, doc_id bigint, n bigint, h1 bigint, h2 bigint, part int, counts binary"


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and at the end the task's counts of distinct sets per slot."""
    counts = np.zeros(1 << SLOT_BITS, np.uint32)
    seen: set[tuple[int, int]] = set()
    names = ["kind", "doc_id", "n", "h1", "h2", "part", "counts"]
    for rows, data, off in arrays.blocks(batches, "text", BLOCK_BYTES):
        n, ones, twos, fresh = [], [], [], []
        for tokens in sets_of(data, off):
            who = identity(tokens)
            n.append(len(tokens))
            ones.append(who[0])
            twos.append(who[1])
            if who not in seen:
                seen.add(who)
                fresh.append(tokens)
        if fresh:
            np.add.at(counts, _slots(np.concatenate(fresh)), np.uint32(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(n), np.int32)), rows.column("doc_id"), pa.array(n, pa.int64()),
             pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.nulls(len(n), pa.int32()),
             pa.nulls(len(n), pa.binary())], names=names)
    if seen:
        parts = [zlib.compress(c.astype("<u4").tobytes(), 1) for c in np.split(counts, SLOT_CHUNKS)]
        empty = [pa.nulls(SLOT_CHUNKS, pa.int64())] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(SLOT_CHUNKS, np.int32)), *empty,
             pa.array(np.arange(SLOT_CHUNKS, dtype=np.int32)), pa.array(parts, pa.binary())], names=names)


def _level_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the tasks' counts, chunk by chunk, as levels (four per doubling)."""
    def out(part, total):
        level = np.minimum(255, np.floor(4 * np.log2(1.0 + total))).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())],
                                          names=["part", "levels"])
    part, total = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part:
                if part is not None:
                    yield out(part, total)
                part, total = row["part"], np.zeros((1 << SLOT_BITS) // SLOT_CHUNKS, np.float64)
            total += np.frombuffer(zlib.decompress(row["counts"]), "<u4")
    if part is not None:
        yield out(part, total)


def level_table(stats: DataFrame) -> np.ndarray:
    """Frequency level of every slot: 1 << SLOT_BITS bytes whatever the corpus's size."""
    rows = (stats.filter("kind = 1").select("part", "counts").repartition(SLOT_CHUNKS, "part")
            .sortWithinPartitions("part").mapInArrow(_level_chunk, "part int, levels binary").collect())
    table = np.zeros((SLOT_CHUNKS, (1 << SLOT_BITS) // SLOT_CHUNKS), np.uint8)
    for r in rows:
        table[r["part"]] = np.frombuffer(bytes(r["levels"]), np.uint8)
    return table.ravel()


_POSTED = "bucket int, salt int, tokens binary, classes binary, sizes binary, places binary"


def _post(levels, buckets: int, list_limit: int):
    """Prefixes of the distinct sets of a block, packed by token bucket (and salt)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        seen: set[tuple[int, int]] = set()
        # expected length of a slot's lists; longer ones are dealt into parts
        parts = np.ceil((2.0 ** (np.arange(256) / 4)) / list_limit).astype(np.int64)
        for _, data, off in arrays.blocks(batches, "text", BLOCK_BYTES):
            tokens, classes, sizes, places = [], [], [], []
            for own in sets_of(data, off):
                who = identity(own)
                if not len(own) or who in seen:
                    continue
                seen.add(who)
                order = np.lexsort((own, table[_slots(own)]))[:prefix_length(len(own))]
                tokens.append(own[order])
                places.append(np.arange(len(order)))                 # tokens before this one
                classes.append(who[0])
                sizes.append(len(own))
            if not tokens:
                continue
            width = np.fromiter(map(len, tokens), np.int64, len(tokens))
            t = np.concatenate(tokens)
            c = np.repeat(np.array(classes, np.int64), width)
            n = np.repeat(np.array(sizes, np.int64), width)
            place = np.concatenate(places)
            salts = parts[table[_slots(t)]]
            salt = np.where(salts > 1, 1 + arrays.mix(c.view(np.uint64)) % np.maximum(salts, 1).astype(np.uint64),
                            0).astype(np.int64)
            bucket = (t % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((salt, bucket))
            t, c, n, place, salt, bucket = (a[order] for a in (t, c, n, place, salt, bucket))
            edge = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1])]))
            cut = np.append(edge, len(t))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[edge].astype(np.int32)), pa.array(salt[edge].astype(np.int32)),
                 *[arrays.binary_array(a, cut).cast(pa.binary()) for a in (t, c, _narrow(n), _narrow(place))]],
                names=["bucket", "salt", "tokens", "classes", "sizes", "places"])
    return run


def _narrow(values: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes that hold them all: 1, 2 or 4 each."""
    most = int(values.max(initial=0))
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


def _widened(raw: bytes, count: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // count}").astype(np.int32)


_LISTS = "token bigint, weight int, x bigint, n int, reach int"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes that hold the same token, from one bucket's postings: a row per member.

    Tokens of a bucket with the same members are one list of that weight; a member's reach
    is then the largest of its reaches."""
    def out(salt: int, held: list) -> pa.RecordBatch | None:
        t, c = (np.concatenate([np.frombuffer(x[k], d) for x in held]) for k, d in (("tokens", "<u8"), ("classes", "<i8")))
        n, place = (np.concatenate([_widened(x[k], len(x["tokens"]) // 8) for x in held]) for k in ("sizes", "places"))
        held.clear()
        r = n - place                                                  # tokens from this one on
        order = np.lexsort((c, t))
        t, c, n, r = (a[order] for a in (t, c, n, r))
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])
        t, c, n, r = (a[new] for a in (t, c, n, r))
        edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(np.append(edge, len(t)))
        full = np.flatnonzero(size >= (1 if salt else 2))
        if not len(full):
            return None
        at, size = edge[full], size[full]
        if salt:
            key = t[at].view(np.int64)
        else:
            total = np.add.reduceat(arrays.mix(c.view(np.uint64)), edge)[full]
            key = arrays.mix(total + size.astype(np.uint64)).view(np.int64)
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        k, c, n, r = np.repeat(key, size), *(arrays.gather(a, at, size) for a in (c, n, r))
        weight = np.repeat(counts[inverse], size)
        order = np.lexsort((c, k))
        k, c, n, r, weight = (a[order] for a in (k, c, n, r, weight))
        edge = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]))
        return pa.RecordBatch.from_arrays(
            [pa.array(k[edge]), pa.array(weight[edge].astype(np.int32)), pa.array(c[edge]),
             pa.array(n[edge].astype(np.int32)),
             pa.array(np.maximum.reduceat(r, edge).astype(np.int32))],
            names=["token", "weight", "x", "n", "reach"])

    key, held = None, []
    for batch in batches:
        packed = {k: batch.column(k) for k in ("tokens", "classes", "sizes", "places")}
        for k, now in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("salt").to_pylist(), strict=True)):
            if now != key:
                if held and (made := out(key[1], held)) is not None:
                    yield made
                    arrays.release()
                key, held = now, []
            held.append({name: column[k].as_buffer() for name, column in packed.items()})    # views, not copies
    if held and (made := out(key[1], held)) is not None:
        yield made


def _linkable(posts: DataFrame) -> DataFrame:
    """Posts of the classes that can link at all, with ``r``, the bound of their overlaps.

    The first token that two linking classes share stands in both prefixes, so an overlap
    is at most what a class holds from its first listed token on, its reach; and it must be
    3/7 of both sizes together.  Classes with too many tokens of their own go, as askers and
    as partners, before any pair is formed.  Lists that lose their members can shorten other
    classes' reach, hence a second pass."""
    for _ in range(2):
        alive = posts.groupBy("token").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1")
        near = posts.join(alive.select("token", "least"), "token")
        bound = near.groupBy("x").agg(F.max("reach").alias("r"), F.min("least").alias("least"),
                                      F.first("n").alias("size"))
        fit = bound.filter(f"{100 + PERCENT} * r >= {PERCENT} * (size + least)").select("x", "r")
        posts = stored(near.select("token", "weight", "x", "n", "reach").join(fit, "x"), "ngram-lists")
    return posts


def _tokens_of(bitmap):
    """Whole sets of the rows whose id is in the bitmap, 48 bits a token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            slot = (arrays.mix(ids.view(np.uint64)) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
            mine = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7)) & 1 == 1))
            for rows, data, off in arrays.blocks(iter([mine]), "text", BLOCK_BYTES):
                who, packed = [], []
                for own in sets_of(data, off):
                    who.append(identity(own)[0])
                    packed.append(_pack48(own))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(who, pa.int64()),
                                                  pa.array(packed, pa.binary())],
                                                 names=["doc_id", "x", "tokens"])
    return run


def _pack48(tokens: np.ndarray) -> bytes:
    """A set's 48-bit tokens in order.  Long sets keep the upper 8 bits in unary, some 5.2 bytes a token;
    the first byte tells which form it is."""
    own = np.sort(tokens >> np.uint64(16)).astype("<u8")
    low = own.view(np.uint8).reshape(-1, 8)
    if len(own) < UNARY_TOKENS:
        return b"\0" + low[:, :6].tobytes()
    steps = np.zeros(len(own) + 256, np.uint8)
    steps[low[:, 5].astype(np.int64) + np.arange(len(own))] = 1
    return b"\1" + low[:, :5].tobytes() + np.packbits(steps).tobytes()


def _unpack48(raw: bytes) -> np.ndarray:
    body = np.frombuffer(raw, np.uint8, offset=1)
    n = 8 * (len(body) - 32) // 41 if raw[0] else len(body) // 6        # 41 bits a token and 256 more
    wide = np.zeros((n, 8), np.uint8)
    if raw[0]:
        wide[:, :5] = body[:5 * n].reshape(-1, 5)
        wide[:, 5] = np.flatnonzero(np.unpackbits(body[5 * n:])) - np.arange(n)
    else:
        wide[:, :6] = body.reshape(-1, 6)
    return wide.view("<u8").ravel()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (y, salt) with y's own set first; yields the pairs that link."""
    y, held = None, None
    for batch in batches:
        a, b = [], []
        for row in batch.to_pylist():
            own = _unpack48(row["tokens"])
            if row["x"] is None:
                y, held = (row["y"], row["salt"]), own
            elif (row["y"], row["salt"]) == y:
                short, long = (own, held) if len(own) <= len(held) else (held, own)
                at = np.minimum(np.searchsorted(long, short), len(long) - 1)
                both = int((long[at] == short).sum())
                if 100 * both >= PERCENT * (len(own) + len(held) - both):
                    a.append(row["x"])
                    b.append(row["y"])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, tokens: DataFrame, per_task: int = 4096) -> DataFrame:
    """Those of the pairs (x, rep_x, y, rep_y) that link, as edges (a, b).  A class with very
    many partners is dealt over tasks of about ``per_task`` partners.

    The wanted sets, for either role, are one small table, so the sets are read and sent once."""
    width = shuffle_width(pairs.sparkSession)
    tasks = pairs.groupBy("y", "rep_y").agg((F.floor(F.count("*") / per_task) + 1).alias("tasks"))
    salt = F.pmod(F.xxhash64("x"), F.col("tasks")).alias("salt")
    asked = pairs.join(tasks.select("y", "tasks"), "y").select(
        F.col("x").alias("id"), F.col("rep_x").alias("rep"), "y", salt, "x")
    held = tasks.select(F.col("y").alias("id"), F.col("rep_y").alias("rep"), "y", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("x"))
    wanted = stored(asked.unionByName(held), "ngram-wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    met = (tokens.join(wanted, ["id", "rep"]).select("y", "salt", "x", "tokens")
           .repartition(width, "y", "salt").sortWithinPartitions("y", "salt", F.col("x").asc_nulls_first()))
    return met.mapInArrow(_compare, "a bigint, b bigint").distinct()


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """(texts, stored statistics rows, classes (n, h1, h2, rep: least id))."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                        F.col(text_col).cast("string").alias("text"))
    stats = stored(texts.mapInArrow(_stats, _STATS), "ngram-stats")
    rows = stats.filter("kind = 0").select("doc_id", "n", "h1", "h2")
    classes = (rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "h1", "h2")
               .agg(F.min("doc_id").alias("rep")))
    return texts, stats, rows, classes


def _bitmap(reps: DataFrame) -> np.ndarray:
    """Bits of the ids' hashes: fixed size, built by a grouped bit_or."""
    words = (reps.mapInArrow(_bitmap_slots, "slot bigint").groupBy(F.expr("shiftright(slot, 5)").alias("w"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 31 AS int)))").alias("bits")).collect())
    bits = np.zeros(1 << (BITMAP_BITS - 5), "<u4")
    for r in words:
        bits[r["w"]] = r["bits"]
    return bits.view(np.uint8)


def _bitmap_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        slot = (arrays.mix(ids.view(np.uint64)) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(slot)], names=["slot"])


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_limit: int = LIST_LIMIT,
          rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows doc_id, n, h1, h2; classes n, h1, h2, rep; groups node, comp of class ids h1).

    The groups are exactly the classes that links connect; a class in none stands alone."""
    spark = docs.sparkSession
    texts, stats, rows, classes = classes_of(docs, id_col, text_col)
    classes = stored(classes, "ngram-classes")
    posted = classes.agg(F.sum(F.floor(F.col("n") / 4) + SHARED + 1)).first()[0] or 0
    width = shuffle_width(spark)
    buckets = max(width, -(-int(posted) // POSTINGS_PER_BUCKET))
    levels = spark.sparkContext.broadcast(level_table(stats))          # 1 << SLOT_BITS bytes
    packed = (texts.filter("doc_id IS NOT NULL").mapInArrow(_post(levels, buckets, list_limit), _POSTED)
              .repartition(buckets, "bucket", "salt").sortWithinPartitions("bucket", "salt"))
    # the same members in several buckets are one list, too
    listed = packed.mapInArrow(_lists, _LISTS).groupBy("token", "x").agg(
        F.sum("weight").cast("int").alias("weight"), F.max("n").alias("n"), F.max("reach").alias("reach"))
    posts = _linkable(stored(listed, "ngram-lists")).select("token", "weight", "x", "n", "r")
    # whole sets of the classes that stand in a list
    reps = classes.join(posts.select(F.col("x").alias("h1")).distinct(), "h1").select("rep", "h1")
    reps = stored(reps, "ngram-reps")
    bits = spark.sparkContext.broadcast(_bitmap(reps.select("rep")))   # 1 << BITMAP_BITS bits
    sets = texts.mapInArrow(_tokens_of(bits), "doc_id bigint, x bigint, tokens binary")
    # a class's set is asked for by its representative's id, so sets of other copies never join
    tokens = stored(sets.select(F.col("x").alias("id"), F.col("doc_id").alias("rep"), "tokens"), "ngram-sets")
    edges = spark.createDataFrame([], "a bigint, b bigint")
    groups = spark.createDataFrame([], "node bigint, comp bigint")
    chosen = spark.createDataFrame([], "x bigint, f bigint")
    alive = posts
    ratio = (f"100 * least(n, n_y) >= {PERCENT} * greatest(n, n_y) AND "
             f"{100 + PERCENT} * least(r, r_y) >= {PERCENT} * (n + n_y)")
    for turn in range(rounds + 1):
        named = alive.join(groups, alive.x == groups.node, "left").select(
            "token", "weight", "x", "n", "r", F.coalesce("comp", "x").alias("g"))
        # lists within one group are settled
        split = named.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo <> hi")
        named = stored(named.join(split.select("token"), "token", "left_semi"), "ngram-matrix")
        alive = named.select("token", "weight", "x", "n", "r")
        if turn < rounds:
            # one partner a class: the leading class of the lists it shares most of, at first
            # the one with the fewest tokens of its own, which is nearest to all others
            order = F.struct((F.col("r") / F.col("n") if turn == 0 else F.lit(0.0)).alias("common"),
                             F.xxhash64(F.lit(turn), F.col("x")).alias("chance"))
            lead = named.groupBy("token").agg(F.max_by(F.struct("x", "n", "r", "g"), order).alias("lead"))
            meet = named.join(lead, "token").select(
                "x", "n", "r", "g", "weight", F.col("lead.x").alias("y"), F.col("lead.n").alias("n_y"),
                F.col("lead.r").alias("r_y"), F.col("lead.g").alias("g_y")).filter("g <> g_y").filter(ratio)
            counted = meet.groupBy("x", "n", "y").agg(F.sum("weight").alias("shared"))
            fit = counted.filter(F.col("shared") >= F.least(F.lit(SHARED), F.ceil(F.col("n") * PERCENT / 100)))
            pairs = fit.groupBy("x").agg(F.max_by("y", F.struct("shared", "y")).alias("y"))
        else:
            # families: classes and the leading classes they chose
            named = stored(_reaching(named).join(chosen, "x", "left").select(
                "token", "weight", "x", "n", "r", "g", F.coalesce("f", "x").alias("f")), "ngram-families")
            found = stored(_within(named, _asking(named), reps, tokens), "ngram-edges")
            edges = edges.unionByName(found)
            groups = stored(components(edges), "ngram-groups")
            break
        fresh = pairs
        for end in ("x", "y"):
            fresh = fresh.join(reps.select(F.col("h1").alias(end), F.col("rep").alias(f"rep_{end}")), end)
        pairs = stored(fresh, "ngram-pairs")
        if turn == 0 and rounds:
            best = (named.join(lead, "token").select("x", "weight", F.col("lead.x").alias("y")).filter("x <> y")
                    .groupBy("x", "y").agg(F.sum("weight").alias("shared")).groupBy("x")
                    .agg(F.max_by("y", F.struct("shared", "y")).alias("y")))
            near = components(best.select(F.col("x").alias("a"), F.col("y").alias("b")))
            chosen = stored(near.select(F.col("node").alias("x"), F.col("comp").alias("f")), "ngram-chosen")
        edges = edges.unionByName(stored(verified(pairs, tokens), "ngram-edges"))
        groups = stored(components(edges), "ngram-groups")
    for done in (posts, reps, tokens, edges):
        dropped(done)
    return rows, classes, groups


def _salt():
    return F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")


def _every_salt():
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def _with_family(rows: DataFrame, families: DataFrame) -> DataFrame:
    """Rows (x, f) with what ``families`` says of f; a family of very many classes is dealt over salted parts."""
    return rows.withColumn("salt", _salt()).join(families.select("*", _every_salt()), ["f", "salt"]).drop("salt")


def _least_shared(n: str = "n"):
    """The least number of listed tokens that a class shares with any that links to it, larger or smaller."""
    return F.least(F.lit(SHARED), F.ceil(F.ceil(F.col(n) * PERCENT / 100) * PERCENT / 100))


def _reaching(named: DataFrame) -> DataFrame:
    """The list rows of classes that can still link outside their group: every list that is left holds
    several groups, and two classes that link share ``_least_shared`` of them."""
    for _ in range(2):
        strong = named.groupBy("x").agg(F.sum("weight").alias("s"), F.first("n").alias("n")).filter(
            F.col("s") >= _least_shared()).select("x")
        named = named.join(strong, "x", "left_semi")
        split = named.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo <> hi")
        named = stored(named.join(split.select("token"), "token", "left_semi"), "ngram-matrix")
    return named


def _asking(named: DataFrame) -> DataFrame:
    """The classes that open other families: (x, f, g, the family opened).

    The token-group matrix holds, for every token, the families whose union has it.  The lists that a class
    shares with a family's union bound its overlap with every member; only families that reach the least
    overlap are opened.  Of two families the one of the lesser name asks.  A token's row of the matrix is
    repeated for ``SALTS`` parts of its list, so a token of very many classes is no hot key."""
    cells = named.groupBy("token", "f").agg(F.first("weight").alias("weight"))
    several = cells.groupBy("token").agg(F.count("*").alias("families")).filter("families > 1").select("token")
    cells = stored(cells.join(several, "token"), "ngram-matrix")
    opened = cells.select("token", F.col("f").alias("f_y"), _every_salt())
    shared = named.withColumn("salt", _salt()).join(opened, ["token", "salt"]).filter("f < f_y").groupBy(
        "x", "n", "f", "g", "f_y").agg(F.sum("weight").alias("shared"))
    return shared.filter(F.col("shared") >= _least_shared()).select("x", "f", "g", "f_y")


def _within(named: DataFrame, asking: DataFrame, reps: DataFrame, tokens: DataFrame) -> DataFrame:
    """Links between groups, family by family and block by block on whole sets.

    The classes outside the family's largest group, and those of other families that opened it, meet all
    its classes.  A block holds some ``BLOCK_CLASSES`` of either side, so a family of any size is many small
    tasks, and only links leave them, at most one for each class and group of a block."""
    width = shuffle_width(named.sparkSession)
    members = named.groupBy("x").agg(F.first("f").alias("f"), F.first("g").alias("g"))
    sizes = members.groupBy("f", "g").agg(F.count("*").alias("size")).groupBy("f").agg(
        F.max_by("g", F.struct("size", "g")).alias("top"), F.sum("size").alias("all"))
    sizes = stored(sizes, "ngram-sizes")
    inner = _with_family(members, sizes).filter("g <> top").select("x", "f", "g")
    asks = stored(inner.unionByName(asking.select("x", F.col("f_y").alias("f"), "g")), "ngram-asks")
    blocks = asks.groupBy("f").agg(F.count("*").alias("rest")).join(sizes, "f").select(
        "f", (F.floor(F.col("all") / BLOCK_CLASSES) + 1).alias("nb"), (F.floor(F.col("rest") / BLOCK_CLASSES) + 1).alias("na"))
    named_reps = reps.select(F.col("h1").alias("x"), "rep")
    hashed = F.xxhash64("x")

    def side(rows: DataFrame, role: int) -> DataFrame:
        mine, other = ("na", "nb") if role == _ASKS else ("nb", "na")
        block = F.pmod(hashed, F.col(mine))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("other")
        out = rows.select("x", "rep", "f", "g", block.alias("mine"), every)
        a, b = ("mine", "other") if role == _ASKS else ("other", "mine")
        return out.select(F.col("x").alias("id"), "rep", "f", F.col(a).alias("a"), F.col(b).alias("b"),
                          F.lit(role).alias("role"), "g")

    sides = side(_with_family(asks, blocks).join(named_reps, "x"), _ASKS).unionByName(
        side(_with_family(members, blocks).join(named_reps, "x"), _ASKED))
    # a class that asks and is asked in one block is sent there once
    wanted = stored(sides.groupBy("id", "rep", "f", "a", "b").agg(
        F.bit_or("role").alias("role"), F.first("g").alias("g")), "ngram-blocks")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    met = (tokens.join(wanted, ["id", "rep"]).select("f", "a", "b", "role", "g", "id", "tokens")
           .repartition(width, "f", "a", "b").sortWithinPartitions("f", "a", "b", "id"))
    return met.mapInArrow(_compare_blocks, "a bigint, b bigint").distinct()


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of 0/1 matrices."""
    lt, rt = np.concatenate(left), np.concatenate(right)
    lo = np.repeat(np.arange(len(left)), [len(x) for x in left])
    ro = np.repeat(np.arange(len(right)), [len(x) for x in right])
    common = np.intersect1d(lt, rt)
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(common), BLOCK_TOKENS):
        part = common[at:at + BLOCK_TOKENS]
        both = []
        for t, o, n in ((lt, lo, len(left)), (rt, ro, len(right))):
            column = np.minimum(np.searchsorted(part, t), len(part) - 1)
            inside = part[column] == t
            matrix = np.zeros((n, len(part)), np.float32)
            matrix[o[inside], column[inside]] = 1
            both.append(matrix)
        out += both[0] @ both[1].T
    return out


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: list) -> pa.RecordBatch:
        asks, asked = ([r for r in held if r["role"] & k] for k in (_ASKS, _ASKED))
        a, b = [], []
        if asks and asked:
            left, right = ([_unpack48(r["tokens"]) for r in side] for side in (asks, asked))
            both = _overlaps(left, right).astype(np.int64)
            union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right]) - both
            group = np.array([r["g"] for r in asked])
            far = np.array([r["g"] for r in asks])[:, None] != group
            x, y = np.nonzero((100 * both >= PERCENT * union) & far)
            _, first = np.unique(np.stack([x, group[y]]), axis=1, return_index=True)
            a, b = [asks[k]["id"] for k in x[first]], [asked[k]["id"] for k in y[first]]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["f"], row["a"], row["b"]) != key:
                if held:
                    yield out(held)
                key, held = (row["f"], row["a"], row["b"]), []
            held.append(row)
    if held:
        yield out(held)


def _owned(docs: DataFrame, id_col: str, text_col: str, list_limit: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(rows doc_id, n, h1, h2; classes n, h1, h2, rep with ``comp``, the group that each is in)."""
    rows, classes, groups = links(docs, id_col, text_col, list_limit, rounds)
    return rows, classes.join(groups, classes.h1 == groups.node, "left").select(
        "n", "h1", "h2", "rep", F.coalesce("comp", "h1").alias("comp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    list_limit: int = LIST_LIMIT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of ``docs``."""
    rows, owned = _owned(docs, id_col, text_col, list_limit, rounds)
    least = owned.groupBy("comp").agg(F.min("rep").alias("component"))
    owner = owned.join(least, "comp").select("n", "h1", "h2", "component")
    joined = rows.join(owner, ["n", "h1", "h2"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(
        F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _with_class(text_col: str):
    """Adds the class key of each row's text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in arrays.blocks(batches, text_col, BLOCK_BYTES):
            keys = [(len(tokens), *identity(tokens)) for tokens in sets_of(data, off)]
            own = [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *own], names=[*rows.schema.names, "_n", "_h1", "_h2"])
    return run


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: one row of each, of the least
    id, and of that id's texts the one of the least class key.  Rows without shingles link with nothing:
    of those that repeat id and text one stays; rows with a null id all stay."""
    rows, owned = _owned(docs, id_col, text_col, LIST_LIMIT, ROUNDS)
    least = owned.groupBy("comp").agg(F.min(F.struct("rep", "n", "h1", "h2")).alias("least")).select("least.*")
    alone = rows.filter("n = 0 AND doc_id IS NOT NULL").select("doc_id", "n", "h1", "h2").distinct()
    key = ["_id", "_n", "_h1", "_h2"]
    chosen = stored(least.union(alone).toDF(*key).select("_id", *[F.col(c).cast("bigint").alias(c) for c in key[1:]]),
                    "ngram-chosen")
    named = docs.withColumn("_id", F.col(id_col).cast("bigint")).join(
        chosen.select("_id").distinct(), "_id", "left_semi")
    kept = (named.mapInArrow(_with_class(text_col), T.StructType(
                [*named.schema.fields, *[T.StructField(c, T.LongType()) for c in key[1:]]]))
            .join(chosen, key, "left_semi").withColumn("_text", F.when(F.col("_n") == 0, F.col(text_col)))
            .dropDuplicates([*key, "_text"]).select(docs.columns))
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
