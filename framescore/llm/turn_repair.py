"""Operator 13: repair of the turn structure of conversations by target alignment.

The roles of a sound conversation alternate: nothing, or an optional system turn and then user
and assistant in turn, ``(s?(ua)+)?`` in their initials.  A conversation's turns are aligned to
the target strings of every feasible length with the edits keep, rerole, delete and insert (Wagner
and Fischer's table).  All targets are suffixes of one alternating string, so one table by (turns
left, target characters left) holds the costs of all lengths.  A greedy repair gives the incumbent
cost; no cheapest path leaves the diagonals that its inserts and deletes can pay for (Ukkonen's
bands).  Of the lengths with the least cost each is backtraced, and the least audit wins.

The work is one shuffle: turns are ranged by conversation and turn, so that a conversation of any
size spreads over tasks, and a task streams its range.  A conversation that lies inside one range
and one segment (``SEGMENT_ROWS`` turns, ``SEGMENT_BYTES`` of text) is finished there.  The others,
those at range edges and very long ones, go on as segments: turns seen in an earlier segment are
found by a shuffle of digests; every segment is aligned for each state of the grammar in which it
can begin and end; a conversation's segments are chained in order by (cost, audit); the audit's
pieces go back to their segments, and the repaired text is hashed as a stream.  No task holds more
than a segment's texts; a chained conversation's audits, which are its result, are held in one.

Order of equal turns: role, then text.  A gap's deletes come before its inserts, as the least audit
demands, so no segment ends with an insert and audits of one segment are never each other's prefix.

Defined cases: a null role, text, conversation or turn counts as one space where it is part of a
text or key; the null conversation is a conversation, its id stays null; an empty role has no
initial and can only be reroled or deleted; repeated rows are turns (and so duplicates); a
conversation whose turns are all dropped is empty; an empty table gives an empty result.  Only the
four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescore.llm.tables import shuffle_width, stored

SEGMENT_ROWS = 1024
SEGMENT_BYTES = 4 << 20
# The costs of the edits.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
_SPACES = " \t\n\x0b\x0c\r"
_NO_INITIAL = "\x00"
_INF = 1 << 40

# States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
_CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id string, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired_sha256 string"
_SEGMENT = ("conv_id string, part int, seg bigint, roles array<string>, texts array<string>, marks string, "
            "digests array<binary>, first_turn bigint, last_turn bigint, n_turns bigint")
_SEGMENT_NAMES = [c.split()[0] for c in _SEGMENT.split(", ")]
_RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]


# ------------------------------------------------------------------ turns

def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """The turns after the damage that their key decides; a dropped one stays as a row marked ``gone``,
    so that its conversation is not lost."""
    conv, turn = F.col(conv_col).cast("string"), F.col(turn_col).cast("bigint")
    fate = F.crc32(F.concat_ws(":", F.coalesce(conv, F.lit(" ")), F.coalesce(turn.cast("string"), F.lit(" "))).cast("binary")) % 20
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), conv), F.lit("")).alias("conv_id"), turn.alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"), fate.alias("fate"))
    return rows.select(
        "conv_id", "turn", (F.col("fate") == 0).alias("gone"),
        F.when(F.col("fate") == 0, "").when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") <= 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")
                                            ).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    ).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """Ranges of (conversation, turn), each sorted; the key's part of the text only splits equal turns."""
    turn = F.col("turn").asc_nulls_first()
    ranged = rows.repartitionByRange(shuffle_width(rows.sparkSession), "conv_id", turn, "role", F.substring("text", 1, 16))
    return ranged.sortWithinPartitions("conv_id", turn, "role", "text")


def _digest(role: str, text: str) -> bytes:
    h = hashlib.blake2b(role.encode("utf-8", "surrogatepass"), digest_size=16)
    h.update(b"\x00\x00" + text.encode("utf-8", "surrogatepass"))
    return h.digest()


class Segment:
    """Consecutive turns of a conversation: roles, texts, marks (b blank, d duplicate, t truncated)."""

    def __init__(self, conv_id: str, opens: bool):
        self.conv_id, self.opens = conv_id, opens       # opens: its conversation surely starts here
        self.roles, self.texts, self.marks, self.digests = [], [], [], []
        self.size, self.seen = 0, set()
        self.first_turn = self.last_turn = None
        self.n_turns = 0

    def add(self, turn, role: str, text: str) -> None:
        bare, digest = text.rstrip(_SPACES), _digest(role, text)
        mark = "b" if not bare else "d" if digest in self.seen else "." if bare[-1] in ".!?" else "t"
        self.seen.add(digest)
        self.roles.append(role)
        self.texts.append(text)
        self.marks.append(mark)
        self.digests.append(digest)
        self.size += len(text)
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.n_turns += 1

    def row(self, part: int, seg: int) -> tuple:
        return (self.conv_id, part, seg, self.roles, self.texts, "".join(self.marks), self.digests,
                self.first_turn, self.last_turn, self.n_turns)


def initials(roles: list[str]) -> str:
    return "".join(r[:1] or _NO_INITIAL for r in roles)


def _illegal(marks: str) -> int:
    return sum(marks[i:i + 2] not in ("su", "ua", "au") for i in range(len(marks) - 1))


# ------------------------------------------------------------------ alignment

def _greedy(live: str, state: int) -> int:
    """Cost of a repair that keeps or reroles every turn and inserts what is missing before it."""
    cost = 0
    for k, c in enumerate(live):
        want = "a" if state == USER else "u"
        if state == START and k == 0 and c == "s":
            state = SYSTEM
            continue
        if c != want:
            cost += INSERT if c in "ua" else REROLE
        state = (USER if c == "u" else ASSISTANT) if c in "ua" else (USER if want == "u" else ASSISTANT)
    return cost


class Alignment:
    """The table of one run of turns: ``cost[i][y][k]`` is the least cost of the turns from ``i`` on
    against the last e characters of the alternating string that ends in state y (USER or ASSISTANT),
    k = e - (turns left) + ``back``.  Deletes that faults demand and the price of kept truncated turns
    are the same on every path and are left out; a truncated turn is so deleted at the difference."""

    def __init__(self, marks: str, chars: str, entries):
        self.live = [i for i, m in enumerate(marks) if m not in "bd"]
        self.chars = "".join(chars[i] for i in self.live)
        self.drop = [DELETE - TRUNCATED if marks[i] == "t" else DELETE for i in self.live]
        cut = sum(d < DELETE for d in self.drop)
        self.base = DELETE * (len(marks) - len(self.live)) + TRUNCATED * cut
        edges = [-1, *self.live, len(marks)]
        self.forced = [edges[k + 1] - edges[k] - 1 for k in range(len(edges) - 1)]    # before the first, after each
        self.n = n = len(self.live)
        incumbent = max(_greedy(self.chars, x) for x in entries) + INSERT + REROLE     # in either end state
        ahead = incumbent // INSERT
        self.back = min(n, incumbent if incumbent <= cut * (DELETE - TRUNCATED)
                        else cut + (incumbent - cut * (DELETE - TRUNCATED)) // DELETE)
        width = self.width = ahead + self.back + 1
        table = np.full((n + 1, 2, width + 1), _INF, np.int64)        # the last column is beyond the band
        steps = INSERT * np.arange(width, dtype=np.int64)
        table[n, :, self.back] = 0                                     # no insert follows the last turn
        k = np.arange(width)
        for i in range(n - 1, -1, -1):
            e = k - self.back + (n - i)
            after = table[i + 1]
            # the character with e to go: of ASSISTANT's string a where e is odd, of USER's u
            odd = (e & 1) == 1
            u, a = (0 if self.chars[i] == "u" else REROLE), (0 if self.chars[i] == "a" else REROLE)
            match = np.where(np.stack([odd, ~odd]), u, a)
            best = np.minimum(self.drop[i] + after[:, 1:], match + after[:, :-1])
            best[:, e == 0] = (self.drop[i] + after[:, 1:])[:, e == 0]
            best[:, e < 0] = _INF
            table[i, :, :-1] = np.minimum.accumulate(best - steps, axis=1) + steps
            table[i, :, :-1][:, e < 0] = _INF
        np.minimum(table, _INF, out=table)
        self.table = table

    def at(self, i: int, y: int, e: int) -> int:
        k = e - (self.n - i) + self.back
        return int(self.table[i, y - USER, k]) if 0 <= k < self.width and e >= 0 else _INF

    def _char(self, y: int, e: int) -> str:
        return "ua"[(e & 1) ^ (y == USER)]

    def _lengths(self, i: int, y: int, first: str) -> tuple[int, list[int]]:
        """(least cost, the lengths e > 0 that have it) of targets that begin with ``first``."""
        low = max(1, (self.n - i) - self.back)
        low += self._char(y, low) != first
        k = low - (self.n - i) + self.back
        if k >= self.width:
            return _INF, []
        row = self.table[i, y - USER, k:self.width:2]
        least = int(row.min())
        return least, [] if least >= _INF else [low + 2 * int(j) for j in np.flatnonzero(row == least)]

    def _backtrace(self, i: int, y: int, e: int) -> str:
        """The least audit of the turns from ``i`` on, in the order D, I, K, R."""
        out = []
        while i < self.n or e:
            cost = self.at(i, y, e)
            if i < self.n and self.drop[i] + self.at(i + 1, y, e) == cost:
                out.append("D" * (1 + self.forced[i + 1]))
                i += 1
            elif e and INSERT + self.at(i, y, e - 1) == cost:
                out.append("I")
                e -= 1
            else:
                out.append(("K" if self.chars[i] == self._char(y, e) else "R") + "D" * self.forced[i + 1])
                i, e = i + 1, e - 1
        return "".join(out)

    def _deletes(self, lo: int, hi: int) -> str:
        return "".join("D" * (1 + self.forced[i + 1]) for i in range(lo, hi))

    def arcs(self, x: int) -> dict[int, tuple[int, str]]:
        """End state -> (cost, least audit) of the turns when they begin in state ``x``."""
        found: dict[int, list] = {y: [] for y in (START, SYSTEM, USER, ASSISTANT)}
        before = np.concatenate([[0], np.cumsum(self.drop)]).astype(int).tolist()
        lead = "D" * self.forced[0]
        found[x].append((before[-1], lambda: self._deletes(0, self.n)))
        for y in (USER, ASSISTANT):
            cost, lengths = self._lengths(0, y, "a" if x == USER else "u")
            found[y] += [(cost, lambda y=y, e=e: self._backtrace(0, y, e)) for e in lengths]
        if x == START:
            for p in (p for p, c in enumerate(self.chars) if c == "s"):
                keep = "K" + "D" * self.forced[p + 1]
                found[SYSTEM].append((before[-1] - self.drop[p],
                                      lambda p=p, k=keep: self._deletes(0, p) + k + self._deletes(p + 1, self.n)))
                for y in (USER, ASSISTANT):
                    cost, lengths = self._lengths(p + 1, y, "u")
                    found[y] += [(before[p] + cost, lambda p=p, k=keep, y=y, e=e:
                                  self._deletes(0, p) + k + self._backtrace(p + 1, y, e)) for e in lengths]
        out = {}
        for y, ways in found.items():
            if ways:
                least = min(c for c, _ in ways)
                out[y] = (self.base + least, min(lead + trace() for c, trace in ways if c == least))
        return out


def close(ends: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The cheapest end of a conversation, ties to the least audit."""
    return min((c + INSERT * len(_CLOSING[y]), audit + _CLOSING[y]) for y, (c, audit) in ends.items())


def repaired(state: int, audit: str, roles: list[str], texts: list[str]) -> Iterator[str]:
    """``role:text`` of the turns that the audit leaves, from that state on."""
    at = 0
    for edit in audit:
        want = "assistant" if state == USER else "user"
        if edit == "D":
            at += 1
            continue
        if edit == "I":
            yield want + ":"
        else:
            role = roles[at] if edit == "K" else want
            yield f"{role}:{texts[at]}"
            at += 1
            if edit == "K" and role[:1] == "s":
                state = SYSTEM
                continue
        state = USER if want == "user" else ASSISTANT


def _sha256(lines) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


def repair(seg: Segment) -> tuple:
    """The result row of a conversation that is one segment."""
    marks, chars = "".join(seg.marks), initials(seg.roles)
    cost, audit = close(Alignment(marks, chars, (START,)).arcs(START))
    gaps = 0 if seg.first_turn is None else seg.last_turn - seg.first_turn + 1 - seg.n_turns
    return (seg.conv_id, gaps, marks.count("b"), marks.count("d"), marks.count("t"), _illegal(chars), cost, audit,
            _sha256(repaired(START, audit, seg.roles, seg.texts)))


# ------------------------------------------------------------------ tasks

def _types(ddl_names: list[str]) -> list[pa.DataType]:
    kinds = {"part": pa.int32(), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()),
             "digests": pa.list_(pa.binary())}
    text = {"conv_id", "marks", "audit", "repaired_sha256"}
    return [kinds.get(n, pa.string() if n in text else pa.int64()) for n in ddl_names]


def _batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _types(names), strict=True)],
                                      names)


def _stream(segment_rows: int, segment_bytes: int):
    names = _RESULT_NAMES + _SEGMENT_NAMES[1:]
    done_pad, open_pad = (None,) * (len(_SEGMENT_NAMES) - 1), (None,) * (len(_RESULT_NAMES) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out, weight, seg, current = [], 0, 0, None

        def closed(one: Segment, ends: bool) -> int:
            nonlocal seg
            if one.opens and ends:                       # the whole conversation: finished here
                out.append(repair(one) + done_pad)
                return len(out[-1][7]) + 100
            row = one.row(part, seg)
            out.append(row[:1] + open_pad + row[1:])
            seg += 1
            return one.size + 100 * len(one.roles)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "gone", "role", "text")]
            for conv_id, turn, gone, role, text in zip(*columns, strict=True):
                if current is None:
                    current = Segment(conv_id, False)     # it may have begun in an earlier range
                elif conv_id != current.conv_id:
                    weight += closed(current, True)
                    current = Segment(conv_id, True)
                elif len(current.roles) >= segment_rows or current.size >= segment_bytes:
                    weight += closed(current, False)
                    current = Segment(conv_id, False)
                if not gone:
                    current.add(turn, role, text)
                if weight > segment_bytes:
                    yield _batch(names, out)
                    out, weight = [], 0
        if current is not None:
            closed(current, False)                        # it may go on in a later range
        if out:
            yield _batch(names, out)
    return run


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every segment from every state: its arcs and counts."""
    for batch in batches:
        for r in batch.to_pylist():
            earlier, chars = set(r["earlier"] or ()), initials(r["roles"])
            marks = "".join("d" if m != "b" and d in earlier else m
                            for m, d in zip(r["marks"], r["digests"], strict=True))
            states = (START, SYSTEM, USER, ASSISTANT)
            table, rows = Alignment(marks, chars, states), []
            for x in states:
                rows += [(x, y, c, audit) for y, (c, audit) in table.arcs(x).items()]
            one = {**{k: [r[k]] for k in ("conv_id", "part", "seg", "first_turn", "last_turn", "n_turns")},
                   "blank": [marks.count("b")], "duplicate": [marks.count("d")], "truncated": [marks.count("t")],
                   "illegal": [_illegal(chars)], "ends": [chars[:1] + chars[-1:]],
                   "x": [[a[0] for a in rows]], "y": [[a[1] for a in rows]], "c": [[a[2] for a in rows]],
                   "audits": [[a[3] for a in rows]]}
            yield pa.RecordBatch.from_pydict(one, pa.schema(_ARC_SCHEMA))


_ARC_SCHEMA = [("conv_id", pa.string()), ("part", pa.int32()), ("seg", pa.int64()), ("first_turn", pa.int64()),
               ("last_turn", pa.int64()), ("n_turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
               ("truncated", pa.int64()), ("illegal", pa.int64()), ("ends", pa.string()), ("x", pa.list_(pa.int32())),
               ("y", pa.list_(pa.int32())), ("c", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
_ARCS = ("conv_id string, part int, seg bigint, first_turn bigint, last_turn bigint, n_turns bigint, blank bigint, "
         "duplicate bigint, truncated bigint, illegal bigint, ends string, x array<int>, y array<int>, c array<bigint>, "
         "audits array<string>")
_CHAINED = RESULT.replace(", repaired_sha256 string", "") + ", part int, seg bigint, state int, piece string"
_CHAINED_NAMES = [c.split()[0] for c in _CHAINED.split(", ")]


class Chain:
    """A conversation's segments in order: for each state the cheapest way into it, ties to the least
    audit.  Audits of two states differ before either ends, so their order carries over as a rank."""

    def __init__(self, conv_id: str):
        self.conv_id = conv_id
        self.ways = {START: (0, 0, None)}                # state -> (cost, rank, last step)
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first_turn = self.last_turn = self.last_char = None
        self.n_turns = 0

    def add(self, r: dict) -> None:
        for k in self.counts:
            self.counts[k] += r[k]
        if r["ends"]:
            if self.last_char is not None:
                self.counts["illegal"] += _illegal(self.last_char + r["ends"][0])
            self.last_char = r["ends"][-1]
        if r["first_turn"] is not None:
            self.n_turns += r["n_turns"] - (r["first_turn"] == self.last_turn)
            self.first_turn = r["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = r["last_turn"]
        best: dict[int, tuple] = {}
        for x, y, c, audit in zip(r["x"], r["y"], r["c"], r["audits"], strict=True):
            if x in self.ways:
                cost, rank, step = self.ways[x]
                way = (cost + c, rank, audit, (step, r["part"], r["seg"], x, audit))
                if y not in best or way[:3] < best[y][:3]:
                    best[y] = way
        order = sorted(best, key=lambda y: best[y][1:3])
        self.ways = {y: (best[y][0], order.index(y), best[y][3]) for y in best}

    def rows(self) -> Iterator[tuple]:
        """The conversation's row, and one for each segment with its state and piece of the audit."""
        cost, _, closing, step = min((c + INSERT * len(_CLOSING[y]), rank, _CLOSING[y], step)
                                     for y, (c, rank, step) in self.ways.items())
        pieces = []
        while step is not None:
            step, part, seg, state, audit = step
            pieces.append((part, seg, state, audit))
        pieces.reverse()
        if pieces:
            pieces[-1] = (*pieces[-1][:3], pieces[-1][3] + closing)
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.n_turns
        yield (self.conv_id, gaps, *(self.counts[k] for k in ("blank", "duplicate", "truncated", "illegal")), cost,
               "".join(p[3] for p in pieces), None, None, None, None)
        for p in pieces:
            yield (self.conv_id, *(None,) * (len(_CHAINED_NAMES) - 5), *p)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows):
        kinds = {"audit": pa.string(), "piece": pa.string(), "part": pa.int32(), "state": pa.int32(), "conv_id": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64()))
                                           for n, c in zip(_CHAINED_NAMES, zip(*rows, strict=True), strict=True)],
                                          _CHAINED_NAMES)
    current, out = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if current is None or r["conv_id"] != current.conv_id:
                if current is not None:
                    out += current.rows()
                current = Chain(r["conv_id"])
            current.add(r)
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
    if current is not None:
        out += current.rows()
    if out:
        yield batch_of(out)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv_id, h, first = None, None, True

    def batch_of(c, digest):
        return pa.RecordBatch.from_arrays([pa.array([c]), pa.array([digest])], ["conv_id", "repaired_sha256"])
    for batch in batches:
        for r in batch.to_pylist():
            if h is None or r["conv_id"] != conv_id:
                if h is not None:
                    yield batch_of(conv_id, h.hexdigest())
                conv_id, h, first = r["conv_id"], hashlib.sha256(), True
            for line in repaired(r["state"], r["piece"], r["roles"], r["texts"]):
                h.update((line if first else "\n" + line).encode("utf-8", "surrogatepass"))
                first = False
    if h is not None:
        yield batch_of(conv_id, h.hexdigest())


# ------------------------------------------------------------------ the operator

def _chained(segments: DataFrame) -> DataFrame:
    """Result rows of the conversations that came as segments."""
    width, place = shuffle_width(segments.sparkSession), F.struct("part", "seg")
    digests = segments.select("conv_id", "part", "seg", F.explode(F.array_distinct("digests")).alias("digest"))
    first = digests.groupBy("conv_id", "digest").agg(F.min(place).alias("first"))
    earlier = digests.join(first, ["conv_id", "digest"]).where(F.col("first") < place).groupBy("part", "seg").agg(
        F.collect_list("digest").alias("earlier"))                       # at most a segment's turns
    marked = segments.drop("texts").join(earlier, ["part", "seg"], "left")
    arcs = marked.select(*[c for c in _SEGMENT_NAMES if c != "texts"], "earlier").mapInArrow(_align, _ARCS)
    chained = stored(arcs.repartition(width, "conv_id").sortWithinPartitions("conv_id", "part", "seg")
                     .mapInArrow(_chain, _CHAINED), "turn-chains")
    pieces = chained.where("part is not null").select("part", "seg", "state", "piece")
    texts = segments.select("conv_id", "part", "seg", "roles", "texts").join(pieces, ["part", "seg"])
    hashed = (texts.repartition(width, "conv_id").sortWithinPartitions("conv_id", "part", "seg")
              .select("conv_id", "roles", "texts", "state", "piece").mapInArrow(_hash, "conv_id string, repaired_sha256 string"))
    whole = chained.where("part is null").drop("part", "seg", "state", "piece")
    return whole.join(hashed, "conv_id").select(*_RESULT_NAMES)


def repair_turns(turns: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """A row per conversation of ``turns`` (as they are, with a column ``gone``; see ``damaged``):
    faults, the cheapest repair's cost and audit, and the repaired conversation's hash."""
    streamed = stored(in_order(turns).mapInArrow(
        _stream(segment_rows, segment_bytes), RESULT + ", " + _SEGMENT.split(", ", 1)[1]), "turn-segments")
    done = streamed.where("part is null").select(*_RESULT_NAMES)
    return done.unionByName(_chained(streamed.where("part is not null").select(*_SEGMENT_NAMES)))


def contract(conversations: DataFrame) -> DataFrame:
    """The conversations damaged by rule and repaired; ids in their own type."""
    kind = conversations.schema["conv_id"].dataType
    rows = repair_turns(damaged(conversations))
    return rows.withColumn("conv_id", F.when(F.col("conv_id") != "", F.expr("substring(conv_id, 2)")).cast(kind))


#: The contract's rows in DuckDB's SQL: an automaton over the turns that carries, for each state of
#: the grammar, the cheapest (cost, audit, text).
ORACLE = r"""
WITH RECURSIVE
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
f AS (SELECT *, xor(list_reduce(list_transform(range(length(key)), lambda i: ascii(substr(key, (i + 1)::INT, 1))::BIGINT),
               lambda crc, b: list_reduce(range(8), lambda x, j: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)),
               4294967295::BIGINT), 4294967295::BIGINT) % 20 AS fate FROM k),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
        CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM f WHERE fate <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
        rtrim(text, E' \t\n\x0B\x0C\r') AS bare, left(role, 1) AS ini FROM d),
m AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(bare, 1) IN ('.', '!', '?') THEN '.' ELSE 't'
               END AS mark,
        lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM n),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
        count(*) FILTER (mark = 'b') AS blank, count(*) FILTER (mark = 'd') AS duplicate,
        count(*) FILTER (mark = 't') AS truncated,
        count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last FROM m GROUP BY conv_id),
r AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 't': ''} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s1,
         NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s2, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT r.conv_id, m.i,
    {'c': s0.c + 4, 'a': s0.a || 'D', 't': s0.t},
    list_sort(list_filter([{'c': s1.c + 4, 'a': s1.a || 'D', 't': s1.t},
      CASE WHEN mark IN ('.', 't') AND ini = 's' THEN {'c': s0.c + cut, 'a': s0.a || 'K', 't': s0.t || own} END],
      lambda z: z.c IS NOT NULL))[1],
    list_sort(list_filter([{'c': s2.c + 4, 'a': s2.a || 'D', 't': s2.t}] ||
      CASE WHEN mark IN ('.', 't') THEN [
        {'c': s0.c + cut + ku, 'a': s0.a || eu, 't': s0.t || tu}, {'c': s1.c + cut + ku, 'a': s1.a || eu, 't': s1.t || tu},
        {'c': s3.c + cut + ku, 'a': s3.a || eu, 't': s3.t || tu},
        {'c': s2.c + cut + ku + 3, 'a': s2.a || 'I' || eu, 't': s2.t || chr(10) || 'assistant:' || tu}] ELSE [] END,
      lambda z: z.c IS NOT NULL))[1],
    list_sort(list_filter([{'c': s3.c + 4, 'a': s3.a || 'D', 't': s3.t}] ||
      CASE WHEN mark IN ('.', 't') THEN [
        {'c': s2.c + cut + ka, 'a': s2.a || ea, 't': s2.t || ta},
        {'c': s0.c + cut + ka + 3, 'a': s0.a || 'I' || ea, 't': s0.t || chr(10) || 'user:' || ta},
        {'c': s1.c + cut + ka + 3, 'a': s1.a || 'I' || ea, 't': s1.t || chr(10) || 'user:' || ta},
        {'c': s3.c + cut + ka + 3, 'a': s3.a || 'I' || ea, 't': s3.t || chr(10) || 'user:' || ta}] ELSE [] END,
      lambda z: z.c IS NOT NULL))[1]
  FROM r JOIN (SELECT *, CASE mark WHEN 't' THEN 3 ELSE 0 END AS cut, chr(10) || role || ':' || text AS own,
                 CASE ini WHEN 'u' THEN 0 ELSE 3 END AS ku, CASE ini WHEN 'a' THEN 0 ELSE 3 END AS ka,
                 CASE ini WHEN 'u' THEN 'K' ELSE 'R' END AS eu, CASE ini WHEN 'a' THEN 'K' ELSE 'R' END AS ea,
                 chr(10) || (CASE ini WHEN 'u' THEN role ELSE 'user' END) || ':' || text AS tu,
                 chr(10) || (CASE ini WHEN 'a' THEN role ELSE 'assistant' END) || ':' || text AS ta FROM m) m
    ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.i = r.i + 1),
e AS (SELECT r.conv_id, list_sort(list_filter([s0, s3, {'c': s2.c + 3, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'},
        {'c': s1.c + 6, 'a': s1.a || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}],
        lambda z: z.c IS NOT NULL))[1] AS best
      FROM r LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM r.conv_id WHERE r.i = coalesce(c.last, 0))
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit,
       sha256(substr(best.t, 2)) AS repaired_sha256
FROM e LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
