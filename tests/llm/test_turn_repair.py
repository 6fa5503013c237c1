"""Operator 13 against a recursion over all edits, on conversations of every awkward kind."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest

from framescore.llm import turn_repair as tr

SPACE = " \t\n\x0b\x0c\r"


def _damage(rows):
    """[(conv, turn, role, text)] by conversation, in order, after the damage."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if fate == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in convs.items()}


def _marks(turns):
    seen, marks = set(), ""
    for _, role, text in turns:
        bare = text.rstrip(SPACE)
        marks += "b" if not bare else "d" if (role, text) in seen else "." if bare[-1] in ".!?" else "t"
        seen.add((role, text))
    return marks


def _brute(turns):
    marks, chars = _marks(turns), [r[1][:1] for r in turns]

    def go(state, char):
        if char == "s":
            return 1 if state == 0 else None
        return 2 if char == "u" and state != 2 else 3 if char == "a" and state == 2 else None

    @lru_cache(None)
    def best(i, state, inserted):
        """(cost, audit, lines) of the rest, at most two inserts in a row."""
        ways = [(0, "", ())] if i == len(turns) and state in (0, 3) else []
        moves = []
        if inserted < 2:
            moves += [(3, "I", c, 0, n + ":") for c, n in (("u", "user"), ("a", "assistant"))]
        if i < len(turns):
            _, role, text = turns[i]
            moves.append((4, "D", None, 1, None))
            if marks[i] in ".t":
                more = 3 * (marks[i] == "t")
                moves += [(more, "K", chars[i], 1, f"{role}:{text}")]
                moves += [(3 + more, "R", c, 1, f"{n}:{text}") for c, n in (("u", "user"), ("a", "assistant"))]
        for cost, edit, char, step, line in moves:
            to = state if char is None else go(state, char)
            if to is not None:
                rest = best(i + step, to, 0 if step else inserted + 1)
                if rest:
                    ways.append((cost + rest[0], edit + rest[1], (() if line is None else (line,)) + rest[2]))
        return min(ways) if ways else None

    cost, audit, lines = best(0, 0, 0)
    known = [t for t, _, _ in turns if t is not None]
    pairs = list(zip(chars, chars[1:], strict=False))
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, marks.count("b"), marks.count("d"), marks.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _rows(seed, n, longest):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        role = 0
        for turn in range(rng.randint(1, longest)):
            role = 1 - role if rng.random() < 0.8 else role
            name = rng.choice(["system", "tool", "", None, "User", "admin"]) if rng.random() < 0.12 else ("user", "assistant")[role]
            text = rng.choice(["Fine.", "same", "same", "", None, "\n\t", "é!", "So? ", "x\x0b"]) if rng.random() < 0.3 else f"t{conv}-{turn}."
            rows.append((None if conv == 3 else conv, None if rng.random() < 0.05 else turn + (rng.random() < 0.1) * 3, name, text))
    return rows + rows[:4]


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture(scope="module")
def rows():
    return _rows(5, 60, 12) + [(900, 0, "system", "Only."), (901, None, None, None), (902, 1, "assistant", "A."),
                               (903, 2, "user", "x" * 200_000)]


def _as_dict(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("segment", [1024, 3, 1])
def test_equals_all_edits(spark, rows, segment, monkeypatch):
    """Also where every conversation is cut into segments of a few turns and chained again."""
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", part int").repartition(4)
    want = {c: _brute(tuple(v)) for c, v in _damage(rows).items()}
    monkeypatch.setattr(tr, "repair_turns", lambda t, f=tr.repair_turns: f(t, segment_rows=segment))
    got = _as_dict(tr.contract(df))
    assert got == want and None in got
    assert any("I" in v[6] for v in got.values()) and any("R" in v[6] for v in got.values())


def test_bands_and_chains_on_random_runs():
    """Alignment from and to every state, in one piece and chained, without Spark."""
    rng = random.Random(8)
    for _ in range(400):
        n = rng.randint(0, 14)
        chars = "".join(rng.choice("uuuaaas?") for _ in range(n))
        marks = "".join(rng.choice("......tbd") for _ in range(n))
        whole = tr.Alignment(marks, chars, (tr.START,)).arcs(tr.START)
        chain = tr.Chain("c")
        at = 0
        while at < n:
            cut = min(n, at + rng.randint(1, 4))
            table, arcs = tr.Alignment(marks[at:cut], chars[at:cut], range(4)), []
            for x in range(4):
                arcs += [(x, y, c, a) for y, (c, a) in table.arcs(x).items()]
            chain.add({"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "ends": chars[at] + chars[cut - 1], "part": 0,
                       "seg": at, "first_turn": at, "last_turn": cut - 1, "n_turns": cut - at, "x": [a[0] for a in arcs],
                       "y": [a[1] for a in arcs], "c": [a[2] for a in arcs], "audits": [a[3] for a in arcs]})
            at = cut
        row = next(chain.rows())
        assert tr.close(whole) == (row[6], row[7])


def test_a_long_conversation_is_chained(spark):
    """One conversation holds nearly all rows: its result equals the one in a single segment."""
    rng = random.Random(2)
    turns = [(1, t, ("user", "assistant")[t % 2] if rng.random() < 0.9 else "user", rng.choice(["a.", f"{t}.", f"{t}"]))
             for t in range(1500)] + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(turns, SCHEMA)
    rows = tr.damaged(df)
    assert _as_dict(tr.repair_turns(rows, segment_rows=100)) == _as_dict(tr.repair_turns(rows, segment_rows=5000))


def test_empty_and_dropped(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tr.contract(empty).collect() == []
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = tr.contract(spark.createDataFrame([(lost, 0, "user", "Gone.")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_equals_sql_on_the_given_conversations(spark):
    path = "/root/testdata/sf0.1/conversations.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    cur = con.execute(tr.ORACLE)
    cols = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in tr.contract(spark.read.parquet(path)).collect()) == want
