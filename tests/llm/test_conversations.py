import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curator.llm import conversations as C

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def faults_of(rows):
    out, seen = [], set()
    for role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        if not shown:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def all_edits(rows):
    """Every way with at most two insertions in one place: (cost, audit, turns)."""
    places = [[x for n in range(3) for x in itertools.product("ua", repeat=n)] for _ in range(len(rows) + 1)]
    faults, names = faults_of(rows), {"u": "user", "a": "assistant"}
    for inserted in itertools.product(*places):
        ways = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in faults]
        for edits in itertools.product(*ways):
            cost, audit, turns = 0, "", []
            for i, more in enumerate(inserted):
                cost, audit = cost + 2 * len(more), audit + "I" * len(more)
                turns += [(names[x], "") for x in more]
                if i < len(rows):
                    role, text = rows[i]
                    audit += edits[i][0]
                    cost += {"D": 3, "K": 0, "R": 2}[edits[i][0]] + (faults[i] == "truncated" and edits[i] != "D")
                    if edits[i] != "D":
                        turns.append((role if edits[i] == "K" else names[edits[i][1]], text))
            if LEGAL.match("".join(r[:1] or "-" for r, _ in turns)):
                yield cost, audit, turns


def expected(rows):
    cost, audit, turns = min(all_edits(rows), key=lambda x: x[:2])
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def chunk_of(rows):
    c = C._Chunk(1)
    for role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        flag = C.BLANK if not shown else 0 if shown[-1] in ".!?" else C.TRUNCATED
        c.add(None, role, text, hashlib.sha256(f"{role}:{text}".encode()).digest(), flag)
    return c


ROLES = ["user", "assistant", "system", "tool", "", "unit"]
TEXTS = ["Fine.", "Well?", "cut", "", " \t", "so!  ", "Other."]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ROLES), st.sampled_from(TEXTS)), max_size=3))
def test_the_cheapest_edits_of_all(rows):
    found = C._finished(chunk_of(rows))
    assert found[5:] == expected(rows)
    faults = faults_of(rows)
    assert found[1:4] == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
    kinds = [r[:1] for r, _ in rows]
    assert found[4] == sum((a + b) not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))


def test_longer_ties():
    for rows in ([("user", f"Same {i}.") for i in range(4)], [("assistant", "A."), ("assistant", "B."), ("user", "C."), ("system", "D.")]):
        assert C._finished(chunk_of(rows))[5:] == expected(rows)


def test_chunks_in_a_chain_equal_one_piece():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice(ROLES), rng.choice([f"Fine {rng.randrange(9)}.", "cut", "", "Well?"])) for _ in range(rng.randrange(1, 40))]
        whole = chunk_of(rows)
        faults, kinds = C._faults(whole.flags, whole.digests, set()), [r[:1] for r in whole.roles]
        chain, cuts = C._Chain(), sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(4))})
        for no, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part = [*zip(kinds[a:b], faults[a:b])]
            weights = [w for q in range(4) for w in C.least_weights(part, q)]
            packed = [None if w is None else w.to_bytes(-(-w.bit_length() // 8), "big") for w in weights]
            illegal = sum(not C._legal(x, y) for x, y in zip(kinds[a:b], kinds[a + 1 : b]))
            chain.add({
                "part": 0, "no": no, "rows": b - a, "first": kinds[a], "last": kinds[b - 1], "blank": faults[a:b].count(1), "duplicate": faults[a:b].count(2),
                "truncated": faults[a:b].count(3), "illegal": illegal, "low": None, "high": None, "turns": 0, "weights": packed})
        audit, got = "", [*chain.rows()][::-1]
        for (a, b), (_, _, start, to, closing, *totals) in zip(zip(cuts, cuts[1:]), got):
            weight = C.least_weights([*zip(kinds[a:b], faults[a:b])], start)[to]
            audit += C.letters(weight, b - a) + closing
        assert (tuple(totals), audit) == (C._finished(whole)[:6], C._finished(whole)[6])


def python_result(rows):
    """The query's result by a plain loop; `rows`: (conv_id, turn, role, text)."""
    found = {}
    for conv_id, turn, role, text in rows:
        own = found.setdefault(conv_id, [])
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv_id, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        c = C._Chunk(conv_id)
        for (turn, role, text), flag in zip(own, chunk_of([r[1:] for r in own]).flags):
            c.add(turn, role, text, hashlib.sha256(f"{role}:{text}".encode()).digest(), flag)
        out[conv_id] = C._finished(c)
    return out


def odd_rows():
    rng = random.Random(8)
    rows = [(c, t, rng.choice(ROLES[:4]), f"Turn {t} of {c}{rng.choice(['.', '!', '', '  '])}") for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(100, t, rng.choice(ROLES[:3]), rng.choice(["Again.", f"New {t}.", "cut"])) for t in range(500)]
    rows += [(None, t, rng.choice(ROLES[:3]), f"Free {t}.") for t in range(40)] + [(None, None, None, None)]
    rows += [(101, None, "user", "Tie."), (101, None, "assistant", "Tie."), (101, 4, "user", "Ünï 数."), (101, 4, "user", "Ünï 数."), (101, 4, "user", "x " * 40_000)]
    rows += [(102, -(2**62), "user", "Far."), (102, 2**62, "assistant", "Away."), (103, 1, "", ""), (104, 7, "user", None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, times string, part int, flag int")


@pytest.mark.parametrize("chunk_rows", [3, 256])
def test_odd_rows(spark, chunk_rows):
    rows = odd_rows()
    got = C.repair(C.damaged(frame(spark, rows)), chunk_rows=chunk_rows).collect()
    want = python_result(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_an_empty_table_and_dropped_conversations(spark):
    assert C.repair(C.damaged(frame(spark, []))).collect() == []
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = C.repair(C.damaged(frame(spark, [(conv, 0, "user", "Gone.")]))).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_text_ids(spark):
    rows = spark.createDataFrame([("a", 1, "user", "Hi.", 1), ("a", 2, "assistant", "Yes.", 1)], "conv_id string, turn int, role string, text string, times int")
    assert [(r.conv_id, r.audit) for r in C.repair(rows).collect()] == [("a", "KK")]
    with pytest.raises(TypeError):
        C.repair(rows.withColumn("conv_id", rows.turn == 1))
