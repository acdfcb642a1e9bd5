"""Repair of conversation structure by the cheapest edits, decided by whole-number shortest paths.

A conversation is to read `(s?(ua)+)?` by the first letters of its roles. Every row is kept, given another role or
deleted, and empty turns may be inserted before it. The graph has a node for each place between rows and each state of
that expression; an edge passes one row. An edge's weight is one whole number: its high digits are the cost, its low
digits hold the letters of its edits in the slot of its row. All slots have the same width, three letters, filled with
zeros at the end, so sums of weights compare first by cost and then by the letters in ASCII order: the letters before a row
end with the row's own, hence no slot of one choice begins another. The least sum decides everything.

Rows are sorted in ranges of the whole key and streamed. A conversation that lies inside a task and a chunk is finished
there. Others are cut into chunks of bounded size: a chunk's rows become the least weights between each pair of states,
the chunks of a conversation are chained over these summaries, and each chunk is then repaired by itself.
"""

from __future__ import annotations

import array
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curator.llm.common import materialize, partitions

#: Rows and characters of one chunk (one row at least).
CHUNK_ROWS, CHUNK_CHARS = 256, 1 << 20
BATCH_CHARS = 4 << 20

START, S, U, A = range(4)
#: What a turn of each kind leads to, by state.
_MOVES = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
#: The only user or assistant turn that a state takes.
_NEXT = {START: "u", S: "u", U: "a", A: "u"}
_ROLE = {"u": "user", "a": "assistant"}
KEEP_TRUNCATED, REROLE, DELETE, INSERT = 1, 2, 3, 2
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Letters in ASCII order, three bits each, three to a slot.
_LETTERS = " DIKR"
SLOT = 9


def _slot(letters: str) -> int:
    code = 0
    for c in letters.ljust(3):
        code = code << 3 | _LETTERS.index(c)
    return code


def _inserted(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, letters) after no, one or two inserted turns; three would only repeat a state."""
    out = [(state, 0, "")]
    for n in (1, 2):
        state = _MOVES[state][_NEXT[state]]
        out.append((state, n * INSERT, "I" * n))
    return out


def _edges(initial: str, fault: int) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, slot) of the ways to pass a row, the least for each pair of states."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for state in range(4):
        for at, cost, letters in _inserted(state):
            ways = [(at, cost + DELETE, "D")]
            if fault not in (BLANK, DUPLICATE):
                kept = cost + (KEEP_TRUNCATED if fault == TRUNCATED else 0)
                if initial in _MOVES[at]:
                    ways.append((_MOVES[at][initial], kept, "K"))
                ways.append((_MOVES[at][_NEXT[at]], kept + REROLE, "R"))
            for to, total, letter in ways:
                found = (total, _slot(letters + letter))
                best[state, to] = min(best.get((state, to), found), found)
    return [(a, b, *best[a, b]) for a, b in sorted(best)]


_EDGES = {(i, f): _edges(i, f) for i in ("s", "u", "a", "") for f in range(4)}
#: (from, cost, slot) of the ways to end: turns inserted after the last row.
_ENDS = [(q, cost, _slot(letters)) for q in range(4) for at, cost, letters in _inserted(q) if at in (START, A)]


def least_weights(rows: list[tuple[str, int]], start: int) -> list[int | None]:
    """Least weight of a path over `rows` (initial, fault) from `start` to each state: cost above, one slot a row below."""
    width = SLOT * len(rows)
    now: list[int | None] = [None] * 4
    now[start] = 0
    for i, (initial, fault) in enumerate(rows):
        then: list[int | None] = [None] * 4
        shift = width - SLOT * (i + 1)
        for a, b, cost, slot in _EDGES[initial if initial in ("s", "u", "a") else "", fault]:
            if now[a] is not None:
                weight = now[a] + (cost << width) + (slot << shift)
                if then[b] is None or weight < then[b]:
                    then[b] = weight
        now = then
    return now


def end(now: list[int | None], rows: int) -> tuple[int, int]:
    """(state, least weight with one more slot) of the cheapest way to end at the weights `now` of a path over `rows` rows."""
    ways = [((now[q] << SLOT) + (cost << SLOT * (rows + 1)) + slot, q) for q, cost, slot in _ENDS if now[q] is not None]
    weight, state = min(ways)
    return state, weight


def letters(digits: int, slots: int) -> str:
    """The edits' letters of the lowest `slots` slots."""
    digits &= (1 << SLOT * slots) - 1
    return "".join(_LETTERS[(digits >> at) & 7] for at in range(SLOT * slots - 3, -1, -3)).replace(" ", "")


def repaired(audit: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """The turns, as `role:text`, that the edits make of the rows from a state on."""
    out, i = [], 0
    for edit in audit:
        if edit == "K":
            kind, turn = roles[i][:1], f"{roles[i]}:{texts[i]}"
        elif edit == "D":
            i += 1
            continue
        else:
            kind = _NEXT[state]
            turn = f"{_ROLE[kind]}:{texts[i] if edit == 'R' else ''}"
        i += edit != "I"
        state = _MOVES[state][kind]
        out.append(turn)
    return out


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class _Chunk:
    """Rows of one conversation, in order: at most `CHUNK_ROWS`."""

    def __init__(self, conv_id):
        self.conv_id, self.roles, self.texts, self.digests, self.flags, self.chars = conv_id, [], [], [], [], 0
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, role: str, text: str, digest: bytes, flag: int) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.digests.append(digest)
        self.flags.append(flag)
        self.chars += len(text) + len(role)
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1


def _faults(flags: Iterable[int], digests: Iterable[bytes], seen: set[bytes]) -> list[int]:
    out = []
    for flag, digest in zip(flags, digests):
        out.append(BLANK if flag == BLANK else DUPLICATE if digest in seen else flag)
        seen.add(digest)
    return out


def _gaps(low, high, turns: int) -> int | None:
    found = 0 if low is None else high - low + 1 - turns
    return found if found < 1 << 63 else None


def _finished(c: _Chunk) -> tuple:
    """The result of a conversation that is one chunk."""
    faults = _faults(c.flags, c.digests, set())
    kinds = [r[:1] for r in c.roles]
    slots = len(kinds) + 1
    _, weight = end(least_weights([*zip(kinds, faults)], START), len(kinds))
    cost, audit = _ended(weight, slots)
    turns = repaired(audit, START, c.roles, c.texts)
    return (
        _gaps(c.low, c.high, c.turns), faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED),
        sum(not _legal(a, b) for a, b in zip(kinds, kinds[1:])), cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def _ended(weight: int, slots: int) -> tuple[int, str]:
    return weight >> SLOT * slots, letters(weight, slots)


_RESULT = (
    ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()))
_RESULT_DDL = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")
_PARTS = (
    ("part", pa.int64()), ("no", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    ("digests", pa.list_(pa.binary())), ("flags", pa.list_(pa.int64())), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()))
_PARTS_DDL = (
    "part bigint, no bigint, roles array<string>, texts array<string>, digests array<binary>, flags array<bigint>, low bigint, high bigint, turns bigint")


class _Rows:
    """Collects output rows into batches of bounded size."""

    def __init__(self, fields: Iterable[tuple[str, pa.DataType]]):
        self.fields, self.rows, self.chars = [*fields], [], 0

    def add(self, row: tuple, chars: int = 0) -> None:
        self.rows.append(row)
        self.chars += chars

    def full(self) -> bool:
        return len(self.rows) >= 2000 or self.chars >= BATCH_CHARS

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[]] * len(self.fields)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, self.fields)], [n for n, _ in self.fields])
        self.rows, self.chars = [], 0
        return batch


def damaged(rows: DataFrame) -> DataFrame:
    """The damage that the query repairs, by a checksum of `conv_id:turn` (null: one space): adds `times`, how often a row stays."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    kind = F.crc32(key) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows in ranges of (conversation, turn, role, text), with the digest of role and text and the row's own fault."""
    shown = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    flag = F.when(shown == "", BLANK).when(F.right(shown, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    gone = F.col("times") == 0
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    ready = rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.when(~gone, F.col("role")).alias("role"), F.when(~gone, F.col("text")).alias("text"),
        F.when(~gone, digest).alias("digest"), F.when(~gone, flag).alias("flag"), "times", F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    keys = ["conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64), "digest"]
    # The salt spreads copies of a row over ranges; they are interchangeable.
    ranged = ready.repartitionByRange(partitions(rows.sparkSession), *keys, "salt").sortWithinPartitions(*keys)
    return ranged.select("conv_id", "turn", "role", "text", "digest", "flag", "times")


def _cut(key_type: pa.DataType, chunk_rows: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0
        out = _Rows((("conv_id", key_type), *_RESULT, *_PARTS))
        blank = (None,) * len(_RESULT)
        now: _Chunk | None = None
        first = True  # a conversation that may have begun in the range before
        going = False  # `now` goes on from a chunk before

        def close(c: _Chunk, is_open: bool) -> None:
            nonlocal no
            if is_open:
                out.add((c.conv_id, *blank, part, no, c.roles, c.texts, c.digests, c.flags, c.low, c.high, c.turns), c.chars)
                no += 1
            else:
                out.add((c.conv_id, *_finished(c), *(None,) * len(_PARTS)))

        for batch in batches:
            for conv_id, turn, role, text, digest, flag, times in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if now is None:
                    now = _Chunk(conv_id)
                elif conv_id != now.conv_id:
                    close(now, first or going)
                    now, first, going = _Chunk(conv_id), False, False
                for _ in range(times):
                    if now.roles and (len(now.roles) >= chunk_rows or now.chars + len(text) > CHUNK_CHARS):
                        close(now, True)
                        now, going = _Chunk(conv_id), True
                    now.add(turn, role, text, digest, flag)
                if out.full():
                    yield out.take()
        if now is not None:
            close(now, True)
        yield out.take()

    return chunks


def _faulty(batch: pa.RecordBatch) -> Iterator[tuple[dict, list[int], list[str]]]:
    """Chunks with the faults of their rows; `late` lists the digests that chunks before have."""
    for row in batch.to_pylist():
        faults = _faults(row["flags"], row["digests"], set(row["late"] or []))
        yield row, faults, [r[:1] for r in row["roles"]]


_SUMMARY = (
    ("part", pa.int64()), ("no", pa.int64()), ("rows", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()),
    ("weights", pa.list_(pa.binary())))
_SUMMARY_DDL = (
    "part bigint, no bigint, rows bigint, first string, last string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "low bigint, high bigint, turns bigint, weights array<binary>")


def _summarise(key_type: pa.DataType):
    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows((("conv_id", key_type), *_SUMMARY))
        for batch in batches:
            for row, faults, kinds in _faulty(batch):
                weights = [w for q in range(4) for w in least_weights([*zip(kinds, faults)], q)]
                packed = [None if w is None else w.to_bytes(-(-w.bit_length() // 8), "big") for w in weights]
                out.add((
                    row["conv_id"], row["part"], row["no"], len(kinds), kinds[0] if kinds else None, kinds[-1] if kinds else None,
                    faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED),
                    sum(not _legal(a, b) for a, b in zip(kinds, kinds[1:])), row["low"], row["high"], row["turns"], packed))
            yield out.take()

    return summaries


_CHAIN = (
    ("part", pa.int64()), ("no", pa.int64()), ("from_state", pa.int64()), ("to_state", pa.int64()), ("closing", pa.string()), ("gaps", pa.int64()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()))
_CHAIN_DDL = (
    "part bigint, no bigint, from_state bigint, to_state bigint, closing string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, cost bigint")


class _Chain:
    """The shortest path over a conversation's chunks. A prefix is its cost and its rank among the four prefixes by
    letters; 2 bits of rank take the place of all slots before, so a weight is as long as a chunk. Held per chunk: its
    number and the state before each state."""

    def __init__(self):
        self.parts, self.nos, self.back = array.array("q"), array.array("q"), bytearray()
        self.costs: list[int | None] = [0, None, None, None]
        self.ranks = [0] * 4
        self.counts = [0, 0, 0, 0]
        self.low = self.high = None
        self.turns, self.last = 0, None

    def add(self, row: dict) -> None:
        width = SLOT * row["rows"]
        then: list[tuple[int, int, int] | None] = [None] * 4
        for a in range(4):
            for b in range(4):
                packed = row["weights"][4 * a + b]
                if packed is None or self.costs[a] is None:
                    continue
                weight = int.from_bytes(packed, "big")
                cost = self.costs[a] + (weight >> width)
                digits = (self.ranks[a] << width) + (weight & ((1 << width) - 1))
                found = ((cost << width + 2) + digits, digits, a)
                if then[b] is None or found < then[b]:
                    then[b] = found
        order = sorted({f[1] for f in then if f})
        self.costs = [f[0] >> width + 2 if f else None for f in then]
        self.ranks = [order.index(f[1]) if f else 0 for f in then]
        self.parts.append(row["part"])
        self.nos.append(row["no"])
        self.back.append(sum((f[2] if f else 0) << 2 * q for q, f in enumerate(then)))
        for i, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[i] += row[name]
        if row["rows"]:
            self.counts[3] += self.last is not None and not _legal(self.last, row["first"])
            self.last = row["last"]
        if row["low"] is not None:
            self.turns += row["turns"] - (self.high == row["low"])
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]

    def rows(self) -> Iterator[tuple]:
        """A row for each chunk, from the last to the first."""
        weights = [None if c is None else (c << 2) + r for c, r in zip(self.costs, self.ranks)]
        cost, _, slot, state = min(
            ((w >> 2) + more, w & 3, slot, q) for q, more, slot in _ENDS if (w := weights[q]) is not None)
        totals = (_gaps(self.low, self.high, self.turns), *self.counts, cost)
        closing = letters(slot, 1)
        for i in range(len(self.parts) - 1, -1, -1):
            before = self.back[i] >> 2 * state & 3
            yield (self.parts[i], self.nos[i], before, state, closing, *totals)
            state, closing = before, ""


def _link(key_type: pa.DataType):
    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(_CHAIN)
        now, chain = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if chain is None or row["conv_id"] != now:
                    if chain is not None:
                        for r in chain.rows():
                            out.add(r)
                            if out.full():
                                yield out.take()
                    now, chain = row["conv_id"], _Chain()
                chain.add(row)
        if chain is not None:
            for r in chain.rows():
                out.add(r)
                if out.full():
                    yield out.take()
        yield out.take()

    return chained


def _mend(key_type: pa.DataType):
    fields = (("conv_id", key_type), *_CHAIN[:2], *_RESULT[:6], ("audit", pa.string()), ("turns", pa.string()))

    def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(fields)
        for batch in batches:
            for row, faults, kinds in _faulty(batch):
                start = row["from_state"]
                weight = least_weights([*zip(kinds, faults)], start)[row["to_state"]]
                audit = letters(weight, len(kinds)) + (row["closing"] or "")
                turns = "".join(f"\n{t}" for t in repaired(audit, start, row["roles"], row["texts"]))
                out.add((row["conv_id"], row["part"], row["no"], *(row[n] for n, _ in _RESULT[:6]), audit, turns), len(turns))
                if out.full():
                    yield out.take()
        yield out.take()

    return mended


def _join_up(key_type: pa.DataType):
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows((("conv_id", key_type), *_RESULT))
        now, totals, audit, sha, empty = None, None, [], hashlib.sha256(), True

        def finish() -> None:
            out.add((now, *totals, "".join(audit), sha.hexdigest()))

        for batch in batches:
            for row in batch.to_pylist():
                if totals is None or row["conv_id"] != now:
                    if totals is not None:
                        finish()
                    now, totals = row["conv_id"], tuple(row[n] for n, _ in _RESULT[:6])
                    audit, sha, empty = [], hashlib.sha256(), True
                audit.append(row["audit"])
                sha.update((row["turns"][1:] if empty else row["turns"]).encode())
                empty = empty and not row["turns"]
            if out.full():
                yield out.take()
        if totals is not None:
            finish()
        yield out.take()

    return joined


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    `rows`: conv_id, turn, role, text and `times`, how often a row stands there (0: it only names its conversation). A
    null conv_id is a conversation; null turns come first; rows of one turn are ordered by role, the first 64
    characters of the text and its digest, copies follow each other. A conversation without rows has zeros, an empty
    audit and the hash of the empty string. An empty table gives no row. `gaps` beyond 64 bits is null.

    The one shuffle of all texts is by ranges. Chunks go through two more, but only those of conversations that lie
    in several chunks or touch the border of a range. The chain of one conversation reads summaries of 1/`chunk_rows` of its
    rows; only its SHA-256, which can't be split, streams its repaired text through one task, piece by piece.
    """
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType
    key_ddl, key_type = f"conv_id {kind.simpleString()}", pa.string() if kind.simpleString() == "string" else pa.int64()
    if kind.simpleString() not in ("string", "bigint"):
        raise TypeError("conv_id must be bigint or string")
    cut = materialize(
        _sorted(rows).mapInArrow(_cut(key_type, chunk_rows), f"{key_ddl}, {_RESULT_DDL}, {_PARTS_DDL}"), "conversations")
    result = ["conv_id", *[n for n, _ in _RESULT]]
    done, parts = cut.where("part is null").select(result), cut.where("part is not null").select("conv_id", *[n for n, _ in _PARTS])

    seen = parts.select("conv_id", "part", "no", F.explode(F.array_distinct("digests")).alias("digest"))
    firsts = seen.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "no")).alias("first"), F.count("*").alias("chunks")).where("chunks > 1")
    firsts = firsts.select(F.col("conv_id").alias("first_conv"), F.col("digest").alias("first_digest"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("first_conv")) & (F.col("digest") == F.col("first_digest"))
    late = seen.join(firsts, same).where(F.struct("part", "no") > F.col("first")).groupBy("part", "no").agg(F.collect_list("digest").alias("late"))
    late = materialize(late, "repeated")

    known = parts.join(late, ["part", "no"], "left").select("conv_id", *[n for n, _ in _PARTS], "late")
    summaries = known.drop("texts").mapInArrow(_summarise(key_type), f"{key_ddl}, {_SUMMARY_DDL}")
    n = partitions(spark)
    ordered = summaries.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "no")
    chain = materialize(ordered.mapInArrow(_link(key_type), _CHAIN_DDL), "chained")

    mended = known.join(chain, ["part", "no"]).mapInArrow(
        _mend(key_type), f"{key_ddl}, part bigint, no bigint, {_RESULT_DDL.rsplit(', ', 2)[0]}, audit string, turns string")
    streamed = mended.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "no")
    return done.unionByName(streamed.mapInArrow(_join_up(key_type), f"{key_ddl}, {_RESULT_DDL}").select(result))


def _edge_values() -> str:
    """The edges of one row as SQL values: (kind, fault, from, to, cost, slot), slots as three characters."""
    rows = []
    for (initial, fault), edges in _EDGES.items():
        for a, b, cost, slot in edges:
            text = "".join(_LETTERS[(slot >> at) & 7] for at in (6, 3, 0))
            rows.append(f"('{initial}', {fault}, {a}, {b}, {cost}, '{text}')")
    return ", ".join(rows)


def _end_values() -> str:
    return ", ".join(f"({q}, {cost}, '{''.join(_LETTERS[(slot >> at) & 7] for at in (6, 3, 0))}')" for q, cost, slot in _ENDS)


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(
            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')]),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) % 20"""

#: The same for DuckDB: costs and padded letters as structs, one recursion step per row.
ORACLE = f"""
WITH RECURSIVE marked AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} AS kind FROM conversations),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM marked, (VALUES (1), (2)) twice(n) WHERE kind <> 0 AND (n = 1 OR kind = 3)),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text)) AS i, rtrim(text, {_WHITE}) AS shown
    FROM damaged),
rows AS (
    SELECT conv_id, turn, role, text, i, left(role, 1) AS kind,
        CASE WHEN shown = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(shown, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
    FROM numbered),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
        count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM rows GROUP BY conv_id),
edges(kind, fault, a, b, cost, slot) AS (VALUES {_edge_values()}),
ends(a, cost, slot) AS (VALUES {_end_values()}),
paths AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0::BIGINT, 'letters': ''}} AS best FROM counted
    UNION ALL
    SELECT p.conv_id, r.i, e.b, min({{'cost': p.best.cost + e.cost, 'letters': p.best.letters || e.slot}})
    FROM paths p JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
    JOIN edges e ON e.a = p.state AND e.fault = r.fault AND e.kind = CASE WHEN r.kind IN ('s', 'u', 'a') THEN r.kind ELSE '' END
    GROUP BY p.conv_id, r.i, e.b),
chosen AS (
    SELECT p.conv_id, min({{'cost': p.best.cost + x.cost, 'letters': p.best.letters || x.slot}}) AS best
    FROM paths p JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i JOIN ends x ON x.a = p.state GROUP BY p.conv_id),
audits AS (SELECT conv_id, best.cost AS cost, replace(best.letters, ' ', '') AS audit FROM chosen),
edits AS (
    SELECT conv_id, k, audit[k] AS edit, k - length(replace(left(audit, k), 'I', '')) AS inserted
    FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM audits)),
kept AS (
    SELECT e.conv_id, e.k, e.edit, r.role, r.text, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.k) AS place
    FROM edits e LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.k - e.inserted AND e.edit <> 'I'
    WHERE e.edit <> 'D'),
turns AS (
    SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place + lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
        || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS turns
    FROM (SELECT *, max(CASE WHEN place = 1 AND edit = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lead FROM kept)
    GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
    coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(a.cost, 0) AS cost, coalesce(a.audit, '') AS audit,
    sha256(coalesce(t.turns, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
