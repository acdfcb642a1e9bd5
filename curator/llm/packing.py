"""Best-fit packing of token pieces into sequences, with lower bounds from dual feasible functions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curator.llm.common import materialize, narrow
from curator.llm.tokens import default_path, encoder

#: Pieces that one group packs. Groups are dealt by a hash of the row, so this bounds a group whatever the keys.
GROUP_ROWS = 4096

_PIECE = "row bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PLACED = _PIECE + ", sequence_id bigint, offset bigint, free bigint, gap bigint, emptiest boolean"


def token_pieces(
    docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids of every whole text and its end id, in pieces of `capacity`.

    Only longer documents are cut; the first piece takes the remainder, so all others are full. Null and empty texts
    are one piece of the end id.
    """
    path = tokenizer or default_path()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.encode(text) + end
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    size = (n % capacity or capacity) if at == 0 else capacity
                    out.append((doc_id, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, piece = at + size, piece + 1
            columns = zip(*out) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return narrow(docs, id_col, text_col).mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the offset of every piece, and the free space of every bin.

    Open bins are stacked by their free space; a bit set of the spaces in use finds the tightest fit in one step.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    stacks: dict[int, list[int]] = {}
    spaces, free = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = spaces >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            at = stacks[space].pop()
            if not stacks[space]:
                spaces ^= 1 << space
        else:
            at, space = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i] = at, capacity - space
        left = free[at] = space - size
        if left:
            stacks.setdefault(left, []).append(at)
            spaces |= 1 << left
    return bins, offsets, np.array(free, np.int64)


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can go below: the best of several dual feasible functions.

    For sizes as shares of the capacity: the identity; for a threshold t up to one half, 1 above 1 - t, the identity
    in between, 0 below t; and over each of these u_k(x) = x where (k + 1) x is whole, else floor((k + 1) x) / k.
    All arithmetic is in whole numbers.
    """
    if not len(sizes):
        return 0
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    best = -(-int((sizes * counts).sum()) // capacity)
    steps = np.unique(np.concatenate((sizes[sizes * 2 <= capacity], capacity - sizes[sizes * 2 > capacity] + 1)))
    for t in np.concatenate(([0], steps[(steps > 0) & (steps * 2 <= capacity)])).tolist():
        x = np.where(sizes > capacity - t, capacity, np.where(sizes < t, 0, sizes))
        best = max(best, -(-int((x * counts).sum()) // capacity))
        for k in (1, 2, 3, 5):
            y = np.where((x * (k + 1)) % capacity == 0, x * k, (x * (k + 1)) // capacity * capacity)
            best = max(best, -(-int((y * counts).sum()) // (k * capacity)))
    return best


def _pack_groups(pieces: DataFrame, groups: int, stage: int, capacity: int) -> DataFrame:
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        sizes = table["length"].to_numpy()
        bins, offsets, free = best_fit(sizes, capacity)
        gap = len(free) - lower_bound(*np.unique(sizes, return_counts=True), capacity)
        first = (stage << 52) + (key[0].as_py() << 24)
        table = table.select([c.split(" ")[0] for c in _PIECE.split(", ")])
        for name, values in (
            ("sequence_id", first + bins), ("offset", offsets), ("free", free[bins]),
            ("gap", np.full(len(bins), gap)), ("emptiest", bins == free.argmax()),
        ):
            table = table.append_column(name, pa.array(values))
        return table

    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("row", F.lit(stage)), F.lit(groups)))
    return materialize(dealt.groupBy("deal").applyInArrow(pack, _PLACED), "packed")


def pack_pieces(pieces: DataFrame, capacity: int = 1024, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Give every piece a sequence_id and an offset, gapless from 0, in as few sequences as the rounds can reach.

    Full pieces are sequences by themselves. The rest is dealt into groups of about `group_rows` and packed by
    best-fit decreasing; a dual-feasible lower bound certifies each group's number of bins. While all bins together
    exceed the bound over the whole table, groups with a gap give the pieces of all their bins that have space left,
    and certified groups those of their emptiest bin; the pool is dealt anew into groups of about `group_rows`, which mixes
    the pieces of different groups, and packed again. A round that saves no bin is discarded and ends the search.
    The driver holds the counts of the `capacity` possible lengths and nothing else.
    """
    stored = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = stored.where(F.col("length") == capacity).select(
        "*", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")).select(columns)
    sizes = sorted((r["length"], r["count"]) for r in stored.where(F.col("length") < capacity).groupBy("length").count().collect())
    rows = sum(n for _, n in sizes)
    if not rows:
        return full
    bound = lower_bound(np.array([s for s, _ in sizes]), np.array([n for _, n in sizes]), capacity)
    groups, stage, settled, done = -(-rows // group_rows), 0, 0, [full]
    now = _pack_groups(stored.where(F.col("length") < capacity), groups, stage, capacity)
    bins = _bins(now)
    while settled + bins > bound and groups > 1:
        stage += 1
        moves = ((F.col("gap") > 0) & (F.col("free") > 0)) | F.col("emptiest")
        pool = now.where(moves)
        counted = pool.agg(F.count("*").alias("n"), F.count(F.when(F.col("offset") == 0, 1)).alias("bins")).first()
        groups = -(-counted["n"] // group_rows)
        again = _pack_groups(pool, groups, stage, capacity)
        fewer = _bins(again)
        if fewer >= counted["bins"]:
            break
        done.append(now.where(~moves).select(columns))
        settled, now, bins = settled + bins - counted["bins"], again, fewer
    for part in done:
        now = now.select(columns).unionByName(part)
    return now


def _bins(placed: DataFrame) -> int:
    """Every bin has exactly one piece at offset 0."""
    return placed.where("offset = 0").count()


def pack_documents(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Cut and pack all documents: (doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Repeated rows are packed as rows of their own; an empty table gives an empty result.
    """
    return pack_pieces(token_pieces(docs, capacity, tokenizer, end_id), capacity, group_rows)
