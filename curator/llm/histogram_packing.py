"""Packing of token sequences by non-negative least squares over a histogram of lengths.

Long documents give whole windows first. What is left of each document (less than a window) is dealt into groups by a
hash of its row. In a group the lengths become a histogram of `classes` steps. Shallow combinations of steps that fill
a window exactly are the columns of a matrix; non-negative least squares solves how often each is to be repeated so
that the histogram is used up, longer lengths weighing more. The solution is rounded to what is there and laid out. The
residual is packed greedily: whole into the tightest space, and in the end the emptiest windows are taken apart and
cut to fill the others to the last token. One window per group may stay unfilled; it is cut into sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curator.llm.common import narrow
from curator.llm.word_tokens import default_path, word_encoder

#: Documents that one group packs. Groups are dealt by a hash of the row, so this bounds a group whatever the keys.
GROUP_ROWS = 4096
CLASSES, DEPTH = 64, 4

_DEALT = "deal bigint, doc_id bigint, doc_tokens bigint, whole array<bigint>, rest binary"
_PLACED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _words(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")


@functools.lru_cache(maxsize=4)
def combinations(classes: int, depth: int) -> np.ndarray:
    """One column per multiset of at most `depth` steps 1..classes whose sum is `classes`: how often it has each step."""
    found: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], left: int) -> None:
        if left == 0:
            found.append(chosen)
        elif len(chosen) < depth:
            most = min(left, chosen[-1] if chosen else left)
            # The steps that follow are no larger, so the next one is at least its share of what is left.
            for step in range(-(-left // (depth - len(chosen))), most + 1):
                extend((*chosen, step), left - step)

    extend((), classes)
    matrix = np.zeros((classes, len(found)))
    for j, chosen in enumerate(found):
        np.add.at(matrix[:, j], np.array(chosen) - 1, 1)
    return matrix


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method: the column of steepest descent enters, columns that
    the unrestricted solution would make negative leave. `rounds` bounds the entries; x is feasible after each."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    limit = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(rounds or 3 * a.shape[0]):
        descent = a.T @ (b - a @ x)
        descent[used] = -np.inf
        best = int(descent.argmax()) if len(descent) else 0
        if not len(descent) or descent[best] <= limit:
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            free = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (free > 0).all():
                x[:] = 0
                x[at] = free
                break
            down = free <= 0
            gap = x[at][down] - free[down]
            step = float((x[at][down] / np.where(gap > 0, gap, 1)).min())
            x[at] += step * (free - x[at])
            leave = at[down & (x[at] <= 1e-12)]
            if not len(leave):
                leave = at[down][:1]
            x[leave], used[leave] = 0, False
    return x


def repeats(counts: np.ndarray, classes: int, depth: int) -> list[tuple[np.ndarray, int]]:
    """(combination, how often): the rounded solution for a histogram, never using more of a step than there is."""
    matrix = combinations(classes, depth)
    matrix = matrix[:, (matrix[counts == 0] == 0).all(axis=0)]
    if not matrix.shape[1]:
        return []
    weight = np.arange(1, classes + 1) / classes
    x = non_negative_least_squares(matrix * weight[:, None], counts * weight)
    left, out = counts.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable").tolist():
        need = matrix[:, j].astype(np.int64)
        n = min(int(x[j] + 0.5), int((left[need > 0] // need[need > 0]).min()))
        if n:
            left -= n * need
            out.append((need, n))
    return out


def pack_lengths(sizes: np.ndarray, capacity: int, classes: int = CLASSES, depth: int = DEPTH) -> list[list[list[int]]]:
    """Sequences of [item, start, length] that hold every token of every item (of `sizes`, below `capacity`) once.

    All sequences are full, but for at most one per power of two, which has exactly that length.
    """
    classes = min(classes, capacity)
    step = -(-sizes * classes // capacity)  # 1..classes: the size in steps, rounded up
    stacks: list[list[int]] = [[] for _ in range(classes + 1)]
    for item in np.argsort(sizes, kind="stable").tolist():
        stacks[int(step[item])].append(item)
    counts = np.array([len(s) for s in stacks[1:]])
    bins: list[list[list[int]]] = []
    for need, n in repeats(counts, classes, depth):
        members = [c + 1 for c in np.flatnonzero(need) for _ in range(int(need[c]))]
        bins += [[[i := stacks[c].pop(), 0, int(sizes[i])] for c in reversed(members)] for _ in range(n)]
    free = [capacity - sum(p[2] for p in b) for b in bins]
    _best_fit([i for s in stacks for i in s], sizes, capacity, bins, free)
    return _fill(bins, free, capacity)


def _best_fit(items: list[int], sizes: np.ndarray, capacity: int, bins: list, free: list[int]) -> None:
    """Put the items, longest first, each into the bin with the least space that takes it; a bit set of the spaces in
    use finds it."""
    stacks: dict[int, list[int]] = {}
    spaces = 0
    for b, space in enumerate(free):
        if space:
            stacks.setdefault(space, []).append(b)
            spaces |= 1 << space
    for item in sorted(items, key=lambda i: (-int(sizes[i]), i)):
        size = int(sizes[item])
        fits = spaces >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = stacks[space].pop()
            if not stacks[space]:
                spaces ^= 1 << space
        else:
            b, space = len(bins), capacity
            bins.append([])
            free.append(capacity)
        bins[b].append([item, 0, size])
        left = free[b] = space - size
        if left:
            stacks.setdefault(left, []).append(b)
            spaces |= 1 << left


def _fill(bins: list, free: list[int], capacity: int) -> list:
    """Cut the pieces of the emptiest bins into the spaces of the fullest; cut the last one at powers of two."""
    open_ = sorted((b for b in range(len(bins)) if free[b]), key=lambda b: (free[b], b))
    done, i, j = [bins[b] for b in range(len(bins)) if not free[b]], 0, len(open_) - 1
    while i < j:
        taker, giver = bins[open_[i]], bins[open_[j]]
        while free[open_[i]] and giver:
            item, start, length = giver[-1]
            moved = min(length, free[open_[i]])
            taker.append([item, start + length - moved, moved])
            free[open_[i]] -= moved
            if moved == length:
                giver.pop()
            else:
                giver[-1][2] -= moved
        if not free[open_[i]]:
            done.append(taker)
            i += 1
        if not giver:
            j -= 1
    if i == j and bins[open_[i]]:
        rest = bins[open_[i]]
        total = sum(p[2] for p in rest)
        while total:
            part, want = [], 1 << (total.bit_length() - 1)
            total -= want
            while want:
                item, start, length = rest[-1]
                moved = min(length, want)
                part.append([item, start + length - moved, moved])
                want -= moved
                if moved == length:
                    rest.pop()
                else:
                    rest[-1][2] -= moved
            done.append(part)
    return done


def pack_documents(
    docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id",
    text_col: str = "text", group_rows: int = GROUP_ROWS, classes: int = CLASSES, depth: int = DEPTH,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document.

    `capacity` is a power of two. Every whole text is encoded once and gets `end_id`; null and empty texts are the end
    id alone. One shuffle deals the documents into groups: it carries the ids of less than a window per document and
    one checksum for each whole window before. Repeated rows, repeated and null ids are packed as documents of
    their own, each row in one group; an empty table gives an empty result. The number of groups follows the number
    of rows, so a group holds about `group_rows` documents at every size.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    path = tokenizer or default_path()
    end = np.array([end_id], "<u4").tobytes()
    rows = narrow(docs, id_col, text_col)
    groups = max(1, -(-rows.count() // group_rows))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(path)
        kind = "<u2" if max(enc.vocab_size, end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            totals, whole, rest = [], [], []
            for text in batch.column(2).to_pylist():
                ids = enc.encode(text) + end
                full = len(ids) // (4 * capacity) * 4 * capacity
                totals.append(len(ids) // 4)
                whole.append([zlib.crc32(ids[at : at + 4 * capacity]) for at in range(0, full, 4 * capacity)])
                rest.append(_words(ids[full:]).astype(kind).tobytes())
            columns = [batch.column(0), batch.column(1), pa.array(totals, pa.int64()), pa.array(whole, pa.list_(pa.int64())), pa.array(rest, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["deal", "doc_id", "doc_tokens", "whole", "rest"])

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        doc_ids, totals = table["doc_id"].to_pylist(), table["doc_tokens"].to_pylist()
        whole, rest = table["whole"].to_pylist(), table["rest"].to_pylist()
        sequence, out = (key[0].as_py() or 0) << 36, []
        for doc_id, total, sums in zip(doc_ids, totals, whole):
            for k, crc in enumerate(sums):
                out.append((doc_id, k * capacity, capacity, crc, total, sequence, 0))
                sequence += 1
        firsts = [len(sums) * capacity for sums in whole]
        sizes = np.array(totals, np.int64) - np.array(firsts, np.int64)
        items = np.flatnonzero(sizes)
        ids = {i: np.frombuffer(rest[i], "<u2" if len(rest[i]) == 2 * sizes[i] else "<u4").astype("<u4") for i in items.tolist()}
        for pieces in pack_lengths(sizes[items], capacity, classes, depth):
            at = 0
            for item, start, length in pieces:
                i = int(items[item])
                out.append((doc_ids[i], firsts[i] + start, length, zlib.crc32(ids[i][start : start + length]), totals[i], sequence, at))
                at += length
            sequence += 1
        names = [c.split(" ")[0] for c in _PLACED.split(", ")]
        columns = zip(*out) if out else [[]] * len(names)
        return pa.table([pa.array(c, pa.int64()) for c in columns], names)

    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("deal")
    dealt = rows.select(deal, "doc_id", "text").mapInArrow(encode, _DEALT)
    return dealt.groupBy("deal").applyInArrow(pack, _PLACED)
