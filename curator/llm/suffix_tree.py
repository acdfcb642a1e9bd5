"""Language-model scoring with a probabilistic suffix tree over bytes, beside an exact unigram word model."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curator.llm.common import materialize

#: Longest context in bytes. With the next byte, a window is one 64-bit number.
DEPTH = 5
#: Ends every text and stands for what is before it; no word holds a line end.
END = 10
#: Bytes whose windows are sorted at once in a task, and different windows that it holds before it hands them over.
COUNTED, HELD = 6 << 20, 3 << 20
#: Texts are scored in pieces of this many bytes, all pieces of a batch in step.
PIECE = 1024
#: Retained contexts that a broadcast join meets; more are joined plainly.
BROADCAST = 1 << 20
#: Tokens and documents whose words are counted together; a document number takes 16 bits.
CHUNK_TOKENS, CHUNK_DOCS = 3 << 20, 1 << 16
NO_ID = np.iinfo(np.int64).min  # stands for a null doc_id


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, ASCII letters lowered."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def windows(line: bytes) -> np.ndarray:
    """Every byte of the line with the DEPTH bytes before it, as one number; END stands before the first."""
    x = np.frombuffer(bytes([END] * DEPTH) + line, np.uint8).astype(np.int64)
    out = np.zeros(len(line), np.int64)
    for j in range(DEPTH + 1):
        out = (out << 8) | x[j : j + len(line)]
    return out


@dataclass
class Tree:
    """A suffix tree as a table of states.

    A state is a retained context. `go[s, a]` is the longest retained suffix after byte class a, `log[s, a]` the log10
    probability of a there. Class 0 is padding (probability 1, keeps no state); the last class is all bytes that
    training never saw.
    """

    classes: np.ndarray
    go: np.ndarray
    log: np.ndarray

    def score(self, lines: list[bytes]) -> np.ndarray:
        """log10 probability of each line, END included."""
        rows, owner = [], []
        for i, line in enumerate(lines):
            x = self.classes[np.frombuffer(bytes([END] * DEPTH) + line, np.uint8)]
            for at in range(0, len(line), PIECE):
                rows.append(x[at : at + PIECE + DEPTH])
                owner.append(i)
        out = np.zeros(len(lines))
        width = self.go.shape[1]
        go, log = self.go.reshape(-1), self.log.reshape(-1)
        order = np.argsort([-len(r) for r in rows], kind="stable")
        for at in range(0, len(rows), 4096):
            some = order[at : at + 4096]
            table = np.zeros((max(len(rows[i]) for i in some), len(some)), np.int64)
            for k, i in enumerate(some):
                table[: len(rows[i]), k] = rows[i]
            total, state = np.zeros(len(some)), np.zeros(len(some), np.int64)
            for j, column in enumerate(table):
                cell = state * width + column
                if j >= DEPTH:  # the first bytes only lead to the piece's state
                    total += log[cell]
                state = go[cell]
            np.add.at(out, np.array(owner)[some], total)
        return out


@dataclass
class Lists:
    """The same model as sorted lists, some 12 bytes for each next byte of a retained context.

    `windows[d]` are the retained contexts of d bytes with each next byte they have, `log[d]` the log10 probability
    there. Any other next byte has `back[d]` of `contexts[d]` more than after the context without its oldest byte.
    """

    root: np.ndarray
    contexts: list[np.ndarray]
    back: list[np.ndarray]
    windows: list[np.ndarray]
    log: list[np.ndarray]

    def of(self, windows: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of every window, after the longest retained of its contexts."""
        out, left = np.zeros(len(windows)), np.arange(len(windows))
        for d in range(len(self.windows) - 1, 0, -1):
            key = windows[left] & ((1 << 8 * (d + 1)) - 1)
            at, hit = _find(self.windows[d], key)
            out[left[hit]] += self.log[d][at[hit]]
            left, key = left[~hit], key[~hit] >> 8
            at, hit = _find(self.contexts[d], key)
            out[left[hit]] += self.back[d][at[hit]]
        out[left] += self.root[windows[left] & 255]
        return out

    def score(self, lines: list[bytes]) -> np.ndarray:
        """log10 probability of each line, END included."""
        out, held, size = np.zeros(len(lines)), [], 0

        def add():
            code = np.concatenate(held)
            code.sort()
            window = code >> np.uint64(16)
            starts = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
            each = np.repeat(self.of(window[starts].astype(np.int64)), np.diff(np.append(starts, len(code))))
            out[base : base + (1 << 16)] += np.bincount(
                (code & np.uint64(0xFFFF)).astype(np.int64), weights=each, minlength=1 << 16)[: len(lines) - base]

        # A window takes 48 bits and the line's number the other 16.
        for base in range(0, len(lines), 1 << 16):
            for i, line in enumerate(lines[base : base + (1 << 16)]):
                for at in range(0, len(line), COUNTED):
                    lead = line[max(0, at - DEPTH) : at]
                    found = windows(lead + line[at : at + COUNTED])[len(lead) :].astype(np.uint64)
                    held.append((found << np.uint64(16)) | np.uint64(i))
                    size += len(found)
                    if size >= COUNTED:
                        add()
                        held, size = [], 0
            if held:
                add()
                held, size = [], 0
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted values in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _lists(levels: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Lists:
    """Lists from (context, next, n) of each depth, the root's first."""
    empty = np.zeros(0, np.int64)
    model = Lists(np.zeros(0), [empty], [np.zeros(0)], [empty], [np.zeros(0)])
    for depth, (context, following, n) in enumerate(levels):
        order = np.lexsort((following, context))
        context, following, n = (x[order].astype(np.int64) for x in (context, following, n))
        if not depth:
            share = np.full(256, len(n) / 256 if len(n) else 1 / 256)
            share[following] += n
            model.root = np.log10(share / (n.sum() + len(n) if len(n) else 1))
            continue
        window = (context << 8) | following
        starts = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))[: len(context)])
        kinds = np.diff(np.append(starts, len(context)))
        total = np.add.reduceat(n, starts) if len(starts) else empty
        lower = 10 ** model.of(window & ((1 << 8 * depth) - 1))
        k, both = np.repeat(kinds, kinds), np.repeat(total + kinds, kinds)
        model.contexts.append(context[starts])
        model.back.append(np.log10(kinds / (total + kinds)).astype(np.float32))
        model.windows.append(window)
        model.log.append(np.log10((n + k * lower) / both).astype(np.float32))
    return model


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different windows and their counts, from several such lists."""
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], np.concatenate([c for _, c in parts])[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


def count_windows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(window, n) over all rows. A task counts blocks of text in numpy and adds them up; Spark adds the tasks'."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, None

        def add():
            block = np.unique(np.concatenate(held), return_counts=True)
            return block if total is None else _merged([total, block])

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(total[0]), pa.array(total[1])], ["window", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                line = b" ".join(words_of(text)) + bytes([END])
                for at in range(0, len(line), COUNTED):
                    lead = line[max(0, at - DEPTH) : at]
                    found = windows(lead + line[at : at + COUNTED])[len(lead) :]
                    held.append(found)
                    size += len(found)
                    if size >= COUNTED:
                        total, held, size = add(), [], 0
                        if len(total[0]) >= HELD:
                            yield rows()
                            total = None
        if held:
            total = add()
        if total is not None:
            yield rows()

    return docs.select(text_col).mapInArrow(counted, "window bigint, n bigint").groupBy("window").agg(F.sum("n").alias("n"))


def _shorter(depth: int):
    """A context of `depth` bytes without its oldest one."""
    return F.col("context").bitwiseAND((1 << 8 * (depth - 1)) - 1)


def grow(counts: DataFrame, strictness: float = 0.5, max_states: int = 32_000) -> Tree | Lists:
    """Build the tree from (window, n).

    A context is retained if its next-byte distribution diverges from that of its parent (the context without its
    oldest byte): the log-likelihood gain over all its occurrences must exceed `strictness` * ln(N) / 2 for each next
    byte it has, N being all counted bytes. Ancestors of retained contexts stay too. Probabilities are interpolated
    with the parent's by the number of different next bytes. The counts, levels and tests are Spark jobs over all
    windows; every window frame has at most 256 rows, as the oldest byte is all in which siblings differ. All
    passing contexts are retained: up to `max_states` become a table of states, more become lists, which score alike.
    """
    level = materialize(counts.select(
        F.shiftright("window", 8).alias("context"), F.col("window").bitwiseAND(255).cast("int").alias("next"), "n"), "level")
    n = level.agg(F.sum("n").alias("n")).first()["n"] or 0
    levels, kept = {DEPTH: level}, None
    for depth in range(DEPTH, 0, -1):
        siblings = Window.partitionBy("parent", "next")
        rows = level.withColumn("parent", _shorter(depth)).withColumn("parent_n", F.sum("n").over(siblings))
        level = materialize(rows.groupBy("parent", "next").agg(F.sum("n").alias("n")).withColumnRenamed("parent", "context"), "level")
        levels[depth - 1] = level
        each = rows.groupBy("context").agg(
            F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.log(F.col("n") / F.col("parent_n"))).alias("inner"))
        each = each.withColumn("parent_total", F.sum("total").over(Window.partitionBy(_shorter(depth))))
        gain = F.col("inner") - F.col("total") * F.log(F.col("total") / F.col("parent_total"))
        found = each.select(F.lit(depth).alias("depth"), "context", gain.alias("gain")).where(
            F.col("gain") > strictness * 0.5 * math.log(max(n, 2)) * F.col("kinds"))
        kept = found if kept is None else kept.unionByName(found)
    family = materialize(kept.select(F.explode(F.expr("sequence(1, depth)")).alias("depth"), "context").select(
        "depth", F.expr("context & (shiftleft(1L, 8 * depth) - 1)").alias("context")).distinct(), "kept")
    states = family.count()

    def counted(depth: int) -> tuple[np.ndarray, ...]:
        rows = levels[depth]
        if depth:
            own = family.where(F.col("depth") == depth).select("context")
            rows = rows.join(F.broadcast(own) if states <= BROADCAST else own, "context")
        found = rows.select("context", F.col("next").cast("smallint").alias("next"), "n").toArrow()
        return tuple(found[c].to_numpy() for c in ("context", "next", "n"))

    each = map(counted, range(DEPTH + 1))
    if states > max_states:
        return _lists(each)
    each = list(each)
    depths = np.repeat(np.arange(len(each)), [len(x[0]) for x in each])
    return _table(depths, *(np.concatenate(x).astype(np.int64) for x in zip(*each)))


def _table(depth: np.ndarray, context: np.ndarray, following: np.ndarray, n: np.ndarray) -> Tree:
    """The table of states from the next-byte counts of the retained contexts; depth 0 is the root."""
    order = np.lexsort((following, context, depth))
    depth, context, following, n = (x[order] for x in (depth, context, following, n))
    starts = np.flatnonzero(np.concatenate(([True], (depth[1:] != depth[:-1]) | (context[1:] != context[:-1])))[: len(depth)])
    found = {
        int(c).to_bytes(DEPTH, "big")[DEPTH - int(d) :]: slice(a, b)
        for c, d, a, b in zip(context[starts], depth[starts], starts, [*starts[1:], len(depth)])
    }
    seen = np.unique(following)
    classes = np.full(256, len(seen) + 1, np.int64)
    classes[seen] = np.arange(1, len(seen) + 1)
    unseen, width = max(1, 256 - len(seen)), len(seen) + 2
    # The longest retained suffix after one more byte follows from the state alone if every state's context without
    # its newest byte is a state too; such added states predict like their longest retained suffix.
    states = sorted({c[:k] for c in found for k in range(len(c) + 1)} | {b""}, key=lambda c: (len(c), c))
    number = {c: i for i, c in enumerate(states)}
    share, go = np.zeros((len(states), width), np.float64), np.zeros((len(states), width), np.int32)
    share[0, 1:-1], share[0, -1] = 1 / 256, unseen / 256
    for i, own in enumerate(states):
        if own:
            base = own[1:]
            while base not in number:
                base = base[1:]
            share[i] = share[number[base]]
        if own in found:
            at = found[own]
            total, kinds = n[at].sum(), at.stop - at.start
            share[i] *= kinds / (total + kinds)
            share[i, classes[following[at]]] += n[at] / (total + kinds)
    for i, own in enumerate(states):
        if own:
            go[number[own[:-1]], classes[own[-1]]] = i
    # A transition that no longer state takes is that of the longest retained proper suffix.
    for i, own in enumerate(states):
        if own:
            base = own[1:]
            while base not in number:
                base = base[1:]
            row = go[i]
            go[i] = np.where(row > 0, row, go[number[base]])
    share[:, -1] /= unseen
    share[:, 0] = 1
    return Tree(classes, go, np.log10(np.maximum(share, 1e-300)).astype(np.float32))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


_POSTS = "chunk bigint, word binary, train bigint, posts binary"


def _word_posts(docs: DataFrame, tree: Tree | Lists) -> DataFrame:
    """Rows of (chunk, word, train, posts): for every chunk of documents and word, its count in training documents and
    the numbers of the documents it is in, repeated as often as it occurs. One row of each chunk has no word; its
    posts are the chunk's documents: id, tokens and tree score."""
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tree, task, turn = shared.value, TaskContext.get().partitionId(), 0
        numbers, ids, docs_of, train, size = _Numbers(), [], [], [], 0

        def emit():
            sizes = np.array([len(x) for x in ids])
            code = np.concatenate(ids).astype(np.int64)
            code <<= 16
            code |= np.repeat(np.arange(len(ids)), sizes)
            code.sort()
            ends = np.searchsorted(code, np.arange(1, len(numbers) + 1) << 16, "left")
            doc = (code & 0xFFFF).astype("<u2")
            known = np.add.reduceat(np.array(train, np.int64)[doc], np.concatenate(([0], ends[:-1])))
            offsets = np.concatenate(([0], ends * 2)).astype(np.int32)
            lists = pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(offsets), pa.py_buffer(doc.tobytes())])
            table = np.array([(d, n, s) for (d, s), n in zip(docs_of, sizes.tolist())], [("d", "<i8"), ("n", "<i8"), ("s", "<f8")])
            chunk = pa.array(np.full(len(numbers) + 1, (task << 24) + turn, np.int64))
            return pa.RecordBatch.from_arrays([
                chunk, pa.array([*numbers, None], pa.binary()), pa.array(np.append(known, 0)),
                pa.concat_arrays([lists, pa.array([table.tobytes()], pa.binary())])], ["chunk", "word", "train", "posts"])

        for batch in batches:
            rows = [words_of(t) for t in batch.column(1).to_pylist()]
            scores = tree.score([b" ".join(r) + bytes([END]) for r in rows])
            for doc_id, words, flag, score in zip(batch.column(0).to_pylist(), rows, batch.column(2).to_pylist(), scores.tolist()):
                words.append(bytes([END]))
                ids.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                docs_of.append((NO_ID if doc_id is None else doc_id, score))
                train.append(flag)
                size += len(words)
                if size >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                    yield emit()
                    numbers, ids, docs_of, train, size, turn = _Numbers(), [], [], [], 0, turn + 1
        if ids:
            yield emit()

    return docs.select("doc_id", "text", "train").mapInArrow(posts, _POSTS)


_SUMS = "doc_id bigint, n_tokens bigint, n_known bigint, log_sum double, score double"


def _sum_chunk(table: pa.Table) -> pa.Table:
    """Add up one chunk: every document's known tokens and the log10 of its words' counts plus one half."""
    posts, counts = table["posts"].combine_chunks(), table["c"].to_numpy(zero_copy_only=False)
    named = np.flatnonzero(np.isnan(counts.astype(float)))
    docs = np.frombuffer(posts[int(named[0])].as_py(), [("d", "<i8"), ("n", "<i8"), ("s", "<f8")])
    sizes = np.diff(np.frombuffer(posts.buffers()[1], np.int32)[posts.offset : posts.offset + len(posts) + 1]) // 2
    words = np.delete(np.arange(len(posts)), named)
    doc = np.frombuffer(b"".join(posts.take(pa.array(words)).to_pylist()), "<u2")
    c = np.repeat(counts[words].astype(float), sizes[words])
    ids = pa.array(docs["d"].copy(), mask=docs["d"] == NO_ID)
    return pa.table({
        "doc_id": ids, "n_tokens": docs["n"].copy(),
        "n_known": np.bincount(doc, weights=c > 0, minlength=len(docs)).astype(np.int64),
        "log_sum": np.bincount(doc, weights=np.log10(c + 0.5), minlength=len(docs)), "score": docs["s"].copy()})


def score_documents(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", strictness: float = 0.5, max_states: int = 32_000) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row, learned from rows where `train` holds.

    Tokens are the text's words and one end. base_score adds log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens; c
    is a token's count, N the number and V the number of different tokens in training rows, exact over all of them.
    score is the tree's log10 probability of the same tokens, spelled with one space between words and END.

    Two passes read the texts: one counts the tree's windows, one scores them and lists each chunk's words with the
    documents they are in. Texts are never shuffled; a word is counted once per chunk before the shuffle, joined with
    its total by an ordinary join that Spark may split, and a chunk's rows are brought together again, bounded by the
    chunk. Null and empty texts are the end token alone. Without training rows every count is 0 and the tree is uniform.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    tree = grow(count_windows(rows.where("train")), strictness, max_states)
    posts = materialize(_word_posts(rows, tree), "posts")
    totals = posts.where("word is not null").groupBy("word").agg(F.sum("train").alias("c"))
    size = materialize(totals.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")), "size").first()
    joined = posts.join(totals, "word", "left").select("chunk", "c", "posts")
    sums = joined.groupBy("chunk").applyInArrow(_sum_chunk, _SUMS)
    whole = math.log10(size["n"] + 0.5 * (size["v"] + 1))
    return sums.select(
        "doc_id", "n_tokens", "n_known", F.lit(size["n"]).cast("bigint").alias("train_tokens"),
        (F.col("log_sum") - F.col("n_tokens") * F.lit(whole)).alias("base_score"), "score")
