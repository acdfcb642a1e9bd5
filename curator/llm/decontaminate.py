"""Find and remove benchmark passages: a broadcast set of benchmark windows scanned over whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curator.llm.common import free_name, materialize, narrow

WINDOW = 13
#: Benchmark text that one broadcast set may hold. A larger benchmark is scanned in several blocks of this size.
BLOCK_BYTES = 8 << 20

#: After ASCII lower-casing, words are runs of a-z, 0-9 and anything outside ASCII.
_SPACED = bytes(b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else 0x20 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so multiplying is a permutation of 64-bit values


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACED).split()


class WindowSet:
    """All windows of some benchmark items.

    Words are numbered; windows are kept by length as sorted 64-bit hashes, each with its place in the numbered texts
    for the exact check that follows a hash hit, and the item it comes from.
    """

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.items: list[str] = []
        flat, places = [], {}
        at = 0
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            k = min(window, len(ids))
            owner = len(self.items)
            self.items.append("" if item_id is None else str(item_id))
            places.setdefault(k, []).append((np.arange(at, at + len(ids) - k + 1), owner))
            flat.append(np.array(ids, np.int64))
            at += len(ids)
        self.flat = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        self.codes = np.random.default_rng(13).integers(1, 1 << 63, len(self.vocab) + 1).astype(np.uint64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, found in places.items():
            starts = np.concatenate([s for s, _ in found])
            owners = np.concatenate([np.full(len(s), o) for s, o in found])
            hashes = self._hashes(self.flat, starts, k)
            order = np.argsort(hashes, kind="stable")
            self.by_length[k] = (hashes[order], starts[order], owners[order])

    def _hashes(self, ids: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for j in range(k):
            out = out * _MULTIPLIER + self.codes[ids[starts + j]]
        return out ^ (out >> np.uint64(29))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Merged (start, end) ranges of hit words, and the ids of the items that occur."""
        if not self.by_length or len(words) < min(self.by_length):
            return [], []
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.int64, len(words))
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        hit, owners = None, set()
        for k, (hashes, places, items) in self.by_length.items():
            starts = np.flatnonzero(unknown[k:] == unknown[: len(unknown) - k]) if len(words) >= k else ()
            if not len(starts):
                continue
            found = self._hashes(ids, starts, k)
            left, right = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
            for i in np.flatnonzero(right > left).tolist():
                at = int(starts[i])
                for j in range(int(left[i]), int(right[i])):
                    if np.array_equal(self.flat[places[j] : places[j] + k], ids[at : at + k]):
                        owners.add(int(items[j]))
                        if hit is None:
                            hit = np.zeros(len(words) + 2, np.int8)
                        hit[at + 1 : at + k + 1] = 1
        if hit is None:
            return [], []
        turns = np.flatnonzero(np.diff(hit)).tolist()
        return list(zip(turns[::2], turns[1::2])), sorted({self.items[o] for o in owners})


_FOUND = "struct<n_words:bigint,spans:array<struct<a:bigint,b:bigint>>,items:array<string>>"


def _scanner(sets) -> object:
    @F.arrow_udf(_FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows, kind = sets.value, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            counts, spans, items = [], [], []
            for text in batch.to_pylist():
                words = words_of(text)
                a, b = windows.scan(words)
                counts.append(len(words))
                spans.append([{"a": x, "b": y} for x, y in a])
                items.append(b)
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))],
                ["n_words", "spans", "items"])

    return scan


def _covered(spans: Column) -> Column:
    """Words in the union of spans sorted by their start."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    add = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"),
        F.greatest(acc["end"], s["b"]).alias("end"))
    return F.aggregate(spans, zero, add, lambda acc: acc["n"])


def _window_sets(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[object]:
    """One broadcast set for each block of the benchmark; each block's size is known before it is collected."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield spark.sparkContext.broadcast(WindowSet([(r["item"], r["text"]) for r in block.collect()], window))


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every row: words inside any occurrence of a benchmark window, and its items.

    A window is `window` consecutive words of an item, or the whole item if it is shorter. A benchmark of at most
    `block_bytes` of text is one broadcast set and one scan without a shuffle. A larger one is scanned block by
    block, and the hits of each (id, text) are merged. Null and blank texts have no words; items without words have
    no window; a null item id counts as the item ''. Repeated rows give repeated result rows.
    """
    sets = list(_window_sets(benchmark, item_col, item_text_col, window, block_bytes))
    return _matches(narrow(docs, id_col, text_col), sets).drop("key")


def _matches(rows: DataFrame, sets: list) -> DataFrame:
    keyed = rows.withColumn("key", F.xxhash64("text"))
    if len(sets) == 1:
        found = keyed.select("doc_id", "key", _scanner(sets[0])("text").alias("f"))
        return found.select("doc_id", "key", "f.n_words", _covered(F.col("f.spans")).alias("n_hit"), "f.items")
    hits = None
    for one in sets:
        f = keyed.select("doc_id", "key", _scanner(one)("text").alias("f")).where("size(f.items) > 0")
        part = materialize(f.select("doc_id", "key", "f.spans", "f.items").dropDuplicates(["doc_id", "key"]), "hits")
        hits = part if hits is None else hits.union(part)
    hits = hits.groupBy("doc_id", "key").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    counted = keyed.select("doc_id", "key", _scanner(sets[0])("text")["n_words"].alias("n_words")).alias("d")
    same = (F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))) & (F.col("d.key") == F.col("h.key"))
    return counted.join(hits.alias("h"), same, "left").select(
        "d.doc_id", "d.key", "n_words", F.coalesce(_covered(F.col("spans")), F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    """A twentieth of the words or more, and at least one, is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`docs` without the contaminated rows; all columns stay. One block of benchmark text: a filter over the scan,
    no shuffle. Several blocks: an anti join with the rows whose merged hits contaminate them."""
    sets = list(_window_sets(benchmark, item_col, item_text_col, window, block_bytes))
    if len(sets) == 1:
        name = free_name(docs, "found")
        scanned = docs.withColumn(name, _scanner(sets[0])(F.col(text_col)))
        bad = is_contaminated(F.col(name)["n_words"], _covered(F.col(name)["spans"]))
        return scanned.where(~bad).drop(name)
    bad = _matches(narrow(docs, id_col, text_col), sets).where(is_contaminated(F.col("n_words"), F.col("n_hit")))
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key"))
    same = docs[id_col].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs[text_col]) == bad["bad_key"])
    return docs.join(bad, same, "left_anti")


def excise(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`docs` with every benchmark passage cut out of `text_col`, from its first word to its last; other texts stay.

    With several blocks of benchmark text the passages of all blocks are found in the whole texts first and cut once, so
    the blocks' size changes nothing. Null texts stay null; repeated rows are cut alike.
    """
    sets = list(_window_sets(benchmark, item_col, item_text_col, window, block_bytes))
    name = free_name(docs, "spans")
    if len(sets) == 1:
        spans = _scanner(sets[0])(F.col(text_col))["spans"]
        return docs.withColumn(name, spans).withColumn(text_col, _cutter(F.col(text_col), F.col(name))).drop(name)
    key = F.sha2(F.col(text_col), 256)
    found = None
    for one in sets:
        part = docs.select(key.alias("excise_key"), _scanner(one)(F.col(text_col)).alias("f")).where("size(f.spans) > 0")
        part = materialize(part.select("excise_key", "f.spans").dropDuplicates(["excise_key"]), "passages")
        found = part if found is None else found.union(part)
    found = found.groupBy("excise_key").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias(name))
    joined = docs.join(found, key == F.col("excise_key"), "left").drop("excise_key")
    return joined.withColumn(text_col, _cutter(F.col(text_col), F.col(name))).drop(name)


def _cutter(text: Column, spans: Column) -> Column:
    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = [_cut(t, [(s["a"], s["b"]) for s in own or ()]) for t, own in zip(texts.to_pylist(), spans.to_pylist())]
        return pa.array(out, pa.string())

    return cut(text, spans)


def _cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans, which are sorted by their start and may overlap."""
    if not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw.lower())]
    kept, at, end = [], 0, -1
    for a, b in spans:
        if a > end:
            kept.append(raw[at : places[a][0]])
        end = max(end, b)
        at = places[end - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")
