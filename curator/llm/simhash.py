"""SimHash fingerprints and exact linking of near fingerprints by one-wildcard segment signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curator.llm.common import by_number, materialize, narrow, partitions, shuffled
from curator.llm.components import connected

BITS = 64
SEED = 42
#: Shingles whose bits are counted at once, which bounds the memory of a very long text.
BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit SimHash of one text.

    ASCII letters are lowered, words are runs of anything but ASCII white space, shingles are `words` consecutive
    words with repeats; a shorter text is one shingle. A bit is set if over half the shingle hashes have it.
    Null, empty and blank texts have fingerprint 0.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(parts) - words + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : min(n, at + BLOCK)].tolist(), ends[at + words - 1 : at + BLOCK + words - 1].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, bits): the fingerprint of every row's whole text as a signed long. No shuffle."""

    @F.arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint(x, words) for x in batch.to_pylist()], "u8").view("i8"))

    return narrow(docs, id_col, text_col).select("doc_id", of("text").alias("bits"))


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one always differs by at most one bit."""
    n = distance // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(nodes: DataFrame, distance: int = 4, crowd: int = 256) -> DataFrame:
    """Edges (a, b) between different fingerprints of `nodes` (bits), whose components are exact.

    Every fingerprint is indexed once per bit: its segment with that bit deleted. Two fingerprints within `distance`
    bits have a segment that differs by at most one bit, so they meet in at least one variant; pairs are formed by an
    equality join and verified by their Hamming distance.

    A variant held by over `crowd` fingerprints (a large group of near copies) would give pairs that grow with the
    square of the group. All its members are then linked through balls instead: two fingerprints are within
    2r bits exactly if some 64-bit value is within r bits of both, so each member is listed under all values within
    r = distance / 2 bits, and each value links its members to the least one. No pair is formed, none is lost: a pair
    that shares a crowded variant has both ends listed, any other pair has an uncrowded variant only.
    """
    if distance % 2:
        raise ValueError("the ball rule for crowded variants needs an even distance")
    cuts = segments(distance)
    spans = [((1 << width) - 1) << at for at, width in cuts]
    slots = [(seg, spans[seg] & ~(1 << bit)) for seg, (at, width) in enumerate(cuts) for bit in range(at, at + width)]
    variants = F.array(*[
        F.struct(F.lit(i).cast("tinyint").alias("slot"), F.lit(_signed(keep)).alias("keep")) for i, (_, keep) in enumerate(slots)
    ])
    spread = nodes.select("bits").repartition(partitions(nodes.sparkSession))
    index = spread.select("bits", F.explode(variants).alias("v")).select(
        F.col("v.slot").alias("slot"), F.col("bits").bitwiseAND(F.col("v.keep")).alias("part"), "bits")
    key = ["slot", "part"]
    full = materialize(index.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > crowd).select(key), "crowds")
    some = full.count()
    sparse = index.join(by_number(full, some), key, "left_anti") if some else index
    # Spark sizes the index like the nodes, of which it has 64 rows each: it must not be broadcast.
    a, b = sparse.alias("a"), shuffled(sparse).alias("b")
    met = (F.col("a.slot") == F.col("b.slot")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.bits") < F.col("b.bits"))
    near = _near_here(F.col("a.slot"), F.col("a.bits").bitwiseXOR(F.col("b.bits")), spans, slots, distance)
    pairs = a.join(b, met & near).select(F.col("a.bits").alias("a"), F.col("b.bits").alias("b"))
    if not some:
        return pairs
    near_values = [_signed(sum(1 << i for i in c)) for r in range(distance // 2 + 1) for c in combinations(range(BITS), r)]
    balls = index.join(by_number(full, some), key, "left_semi").select("bits").distinct().repartition("bits").select(
        "bits", F.explode(F.array(*[F.lit(x) for x in near_values])).alias("x")
    ).select("bits", F.col("bits").bitwiseXOR(F.col("x")).alias("centre"))
    # A ball holds at most len(near_values) fingerprints, so a window over one is bounded.
    stars = balls.select(F.col("bits").alias("a"), F.min("bits").over(Window.partitionBy("centre")).alias("b"))
    return pairs.union(stars.where("a <> b").distinct())


def _near_here(slot: Column, x: Column, spans: list[int], slots: list[tuple[int, int]], distance: int) -> Column:
    """Values that differ by `x` are within `distance` bits, and `slot` is the first variant that they share: each
    pair comes once."""
    differ = [F.bit_count(x.bitwiseAND(F.lit(_signed(span)))) for span in spans]
    first = F.lit(False)
    for seg in range(len(spans)):
        own = [i for i, (s, _) in enumerate(slots) if s == seg]
        here = slot.between(own[0], own[-1]) & ((differ[seg] == 1) | (slot == own[0]))
        for earlier in differ[:seg]:
            here = here & (earlier > 1)
        first = first | here
    return (F.bit_count(x) <= distance) & first


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, crowd: int = 256
) -> DataFrame:
    """(doc_id, bits, component_id) of every row: components of fingerprints linked at `distance` or fewer bits.

    component_id is the smallest doc_id of the component. Rows with equal fingerprints are one node, so thousands of
    copies cost one index entry. Null and empty texts have fingerprint 0 and link like any other. Repeated rows give
    repeated result rows; a null id is carried along and is never a component's name unless all its ids are null.
    An empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, words), "simhash")
    nodes = materialize(rows.groupBy("bits").agg(F.min("doc_id").alias("first")), "nodes")
    found = connected(links(nodes.select("bits"), distance, crowd)).withColumnRenamed("node", "bits")
    labels = nodes.join(shuffled(found), "bits", "left").select("bits", "first", F.coalesce("root", "bits").alias("root"))
    named = labels.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = labels.join(shuffled(named), "root").select("bits", "component_id")
    return rows.join(shuffled(labels), "bits").select("doc_id", "bits", "component_id")
