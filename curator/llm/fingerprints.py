"""MinHash fingerprints of whole texts, of edited texts, and near duplicates by signature bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curator.llm.common import in_order, materialize, narrow, partitions

WORDS = 5
HASHES = 128
#: Shingles that are permuted at once.
BLOCK = 1 << 11
#: Bands of ROWS values each: a pair of likeness 0.8 shares a band with probability 0.99995.
ROWS, BANDS = 5, 25

_random = np.random.default_rng(20_240_501)
#: One permutation x -> a x + b of 32-bit values per row; an odd factor makes each a permutation.
_A = (_random.integers(0, 1 << 31, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32)[:, None]
_B = _random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the text's word shingles (ASCII lower-cased, cut at ASCII white space). A text of
    fewer words is one shingle; null and blank texts have none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    x = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    k = min(words, len(parts))
    out = np.zeros(len(parts) - k + 1, np.uint64)
    for j in range(k):
        out = out * _STEP + x[j : j + len(out)]
    out ^= out >> np.uint64(31)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of every permutation, reduced to 16 bits; all 65535 without shingles."""
    if not len(hashes):
        return np.full(HASHES, 0xFFFF, np.uint16)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), BLOCK):
        np.minimum(least, (_A * x[None, at : at + BLOCK] + _B).min(axis=1), out=least)
    return (least >> np.uint32(3)).astype(np.uint16)


def fingerprint(text: str | None) -> np.ndarray:
    return signature(shingles(text))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal values: estimates the Jaccard similarity of the shingle sets."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last quarter of the code points (rounded down) replaced by the first as many of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_ROW = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next document.

    Next means ascending id, after the last the first. One shuffle places whole texts into ranges of ids; each range
    also gets the first document of the following range, so a task that sorts its ranges and reads them in order knows
    every next text. Those extra rows are one per range. Null texts count as empty. Rows of one id follow each other
    by a hash of their texts; null ids come first. A single row is its own next.
    """
    spark = docs.sparkSession
    rows, bounds = in_order(narrow(docs, id_col, text_col), buckets or 2 * partitions(spark))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    # The first row of each range, by id and tie: as many rows as ranges, without texts.
    order = F.struct(F.col("doc_id").isNotNull().alias("some"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "tie")
    heads = sorted((r["bucket"], tuple(r["head"])) for r in rows.groupBy("bucket").agg(F.min(order).alias("head")).collect())
    if not heads:
        return spark.createDataFrame([], _ROW)
    known = [(bucket, *head, heads[i - 1][0]) for i, (bucket, head) in enumerate(heads)]
    known = spark.createDataFrame(known, "bucket int, head_some boolean, head_id bigint, head_tie bigint, before int")
    rows = rows.join(F.broadcast(known), "bucket")  # one row per range
    is_head = order == F.struct(F.col("head_some").alias("some"), F.col("head_id").alias("doc_id"), F.col("head_tie").alias("tie"))
    own = F.struct(F.col("bucket"), F.lit(0).alias("after"))
    before = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("after"))
    placed = rows.select("doc_id", "text", "tie", F.explode(F.when(is_head, F.array(own, before)).otherwise(F.array(own))).alias("p"))
    placed = placed.select("doc_id", "text", "tie", "p.bucket", "p.after").repartition(partitions(spark), "bucket")
    ordered = placed.sortWithinPartitions("bucket", "after", "doc_id", "tie").select("bucket", "after", "doc_id", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # bucket, doc_id, text and fingerprint of a row whose next row hasn't come yet
        for batch in batches:
            out = []
            for bucket, after, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                text = text or ""
                if after and (last is None or last[0] != bucket):
                    continue  # a repeated row of the head
                now = fingerprint(text)
                if last is not None and last[0] == bucket:
                    out.append(_compare(*last[1:], text, now))
                last = None if after else (bucket, doc_id, text, now)
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split(" ")[0] for f in _ROW.split(", ")])

    return ordered.mapInArrow(walk, _ROW)


def _compare(doc_id: int | None, text: str, own: np.ndarray, following: str, next_one: np.ndarray) -> tuple:
    changed = edited(text, following)
    other = fingerprint(changed)
    return (
        doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        own.astype(">u2").tobytes().hex(), other.astype(">u2").tobytes().hex(), likeness(own, other), likeness(own, next_one))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Classes of equal shingle sets, and all found pairs of classes of Jaccard similarity `threshold` or more.

    Returns members (doc_id, class_id) of every row, class_id being the least id of the class, and pairs (a, b,
    jaccard) of class ids, a < b. Classes, not rows, are indexed, so copies cost one entry. Signatures are cut into
    bands; classes that share a band are joined on (band, hash of the band) — a plain equality join, which Spark may
    split where many classes share one — and each pair is kept at its first common band and verified on the shingles
    themselves. Texts without shingles are one class without links. A pair just at the threshold shares a band with
    probability 0.99995. Rows with a null id are left out of both results, as they can't be named; an id with several
    texts is a member of the class of each.
    """

    @F.arrow_udf("struct<set_hash:bigint,bands:array<bigint>,hashes:array<bigint>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            marks, bands, sets = [], [], []
            for text in batch.to_pylist():
                hashes = shingles(text, words)
                sig = signature(hashes)[: ROWS * BANDS].reshape(BANDS, ROWS)
                marks.append(xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63))
                bands.append([xxhash.xxh64_intdigest(b.tobytes()) - (1 << 63) for b in sig] if len(hashes) else [])
                sets.append(hashes.view(np.int64).tolist())
            longs = pa.list_(pa.int64())
            yield pa.StructArray.from_arrays([pa.array(marks, pa.int64()), pa.array(bands, longs), pa.array(sets, longs)], ["set_hash", "bands", "hashes"])

    rows = narrow(docs, id_col, text_col).where("doc_id is not null")
    found = materialize(rows.select("doc_id", of("text").alias("f")).select("doc_id", "f.*"), "shingles")
    names = found.groupBy("set_hash").agg(F.min("doc_id").alias("class_id"))
    members = found.select("doc_id", "set_hash").join(names, "set_hash").select("doc_id", "class_id")
    classes = materialize(found.join(names, [found.set_hash == names.set_hash, found.doc_id == names.class_id], "left_semi").dropDuplicates(["set_hash"]), "classes")
    index = classes.select("doc_id", "bands", F.posexplode("bands").alias("band", "key"))
    a, b = index.alias("a"), index.alias("b")
    same = (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.doc_id") < F.col("b.doc_id"))
    first = F.array_position(F.zip_with("a.bands", "b.bands", lambda x, y: x == y), True) == F.col("a.band") + 1
    pairs = a.join(b, same & first).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"))
    left, right = (classes.select(F.col("doc_id").alias(k), F.col("hashes").alias(f"h{k}")) for k in "ab")
    both = F.size(F.array_intersect("ha", "hb"))
    verified = pairs.join(left, "a").join(right, "b").select(
        "a", "b", (both / (F.size("ha") + F.size("hb") - both)).alias("jaccard")).where(F.col("jaccard") >= threshold)
    return members, verified
