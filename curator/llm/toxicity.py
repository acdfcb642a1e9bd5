"""Toxicity by a classifier chain over linear models, trained with out-of-fold predictions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curator.llm import linear
from curator.llm.common import materialize, narrow, rows_of_ids, sample_rows

#: Lengths of the grams in bytes; codes of different lengths can't be equal.
GRAMS = (5, 7)
#: Bytes whose grams are looked up at once.
BLOCK = 1 << 18
#: ASCII that is not a letter separates words.
_SPACED = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))

#: The chain's order. `toxic` is the label; the two before it are what labelled toxic rows show of it: many different
#: marks, and many marks for their length (at or above the median of toxic rows).
CATEGORIES = ("broad", "dense", "toxic")


def grams(text: str | None) -> Iterator[np.ndarray]:
    """The exact codes of the text's 5- and 7-byte grams, lower-cased, words apart by one space, block by block."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED)
    raw = b" ".join([b"", *raw.split(), b""])
    for at in range(0, len(raw), BLOCK):
        x = np.frombuffer(raw[at : at + BLOCK + GRAMS[-1] - 1], np.uint8).astype(np.uint64)
        own = min(BLOCK, len(raw) - at)
        code, parts = np.zeros(len(x), np.uint64), []
        for k in range(1, GRAMS[-1] + 1):
            n = len(x) - k + 1
            if n < 1:
                break
            code = (code[:n] << np.uint64(8)) | x[k - 1 :]
            if k in GRAMS:
                parts.append(code[:own])
        if parts:
            yield np.concatenate(parts)


@dataclass
class Marks:
    """The grams that tell toxic rows from clean ones, sorted, and a table that most other grams fail at once."""

    codes: np.ndarray

    def __post_init__(self):
        self.codes = np.sort(self.codes.astype(np.uint64))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self._slot(self.codes)] = True

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)

    def features(self, text: str | None) -> np.ndarray:
        """Of every mark how often it occurs in a thousand grams, then how many different ones occur and how often any
        does, all as logarithms: a long text holds some marks by chance."""
        counts, n = np.zeros(len(self.codes), np.int64), 0
        for block in grams(text):
            n += len(block)
            block = block[self.maybe[self._slot(block)]]
            if len(block) and len(self.codes):
                at = np.minimum(np.searchsorted(self.codes, block), len(self.codes) - 1)
                counts += np.bincount(at[self.codes[at] == block], minlength=len(self.codes))
        rate = 1000 / max(n, 1)
        return np.log1p([*(counts * rate), (counts > 0).sum(), counts.sum() * rate]).astype(np.float32)


@dataclass
class Chain:
    """One linear model per category, each fed the probabilities of the earlier ones."""

    marks: Marks
    weights: list[np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0), np.float64)
        for w in self.weights:
            out = np.hstack([out, linear.predict(np.hstack([x, out]), w)[:, None]])
        return out


def fit_chain(x: np.ndarray, y: np.ndarray, weight: np.ndarray, folds: int = 5) -> list[np.ndarray]:
    """Fit the models of the columns of `y` in order.

    A later model trains on out-of-fold probabilities of the earlier categories, so it sees the errors that they make
    on rows they weren't fitted on; the models that predict are fitted on all rows.
    """
    # Equal rows share a fold, so none is predicted by a model that was fitted on its copy.
    fold = np.array([zlib.crc32(np.ascontiguousarray(row).tobytes()) % folds for row in x])
    models, earlier = [], np.zeros((len(x), 0), x.dtype)
    for c in range(y.shape[1]):
        z = np.hstack([x, earlier])
        models.append(linear.fit_logistic(z, y[:, c], weight))
        if c + 1 < y.shape[1]:
            out = np.zeros(len(x))
            for f in range(folds):
                own = fold == f
                if own.all():
                    out = linear.predict(z, models[-1])
                elif own.any():
                    out[own] = linear.predict(z[own], linear.fit_logistic(z[~own], y[~own, c], weight[~own]))
            earlier = np.hstack([earlier, out[:, None].astype(x.dtype)])
    return models


def _find_marks(texts: DataFrame, toxic: int, clean: int, n_marks: int) -> Marks:
    """Grams that at least three toxic rows hold and that are four times as frequent among them, best first by the
    log-likelihood ratio of the two shares."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = {0: [], 1: []}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by[y].append(np.unique(np.concatenate([np.unique(b) for b in grams(text)] or [np.zeros(0, np.uint64)])))
            for y, found in by.items():
                if found:
                    codes, n = np.unique(np.concatenate(found), return_counts=True)
                    zero = np.zeros(len(n), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(codes.astype(np.int64)), pa.array(n if y else zero), pa.array(zero if y else n)], ["code", "bad", "good"])

    held = texts.mapInArrow(counted, "code bigint, bad bigint, good bigint").groupBy("code").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad >= 3")
    p, q = (F.col("bad") + 0.5) / (toxic + 1), (F.col("good") + 0.5) / (clean + 1)
    best = held.where(p > 4 * q).orderBy((F.col("bad") * F.log(p / q)).desc(), "code").limit(n_marks)
    return Marks(np.array([r["code"] for r in best.select("code").collect()], np.uint64))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    per_class: int = 3000, n_marks: int = 512, rows_per_id: int = 4,
) -> Chain | None:
    """Learn from the labelled rows; None if they don't have both classes.

    The classifier is fitted on about `per_class` ids of each class with at most `rows_per_id` rows each, a documented bound:
    their ids are broadcast, so only texts of the sample are shuffled. Several labels of one id count as their maximum; rows
    without an id have no label, repeated rows of an id count `rows_per_id` times at most. Sample weights restore the
    classes' shares among all labelled rows.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(
        (F.max(label_col) > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if set(sizes) != {0, 1}:
        return None
    chosen = F.broadcast(sample_rows(known, ["label_id"], "y", per_class))
    rows = narrow(docs, id_col, text_col).join(chosen, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y")
    rows = materialize(rows_of_ids(rows, "doc_id", rows_per_id).select("text", "y"), "toxicity-sample")
    n = {y: min(sizes[y], per_class) for y in sizes}
    marks = _find_marks(rows, n[1], n[0], n_marks)

    @F.arrow_udf("binary")
    def vector(texts: pa.Array) -> pa.Array:
        return pa.array([marks.features(t).tobytes() for t in texts.to_pylist()], pa.binary())

    found = sorted(rows.select("y", vector("text").alias("v")).collect(), key=lambda r: (bytes(r["v"]), r["y"]))
    y = np.array([r["y"] for r in found])
    if len({*y.tolist()}) < 2:
        return None
    x = np.stack([np.frombuffer(r["v"], np.float32) for r in found])
    bad = y == 1
    wide, thick = x[:, -2], x[:, -1]
    categories = np.stack([bad & (wide >= np.median(wide[bad])), bad & (thick >= np.median(thick[bad])), bad], axis=1)
    weight = np.where(bad, sizes[1] / bad.sum(), sizes[0] / (~bad).sum())
    return Chain(marks, fit_chain(x, categories.astype(float), weight))


def scorer(chain: Chain | None, threshold: float = 0.5):
    """A column function: text -> struct(broad, dense, toxic probabilities, predicted). Null and empty texts are
    scored as texts without marks. Without a chain every probability is 0."""

    @F.arrow_udf("struct<broad:double,dense:double,toxic:double,predicted:int>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            if chain is None or not texts:
                p = np.zeros((len(texts), len(CATEGORIES)))
            else:
                p = chain.probabilities(np.stack([chain.marks.features(t) for t in texts]).astype(np.float64))
            yield pa.StructArray.from_arrays(
                [*(pa.array(np.ascontiguousarray(p[:, i])) for i in range(p.shape[1])), pa.array((p[:, -1] >= threshold).astype(np.int32))],
                [*CATEGORIES, "predicted"])

    return of
