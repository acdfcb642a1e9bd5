"""Language identification: several clustered TF-IDF centroids per language, cosine, distance-based rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curator.llm.common import materialize, remainder, sample_rows

UNKNOWN = "und"
BUCKETS_BITS = 12
BUCKETS = 1 << BUCKETS_BITS
LENGTHS = 40
#: Where the sample has too few texts of a length, a text is accepted down to SHARE of the similarity that
#: all but LOWEST of the sample's cut pieces of that length reach.
SHARE, LOWEST = 0.75, 0.02
#: Bytes whose n-grams are counted at once.
BLOCK = 1 << 18

_LETTER = regex.compile(r"\p{L}")
#: ASCII that is not a letter separates words.
_SPACED = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def gram_counts(text: str | None) -> np.ndarray:
    """Counts of the text's 1-, 2- and 3-byte grams, lower-cased, by hash bucket."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED)
    raw = b" ".join([b"", *raw.split(), b""])
    out = np.zeros(BUCKETS, np.int64)
    shift = np.uint32(32 - BUCKETS_BITS)
    for at in range(0, len(raw), BLOCK):
        x = np.frombuffer(raw[at : at + BLOCK + 2], np.uint8).astype(np.uint32)
        two = x[:-1] * np.uint32(257) + x[1:]
        three = two[:-1] * np.uint32(263) + x[2:]
        n = min(BLOCK, len(raw) - at)
        for grams, salt in ((x, 0x9E3779B1), (two, 0x85EBCA77), (three, 0xC2B2AE3D)):
            out += np.bincount((grams[:n] * np.uint32(salt)) >> shift, minlength=BUCKETS)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def cluster(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means over unit rows: farthest-first seeds, at most `k` unit centroids. Deterministic."""
    seeds = [int(np.argmax(x @ unit(x.mean(axis=0))))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(axis=1))))
    centres = x[seeds]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        centres = unit(np.stack([x[nearest == j].mean(axis=0) if (nearest == j).any() else centres[j] for j in range(len(centres))]))
    return centres


@dataclass
class Centroids:
    """Unit centroids, the language of each, the idf of every bucket, and the least accepted similarity per language
    and length (a text's n-grams, as a power of two): short texts resemble any centroid less."""

    idf: np.ndarray
    centres: np.ndarray
    owner: np.ndarray
    langs: list[str] = field(default_factory=list)
    least: np.ndarray = field(default_factory=lambda: np.zeros((0, LENGTHS)))

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts).astype(np.float32) * self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine similarity and rejection of each text."""
        known = np.array([bool(t) and _LETTER.search(t) is not None for t in texts], bool)
        score, best, least = np.zeros(len(texts)), np.full(len(texts), -1), np.full(len(texts), 2.0)
        rows = np.flatnonzero(known)
        if len(self.langs):
            for at in range(0, len(rows), 64):
                some = rows[at : at + 64]
                counts = np.stack([gram_counts(texts[i]) for i in some.tolist()])
                like = self.vectors(counts) @ self.centres.T
                pick = like.argmax(axis=1)
                best[some], score[some] = self.owner[pick], np.clip(like[np.arange(len(some)), pick], 0, 1)
                least[some] = self.least[best[some], _length(counts)]
        names = [self.langs[b] if b >= 0 else UNKNOWN for b in best.tolist()]
        return names, score, score < least


def _length(counts: np.ndarray) -> np.ndarray:
    return np.log2(counts.sum(axis=-1) + 1).astype(np.int64).clip(0, LENGTHS - 1)


def pieces(text: str | None) -> Iterator[str]:
    """Starts of the text of rising length, one for each power of two of n-grams below its own."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    for power in range(2, LENGTHS):
        size = round(1.4 * 2**power / 3)  # each byte starts three n-grams
        if size >= len(raw):
            return
        yield raw[:size].decode("utf-8", "ignore")


def _accepted(similarity: np.ndarray, length: np.ndarray, slack: float) -> tuple[np.ndarray, int]:
    """By length: `slack` times the least similarity of all sample texts that are as long or longer; and the length
    of the sample's shortest twentieth, below which that says nothing."""
    out, start = np.zeros(LENGTHS), int(np.quantile(length, 0.05))
    for at in range(start, LENGTHS):
        longer = similarity[length >= at]
        out[at] = slack * longer.min() if len(longer) else out[at - 1]
    return out, start


def _short(out: np.ndarray, start: int, similarity: np.ndarray, length: np.ndarray) -> None:
    """Fill the limits of lengths below `start` from cut pieces of sample texts."""
    for at in range(start):
        own = similarity[length == at]
        out[at] = SHARE * np.quantile(own, LOWEST) if len(own) else out[at - 1] if at else 0


def fit(
    docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = 500,
    clusters: int = 4, slack: float = 0.25,
) -> Centroids:
    """Learn from the rows of `docs` with a language.

    Document frequencies are counted over all rows. The centroids come from about `per_language` different rows of each
    language (a documented bound), which one task clusters; `clusters` centroids per language come to the driver. Rows that share
    an id or have none are different rows if their texts differ. A language accepts texts down
    to `slack` times the least similarity of its own sample texts of that length or more, and texts shorter than nearly
    all of those down to a limit that starts of the sample texts give; what lies farther from all centroids is rejected.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += gram_counts(text) > 0
                n += 1
        slots = np.append(np.flatnonzero(seen), BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.append(seen[slots[:-1]], n))], ["slot", "n"])

    counted = rows.select("text").mapInArrow(frequencies, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    df = np.zeros(BUCKETS + 1)
    for r in counted.collect():
        df[r["slot"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + np.float32(0.1)

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([gram_counts(t).astype("<f4").tobytes() for t in texts.to_pylist()], pa.binary())

    sample = materialize(sample_rows(rows, ["doc_id", "text"], "lang", per_language), "language-sample")
    model = Centroids(idf, np.zeros((0, BUCKETS), np.float32), np.zeros(0, np.int64))

    def clustered(key: tuple, table: pa.Table) -> pa.Table:
        """The centroids of one language and the limits of its longer texts; the rows are its sample."""
        counts = np.stack([np.frombuffer(v, "<f4") for v in sorted(table["v"].to_pylist())])
        x = model.vectors(counts)
        own = cluster(x, clusters)
        least, start = _accepted((x @ own.T).max(axis=1), _length(counts), slack)
        return pa.table({
            "lang": [key[0].as_py()], "centres": [own.astype("<f4").tobytes()], "least": [least.tolist()], "start": [start]},
            schema=pa.schema([("lang", pa.string()), ("centres", pa.binary()), ("least", pa.list_(pa.float64())), ("start", pa.int32())]))

    # A few vectors for each language come to the driver, the sample's own stay in the tasks.
    learned = sample.select("lang", packed("text").alias("v")).groupBy("lang").applyInArrow(
        clustered, "lang string, centres binary, least array<double>, start int").collect()
    centres, owner, sims = [], [], []
    for r in sorted(learned, key=lambda r: r["lang"]):
        own = np.frombuffer(r["centres"], "<f4").reshape(-1, BUCKETS)
        sims.append((np.array(r["least"]), r["start"]))
        owner += [len(model.langs)] * len(own)
        centres.append(own)
        model.langs.append(r["lang"])
    if not centres:
        return model
    model.centres, model.owner = np.vstack(centres).astype(np.float32), np.array(owner)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = model.centres[model.owner == model.langs.index(lang)]
                for piece in pieces(text):
                    counts = gram_counts(piece)
                    found.append((lang, int(_length(counts)), float((model.vectors(counts) @ own.T).max())))
            columns = zip(*found) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.float64()))], ["lang", "length", "similarity"])

    # Some ten numbers for each sample row.
    found = sample.select("lang", "text").mapInArrow(cut, "lang string, length int, similarity double").toArrow()
    names, length, similarity = (found[c].to_numpy(zero_copy_only=False) for c in ("lang", "length", "similarity"))
    for lang, (least, start) in zip(model.langs, sims):
        _short(least, start, similarity[names == lang], length[names == lang])
    model.least = np.stack([least for least, _ in sims])
    return model


def predictor(model: Centroids):
    """A column function: text -> struct(lang_pred, score, rejected)."""

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names, score, rejected = model.predict(batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], ["lang_pred", "score", "rejected"])

    return of


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All but the held-out quarter: crc32 of the id modulo 4 is not 2."""
    return docs.where(remainder(id_col, 4) != 2)


def identify(docs: DataFrame, model: Centroids, text_col: str = "text") -> Column:
    """The prediction of every row. Null texts and texts without a letter are `und`, score 0 and rejected; so is
    everything if no language was learned."""
    return predictor(model)(docs[text_col])
