"""Document quality by positive-unlabelled learning: a non-negative unbiased risk and an estimated class prior."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curator.llm import linear
from curator.llm.common import narrow, rows_of_ids, sample_rows

#: Words looked at together; sums over blocks make the memory of a very long text bounded.
BLOCK = 1 << 16

_KINDS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 sentence mark, 7 symbol
for _codes, _kind in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b" \t\r", 4), (b"\n", 5), (b".,;:'\"-()?", 6), (b"#$%&*!|@<>=+/\\^_`~[]{}", 7)):
    _KINDS[list(_codes)] = _kind

NAMES = (
    "log_bytes", "log_words", "upper", "digit", "space", "line", "mark", "symbol", "non_ascii", "mean_word", "spread_word",
    "distinct", "repeat_next", "top_word", "short_words", "symbol_words", "mean_line", "repeat_lines", "entropy", "capital_words",
    "marks_per_word",
)


def measures(text: str | None) -> np.ndarray:
    """Surface measures of one whole text, NAMES in order; all are 0 for null and empty texts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return np.zeros(len(NAMES), np.float32)
    x = np.frombuffer(raw, np.uint8)
    bytes_ = np.bincount(x, minlength=256)
    kinds = np.bincount(_KINDS, weights=bytes_, minlength=8)
    n, high = len(raw), bytes_[128:].sum()
    letters = max(1.0, kinds[1] + kinds[2] + high)
    words = raw.split()
    m = len(words)
    if not m:
        words, m = [b""], 1
    seen: dict[bytes, int] = {}
    sizes, squares, again, symbols, capitals, last = 0, 0, 0, 0, 0, None
    for w in words:
        seen[w] = seen.get(w, 0) + 1
        k = len(w)
        sizes += k
        squares += k * k
        again += w == last
        last = w
    for w, c in seen.items():
        if w:
            symbols += c * (_KINDS[w[-1]] == 7)
            capitals += c * (w.isupper() and len(w) > 1)
    lines = raw.split(b"\n")
    share = bytes_[bytes_ > 0] / n
    mean = sizes / m
    return np.array([
        np.log1p(n), np.log1p(m), kinds[2] / letters, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / n,
        high / n, mean, np.sqrt(max(0.0, squares / m - mean * mean)), np.log1p(len(seen)) / np.log1p(m), again / m,
        max(seen.values()) / m, sum(c for w, c in seen.items() if len(w) <= 3) / m, symbols / m, np.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines), -(share * np.log2(share)).sum(), capitals / m, kinds[6] / m,
    ], np.float32)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from the scores of held-out rows of both kinds.

    Above any threshold the unlabelled hold at least prior times the share of positives there, so each threshold gives
    an upper bound; the one with the least confidence-corrected bound (both shares plus a DKW margin) is taken.
    """
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    p = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts, "left") / len(unlabelled)
    margin = sum(np.sqrt(np.log(4 / delta) / (2 * k)) for k in (len(positive), len(unlabelled)))
    ok = p > 0.01
    best = np.argmin((u[ok] + margin) / p[ok])
    return float(np.clip(u[ok][best] / p[ok][best], 0.01, 0.99))


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, l2: float = 1e-4, steps: int = 600, rate: float = 0.03) -> np.ndarray:
    """Weights that minimise prior * R+(p) + max(0, R-(u) - prior * R-(p)) under the logistic loss.

    Where the second term is negative, which only overfitting makes it, the step ascends it instead.
    """
    p, u = linear.with_bias(p), linear.with_bias(u)
    w, rule = np.zeros(p.shape[1]), linear.Adam(p.shape[1], rate)
    for _ in range(steps):
        zp, zu = p @ w, u @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad = u.T @ linear.sigmoid(zu) / len(u) - prior * (p.T @ linear.sigmoid(zp)) / len(p)
        if negative < 0:
            w -= rule.step(-grad)
        else:
            w -= rule.step(grad - prior * (p.T @ linear.sigmoid(-zp)) / len(p) + l2 * w)
    return w


@dataclass
class Quality:
    """Cut points of every measure and the weight of every resulting bin."""

    cuts: np.ndarray
    weights: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        """For every measure and cut, whether the measure is above it: an additive step function of each measure."""
        return (x[:, :, None] > self.cuts[None]).reshape(len(x), -1).astype(np.float64)

    def score(self, x: np.ndarray) -> np.ndarray:
        return linear.predict(self.bins(x), self.weights)


def _vector():
    @F.arrow_udf("binary")
    def vector(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([measures(t).tobytes() for t in texts.to_pylist()], pa.binary())

    return vector


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    n_positive: int = 4000, n_unlabelled: int = 8000, n_cuts: int = 12, rows_per_id: int = 4,
) -> Quality | None:
    """Learn from trusted positives and unlabelled rows; None if there are no positives or no rows.

    Positives are rows of `docs` whose label is 1 in `labels`; the unlabelled rows are drawn from all rows, labelled or
    not, so the cover of the labels doesn't change what they are. Labels 0 are never used. The driver holds the measures
    of about `n_positive` ids with at most `rows_per_id` rows each and of `n_unlabelled` rows, a documented bound; ids of
    positives are broadcast. Repeated rows count once; rows without an id have no label, but are among the unlabelled.
    Half of each kind estimates the class prior with a model fitted on the other half.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg((F.max(label_col) == 1).alias("good"))
    good = sample_rows(known.where("good"), ["label_id"], None, n_positive)
    text = narrow(docs, id_col, text_col)
    vector = _vector()
    p = text.join(F.broadcast(good), text["doc_id"] == good["label_id"]).select("doc_id", vector("text").alias("v"))
    p = rows_of_ids(p, "doc_id", rows_per_id).select("v").collect()
    u = sample_rows(text, ["doc_id", "text"], None, n_unlabelled).select(vector("text").alias("v")).collect()
    if not p or not u:
        return None
    p, u = (np.stack([np.frombuffer(v, np.float32) for v in sorted(bytes(r["v"]) for r in rows)]) for rows in (p, u))
    steps = np.linspace(0, 1, n_cuts + 2)[1:-1]
    tails = [0.005, 0.02, 0.98, 0.995]
    model = Quality(np.quantile(u, [*steps, *tails], axis=0).T, np.zeros(0))
    bp, bu = model.bins(p), model.bins(u)
    draft = linear.fit_logistic(
        np.vstack([bp[::2], bu[::2]]), np.concatenate([np.ones(len(bp[::2])), np.zeros(len(bu[::2]))]),
        np.concatenate([np.full(len(bp[::2]), 1 / len(bp[::2])), np.full(len(bu[::2]), 1 / len(bu[::2]))]))
    other = (bp[1::2], bu[1::2]) if len(bp) > 1 and len(bu) > 1 else (bp, bu)
    prior = class_prior(*(linear.predict(x, draft) for x in other))
    model.weights = fit_nnpu(bp, bu, prior)
    return model


def scorer(model: Quality | None):
    """A column function: text -> score in 0 to 1, higher where a positive label is likelier. Null and empty texts are
    scored by measures of 0; without a model every score is 0.5."""

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            if model is None or not len(texts):
                yield pa.array(np.full(len(texts), 0.5))
            else:
                yield pa.array(model.score(np.stack([measures(t) for t in texts.to_pylist()])))

    return of
