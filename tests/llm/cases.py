"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

import os
import random

DATA = os.environ.get("CURATOR_TESTDATA", "/root/testdata")
SMALL = f"{DATA}/sf0.001"
MEDIUM = f"{DATA}/sf0.01"

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, bits bigint, key bigint, bucket int, found string, "
    "score double, f string, v binary, row bigint, length int, toxicity string, language string, label_id bigint, y int, train int"
)


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def edge_rows(seed=1):
    rng = random.Random(seed)
    base = words(rng, 120)
    parts = base.split(" ")
    near = " ".join([*parts[:-1], "changed"])
    texts = [
        (0, base), (1, base), (2, near), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "One two three"), (8, words(rng, 60)),
        (9, words(rng, 30_000)), (10, "Ünïcödé — “text” 数据 \x0b ½ \U0001f600"), (11, words(rng, 60)), (12, base.upper()),
        (20, base), (None, words(rng, 20)), (None, base), (13, "12 34 !! ##"), (8, "tie of ids"),
    ]
    texts += [(21, "twice the same row"), (21, "twice the same row")]
    return texts


def frame(spark, rows=None):
    rows = edge_rows() if rows is None else rows
    langs = ["xx", None, "yy"]
    full = [
        (d, t, langs[i % 3], "src0", len(t or ""), i, i, i, "f", 0.5, "f", b"v", i, i, "t", "l", i, i, i) for i, (d, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


def by_text(rows):
    return sorted(rows, key=lambda x: (x is None, str(x)))
