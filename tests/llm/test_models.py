"""Language ID, quality and toxicity: held-out accuracy, and the parts against plain versions."""

import os
import random
import zlib

import numpy as np
import pytest
from cases import MEDIUM, frame, words
from pyspark.sql import functions as F

from curator.llm import language, linear, quality, queries, toxicity

given_tables = pytest.mark.skipif(not os.path.isdir(MEDIUM), reason="driver tables are not present")


def held(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


# language


def test_gram_counts_in_blocks_equal_those_at_once(monkeypatch):
    text = "Größe & ñandú, l'été " * 40
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "BLOCK", 17)
    assert (language.gram_counts(text) == whole).all()
    assert whole.sum() > 0 and (language.gram_counts(None) == language.gram_counts("")).all()


def test_clusters_are_unit_and_deterministic():
    x = language.unit(np.random.default_rng(3).random((60, 12)))
    a, b = language.cluster(x, 4), language.cluster(x, 4)
    assert (a == b).all() and np.allclose(np.linalg.norm(a, axis=1), 1) and len(a) == 4
    assert len(language.cluster(x[:2], 4)) == 2


@given_tables
def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang")
    rows = queries.op2(spark, MEDIUM).join(docs, "doc_id").collect()
    for r in rows:
        assert r.held_out == (held(r.doc_id, 4) == 2) and 0 <= r.score <= 1
    own = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(own) >= 0.97 * len(own)
    assert sum(r.rejected for r in rows) <= 0.005 * len(rows)


def test_language_edges(spark):
    rng = random.Random(2)
    abc = [(i, " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(50))) for i in range(30)]
    xyz = [(100 + i, " ".join("".join(rng.choice("vwxyz") for _ in range(5)) for _ in range(50))) for i in range(30)]
    docs = frame(spark, abc + xyz).withColumn("lang", F.when(F.col("doc_id") < 100, "A").otherwise("Z"))
    model = language.fit(docs)
    odd = frame(spark, [(1, None), (2, ""), (3, "12 ½ Ⅷ !!"), (4, "abc cab dab bad " * 30), (5, "жшщ " * 300), (None, "xyz zyx vwx xyw " * 30), (4, "abc cab dab bad " * 30)])
    got = odd.select("doc_id", language.identify(odd, model).alias("p")).select("doc_id", "p.*").collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.rejected))
    assert by[1] == by[2] == by[3] == [("und", True)]
    assert by[4] == [("A", False)] * 2 and by[None] == [("Z", False)]
    assert by[5][0][1] is True
    none = language.fit(frame(spark, []))
    assert {r.p.lang_pred for r in odd.select(language.identify(odd, none).alias("p")).collect()} == {"und"}
    no_rows = frame(spark, [])
    assert no_rows.select(language.identify(no_rows, model).alias("p")).collect() == []


# quality


def test_class_prior_of_a_known_mixture():
    rng = np.random.default_rng(8)
    p, u = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 2800), rng.normal(-2, 1, 1200)])
    assert abs(quality.class_prior(linear.sigmoid(p), linear.sigmoid(u)) - 0.7) < 0.06


def test_non_negative_risk_separates_without_negatives():
    rng = np.random.default_rng(8)
    draw = lambda at, n: rng.normal(at, 1, (n, 2))
    w = quality.fit_nnpu(draw(2, 1000), np.vstack([draw(2, 1400), draw(-2, 600)]), 0.7)
    assert (linear.predict(draw(2, 500), w) > 0.5).mean() > 0.95 and (linear.predict(draw(-2, 500), w) < 0.5).mean() > 0.95


@given_tables
def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "quality")
    scored = queries.op4(spark, MEDIUM)
    rows = scored.join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.held_out and r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == (held(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    assert scored.count() == 1000


def test_quality_edges(spark):
    rng = random.Random(2)
    docs = frame(spark, [(i, words(rng, 40).capitalize() + ".") for i in range(60)] + [(100 + i, "!! ## " * 30) for i in range(20)])
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(0, None), (None, 1), (1, 0), (100, 0)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    odd = frame(spark)
    scores = [r.s for r in odd.select(quality.scorer(model)("text").alias("s")).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert quality.fit(frame(spark, []), labels) is None and quality.fit(docs, labels.where("quality = 5")) is None
    assert {r.s for r in odd.select(quality.scorer(None)("text").alias("s")).collect()} == {0.5}


# toxicity


def test_grams_in_blocks_equal_those_at_once(monkeypatch):
    text = "A vile Word, ñandú " * 30
    whole = sorted(np.concatenate([*toxicity.grams(text)]).tolist())
    assert int.from_bytes(b" a vi", "big") in whole and int.from_bytes(b" a vile", "big") in whole
    monkeypatch.setattr(toxicity, "BLOCK", 13)
    assert sorted(np.concatenate([*toxicity.grams(text)]).tolist()) == whole
    assert [*toxicity.grams("a")] == [] and [*toxicity.grams(None)] == []


def test_a_chain_feeds_earlier_categories_forward():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3)).astype(np.float32)
    first = (x[:, 0] > 0).astype(float)
    y = np.stack([first, first * (x[:, 1] > 0)], axis=1)
    weights = toxicity.fit_chain(x, y, np.ones(600))
    assert [len(w) for w in weights] == [4, 5]
    p = toxicity.Chain(toxicity.Marks(np.zeros(0, np.uint64)), weights).probabilities(x)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.93 and weights[1][3] > 0


def test_toxic_words_are_learned_and_clean_rows_stay(spark):
    rng = random.Random(6)
    bad = ["scumbag", "vermin", "filth"]

    def toxic():
        w = words(rng, 60).split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), rng.choice(bad).upper())
        return " ".join(w)

    rows = [(i, toxic() if i % 5 == 0 else words(rng, 60)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(0, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    docs = frame(spark, rows)
    chain = toxicity.fit(docs, labels)
    got = docs.select("doc_id", toxicity.scorer(chain)("text").alias("p")).select("doc_id", "p.*").collect()
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in got if r.doc_id >= 300)
    odd = frame(spark).select("doc_id", toxicity.scorer(chain)("text").alias("p")).select("doc_id", "p.*").collect()
    assert len(odd) == frame(spark).count() and not any(r.predicted for r in odd)
    assert toxicity.fit(frame(spark, []), labels) is None and toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert {r.p.toxic for r in docs.select(toxicity.scorer(None)("text").alias("p")).collect()} == {0.0}


@given_tables
def test_toxicity_finds_marks_in_held_out_rows(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    rows = queries.op10(spark, MEDIUM).join(labels, "doc_id").where("held_out").collect()
    clean = [r.predicted for r in rows if r.label == 0]
    assert sum(clean) <= 0.03 * len(clean) and sum(r.predicted for r in rows if r.label == 1) >= 0.5 * sum(r.label for r in rows)


def test_short_texts_far_from_all_languages_are_rejected(spark):
    rng = random.Random(4)
    stems = {"xx": "haus baum strasse wasser licht garten fenster morgen".split(), "yy": "casa arbol calle agua luz jardin ventana manana".split()}
    rows = [(i, " ".join(rng.choice(stems[lang]) for _ in range(200))) for i, lang in zip(range(120), ["xx", "yy"] * 60)]
    docs = frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").otherwise("yy"))
    model = language.fit(docs)
    far = ["Привет как дела сегодня утром", "Καλημέρα τι κάνεις σήμερα φίλε", "今天天气很好我们去公园", "안녕하세요 오늘 날씨가 좋네요"]
    assert model.predict(far)[2].all()
    near = ["garten haus morgen licht baum", "agua luz casa", "haus baum strasse", "calle jardin ventana"]
    assert not model.predict(near)[2].any()


def test_a_sample_is_bounded_whatever_the_ids(spark):
    from curator.llm.common import rows_of_ids, sample_rows

    for ids in ("cast(null as bigint)", "7L", "11L", "id"):
        rows = spark.range(20_000).selectExpr(f"{ids} as doc_id", "concat('text ', id) as text", "if(id % 4 = 0, 'b', 'a') as lang")
        got = {r.lang: r["count"] for r in sample_rows(rows, ["doc_id", "text"], "lang", 500).groupBy("lang").count().collect()}
        assert set(got) == {"a", "b"} and all(380 < n < 620 for n in got.values())
    copies = spark.range(20_000).selectExpr("id % 50 as doc_id", "concat('text ', id % 50) as text", "if(id = 0, null, 'a') as lang")
    assert sample_rows(copies, ["doc_id", "text"], "lang", 500).count() == 50
    one = spark.range(1000).selectExpr("id % 2 as doc_id", "concat('text ', id) as text")
    assert rows_of_ids(one, "doc_id", 4).count() == 8
    assert sample_rows(copies.limit(0), ["doc_id", "text"], "lang", 500).collect() == []


def test_many_languages_are_learned_in_tasks(spark):
    rows = spark.range(600).selectExpr("cast(null as bigint) as doc_id", "concat('wort', id % 60, ' dann ', id) as text", "concat('l', id % 60) as lang")
    model = language.fit(rows, per_language=5, clusters=2)
    assert len(model.langs) == 60 and len(model.centres) <= 120 and model.least.shape == (60, language.LENGTHS)


def test_the_cover_of_the_labels_does_not_empty_the_unlabelled_rows(spark):
    good = [(i, f"A quiet sentence number {i} about rivers and hills.") for i in range(40)]
    docs = spark.createDataFrame([*good, (None, "$$$ ### !!!")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)], "doc_id bigint, quality int")
    assert quality.fit(docs, labels) is not None
    same_id = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + good[2:], "doc_id bigint, text string")
    assert quality.fit(same_id, labels, n_positive=10, n_unlabelled=50) is not None


def test_equal_rows_share_a_fold(monkeypatch):
    seen = []
    fit = linear.fit_logistic

    def watched(z, y, *weight):
        seen.append(z)
        return fit(z, y, *weight)

    monkeypatch.setattr(linear, "fit_logistic", watched)
    x = np.repeat(np.random.default_rng(0).normal(size=(40, 3)), 5, axis=0)
    y = np.stack([x[:, 0] > 0, x[:, 1] > 0], axis=1).astype(float)
    toxicity.fit_chain(x, y, np.ones(len(x)))
    part = [z for z in seen if len(z) < len(x)]
    assert len(part) == 5 and sum(len(x) - len(z) for z in part) == len(x)
    for z in part:
        rows, counts = np.unique(z, axis=0, return_counts=True)
        assert set(counts.tolist()) == {5}
