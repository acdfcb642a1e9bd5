"""The pipeline's stages, each against a plain version on its own input, and the whole run."""

import os

import pytest
from cases import SMALL, frame
from test_decontaminate import plain_match
from test_simhash import plain_components, plain_fingerprint
from test_tokens import check_packing

import corpus_pipeline
from curator.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not present")


def test_stages_are_named_and_registered():
    import __spark_entry__ as entry

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_dedup", "decontamination", "packing"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)


def test_every_stage_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, before, SMALL), name)
        rows = [(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()]
        if name == "packing":
            check_packing(rows, after.collect(), 1024)
            break
        assert after.columns == docs.columns
        kept = {r.doc_id: r.text for r in after.collect()}
        assert all(dict(rows)[d] == t for d, t in kept.items())
        if name == "toxicity":
            assert 0.7 * len(rows) <= len(kept) < len(rows)
        if name == "language":
            assert len(kept) >= 0.98 * len(rows)
        if name == "near_dedup":
            nodes = [(d, plain_fingerprint(t)) for d, t in rows]
            assert set(kept) == set(plain_components(nodes))
        if name == "decontamination":
            bad = {d for d, t in rows if (m := plain_match(t, bench))[1] and 20 * m[1] >= m[0]}
            assert set(kept) == {d for d, _ in rows} - bad
        before = after


def test_stages_take_odd_rows_and_empty_tables(spark):
    for rows in (None, []):
        docs = frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert len(out.collect()) <= (10_000 if rows is None else 0)


def test_rows_without_an_id_stay_unless_they_are_copies(spark):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(1, texts[0]), (2, texts[1]), (None, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (5, texts[0])]
    out = corpus_pipeline.near_dedup(spark, frame(spark, rows), SMALL)
    assert out.columns == frame(spark, []).columns
    assert sorted((r.doc_id or 0, r.text[0]) for r in out.collect()) == [(0, "c"), (0, "d"), (1, "a"), (2, "b")]


def test_run_equals_its_stages(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(rows[0].asDict())


def test_the_language_stage_keeps_all_where_nothing_is_learned(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    everything = docs.count()
    with_lang = corpus_pipeline.drop_unknown_language(spark, docs, SMALL).count()
    without_ids = corpus_pipeline.drop_unknown_language(spark, docs.selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars"), SMALL).count()
    without_lang = corpus_pipeline.drop_unknown_language(spark, docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars"), SMALL).count()
    assert without_lang == everything and with_lang >= 0.98 * everything and abs(without_ids - with_lang) <= 0.02 * everything
