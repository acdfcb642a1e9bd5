"""What reaches Python stays small."""

import pyarrow as pa
from pyspark.sql import functions as F

from curator.functions import markup, text


def test_utf8_pages_stay_out_of_python(spark, monkeypatch):
    monkeypatch.setattr(markup, "_strictly", lambda given: F.when(given["body"].isNotNull(), F.raise_error(F.lit("sent to Python"))).cast("string"))
    pages = spark.createDataFrame([(1, b"<p>caf\xc3\xa9"), (2, b"<p>\xff"), (3, b"<p>\xed\xa0\x80"), (4, b"\xef\xbb\xbf<p>x")], "id int, raw binary")
    got = {r.id: (r.d.text, r.d.error) for r in pages.select("id", markup.decode_page("raw", F.lit("text/html")).alias("d")).collect()}
    assert got == {1: ("<p>café", None), 2: (None, "invalid bytes for utf-8"), 3: (None, "invalid bytes for utf-8"), 4: ("<p>x", None)}


def test_references_are_resolved_in_arrow():
    assert text._unescape.func(pa.array(["&nbsp;&eacute;", None])).to_pylist() == ["\xa0é", None]


def test_batches_of_long_texts_are_short(spark):
    from curator.runtime import configure

    @F.arrow_udf("long")
    def size(values: pa.Array) -> pa.Array:
        return pa.array([len(values)] * len(values))

    configure(spark)
    long = spark.range(0, 400, 1, 1).select(size(F.concat(F.repeat(F.lit("x"), 100_000), F.col("id").cast("string"))).alias("n"))
    assert long.agg(F.max("n")).collect()[0][0] < 200
