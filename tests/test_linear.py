"""Functions whose time must follow the length of their input, against plain versions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from curator.functions import spans
from curator.functions.markup import marked_text, page_text
from curator.operators.validation import uncovered_units


def union(ranges):
    out = []
    for a, b in sorted(r for r in ranges if r[1] > r[0]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def placed(ranges):
    at, out = 0, []
    for a, b in ranges:
        out.append((at, at + b - a, a))
        at += b - a + 2
    return out


RANGES = "array<struct<start:int,end:int>>"


def test_ranges_against_a_loop(spark):
    rng, rows = random.Random(0), []
    for i in range(200):
        n = rng.choice([0, 1, 2, 5, 40, 700])
        given = [(a, a + rng.randrange(9) - 1) for a in (rng.randrange(5000 if n > 50 else 60) for _ in range(n))]
        rows.append((i, given, [tuple(sorted((rng.randrange(300), rng.randrange(300)))) for _ in range(rng.randrange(6))]))
    df = spark.createDataFrame(rows, f"i int, r {RANGES}, q {RANGES}").withColumn("m", spans.merge_ranges("r"))
    df = df.withColumn("s", spans.supplied_segments("m")).withColumn("x", spans.remap("q", "s")).withColumn("sums", spans.running_sums(F.transform("r", lambda r: r["end"])))
    for row in df.collect():
        want = union([tuple(x) for x in row.r])
        assert [tuple(x) for x in row.m] == want and [tuple(x) for x in row.s] == placed(want)
        moved = [(o + max(a, s) - s, o + min(b, e) - s) for a, b in union([tuple(x) for x in row.q]) for s, e, o in placed(want)]
        assert [tuple(x) for x in row.x] == union(moved)
        assert row.sums == [sum(r.end for r in row.r[:i]) for i in range(len(row.r))]


def test_a_hundred_thousand_ranges_take_seconds(spark):
    rng = random.Random(1)
    given = [(a, a + rng.randrange(80)) for a in (rng.randrange(10**7) for _ in range(100_000))]
    df = spark.createDataFrame([(given,)], f"r {RANGES}")
    start = time.time()
    found = df.select(spans.merge_ranges("r").alias("m")).select("m", spans.supplied_segments("m").alias("s"))
    row = found.select(F.size("m").alias("n"), F.size(spans.remap(F.transform("s", lambda s: F.struct((s["supplied_start"] + 1).alias("start"), s["supplied_end"].alias("end"))), "s")).alias("k")).first()
    assert row.n == len(union(given)) and row.k <= row.n and time.time() - start < 30


@pytest.mark.parametrize("page, text", [
    ("a<sup role=doc-noteref>x<sup>y</sup>z</sup>b", "a[footnote: xyz]b"),
    ("<a class='x footnote-ref'> <b>1</b></a>t", "[footnote: 1]t"),
    ("<a href='#fn-3'>3</a><a href='#other'>4</a>", "[footnote: 3]4"),
    ("<time itemprop='dateModified'>1<time>2</time>3</time>k", "k"),
    ("<ul><li>a<ul><li>b<sub>2</sub></li></ul></li></ul>", "- a\n\n- b[subscript: 2]"),
    ("<time datetime='2024-01-02'>x</time>", "time datetime: 2024-01-02\nx"),
    ("<sup role='doc-noteref'><time datetime='2024'>1</time></sup>", "[footnote: 1]"),
    ("<script>var a='</p>'</script>b<style>c</style>d", "bd"),
    ("x <!-- y > z", "x"), ("<sup role=doc-noteref>open", ""), ("a < b &lt;c&gt;", "a < b <c>"),
    ("<p title='a > b'>t</p>", "t"), ("<H2>Head</H2>x", "## Head\nx"),
    ('<script type="application/ld+json">[{"@type":"Article","datePublished":"1"},{"@graph":[{"@type":["X","NewsArticle"],"datePublished":"2"}]}]</script>',
     "article datePublished: 2\n\narticle datePublished: 1"),
    ('<script type="application/ld+json">{broken</script>t', "t"), (None, None), ("", ""),
])
def test_nested_structure(one, page, text):
    assert one(page_text(F.col("t").cast("string"), "structured"), t=page) == text


@pytest.mark.parametrize("page", [
    "<div><p>Some <a href='#fn1'>1</a> and <sup>2</sup></p><ul><li>one</li></ul><time datetime='2024'>x</time></div>\n" * 10_000,
    "<sup role=doc-noteref>" * 40_000 + "</sup>" * 40_000, "<p " * 300_000 + "'>", "<p '" * 200_001 + ">", "<!-- " * 200_000,
    "<script>" * 100_000, "<" * 1_000_000, "<a" * 300_000, "<p \"'" * 150_001 + ">",
], ids=range(9))
def test_a_long_page_takes_a_second(page):
    start = time.time()
    marked_text(page)
    assert time.time() - start < 5


def test_many_excerpts_of_a_long_text(spark):
    words = [f"word{i}" for i in range(4000)]
    text = " ".join(words) + " aaaa!"
    units = spark.createDataFrame([(1, text), (2, text), (3, "aXa."), (4, ""), (5, "a.b E\\E.")], "unit_id int, text string")
    checks = [(1, w) for w in words] + [(1, "aa"), (1, "aa")] + [(2, w) for w in words] + [(3, "a"), (5, "a.b"), (5, "E\\E"), (4, "")]
    start = time.time()
    got = sorted(tuple(r) for r in uncovered_units(units, spark.createDataFrame(checks, "unit_id int, text string")).collect())
    assert got == [(2, "text_uncovered"), (3, "text_uncovered"), (4, "excerpt_not_in_text")] and time.time() - start < 60
