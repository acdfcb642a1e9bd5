"""Scalar functions on the cases that define them."""

import pytest
from pyspark.sql import functions as F

from curator.functions import ids, links, markup, paths, spans, text, times, urls

C = F.col


@pytest.mark.parametrize("given, expected", [
    ("HTTPS://Example.COM/A/?utm_source=x&b=2&a=1&fbclid=z#top", "https://example.com/A?a=1&b=2"),
    ("https://h/", "https://h/"),
    ("https://h", "https://h"),
    ("https://h/a//", "https://h/a"),
    ("https://h/a?x=&y", "https://h/a?x=&y="),
    ("https://h/a?q=a%20b~*", "https://h/a?q=a+b~%2A"),
    ("https://under_score.example/a b", "https://under_score.example/a b"),
    ("", ""),
])
def test_normalize_url(one, given, expected):
    assert one(urls.normalize_url("u"), u=given) == expected


@pytest.mark.parametrize("given, kind, expected", [
    ("https://github.com/Owner/Repo.git/releases/tag/v1", "project", "https://github.com/owner/repo"),
    ("http://www.github.com/Owner/Repo/Blob/X?utm_a=1&z=1", "reading", "https://github.com/owner/repo/Blob/X?z=1"),
    ("https://github.com/only", "project", None),
    ("https://h:443/a", "reading", "https://h/a"),
    ("http://h:8080", "reading", "http://h:8080/"),
    ("https://user:pw@h/a", "reading", None),
    ("ftp://h/a", "reading", None),
    ("https://h/a b", "reading", None),
    ("https://[::1]:8443/x", "reading", "https://[::1]:8443/x"),
    ("https://h/?gclid=1&mc_cid=2", "reading", "https://h/?mc_cid=2"),
])
def test_canonical_url(one, given, kind, expected):
    assert one(urls.canonical_url("u", kind), u=given) == expected


def test_event_url_keeps_the_anchor(one):
    assert one(urls.event_url("u"), u="https://h/log?utm_x=1#v2") == "https://h/log#v2"


@pytest.mark.parametrize("given, expected", [
    ("https://example.org/x", True), ("http://localhost/x", False), ("http://a.internal/", False), ("http://10.1.2.3/", False),
    ("http://172.20.0.1/", False), ("http://8.8.8.8/", True), ("http://169.254.1.1/", False), ("http://[::1]/", False),
    ("http://[2606:4700::1]/", True), ("javascript:alert(1)", False), ("https://h:99999/", False),
])
def test_is_public_url(one, given, expected):
    assert one(urls.is_public_url("u"), u=given) is expected


@pytest.mark.parametrize("base, link, expected", [
    ("https://h/a/b.xml", "c", "https://h/a/c"), ("https://h/a/b.xml", "../c", "https://h/c"), ("https://h/a/", "/c", "https://h/c"),
    ("https://h/a", "//o/c", "https://o/c"), ("https://h/a", "https://o/", "https://o/"), ("https://h/a?x=1", "#f", "https://h/a#f"),
])
def test_resolve_url(one, base, link, expected):
    assert one(urls.resolve_url(C("b"), C("l")), b=base, l=link) == expected


@pytest.mark.parametrize("given, kind, ref", [
    ("https://github.com/a/b", "repository", None), ("https://github.com/a/b/releases/tag/v1/x", "release", "v1/x"),
    ("https://github.com/a/b/pull/7", "pull", "7"), ("https://github.com/a/b/issues/8", "issue", "8"), ("https://github.com/a/b/tree/main", "tree", "main"),
    ("https://github.com/a/b/wiki", None, None), ("http://github.com/a/b", None, None), ("https://github.com/a/b?x=1", None, None),
])
def test_classify_repo_url(one, given, kind, ref):
    found = one(urls.classify_repo_url("u"), u=given)
    assert (found and found["kind"], found and found["ref"]) == (kind, ref)


def test_titles(one):
    assert one(text.normalize_title("t"), t="  ＡＢＣ－１２：Ünïted ﬁle 模型!") == "abc 12 ünïted file 模型"
    assert sorted(one(text.title_features("t"), t="GPT-5 发布新模型 强")) == sorted(
        ["ascii:gpt", "ascii:5", "cjk:发布", "cjk:布新", "cjk:新模", "cjk:模型", "cjk:强"]
    )


def test_entities(one):
    assert one(text.normalize_evidence("t"), t="a &amp;lt; b&nbsp;&eacute; &#x41; ﬁ") == "a &lt; b é A fi"
    assert one(text.plain_text("t", 5), t="<p>one</p>&copy; two") == "one ©"


def test_extract_urls(one):
    assert one(text.extract_urls("t"), t="see https://a.b/c. 和 github.com/x/y； again https://a.b/c; not x@github.com/z") == [
        "https://a.b/c", "https://github.com/x/y"
    ]


def test_statements_round_trip(one):
    source = "  One v1.2 at https://a.b/c.html is \"done.\" Two！三。\n\n Four"
    parts = one(text.split_statements("t"), t=source)
    assert "".join(p["text"] for p in parts) == source
    assert [p["id"] for p in parts] == ["s0", "s1", "s2", "s3"]
    assert parts[0]["text"].endswith('"done." ')


@pytest.mark.parametrize("size, limit, words, expected", [
    (10, 20, [], [(0, 10)]), (100, 3, ["k"], [(0, 3)]), (9000, 4000, ["zz"], [(0, 4000)]),
])
def test_excerpt_without_a_hit(one, size, limit, words, expected):
    keywords = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    found = one(text.excerpt_ranges("t", limit, keywords), t="k" + "x" * (size - 1))
    assert [(r["start"], r["end"]) for r in found] == expected


def test_excerpt_around_a_hit(one):
    body = "x" * 6000 + "KEY" + "y" * 3000
    found = one(text.excerpt_ranges("t", 4000, F.array(F.lit("key"))), t=body)
    assert [(r["start"], r["end"]) for r in found] == [(0, 2000), (5800, 7798)]


@pytest.mark.parametrize("given, expected", [
    ("2024-02-03T04:05:06.789Z", "2024-02-03T04:05:06Z"), ("2024-02-03T12:05:06+08:00", "2024-02-03T04:05:06Z"), ("2024-02-03", "2024-02-03T00:00:00Z"),
    ("Sat, 03 Feb 2024 04:05:06 GMT", "2024-02-03T04:05:06Z"), ("3 Feb 2024 04:05:06 -0500", "2024-02-03T09:05:06Z"),
    ("Sat, 3 Feb 2024 04:05 EST", "2024-02-03T09:05:00Z"), ("soon", None), ("2024-13-01", None), ("", None),
])
def test_to_utc(one, given, expected):
    assert one(times.iso_text(times.to_utc("t")), t=given) == expected


def test_naive_time_can_be_unknown(one):
    assert one(times.to_utc("t", naive="null"), t="2024-02-03T04:05:06") is None


@pytest.mark.parametrize("given, precision", [
    ("2024-02-03", "date"), ("2024-02-03T04:05:06Z", "timestamp"), ("2024-02-03 04:05 UTC", "timestamp"), ("Sat, 03 Feb 2024 04:05:06 GMT", "timestamp"),
    ("2024-02-03T04:05:06", None), ("Sat, 03 Feb 2024 04:05:06 EST", None), ("2024-02-31", None),
])
def test_parse_publication(one, given, precision):
    found = one(times.parse_publication("t"), t=given)
    assert (found and found["precision"]) == precision


@pytest.mark.parametrize("day, quote, expected", [
    ("2024-03-05", "released 2024-03-05", True), ("2024-03-05", "March 5, 2024", True), ("2024-03-05", "2024年3月5日", True),
    ("2024-03-05", "at 2024-03-05T10:00:00Z", False), ("2024-03-15", "<meta name='publication-date' content='03-15-2024'>", True),
    ("2024-03-05", "<meta name='publication-date' content='03-05-2024'>", False), ("2024-03-15", "<meta name='dateModified' content='03-15-2024'>", False),
    ("2024-03-05T10:00:00+00:00", "at 2024-03-05T18:00:00+08:00", True), ("2024-03-05T10:00:00Z", "on 2024-03-05", False),
])
def test_date_supported(one, day, quote, expected):
    assert one(times.date_supported("d", "q"), d=day, q=quote) is expected


def test_period_windows(one):
    month = one(times.period_window("p", "monthly"), p="2024-02")
    assert (str(month["start_date"]), str(month["end_date"])) == ("2024-02-01", "2024-02-29")
    assert one(times.iso_text(times.period_window("p", "monthly")["due_at"]), p="2024-02") == "2024-03-01T03:00:00Z"
    assert one(times.period_window("p", "weekly"), p="2024-02-06") is None
    assert one(times.period_of(C("t").cast("timestamp"), "daily"), t="2024-02-03 16:00:00") == "2024-02-04"


def test_bare_date_never_fits_a_day(one):
    day = C("d").cast("date")
    inside = lambda a, b: times.event_in_period(F.lit(None).cast("timestamp"), day, F.lit(a).cast("date"), F.lit(b).cast("date"))
    assert one(inside("2024-02-10", "2024-02-10"), d="2024-02-10") is False
    assert one(inside("2024-02-01", "2024-02-29"), d="2024-02-10") is True
    assert one(inside("2024-02-10", "2024-02-29"), d="2024-02-10") is False


def test_candidate_id_ignores_the_event_name(one):
    make = lambda kind: ids.candidate_id("u", F.lit(kind), F.lit("https://h/e#1"))
    assert one(make("update"), u="https://h/a") == one(make("update"), u="https://H/a")
    assert one(make("update"), u="https://h/a") != one(make("project"), u="https://h/a")


def test_links(one):
    payload = '{"other":["https://z/1",{"href":"https://z/2"}],"original":"https://o/?utm_q=1","url":"https://u/"}'
    found = one(links.declared_links(C("p")), p=payload)
    assert found["url"] == "https://o/"
    assert found["relation"] == "original_link"
    assert found["extra_urls"] == ["https://u/", "https://z/1", "https://z/2"]
    assert one(links.declared_links(C("p")), p='["https://a/x","https://a/x","not"]')["relation"] == "discovery_link"


@pytest.mark.parametrize("path, basic, discovery", [
    ("LICENSE", "license", "license"), ("COPYING.md", "license", "license"), ("license.py", None, None), ("docs/install.md", "installation", "installation"),
    ("docs/README.md", "usage", "usage"), ("README.md", None, None), ("help/user guide.html", None, "usage"), ("docs/_index.md", None, "overview"), ("src/faq.md", None, None),
])
def test_doc_purpose(one, path, basic, discovery):
    assert one(paths.doc_purpose("p"), p=path) == basic
    assert one(paths.doc_purpose("p", "discovery"), p=path) == discovery


def test_safe_paths(one):
    for path, safe in (("a/b.md", True), ("../a", False), ("/a", False), ("a//b", False), ("a\\b", False), ("c:x", False), ("", False)):
        assert one(paths.is_safe_path("p"), p=path) is safe
    assert one(paths.is_sensitive_path("p"), p="a/.env.local") and one(paths.is_sensitive_path("p"), p="my_token.txt")
    assert not one(paths.is_sensitive_path("p"), p="a/tokenizer.md")


def test_scope_rules(one):
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    broken = spans.scope_violations(F.lit("excerpt"), F.lit(10), F.lit(5), F.array(span(0, 2), span(1, 4)), F.lit(None).cast("string"), F.lit("abcde"))
    assert one(broken) == ["ranges_disordered"]
    good = spans.scope_violations(F.lit("complete_text"), F.lit(5), F.lit(5), F.array(span(0, 2), span(2, 5)), F.sha2(F.lit("abcde"), 256), F.lit("abcde"))
    assert one(good) == []


def test_json_fields(one):
    body = '{ "id": 1, "name" : "A\\"b", "description": null, "homepage": "" , "full_name":"o/r"}'
    found = one(spans.json_field_ranges("t"), t=body)
    assert [body[r["start"]:r["end"]] for r in found] == ['"name" : "A\\"b"', '"full_name":"o/r"']
    assert one(spans.json_field_ranges("t"), t="[1]") is None


def test_page_profiles(one):
    page = (
        "<html><head><title>T</title><meta property='article:published_time' content='2024-01-02'><script type='application/ld+json'>"
        '{"@graph":[{"@type":"NewsArticle","datePublished":"2024-01-03"}]}</script></head><body><h2>Head</h2><p>One<sup>2</sup> '
        "<a class='footnote-ref' href='#fn1'>7</a></p><time itemprop='dateModified'>later</time><ul><li>x</li></ul><table><tr><td>c</td></tr></table>"
        "<noscript>hidden</noscript><script>var a='</p>'</script></body></html>"
    )
    structured = one(markup.page_text("t", "structured"), t=page)
    for piece in ("publication metadata: 2024-01-02", "article datePublished: 2024-01-03", "## Head", "[superscript: 2]", "[footnote: 7]", "- x", "| c"):
        assert piece in structured
    assert "later" not in structured and "var a" not in structured
    assert "## Head" in one(markup.page_text("t", "product"), t=page)
    evidence = one(markup.page_text("t", "evidence"), t=page)
    assert "hidden" not in evidence and "Head One 2 7" in evidence


@pytest.mark.parametrize("raw, header, encoding, origin, good", [
    ("<html>é".encode(), "", "utf-8", "utf-8-default", True), ("<html>é".encode("cp1252"), "text/html; charset=windows-1252", "cp1252", "http-header", True),
    ('<meta charset="gbk"><p>模'.encode("gbk"), "text/html", "gbk", "html-meta", True), ("﻿<p>x".encode("utf-16-le"), "", "utf-16-le", "bom", True),
    ("<html>é".encode("cp1252"), "", "utf-8", "utf-8-default", False), (b"%PDF-1.4", "", "utf-8", "utf-8-default", False),
    (b"<p>\x00", "", "utf-8", "utf-8-default", False), (b"<p>x", "image/png", "utf-8", "utf-8-default", False), (b"plain words", "", "utf-8", "utf-8-default", False),
])
def test_decode_pages(one, raw, header, encoding, origin, good):
    found = one(markup.decode_page(F.lit(bytearray(raw)), F.lit(header)))
    assert (found["encoding"], found["origin"], found["error"] is None) == (encoding, origin, good)


def test_passages_keep_every_word(one):
    body = "# A\n" + "word " * 900 + "\n\n" + "tail " * 300 + "\n```\n# not a heading\n```\n## B\nx\nTitle\n=====\nend  \n"
    found = one(markup.passages_of("t"), t=body)
    assert "".join(p["quote"] for p in found).split() == body.split()
    assert all(len(p["quote"]) <= 2400 and body[p["start"]:].startswith(p["quote"]) for p in found)
    assert found[0]["heading_path"] == ["A"] and ["A", "B"] in [p["heading_path"] for p in found]
    assert found[-1]["heading_path"] == ["Title"]


def test_links_and_dots_have_no_depth_limit(one):
    deep = '{"a":{"b":[{"c":{"d":{"e":{"f":["https://h/x", {"url":"https://h/y"}]}}}}]},"url":"https://h/first","z":"]}]}"}'
    assert one(links.harvest(F.col("p")), p=deep) == ["https://h/first", "https://h/x", "https://h/y"]
    assert one(links.harvest(F.col("p").cast("string")), p=None) is None and one(links.harvest(F.col("p")), p="plain") == []
    join = lambda b, u: one(urls.resolve_url(F.lit(b), F.lit(u)))
    assert join("https://h/1/2/3/4/5/6/7/x", "../../../../../../p") == "https://h/1/p"
    assert join("https://h/a/b", "../../../p") == "https://h/p" and join("https://h/a/b/c", "..") == "https://h/a/"
    assert join("https://h/a/b", "./c/./d?e=../f") == "https://h/a/c/d?e=../f" and join("https://h", "x") == "https://h/x"
    assert join("https://h/a/b", "/c/../d/") == "https://h/d/"


def test_all_keywords_of_a_record(one):
    title = " ".join(f"word{i}" for i in range(30))
    few, every = (one(text.record_keywords(F.col("t"), F.lit("https://h/a/last"), n), t=title) for n in (text.KEYWORDS, None))
    assert few == every[:12] and len(every) == 32 and every[-1] == "last"


@pytest.mark.parametrize("name, module", [("split_statements", "text"), ("passages_of", "markup")])
def test_long_batches_are_cut_in_pieces(monkeypatch, name, module):
    import importlib

    import pyarrow as pa

    module, text = importlib.import_module(f"curator.functions.{module}"), importlib.import_module("curator.functions.text")
    udf = getattr(module, name).func
    rows = [None, "", " \n", "One. Two! Three", "# A\n\nfirst\n\n# B\n\nsecond. " + "word " * 900] * 60
    whole, seen = udf(pa.array(rows)), []
    make = pa.array
    monkeypatch.setattr(text, "_PIECE", 7)
    monkeypatch.setattr(text.pa, "array", lambda values, **kind: seen.append(len(values)) or make(values, **kind))
    assert udf(make(rows)).equals(whole) and max(seen) == 7 and sum(seen) == len(rows)
    assert udf(make([], pa.string())).to_pylist() == []
