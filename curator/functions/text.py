"""Text normalisation, features and excerpts as column expressions."""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)\s+"
# Characters on which NFKC is the identity, so that only other text leaves the JVM:
# ASCII, Latin letters with precomposed accents, kana and common CJK ideographs.
NFKC_STABLE = r"^[\x00-\x7F\u00C0-\u0131\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF]*$"
# An '&' that does not start one of the five entities replaced inside the JVM.
RARE_ENTITY = r"&(?!(?:amp|lt|gt|quot|#39);)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Values whose results are Python objects at one time.
_PIECE = 100


def by_pieces(values: pa.Array, function, kind: T.DataType) -> pa.Array:
    """`function` of every value that isn't null; only results of a few values are Python objects, the others are in Arrow already."""
    from pyspark.sql.pandas.types import to_arrow_type

    of = to_arrow_type(kind)
    done = [
        pa.array([None if v is None else function(v) for v in values.slice(i, _PIECE).to_pylist()], type=of)
        for i in range(0, len(values), _PIECE)]
    return pa.concat_arrays(done) if done else pa.array([], type=of)


@F.arrow_udf(T.StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    return by_pieces(values, lambda v: unicodedata.normalize("NFKC", v), T.StringType())


@F.arrow_udf(T.StringType())
def _unescape(values: pa.Array) -> pa.Array:
    return by_pieces(values, html.unescape, T.StringType())


def nfkc(c: Column | str) -> Column:
    c = _col(c)
    # Stable text travels to Python as null, not as text.
    return F.coalesce(_nfkc(F.when(~c.rlike(NFKC_STABLE), c)), c)


def unescape(c: Column | str) -> Column:
    """HTML character references to characters, once."""
    c = _col(c)
    common = c
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        common = F.replace(common, F.lit(name), F.lit(value))
    return F.coalesce(_unescape(F.when(c.rlike(RARE_ENTITY), c)), common)


def collapse(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(c), SPACE, " "), r"^ | $", "")


def normalize_title(c: Column | str) -> Column:
    """NFKC, lower case, letters and digits only, single spaces."""
    return collapse(F.regexp_replace(F.lower(nfkc(c)), r"(?U)[^\p{L}\p{N}\s]", " "))


def normalize_evidence(c: Column | str) -> Column:
    return collapse(nfkc(unescape(F.coalesce(_col(c), F.lit("")))))


def plain_text(c: Column | str, limit: int | None = None) -> Column:
    """Text without tags or references, single spaces, at most `limit` characters."""
    text = collapse(unescape(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"<[^>]+>", " ")))
    return text if limit is None else F.substring(text, 1, limit)


def title_features(c: Column | str) -> Column:
    """Distinct ASCII tokens and CJK bigrams (a lone CJK character is kept)."""
    # The runs looked for are broken by everything that normalisation blanks out.
    title = F.lower(nfkc(c))
    tokens = F.transform(
        F.array_distinct(F.regexp_extract_all(title, F.lit(r"([a-z0-9]+)"), F.lit(1))),
        lambda t: F.concat(F.lit("ascii:"), t),
    )
    runs = F.array_distinct(F.regexp_extract_all(title, F.lit(r"([\u3400-\u4dbf\u4e00-\u9fff]+)"), F.lit(1)))
    grams = F.flatten(
        F.transform(
            runs,
            lambda run: F.when(F.length(run) == 1, F.array(F.concat(F.lit("cjk:"), run))).otherwise(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))),
                    lambda i: F.concat(F.lit("cjk:"), F.substring(run, i, F.lit(2))),
                )
            ),
        )
    )
    return F.concat(tokens, F.array_distinct(grams))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Share of common features; 0 where either side has none."""
    a, b = _col(a), _col(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def has_term(c: Column | str, terms) -> Column:
    """Does the lower-case text contain any of the terms?"""
    lowered = F.lower(_col(c))
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(lowered, F.lit(term.lower()))
    return found


def extract_urls(c: Column | str) -> Column:
    """Distinct URLs of a free text, trailing '.' and ';' trimmed."""
    stop = "\\s<>\"'`，。；！？、（）\\[\\](),"
    pattern = (
        rf"(?i)(https?://[^{stop}]+|(?<![\w./@:-])(?:www\.)?github\.com/[^\s<>，。；！？、（）\[\](),]+)"
    )
    found = F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(1))
    trimmed = F.transform(found, lambda u: F.regexp_replace(u, r"[.;]+$", ""))
    return F.array_distinct(
        F.transform(trimmed, lambda u: F.when(F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit("https://"), u)))
    )


def clean_categories(c: Column | str) -> Column:
    """Collapsed, distinct, non-blank names in case-insensitive order."""
    names = F.array_distinct(F.filter(F.transform(_col(c), collapse), lambda n: n != ""))
    keyed = F.array_sort(F.transform(names, lambda n: F.struct(F.lower(n).alias("k"), n.alias("v"))))
    return F.transform(keyed, lambda x: x["v"])


def quote_span(text: Column | str, quote: Column | str) -> Column:
    """Half-open code point range of the first occurrence, null when absent."""
    text, quote = _col(text), _col(quote)
    at = F.position(quote, text)
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(quote)).alias("end")))


def excerpt_ranges(text: Column | str, limit: Column | int, keywords: Column) -> Column:
    """Ranges of an excerpt of `limit` characters around the first keyword hit.

    The opening part is always kept; without a later hit the excerpt is a prefix.
    """
    text = _col(text)
    limit = F.lit(limit) if isinstance(limit, int) else limit
    lowered = F.lower(text)
    size = F.length(text)
    prefix = F.least(F.lit(2048), F.floor(limit / 2).cast("int"))
    remaining = limit - prefix - 2
    hits = F.transform(keywords, lambda k: F.position(F.lower(k), lowered, prefix + 1))
    centre = F.array_min(F.filter(hits, lambda h: h > 0)) - 1
    start = F.greatest(
        prefix,
        F.least(centre - F.least(F.lit(200), F.floor(remaining / 4).cast("int")), size - remaining),
    )
    one = lambda a, b: F.array(F.struct(F.lit(a).cast("int").alias("start"), b.cast("int").alias("end")))
    windowed = F.concat(
        one(0, prefix),
        F.array(F.struct(start.cast("int").alias("start"), (start + remaining).cast("int").alias("end"))),
    )
    return (
        F.when(size <= limit, one(0, size))
        .when((limit < 4) | centre.isNull() | (remaining <= 0) | (start == prefix), one(0, limit))
        .otherwise(windowed)
    )


# Fixed value: keywords of a record that are searched for.
KEYWORDS = 12


def record_keywords(title: Column, url: Column, most: int | None = KEYWORDS) -> Column:
    """Title, its Latin words and the last URL path segment: the first `most` different ones, or all (None)."""
    from curator.functions.urls import split_url

    title = F.trim(F.coalesce(title, F.lit("")))
    words = F.regexp_extract_all(title, F.lit(r"([A-Za-z][A-Za-z0-9+._-]{2,})"), F.lit(1))
    last = F.substring_index(F.regexp_replace(split_url(url)["path"], r"/+$", ""), "/", -1)
    skip = ("the", "and", "with", "for", "com", "www", "index", "readme", "html")  # fixed values
    every = F.concat(
        F.when(F.length(title) >= 3, F.array(title)).otherwise(F.array().cast("array<string>")),
        words,
        F.when(F.length(last) >= 3, F.array(last)).otherwise(F.array().cast("array<string>")),
    )
    found = F.array_distinct(F.filter(every, lambda w: ~F.lower(w).isin(*skip)))
    return found if most is None else F.slice(found, 1, most)


def route_overview(c: Column | str) -> Column:
    """Which question an overview document should answer first."""
    c = _col(c)
    return (
        F.when(c.rlike(r"(?i)AppWizard has created|MICROSOFT FOUNDATION CLASS LIBRARY"), F.lit("generated_application_template"))
        .when((F.length(c) <= 2000) & c.rlike(r"(?i)source[_ ]code|\bdevelopment\b|\bbuilding\b"), F.lit("short_source_development_entry"))
        .otherwise("repository_overview")
    )


_STATEMENT_END = re.compile(
    r"""(?:[。！？!?；;\r\n]|\.(?=$|\s|[”’」』》）》)\]}"']))[”’」』》）》)\]}"'。！？!?；;\r\n.\s]*"""
)


def _statements(text: str) -> list[dict]:
    cuts = [0, *(m.end() for m in _STATEMENT_END.finditer(text)), len(text)]
    parts: list[str] = []
    lead = ""
    for a, b in zip(cuts, cuts[1:]):
        piece = text[a:b]
        if piece.strip():
            parts.append(lead + piece)
            lead = ""
        elif parts:
            parts[-1] += piece
        else:
            lead += piece
    return [{"id": f"s{i}", "text": part} for i, part in enumerate(parts)]


_STATEMENTS = T.ArrayType(
    T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])
)


@F.arrow_udf(_STATEMENTS)
def split_statements(values: pa.Array) -> pa.Array:
    """Sentences of a text; joined in order they give back the text."""
    return by_pieces(values, lambda v: _statements(v) if v.strip() else None, _STATEMENTS)
