"""Repository paths: safety, purpose and reading preference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parts(c: Column | str) -> Column:
    return F.split(_col(c), "/")


def file_name(c: Column | str) -> Column:
    return F.substring_index(_col(c), "/", -1)


def suffix(c: Column | str) -> Column:
    """'.md' of 'a/b.md'; '' for no dot or a leading dot only."""
    return F.regexp_extract(file_name(c), r"^.+(\.[^.]+)$", 1)


def stem(c: Column | str) -> Column:
    name = file_name(c)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(c)))


def is_safe_path(c: Column | str) -> Column:
    """A relative repository path that cannot leave its root."""
    c = _col(c)
    return F.coalesce(
        (c != "") & ~c.rlike(r"[\\:\x00]") & ~c.startswith("/")
        & ~F.exists(parts(c), lambda p: p.isin("", ".", "..")),
        F.lit(False),
    )


def is_sensitive_path(c: Column | str) -> Column:
    """Paths that may hold credentials are never read."""
    c = _col(c)
    return F.exists(parts(c), lambda p: F.lower(p).startswith(".env")) | c.rlike(
        r"(?i)(?:^|[/_.-])(?:auth|credentials|secrets?|tokens?)(?:[/_.-]|$)"
    )


# Document names by purpose.
_TEXT_SUFFIXES = (".md", ".mdx", ".rst", ".txt", ".adoc")
_INSTALL_NAMES = ("install", "installation", "setup", "getting-started", "get-started")
_USAGE_NAMES = (
    "usage", "guide", "user-guide", "tutorial", "tutorials", "examples", "quickstart", "quick-start",
)
_DOC_ROOTS = ("docs", "doc", "documentation", "examples")
_DOC_FOLDERS = ("docs", "doc", "documentation", "help", "website")
_PAGE_SUFFIXES = _TEXT_SUFFIXES + (".html", ".htm")


def doc_purpose(c: Column | str, profile: str = "basic") -> Column:
    """Question a repository document answers; null when it answers none.

    The 'discovery' profile also knows user pages kept in documentation folders.
    """
    c = _col(c)
    name = F.lower(file_name(c))
    tail = suffix(name)
    key = F.regexp_replace(stem(name), r"[_ ]+", "-")
    licensed = name.rlike(r"^(?:licen[sc]e|copying)(?:[._-][a-z0-9_-]+)*$") & (
        tail.isin("", ".txt", ".md", ".rst", ".adoc")
    )
    basic = (
        F.when(licensed, F.lit("license"))
        .when(~tail.isin(*_TEXT_SUFFIXES), F.lit(None))
        .when(key.isin(*_INSTALL_NAMES), F.lit("installation"))
        .when(key.isin(*_USAGE_NAMES), F.lit("usage"))
        .when(key.isin("readme", "index") & F.get(parts(F.lower(c)), 0).isin(*_DOC_ROOTS), F.lit("usage"))
    )
    if profile == "basic":
        return basic
    folders = F.slice(parts(F.lower(c)), 1, F.greatest(F.size(parts(c)) - 1, F.lit(0)))
    compact = F.regexp_replace(stem(name), r"[_ -]+", "")
    page = tail.isin(*_PAGE_SUFFIXES) & F.arrays_overlap(folders, F.array(*[F.lit(f) for f in _DOC_FOLDERS]))
    return F.coalesce(
        basic,
        F.when(page & compact.rlike(r"(?:gettingstarted|quickstart|userguide|usage|faq)$"), F.lit("usage")).when(
            page & compact.isin("overview", "features", "index"), F.lit("overview")
        ),
    )


def preference_key(c: Column | str, purpose: Column, profile: str = "basic") -> Column:
    """Sort key of candidate documents: concrete and shallow first."""
    c = _col(c)
    name = F.lower(file_name(c))
    depth = F.size(parts(c))
    if profile == "basic":
        generic = F.lower(stem(c)).isin("index", "readme")
        first = ~name.isin("license", "license.md", "license.txt")
        return F.struct(generic.alias("a"), depth.alias("b"), first.alias("c"), F.lower(c).alias("d"), c.alias("e"))
    priority = (
        F.when((purpose == "license") & (depth == 1), 0)
        .when(purpose.isin("usage", "overview"), 1)
        .when(purpose == "installation", 2)
        .otherwise(3)
    )
    generic = F.lower(stem(c)).isin("index", "_index", "readme")
    return F.struct(priority.alias("a"), generic.alias("b"), depth.alias("c"), F.lower(c).alias("d"), c.alias("e"))
