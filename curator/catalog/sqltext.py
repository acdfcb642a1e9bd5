"""Shared SQL fragments of the DuckDB side."""

from curator.constants import IDENTITY_TRACKING_KEYS, TRACKING_KEYS

URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: str, n: int) -> str:
    return f"regexp_extract({url}, '{URL}', {n})"


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def clean_query(q: str, keys) -> str:
    pairs = (
        f"list_transform(list_filter(string_split({q}, '&'), lambda x: x <> ''), lambda x: "
        "{'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), "
        "'v': url_decode(replace(case when instr(x, '=') > 0 then substr(x, instr(x, '=') + 1) else '' end, '+', ' '))})"
    )
    kept = (
        f"list_sort(list_filter({pairs}, lambda z: not starts_with(lower(z.k), 'utm_') "
        f"and lower(z.k) not in ({quoted(keys)})))"
    )
    enc = lambda v: f"replace(replace(url_encode({v}), '%20', '+'), '*', '%2A')"
    return f"array_to_string(list_transform({kept}, lambda z: {enc('z.k')} || '=' || {enc('z.v')}), '&')"


def normalize_url(u: str) -> str:
    q = clean_query(part(u, 4), TRACKING_KEYS)
    p = part(u, 3)
    return (
        f"(lower({part(u, 1)}) || '://' || lower({part(u, 2)}) || "
        f"case when {p} = '/' then {p} else regexp_replace({p}, '/+$', '') end || "
        f"case when {q} <> '' then '?' || {q} else '' end)"
    )


def canonical_reading(u: str) -> str:
    """Identity of a plain web page (no default ports or repositories in the tables)."""
    q = clean_query(part(u, 4), IDENTITY_TRACKING_KEYS)
    p = part(u, 3)
    return (
        f"(lower({part(u, 1)}) || '://' || lower({part(u, 2)}) || case when {p} = '' then '/' else {p} end || "
        f"case when {q} <> '' then '?' || {q} else '' end)"
    )


def event_url(u: str) -> str:
    f = part(u, 5)
    return f"({canonical_reading(u)} || case when {f} <> '' then '#' || {f} else '' end)"


def unescape(x: str) -> str:
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                        ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{value}')"
    return x


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def normalize_title(x: str) -> str:
    return collapse(rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g')")


def features(x: str) -> str:
    """Distinct ASCII tokens; the tables hold no CJK text."""
    return f"list_distinct(list_transform(regexp_extract_all({normalize_title(x)}, '[a-z0-9]+'), lambda t: 'ascii:' || t))"


TITLE = unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")
