"""URL identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curator.constants import IDENTITY_TRACKING_KEYS, TRACKING_KEYS
from curator.functions.expr import let

# RFC 3986 appendix B with a strict scheme: also splits what java.net.URI refuses
# (spaces, '|', hosts with '_').
URL_PARTS = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_url(c: Column | str) -> Column:
    """STRUCT<scheme, authority, path, query, fragment, host, port>; '' for absent parts.

    The host is lower case without credentials, port or IPv6 brackets.
    """

    def cut(text: Column) -> Column:
        part = lambda i: F.regexp_extract(text, URL_PARTS, i)
        return F.struct(
            F.lower(part(1)).alias("scheme"), part(2).alias("authority"), part(3).alias("path"),
            part(4).alias("query"), part(5).alias("fragment"),
        )

    def with_host(u: Column) -> Column:
        host = F.coalesce(
            F.nullif(F.regexp_extract(u["authority"], r"^(?:.*@)?\[([^\]]*)\]", 1), F.lit("")),
            F.regexp_extract(u["authority"], r"^(?:.*@)?([^:\[]*)", 1),
        )
        return F.struct(
            *[u[f].alias(f) for f in ("scheme", "authority", "path", "query", "fragment")],
            F.lower(host).alias("host"),
            F.regexp_extract(u["authority"], r"(?:^|[^:\]]|\]):([^:\]]*)$", 1).alias("port"),
        )

    clean = F.regexp_replace(_col(c), r"^[\x00-\x20]+|[\t\r\n]", "")
    return let(let(clean, cut), with_host)


def hostname(c: Column | str) -> Column:
    return split_url(c)["host"]


def _decode(c: Column) -> Column:
    # A broken percent escape is kept as it stands.
    return F.coalesce(F.try_url_decode(c), c)


def _decode_path(c: Column) -> Column:
    return _decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def clean_query(query: Column, tracking: tuple[str, ...]) -> Column:
    """Decode, drop tracking keys, sort by (key, value), encode again."""

    def pair(piece: Column) -> Column:
        key = F.regexp_extract(piece, r"^([^=]*)", 1)
        value = F.regexp_extract(piece, r"(?s)^[^=]*=(.*)$", 1)
        return F.struct(_decode(key).alias("k"), _decode(value).alias("v"))

    pieces = F.filter(F.split(query, "&", -1), lambda p: p != "")
    pairs = F.filter(
        F.transform(pieces, pair),
        lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(*tracking),
    )
    return F.array_join(
        F.transform(F.array_sort(pairs), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))),
        "&",
    )


def _with_query(base: Column, query: Column) -> Column:
    """base?query, or base alone: neither part can hold a bare '?'."""
    return F.regexp_replace(F.concat(base, F.lit("?"), query), r"\?$", "")


def normalize_url(c: Column | str) -> Column:
    """Comparison URL: lower scheme and authority, no fragment or tracking data."""

    def build(u: Column) -> Column:
        path = F.when(u["path"] == "/", u["path"]).otherwise(F.regexp_replace(u["path"], r"/+$", ""))
        site = F.when(
            u["authority"] != "",
            F.concat(F.lit("//"), F.lower(u["authority"]), F.regexp_replace(path, r"^(?=[^/])", "/")),
        ).otherwise(path)
        return _with_query(
            F.concat(F.when(u["scheme"] != "", F.concat(u["scheme"], F.lit(":"))).otherwise(""), site),
            clean_query(u["query"], TRACKING_KEYS),
        )

    return let(split_url(F.coalesce(_col(c), F.lit(""))), build)


def _acceptable(u: Column, raw: Column) -> Column:
    port = u["port"]
    return F.coalesce(
        u["scheme"].isin("http", "https")
        & (u["host"] != "")
        & ~F.contains(u["authority"], F.lit("@"))
        & ~raw.rlike(r"(?U)\s")
        & port.rlike(r"^[0-9]*$")
        & (F.coalesce(port.try_cast("int"), F.lit(0)) <= 65535),
        F.lit(False),
    )


#: Valid without a closer look: a plain host, no port or credentials, visible ASCII only.
_PLAIN_HTTP = r"^https?://[A-Za-z0-9.\-]+(?:[/?#][\x21-\x7E]*)?\z"


def is_http_url(c: Column | str) -> Column:
    """http(s), with a host, no credentials, no whitespace, a valid port."""
    return F.when(_col(c).rlike(_PLAIN_HTTP), True).otherwise(let(split_url(c), lambda u: _acceptable(u, _col(c))))


def _identity(u: Column, kind: Column) -> Column:
    is_hub = u["host"].isin("github.com", "www.github.com")
    whole = kind.isin("reading", "news")
    port = u["port"].try_cast("int")
    shown_port = F.when(
        (port > 0)
        & ~((u["scheme"] == "https") & (port == 443))
        & ~((u["scheme"] == "http") & (port == 80)),
        F.concat(F.lit(":"), port.cast("string")),
    ).otherwise("")
    host = F.when(F.contains(u["host"], F.lit(":")), F.concat(F.lit("["), u["host"], F.lit("]"))).otherwise(u["host"])
    web = _with_query(
        F.concat(
            u["scheme"], F.lit("://"), host, shown_port,
            F.when(u["path"] == "", F.lit("/")).otherwise(u["path"]),
        ),
        clean_query(u["query"], IDENTITY_TRACKING_KEYS),
    )

    def hub(pieces: Column) -> Column:
        owner = F.lower(F.get(pieces, 0))
        repo = F.lower(F.regexp_replace(F.get(pieces, 1), r"(?i)\.git$", ""))
        below = F.slice(pieces, 3, F.greatest(F.size(pieces) - 2, F.lit(0)))
        page = _with_query(
            F.concat(
                F.when(shown_port == "", F.lit("https")).otherwise(u["scheme"]),
                F.lit("://github.com"), shown_port, F.lit("/"),
                F.array_join(F.concat(F.array(owner, repo), below), "/"),
            ),
            clean_query(u["query"], IDENTITY_TRACKING_KEYS),
        )
        project = F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo)
        return F.when((F.size(pieces) >= 2) & (repo != ""), F.when(whole, page).otherwise(project))

    pieces = F.filter(F.split(u["path"], "/"), lambda p: p != "")
    return F.when(is_hub, let(pieces, hub)).otherwise(web)


def canonical_url(c: Column | str, kind: Column | str = "project") -> Column:
    """Identity URL; null where the URL is not an acceptable identity.

    Repository pages on github.com collapse to lower `owner/repo` for projects
    and updates; readings and news keep the path below the repository.
    """
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return let(split_url(c), lambda u: F.when(_acceptable(u, _col(c)), _identity(u, kind)))


def event_url(c: Column | str) -> Column:
    """Reading identity that keeps the fragment: an anchor names the event."""
    return let(
        split_url(c),
        lambda u: F.when(
            _acceptable(u, _col(c)),
            F.regexp_replace(
                F.concat(_identity(u, F.lit("reading")), F.lit("#"), u["fragment"]), r"#$", ""
            ),
        ),
    )


def publisher(c: Column | str) -> Column:
    """Host without a leading `www.`, null unless http(s)."""
    return let(
        split_url(c),
        lambda u: F.when(
            u["scheme"].isin("http", "https") & (u["host"] != ""), F.regexp_replace(u["host"], r"^www\.", "")
        ),
    )


# Private, reserved and documentation IPv4 and IPv6 ranges, as host patterns.
_PRIVATE_V4 = (
    r"^(?:0|10|127)\.|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^169\.254\.|^172\.(?:1[6-9]|2\d|3[01])\.|"
    r"^192\.168\.|^192\.0\.[02]\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^2(?:4\d|5[0-5])\."
)
_LITERAL_V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"
_PRIVATE_V6 = r"^(?:::1?$|::ffff:|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|2001:db8:|100::|64:ff9b:1:)"


def is_public_url(c: Column | str) -> Column:
    """An http(s) URL whose host is not local, internal or a private literal address."""
    return let(
        split_url(c),
        lambda u: _acceptable(u, _col(c))
        & (u["host"] != "localhost")
        & ~u["host"].rlike(r"\.(?:localhost|local|internal)$")
        & ~(u["host"].rlike(_LITERAL_V4) & u["host"].rlike(_PRIVATE_V4))
        & ~u["host"].rlike(_PRIVATE_V6),
    )


def fold_dots(path: Column) -> Column:
    """An absolute path with its '.' and '..' segments folded, however many; '..' at the root is dropped."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    # The first part is the empty text before the root.
    folded = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), step)
    closed = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.concat(F.lit("/"), F.array_join(closed, "/"))


def resolve_url(base: Column, link: Column) -> Column:
    """Join a possibly relative link to its page URL; dots are folded in the path, not in a query or fragment."""

    def join(u: Column) -> Column:
        root = F.concat(u["scheme"], F.lit("://"), u["authority"])
        folder = F.regexp_replace(u["path"], r"[^/]*$", "")
        path, tail = F.regexp_extract(link, r"^[^?#]*", 0), F.regexp_extract(link, r"[?#].*$", 0)
        whole = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)
        return (
            F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
            .when(link.startswith("//"), F.concat(u["scheme"], F.lit(":"), link))
            .when(link.startswith("/"), F.concat(root, fold_dots(path), tail))
            .when(link.rlike("^[#?]"), F.concat(root, u["path"], link))
            .when(link == "", base)
            .otherwise(F.concat(root, fold_dots(whole), tail))
        )

    return let(split_url(base), join)


def _path_pieces(u: Column) -> Column:
    return F.transform(F.filter(F.split(u["path"], "/"), lambda p: p != ""), _decode_path)


def classify_repo_url(c: Column | str) -> Column:
    """STRUCT<kind, repository, ref> of a public repository page, null if unsupported."""

    def of(u: Column, pieces: Column) -> Column:
        owner = F.get(pieces, 0)
        repo = F.regexp_replace(F.get(pieces, 1), r"\.git$", "")
        tail = F.array_join(F.slice(pieces, 3, F.greatest(F.size(pieces) - 2, F.lit(0))), "/")
        kind = (
            F.when(F.size(pieces) == 2, F.lit("repository"))
            .when(tail.rlike(r"^releases/tag/."), F.lit("release"))
            .when(tail.rlike(r"^pull/\d+$"), F.lit("pull"))
            .when(tail.rlike(r"^issues/\d+$"), F.lit("issue"))
            .when(tail.rlike(r"^tree/."), F.lit("tree"))
        )
        ref = F.nullif(F.regexp_extract(tail, r"^(?:releases/tag|pull|issues|tree)/(.*)$", 1), F.lit(""))
        supported = (
            (u["scheme"] == "https") & (F.lower(u["authority"]) == "github.com")
            & (u["query"] == "") & (u["fragment"] == "")
            & owner.rlike(r"^[A-Za-z0-9_.-]+$") & repo.rlike(r"^[A-Za-z0-9_.-]+$")
        )
        return F.when(
            supported & kind.isNotNull(),
            F.struct(kind.alias("kind"), F.concat(owner, F.lit("/"), repo).alias("repository"), ref.alias("ref")),
        )

    return let(split_url(F.trim(_col(c))), lambda u: let(_path_pieces(u), lambda p: of(u, p)))


def release_tag(url: Column, entry_id: Column) -> Column:
    """Tag from the release URL, else the last segment of the entry id, else ''."""
    from_url = F.regexp_replace(
        _decode_path(F.regexp_extract(split_url(url)["path"], r"/releases/tag/(.*)$", 1)), r"^/+|/+$", ""
    )
    return (
        F.when(F.contains(url, F.lit("/releases/tag/")), from_url)
        .when(F.contains(entry_id, F.lit("/")), _decode_path(F.substring_index(entry_id, "/", -1)))
        .otherwise("")
    )


def pinned_blob_path(c: Column | str, repository: Column, commit_sha: Column) -> Column:
    """Path of a file page pinned to one commit of one repository, else null."""

    def of(u: Column, pieces: Column) -> Column:
        head = F.concat_ws("/", F.lower(F.get(pieces, 0)), F.lower(F.get(pieces, 1)), F.get(pieces, 2), F.get(pieces, 3))
        path = F.array_join(F.slice(pieces, 5, F.greatest(F.size(pieces) - 4, F.lit(0))), "/")
        pinned = (
            (u["scheme"] == "https") & (u["host"] == "github.com") & (u["query"] == "") & (u["fragment"] == "")
            & (head == F.concat_ws("/", F.lower(repository), F.lit("blob"), commit_sha))
            & (path != "") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")
        )
        return F.when(pinned, path)

    return let(split_url(F.trim(_col(c))), lambda u: let(_path_pieces(u), lambda p: of(u, p)))
