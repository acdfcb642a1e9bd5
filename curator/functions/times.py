"""Timestamps, publication dates, natural periods and event bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curator.constants import DUE_HOURS, LOCAL_HOURS
from curator.functions.expr import let, regex_groups

# Month abbreviations and the zone names of RFC 2822.
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}
# The accepted forms of ISO 8601 and RFC 2822 times.
_ISO = (
    r"^(\d{4}-\d{2}-\d{2})(?:[Tt ](\d{2}:\d{2})(:\d{2})?(?:[.,](\d{1,9}))?)?"
    r"\s*([Zz]|[+-]\d{2}(?::?\d{2})?)?$"
)
_MAIL = (
    r"(?i)^(?:[a-z]{3,9},?\s+)?(\d{1,2})\s+([a-z]{3})[a-z]*\s+(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"
    r"(?:\s+([+-]\d{4}|[a-z]{1,3}))?$"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _instant(day: Column, clock: Column, zone: Column, naive: str) -> Column:
    """Instant of a civil date, clock and offset text ('' offset = naive)."""
    offset = F.when(F.upper(zone) == "Z", F.lit("+00:00")).when(
        zone == "", F.lit("+00:00") if naive == "utc" else F.lit(None).cast("string")
    ).otherwise(
        F.concat(F.substring(zone, 1, 3), F.lit(":"), F.when(F.length(zone) == 3, F.lit("00")).otherwise(F.right(zone, F.lit(2))))
    )
    return F.concat(day, F.lit(" "), clock, offset).try_cast("timestamp")


def _iso(c: Column, naive: str) -> Column:
    def build(p: Column) -> Column:
        seconds = F.when(p["g3"] == "", F.lit(":00")).otherwise(p["g3"])
        fraction = F.regexp_replace(F.concat(F.lit("."), F.substring(p["g4"], 1, 6)), r"^\.$", "")
        clock = F.when(p["g2"] == "", F.lit("00:00:00")).otherwise(F.concat(p["g2"], seconds, fraction))
        return F.when(p["g1"] != "", _instant(p["g1"], clock, p["g5"], naive))

    return let(regex_groups(c, _ISO, 5), build)


def _mail(c: Column, naive: str) -> Column:
    two = lambda x: F.lpad(x, 2, "0")

    def build(p: Column) -> Column:
        month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(p["g2"]))
        day = F.concat_ws("-", p["g3"], two(month.cast("string")), two(p["g1"]))
        clock = F.concat_ws(":", two(p["g4"]), p["g5"], F.when(p["g6"] == "", F.lit("00")).otherwise(p["g6"]))
        named = F.try_element_at(_literal_map(_ZONES), F.upper(p["g7"]))
        # An unknown zone name says nothing about the offset: naive.
        zone = F.when(p["g7"].rlike(r"^[+-]\d{4}$"), p["g7"]).otherwise(F.coalesce(named, F.lit("")))
        return F.when((p["g1"] != "") & (month > 0), _instant(day, clock, zone, naive))

    return let(regex_groups(c, _MAIL, 7), build)


_EPOCH = r"^[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"


def to_utc(c: Column | str, naive: str = "utc", keep_fraction: bool = False, epoch: bool = False) -> Column:
    """Tolerant timestamp: ISO 8601 or RFC 2822 text; unparsable text is null.

    `naive` says what a time without a zone means: 'utc', or 'null' for unknown.
    With `epoch`, a bare number is seconds since 1970, as in JSON payloads.
    """
    c = F.trim(_col(c))
    value = F.coalesce(_iso(c, naive), _mail(c, naive))
    if epoch:
        # Seconds beyond the calendar are no time.
        seconds = c.try_cast("double")
        value = F.when(c.rlike(_EPOCH), F.when(F.abs(seconds) < 253402300800, epoch_to_utc(seconds))).otherwise(value)
    return value if keep_fraction else F.date_trunc("second", value)


def epoch_to_utc(c: Column | str) -> Column:
    return F.timestamp_seconds(_col(c))


def iso_text(c: Column | str) -> Column:
    """`2024-01-31T08:00:00Z` form of an instant."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


# The accepted forms of a stated publication date.
_DATE_ONLY = r"^\d{4}-\d{2}-\d{2}$"
_STATED_ISO = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:[Zz]|[+-]\d{2}(?::?\d{2})?)$"
_ISO_THEN_UTC = r"(?i)^(\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s+(?:GMT|UTC)$"
_STATED_MAIL = r"(?i)\s(?:GMT|UTC|[+-]\d{4})$"


def parse_publication(c: Column | str) -> Column:
    """STRUCT<event_date, event_at, precision> of a stated publication date.

    A date keeps date precision, a clock needs a stated zone; anything else is
    null. No zone, midnight or refresh time is supplied for the source.
    """
    c = F.trim(_col(c))
    day = c.try_cast("date")
    moment = (
        F.when(c.rlike(_STATED_ISO), _iso(c, "null"))
        .when(c.rlike(_ISO_THEN_UTC), _iso(F.regexp_extract(c, _ISO_THEN_UTC, 1), "utc"))
        .when(c.rlike(_STATED_MAIL), _mail(c, "null"))
    )
    return F.when(
        c.rlike(_DATE_ONLY) & day.isNotNull(),
        F.struct(day.alias("event_date"), F.lit(None).cast("timestamp").alias("event_at"), F.lit("date").alias("precision")),
    ).when(
        ~c.rlike(_DATE_ONLY) & moment.isNotNull(),
        F.struct(F.lit(None).cast("date").alias("event_date"), moment.alias("event_at"), F.lit("timestamp").alias("precision")),
    )


# Fixed value: a time with its zone inside running text.
_STAMP = r"(\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:[Zz]|[+-]\d{2}(?::?\d{2})?)(?![\d:]))"
_LONG_MONTHS = (
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
)


def date_supported(event_date: Column | str, quote: Column | str, original: Column | None = None) -> Column:
    """Does the quotation state this date (or, for a timestamp, this instant)?

    A day is not supported by a text that gives the clock time: that would drop
    known precision.
    """
    event_date, quote = _col(event_date), _col(quote)
    stamps = F.regexp_extract_all(quote, F.lit(_STAMP), F.lit(1))
    two = lambda x: F.lpad(x, 2, "0")
    iso = F.regexp_extract_all(quote, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1))
    named_pattern = r"(?i)\b((?:" + "|".join(_LONG_MONTHS) + r")\s+\d{1,2},?\s+\d{4})\b"
    named = F.transform(
        F.regexp_extract_all(quote, F.lit(named_pattern), F.lit(1)),
        lambda m: F.concat_ws(
            "-",
            F.regexp_extract(m, r"(\d{4})$", 1),
            two(F.array_position(F.array(*[F.lit(x) for x in _LONG_MONTHS]), F.lower(F.regexp_extract(m, r"^([A-Za-z]+)", 1))).cast("string")),
            two(F.regexp_extract(m, r"^[A-Za-z]+\s+(\d{1,2})", 1)),
        ),
    )
    cjk = F.transform(
        F.regexp_extract_all(quote, F.lit(r"(\d{4}年\s*\d{1,2}月\s*\d{1,2}日)"), F.lit(1)),
        lambda m: F.concat_ws(
            "-",
            F.regexp_extract(m, r"^(\d{4})", 1),
            two(F.regexp_extract(m, r"年\s*(\d{1,2})", 1)),
            two(F.regexp_extract(m, r"月\s*(\d{1,2})", 1)),
        ),
    )
    tags = F.filter(
        F.regexp_extract_all(quote, F.lit(r"(?i)(<meta\b[^>]*>)"), F.lit(1)),
        lambda t: t.rlike(r"(?i)\bname\s*=\s*[\"']publication-date[\"']"),
    )
    numeric = r"(?i)\bcontent\s*=\s*[\"'](\d{2})-(\d{2})-(\d{4})[\"']"
    meta = F.transform(
        F.filter(tags, lambda t: F.coalesce(F.regexp_extract(t, numeric, 2).try_cast("int"), F.lit(0)) > 12),
        lambda t: F.concat_ws("-", F.regexp_extract(t, numeric, 3), F.regexp_extract(t, numeric, 1), F.regexp_extract(t, numeric, 2)),
    )
    day_stated = F.array_contains(F.concat(iso, named, cjk, meta), event_date)
    known_clock = F.size(stamps) > 0
    if original is not None:
        known_clock = known_clock | F.exists(
            F.regexp_extract_all(original, F.lit(_STAMP), F.lit(1)), lambda s: F.substring(s, 1, 10) == event_date
        )
    wanted = _iso(event_date, "null")
    instant_stated = F.exists(stamps, lambda s: _iso(s, "null") == wanted)
    return F.coalesce(
        F.when(event_date.rlike(_DATE_ONLY), ~known_clock & day_stated).otherwise(instant_stated), F.lit(False)
    )


def local_time(c: Column | str) -> Column:
    """Wall clock of the natural-period calendar (fixed UTC+8)."""
    return _col(c) + F.expr(f"INTERVAL {LOCAL_HOURS} HOURS")


def local_date(c: Column | str) -> Column:
    return F.to_date(local_time(c))


def _local_midnight(day: Column) -> Column:
    return day.cast("timestamp") - F.expr(f"INTERVAL {LOCAL_HOURS} HOURS")


def period_of(c: Column | str, ranking_type: str) -> Column:
    """Name of the natural period an instant falls into."""
    day = local_date(c)
    if ranking_type == "daily":
        return F.date_format(day, "yyyy-MM-dd")
    if ranking_type == "weekly":
        return F.date_format(F.date_trunc("week", day), "yyyy-MM-dd")
    return F.date_format(day, "yyyy-MM")


def period_window(period: Column | str, ranking_type: str) -> Column:
    """STRUCT<start_date, end_date, due_at>; null for a name that is no period."""
    period = _col(period)
    if ranking_type == "monthly":
        start = F.when(period.rlike(r"^\d{4}-\d{2}$"), F.concat(period, F.lit("-01")).try_cast("date"))
        end = F.last_day(start)
    else:
        start = F.when(period.rlike(_DATE_ONLY), period.try_cast("date"))
        if ranking_type == "weekly":
            start = F.when(F.weekday(start) == 0, start)
        end = F.date_add(start, 6 if ranking_type == "weekly" else 0)
    due = _local_midnight(F.date_add(end, 1)) + F.expr(f"INTERVAL {DUE_HOURS[ranking_type]} HOURS")
    return F.when(
        start.isNotNull(), F.struct(start.alias("start_date"), end.alias("end_date"), due.alias("due_at"))
    )


def period_bounds(start: Column, end: Column) -> tuple[Column, Column]:
    """Half-open instants of a closed local date range."""
    return _local_midnight(start), _local_midnight(F.date_add(end, 1))


def event_bounds(occurred_at: Column | str, occurred_on: Column | str) -> Column:
    """STRUCT<earliest, latest>: a point, or every instant a bare date can mean.

    A date without a zone spans the civil zones UTC+14 to UTC-12.
    """
    at, on = _col(occurred_at), _col(occurred_on)
    midnight = on.cast("timestamp")
    return (
        F.when(at.isNotNull(), F.struct(at.alias("earliest"), at.alias("latest")))
        .when(
            on.isNotNull(),
            F.struct(
                (midnight - F.expr("INTERVAL 14 HOURS")).alias("earliest"),
                (midnight + F.expr("INTERVAL 36 HOURS") - F.expr("INTERVAL 1 MICROSECOND")).alias("latest"),
            ),
        )
    )


def event_time_key(occurred_at: Column | str, occurred_on: Column | str) -> Column:
    """Identity of an event time that keeps its precision; not an ordering."""
    at, on = _col(occurred_at), _col(occurred_on)
    return F.when(at.isNotNull(), F.concat(F.lit("timestamp|"), F.unix_micros(at).cast("string"))).when(
        on.isNotNull(), F.concat(F.lit("date|"), on.cast("string"), F.lit("|date|unknown"))
    )


def event_in_period(occurred_at: Column, occurred_on: Column, start: Column, end: Column) -> Column:
    bounds = event_bounds(occurred_at, occurred_on)
    low, high = period_bounds(start, end)
    return (low <= bounds["earliest"]) & (bounds["latest"] < high)
