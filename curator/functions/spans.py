"""Half-open character ranges held in arrays of STRUCT<start, end>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPANS = "array<struct<start:int,end:int>>"
_SPAN_TYPE = T.ArrayType(
    T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _span(a: Column, b: Column) -> Column:
    return F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))


def _let(value: Column, use) -> Column:
    """`use(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def merge_ranges(ranges: Column | str) -> Column:
    """Sorted disjoint union; touching ranges join, empty ranges vanish.

    A sweep over sorted starts and sorted ends: a merged range begins at the i-th start if all i ranges before it have
    ended, that is if it lies beyond the i-th end. Linear after the sorts.
    """
    solid = F.filter(_col(ranges), lambda r: r["end"] > r["start"])
    sides = _let(solid, lambda given: F.struct(
        F.array_sort(F.transform(given, lambda r: r["start"])).alias("a"), F.array_sort(F.transform(given, lambda r: r["end"])).alias("b")))

    def union(s: Column) -> Column:
        low = F.filter(s["a"], lambda x, i: (i == 0) | (x > F.get(s["b"], i - 1)))
        high = F.filter(s["b"], lambda x, i: F.coalesce(F.get(s["a"], i + 1) > x, F.lit(True)))
        return F.zip_with(low, high, _span)

    return _let(sides, union)


#: Elements that one step of a running sum handles.
_STEP = 256


def running_sums(lengths: Column | str) -> Column:
    """The sum of all elements before each element of an int array.

    Blocks of `_STEP` elements are summed by themselves and moved by the sums of the blocks before, so no step copies more
    than a block.
    """
    def sums(values: Column, zero: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            values, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])

    def blocks(values: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(_STEP))
        return F.transform(firsts, lambda i: F.slice(values, i, F.lit(_STEP)))

    def moved(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + x))
        return _let(sums(totals, F.lit(0)), lambda before: F.flatten(F.transform(parts, lambda p, i: sums(p, F.get(before, i)))))

    return _let(F.transform(_col(lengths), lambda x: x.cast("int")), lambda v: _let(blocks(v), moved))


def covered(ranges: Column | str) -> Column:
    """Characters covered by disjoint ranges."""
    return F.aggregate(_col(ranges), F.lit(0), lambda n, r: n + r["end"] - r["start"])


def supplied_segments(ranges: Column | str) -> Column:
    """Where each original range lies in an excerpt joined by two newlines."""
    def placed(given: Column) -> Column:
        starts = running_sums(F.transform(given, lambda r: r["end"] - r["start"] + 2))
        return F.zip_with(given, starts, lambda r, at: F.struct(
            at.cast("int").alias("supplied_start"), (at + r["end"] - r["start"]).cast("int").alias("supplied_end"), r["start"].cast("int").alias("original_start")))

    return _let(_col(ranges), placed)


def _before(values: Column, limit: Column) -> Column:
    """How many elements of an ascending array are at most `limit`, by halving."""
    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(values).cast("bigint"))))
    start = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        within = F.get(values, mid) <= limit
        return F.when(s["low"] >= s["high"], s).when(
            within, F.struct((mid + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), mid.alias("high")))

    return F.aggregate(steps, start, halve, lambda s: s["low"])


def remap(ranges: Column | str, segments: Column | str) -> Column:
    """Ranges of the supplied text expressed in the original document.

    Each merged range meets only the segments that it overlaps, found by halving.
    """
    def cut(x: Column) -> Column:
        def pieces(r: Column) -> Column:
            first, last = _before(x["ends"], r["start"]), _before(x["starts"], r["end"] - 1)
            return F.transform(F.slice(x["segments"], first + 1, F.greatest(last - first, F.lit(0))), lambda s: _span(
                s["original_start"] + F.greatest(r["start"], s["supplied_start"]) - s["supplied_start"],
                s["original_start"] + F.least(r["end"], s["supplied_end"]) - s["supplied_start"]))

        return F.flatten(F.transform(x["ranges"], pieces))

    bound = F.struct(merge_ranges(ranges).alias("ranges"), _col(segments).alias("segments"))
    ends = lambda x: F.transform(x["segments"], lambda s: s["supplied_end"])
    starts = lambda x: F.transform(x["segments"], lambda s: s["supplied_start"])
    return merge_ranges(_let(_let(bound, lambda x: F.struct(
        x["ranges"].alias("ranges"), x["segments"].alias("segments"), starts(x).alias("starts"), ends(x).alias("ends"))), cut))


def scope_violations(
    coverage: Column, document_chars: Column, supplied_chars: Column, ranges: Column,
    document_sha256: Column, supplied_text: Column,
) -> Column:
    """Codes of every rule a source-scope record breaks."""
    size = F.size(ranges)
    index = F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1)))
    disordered = F.exists(ranges, lambda r: (r["end"] <= r["start"]) | (r["start"] < 0)) | (
        (size > 1) & F.exists(index, lambda i: F.get(ranges, i)["start"] < F.get(ranges, i - 1)["end"])
    )
    gap = (
        (F.coalesce(F.get(ranges, 0)["start"], F.lit(-1)) != 0)
        | (F.coalesce(F.try_element_at(ranges, F.lit(-1))["end"], F.lit(-1)) != document_chars)
        | ((size > 1) & F.exists(index, lambda i: F.get(ranges, i)["start"] != F.get(ranges, i - 1)["end"]))
    )
    # A document without a single character has no range to show.
    gap = gap & ~((size == 0) & (document_chars == 0))
    rules = {
        "coverage_unknown_value": ~coverage.isin("complete_text", "excerpt", "unknown"),
        "supplied_exceeds_document": supplied_chars > document_chars,
        "supplied_count_differs": supplied_chars != F.length(supplied_text),
        "hash_malformed": ~document_sha256.rlike(r"^[0-9a-f]{64}$"),
        "ranges_disordered": disordered,
        "range_exceeds_document": F.exists(ranges, lambda r: r["end"] > document_chars),
        "ranges_exceed_supplied": (size > 0) & (covered(ranges) > supplied_chars),
        "excerpt_without_ranges": (coverage == "excerpt") & (supplied_chars > 0) & (size == 0),
        "complete_count_differs": (coverage == "complete_text")
        & (document_chars.isNull() | (document_chars != supplied_chars)),
        "complete_has_gap": (coverage == "complete_text") & gap,
        "complete_hash_differs": (coverage == "complete_text") & (document_sha256 != F.sha2(supplied_text, 256)),
    }
    return F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]))


# The metadata fields quoted as evidence.
METADATA_KEYS = ("name", "full_name", "description", "homepage")

# Tokens of a JSON text with the white space after them, so that their lengths add up to positions.
_JSON_TOKENS = r"""(?s)(?:"(?:[^"\\]++|\\.)*+"|[{}\[\]:,]|[^\s"{}\[\]:,]++|^)\s*+"""
_BLANK_STRING = r"""^"(?:\s|\\[tnrf]|\\u(?:0020|0009|000[aAdD]|00[aA]0))*"$"""


def json_field_ranges(c: Column | str, keys: tuple[str, ...] = METADATA_KEYS) -> Column:
    """Character ranges of selected top-level members with a non-blank string; null if not an object.

    A fold over the tokens keeps the position, the depth and the member name that stands open at depth 1.
    """
    c = _col(c)
    wanted = F.array(*[F.lit(k) for k in keys])
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(-1).alias("since"), F.lit(False).alias("named"), F.array().cast(_SPAN_TYPE).alias("found"))

    def step(s: Column, token: Column) -> Column:
        mark = F.rtrim(F.regexp_replace(token, r"\s+$", ""))
        depth = s["depth"] + F.when(mark.isin("{", "["), 1).when(mark.isin("}", "]"), -1).otherwise(0)
        text = mark.startswith('"')
        top = (s["depth"] == 1) & (depth == 1)
        value = top & text & s["named"]
        opens = top & text & ~s["named"] & (s["since"] < 0)
        known = F.array_contains(wanted, F.get(F.from_json(F.concat(F.lit("["), mark, F.lit("]")), "array<string>"), 0))
        span = F.struct(s["since"].alias("start"), (s["at"] + F.length(mark)).alias("end"))
        kept = value & (s["since"] >= 0) & ~mark.rlike(_BLANK_STRING)
        return F.struct(
            (s["at"] + F.length(token)).alias("at"), depth.alias("depth"),
            # -2 stands for a member that is not wanted, -1 for none.
            F.when(opens & known, s["at"]).when(opens, -2).when(top & (mark == ","), -1).otherwise(s["since"]).alias("since"),
            F.when(top & (mark == ":"), True).when(top & (mark == ","), False).otherwise(s["named"]).alias("named"),
            F.when(kept, F.concat(s["found"], F.array(span).cast(_SPAN_TYPE))).otherwise(s["found"]).alias("found"))

    found = F.aggregate(F.regexp_extract_all(c, F.lit(_JSON_TOKENS), F.lit(0)), start, step, lambda s: s["found"])
    return F.when(c.rlike(r"^\s*\{") & F.try_parse_json(c).isNotNull(), found)
