"""Running aggregates over long orders without a single-task window.

A plain window with few partition keys sends each group to one task, so a group
that holds a third of all rows (or a global order) does not scale. Here rows are
cut into balanced ranges of the *whole* sort key (group first, then order), the
running value is computed inside each range, and the carry into every range is
added from a tiny table. A group spans two ranges only where a range boundary
falls inside it, so that carry table has fewer than two rows per range whatever
the data looks like, which is why it may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SAMPLE_PER_RANGE = 16
# Rows of a range; for many rows both the number of ranges and their size grow with the square root.
_MIN_RANGE_ROWS = 50_000


def _sortable(df: DataFrame, order: Sequence[Column | str]) -> list[Column]:
    """Order columns as values that survive a trip through the driver."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    fields = df.select(*[c.alias(f"k{i}") for i, c in enumerate(columns)]).schema
    out = []
    for column, field in zip(columns, fields):
        if isinstance(field.dataType, T.TimestampType):
            out.append(F.unix_micros(column))
        elif isinstance(field.dataType, T.DateType):
            out.append(F.unix_date(column))
        else:
            out.append(column)
    return out


def _pick(bounds: Column, n: int, key: Column) -> Column:
    """Number of the `n` sorted bounds that are <= key, by halving the open interval."""
    halvings = F.sequence(F.lit(1), F.lit(max(1, n.bit_length())))
    start = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.call_function("shiftright", s["low"] + s["high"], F.lit(1))
        below = F.get(bounds, mid) <= key
        return F.when(s["low"] >= s["high"], s).when(
            below, F.struct((mid + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), mid.alias("high")))

    return F.aggregate(halvings, start, halve, lambda s: s["low"])


def range_count(rows: int) -> int:
    return -(-rows // max(_MIN_RANGE_ROWS, int(10 * rows**0.5)))


def range_bucket(df: DataFrame, keys: Sequence[Column]) -> Column | None:
    """A bucket number that follows the order of `keys` with balanced buckets.

    None when the rows make one range. Boundaries come from a sample of the keys, a few per range. They travel in the
    plan as one literal, and a row finds its range by binary search, so thousands of ranges cost no planning. They
    only decide how work is split: results do not depend on which rows were sampled.
    """
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    keyed = df.select(key.alias("k"))
    rows = keyed.count()
    buckets = range_count(rows)
    if buckets <= 1:
        return None
    wanted = buckets * _SAMPLE_PER_RANGE
    if rows > wanted:
        keyed = keyed.sample(min(1.0, 1.2 * wanted / rows), seed=17)
    sample = [r["k"] for r in keyed.orderBy("k").select(F.to_json("k", {"ignoreNullFields": "false"}).alias("k")).collect()]
    bounds = list(dict.fromkeys(sample[len(sample) * i // buckets] for i in range(1, buckets) if sample))
    if not bounds:
        return None
    kind = keyed.schema["k"].dataType.simpleString()
    return _pick(F.from_json(F.lit("[" + ",".join(bounds) + "]"), f"array<{kind}>"), len(bounds), key)


def with_ranges(df: DataFrame, keys: Sequence[Column], name: str) -> tuple[DataFrame, str | bool]:
    """`df` with its bucket column, and what to pass as `bucket` to several scans of it."""
    bucket = range_bucket(df, keys)
    return (df, False) if bucket is None else (df.withColumn(name, bucket), name)


def ordered_scan(
    df: DataFrame,
    order: Sequence[Column | str],
    group: Sequence[str] = (),
    *,
    position: str | None = None,
    size: str | None = None,
    sums: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    mins_before: dict[str, Column] | None = None,
    bucket: str | bool | None = None,
) -> DataFrame:
    """Add running values of each group in ascending `order`.

    position      1-based place of the row in its group
    size          number of rows of the group
    sums          name -> value: running sum including the row
    totals        name -> value: sum over the whole group
    mins_before   name -> value: minimum over the rows strictly before the row
    bucket        second result of `with_ranges`, to scan the same ranges again

    Descending numeric order is asked for with a negated key. `order` must be a
    total order inside each group for the result to be deterministic.
    """
    sums, totals, mins_before = sums or {}, totals or {}, mins_before or {}
    group = list(group)
    keys = _sortable(df, [*group, *order])
    kept = [F.col(c) for c in df.columns]
    work = df
    if bucket is None:
        work, bucket = with_ranges(df, keys, "_scan_bucket")
    inner_order = keys[len(group):]
    split = [bucket] if bucket else []
    piece = Window.partitionBy(*split, *group) if split or group else Window.partitionBy(F.lit(0))
    running = piece.orderBy(*inner_order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = piece.orderBy(*inner_order).rowsBetween(Window.unboundedPreceding, -1)
    if not bucket:
        # Few rows in all: one range, nothing to carry.
        return work.select(
            *kept,
            *([F.row_number().over(piece.orderBy(*inner_order)).cast("long").alias(position)] if position else []),
            *([F.count(F.lit(1)).over(piece).alias(size)] if size else []),
            *[F.sum(c).over(running).alias(n) for n, c in sums.items()],
            *[F.sum(c).over(piece).alias(n) for n, c in totals.items()],
            *[F.min(c).over(earlier).alias(n) for n, c in mins_before.items()],
        )

    # One partial-aggregated pass gives what each (bucket, group) piece holds.
    aggregates = [F.count(F.lit(1)).alias("_scan_n")]
    aggregates += [F.sum(c).alias(f"_scan_s_{n}") for n, c in sums.items()]
    aggregates += [F.sum(c).alias(f"_scan_t_{n}") for n, c in totals.items()]
    aggregates += [F.min(c).alias(f"_scan_m_{n}") for n, c in mins_before.items()]
    pieces = work.groupBy(bucket, *group).agg(*aggregates)
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = pieces.select(
        F.col(bucket).alias("_scan_b"),
        *[F.col(g).alias(f"_scan_g{i}") for i, g in enumerate(group)],
        F.count(F.lit(1)).over(whole).alias("_scan_pieces"),
        F.sum("_scan_n").over(before).alias("_scan_c_n"),
        F.sum("_scan_n").over(whole).alias("_scan_z_n"),
        *[F.sum(f"_scan_s_{n}").over(before).alias(f"_scan_c_s_{n}") for n in sums],
        *[F.sum(f"_scan_t_{n}").over(whole).alias(f"_scan_z_t_{n}") for n in totals],
        *[F.min(f"_scan_m_{n}").over(before).alias(f"_scan_c_m_{n}") for n in mins_before],
    ).where("_scan_pieces > 1")

    on = F.col(bucket) == F.col("_scan_b")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_scan_g{i}"))
    joined = work.join(F.broadcast(carry), on, "left")

    added = []
    if position:
        added.append((F.row_number().over(piece.orderBy(*inner_order)).cast("long")
                      + F.coalesce("_scan_c_n", F.lit(0))).alias(position))
    if size:
        added.append(F.coalesce(F.col("_scan_z_n"), F.count(F.lit(1)).over(piece)).alias(size))
    for name, column in sums.items():
        added.append((F.sum(column).over(running)
                      + F.coalesce(f"_scan_c_s_{name}", F.lit(0))).alias(name))
    for name, column in totals.items():
        added.append(F.coalesce(F.col(f"_scan_z_t_{name}"), F.sum(column).over(piece)).alias(name))
    for name, column in mins_before.items():
        added.append(F.least(F.min(column).over(earlier), F.col(f"_scan_c_m_{name}")).alias(name))
    return joined.select(*kept, *added)
