"""Line ranges as bit masks of 64-line cells.

Which lines of a file are covered is one 64-bit mask per (file, cell), combined
with a bitwise or on the map side. However many ranges a file has, a range then
meets one row per cell it touches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINES = 64
MOST_LINES = 10_000_000


def cells(start: Column, end: Column) -> Column:
    """ARRAY<STRUCT<cell, mask>> of the closed line range; null when end < start.

    A range of over `MOST_LINES` lines is no range of a source file and is refused, as it would make a row for every
    64 lines.
    """
    first, last = F.floor(start / LINES), F.floor(end / LINES)

    def piece(cell: Column) -> Column:
        low = F.greatest(start - cell * LINES, F.lit(0)).cast("int")
        high = F.least(end - cell * LINES, F.lit(LINES - 1)).cast("int")
        ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), LINES - 1 - (high - low))
        return F.struct(cell.alias("cell"), F.call_function("shiftleft", ones, low).alias("mask"))

    refused = F.raise_error(F.concat(F.lit("a line range is too long: "), start.cast("string"), F.lit("-"), end.cast("string")))
    return F.when(end - start > MOST_LINES, refused).when(end >= start, F.transform(F.sequence(first, last), piece))
