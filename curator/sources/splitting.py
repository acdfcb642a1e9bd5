"""Entries of large payload files, cut across tasks.

A file is read in splits, each row of which ends at a closing mark; what state a row starts in follows from running sums over
the rows before it, so no task needs the file as a whole. Only the pieces of one entry come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curator.operators.ordered import ordered_scan
from curator.runtime import materialize

#: A quote that begins or ends a string: an even number of backslashes stands before it.
_QUOTE = r'(?<!\\)(?:\\\\)*+"'
#: A string from its opening to its closing quote.
_STRING = r'(?s)"(?:[^"\\]++|\\.)*+"'


def _rows(spark: SparkSession, path: str, end: str) -> DataFrame:
    """source_id, block, at, text: the rows of each file in order, without the `end` that closes them."""
    name = F.col("_metadata.file_path")
    read = spark.read.option("lineSep", end).text(path)
    return materialize(read.select(
        name.alias("source_file"), F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("source_id"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text")), "payload-rows")


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def json_array_entries(spark: SparkSession, path: str) -> DataFrame:
    """source_id, place, entry: the objects of landed JSON arrays, one file per payload; place counts them from 0.

    Rows end at '}'. The quotes before a row tell whether it starts inside a string, the brackets outside strings how deep it is,
    and an entry ends where the depth is that of the array again. Entries that are no objects are passed over, as is what
    follows the last object. A file that is no array has no entries.
    """
    order, group = ["block", "at"], ["source_file"]
    rows = _rows(spark, path, "}").withColumn("quotes", _count(F.col("text"), _QUOTE).cast("long"))
    rows = ordered_scan(rows, order, group, sums={"seen": F.col("quotes")}, position="n", size="last")
    inside = (F.col("seen") - F.col("quotes")) % 2 == 1
    # Outside strings: what follows the end of an open one, without whole ones and without one that stays open.
    rest = F.when(inside, F.regexp_replace("text", rf"(?s)^(?:[^\"\\]++|\\.)*+(?:\"|$)", "")).otherwise(F.col("text"))
    bare = F.regexp_replace(F.regexp_replace(rest, _STRING, ""), r'(?s)".*$', "")
    closed = (F.col("seen") % 2 == 0) & (F.col("n") < F.col("last"))  # the row's own '}', which the last row of a file lacks
    depth = _count(bare, r"[\[{]") - _count(bare, r"[\]}]") - closed.cast("int")
    rows = materialize(rows.select(
        "source_file", "source_id", "block", "at", "n", "last", "text", closed.alias("closed"), depth.cast("long").alias("step"),
        ((F.col("n") == 1) & F.col("text").rlike(r"(?s)^﻿?\s*\[")).cast("long").alias("array")), "payload-depths")
    rows = ordered_scan(rows, order, group, sums={"depth": F.col("step"), "is_array": F.col("array")})
    ends = (F.col("closed") & (F.col("depth") == 1)).cast("long")
    rows = ordered_scan(rows.withColumn("ends", ends), order, group, sums={"done": F.col("ends")}).where("is_array = 1")
    pieces = rows.select(
        "source_file", "source_id", (F.col("done") - F.col("ends")).alias("entry_no"),
        F.struct("block", "at", F.concat("text", F.when(F.col("n") < F.col("last"), "}").otherwise("")).alias("text")).alias("piece"), "ends")
    joined = pieces.groupBy("source_file", "source_id", "entry_no").agg(F.array_sort(F.collect_list("piece")).alias("p"), F.max("ends").alias("whole")).where("whole = 1")
    text = F.array_join(F.col("p")["text"], "")
    # Before the object: the array's bracket, commas, and entries that are no objects.
    found = joined.select("source_file", "source_id", "entry_no", F.regexp_replace(text, rf'^(?s)(?:[^"{{]++|"(?:[^"\\]++|\\.)*+")*+(?=\{{)', "").alias("entry"))
    return found.select("source_id", F.col("entry_no").alias("place"), "entry")


def xml_entries(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """source_id, place, entry: the elements named `tag` of landed XML files, from their start to their end tag; place counts them from 0.

    Rows end at the end tag. Elements of that name don't lie inside each other in a feed; an end tag inside CDATA ends the entry.
    """
    rows = _rows(spark, path, f"</{tag}>")
    found = rows.select("source_file", "source_id", "block", "at", F.regexp_extract("text", rf"(?s)<{tag}(?:\s[^>]*)?>.*$", 0).alias("body"))
    numbered = ordered_scan(found.where("body <> ''"), ["block", "at"], ["source_file"], position="place")
    return numbered.select("source_id", (F.col("place") - 1).alias("place"), F.concat("body", F.lit(f"</{tag}>")).alias("entry"))
