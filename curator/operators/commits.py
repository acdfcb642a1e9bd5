"""Versions of a table of appended folders: a commit file per version, made by compare-and-set.

Version n is the file `_commits/n`, a list of the data folders it consists of. A writer puts its rows into a folder of its
own and then creates the file of the next version; of several writers one creates it, the others see that it exists and
start over. Rows of a writer that ends before its commit belong to no version and are never read. Version 0 is what
lies in the table's own folder.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, table: str) -> int:
    """The last version."""
    folder, fs = _path(spark, f"{table}/_commits")
    if not fs.exists(folder):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def folders(spark: SparkSession, table: str, version: int) -> list[str]:
    """The data folders of a version, relative to the table."""
    return json.loads(spark.read.text(f"{table}/_commits/{version:020d}", wholetext=True).first()[0]) if version else []


def commit(spark: SparkSession, table: str, version: int, listed: list[str]) -> bool:
    """Make `version` of these folders; False if another writer made it first."""
    draft, fs = _path(spark, f"{table}/_drafts/{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(listed).encode()))
    out.close()
    target, _ = _path(spark, f"{table}/_commits/{version:020d}")
    fs.mkdirs(target.getParent())
    if fs.getUri().getScheme() == "file":
        # A link is the one local operation that fails where the name exists.
        local = lambda p: unquote(urlsplit(fs.makeQualified(p).toUri().toString()).path)
        try:
            os.link(local(draft), local(target))
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(draft, False)
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    kinds = spark._gateway.new_array(options, 1)
    kinds[0] = options.NONE
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, kinds)
        return True
    except Exception as error:
        if "FileAlreadyExists" not in str(error):
            raise
        fs.delete(draft, False)
        return False


def new_folder() -> str:
    return f"_data/{uuid.uuid4().hex}"


def read(spark: SparkSession, table: str, schema: StructType, version: int | None = None) -> DataFrame:
    """The rows of a version, the last one if none is named; commits that come later change nothing in the result."""
    version = current(spark, table) if version is None else version
    base, fs = _path(spark, table)
    reader = spark.read.schema(schema)
    parts = [f"{table}/{f}" for f in folders(spark, table, version)]
    rows = reader.parquet(table) if fs.exists(base) else spark.createDataFrame([], schema)
    return rows.unionByName(reader.parquet(*parts)) if parts else rows
