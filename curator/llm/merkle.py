"""Merkle manifest of a table: a tree of digests per group, a tree over the groups' roots, and a proof for every row.

Rows of a group lie in a total order and are cut into aligned blocks of `BLOCK` nodes. A block keeps each level of its
part of the tree as one string of concatenated hexadecimal digests: fixed-width substrings of a level, two digests
each, are hashed to the next level (the last one may have one digest only). A node's sibling at a level is the
substring that flanks its own. The roots of the blocks are the nodes of the next tier of blocks, and so on until each
group has one root; the groups' roots, in order, make the last tree in the same way. All of it is Spark's own functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curator.llm.common import materialize, partitions

#: Nodes of a block, a power of two, and the levels between its nodes and its root.
BLOCK = 1024
LEVELS = BLOCK.bit_length() - 1
WIDTH = 64

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(values: Sequence[Column]) -> Column:
    """SHA-256 over the values in order: `-` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    parts = [v.cast("string") for v in values]
    framed = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*framed), 256)


def _shift(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add `at`, the place from 0 in the group `g` by `order`, and `n`, the size of the group.

    Rows are sorted in ranges of the whole key, so a large group is spread over many tasks; a salt behind the key also
    spreads equal rows, which are interchangeable. A task's first and number of rows of a group give the places.
    """
    keys = ["g", *order]
    salted = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    placed = salted.repartitionByRange(partitions(rows.sparkSession), *keys, "salt").sortWithinPartitions(*keys).drop("salt")
    placed = materialize(placed.withColumn("seq", F.monotonically_increasing_id()).withColumn("part", _shift(F.col("seq"), F.lit(33))), "ordered")
    cuts = placed.groupBy("g", "part").agg(F.min("seq").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("g")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.select(
        F.col("g").alias("cut_g"), F.col("part").alias("cut_part"),
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("move"), F.sum("rows").over(whole).alias("n"))
    on = F.col("g").eqNullSafe(F.col("cut_g")) & (F.col("part") == F.col("cut_part"))
    return placed.join(cuts, on).select("g", (F.col("seq") + F.col("move")).alias("at"), "n", "h", "load")


def _parents(level: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.ceil(F.length(level) / F.lit(2 * WIDTH)).cast("int") - 1)
    return F.array_join(F.transform(pairs, lambda i: F.sha2(F.substring(level, i * 2 * WIDTH + 1, F.lit(2 * WIDTH)), 256)), "").cast("binary")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(g, block, n, nodes, levels) of nodes (g, at, n, h, load): `levels` has one string a level, up to the block's root.

    The strings of hexadecimal digits are kept as bytes, of which a substring is found without counting characters.
    A group that is one block goes up to its root, a block of a larger group up `LEVELS` levels, alone or not.
    """
    height = F.when(F.col("n") > BLOCK, LEVELS).when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    steps = F.slice(F.array(*[F.lit(i) for i in range(1, LEVELS + 1)]), F.lit(1), height)
    listed = nodes.groupBy("g", _shift(F.col("at"), F.lit(LEVELS)).alias("block")).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "h", "load"))).alias("nodes"))
    lowest = F.array(F.array_join(F.col("nodes")["h"], "").cast("binary"))
    levels = F.aggregate(steps, lowest, lambda found, _: F.array_append(found, _parents(F.element_at(found, -1))))
    return listed.withColumn("levels", levels)


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """Tables of blocks, each over the roots of the blocks before, until every group is one block."""
    tiers: list[DataFrame] = []
    nothing = F.lit(None).cast(nodes.schema["load"].dataType)
    while True:
        tiers.append(materialize(_blocks(nodes), "merkle"))
        largest = tiers[-1].agg(F.max("n")).first()[0]
        if largest is None or largest <= BLOCK:
            return tiers
        nodes = tiers[-1].select(
            "g", F.col("block").alias("at"), F.ceil(F.col("n") / BLOCK).alias("n"), F.element_at("levels", -1).cast("string").alias("h"), nothing.alias("load"))


def _own_path(i: Column) -> Column:
    """Side and digest of the sibling of a block's node `i` at every level below the block's root; an empty digest where it has none."""
    below = F.slice(F.col("levels"), F.lit(1), F.size("levels") - 1)

    def sibling(level: Column, depth: Column) -> Column:
        at = _shift(i, depth)
        left = at % 2 == 1
        beside = F.when(left, at - 1).otherwise(at + 1)
        return F.struct(left.alias("left"), F.substring(level, beside * WIDTH + 1, F.lit(WIDTH)).cast("string").alias("sibling"))

    return F.transform(below, sibling)


def _paths(tiers: list[DataFrame], above: DataFrame | None, root: str) -> DataFrame:
    """Every node of the lowest tier with its path to the root, from the top down; `root` names the column of the group's root.

    `above` has the path (and more columns) from each group's root on, by `g`.
    """
    top = tiers[-1].withColumn(root, F.element_at("levels", -1).cast("string"))
    if above is None:
        at = top.withColumn("path", F.array().cast("array<struct<left:boolean,sibling:string>>"))
    else:
        at = top.join(above.withColumnRenamed("g", "above_g"), F.col("g").eqNullSafe(F.col("above_g"))).drop("above_g")
    kept = [c for c in at.columns if c not in tiers[-1].columns and c != "path"]
    for k in range(len(tiers) - 1, -1, -1):
        if k < len(tiers) - 1:
            upper = at.select(F.col("g").alias("above_g"), F.col("at").alias("above_block"), "path", *kept)
            on = F.col("g").eqNullSafe(F.col("above_g")) & (F.col("block") == F.col("above_block"))
            at = tiers[k].join(upper, on)
        # Paths are cut inside the block, so that no row carries the block's levels.
        placed = F.transform("nodes", lambda node, i: F.struct(node["at"].alias("at"), node["h"].alias("h"), node["load"].alias("load"), _own_path(i).alias("own")))
        each = at.select("g", "path", *kept, F.explode(placed).alias("node"))
        at = each.select("g", "node.at", "node.h", "node.load", F.concat("node.own", "path").alias("path"), *kept)
    return at


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    def step(found: Column, p: Column) -> Column:
        return F.sha2(F.when(p["left"], F.concat(p["sibling"], found)).otherwise(F.concat(found, p["sibling"])), 256)

    return F.aggregate(path, leaf, step)


def manifest(
    docs: DataFrame, tampered: dict[str, Column] | None = None, where: Column | None = None, id_col: str = "doc_id",
    group_col: str = "lang", fields: Sequence[str] = FIELDS,
) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, checked_leaf) of every row.

    `leaf` is the digest of `fields`; leaves of a group (null is a group, the first) ascend by id, null ids first, rows
    of one id by their leaf; repeated rows are leaves of their own. `subroot` is the group's root, `root` that over all
    groups. `path` lists side and digest of each sibling up to the root. `checked_leaf` is the digest of the row as
    found now: `fields` with the values of `tampered` where `where` is true, the leaf elsewhere. Texts are
    read once and never shuffled. Long texts are hashed whole; an empty table has no leaf and gives no row.
    """
    found = {f: F.col(f) for f in fields} | (tampered or {})
    leaf = digest([F.col(f) for f in fields])
    checked = F.when(where if where is not None else F.lit(False), digest([found[f] for f in fields]))
    slim = docs.select(
        F.col(group_col).alias("g"), leaf.alias("h"), F.struct(F.col(id_col).alias("doc_id"), checked.alias("checked")).alias("load"))
    slim = materialize(slim.withColumn("key", F.col("load.doc_id")), "leaves")
    tiers = _tiers(_numbered(slim, ["key", "h"]))
    roots = tiers[-1].select(F.lit(0).alias("g"), F.element_at("levels", -1).cast("string").alias("h"), F.struct(F.col("g").alias("group")).alias("load"))
    top = _paths(_tiers(_numbered(roots.withColumn("key", F.col("load.group")), ["key"])), None, "root")
    above = materialize(top.select(F.col("load.group").alias("g"), "path", "root"), "subroots")
    rows = _paths(tiers, above, "subroot")
    return rows.select(
        F.col("load.doc_id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", "root", "path",
        F.coalesce("load.checked", "h").alias("checked_leaf"))


def proof(path: Column) -> Column:
    """SHA-256 of a path's siblings from the leaf up."""
    return F.sha2(F.array_join(path["sibling"], ""), 256)


def _framed(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text}, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_framed(n_chars if f == "n_chars" else f) for f in FIELDS) + ")"


#: The same for DuckDB: levels by recursion over single nodes, checksums bit by bit.
ORACLE = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, {_leaf_sql('CAST(n_chars AS HUGEINT) + 1')} AS other,
        xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) AS crc
    FROM documents),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
    FROM leaves),
tree AS (
    SELECT lang, 0 AS level, pos, n, leaf AS h FROM placed
    UNION ALL
    SELECT lang, level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1
    GROUP BY lang, level, pos // 2),
subroots AS (
    SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS m
    FROM tree WHERE n = 1),
upper AS (
    SELECT 0 AS level, place AS pos, m, subroot AS h FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, (max(m) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM upper WHERE m > 1 GROUP BY level, pos // 2),
docs AS (
    SELECT row_number() OVER () AS row, p.*, s.height, s.subroot, s.place, r.h AS root, r.level AS top
    FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang, (SELECT h, level FROM upper WHERE m = 1) r),
steps AS (
    SELECT d.row, t.level AS step, (d.pos >> t.level) % 2 AS odd, coalesce(b.h, '') AS sibling
    FROM docs d JOIN (SELECT DISTINCT lang, level FROM tree) t ON d.lang IS NOT DISTINCT FROM t.lang AND t.level < d.height
    LEFT JOIN tree b ON b.lang IS NOT DISTINCT FROM d.lang AND b.level = t.level AND b.pos = xor(d.pos >> t.level, 1)
    UNION ALL
    SELECT d.row, d.height + t.level, (d.place >> t.level) % 2, coalesce(b.h, '')
    FROM docs d JOIN (SELECT DISTINCT level FROM upper) t ON t.level < d.top
    LEFT JOIN upper b ON b.level = t.level AND b.pos = xor(d.place >> t.level, 1)),
folded AS (
    SELECT row, 0 AS step, CASE WHEN crc % 7 = 0 THEN other ELSE leaf END AS h FROM docs
    UNION ALL
    SELECT f.row, f.step + 1, sha256(CASE WHEN s.odd = 1 THEN s.sibling || f.h ELSE f.h || s.sibling END)
    FROM folded f JOIN steps s ON s.row = f.row AND s.step = f.step),
proofs AS (SELECT row, string_agg(sibling, '' ORDER BY step) AS siblings FROM steps GROUP BY row)
SELECT d.doc_id, d.leaf, d.subroot, d.root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = d.root AS verified
FROM docs d LEFT JOIN proofs p ON p.row = d.row JOIN folded f ON f.row = d.row AND f.step = d.height + d.top
"""
