import hashlib
import random
import zlib

import pytest
from cases import edge_rows

from curator.llm import merkle
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, g string, h string, load int, at int, n int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """(root, siblings of each leaf from below: (left, digest or empty))."""
    paths, groups, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        up, merged = [], []
        for i in range(0, len(level), 2):
            pair = level[i : i + 2]
            for k in range(len(pair)):
                beside = pair[1 - k] if len(pair) == 2 else ""
                for j in groups[i + k]:
                    paths[j].append((k == 1, beside))
            up.append(sha("".join(pair)))
            merged.append([j for g in groups[i : i + 2] for j in g])
        level, groups = up, merged
    return level[0], paths


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    roots, all_paths, out = [], [], []
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = tree([leaf(r) for r in groups[name]])
        roots.append(root)
        all_paths.append(paths)
    root, above = tree(roots)
    for k, name in enumerate(names):
        for row, path in zip(groups[name], all_paths[k]):
            whole = path + above[k]
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                changed = (*row[:3], row[3] + 1, row[4])
            found = leaf(changed)
            for left, beside in whole:
                found = sha(beside + found if left else found + beside)
            out.append((row[0], leaf(row), roots[k], root, sha("".join(b for _, b in whole)), found, found == root))
    return sorted(out, key=str)


def rows_of(n, langs):
    rng = random.Random(n)
    return [(i if rng.random() < 0.97 else None, rng.choice(["a", None, "é"]), rng.choice(langs), rng.choice([None, i, 2**63 - 1]), rng.choice([None, "", f"t {i} 数"])) for i in range(n)]


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "g", "h", 1, 2, 3) for r in rows], SCHEMA)
    one_more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    got = merkle.manifest(docs, {"n_chars": one_more}, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    folded = merkle.fold(F.col("checked_leaf"), F.col("path"))
    got = got.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")), folded.alias("f"), (folded == F.col("root")))
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (2, ["en"]), (3, [None]), (60, ["en", "fr", None]), (300, ["en"] * 9 + ["fr", "ünï", "z"])])
def test_against_a_plain_tree(spark, monkeypatch, n, langs):
    monkeypatch.setattr(merkle, "BLOCK", 8)
    monkeypatch.setattr(merkle, "LEVELS", 3)
    rows = rows_of(n, langs)
    assert found(spark, rows) == expected(rows)


def test_odd_rows_in_blocks_of_the_production_size(spark):
    rows = [(d, "s", ["xx", None, "yy"][i % 3], i, t) for i, (d, t) in enumerate(edge_rows())]
    rows += rows[:5] + [(7, "same", "xx", 1, "copies")] * 2100
    assert found(spark, rows) == expected(rows)
    assert found(spark, []) == []


def test_many_groups(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 4)
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rows = [(i, "s", f"lang {i % 37}", i, "t") for i in range(120)]
    assert found(spark, rows) == expected(rows)


def test_a_changed_row_does_not_verify(spark):
    rows = rows_of(200, ["en", "fr"])
    got = found(spark, rows)
    wrong = [r for r in got if not r[6]]
    assert wrong and all(zlib.crc32(str(r[0]).encode()) % 7 == 0 for r in wrong)
