"""Run registered queries beside their DuckDB SQL and report differences.

    python tests/compare.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("CURATOR_TESTDATA", "/root/testdata")


def duck(root):
    import duckdb

    from curator.runtime import TABLES

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{root}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "tzinfo") and getattr(value, "tzinfo", None) is not None:
        return value.replace(tzinfo=None)
    return value


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, con, root, name, query, sql):
    start = time.time()
    df = query(spark, root)
    names = df.columns
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if sql is None:
        return True, f"{name}: rows={len(rows)} (no SQL) {spent:.1f}s"
    start = time.time()
    cur = con.execute(sql)
    other_names = [d[0] for d in cur.description]
    other = cur.fetchall()
    duck_spent = time.time() - start
    if sorted(names) != sorted(other_names):
        return False, f"{name}: COLUMNS {sorted(names)} != {sorted(other_names)}"
    a, b = bag(names, rows), bag(other_names, other)
    if a != b:
        return False, (
            f"{name}: MISMATCH spark={len(rows)} duck={len(other)}\n"
            f"   cols={sorted(names)}\n"
            f"   only spark: {[str(x)[:400] for x in list((a - b))[:3]]}\n"
            f"   only duck : {[str(x)[:400] for x in list((b - a))[:3]]}"
        )
    kinds = {type(v).__name__ for r in rows[:50] for v in r}
    odd = kinds - {"int", "str", "float", "bool", "NoneType"}
    return True, f"{name}: ok rows={len(rows)} spark={spent:.1f}s duck={duck_spent:.1f}s {odd or ''}"


def main(argv):
    import __spark_entry__ as entry
    from curator.runtime import local_session

    if os.environ.get("CURATOR_SMALL_RANGES"):
        # Cut even small tables into several ranges, as large ones are.
        from curator.operators import ordered

        ordered._MIN_RANGE_ROWS = 500
    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    root = f"{DATA}/sf{sf}"
    spark = local_session(8)
    con = duck(root)
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries), set(oracles) - set(queries)
    bad = 0
    for name in queries:
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            ok, text = check(spark, con, root, name, queries[name], oracles.get(name))
        except Exception as error:  # report every query, not only the first failure
            ok, text = False, f"{name}: ERROR {type(error).__name__}: {str(error)[:900]}"
        bad += not ok
        print(("    " if ok else "BAD ") + text, flush=True)
    print("failures:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
