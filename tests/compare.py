"""Runs a query and its SQL on the same tables and compares the rows: `python tests/compare.py SF_DIR [name...]`."""

import glob
import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# Queries without SQL, and what they are held against instead.
NO_SQL = {
    "p4_loaded": "tests/test_rejects.py, and p4_found and p6_found for what isn't loaded and when",
    "p8_packed": "tests/llm/test_packing.py", "p8_fill": "tests/llm/test_packing.py", "p9_mixed": "tests/llm/test_mixing.py", "p9_shares": "tests/llm/test_mixing.py", "p9_scarce": "tests/llm/test_mixing.py",
    "p10_found": "tests/llm/test_langid.py", "p10_languages": "tests/llm/test_langid.py",
}


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.9g}"
    if isinstance(v, int):
        return f"{v:.9g}" if abs(v) < 10**9 else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return str(v)


def compare(spark, con, name, f, sql, d):
    t = time.time()
    df = f(spark, d)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    took = time.time() - t
    if sql is None:
        return f"{name}: {len(got)} rows, no SQL, {took:.1f} s", name in NO_SQL
    cur = con.execute(sql)
    have = [x[0] for x in cur.description]
    rows = cur.fetchall()
    if sorted(have) != names:
        return f"{name}: columns {names} but SQL has {sorted(have)}", False
    at = [have.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)
    if got != want:
        a = [x for x in got if x not in set(want)][:3] if len(got) < 200_000 else []
        b = [x for x in want if x not in set(got)][:3] if len(got) < 200_000 else []
        return f"{name}: DIFFERENT, {len(got)} and {len(want)} rows; only here {a}; only in SQL {b}", False
    return f"{name}: {len(got)} rows equal, {took:.1f} s", True


def connect(d):
    import duckdb

    con = duckdb.connect()
    for p in sorted(glob.glob(f"{d}/*.parquet")):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


if __name__ == "__main__":
    import __spark_entry__ as entry

    from dimforge import session

    spark = session.build("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    d, names = sys.argv[1], sys.argv[2:]
    qs, sqls, con, bad = entry.queries(), entry.oracle_sql(), connect(d), 0
    for name in names or qs:
        try:
            said, ok = compare(spark, con, name, qs[name], sqls.get(name), d)
        except Exception as e:
            said, ok = f"{name}: {type(e).__name__} {str(e)[:1500]}", False
        bad += not ok
        print(said[:2500], flush=True)
    sys.exit(bad)
