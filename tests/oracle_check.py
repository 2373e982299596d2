"""Run registered queries against their SQL twins: python tests/oracle_check.py SF_DIR [name ...]"""

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return repr(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, fn, sql):
    """(ok, message) for one query."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return True, f"rows only: {len(got)}"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        sa, sb = set(a), set(b)
        return False, (
            f"spark {len(a)} rows, sql {len(b)} rows; columns {sorted(cols)}\n"
            f"  only spark: {sorted(sa - sb)[:3]}\n  only sql: {sorted(sb - sa)[:3]}"
        )
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    sql_kinds = {d[0]: str(d[1]) for d in cur.description}
    pairs = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [c for c in kinds if pairs.get(kinds[c]) != sql_kinds[c]]
    return True, f"{len(a)} rows" + (f"; types differ: {[(c, kinds[c], sql_kinds[c]) for c in odd]}" if odd else "")


def main():
    import __spark_entry__ as entry
    from bench import session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            ok, message = compare(spark, con, sf_dir, queries[name], oracle.get(name))
        except Exception as exc:
            ok, message = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {message}", flush=True)
    print(f"{len(names or queries)} queries, {bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
