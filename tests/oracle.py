"""Runs registered queries against their SQL in DuckDB: python -m tests.oracle SF_DIR [NAME...]."""

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings exams pages storage_object "
    "page_result deletion_log page_payload eval_item pack_target"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf, name, query, sql):
    """'' when equal, else what differs."""
    df = query(spark, sf)
    mine = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    theirs = rows_of(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}; {[x for x in mine if x not in set(theirs)][:2]} / {[x for x in theirs if x not in set(mine)][:2]}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} of {len(mine)} differ: {bad[0]}" if bad else ""


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from pagemill.session import local_session

    sf = sys.argv[1]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    q, s = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or list(q):
        t = time.time()
        try:
            r = compare(spark, con, sf, name, q[name], s[name]) if name in s else f"rows only: {q[name](spark, sf).count()}"
        except Exception as x:  # noqa: BLE001
            r = f"ERROR {str(x)[:600]}"
        print(f"{name}: {r or 'equal'} ({time.time() - t:.1f} s)", flush=True)
