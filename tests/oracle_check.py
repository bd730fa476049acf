"""Run registered queries next to their SQL in DuckDB and report differences.

Usage: python tests/oracle_check.py <table folder> [name part ...]
"""

import datetime
import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def cell(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{round(v, 6) + 0.0:.6f}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


KINDS = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "DATE": "date",
         "BOOLEAN": "boolean", "TIMESTAMP": "timestamp"}


def compare(spark, con, folder, fn, sql):
    df = fn(spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        if node in plan:
            return -1, f"plan has {node}"
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), "rows only"
    cur = con.execute(sql)
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in cur.description}
    ocols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != ocols:
        return len(got), f"columns {cols} != {ocols}"
    odd = {c: (types[c], kinds[c]) for c in cols if types[c] != kinds[c]}
    if len(got) != len(want):
        return len(got), f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return len(got), f"{len(bad)} rows differ, e.g. {bad[0]} types {odd}"
    return len(got), f"type {odd}" if odd else "ok"


def connect(folder):
    import duckdb
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def main(folder, parts):
    import __spark_entry__ as e
    from voicegrid.session import local_session
    spark, con = local_session("check", 8), connect(folder)
    oracles, bad = e.oracle_sql(), 0
    for name, fn in e.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            n, verdict = compare(spark, con, folder, fn, oracles.get(name))
        except Exception as err:  # report and go on with the next query
            n, verdict = -1, f"{type(err).__name__}: {str(err)[:700]}"
        bad += verdict not in ("ok", "rows only")
        print(f"{verdict[:900] if verdict != 'ok' else 'ok':10} {name} rows={n} {time.time() - t:.1f}s", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
