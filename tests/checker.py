"""Runs registered queries against their oracle SQL and compares rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(folder + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "date": "DATE"}


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


def compare(spark_df, con, sql):
    """List of differences, empty when equal."""
    rel = con.sql(sql)
    d_cols = dict(zip(rel.columns, map(str, rel.types)))
    s_types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    if sorted(d_cols) != sorted(s_types):
        return [f"columns {sorted(s_types)} != {sorted(d_cols)}"]
    problems = []
    for c, t in s_types.items():
        if TYPES.get(t.split(" collate")[0], t) != d_cols[c]:
            problems.append(f"type of {c}: {t} vs {d_cols[c]}")
    cols = sorted(d_cols)
    a = sorted([tuple(canon(r[c]) for c in cols) for r in spark_df.collect()])
    idx = [rel.columns.index(c) for c in cols]
    b = sorted([tuple(canon(r[i]) for i in idx) for r in rel.fetchall()])
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        for c_i, c in enumerate(cols):
            bad = [(x[c_i], y[c_i]) for x, y in zip(a, b) if x[c_i] != y[c_i]]
            if bad:
                problems.append(f"{c}: {len(bad)} differ, e.g. spark {bad[0][0][:200]} duck {bad[0][1][:200]}")
        only = sorted(set(a) - set(b))[:1], sorted(set(b) - set(a))[:1]
        problems.append(f"first spark-only {str(only[0])[:500]}\n   first duck-only {str(only[1])[:500]}")
    return problems


def main(folder, wanted):
    from credence.session import build_session
    from __spark_entry__ import oracle_sql, queries

    if os.environ.get("PLAIN"):  # a session without the package settings, in another time zone
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[4]").config("spark.sql.session.timeZone", "America/New_York").config("spark.ui.enabled", "false").getOrCreate()
    else:
        spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    qs, sqls = queries(), oracle_sql()
    failed = []
    for name, fn in qs.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                problems = compare(df, con, sqls[name])
                note = "ok" if not problems else "DIFF"
            else:
                n = len(df.collect())
                problems, note = [], f"rows-only {n}"
        except Exception as e:
            problems, note = [str(e)[:1500] if os.environ.get("SHORT") else traceback.format_exc()[-2500:]], "ERROR"
        print(f"{note:10s} {name} {time.time() - t:.2f}s", flush=True)
        for p in problems:
            print("    ", p, flush=True)
        if problems:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
