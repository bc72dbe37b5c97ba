"""Run a registered query and its DuckDB SQL side by side and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


def compare(df, con, sql):
    """Problems found, empty when both agree; plus row count and seconds."""
    t0 = time.time()
    spark_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    duck_rows = cur.fetchall()
    t2 = time.time()
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} / {sorted(names)}")
    else:
        for name, kind in df.dtypes:
            if KINDS.get(kind) != kinds[name]:
                problems.append(f"type {name}: {kind} / {kinds[name]}")
        a, b = rows_of(df.columns, spark_rows), rows_of(names, duck_rows)
        if len(a) != len(b):
            problems.append(f"rows {len(a)} / {len(b)}")
        if a != b:
            only_a = [r for r in a if r not in set(b)][:3] if len(a) < 50000 else a[:3]
            only_b = [r for r in b if r not in set(a)][:3] if len(b) < 50000 else b[:3]
            problems.append(f"values\n   spark {str(only_a)[:900]}\n   duck  {str(only_b)[:900]}")
    return problems, len(spark_rows), t1 - t0, t2 - t1


def main(names: list[str], sf_dir: str) -> int:
    from lexmill.plans import ORACLES, QUERIES
    from lexmill.session import local_session

    spark = local_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in names or list(QUERIES):
        t = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problems, n, ts, td = compare(df, con, ORACLES[name])
                verdict = "ok" if not problems else "BAD " + "; ".join(problems)
                extra = f"duck {td:.2f}s"
            else:
                n, verdict, extra = len(df.collect()), "rows only", ""
        except Exception as exc:  # report and go on
            n, verdict, extra = -1, "ERROR " + str(exc)[:700], ""
        bad += verdict.startswith(("BAD", "ERROR"))
        print(f"{name:32s} {n:7d} rows {time.time() - t:6.2f}s {extra} {verdict}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sf = sys.argv[1]
    sys.exit(1 if main(sys.argv[2:], sf) else 0)
