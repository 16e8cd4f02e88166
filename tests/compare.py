"""Side-by-side run of registered queries against their SQL in DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]
DATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def oracle(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if value.__class__.__name__ == "Decimal":
        return repr(float(value))
    return "NULL" if value is None else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree on columns and rows, else the first difference."""
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} <> {sorted(names)}"
    want = _rows(names, expected.fetchall())
    got = _rows(df.columns, df.collect())
    if want == got:
        return None
    left, right = set(got) - set(want), set(want) - set(got)
    return f"{len(got)} vs {len(want)} rows; {len(left)}/{len(right)} differ; spark {sorted(left)[:2]} oracle {sorted(right)[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from fieldproof.plans import catalog
    from fieldproof.session import build_session

    sf_dir = f"{DATA}/sf{os.environ.get('SF', '0.01')}"
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf_dir)
    chosen, failed = sys.argv[1:], []
    for name, entry in catalog.entries().items():
        if chosen and not any(c in name for c in chosen):
            continue
        begin = time.time()
        try:
            df = entry.run(spark, sf_dir)
            problem = difference(df, con, entry.sql) if entry.sql else f"rows only: {df.count()}"
        except Exception as error:  # a broken query must not stop the others
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        mark = "ok  " if problem is None else "    "
        if problem and not problem.startswith("rows only"):
            failed.append(name)
        print(f"{mark} {name:28s} {time.time() - begin:6.2f}s {' '.join((problem or '').split())[:int(os.environ.get('WIDTH', 300))]}", flush=True)
    print("failed:", failed)
