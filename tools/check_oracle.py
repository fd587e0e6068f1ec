"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows.

    python tools/check_oracle.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from catalog import entries  # noqa: E402
from vendaflux.plans.session import build_session  # noqa: E402


def normal(value):
    """Exact comparison, but NaN equals NaN and -0.0 equals 0.0."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def compare(spark, con, sf_dir, entry):
    """Empty text when equal, else what differs."""
    df = entry.run(spark, sf_dir)
    cols, rows = table(df.columns, df.collect())
    if entry.sql is None:
        return "" if rows else "no rows"
    res = con.execute(entry.sql)
    sql_types = {c[0]: str(c[1]) for c in res.description}
    ocols, orows = table([c[0] for c in res.description], res.fetchall())
    if cols != ocols:
        return f"columns {cols} != {ocols}"
    if len(rows) != len(orows):
        return f"rows {len(rows)} != {len(orows)}"
    if not rows:
        return "no rows"
    bad = [(a, b) for a, b in zip(rows, orows) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ, e.g. {bad[0]}"
    names = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN"}
    odd = {c: (t, sql_types[c]) for c, t in df.dtypes if names.get(t, t) != sql_types[c]}
    return f"types {odd}" if odd else ""


def main() -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    spark = build_session("local[8]", shuffle_partitions=8, extra={"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(a.sf)
    failed = 0
    todo = entries()
    for name in a.names or todo:
        t0 = time.time()
        try:
            msg = compare(spark, con, a.sf, todo[name])
        except Exception as exc:  # report and go on to the next query
            msg = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {name} {time.time() - t0:.2f}s {msg}", flush=True)
    print(f"{failed} failed of {len(a.names or todo)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
