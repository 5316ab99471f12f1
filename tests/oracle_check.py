"""Run registered queries against their SQL and report differences.

    python tests/oracle_check.py [--dir DIR] [name-or-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    """Empty string when equal, else a description of the first difference."""
    got = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    spark_types = {f.name: f.dataType.simpleString() for f in spark_df.schema}
    duck = {d[0]: str(d[1]).lower() for d in cur.description}
    same = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar", "boolean": "boolean"}
    bad = [(n, spark_types[n], duck[n]) for n in names if same.get(spark_types[n], None) not in (None, duck[n])]
    if bad:
        return f"types {bad}"
    a, b = canonical(spark_df.columns, got), canonical(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(diff)} of {len(a)} rows differ, e.g. {diff[0]}" if diff else ""


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("--plain", action="store_true", help="use a session with default settings")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from varienne.session import build_session

    if args.plain:
        from pyspark.sql import SparkSession

        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark = SparkSession.getActiveSession() if args.plain else build_session("oracle-check", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.dir)
    failures, oracles = 0, entry.oracle_sql()
    for name, run in entry.queries().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            df = run(spark, args.dir)
            if name in oracles:
                message = compare(df, con, oracles[name])
            else:
                message, rows = "", df.count()
                print(f"rows {name}: {rows}")
        except Exception as err:  # report and go on with the next query
            message = f"{type(err).__name__}: {str(err)[:900]}"
        failures += bool(message)
        print(f"{'FAIL' if message else 'ok  '} {name} {time.time() - start:.1f}s {message}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
