"""Side-by-side check of the registered queries against their SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False):
        cells = []
        for v in row:
            if v is None or str(v) in ("NaT", "<NA>", "nan"):
                cells.append("null")
            elif isinstance(v, float):
                cells.append("null" if math.isnan(v) else repr(v + 0.0))
            elif hasattr(v, "tolist") and not hasattr(v, "isoformat"):
                v = v.tolist()
                cells.append(repr(v + 0.0) if isinstance(v, float) else repr(v))
            else:
                cells.append(str(v))
        out.append(tuple(cells))
    return sorted(out)


def compare(spark, con, folder, name, fn, sql):
    """Problem text, or None when rows, columns and values agree."""
    got = fn(spark, folder).toPandas()
    if sql is None:
        return None if len(got.columns) else "no columns"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns}
    a, b = canonical(got), canonical(want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0]} kinds {kinds}"
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and not k[0].startswith("datetime")}
    return f"OK but kinds {odd}" if odd else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, name, fn, oracles.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        mark = "rows" if name not in oracles else "sql "
        print(f"{'FAIL' if problem else 'ok  '} {mark} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print("failed:", failed)
