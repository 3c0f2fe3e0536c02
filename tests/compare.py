"""Compare registered queries with their SQL: names, row counts and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> str | None:
    """None when both agree, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    ours, theirs = _rows(df.columns, [tuple(r) for r in df.collect()]), _rows(names, cur.fetchall())
    if ours == theirs:
        return None
    only = [r for r in zip(ours, theirs) if r[0] != r[1]]
    return f"rows {len(ours)} / {len(theirs)}; first difference {only[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as e
    from bankrec.session import build_session

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", 8, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf_dir), e.oracle_sql()
    for name, query in e.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            verdict = (differences(df, con, sqls[name]) or "ok") if name in sqls else f"rows {df.count()}"
        except Exception as error:  # noqa: BLE001
            verdict = f"FAILED {str(error)[:3000]}"
        print(f"{name:26s} {time.time() - start:6.2f}s {verdict}", flush=True)
