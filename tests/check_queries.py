"""Compare named queries with their SQL: ``python tests/check_queries.py SF_DIR [name-part ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def kind_of(name: str) -> str:
    """Type families that must agree; sums of whole numbers in SQL need a cast to BIGINT."""
    name = name.lower()
    if name in ("tinyint", "smallint", "int", "integer", "bigint", "utinyint", "usmallint", "uinteger", "ubigint"):
        return "whole"
    if name in ("float", "double"):
        return "real"
    if name in ("string", "varchar"):
        return "text"
    return name


def key_of(row):
    return tuple((v is None, f"{v:.3f}" if isinstance(v, float) else str(v)) for v in row)


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None or isinstance(a, str) or isinstance(b, str):
            return a == b
        return a == b or abs(a - b) <= 1e-6 + 1e-9 * abs(b)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))
    return a == b


def compare(frame, connection, sql: str) -> tuple[bool, str]:
    columns = sorted(frame.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in frame.collect()]
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return False, f"columns {columns} != {sorted(names)}"
    kinds = {d[0]: kind_of(str(d[1])) for d in cursor.description}
    wrong = {c: (t, kinds[c]) for c, t in frame.dtypes if kind_of(t) != kinds[c]}
    if wrong:
        return False, f"types differ: {wrong}"
    order = [names.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in order) for r in cursor.fetchall()]
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    got.sort(key=key_of)
    want.sort(key=key_of)
    bad = [(g, w) for g, w in zip(got, want) if not all(same(x, y) for x, y in zip(g, w))]
    exact = sum(g != w for g, w in zip(got, want))
    if bad:
        g, w = bad[0]
        diff = [(c, x, y) for c, x, y in zip(columns, g, w) if not same(x, y)]
        return False, f"{len(bad)} of {len(got)} rows differ, first: {str(diff)[:600]} in {str(g)[:200]}"
    spread = [c for i, c in enumerate(columns) if len({g[i] for g in got}) > 1]
    return True, f"{len(got)} rows, {exact} inexact, varying {len(spread)}/{len(columns)}"


def main() -> int:
    import __spark_entry__ as entry
    from clausespark.session import get_session

    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark = get_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for name, query in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        began = time.time()
        try:
            frame = query(spark, sf_dir)
            if name in oracle:
                good, note = compare(frame, connection, oracle[name])
            else:
                rows = frame.collect()
                good, note = len(rows) > 0, f"rows only: {len(rows)}"
        except Exception as error:  # report and go on with the next query
            good, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{'ok  ' if good else 'FAIL'} {name} {time.time() - began:.1f}s {note}", flush=True)
        if not good:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
