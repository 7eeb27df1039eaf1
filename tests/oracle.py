"""Side-by-side run of registered queries and their SQL in DuckDB."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(value):
    if value is None or value != value:
        return "~"
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, text, sf_dir) -> str | None:
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(text)
    columns = [c[0] for c in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"first difference {sorted(columns)}: spark {g} sql {w}"
    if not got:
        return "EMPTY"
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    wants = {c[0]: str(c[1]) for c in cur.description}
    loose = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    off = {c: (kinds[c], wants[c]) for c in kinds if loose.get(kinds[c], kinds[c]) != wants[c]}
    return f"types {off}" if off else None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries

    from alarmlake.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("local[8]")
    con = connect(sf_dir)
    sqls = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, name, fn, sqls[name], sf_dir)
            else:
                n = len(fn(spark, sf_dir).collect())
                problem = None if n else "EMPTY"
        except Exception as error:  # report every query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {'' if name in sqls else '(no sql) '}{problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
