"""Runs registered queries beside their SQL in DuckDB and compares schema and rows.

    python tests/compare.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
DATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date", "FLOAT": "float",
    "SMALLINT": "smallint", "TINYINT": "tinyint",
}


def _value(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(df, con, sql) -> str | None:
    """None when equal, else the first difference."""
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = [KINDS.get(str(d[1]), str(d[1])) for d in res.description]
    expected = rows_of(names, res.fetchall())
    ours = dict(df.dtypes)
    if sorted(ours) != sorted(names):
        return f"columns {sorted(ours)} != {sorted(names)}"
    wrong = {n: (ours[n], k) for n, k in zip(names, kinds) if ours[n] != k}
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(actual) != len(expected):
        return f"rows {len(actual)} != {len(expected)}"
    for a, b in zip(actual, expected):
        if a != b:
            return f"spark {a}\n      duck  {b}"
    if wrong:
        return f"types (spark, duckdb) {wrong}"
    return None


def main(argv: list[str]) -> int:
    from dqengine.session import local_session

    import __spark_entry__ as entry

    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"{DATA}/sf{sf}"
    spark = local_session(cores="8")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            if name in oracles:
                found = difference(query(spark, sf_dir), con, oracles[name])
                label = "ok" if found is None else "DIFF " + found
                bad += found is not None
            else:
                label = f"rows {query(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            label, bad = f"ERROR {type(error).__name__}: {str(error)[:600]}", bad + 1
        print(f"{name:45s} {time.time() - start:6.2f}s {label}", flush=True)
    print(f"{bad} bad of {len(queries)} queries, {len(oracles)} with SQL")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
