"""Runs registered queries beside their SQL twins in DuckDB and compares values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from particlelake.plans.catalog import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, float) and value == 0.0:
        return 0.0
    return value


def _sort_key(row):
    return tuple((v is not None, str(type(v).__name__ if not isinstance(v, (int, float, bool)) else "n"),
                  round(v, 4) if isinstance(v, float) else v) for v in row)


def compare(spark, con, name: str, sf_dir: str) -> dict:
    """Row count, column names, exact mismatches and the largest relative gap."""
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = [tuple(_plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    seconds = time.time() - started
    result = {"name": name, "rows": len(mine), "seconds": seconds, "ok": True, "note": ""}
    if name not in ORACLES:
        result["note"] = "no oracle"
        return result
    relation = con.sql(ORACLES[name])
    theirs_columns = sorted(relation.columns)
    if columns != theirs_columns:
        result.update(ok=False, note=f"columns {set(columns) ^ set(theirs_columns)}")
        return result
    order = [relation.columns.index(c) for c in columns]
    theirs = [tuple(_plain(r[i]) for i in order) for r in relation.fetchall()]
    if len(mine) != len(theirs):
        result.update(ok=False, note=f"rows {len(mine)} against {len(theirs)}")
        return result
    try:
        mine.sort(key=_sort_key)
        theirs.sort(key=_sort_key)
    except TypeError as error:
        result.update(ok=False, note=f"types differ: {error}")
        return result
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    kinds = {(c, type(x).__name__, type(y).__name__) for a, b in zip(mine, theirs) for c, x, y in zip(columns, a, b)
             if x is not None and y is not None and type(x) is not type(y)}
    if kinds:
        result["note"] = f"types {sorted(kinds)[:4]}"
    if bad:
        a, b = bad[0]
        cells = [(c, x, y) for c, x, y in zip(columns, a, b) if x != y]
        result.update(ok=False, note=f"{len(bad)} rows differ, first {cells[:6]} {result['note']}")
    return result


def main() -> None:
    from tests.conftest import make_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:] or list(QUERIES)
    spark = make_session()
    con = connect(sf_dir)
    failures = 0
    for name in wanted:
        try:
            r = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            r = {"name": name, "rows": -1, "seconds": 0.0, "ok": False, "note": f"{type(error).__name__}: {str(error)[:900]}"}
        failures += not r["ok"]
        print(f"{'ok  ' if r['ok'] else 'FAIL'} {r['name']:38s} rows={r['rows']:<8d} {r['seconds']:.2f}s {r['note']}", flush=True)
    print(f"{len(wanted)} queries, {failures} failures")


if __name__ == "__main__":
    main()
