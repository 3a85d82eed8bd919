"""Side-by-side check of a registered query against its DuckDB oracle.

Mirrors the correctness gate: same column names, same row count, same
multiset of rows (floats compared after rounding to 6 digits).
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from scorewise.sources.tables import TABLES, table_path


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    from scorewise.plans.catalog import REGISTRY
    fn, oracle = REGISTRY[name]
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t_spark, 2)}
    if oracle is None:
        res["status"] = "rows-only"
        return res
    con = con or duck_connection(sf_dir)
    cur = con.execute(oracle)
    o_cols = [d[0] for d in cur.description]
    o_rows = cur.fetchall()
    res["oracle_rows"] = len(o_rows)
    if sorted(s_cols) != sorted(o_cols):
        res["status"] = f"COLUMNS spark={sorted(s_cols)} oracle={sorted(o_cols)}"
        return res
    a, b = _rows(s_cols, s_rows), _rows(o_cols, o_rows)
    if len(a) != len(b):
        res["status"] = "ROWCOUNT"
        return res
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    res["status"] = "ok" if not bad else f"VALUES {len(bad)} differ, e.g. {bad[:2]}"
    return res


def main(argv):
    from scorewise.plans.catalog import REGISTRY
    from scorewise.session import local_session
    sf_dir = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")] or list(REGISTRY)
    dirs = [a for a in argv if a.startswith("/")]
    if dirs:
        sf_dir = dirs[0]
    spark = local_session()
    con = duck_connection(sf_dir)
    failed = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # noqa: BLE001 - report and continue
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        if r["status"] not in ("ok", "rows-only"):
            failed += 1
        print(r, flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")


if __name__ == "__main__":
    main(sys.argv[1:])
