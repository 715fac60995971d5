"""Local twin of the driver's correctness gate: run a registered query in Spark
and its SQL in DuckDB over the same parquet tables, then compare row count,
column names and order-insensitive values."""

from __future__ import annotations

import math
from collections.abc import Iterable

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if not isinstance(x, tuple) else str(x)) for x in row)


def compare(spark_rows: list[dict], duck_rows: list[dict], tol: float = 1e-9) -> tuple[bool, str]:
    if len(spark_rows) != len(duck_rows):
        return False, f"rows {len(spark_rows)} vs {len(duck_rows)}"
    if not spark_rows:
        return True, "empty"
    sc, dc = sorted(spark_rows[0]), sorted(duck_rows[0])
    if sc != dc:
        return False, f"columns {sc} vs {dc}"
    a = sorted((tuple(_norm(r[c]) for c in sc) for r in spark_rows), key=_key)
    b = sorted((tuple(_norm(r[c]) for c in sc) for r in duck_rows), key=_key)
    exact = a == b
    worst = 0.0
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool):
                worst = max(worst, abs(float(x) - float(y)))
            elif x != y:
                return False, f"value {x!r} vs {y!r} in row {ra} / {rb}"
    if exact:
        return True, "exact"
    return worst <= tol, f"max abs diff {worst:g}"


def check(spark, sf_dir: str, names: Iterable[str] | None = None, verbose: bool = True):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck_connect(sf_dir)
    out = {}
    for name in (names or qs):
        if name not in sqls:
            n = qs[name](spark, sf_dir).count()
            out[name] = (None, f"rows-only {n}")
            continue
        sdf = qs[name](spark, sf_dir)
        srows = [r.asDict(recursive=True) for r in sdf.collect()]
        cur = con.execute(sqls[name])
        cols = [d[0] for d in cur.description]
        drows = [dict(zip(cols, r)) for r in cur.fetchall()]
        ok, why = compare(srows, drows)
        out[name] = (ok, why)
        if verbose:
            print(f"{'OK ' if ok else 'BAD'} {name}: {why}", flush=True)
    return out
