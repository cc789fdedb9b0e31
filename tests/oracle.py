"""Compare registered queries with their SQL twins in DuckDB.

``python tests/oracle.py [prefix ...]`` checks the queries whose name starts
with one of the prefixes at the scale of ``$SF_DIR``.
"""

from __future__ import annotations

import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads=4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(t: str) -> str:
    t = t.lower()
    for k in ("bigint", "long", "int64"):
        if t.startswith(k):
            return "long"
    if t in ("int", "integer", "int32"):
        return "int"
    if t in ("varchar", "string", "json"):
        return "string"
    return {"float": "float", "double": "double", "boolean": "bool", "bool": "bool"}.get(t, t)


def compare(spark_df, con, sql: str) -> list[str]:
    """Problems between the Spark result and the SQL result; empty when they agree."""
    rel = con.sql(sql)
    names = sorted(spark_df.columns)
    problems = []
    if names != sorted(rel.columns):
        return [f"columns {names} vs {sorted(rel.columns)}"]
    st, dt = dict(spark_df.dtypes), dict(zip(rel.columns, map(str, rel.types)))
    for n in names:
        if _kind(st[n]) != _kind(dt[n]):
            problems.append(f"type of {n}: {st[n]} vs {dt[n]}")
    key = lambda r: tuple((v is None, str(v)) for v in r)
    clean = lambda v: float(v) if isinstance(v, Decimal) else (v + 0.0 if isinstance(v, float) else v)
    a = sorted((tuple(clean(r[n]) for n in names) for r in spark_df.collect()), key=key)
    b = sorted((tuple(map(clean, r)) for r in rel.select(*[f'"{n}"' for n in names]).fetchall()), key=key)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} vs {len(b)}")
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        problems.append(f"{len(diff)} rows differ, first {str(diff[0])[:700]}")
    if not a:
        problems.append("note: empty result")
    return problems


def main(prefixes: list[str]) -> int:
    import __spark_entry__ as entry
    from framelens.session import build_session
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                  "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                problems = compare(df, con, sqls[name])
            else:
                n = df.count()
                problems = [] if n else ["note: empty result"]
        except Exception as exc:  # report and go on
            problems = [f"{type(exc).__name__}: {str(exc)[:900]}"]
        bad += any(not p.startswith("note") for p in problems)
        state = "ok  " if not problems else "FAIL" if any(not p.startswith("note") for p in problems) else "note"
        print(f"{state} {'S' if name in sqls else 'R'} {name} {time.time() - t0:.1f}s", *problems, sep="\n     " if problems else " ", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
