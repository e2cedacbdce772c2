"""Run registered queries and their SQL twins side by side: ``check.py SF_DIR [names]``."""

from __future__ import annotations

import logging
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from cueweave.catalog import QUERIES  # noqa: E402
from cueweave.catalog_sql import ORACLE  # noqa: E402
from cueweave.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v + 0.0:.6f}"
    if isinstance(v, int):
        return f"{float(v):.6f}"
    if hasattr(v, "as_tuple"):
        return f"{float(v):.6f}"
    return str(v)


def compare(df, con, query: str) -> str:
    cols = sorted(df.columns)
    mine = sorted(tuple(_key(v) for v in row) for row in df.select(*[f"`{c}`" for c in cols]).collect())
    res = con.execute(query)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"COLUMNS {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    other = sorted(tuple(_key(row[i]) for i in order) for row in res.fetchall())
    if mine == other:
        return f"ok {len(mine)}"
    a, b = set(mine), set(other)
    return f"DIFF rows {len(mine)} vs {len(other)}; {cols} only spark {sorted(a - b)[:2]} only sql {sorted(b - a)[:2]}"


def main() -> None:
    logging.disable(logging.CRITICAL)
    sf_dir, names = sys.argv[1], sys.argv[2:] or [n for n in QUERIES if n in ORACLE]
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name in names:
        t = time.time()
        try:
            out = compare(QUERIES[name](spark, sf_dir), con, ORACLE[name])
        except Exception as exc:  # noqa: BLE001
            out = "FAIL " + str(exc)[:700]
        bad += not out.startswith("ok")
        print(f"{name:24s} {time.time() - t:6.1f}s {out}", flush=True)
    print("bad:", bad, "without SQL twin:", [n for n in QUERIES if n not in ORACLE])


if __name__ == "__main__":
    main()
