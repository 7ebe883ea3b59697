"""Compare registered queries with their SQL twins.

    python tests/check_queries.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("null",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, float):
        return ("f", repr(v + 0.0))
    return ("s", str(v))


def compare(df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    expected = rel.fetchall()
    cols = sorted(df.columns)
    if cols != sorted(names):
        return f"columns {cols} / {sorted(names)}"
    got = [[_cell(r[c]) for c in cols] for r in df.collect()]
    order = [names.index(c) for c in cols]
    want = [[_cell(r[i]) for i in order] for r in expected]
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    got.sort(), want.sort()
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} of {len(got)} rows differ; columns {cols}; first {bad[0]}" if bad else None


def main() -> None:
    import __spark_entry__ as entry
    from flowloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(8), duck(sf_dir)
    twins, failed = entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = run(spark, sf_dir)
            if name in twins:
                t1 = time.time()
                out = compare(df, con, twins[name])
                note = out or "ok"
            else:
                rows = df.count()
                out, note = (None if rows else "no rows"), f"rows {rows}"
                t1 = time.time()
        except Exception as e:  # noqa: BLE001
            out = note = f"{type(e).__name__}: {str(e)[:1500]}"
            t1 = time.time()
        if out:
            failed.append(name)
        print(f"{'FAIL' if out else 'pass'} {name} {time.time() - t0:.1f}s (build {t1 - t0:.1f}s) {note}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
