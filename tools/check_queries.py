"""Run registered queries beside their SQL twins in DuckDB and compare.

Usage: python tools/check_queries.py [folder] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tidegrid.queries import ORACLE, QUERIES  # noqa: E402
from tidegrid.session import local_session  # noqa: E402

TABLES = ("events", "orders")


def canonical(table):
    """Rows as sorted tuples of text, columns in name order."""
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted(zip(*[[repr(v) for v in c] for c in columns]))


def type_text(arrow_type) -> str:
    text = str(arrow_type)
    return text.replace("large_string", "string").replace("timestamp[ns]", "timestamp[us]")


def main(folder: str, names: list[str]) -> int:
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in names or QUERIES:
        started = time.time()
        try:
            got = QUERIES[name](spark, folder).toArrow()
        except Exception as error:  # noqa: BLE001
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
            bad += 1
            continue
        spent = time.time() - started
        if name not in ORACLE:
            print(f"rows {name}: {got.num_rows} rows, {spent:.1f}s", flush=True)
            continue
        started = time.time()
        try:
            want = con.execute(ORACLE[name]).to_arrow_table()
        except Exception as error:  # noqa: BLE001
            print(f"SQL  {name}: {str(error)[:800]}", flush=True)
            bad += 1
            continue
        sql_spent = time.time() - started
        (a_names, a), (b_names, b) = canonical(got), canonical(want)
        types = [
            (n, type_text(got.schema.field(n).type), type_text(want.schema.field(n).type))
            for n in a_names if n in b_names
            and type_text(got.schema.field(n).type) != type_text(want.schema.field(n).type)
        ]
        same = a_names == b_names and a == b
        bad += not same or bool(types)
        print(f"{'ok  ' if same else 'DIFF'} {name}: {len(a)} rows, {spent:.1f}s (sql {sql_spent:.1f}s)"
              f"{' types ' + str(types) if types else ''}", flush=True)
        if not same:
            print("  columns", a_names, b_names) if a_names != b_names else None
            only = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
            print("  spark only", only[0], "\n  sql only  ", only[1], "counts", len(a), len(b), flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    arguments = sys.argv[1:]
    sys.exit(1 if main(arguments[0] if arguments else "/root/testdata/sf0.01", arguments[1:]) else 0)
