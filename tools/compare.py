"""Run registered queries on Spark and their oracle on DuckDB; report differences.

Usage: python tools/compare.py [sf] [name-substring ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from answerlake.catalog.registry import all_entries  # noqa: E402
from answerlake.session import TABLE_NAMES, Tables, get_session  # noqa: E402


def kind(type_name: str) -> str:
    name = type_name.lower()
    for key, words in (("int", ("bigint", "long")), ("int32", ("integer", "int")), ("double", ("double",)),
                       ("float", ("float",)), ("string", ("varchar", "string")), ("bool", ("boolean",)),
                       ("date", ("date",))):
        if name in words:
            return key
    return name


def plain(value):
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    return str(value)


def compare(name, item, tables, con):
    start = time.time()
    df = item.build(tables)
    rows = df.collect()
    spark_s = time.time() - start
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in rows)
    if item.sql is None:
        return f"rows-only {len(got):>7} rows  spark {spark_s:6.2f}s", True
    start = time.time()
    cur = con.execute(item.sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: kind(str(d[1])) for d in cur.description}
    fetched = cur.fetchall()
    duck_s = time.time() - start
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    want = sorted(tuple(plain(r[i]) for i in order) for r in fetched)
    notes = []
    if sorted(cols) != names:
        return f"COLUMNS {names} vs {sorted(cols)}", False
    for field in df.schema.fields:
        mine = kind(field.dataType.simpleString())
        if mine != types[field.name]:
            notes.append(f"type {field.name}: {mine} vs {types[field.name]}")
    if len(got) != len(want):
        notes.append(f"rows {len(got)} vs {len(want)}")
    if got != want:
        only_spark = [g for g in got if g not in set(want)][:3]
        only_duck = [w for w in want if w not in set(got)][:3]
        notes.append(f"VALUES differ {names}\n   spark {only_spark}\n   duck  {only_duck}")
    if not got:
        notes.append("EMPTY")
    head = f"{len(got):>7} rows  spark {spark_s:6.2f}s  duck {duck_s:6.2f}s"
    return (head + ("  " + "; ".join(notes) if notes else "  ok"))[:1500], not notes


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    path = f"/root/testdata/sf{sf}"
    spark = get_session("local[8]", 8)
    con = duckdb.connect()
    for table in TABLE_NAMES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    failed = []
    for name, item in all_entries().items():
        if wanted and not any(w in name or item.build.__module__.endswith("." + w) for w in wanted):
            continue
        try:
            note, ok = compare(name, item, Tables(spark, path), con)
        except Exception as error:  # keep going, report at the end
            note, ok = f"ERROR {type(error).__name__}: {str(error)[:700]}", False
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:<34} {note}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
