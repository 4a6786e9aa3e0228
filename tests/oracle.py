"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


def _kind(t):
    t = t.lower()
    for name, words in {
        "int": ("int", "long", "short", "byte", "hugeint"), "float": ("double", "float"), "text": ("string", "varchar"),
        "bool": ("bool",),
    }.items():
        if any(w in t for w in words) and "[" not in t and "array" not in t:
            return name
    return t


def compare(spark, con, name, fn, sql, sf_dir):
    """(ok, message)"""
    started = time.time()
    df = fn(spark, sf_dir)
    columns = sorted(df.columns)
    left = [tuple(r) for r in df.select(*columns).collect()]
    spent = time.time() - started
    if sql is None:
        return len(left) >= 0, f"{name}: {len(left)} rows, no SQL, {spent:.1f}s"
    started = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: _kind(str(d[1])) for d in cur.description}
    right = cur.fetchall()
    sql_spent = time.time() - started
    if sorted(names) != columns:
        return False, f"{name}: columns {columns} against {sorted(names)}"
    pick = [names.index(c) for c in columns]
    a = sorted(tuple(map(_cell, r)) for r in left)
    b = sorted(tuple(_cell(r[i]) for i in pick) for r in right)
    types = dict(df.dtypes)
    odd = {c: (types[c], kinds[c]) for c in columns if _kind(types[c]) != kinds[c]}
    if a != b:
        in_a, in_b = set(a), set(b)
        only_a, only_b = [r for r in a if r not in in_b][:3], [r for r in b if r not in in_a][:3]
        return False, f"{name}: rows {len(a)} against {len(b)}\n  columns {columns}\n  spark {only_a}\n  sql   {only_b}"
    if odd:
        return False, f"{name}: types differ {odd}"
    return True, f"{name}: {len(a)} rows agree, spark {spent:.1f}s, sql {sql_spent:.1f}s"


if __name__ == "__main__":
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = root
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, message = compare(session, con, name, fn, oracles.get(name), sf_dir)
        except Exception as error:  # report every query
            ok, message = False, f"{name}: {type(error).__name__} {str(error)[:900]}"
        print("ok " if ok else "BAD", message, flush=True)
        if not ok:
            bad.append(name)
    print("failing:", bad)
