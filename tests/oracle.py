"""Run queries and their SQL side by side: python tests/oracle.py SF_DIR [name ...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return "null" if v is None else str(v)

    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def spark_result(df):
    return _canonical(df.columns, [tuple(r) for r in df.collect()])


def duck_result(con, sql):
    cur = con.execute(sql)
    return _canonical([d[0] for d in cur.description], cur.fetchall())


def difference(left, right):
    """None if equal, else a short description."""
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows != {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if a != b:
            return f"{str(a)[:300]} != {str(b)[:300]}"
    return None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            got = spark_result(queries[name](spark, sf_dir))
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: {str(e)[:3000]}", flush=True)
            continue
        took = time.time() - start
        verdict = "rows-only" if name not in oracles else difference(got, duck_result(con, oracles[name])) or "ok"
        bad += verdict not in ("ok", "rows-only")
        print(f"{name:32s} {len(got[1]):8d} rows {took:6.2f}s {time.time() - start - took:6.2f}s  {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
