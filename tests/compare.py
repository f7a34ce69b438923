"""Runs registered queries and their SQL side by side and compares sorted rows."""

from __future__ import annotations

import math
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: "null" if v is None else repr(float(v)) if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark, con, f, sql: str, sf_dir: str) -> str:
    df = f(spark, sf_dir)
    mine = canonical([tuple(r) for r in df.collect()], df.columns)
    rel = con.sql(sql)
    theirs = canonical(rel.fetchall(), rel.columns)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if mine != theirs:
        only = [r for r in mine if r not in set(theirs)][:2], [r for r in theirs if r not in set(mine)][:2]
        return f"{len(mine)} and {len(theirs)} rows; only here {only[0]}; only in SQL {only[1]}"
    return "" if mine else "no rows"


def main(sf_dir: str, names: list[str]) -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, queries = duck(sf_dir), e.oracle_sql(), e.queries()
    for n in names or [n for n in sql]:
        t = time.time()
        try:
            found = difference(spark, con, queries[n], sql[n], sf_dir)
        except Exception as x:
            found = f"{type(x).__name__}: {str(x)[:600]}"
        print(f"{'ok ' if not found else 'BAD'} {n} {time.time() - t:.1f}s {found}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
