"""Compare catalogue queries with their SQL in DuckDB.

As a script: ``python tests/oracle.py SF_DIR [query ...]``.
"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(pdf):
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pdf[c].dtype == object:
            pdf[c] = pdf[c].map(lambda v: None if v is None or v != v else v)
        elif pd.api.types.is_integer_dtype(pdf[c]) or pd.api.types.is_float_dtype(pdf[c]):
            pdf[c] = pdf[c].astype(float)
    return pdf.sort_values(list(pdf.columns), na_position="last").reset_index(drop=True)


def differences(spark, con, run, sql, sf_dir):
    """Empty when both results hold the same rows, else a description."""
    mine = canonical(run(spark, sf_dir).toPandas())
    theirs = canonical(con.execute(sql).df())
    if list(mine.columns) != list(theirs.columns):
        return f"columns {list(mine.columns)} / {list(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    if len(mine) == 0:
        return "no rows"
    bad = []
    for c in mine.columns:
        a, b = mine[c], theirs[c]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            at = same.idxmin()
            bad.append(f"{c}: {(~same).sum()} differ, first {a[at]!r} / {b[at]!r}")
    return "; ".join(bad)


def main(sf_dir, names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("FATAL")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sqls:
                found = differences(spark, con, run, sqls[name], sf_dir)
                note = "same" if not found else "DIFFERENT " + found
            else:
                pdf = run(spark, sf_dir).toPandas()
                note = f"rows only: {len(pdf)}"
        except Exception as e:  # report and go on with the next query
            note = "FAILED " + str(e)[:600]
        failed += note.startswith(("DIFF", "FAIL"))
        print(f"{name:28s} {time.time() - start:6.1f}s  {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
