"""Run registered queries beside their SQL twins in DuckDB and report differences.

usage: compare.py [sf_dir] [name …]
"""

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from pagegraph.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute("CREATE VIEW {0} AS SELECT * FROM '{1}/{0}.parquet'".format(name, sf_dir))
    return con


def text_rows(rows, order):
    return sorted(tuple("∅" if row[i] is None else str(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, name, run, sql):
    start = time.time()
    df = run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    mine = text_rows(rows, order)
    if sql is None:
        return "rows-only", len(mine), took, None
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = text_rows(result.fetchall(), sorted(range(len(names)), key=lambda i: names[i]))
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", len(mine), took, (sorted(df.columns), sorted(names))
    if mine == theirs:
        return "ok", len(mine), took, None
    only_mine = sorted(set(mine) - set(theirs))[:3]
    only_theirs = sorted(set(theirs) - set(mine))[:3]
    return "DIFF", len(mine), took, (sorted(df.columns), len(theirs), only_mine, only_theirs)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from pagegraph.plans import all_queries, oracles

    queries, sqls = all_queries(), oracles()
    names = sys.argv[2:] or list(queries)
    spark = build_session("compare", master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            state, count, took, detail = compare(spark, con, sf_dir, name, queries[name], sqls.get(name))
        except Exception as error:  # report and go on
            state, count, took, detail = "ERROR", 0, 0.0, str(error)[:900]
        bad += state not in ("ok", "rows-only")
        print("{:10s} {:24s} {:8d} rows {:6.2f}s {}".format(state, name, count, took, detail or ""), flush=True)
    print("{} queries, {} with SQL, {} bad".format(len(names), sum(n in sqls for n in names), bad))
    spark.stop()
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
