"""Run registered queries beside their oracle SQL in DuckDB and compare all rows.

    python tests/compare.py [folder] [name-part ...]
"""

import collections
import datetime
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.10g}")
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    return str(v)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, collections.Counter(
        tuple(plain(r[n]) for n in names) for r in df.collect()
    )


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    names = sorted(cols)
    where = [cols.index(n) for n in names]
    return names, collections.Counter(
        tuple(plain(r[i]) for i in where) for r in cur.fetchall()
    )


def compare(df, con, sql):
    names, got = rows_of_spark(df)
    want_names, want = rows_of_duck(con, sql)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if got != want:
        more, less = got - want, want - got
        return (f"rows {sum(got.values())} vs {sum(want.values())}; "
                f"only here {list(more.items())[:3]}; only oracle {list(less.items())[:3]}")
    return None


def main():
    import __spark_entry__ as entry
    from rolecall.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            df = build(spark, folder)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                n = ""
            else:
                n = f"rows only: {df.count()}"
                problem = None
        except Exception as e:  # report and go on with the next query
            problem, n = f"{type(e).__name__}: {str(e)[:900]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - started:6.2f}s {name} {n}", flush=True)
        if problem:
            print("     ", problem[:1500], flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
