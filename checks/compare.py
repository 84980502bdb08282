"""Run registered queries against their SQL twins.

    python -m checks.compare [sf_dir] [name prefix ...]
"""

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("annalist-checks")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reference(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        [columns[i] for i in order],
        sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr),
    )


def differences(spark, con, sf_dir, run, sql) -> "str | None":
    df = run(spark, sf_dir)
    got_columns, got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} != {b}"
    return None


def main(argv):
    from checks import all_queries, all_twins

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = session(), reference(sf_dir)
    twins, bad = all_twins(), 0
    for name, run in all_queries().items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        started = time.time()
        if name in twins:
            found = differences(spark, con, sf_dir, run, twins[name])
        else:
            found = f"rows only: {len(run(spark, sf_dir).collect())}"
        took = time.time() - started
        bad += found is not None and name in twins
        print(f"{'ok  ' if found is None else 'DIFF'} {name:28s} {took:6.2f}s {found or ''}", flush=True)
    print(f"{bad} differences")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
