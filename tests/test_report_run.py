"""Statements in the history dialect, and reports over one scan."""

import pytest
from pyspark.sql import functions as F

from annalist.functions import sqlfn
from annalist.operators import results
from annalist.plans import report_run
from annalist.sources import shared, tables
from checks import views

CASES = [
    ("select year(datetime) from 'db.commit' limit 1;", "select rfc_year(datetime) from db.commit limit 1"),
    ("SELECT min( Timestamp(x)) FROM \"db.tag\" JOIN 'db.b' ON 1=1", "SELECT min( rfc_timestamp(x)) FROM db.tag JOIN db.b ON 1=1"),
    ("SELECT 'year(x)', `hour(y)`, commit_year(z), t.year, year FROM a", "SELECT 'year(x)', `hour(y)`, commit_year(z), t.year, year FROM a"),
    ("SELECT active_longest_days(concat(a, ')', b)) AS n, hour(c)", "SELECT streak_days(collect_set(rfc_utc_day(concat(a, ')', b)))) AS n, rfc_hour(c)"),
    ("SELECT weekday(timestamp_rfc3339(timestamp(d))), weeknum(d)", "SELECT rfc_weekday(timestamp_rfc3339(rfc_timestamp(d))), weeknum(d)"),
    ("SELECT 'it''s year(x)' , month (d)", "SELECT 'it''s year(x)' , rfc_month(d)"),
]


@pytest.mark.parametrize("text, want", CASES)
def test_statements_in_the_history_dialect(text, want):
    assert report_run.spark_statement(text) == want
    assert report_run.spark_statement(want) == want


def test_open_brackets_are_refused():
    with pytest.raises(ValueError):
        report_run.spark_statement("SELECT active_longest_days(a")


@pytest.fixture(scope="module")
def base(spark, sf):
    base = shared.folder(spark, "dialect-db")
    tables.write_table("commit", views.commits(spark, sf), base)
    tables.register_database(spark, "dialect_db", base)
    return base


REPORT = {
    "a": ["SELECT c.author_name, count(*) AS n FROM 'dialect_db.commit' c GROUP BY c.author_name",
          "SELECT year(datetime) AS y, active_longest_end(datetime) AS e FROM dialect_db.commit GROUP BY y"],
    "b": ["SELECT count(DISTINCT hash) AS n FROM 'dialect_db.commit' WHERE commit.branch = 'main'"],
}


def test_shared_scan_gives_the_same(spark, base, monkeypatch):
    staged = []
    read = report_run._share
    monkeypatch.setattr(report_run, "_share", lambda *a: staged.append(read(*a)) or staged[-1])
    alone = report_run.run_report(spark, {k: [s.replace("commit.branch", "branch") for s in v] for k, v in REPORT.items()}, shared.folder(spark, "alone"))
    assert not staged
    removed = []
    monkeypatch.setattr(report_run.shared, "remove", lambda s, p: removed.append(s.read.parquet(p).columns))
    both = report_run.run_report(spark, REPORT, shared.folder(spark, "both"), share=["dialect_db.commit"])
    # One stage of the columns in use, and the statements' plans read nothing else.
    assert len(staged) == 1 and sorted(removed[0]) == ["author_name", "branch", "datetime", "hash"]
    assert not spark.catalog.tableExists("commit")
    for name in REPORT:
        for one, other in zip(alone[name], both[name], strict=True):
            assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_all_columns_for_a_star():
    assert report_run._used_columns(["a", "b"], ["SELECT count(*), a FROM t"]) == ["a"]
    assert report_run._used_columns(["a", "b"], ["SELECT a * 2 FROM t"]) == ["a"]
    for star in ("SELECT * FROM t", "select distinct * from t", "SELECT a, * FROM t", "SELECT t.* FROM t"):
        assert report_run._used_columns(["a", "b"], [star]) == ["a", "b"]


def test_streaks_by_name_over_no_rows(spark, base):
    sqlfn.register(spark)
    text = report_run.spark_statement("SELECT active_longest_days(datetime), active_longest_start(datetime) FROM 'dialect_db.commit' WHERE hash = ''")
    assert tuple(spark.sql(text).first()) == (0, "1970-01-01")


@pytest.mark.parametrize("rows, order", [(7, ["k"]), (1000, ["k"]), (10, None)])
def test_array_blocks_are_full_and_in_order(spark, rows, order):
    frame = spark.range(503).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("v"))
    got = sorted(results.array_blocks(frame.repartition(5), order or [F.desc("k")], rows).collect())
    keys = [x for r in got for x in r["k"]]
    assert keys == sorted(range(503), reverse=rows == 10)
    assert [len(r["k"]) for r in got[:-1]] == [rows] * (len(got) - 1) and [r["first"] for r in got] == [i * rows for i in range(len(got))]
    assert [x for r in got for x in r["v"]] == [str(k) if k % 3 == 0 else None for k in keys]


def test_array_blocks_of_nothing(spark):
    assert results.array_blocks(spark.range(0).toDF("k"), ["k"]).count() == 0
    with pytest.raises(ValueError):
        results.array_blocks(spark.range(1).toDF("Block"), ["Block"])
