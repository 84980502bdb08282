"""Queries whose row order is part of the result; the comparison with the twins sorts both sides."""

import pytest

from checks import all_queries, all_twins


@pytest.mark.parametrize("name", ["rel_order", "rel_topk"])
def test_rows_in_the_order_of_the_twin(spark, duck, sf, name):
    rows = all_queries()[name](spark, sf)
    cursor = duck.execute(all_twins()[name])
    assert rows.columns == [d[0] for d in cursor.description]
    assert [tuple(r) for r in rows.collect()] == cursor.fetchall()


@pytest.mark.parametrize("name", ["q_weekday", "stored_q_weekday"])
def test_weekdays_from_monday(spark, duck, sf, name):
    days = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    got = [tuple(r) for r in all_queries()[name](spark, sf).collect()]
    assert [r[0] for r in got] == [d for d in days if d in dict(got)]
    assert dict(got) == dict(duck.execute(all_twins()[name]).fetchall())


def test_arrays_in_order(spark, sf):
    row = all_queries()["result_arrays"](spark, sf).first()
    assert row["hour"] == sorted(row["hour"]) and len(row["hour"]) == len(row["count"])
