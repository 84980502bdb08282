import pytest

from annalist.operators import results


@pytest.mark.parametrize(
    "text, expected",
    [
        ("${0:foo}", (0, "foo")),
        ("${0:foo:bar}", (0, "foo:bar")),
        ("${foo}", (0, "foo")),
        ("${12:foo}", (12, "foo")),
        ("a ${foo} b", (0, "foo")),
        ("${x:foo}", None),
        ("${}", None),
        ("${", None),
        ("{}", None),
        ("}${", None),
        ("plain", None),
    ],
)
def test_binding(text, expected):
    assert results.parse_binding(text) == expected


def test_column_arrays_keep_order_and_nulls(spark):
    df = spark.createDataFrame([(3, "c"), (1, None), (2, "b")], "k int, v string")
    row = results.column_arrays(df, ["k"]).first()
    assert (row.k, row.v) == ([1, 2, 3], [None, "b", "c"])


def test_series_joins_on_the_label(spark):
    first = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "hour int, count int")
    second = spark.createDataFrame([(3, 300), (1, 100)], "hour int, count int")
    got = results.chart_series(
        [first, second],
        "${hour}",
        {"a": "${0:count}", "b": "${1:count}", "none": "${7:count}", "no": "${gone}", "lit": "x"},
    )
    assert got.columns == ["label", "a", "b", "none", "no", "lit"]
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 10, 100, None, None, "x"),
        (2, 20, None, None, None, "x"),
        (3, 30, 300, None, None, "x"),
    ]
    with pytest.raises(ValueError):
        results.chart_series([first], "literal", {})


def test_series_loses_nothing(spark):
    first = spark.createDataFrame([(1, 10), (2, 20), (None, 5)], "hour int, count int")
    second = spark.createDataFrame([(2, 200), (3, 300), (None, 50)], "hour int, count int")
    got = results.chart_series([first, second], "${hour}", {"a": "${0:count}", "b": "${1:count}"})
    assert sorted(map(tuple, got.collect()), key=repr) == [
        (1, 10, None),
        (2, 20, 200),
        (3, None, 300),
        (None, 5, 50),
    ]


def test_chart_arrays(spark):
    first = spark.createDataFrame([(2, 20), (1, 10)], "hour int, count int")
    second = spark.createDataFrame([("b", None), ("a", 5)], "k string, n int")
    row = results.chart_arrays(
        [first, second],
        [["hour"], ["k"]],
        ["before", "${hour}", "${1:k}", "${no}"],
        {"x": ["${count}", 7, "${9:count}"], "y": ["${1:n}"], "z": []},
    ).first()
    assert row.labels == ["before", "1", "2", "a", "b"]
    assert (row.x, row.y, row.z) == ([10.0, 20.0, 7.0], [5.0, None], [])


def test_share(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "k string, n int")
    got = {r.k: r.share for r in results.with_share(df, "n").collect()}
    assert got == {"a": "12.50%", "b": "37.50%", "c": "50.00%"}
    # 1.005 % is a little less as a binary number; 12.125 % is a true half.
    for n, rest, want in ((201, 19799, "1.00%"), (97, 703, "12.13%"), (1, 2, "33.33%"), (0, 1, "0.00%")):
        df = spark.createDataFrame([("a", n), ("b", rest)], "k string, n int")
        assert {r.k: r.share for r in results.with_share(df, "n").collect()}["a"] == want


def test_round2(values):
    inputs = [0.125, -0.125, 1.004, 2.0958904109589, 0.0, None]
    assert values("double", inputs, results.round2) == [0.13, -0.12, 1.0, 2.1, 0.0, None]
