"""Whole sections hold the lines of the log; changes are summed inside the row of their section."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from annalist import schemas
from annalist.operators import sections, tags
from annalist.sources import shared
from checks import views


def _tables(spark, base):
    """Orders that come twice, have no line items or no key; line items of no order or no key."""
    orders = [(1, 1, "F"), (1, 1, "F"), (2, 1, "P"), (3, 1, "P"), (None, 1, "O"), (4, 2, "O")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").selectExpr(
        "*", "TIMESTAMP_NTZ '1998-02-03 00:00:00' AS o_orderdate", "if(o_orderkey = 2, '5-LOW', '1-URGENT') AS o_orderpriority"
    ).write.parquet(f"{base}/orders.parquet")
    customer = spark.createDataFrame([(1, 0, "A"), (2, 0, None)], "c_custkey long, c_nationkey int, c_mktsegment string")
    customer.write.parquet(f"{base}/customer.parquet")
    spark.createDataFrame([(0, "N")], "n_nationkey int, n_name string").write.parquet(f"{base}/nation.parquet")
    items = [(1, 7, 1, 3.0), (1, 8, 2, 4.0), (3, 12, 1, None), (4, 5, 1, 2.0), (None, 6, 1, 1.0), (77, 6, 1, 1.0)]
    items = spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double")
    items.write.parquet(f"{base}/lineitem.parquet")


def test_sections_hold_the_lines(spark, tmp_path):
    _tables(spark, str(tmp_path))
    lines = views.log_lines(spark, str(tmp_path)).collect()
    found = views.log_sections(spark, str(tmp_path)).collect()
    want = Counter((r["repo_name"], r["value"]) for r in lines if r["value"])
    assert Counter((r["repo_name"], x) for r in found for x in r["value"].split("\n") if x) == want
    # A commit that comes twice has both headers in front of all lines.
    twice = [r["value"].split("\n") for r in found if r["value"].count("<") > 4]
    assert [[x[:1] for x in t] for t in twice] == [["<", "<", "3", "4", "3", "4"]] or len(twice[0]) == 6
    # What is sent between tasks are the headers and the numbers of line items, not their text.
    plan = views.log_sections(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_numbers_are_stored_and_not_text(spark, tmp_path):
    """Before, headers were shuffled and whole sections stored and shuffled as text."""
    _tables(spark, str(tmp_path))
    parts = views.log_parts(spark, str(tmp_path))
    assert [f.name for f in parts.schema if "string" in f.dataType.simpleString()] == ["repo_name"]
    found = views.log_sections(spark, str(tmp_path)).select("repo_name", "value").collect()
    text = parts.select("repo_name", views.section_text()).collect()
    assert Counter(map(tuple, text)) == Counter(map(tuple, found))
    # A hash as bytes is in the order of its text.
    views.write_sections(parts, str(tmp_path / "log"), F.unhex(F.md5(F.col("o_orderkey").cast("string"))), views.section_text())
    views.write_sections(views.log_sections(spark, str(tmp_path)), str(tmp_path / "plain"))
    texts = [[r["value"] for r in spark.read.text(f"{tmp_path}/{x}", wholetext=True).orderBy("value").collect()] for x in ("log", "plain")]
    assert texts[0] == texts[1]


def test_parents_are_written_after_one_shuffle(spark, tmp_path):
    """The parents of a commit are its neighbours in the window, which no join has to find."""
    _tables(spark, str(tmp_path))
    orders = [(k, 1 + k % 7 // 6, "F") for k in range(1, 120)] + [(40, 1, "F"), (None, 1, "F")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").selectExpr(
        "*", "TIMESTAMP_NTZ '1998-02-03 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority"
    ).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    lines = views.parent_lines(spark, str(tmp_path))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    md5 = lambda k: hashlib.md5(str(k).encode()).hexdigest()
    want = []
    for repo, cust in (("A/N", 1), (None, 2)):
        own = sorted((o[0] for o in orders if o[1] == cust), key=lambda k: (k is not None, k))
        of = {}
        for n, k in enumerate(own, 1):
            back = [n - 1] if n % 40 in (0, 17) else [n - 2, n - 5] if n % 40 in (1, 18) else [n - 1, n - 5]
            of.setdefault(k, []).extend((at, own[p - 1]) for at, p in enumerate(x for x in back if x > 0) if k is not None and repo)
        for n, k in enumerate(own, 1):
            named = [md5(p) for _, p in sorted(((at, p) for at, p in of[k] if p is not None), key=lambda x: (x[0], md5(x[1])))]
            want.append((repo, " ".join([*([md5(k)] if k is not None else []), str(100 * n), *named])))
    assert Counter((r[0], r[1].rstrip(" ")) for r in lines.collect()) == Counter(want)


def test_changes_of_few_extensions_are_summed_in_their_row(spark):
    many = [(f"e{k % 50}", k, 1) for k in range(500)]
    rows = [(0, [("py", 1, 2), ("", 3, 4), ("py", 5, 6)]), (1, many), (2, []), (3, [("go", 1, 1)])]
    kind = schemas.PARSED["entries"].dataType.simpleString()
    base = spark.createDataFrame(rows, f"section long, entries {kind}")
    others = [f"CAST('x' AS {f.dataType.simpleString()}) AS {f.name}" if f.dataType.simpleString() == "string"
              else f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}"
              for f in schemas.PARSED if f.name not in ("section", "entries")]
    place = shared.folder(spark, "few")
    base.selectExpr("*", *others).write.parquet(place)
    got = sections.changes(spark.read.schema(schemas.PARSED).parquet(place))
    want = Counter({("py", 6, 8): 1, ("", 3, 4): 1, ("go", 1, 1): 1})
    for e in range(50):
        want[(f"e{e}", sum(range(e, 500, 50)), 10)] += 1
    assert Counter((r["ext"], r["insertion"], r["deletion"]) for r in got.collect()) == want
    first = got._jdf.queryExecution().optimizedPlan().children().apply(0).toString()
    assert "Aggregate" not in first and "Join" not in first


def test_sections_are_made_once(spark, tmp_path):
    """Finding the ranges to write in does not make all sections a second time."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [("a/b", f"{k:03}", f"<{k}>\n1\t2\tx.py") for k in range(40)] + [(None, None, "<none>"), ("a/b", "007", "")]
    found = spark.createDataFrame(rows, "repo_name string, hash string, value string")
    views.write_sections(found.mapInArrow(counted, found.schema), str(tmp_path / "log"))
    assert made.value == len(rows)
    back = spark.read.schema("value string, repo_name string").text(str(tmp_path / "log"))
    want = Counter((r[0], x) for r in rows for x in r[2].split("\n"))
    assert Counter((r["repo_name"], r["value"]) for r in back.collect()) == want


def test_headers_of_references_are_searched_once(spark):
    headers = [
        "<Tue, 3 Feb 1998 01:02:03 +0800> <h> <n> <e>",
        "x<3 Feb 1998 01:02:03 -0000> <h> <a <b> c> <e> tail",
        "<no date> <h> <n> <e>",
        "<> <h> <n> <e>",
        "<only> <three> <parts>",
        "",
        None,
    ]
    rows = [("r", f"h{k}", f"t{k}", x) for k, x in enumerate(headers)]
    refs = spark.createDataFrame(rows, "repo_name string, hash string, tag string, header string")
    commits = spark.createDataFrame([("r", "h5", "1999-01-01T00:00:00+00:00")], "repo_name string, hash string, datetime string")
    want = {"t0": "1998-02-03T01:02:03+08:00", "t1": "1998-02-03T01:02:03+00:00", "t2": "", "t3": "",
            "t4": None, "t5": "1999-01-01T00:00:00+00:00", "t6": None}
    assert {r["tag"]: r["datetime"] for r in tags.dated(refs, commits).collect()} == want
    place = shared.folder(spark, "refs")
    tags.with_dates(refs).write.parquet(place)
    found = tags.dated(spark.read.parquet(place), commits)
    assert {r["tag"]: r["datetime"] for r in found.collect()} == want
    # One search tells whether it is a header, one more is the date; the date's parts are cut from that.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 0
    alone = refs.select(F.col("tag"), tags.header_date("header").alias("date"))
    assert alone._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 2


def test_plain_headers_are_their_own_match(values):
    plain = ["<d> <h> <n> <e>", "<> <> <> <>", "<d> <h\tx> <n\u00fc> <e>"]
    odd = ["<d> <h> <n> <e> ", "x<d> <h> <n> <e>", "<d> <h> <n>", "<d> <h> <n> <e> <f>", "<a<b> <h> <n> <e>>", "", None, "<d>  <h> <n> <e>",
           "<d> <h> <n> <e>\r", "<d> <h\u2028> <n> <e>"]
    inputs = plain + odd
    got = values(
        "string",
        inputs,
        lambda c: sections.matched_header(F.col(c)),
        lambda c: F.regexp_extract(c, sections.HEADER, 0),
    )
    assert [a for a, _ in got] == [b for _, b in got]
    assert [a for a, _ in got[:3]] == plain
