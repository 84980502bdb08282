import json

from pyspark.sql import functions as F

from annalist import schemas
from annalist.operators import linecount, tags
from annalist.plans.load import load
from annalist.plans.report_run import run_report
from annalist.sources import logs, manifest as manifests, shared, tables
from checks import views


def test_csv_keeps_empty_text_and_quotes(spark):
    rows = [
        ("o/a", "123", "", "2021-10-12T14:20:50+08:00", 'An "x", Lee', "a@b", "b", "", 1, 2),
        ("o/b", "0001", "main", "", "back\\slash", "", "", "py", 0, 0),
        ("o/c", "12e3", " main ", "", "  two  blanks ", '"', "\\", "c\\", 0, 0),
    ]
    df = spark.createDataFrame(rows, schemas.CHANGE)
    base = shared.folder(spark, "csv")
    tables.write_csv("change", df, base)
    got = tables.read_csv(spark, "change", base)
    assert got.dtypes == [(f.name, f.dataType.simpleString()) for f in schemas.CHANGE]
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows)


def test_csv_written_elsewhere(spark, tmp_path):
    """Both an unquoted and a quoted empty field come back as ''."""
    folder = tmp_path / "tag"
    folder.mkdir()
    (folder / "tag.csv").write_text('repo_name,branch,datetime,tag\no/a,,"",20210101\n')
    row = tables.read_csv(spark, "tag", str(tmp_path)).first()
    assert tuple(row) == ("o/a", "", "", "20210101")


def test_csv_in_single_files(spark, tmp_path):
    (tmp_path / "active.csv").write_text("repo_name,forks,stars\no/a,3,4\n")
    (tmp_path / "tag.csv").write_text("repo_name,branch,datetime,tag\no/a,,,v1\n")
    assert tables.register_database(spark, "files", str(tmp_path), "csv") == ["tag", "active"]
    assert tuple(spark.table("files.active").first()) == ("o/a", 3, 4)
    assert tuple(spark.table("files.tag").first()) == ("o/a", "", "", "v1")


def test_databases_side_by_side(spark):
    first, second = shared.folder(spark, "db"), shared.folder(spark, "db")
    active = spark.createDataFrame([("o/a", 1, 2)], schemas.ACTIVE)
    tag = spark.createDataFrame([("o/a", "", "2021-10-12T14:20:50Z", "v1")], schemas.TAG)
    commit = spark.createDataFrame(
        [("o/a", f"h{y}", "", f"{y}-05-01T00:00:00Z", "n", "m", "d") for y in (2019, 2020)]
        + [("o/a", "hx", "", "", "n", "m", "d")],
        schemas.COMMIT,
    )
    tables.write_table("active", active, first)
    tables.write_table("commit", commit, first)
    tables.write_csv("active", active, second)
    tables.write_csv("tag", tag, second)
    assert tables.register_database(spark, "one", first) == ["commit", "active"]
    assert tables.register_database(spark, "two", second, "csv") == ["tag", "active"]
    assert tables.register_database(spark, "one", first) == ["commit", "active"]
    joined = spark.sql("SELECT a.stars, t.branch FROM one.active a JOIN two.tag t USING (repo_name)")
    assert tuple(joined.first()) == (2, "")
    years = spark.sql("SELECT commit_year, hash FROM one.commit").collect()
    assert sorted(tuple(r) for r in years if r[0]) == [(2019, "h2019"), (2020, "h2020")]
    assert [r.hash for r in years if r[0] is None] == ["hx"]


def test_csv_columns_go_by_name(spark, tmp_path):
    folder = tmp_path / "active"
    folder.mkdir()
    (folder / "part.csv").write_text("Stars,extra,repo_name\n7,x,o/a\n8,y,\n")
    got = tables.read_csv(spark, "active", str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("", None, 8), ("o/a", None, 7)]
    assert tables.register_database(spark, "by_name", str(tmp_path), "csv") == ["active"]
    rows = spark.sql("SELECT stars, forks, repo_name FROM by_name.active").collect()
    assert sorted(map(tuple, rows)) == [(7, None, "o/a"), (8, None, "")]


def test_a_database_moves(spark, tmp_path):
    """To a folder with fewer tables, to another format and back; a quote in the path."""
    active = spark.createDataFrame([("o/a", 1, 2)], schemas.ACTIVE)
    tag = spark.createDataFrame([("o/a", "main", "", "v1")], schemas.TAG)
    first, second, csv = (str(tmp_path / x) for x in ("first", "it's second", "csv"))
    tables.write_table("active", active, first)
    tables.write_table("tag", tag, first)
    tables.write_table("active", active.withColumn("stars", F.lit(9).cast("long")), second)
    tables.write_csv("active", active, csv)
    for base, fmt, names, stars in (
        (first, "parquet", ["tag", "active"], 2),
        (second, "parquet", ["active"], 9),
        (csv, "csv", ["active"], 2),
        (first, "parquet", ["tag", "active"], 2),
    ):
        assert tables.register_database(spark, "moving", base, fmt) == names
        assert spark.sql("SELECT stars FROM moving.active").first()[0] == stars
        assert spark.catalog.tableExists("moving.tag") == ("tag" in names)


def test_a_rewrite_replaces_all_years(spark, commits):
    base = shared.folder(spark, "years")
    tables.write_table("commit", commits, base)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        tables.write_table("commit", commits.filter(F.col("datetime") < "1996"), base)
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    years = tables.read_table(spark, "commit", base).select("commit_year").distinct().collect()
    assert {r[0] for r in years} == {1995}


def test_a_rewrite_replaces_the_table(spark):
    base = shared.folder(spark, "rewrite")
    for count in (3, 1):
        df = spark.createDataFrame([(f"o/{i}", i, i) for i in range(count)], schemas.ACTIVE)
        tables.write_table("active", df, base)
    assert tables.read_table(spark, "active", base).count() == 1


def test_empty_tables(spark):
    """A load of nothing leaves tables that can be read and queried."""
    base = shared.folder(spark, "empty")
    for name, schema in schemas.TABLES.items():
        tables.write_table(name, spark.createDataFrame([], schema), base)
        stored = tables.read_table(spark, name, base)
        assert stored.count() == 0 and stored.schema == schemas.stored(name)
    assert tables.register_database(spark, "nothing", base) == list(schemas.TABLES)
    assert spark.sql("SELECT count(*) FROM nothing.change WHERE commit_year = 2020").first()[0] == 0


def test_year_filter_prunes_partitions(spark, commits):
    from annalist.plans import reports

    base = shared.folder(spark, "prune")
    tables.write_table("commit", commits, base)
    stored = tables.read_table(spark, "commit", base)
    plan = reports.commits_by_hour(stored, "user7", 1998)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "PartitionFilters: [isnotnull(commit_year" in text
    assert "EqualTo(author_name,user7)" in text
    assert "datetime" not in text


def test_manifest_files_and_inline_list(spark, tmp_path):
    for n in (1, 2):
        rows = [{"name": f"o/{n}", "path": "p", "forks_count": n}, {"name": "o/both", "path": "p"}]
        (tmp_path / f"m{n}.json").write_text("\n".join(map(json.dumps, rows)))
    paths = [str(tmp_path / f"m{n}.json") for n in (1, 2)]
    files = manifests.read_manifests(spark, paths)
    inline = spark.createDataFrame([("o/in", None, None, "p", None, 7)], schemas.MANIFEST)
    both = manifests.combine(inline, files)
    assert sorted(r.name for r in both.collect()) == ["o/1", "o/2", "o/both", "o/both", "o/in"]
    counters = {r.repo_name: (r.forks, r.stars) for r in manifests.active(both).collect()}
    assert counters == {"o/1": (1, 0), "o/2": (2, 0), "o/both": (0, 0), "o/in": (0, 7)}
    assert manifests.combine(None, files) is files
    assert manifests.combine(inline, None) is inline


def test_api_pages(spark, tmp_path):
    for page in (1, 2):
        response = [
            {
                "full_name": f"o/p{page}",
                "clone_url": "u",
                "default_branch": "main",
                "forks_count": page,
                "stargazers_count": 9,
                "unknown": {"x": 1},
            }
        ]
        (tmp_path / f"page{page}.json").write_text(json.dumps(response, indent=2))
    got = manifests.read_api_pages(spark, str(tmp_path), "/srv/clones")
    assert got.columns == schemas.columns(schemas.MANIFEST)
    assert sorted(tuple(r) for r in got.collect()) == [
        ("o/p1", "main", "u", "/srv/clones/o/p1", 1, 9),
        ("o/p2", "main", "u", "/srv/clones/o/p2", 2, 9),
    ]
    for clone_dir, start in (("", ""), ("/", "/"), ("./db/", "./db/"), (".", "./")):
        row = manifests.read_api_pages(spark, str(tmp_path), clone_dir).orderBy("path").first()
        assert row.path == f"{start}o/p1"


def test_exclusion_by_prefix(spark):
    names = ["foo/x", "foobar/x", "fo/x", "bar/foo", "bar/fox"]
    df = spark.createDataFrame([(n,) for n in names], "name string")

    def kept(*prefixes):
        return sorted(r.name for r in manifests.exclude_prefixes(df, prefixes).collect())

    assert kept("foo") == ["bar/foo", "bar/fox", "fo/x"]
    assert kept("foo", "bar/fo") == ["fo/x"]
    assert kept("bar/foo", "fo/") == ["bar/fox", "foo/x", "foobar/x"]
    assert kept() == sorted(names)
    assert kept("") == []


def test_heads_and_tags(spark):
    rows = [
        ("o/a", "h1", "2021-10-12T23:00:00-05:00"),
        ("o/a", "h2", "2021-10-13T02:00:00+00:00"),
        ("o/b", "h1", "1969-12-31T23:00:00-00:30"),
        ("o/c", "h9", ""),
    ]
    df = spark.createDataFrame(rows, "repo_name string, hash string, datetime string")
    assert {r.repo_name: r.datetime for r in tags.heads(df).collect()} == {
        "o/a": "2021-10-12T23:00:00-05:00",
        "o/b": "1969-12-31T23:00:00-00:30",
        "o/c": "",
    }
    line = "<Mon, 8 Nov 2021 23:34:49 +0800> <h9> <a> <a@b>"
    refs = spark.createDataFrame(
        [
            ("o/a", "h2", "v2", None),
            ("o/b", "h1", "v1", None),
            ("o/b", "gone", "v0", None),
            ("o/b", "side", "v9", line),
            ("o/b", "gone", "v8", "no header"),
        ],
        "repo_name string, hash string, tag string, header string",
    )
    assert [tuple(r) for r in tags.tag_rejects(refs, df).collect()] == [("o/b", 2)]
    lines = spark.createDataFrame([("o/a", line), ("o/new", line)], "repo_name string, header string")
    named = {r.repo_name: r.datetime for r in tags.heads(df, lines).collect()}
    assert named["o/a"] == named["o/new"] == "2021-11-08T23:34:49+08:00"
    assert named["o/b"] == "1969-12-31T23:00:00-00:30"
    manifest = spark.createDataFrame(
        [("o/a", "main"), ("o/b", None)], "name string, branch string"
    )
    assert sorted(tuple(r) for r in tags.tags(refs, df, manifest).collect()) == [
        ("o/a", "main", "2021-10-13T02:00:00+00:00", "v2"),
        ("o/b", "", "1969-12-31T23:00:00-00:30", "v1"),
        ("o/b", "", "2021-11-08T23:34:49+08:00", "v9"),
    ]


def test_line_counts_of_source_files(spark):
    texts = {
        "src/main.py": "# head\n\nx = 1\n\t# inner\n   \ny = 2  # not a comment line\n",
        "src/lib.rs": "// head\nfn a() {}",
        "README.MD": "# Title\n\ntext\n",
        "data.bin": "1\n2\n",
        "empty.py": "",
        "a+b c.sh": "ls\n",
        "sub/Makefile": "# m\nall:\n",
        "_private/__init__.py": "a = 1\n",
    }
    sources = spark.createDataFrame(
        [("o/a", path, text) for path, text in texts.items()], "repo_name string, path string, text string"
    )
    got = {r.ext: (r.code, r.comments, r.blanks) for r in linecount.count_lines(sources).collect()}
    assert got == {
        "python": (3, 2, 2),
        "rust": (1, 1, 0),
        "markdown": (0, 2, 1),
        "shell": (1, 0, 0),
        "makefile": (1, 1, 0),
    }
    assert [tuple(r) for r in linecount.skipped_files(sources).collect()] == [("o/a", "bin", 1)]
    other = linecount.count_lines(sources, (), ["1"]).collect()
    assert {r.ext: (r.code, r.comments, r.blanks) for r in other}["bin"] == (1, 1, 0)


def test_line_counts_of_source_records(spark, tmp_path):
    record = {"repo_name": "o/a", "path": "pkg/__init__.py", "text": "# a\n\nb = 1\n"}
    (tmp_path / "part-0.json").write_text(json.dumps(record) + "\n")
    row = linecount.count_lines(logs.read_source_records(spark, str(tmp_path))).first()
    assert tuple(row) == ("o/a", "python", 1, 1, 1)


def test_load_and_report(spark, sf):
    """Exported text to tables to a report, with rejects, mapping and snapshot."""
    from annalist.operators.sections import author_rules

    out = shared.folder(spark, "load")
    repo = views.commits(spark, sf).agg(F.max("repo_name")).first()[0]
    rejects = load(
        spark,
        out,
        views.stored_manifest(spark, sf),
        views.damaged_log_path(spark, sf),
        views.refs_path(spark, sf),
        views.sources(spark, sf).withColumn("repo_name", F.lit(repo)),
        author_rules(spark, [("user7", "user7@d7.example.com", "seven", "7@example.org")]),
        other_prefixes=views.COMMENT_PREFIXES,
    )
    orders = views.table(spark, sf, "orders")
    damaged = orders.filter("o_orderstatus = 'P'").count()
    assert rejects.filter("reject <> 'tag'").agg(F.sum("sections")).first()[0] == damaged
    lost = orders.filter("o_orderpriority = '2-HIGH' AND o_orderkey % 5 = 0").count()
    bare = "o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' AND o_orderkey % 4 < 2"
    lost += orders.filter(bare).count()
    assert rejects.filter("reject = 'tag'").agg(F.sum("sections")).first()[0] == lost
    stored = {n: tables.read_table(spark, n, out) for n in schemas.TABLES}
    assert stored["commit"].count() == orders.count() - damaged
    assert stored["tag"].count() == orders.filter(
        "o_orderpriority = '1-URGENT' AND (o_orderstatus <> 'P' OR o_orderkey % 4 >= 2)"
    ).count()
    names = {r[0] for r in stored["commit"].select("author_name").distinct().collect()}
    assert "seven" in names and "user7" not in names
    snapshot = stored["snapshot"].select("branch", "datetime").distinct().collect()
    assert len(snapshot) == 1 and snapshot[0].branch == "main" and snapshot[0].datetime
    for name, schema in schemas.TABLES.items():
        assert set(schemas.columns(schema)) <= set(stored[name].columns)

    tables.register_database(spark, "loaded", out)
    results = run_report(
        spark,
        {
            "total": ["SELECT count(1) AS count FROM loaded.commit;"],
            "hours": [
                "SELECT rfc_hour(datetime) AS h, count(1) AS count FROM loaded.commit GROUP BY h",
                "SELECT max(stars) AS stars FROM loaded.active",
            ],
        },
        shared.folder(spark, "report"),
    )
    assert list(results) == ["total", "hours"] and len(results["hours"]) == 2
    total = results["total"][0].first()["count"]
    assert total == results["hours"][0].agg(F.sum("count")).first()[0] == stored["commit"].count()
