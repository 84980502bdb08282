import re
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annalist.operators import sections
from annalist.sources import logs, manifest as manifests, shared

HEAD = "<Tue, 9 Nov 2021 23:34:49 +0800> <{}> <Ann Lee> <ann@example.com>"


def finished(spark, texts):
    rows = [(f"r{i}", "main", text) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "repo_name string, branch string, value string")
    return sections.finish(sections.parse_sections(df)).orderBy("repo_name")


def churn_of(rows, hash_):
    found = sections.changes(sections.accepted(rows)).filter(F.col("hash") == hash_).collect()
    assert len({r.ext for r in found}) == len(found)
    return {r.ext: (r.insertion, r.deletion) for r in found}


def test_one_section(spark):
    lines = [
        "12\t0\t.gitignore",
        "28\t0\tLICENSE",
        "1\t0\tREADME.md",
        "700\t3\tcmd/main.go",
        "777\t4\tpkg/store.go",
        "18\t0\tgo.mod",
        "52\t1\tgo.sum",
        "-\t-\timg/logo.png",
        "5\t5\tsrc/{a.c => b.rs}",
        '2\t0\t"x/\\346.py"',
    ]
    rows = finished(spark, ["\n".join([HEAD.format("abc"), *lines, ""])])
    row = rows.first()
    assert (row.hash, row.author_name, row.author_email) == ("abc", "Ann Lee", "ann@example.com")
    assert (row.datetime, row.author_domain) == ("2021-11-09T23:34:49+08:00", "example.com")
    assert (row.files, row.reject) == (10, None)
    assert churn_of(rows, "abc") == {
        "": (40, 0),
        "md": (1, 0),
        "go": (1477, 7),
        "mod": (18, 0),
        "sum": (52, 1),
        "png": (0, 0),
        "rs": (5, 5),
        "py": (2, 0),
    }


def test_header_forms(spark):
    texts = [
        # The record separator takes the first character of all but the first header.
        HEAD.format("a")[1:] + "\n1\t2\tx.py\n",
        # Blank lines around the change lines do not count.
        "\n".join([HEAD.format("b"), "", "1\t2\tx.py", "", "3\t4\ty.py", "", ""]),
        # A commit without changes.
        HEAD.format("c"),
        # A separator inside the name belongs to the fields before the last two.
        "<d> <h> <x> <name> <mail>",
        # Text before and after the match is ignored.
        HEAD.format("e") + " trailing",
    ]
    all_rows = finished(spark, texts)
    rows = all_rows.collect()
    assert [r.hash for r in rows] == ["a", "b", "c", "h> <x", "e"]
    assert [r.files for r in rows] == [1, 2, 0, 0, 0]
    assert churn_of(all_rows, "b") == {"py": (4, 6)}
    assert [r.reject for r in rows] == [None] * 5
    assert rows[3].datetime == ""


def test_one_bad_line_drops_the_commit(spark):
    texts = [
        HEAD.format("good") + "\n1\t2\tx.py",
        HEAD.format("bad") + "\n1\t2\tx.py\nno counters\n3\t4\ty.py",
        "<only> <three> <fields>\n1\t2\tx.py",
    ]
    all_rows = finished(spark, texts)
    assert [r.reject for r in all_rows.collect()] == [None, "change", "header"]
    kept = sections.accepted(all_rows)
    assert [r.hash for r in sections.commits(kept).collect()] == ["good"]
    assert [r.hash for r in sections.changes(kept).collect()] == ["good"]
    counts = {(r.repo_name, r.reject): r.sections for r in sections.reject_counts(all_rows).collect()}
    assert counts == {("r1", "change"): 1, ("r2", "header"): 1}


def test_change_line_numbers(spark):
    lines = ["-5\t1-2\ta.x", "007\t--\ta.x", "99999999999999999999\t3\ta.x", "x12\t3\ta.x"]
    assert churn_of(finished(spark, ["\n".join([HEAD.format("n"), *lines])]), "n") == {"x": (19, 6)}


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Mon, 8 Nov 2021 23:34:49 +0800", "2021-11-08T23:34:49+08:00"),
        ("Tue, 28 Feb 2017 00:00:00 -0530", "2017-02-28T00:00:00-05:30"),
        ("8 Nov 2021 23:34:49 +0800", "2021-11-08T23:34:49+08:00"),
        ("18 nov 2021 23:34:49 -0000", "2021-11-18T23:34:49+00:00"),
        ("Tue, 8 Nov 2021 23:34:49 +0800", ""),
        ("Mon Nov 8 23:34:49 2021 +0800", ""),
        ("Mon, 30 Feb 2021 23:34:49 +0800", ""),
        ("Mon, 8 Nov 2021 24:34:49 +0800", ""),
        ("Mon, 8 Nov 2021 23:34:49 +2400", ""),
        ("Mon, 8 Nov 2021 23:34:49 +08:00", ""),
        ("Mon, 8 Abc 2021 23:34:49 +0800", ""),
        ("Mon, 8 Anf 2021 23:34:49 +0800", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_mail_date(values, raw, expected):
    assert values("string", [raw], sections.mail_date_to_rfc3339) == [expected]


def test_email_domain(values):
    inputs = ["a@b.c", "a@b@c", "nomail", "", "@", "a@"]
    assert values("string", inputs, sections.email_domain) == [
        "b.c",
        "b@c",
        "nomail",
        "",
        "",
        "",
    ]


def expected_ext(path):
    """The rule of the extension, one step at a time."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    if not dot or not stem:
        return ""
    if ext and ext.isascii() and not re.match(r"[A-Za-z0-9]\Z", ext[-1]):
        ext = ext[:-1]
    return ext


PATHS = {
    ".gitignore": "",
    "LICENSE": "",
    "a/b.tar.gz": "gz",
    "src/{a.c => b.rs}": "rs",
    '"x/\\346.py"': "py",
    "dir.d/file": "",
    "dir.d/": "d",
    "foo.": "",
    "a/.b.c": "c",
    "..": "",
    "x.p-}": "p-",
    "x.é}": "é}",
    "é/x.c}": "c",
    "a b/c.d e": "d e",
    "": "",
}


def test_file_ext(values):
    assert values("string", list(PATHS), sections.file_ext) == list(PATHS.values())
    assert [expected_ext(p) for p in PATHS] == list(PATHS.values())


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab./é}\"- \r", max_size=12), min_size=40, max_size=80))
def test_file_ext_against_the_rule(values, paths):
    assert values("string", paths, sections.file_ext) == [expected_ext(p) for p in paths]


def test_author_mapping(spark):
    rules = [
        ("a", "a@x", "b", "b@x"),
        ("a", "a@x", "late", "late@x"),
        ("b", "b@x", "c", "c@x"),
    ]
    people = [("a", "a@x"), ("a", "other@x"), ("b", "b@x"), ("z", "z@x")]
    df = spark.createDataFrame(people, "author_name string, author_email string")
    got = sections.map_authors(df, sections.author_rules(spark, rules)).collect()
    assert sorted(tuple(r) for r in got) == [
        ("a", "other@x"),
        ("b", "b@x"),
        ("c", "c@x"),
        ("z", "z@x"),
    ]


def test_empty_mapping(spark):
    df = spark.createDataFrame([("a", "a@x")], "author_name string, author_email string")
    got = sections.map_authors(df, sections.author_rules(spark, [])).collect()
    assert [tuple(r) for r in got] == [("a", "a@x")]


def test_sections_survive_any_split_of_the_file(spark, tmp_path):
    """One large log, cut into many input splits, gives each section once and whole."""
    folder = tmp_path / "repo_name=big%2Flog"
    folder.mkdir()
    expected = {}
    with open(folder / "log.txt", "w") as f:
        for n in range(3000):
            lines = [f"{n}\t{k}\tsrc/f{k}.e{k % 3}" for k in range(n % 7)]
            f.write("\n".join([HEAD.format(f"h{n}"), "", *lines, "", ""]))
            expected[f"h{n}"] = n % 7
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10007")
        read = logs.read_log(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 20
        rows = sections.parse_sections(read).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.repo_name for r in rows} == {"big/log"}
    assert len(rows) == 3000
    assert {r.hash: len(r.entries) for r in rows} == expected


def test_one_commit_with_many_files(spark):
    lines = [f"1\t2\td/f{n}.x{n % 50}" for n in range(20_000)]
    rows = finished(spark, ["\n".join([HEAD.format("huge"), *lines])])
    assert rows.first().files == 20_000
    assert churn_of(rows, "huge") == {f"x{k}": (400, 800) for k in range(50)}


def test_one_commit_with_many_extensions(spark):
    lines = [f"{n}\t1\td/f{n}.x{n}" for n in range(32_000)]
    rows = finished(spark, ["\n".join([HEAD.format("dump"), *lines])])
    assert churn_of(rows, "dump") == {f"x{n}": (n, 1) for n in range(32_000)}


def test_a_repository_listed_twice_keeps_doubled_changes(spark):
    text = HEAD.format("h") + "\n1\t2\tx.py\n3\t4\ty.py"
    rows = [("r", branch, text) for branch in ("main", "main")]
    df = spark.createDataFrame(rows, "repo_name string, branch string, value string")
    done = sections.changes(sections.finish(sections.parse_sections(df))).collect()
    assert [(r.ext, r.insertion, r.deletion) for r in done] == [("py", 4, 6)] * 2


def test_branch_comes_from_the_manifest_as_often_as_listed(spark):
    schema = "name string, branch string"
    listed = spark.createDataFrame([("a", "dev"), ("b", None), ("b", "next")], schema)
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "repo_name string")
    got = manifests.with_branch(df, listed).collect()
    assert sorted(tuple(r) for r in got) == [("a", "dev"), ("b", ""), ("b", "next")]


def test_tag_list(spark, tmp_path):
    folder = tmp_path / "repo_name=o%2Fn"
    folder.mkdir()
    lines = [
        "h1 refs/tags/v1",
        "h2 refs/tags/a b",
        "noblank",
        "obj refs/tags/v3",
        "h3 refs/tags/v3^{}",
        "obj4 refs/tags/v4\t" + HEAD.format("c4"),
        "h4 refs/tags/v4^{}\t" + HEAD.format("c4"),
        "h5 refs/heads/main",
        "h6 HEAD\t" + HEAD.format("h6"),
    ]
    (folder / "refs.txt").write_text("\n".join(lines) + "\n")
    refs = logs.read_refs(spark, str(tmp_path))
    assert sorted((tuple(r) for r in refs.collect()), key=lambda r: r[2]) == [
        ("o/n", "h2", "a b", None),
        ("o/n", "h1", "v1", None),
        ("o/n", "h3", "v3", None),
        ("o/n", "h4", "v4", HEAD.format("c4")),
    ]
    heads = logs.read_heads(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in heads] == [("o/n", HEAD.format("h6"))]


def test_shared_folder_is_new_every_time(spark):
    first, second = shared.folder(spark, "t"), shared.folder(spark, "t")
    assert first != second
    assert uuid.UUID(first.rsplit("-", 1)[-1])
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        assert first.startswith(base)


class Settings:
    """The settings of a session that was never started."""

    def __init__(self, **values):
        self.conf = self
        self.values = {key.replace("_", "."): value for key, value in values.items()}

    def get(self, key, default=None):
        return self.values.get(key, default)


def test_shared_folder_follows_the_session():
    named = Settings(spark_master="yarn", spark_checkpoint_dir="hdfs://x/shared/")
    assert shared.folder(named, "t").startswith("hdfs://x/shared/annalist/t-")
    assert "annalist-" in shared.folder(Settings(spark_master="local[2]"), "t")
    with pytest.raises(ValueError):
        shared.folder(Settings(spark_master="yarn"), "t")
