"""Logs read by lines against logs read by sections, in blocks of any size."""

import random

import pytest
from pyspark.sql import functions as F

from annalist import schemas
from annalist.operators import long_sections, sections
from annalist.sources import logs

HEAD = "<Tue, 12 Oct 2021 14:20:50 +0800> <{}> <n a> <n@a.example>"


@pytest.fixture(params=[700, 5_000, 10_000_000])
def blocks(spark, request):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def written(folder, texts):
    for repo, files in texts.items():
        for n, text in enumerate(files):
            path = folder / f"repo_name={repo}" / f"log{n}.txt"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
    return str(folder)


def random_log(rng, n):
    lines = []
    for k in range(n):
        lines.append(HEAD.format(f"h{rng.getrandbits(60):x}") if rng.random() < 0.95 else "<bad header")
        for _ in range(rng.choice([0, 1, 3, 3, 200])):
            lines.append(f"{rng.randrange(9)}\t{rng.choice(['-', '4'])}\tsrc/f.{rng.choice(['py', 'go', 'md'])}")
        if rng.random() < 0.1:
            lines.append(rng.choice(["", "", "1 file changed"]))
    return "\n".join(lines) + rng.choice(["", "\n"])


def compared(spark, folder, manifest):
    done, changes = long_sections.parse(logs.read_log_lines(spark, folder), manifest)
    other = sections.parse_sections(logs.read_log(spark, folder)).withColumn("branch", F.lit("main"))
    other = sections.finish(other.join(manifest.select(F.col("name").alias("repo_name")), "repo_name"))
    for make in (sections.commits, sections.file_counts):
        got, want = (sorted(map(tuple, make(sections.accepted(x)).collect())) for x in (done, other))
        assert got == want
    assert sorted(map(tuple, sections.reject_counts(done).collect())) == sorted(map(tuple, sections.reject_counts(other).collect()))
    names = schemas.columns(schemas.CHANGE)
    got, want = (sorted(map(tuple, x.select(*names).collect())) for x in (changes, sections.changes(sections.accepted(other))))
    assert got == want and got
    return got


def test_lines_equal_sections(spark, tmp_path, blocks):
    rng = random.Random(blocks)
    folder = written(tmp_path, {"o%2Fa": [random_log(rng, 30), random_log(rng, 40)], "b": [random_log(rng, 25)], "c": [random_log(rng, 5)]})
    compared(spark, folder, spark.createDataFrame([("o/a", "main"), ("b", "main")], "name string, branch string"))


def test_one_commit_over_many_blocks(spark, tmp_path):
    lines = [HEAD.format("one"), *["1\t2\ta.py"] * 40_000, "3\t0\tb.md", HEAD.format("two"), "5\t5\tc.go"]
    folder = written(tmp_path, {"r": ["\n".join(lines)]})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        pieces = long_sections.pieces(logs.read_log_lines(spark, folder)).collect()
        got = compared(spark, folder, spark.createDataFrame([("r", "main")], "name string, branch string"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # Each block gives a few rows, whatever its lines.
    assert len({p["block"] for p in pieces}) > 10 and len(pieces) < 50
    assert [r[-3:] for r in got] == [("md", 3, 0), ("py", 40_000, 80_000), ("go", 5, 5)]


def test_lines_without_a_header_are_one_reject(spark, tmp_path):
    folder = written(tmp_path, {"r": ["1\t2\ta.py\n3\t4\tb.py\n" + HEAD.format("x")], "empty": [""]})
    manifest = spark.createDataFrame([("r", "main"), ("empty", "main")], "name string, branch string")
    done, changes = long_sections.parse(logs.read_log_lines(spark, folder), manifest)
    assert [tuple(r) for r in sections.reject_counts(done).collect()] == [("r", "header", 1)]
    assert sections.commits(sections.accepted(done)).count() == 1 and changes.count() == 0
