"""Headline timings: the load, then the reports on the loaded tables.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[BENCH_CPUS]`` and prints one
JSON line. The log text is generated first and not timed, since it comes from outside. The
load is timed as a whole, then each report on the stored tables. Every time is the better of
two runs; ``load_first`` is the first, cold load and not part of ``value``.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from annalist.operators import linecount  # noqa: E402
from annalist.operators.sections import author_rules  # noqa: E402
from annalist.plans import reports  # noqa: E402
from annalist.plans.load import load  # noqa: E402
from annalist.sources import shared, tables  # noqa: E402
from checks import views  # noqa: E402

AUTHOR, REPO, MONTHS = "user7", "AUTOMOBILE/NATION_7", (1, 2, 3, 4)
EXTS = ("py", "js", "go", "html", "css")


def headline(t):
    commit, change, tag, active = t["commit"], t["change"], t["tag"], t["active"]
    snapshot = t["snapshot"]
    return {
        "q1_first_commit": lambda: reports.first_commit(commit, AUTHOR),
        "q3_commits_per_year": lambda: reports.commits_per_year(commit, AUTHOR, 2000),
        "q7_most_tags": lambda: reports.most_tags(tag),
        "q8_first_tag": lambda: reports.first_tag(tag),
        "q9_repos_active_in_year": lambda: reports.repos_active_in_year(commit, AUTHOR, 1998),
        "q10_churn_topk": lambda: reports.churn_topk(change, AUTHOR, 1998, 8),
        "q12_streak_global": lambda: reports.streak_of_year(commit, AUTHOR, 1998),
        "q13_streak_repo_top": lambda: reports.repo_with_longest_streak(commit, AUTHOR, 1998),
        "q14_repos_created": lambda: reports.repos_created_in_year(commit, AUTHOR, 1995),
        "q15_snapshot_lookup": lambda: reports.snapshot_of(snapshot, ["src0", "src1"]),
        "q16_language_dist": lambda: reports.language_dist(change, AUTHOR, 1998, EXTS),
        "q18_count_filtered": lambda: reports.count_filtered(commit, AUTHOR, 1998, REPO, MONTHS),
        "q20_churn_one_repo": lambda: reports.churn_of_repo(change, AUTHOR, 1998, REPO, MONTHS),
        "q22_hours_weekend": lambda: reports.hours_filled(commit, AUTHOR, 1998, True),
        "q24_popularity_total": lambda: reports.popularity_total(active),
        "q25_contributors": lambda: reports.contributors(commit, AUTHOR),
        "q26_timezones": lambda: reports.timezones(commit),
        "q27_domains": lambda: reports.domains(commit),
        "q28_top_starred": lambda: reports.top_starred(active, commit, AUTHOR),
        "q29_repo_year_tz": lambda: reports.repo_year_tz(commit).limit(1),
        "q30_max_insertion": lambda: reports.max_insertion(change),
        "q31_tags_until": lambda: reports.tags_until(tag, 1997).limit(1),
        "q32_active_lookup": lambda: reports.active_of(active, REPO),
    }


def timed(run):
    started = time.perf_counter()
    result = run()
    return time.perf_counter() - started, result


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("annalist-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    log, refs = views.log_path(spark, sf_dir), views.refs_path(spark, sf_dir)
    base = shared.folder(spark, "bench")
    manifest = views.stored_manifest(spark, sf_dir)

    code = views.code_records(spark, sf_dir)
    rules = author_rules(spark, [("user39", "user39@d7.example.com", "renamed", "r@example.org")])

    def whole_load(out):
        return load(spark, out, manifest, log, refs, code, rules)

    times = {}
    first, _ = timed(lambda: whole_load(shared.folder(spark, "bench")))
    again, rejects = timed(lambda: whole_load(base))
    times["load"] = min(first, again)
    stored = {n: tables.read_table(spark, n, base) for n in ("commit", "change", "tag", "active")}
    commits = stored["commit"].count()
    counts = linecount.count_lines(views.sources(spark, sf_dir), (), views.COMMENT_PREFIXES)
    lines = shared.folder(spark, "bench-lines")
    times["line_count"] = min(
        timed(lambda: tables.write_table("snapshot", counts, lines))[0] for _ in range(2)
    )
    stored["snapshot"] = tables.read_table(spark, "snapshot", lines)
    # Not timed: what the first query on stored tables loads and compiles is no query's own.
    reports.hours_filled(stored["commit"], AUTHOR, 1998, False).collect()
    for name, run in headline(stored).items():
        times[name] = min(timed(lambda: run().collect())[0] for _ in range(2))

    print(
        json.dumps(
            {
                "metric": "load and report queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {name: round(took, 4) for name, took in times.items()},
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cores": int(cpus),
                "commits": commits,
                "load_first": round(first, 4),
                "load_commits_per_sec": round(commits / times["load"]),
                "reject_groups": rejects.count(),
            }
        )
    )


if __name__ == "__main__":
    main()
