"""Invariants between report results."""

import pytest

from annalist.plans import reports
from annalist.sources import shared, tables
from checks import views

AUTHOR = "user7"


@pytest.fixture(scope="module")
def stored(spark, sf):
    base = shared.folder(spark, "reports")
    for name in ("commit", "change", "tag", "active"):
        view = {"commit": "commits", "change": "changes", "tag": "tags", "active": "active"}[name]
        tables.write_table(name, getattr(views, view)(spark, sf), base)
    return {n: tables.read_table(spark, n, base) for n in ("commit", "change", "tag", "active")}


def total(df, column="count"):
    return sum(row[column] for row in df.collect())


def test_parts_of_a_year_sum_up(stored):
    commit = stored["commit"]
    by_year = {r.year: r["count"] for r in reports.commits_per_year(commit, AUTHOR, 9999).collect()}
    year = 1998
    want = by_year[year]
    assert want > 0
    assert total(reports.period_dist(commit, AUTHOR, year)) == want
    assert total(reports.commits_by_hour(commit, AUTHOR, year)) == want
    assert total(reports.commits_by_weekday(commit, AUTHOR, year)) == want
    assert total(reports.commits_by_month(commit, AUTHOR, year)) == want
    work = reports.hours_filled(commit, AUTHOR, year, False)
    free = reports.hours_filled(commit, AUTHOR, year, True)
    assert total(work) + total(free) == want
    assert [r.hour for r in work.collect()] == list(range(24))
    mean = {r.year: r["count"] for r in reports.commits_per_day(commit, AUTHOR, 9999).collect()}
    assert mean[year] == want / 365


def test_repositories_by_creation_year(stored):
    commit = stored["commit"]
    per_year = {r.year: r["count"] for r in reports.projects_per_year(commit, AUTHOR).collect()}
    for year, count in per_year.items():
        assert reports.repos_created_in_year(commit, AUTHOR, year).count() == count


def test_filtered_count_is_the_sum_of_its_hours(stored):
    commit = stored["commit"]
    repo = commit.filter(commit.author_name == AUTHOR).first().repo_name
    months = (1, 2, 3, 4, 5, 6)
    got = reports.count_filtered(commit, AUTHOR, 1998, repo, months).first()["count"]
    assert total(reports.commits_by_hour(commit, AUTHOR, 1998, repo, months)) == got


def test_weekdays_come_in_week_order(stored):
    days = [r.week for r in reports.commits_by_weekday(stored["commit"], AUTHOR, 1998).collect()]
    order = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    assert days == [d for d in order if d in days]


def test_stored_tables_and_plain_views_agree(spark, sf, stored):
    plain = {
        "commit": views.commits(spark, sf),
        "change": views.changes(spark, sf),
        "tag": views.tags(spark, sf),
        "active": views.active(spark, sf),
    }

    def results(t):
        return [
            sorted(map(tuple, df.collect()), key=repr)
            for df in (
                reports.first_commit(t["commit"], AUTHOR, 1_100_000_000),
                reports.active_days(t["commit"], AUTHOR, 2000),
                reports.streak_of_year(t["commit"], AUTHOR, 1998),
                reports.churn_topk(t["change"], AUTHOR, 1998, 3),
                reports.tags_per_year(t["tag"], 2000),
                reports.top_starred(t["active"], t["commit"], AUTHOR, 5),
                reports.timezones(t["commit"]),
            )
        ]

    assert results(plain) == results(stored)
