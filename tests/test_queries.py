"""Every registered query against its SQL twin."""

import pytest

from checks import all_queries, all_twins, compare

def test_every_query_has_a_twin():
    assert set(all_queries()) == set(all_twins())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_twin(spark, duck, sf, name):
    assert compare.differences(spark, duck, sf, all_queries()[name], all_twins()[name]) is None


def test_flagship(spark):
    import __spark_entry__

    result = __spark_entry__.entry(spark)
    assert result.columns == ["repo_name", "stars", "last_commit"]
    assert 0 < result.count() <= 10
