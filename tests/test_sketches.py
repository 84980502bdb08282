"""Approximate aggregates are one sketch for each group and task."""

import __spark_entry__


def test_sketches_are_not_made_for_every_part(spark, tmp_path):
    # Sketches beside an exact distinct count in one aggregation are made for each distinct value.
    rows = "SELECT id AS l_orderkey, id % 7 AS l_partkey, 1D * (id % 5) AS l_quantity, 'A' AS l_returnflag FROM range(70)"
    spark.sql(rows).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("orders", "customer", "nation", "region", "supplier", "part"):
        spark.range(1).write.parquet(f"{tmp_path}/{name}.parquet")
    found = __spark_entry__.queries()["sql_stats_approx"](spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [("A", 7, 2.0, True, True)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    made = [x for x in plan.splitlines() if "partial_percentile_approx" in x or "partial_approx_count_distinct" in x]
    assert made and not [x for x in made if "l_partkey" in x.split("functions=")[0]]
