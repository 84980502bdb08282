"""The queries on data where one key holds a third of the rows."""

import duckdb
import pytest

from checks import all_queries, all_twins, compare

HOT = {
    "orders": "CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey",
    "lineitem": "CASE WHEN l_partkey % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey",
    "events": "CASE WHEN event_id % 3 = 0 THEN 8 ELSE user_id END AS user_id",
    "documents": "CASE WHEN doc_id % 3 = 0 THEN 'src0' ELSE source END AS source",
}
NAMES = [
    "ingest_log_sections",
    "ingest_commit",
    "ingest_change",
    "ingest_rejects",
    "ingest_tags",
    "commit_file_count",
    "head_commit",
    "agg_longest_days",
    "agg_streak_sql",
    "snapshot_lines",
    "q_top_starred",
    "q_churn_topk",
    "q_streak_global",
    "q_streak_repo_top",
    "q_hour_weekend",
    "rel_count_distinct",
    "sink_tables_roundtrip",
    "sql_semi_anti",
    "sql_join_interval",
    "snapshot_block_comments",
    "ingest_giant_commit",
    "ingest_tag_ancestors",
    "agg_streak_rollup",
    "exclude_prefix_table",
    "report_shared_scan",
    "result_array_blocks",
]


@pytest.fixture(scope="module")
def skewed(sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in compare.TABLES:
        change = f"* REPLACE ({HOT[name]})" if name in HOT else "*"
        con.execute(
            f"COPY (SELECT {change} FROM '{sf}/{name}.parquet') TO '{folder}/{name}.parquet'"
        )
    return str(folder)


@pytest.fixture(scope="module")
def skewed_duck(skewed):
    return compare.reference(skewed)


@pytest.mark.parametrize("name", NAMES)
def test_twin_on_skewed_data(spark, skewed_duck, skewed, name):
    """Small shuffle partitions and no broadcast, as for tables of another size."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    }
    before = {key: spark.conf.get(key, None) for key in changed}
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        run, sql = all_queries()[name], all_twins()[name]
        assert compare.differences(spark, skewed_duck, skewed, run, sql) is None
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
