"""One query per area of plain SQL that users reach beside the reports."""

from pyspark.sql import functions as F

from annalist.operators import intervals
from checks import views
from checks.registry import check


def _sql(name, text, twin=None):
    @check(name, twin or text)
    def query(spark, sf_dir):
        for table in ("orders", "customer", "nation", "region", "supplier", "part", "lineitem"):
            views.table(spark, sf_dir, table).createOrReplaceTempView(table)
        return spark.sql(text)


# Orders are counted per customer before they meet the customers, so that a customer with
# very many orders is one row in the join.
_sql(
    "sql_join_inner",
    """SELECT n_name, c_mktsegment, CAST(sum(orders) AS BIGINT) AS orders
       FROM (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey) o
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       GROUP BY n_name, c_mktsegment""",
)
_sql(
    "sql_join_outer",
    """SELECT r_name, n.n_name, suppliers, customers
       FROM (SELECT s_nationkey, count(*) AS suppliers FROM supplier
             WHERE s_acctbal > 0 GROUP BY s_nationkey) s
       FULL JOIN (SELECT c_nationkey, count(*) AS customers FROM customer
                  WHERE c_acctbal < 0 GROUP BY c_nationkey) c ON s_nationkey = c_nationkey
       RIGHT JOIN nation n ON n_nationkey = coalesce(s_nationkey, c_nationkey)
       LEFT JOIN region ON n_regionkey = r_regionkey""",
)
_sql(
    "sql_semi_anti",
    """SELECT c_mktsegment, count(*) AS customers FROM customer
       WHERE c_custkey IN (SELECT DISTINCT o_custkey FROM orders
                           WHERE o_orderpriority = '1-URGENT')
         AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT o_custkey FROM orders
                                        WHERE o_orderstatus = 'P') p
                         WHERE p.o_custkey = c_custkey)
       GROUP BY c_mktsegment""",
)
# The range condition stands beside an equality on the year, so that the join hashes on the
# year; the orders are counted per month first, so that a year is twelve rows in the join.
_sql(
    "sql_join_range",
    """SELECT q.y, q.first_month, CAST(sum(orders) AS BIGINT) AS orders
       FROM (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS orders
             FROM orders GROUP BY 1, 2) o
       JOIN (SELECT DISTINCT year(o_orderdate) AS y,
                    CAST(month(o_orderdate) - (month(o_orderdate) - 1) % 3 AS INT) AS first_month
             FROM orders) q
         ON o.y = q.y AND o.m >= q.first_month AND o.m < q.first_month + 3
       GROUP BY q.y, q.first_month""",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS y,
              CAST(quarter(o_orderdate) * 3 - 2 AS INTEGER) AS first_month, count(*) AS orders
       FROM orders GROUP BY 1, 2""",
)
# Windows of very different length: after every urgent order some hours to some months, in hours.
_WINDOW = """SELECT o_orderkey AS release, CAST(epoch(o_orderdate) // 3600 AS BIGINT) AS opens,
       CAST(epoch(o_orderdate) // 3600 + CASE WHEN o_orderkey % 50 = 0 THEN 3000 WHEN o_orderkey % 7 = 0 THEN 0
                                              ELSE o_orderkey % 24 END AS BIGINT) AS closes
FROM orders WHERE o_orderpriority = '1-URGENT'"""


@check(
    "sql_join_interval",
    f"""SELECT release, count(*) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS keys
        FROM ({_WINDOW}) w JOIN (
          SELECT o_orderkey, CAST(epoch(o_orderdate) // 3600 + o_orderkey % 24 AS BIGINT) AS hour FROM orders) o
        ON opens <= hour AND hour < closes GROUP BY release""",
)
def sql_join_interval(spark, sf_dir):
    """Orders that fall into windows after others: a condition of ranges alone."""
    orders = views.table(spark, sf_dir, "orders")
    key, hour = F.col("o_orderkey"), F.call_function("div", F.unix_seconds(F.col("o_orderdate").cast("timestamp")), F.lit(3600))
    length = F.when(key % 50 == 0, 3000).when(key % 7 == 0, 0).otherwise(key % 24)
    windows = orders.filter("o_orderpriority = '1-URGENT'").select(
        key.alias("release"), hour.alias("opens"), (hour + length).alias("closes")
    )
    points = orders.select("o_orderkey", (hour + key % 24).alias("at"))
    met = intervals.interval_sums(points, windows, "at", "opens", "closes", {"keys": "o_orderkey"}, "orders", width=24)
    return met.groupBy("release").agg(F.sum("orders").alias("orders"), F.sum("keys").alias("keys"))


_sql(
    "sql_having_case",
    """WITH sized AS (
         SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle'
                     ELSE 'large' END AS size, p_brand
         FROM part WHERE p_name LIKE '%ring%')
       SELECT size, p_brand, count(*) AS parts FROM sized
       GROUP BY size, p_brand HAVING count(*) > 1""",
)
_sql(
    "sql_setops",
    """(SELECT c_nationkey AS k, 'both' AS kind FROM customer
        INTERSECT SELECT s_nationkey, 'both' FROM supplier)
       UNION ALL
       (SELECT n_nationkey, 'no supplier' FROM nation
        EXCEPT SELECT s_nationkey, 'no supplier' FROM supplier)""",
)
# The windows run over counts, whose groups are bounded by the calendar, not over the rows.
_sql(
    "sql_window_rank",
    """SELECT y, o_orderpriority, orders,
              CAST(row_number() OVER (PARTITION BY y ORDER BY orders DESC, o_orderpriority)
                   AS BIGINT) AS rn,
              CAST(rank() OVER (PARTITION BY y ORDER BY orders DESC) AS BIGINT) AS rk,
              CAST(dense_rank() OVER (PARTITION BY y ORDER BY orders DESC) AS BIGINT) AS dr
       FROM (SELECT CAST(year(o_orderdate) AS INT) AS y, o_orderpriority, count(*) AS orders
             FROM orders GROUP BY 1, 2) c""",
)
_sql(
    "sql_window_frame",
    """SELECT o_orderpriority, d, orders,
              lag(orders) OVER w AS before, lead(orders) OVER w AS after,
              CAST(sum(orders) OVER (PARTITION BY o_orderpriority ORDER BY d
                                     ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS week
       FROM (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS d, count(*) AS orders
             FROM orders GROUP BY 1, 2) c
       WINDOW w AS (PARTITION BY o_orderpriority ORDER BY d)""",
)
_sql(
    "sql_rollup",
    """SELECT r_name, n_name, count(*) AS customers,
              CAST(grouping(r_name) + grouping(n_name) AS INT) AS level
       FROM customer JOIN nation ON c_nationkey = n_nationkey
                     JOIN region ON n_regionkey = r_regionkey
       GROUP BY ROLLUP (r_name, n_name)""",
)
# The exact median from counts per value: the middle one or two values by running totals, with
# no more state than the distinct values of a flag.
_MEDIAN = """SELECT l_returnflag, avg(l_quantity) AS middle FROM (
  SELECT l_returnflag, l_quantity, n,
         sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS upto,
         sum(n) OVER (PARTITION BY l_returnflag) AS total
  FROM (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_quantity))
WHERE 2 * upto >= total AND 2 * (upto - n) <= total GROUP BY l_returnflag"""
_sql(
    "sql_stats",
    f"""SELECT s.l_returnflag, spread, middle, suppliers FROM (
          SELECT l_returnflag, round(stddev(l_quantity), 6) AS spread,
                 count(DISTINCT l_suppkey) AS suppliers
          FROM lineitem GROUP BY l_returnflag) s JOIN ({_MEDIAN}) m ON s.l_returnflag = m.l_returnflag""",
    """SELECT l_returnflag, round(stddev(l_quantity), 6) AS spread,
              quantile_cont(l_quantity, 0.5) AS middle,
              count(DISTINCT l_suppkey) AS suppliers
       FROM lineitem GROUP BY l_returnflag""",
)


# Approximate results differ by engine; what can be compared is that they are close to the
# exact ones, which stand beside them. The sketches are made apart from the exact distinct count:
# in one aggregation Spark would make them for every part of a flag before it merges them.
_sql(
    "sql_stats_approx",
    f"""SELECT s.l_returnflag, parts, middle,
               abs(about / parts - 1) < 0.2 AS parts_close, abs(near - middle) <= 1 AS middle_close
        FROM (SELECT l_returnflag, approx_count_distinct(l_partkey) AS about,
                     percentile_approx(l_quantity, 0.5) AS near
              FROM lineitem GROUP BY l_returnflag) s
        JOIN (SELECT l_returnflag, count(DISTINCT l_partkey) AS parts
              FROM lineitem GROUP BY l_returnflag) d ON s.l_returnflag = d.l_returnflag
        JOIN ({_MEDIAN}) m ON s.l_returnflag = m.l_returnflag""",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts,
              quantile_cont(l_quantity, 0.5) AS middle, TRUE AS parts_close, TRUE AS middle_close
       FROM lineitem GROUP BY l_returnflag""",
)
_sql(
    "sql_scalar_builtin",
    """SELECT p_partkey, upper(p_name) AS name, length(p_type) AS len,
              concat(substr(p_brand, 1, 3), '-', lpad(CAST(p_size AS STRING), 3, '0')) AS code,
              abs(p_size - 20) AS off, round(sqrt(p_size), 6) AS root,
              coalesce(nullif(p_type, 'ECONOMY'), 'cheap') AS type
       FROM part""",
)
