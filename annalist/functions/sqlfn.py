"""The same functions for SQL text, as temporary SQL functions that Catalyst inlines.

Names that would hide a Spark built-in get the prefix ``rfc_``; the others keep their own.
The streak aggregates are scalar functions over the days of a group, so that they fit any
``GROUP BY``. Reduce the events to distinct days first: that step aggregates before and
after a shuffle on (group, day), and leaves a group no more rows than the calendar has::

    SELECT repo_name, streak_days(collect_list(day))
    FROM (SELECT DISTINCT repo_name, rfc_utc_day(datetime) AS day FROM commit)
    GROUP BY repo_name
"""

from pyspark.sql import SparkSession

from annalist.functions.timefn import (
    AFTERNOON_LAST_HOUR,
    DAY,
    MIDNIGHT_LAST_HOUR,
    MONTH,
    MORNING_LAST_HOUR,
    RFC3339,
    WEEKDAYS,
    YEAR,
)

_FUNCTIONS = (
    (
        "rfc_local(s STRING) RETURNS TIMESTAMP_NTZ",
        f"""CASE WHEN s RLIKE r'{RFC3339}' THEN try_cast(
              concat(substring(s, 1, 10), ' ', substring(s, 12, 6),
                     if(substring(s, 18, 2) = '60', '59', substring(s, 18, 2)))
              AS TIMESTAMP_NTZ) END""",
    ),
    (
        "rfc_offset_minutes(s STRING) RETURNS INT",
        """CASE WHEN upper(right(s, 1)) = 'Z' THEN 0
             ELSE if(substring(s, -6, 1) = '-', -1, 1)
                  * (try_cast(substring(s, -5, 2) AS INT) * 60 + try_cast(right(s, 2) AS INT))
           END""",
    ),
    ("rfc_year(s STRING) RETURNS INT", "year(rfc_local(s))"),
    ("rfc_month(s STRING) RETURNS INT", "month(rfc_local(s))"),
    ("weeknum(s STRING) RETURNS INT", "weekday(rfc_local(s))"),
    (
        "rfc_weekday(s STRING) RETURNS STRING",
        f"substring('{WEEKDAYS}', weeknum(s) * 3 + 1, 3)",
    ),
    ("dateday(s STRING) RETURNS STRING", "CAST(CAST(rfc_local(s) AS DATE) AS STRING)"),
    ("rfc_hour(s STRING) RETURNS INT", "hour(rfc_local(s))"),
    (
        "period(s STRING) RETURNS STRING",
        f"""CASE WHEN rfc_hour(s) <= {MIDNIGHT_LAST_HOUR} THEN 'Midnight'
                 WHEN rfc_hour(s) <= {MORNING_LAST_HOUR} THEN 'Morning'
                 WHEN rfc_hour(s) <= {AFTERNOON_LAST_HOUR} THEN 'Afternoon'
                 WHEN rfc_hour(s) IS NOT NULL THEN 'Evening' END""",
    ),
    (
        "rfc_timestamp(s STRING) RETURNS BIGINT",
        f"""CAST(unix_date(CAST(rfc_local(s) AS DATE)) AS BIGINT) * {DAY}
            + hour(rfc_local(s)) * 3600 + minute(rfc_local(s)) * 60 + second(rfc_local(s))
            - rfc_offset_minutes(s) * 60""",
    ),
    (
        "timezone(s STRING) RETURNS STRING",
        """CASE WHEN rfc_local(s) IS NULL THEN NULL
                WHEN upper(right(s, 1)) = 'Z' OR right(s, 6) = '-00:00' THEN '+00:00'
                ELSE right(s, 6) END""",
    ),
    (
        "duration(n BIGINT, as_of BIGINT DEFAULT unix_seconds(current_timestamp()))"
        " RETURNS STRING",
        f"""CASE WHEN as_of = n THEN '0s' WHEN as_of > n THEN concat_ws(' ',
              CASE (as_of - n) DIV {YEAR} WHEN 0 THEN NULL WHEN 1 THEN '1year'
                ELSE concat((as_of - n) DIV {YEAR}, 'years') END,
              CASE (as_of - n) % {YEAR} DIV {MONTH} WHEN 0 THEN NULL WHEN 1 THEN '1month'
                ELSE concat((as_of - n) % {YEAR} DIV {MONTH}, 'months') END,
              CASE (as_of - n) % {YEAR} % {MONTH} DIV {DAY} WHEN 0 THEN NULL WHEN 1 THEN '1day'
                ELSE concat((as_of - n) % {YEAR} % {MONTH} DIV {DAY}, 'days') END,
              CASE (as_of - n) % {YEAR} % {MONTH} % {DAY} DIV 3600 WHEN 0 THEN NULL
                ELSE concat((as_of - n) % {YEAR} % {MONTH} % {DAY} DIV 3600, 'h') END,
              CASE (as_of - n) % {YEAR} % {MONTH} % {DAY} % 3600 DIV 60 WHEN 0 THEN NULL
                ELSE concat((as_of - n) % {YEAR} % {MONTH} % {DAY} % 3600 DIV 60, 'm') END,
              CASE (as_of - n) % {YEAR} % {MONTH} % {DAY} % 60 WHEN 0 THEN NULL
                ELSE concat((as_of - n) % {YEAR} % {MONTH} % {DAY} % 60, 's') END) END""",
    ),
    (
        "timestamp_rfc3339(n BIGINT) RETURNS STRING",
        """date_format(TIMESTAMP_NTZ'1970-01-01 00:00:00' + n * INTERVAL '1' SECOND,
                       "yyyy-MM-dd'T'HH:mm:ss'+00:00'")""",
    ),
    ("rfc_utc_day(s STRING) RETURNS BIGINT", f"rfc_timestamp(s) DIV {DAY}"),
    (
        # The accumulator holds the best run so far and the run that is still open. A run
        # replaces the best one only when it is longer, so the earliest of equals stays.
        "streak(days ARRAY<BIGINT>) RETURNS STRUCT<n: BIGINT, s: BIGINT, e: BIGINT>",
        """aggregate(
             array_sort(array_distinct(array_compact(days))),
             named_struct('n', 0L, 's', 0L, 'e', 0L, 'run', 0L, 'last', CAST(NULL AS BIGINT)),
             (a, d) -> named_struct(
               'n', if(d - a.last = 1, greatest(a.n, a.run + 1), greatest(a.n, 1L)),
               's', CASE WHEN d - a.last = 1 AND a.run + 1 > a.n THEN d - a.run
                         WHEN a.n = 0 THEN d ELSE a.s END,
               'e', CASE WHEN d - a.last = 1 AND a.run + 1 > a.n THEN d
                         WHEN a.n = 0 THEN d ELSE a.e END,
               'run', if(d - a.last = 1, a.run + 1, 1L),
               'last', d),
             a -> named_struct('n', a.n, 's', a.s, 'e', a.e))""",
    ),
    ("streak_days(days ARRAY<BIGINT>) RETURNS BIGINT", "streak(days).n"),
    (
        "streak_start(days ARRAY<BIGINT>) RETURNS STRING",
        "CAST(date_from_unix_date(CAST(streak(days).s AS INT)) AS STRING)",
    ),
    (
        "streak_end(days ARRAY<BIGINT>) RETURNS STRING",
        "CAST(date_from_unix_date(CAST(streak(days).e AS INT)) AS STRING)",
    ),
)


def register(spark: SparkSession) -> None:
    """Create the functions in this session; calling it again is harmless."""
    for signature, body in _FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
