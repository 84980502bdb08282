"""The registered queries: name, Spark form, SQL twin."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def check(name: str, sql: "str | None" = None):
    """Register a query under a name, with its twin if plain SQL can express it."""

    def keep(run):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            TWINS[name] = views.twin(sql)
        return run

    return keep


# SQL of the twins for the time fields of a valid ``datetime``, in its own offset.
LOCAL = "CAST(substr(datetime, 1, 19) AS TIMESTAMP)"
YEAR = f"CAST(year({LOCAL}) AS INTEGER)"
MONTH = f"CAST(month({LOCAL}) AS INTEGER)"
HOUR = f"CAST(hour({LOCAL}) AS INTEGER)"
WEEKNUM = f"CAST((dayofweek({LOCAL}) + 6) % 7 AS INTEGER)"
WEEKDAY = f"substr(dayname({LOCAL}), 1, 3)"
DATEDAY = "substr(datetime, 1, 10)"
TIMEZONE = "substr(datetime, 20, 6)"
OFFSET = (
    "(CASE substr(datetime, 20, 1) WHEN '-' THEN -60 ELSE 60 END"
    " * (CAST(substr(datetime, 21, 2) AS INTEGER) * 60 + CAST(substr(datetime, 24, 2) AS INTEGER)))"
)
UNIX = f"(CAST(epoch({LOCAL}) AS BIGINT) - {OFFSET})"
PERIOD = (
    f"CASE WHEN hour({LOCAL}) < 8 THEN 'Midnight' WHEN hour({LOCAL}) < 12 THEN 'Morning'"
    f" WHEN hour({LOCAL}) < 19 THEN 'Afternoon' ELSE 'Evening' END"
)


def rfc3339(seconds: str) -> str:
    return f"strftime(make_timestamp(({seconds}) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')"


def duration(age: str) -> str:
    """Text age of a number of seconds."""
    steps = [
        ("years", f"({age}) // 31557600"),
        ("months", f"({age}) % 31557600 // 2630016"),
        ("days", f"({age}) % 31557600 % 2630016 // 86400"),
    ]
    parts = [
        f"CASE WHEN {n} = 1 THEN '1{unit[:-1]}' WHEN {n} > 1 THEN concat({n}, '{unit}') END"
        for unit, n in steps
    ]
    rest = f"({age}) % 31557600 % 2630016 % 86400"
    for unit, n in (("h", f"{rest} // 3600"), ("m", f"{rest} % 3600 // 60"), ("s", f"{rest} % 60")):
        parts.append(f"CASE WHEN {n} > 0 THEN concat({n}, '{unit}') END")
    text = f"concat_ws(' ', {', '.join(parts)})"
    return f"CASE WHEN ({age}) = 0 THEN '0s' WHEN ({age}) > 0 THEN {text} END"


def streaks(source: str, group: str = "repo_name") -> str:
    """Gaps-and-islands twin: one row per group with n, first day and last day."""
    return f"""
      SELECT * FROM (
        SELECT grp, count(*) AS n, min(day) AS s, max(day) AS e,
               row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, min(day)) AS place
        FROM (SELECT grp, day, day - row_number() OVER (PARTITION BY grp ORDER BY day) AS run
              FROM (SELECT DISTINCT {group} AS grp, {UNIX} // 86400 AS day FROM {source}))
        GROUP BY grp, run) WHERE place = 1"""


def day_text(day: str) -> str:
    return f"strftime(DATE '1970-01-01' + CAST({day} AS INTEGER), '%Y-%m-%d')"
