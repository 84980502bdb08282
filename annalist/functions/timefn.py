"""Time functions over RFC 3339 text, read in the text's own UTC offset.

Every function is a native Column expression, so it stays inside whole-stage codegen, and
gives NULL for NULL or unparseable text. None of them depends on the session time zone.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted text shape, names and limits the results must agree on.
RFC3339 = (
    r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?"
    r"([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)\z"
)
WEEKDAYS = "MonTueWedThuFriSatSun"
MIDNIGHT_LAST_HOUR = 7
MORNING_LAST_HOUR = 11
AFTERNOON_LAST_HOUR = 18
DAY = 86_400
YEAR = 31_557_600
MONTH = 2_630_016


def _col(c: "Column | str") -> Column:
    return F.col(c) if isinstance(c, str) else c


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def local_ts(c: "Column | str") -> Column:
    """Wall clock of the text as TIMESTAMP_NTZ, to the second; a leap second reads as :59."""
    c = _col(c)
    second = F.substring(c, 18, 2)
    text = F.concat(
        F.substring(c, 1, 10),
        F.lit(" "),
        F.substring(c, 12, 6),
        F.when(second == "60", "59").otherwise(second),
    )
    return F.when(c.rlike(RFC3339), text.try_cast("timestamp_ntz"))


def offset_minutes(c: "Column | str") -> Column:
    """UTC offset of valid text in minutes, east positive."""
    c = _col(c)
    minutes = (
        F.substring(c, -5, 2).try_cast("int") * 60 + F.substring(c, -2, 2).try_cast("int")
    )
    return (
        F.when(F.upper(F.substring(c, -1, 1)) == "Z", F.lit(0))
        .when(F.substring(c, -6, 1) == "-", -minutes)
        .otherwise(minutes)
    )


def year(c: "Column | str") -> Column:
    return F.year(local_ts(c))


def month(c: "Column | str") -> Column:
    return F.month(local_ts(c))


def weeknum(c: "Column | str") -> Column:
    """Day of the week, 0 for Monday to 6 for Sunday."""
    return F.weekday(local_ts(c))


def weekday_name(number: Column) -> Column:
    """Three-letter English name of a day number; the same in every locale."""
    return F.substring(F.lit(WEEKDAYS), number * 3 + 1, F.lit(3))


def weekday(c: "Column | str") -> Column:
    return weekday_name(weeknum(c))


def dateday(c: "Column | str") -> Column:
    return local_ts(c).cast("date").cast("string")


def hour(c: "Column | str") -> Column:
    return F.hour(local_ts(c))


def period_of_hour(h: Column) -> Column:
    return (
        F.when(h <= MIDNIGHT_LAST_HOUR, "Midnight")
        .when(h <= MORNING_LAST_HOUR, "Morning")
        .when(h <= AFTERNOON_LAST_HOUR, "Afternoon")
        .when(h.isNotNull(), "Evening")
    )


def period(c: "Column | str") -> Column:
    return period_of_hour(hour(c))


def seconds_of(local: Column, c: "Column | str") -> Column:
    """Unix seconds of a parsed wall clock, with the offset of its text."""
    return (
        F.unix_date(local.cast("date")).cast("bigint") * DAY
        + F.hour(local) * 3600
        + F.minute(local) * 60
        + F.second(local)
        - offset_minutes(c) * 60
    )


def timestamp(c: "Column | str") -> Column:
    """Unix seconds."""
    return seconds_of(local_ts(c), c)


def offset_text(c: "Column | str") -> Column:
    """UTC offset of valid text, ``+00:00`` for every form of zero."""
    c = _col(c)
    tail = F.substring(c, -6, 6)
    zero = (F.upper(F.substring(c, -1, 1)) == "Z") | (tail == "-00:00")
    return F.when(zero, "+00:00").otherwise(tail)


def timezone(c: "Column | str") -> Column:
    return F.when(local_ts(c).isNotNull(), offset_text(c))


def utc_clock(seconds: "Column | str") -> Column:
    """UTC wall clock of Unix seconds as TIMESTAMP_NTZ."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + _col(seconds) * F.expr("INTERVAL '1' SECOND")


def timestamp_rfc3339(seconds: "Column | str") -> Column:
    return F.date_format(utc_clock(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def duration(seconds: "Column | str", as_of: "Column | int | None" = None) -> Column:
    """Age of a Unix time as text such as ``5years 17days 7h 53m 36s``.

    ``as_of`` is the Unix time to count from, the query's start if left out. A time after
    ``as_of`` gives NULL.
    """
    if as_of is None:
        as_of = F.unix_seconds(F.current_timestamp())
    elif not isinstance(as_of, Column):
        as_of = F.lit(as_of).cast("bigint")
    age = as_of - _col(seconds)
    in_year = age % YEAR
    in_month = in_year % MONTH
    in_day = in_month % DAY

    def named(n, unit):
        return F.when(n == 1, f"1{unit}").when(n > 1, F.concat(n.cast("string"), F.lit(f"{unit}s")))

    def short(n, unit):
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))

    text = F.concat_ws(
        " ",
        named(_div(age, YEAR), "year"),
        named(_div(in_year, MONTH), "month"),
        named(_div(in_month, DAY), "day"),
        short(_div(in_day, 3600), "h"),
        short(_div(in_day % 3600, 60), "m"),
        short(in_day % 60, "s"),
    )
    return F.when(age == 0, "0s").when(age > 0, text)
