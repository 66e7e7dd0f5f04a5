"""Time expressions: date parsing, elapsed and working time, HH:MM text.

All of them are plain Column expressions. Instants are taken as whole microseconds, so fractions of a
second are kept, and naive timestamps are read in the session time zone, which must be UTC.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
HOUR_MICROS = 3_600_000_000
EPOCH_TO_MONDAY_DAYS = 4  # 1970-01-01 is a Thursday; 1970-01-05 is the first Monday
UNIT_SECONDS = {"segundos": 1, "minutos": 60, "horas": 3600, "dias": 86400}
NULL_TEXTS = ("", "NaT", "null")


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def micros(instant: Column) -> Column:
    return F.unix_micros(instant.cast("timestamp"))


def now() -> Column:
    return F.localtimestamp()


def seconds_between(start, end) -> Column:
    """Signed seconds from ``start`` to ``end``, fractions kept."""
    return (micros(_column(end)) - micros(_column(start))) / F.lit(1e6)


def elapsed(start, end=None, unit: str = "horas") -> Column:
    """Signed difference in ``unit`` (segundos, minutos, horas, dias; anything else counts as horas).

    ``end`` is a Column, a date text, or None for the current time.
    """
    if end is None:
        end = now()
    elif not isinstance(end, Column):
        end = F.lit(str(end)).cast("timestamp_ntz")
    return seconds_between(start, end) / F.lit(float(UNIT_SECONDS.get(unit, 3600)))


def _open_micros(instant: Column, opens: int, closes: int) -> Column:
    """Opening time passed from the first Monday until ``instant``, in microseconds."""
    since_monday = micros(instant) - F.lit(EPOCH_TO_MONDAY_DAYS * DAY_MICROS)
    time_of_day = F.pmod(since_monday, F.lit(DAY_MICROS))
    day = ((since_monday - time_of_day) / F.lit(DAY_MICROS)).cast("long")
    weekday = F.pmod(day, F.lit(7))
    weeks = ((day - weekday) / F.lit(7)).cast("long")
    span = F.lit(closes - opens)
    today = F.greatest(F.lit(0), F.least(span, time_of_day - F.lit(opens)))
    return (weeks * 5 + F.least(weekday, F.lit(5))) * span + F.when(weekday < 5, today).otherwise(F.lit(0))


def business_hours(start, end=None, opens: float = 9.0, closes: float = 18.5) -> Column:
    """Hours of [start, end] that fall on Monday to Friday between ``opens`` and ``closes``.

    Order of the two ends does not matter; a missing end point gives 0.
    """
    lo, hi = round(opens * HOUR_MICROS), round(closes * HOUR_MICROS)
    first = _column(start)
    last = now() if end is None else _column(end)
    worked = F.abs(_open_micros(last, lo, hi) - _open_micros(first, lo, hi))
    return F.coalesce(worked / F.lit(float(HOUR_MICROS)), F.lit(0.0))


def _weekdays_before(day: Column) -> Column:
    """Monday-to-Friday days from the first Monday up to, and not including, ``day``."""
    n = F.datediff(day, F.lit("1970-01-05").cast("date"))
    weekday = F.pmod(n, F.lit(7))
    return ((n - weekday) / F.lit(7)).cast("long") * 5 + F.least(weekday, F.lit(5))


def working_days(start, end) -> Column:
    """Weekdays in [start, end), at least 1."""
    n = _weekdays_before(_column(end).cast("date")) - _weekdays_before(_column(start).cast("date"))
    return F.when(n.isNotNull(), F.greatest(n, F.lit(1)))


def _hhmm(negative: Column, hours: Column, minutes: Column) -> Column:
    sign = F.when(negative, F.lit("-")).otherwise(F.lit(""))
    return F.format_string("%s%02d:%02d", sign, hours.cast("long"), minutes.cast("long"))


def interval_to_hhmm(seconds) -> Column:
    """Seconds to ``[-]HH:MM``; the part below a second is cut off, then the part below a minute."""
    whole = _column(seconds).cast("long")
    size = F.abs(whole)
    minutes = F.pmod((size - F.pmod(size, F.lit(60))) / F.lit(60), F.lit(60))
    hours = (size - F.pmod(size, F.lit(3600))) / F.lit(3600)
    return F.when(whole.isNotNull(), _hhmm(whole < 0, hours, minutes))


def hours_to_hhmm(hours) -> Column:
    """Hours to ``[-]HH:MM``; minutes are rounded half to even and carried."""
    value = _column(hours).cast("double")
    size = F.abs(value)
    whole = F.floor(size)
    minutes = F.bround((size - whole) * 60, 0).cast("long")
    carry = F.when(minutes == 60, F.lit(1)).otherwise(F.lit(0))
    text = _hhmm(value < 0, whole + carry, F.when(minutes == 60, F.lit(0)).otherwise(minutes))
    return F.when(value.isNotNull() & ~F.isnan(value), text)


def parse_date(col, offset_hours: float = 0, formats: Sequence[str] = ()) -> Column:
    """Text to a UTC timestamp, shifted by ``offset_hours``; empty, ``NaT``, ``null`` or unreadable is NULL.

    ``formats`` are tried in order when the ISO reading fails.
    """
    text = _column(col).cast("string")
    text = F.when(~text.isin(*NULL_TEXTS), text)
    parsed = F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    if offset_hours:
        parsed = F.timestamp_add("MICROSECOND", F.lit(round(offset_hours * HOUR_MICROS)), parsed)
    return parsed


def auto_parse_dates(
    df: DataFrame,
    keyword: str = "fecha",
    parse: Callable[[Column], Column] | None = None,
    offset_hours: float = 0,
) -> DataFrame:
    """Apply a Column -> Column parser to every column whose lower-cased name contains ``keyword``."""
    parser = parse or (lambda c: parse_date(c, offset_hours))
    return df.withColumns({c: parser(df[c]) for c in df.columns if keyword in c.lower()})
