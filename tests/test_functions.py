import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmetrics.functions import labels, time as X
from flowmetrics.functions.pvalue import correlation_p_value


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def day_by_day(start, end):
    """Working hours by walking over the days."""
    if start is None or end is None:
        return 0.0
    start, end = min(start, end), max(start, end)
    total, day = 0.0, start.replace(hour=0, minute=0, second=0, microsecond=0)
    while day <= end:
        if day.weekday() < 5:
            lo = max(start, day + dt.timedelta(hours=9))
            hi = min(end, day + dt.timedelta(hours=18, minutes=30))
            total += max(0.0, (hi - lo).total_seconds())
        day += dt.timedelta(days=1)
    return total / 3600


def test_business_hours_equals_day_by_day(spark):
    rng = np.random.default_rng(7)
    base = dt.datetime(1968, 1, 1)
    rows = []
    for i in range(400):
        a = base + dt.timedelta(seconds=int(rng.integers(0, 2_000_000_000)), microseconds=int(rng.integers(0, 1_000_000)))
        b = a + dt.timedelta(seconds=int(rng.integers(-3_000_000, 3_000_000)))
        rows.append((i, a, b))
    rows += [(400, None, base), (401, base, None)]
    got = dict(values(spark, rows, "i int, a timestamp_ntz, b timestamp_ntz", "i", X.business_hours("a", "b")))
    for i, a, b in rows:
        assert got[i] == pytest.approx(day_by_day(a, b), abs=1e-9)


def test_business_hours_to_now_is_not_negative(spark):
    (got,) = values(spark, [(dt.datetime(2024, 1, 1),)], "a timestamp_ntz", X.business_hours("a"))
    assert got[0] > 1000


def test_working_days_equals_busday_count(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        a = dt.date(1969, 1, 1) + dt.timedelta(days=int(rng.integers(0, 25000)))
        rows.append((i, a, a + dt.timedelta(days=int(rng.integers(-5, 400)))))
    got = dict(values(spark, rows, "i int, a date, b date", "i", X.working_days("a", "b")))
    for i, a, b in rows:
        assert got[i] == max(1, int(np.busday_count(a, b)))


@pytest.mark.parametrize("seconds,text", [
    (0.0, "00:00"), (59.9, "00:00"), (60.0, "00:01"), (-0.5, "00:00"), (-61.0, "-00:01"), (359_999.0, "99:59"),
    (443_000.0, "123:03"), (None, None),
])
def test_interval_to_hhmm(spark, seconds, text):
    assert values(spark, [(seconds,)], "x double", X.interval_to_hhmm("x")) == [(text,)]


@pytest.mark.parametrize("hours,text", [
    (0.0, "00:00"), (1.5, "01:30"), (-3.25, "-03:15"), (1.9999, "02:00"), (0.5 + 0.5 / 60, "00:30"), (123.0, "123:00"),
    (-0.001, "-00:00"), (None, None), (float("nan"), None),
])
def test_hours_to_hhmm(spark, hours, text):
    assert values(spark, [(hours,)], "x double", X.hours_to_hhmm("x")) == [(text,)]


def test_parse_date_and_offsets(spark):
    rows = [("2025-03-01 10:00:00",), ("2025-03-01T10:00:00+02:00",), ("2025-03-01",), ("",), ("NaT",), ("null",), (None,), ("no",)]
    got = [r[0] for r in values(spark, rows, "x string", F.date_format(X.parse_date("x"), "yyyy-MM-dd HH:mm"))]
    assert got == ["2025-03-01 10:00", "2025-03-01 08:00", "2025-03-01 00:00", None, None, None, None, None]
    shifted = values(spark, rows[:1], "x string", F.date_format(X.parse_date("x", -6.5), "yyyy-MM-dd HH:mm"))
    assert shifted == [("2025-03-01 03:30",)]
    other = values(spark, [("01/02/2025",)], "x string", F.date_format(X.parse_date("x", formats=["dd/MM/yyyy"]), "yyyy-MM-dd"))
    assert other == [("2025-02-01",)]


def test_auto_parse_dates_takes_any_parser(spark):
    df = spark.createDataFrame([("a", "b", "c")], "Fecha_x string, otra string, mi_fecha string")
    assert [tuple(r) for r in X.auto_parse_dates(df, parse=F.upper).collect()] == [("A", "b", "C")]


def test_elapsed_units_and_literal_end(spark):
    rows = [(dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2, 12, 0, 0, 500_000))]
    got = values(
        spark, rows, "a timestamp_ntz, b timestamp_ntz",
        X.elapsed("a", F.col("b"), "segundos"), X.elapsed("a", F.col("b"), "dias"), X.elapsed("b", "2025-01-02 12:00:00", "otra"),
    )[0]
    assert got == (pytest.approx(129_600.5), pytest.approx(1.5 + 0.5 / 86400), pytest.approx(-0.5 / 3600))


@pytest.mark.parametrize("name,kind", [
    (" calidad ", "Calidad"), ("Pre Calidad", "Pre-Calidad"), ("PRECALIDAD", "Pre-Calidad"), ("bg", "Morado"), ("MORADO", "Morado"),
    ("verde", "Verde"), ("Estacion 1", "Azul"), ("Estacion 8", "Rojo"), ("Estacion 9", "Verde"), ("Estacion 4", "Amarillo"),
    ("Estacion 5", "Morado"), ("Estacion 6", "Calidad"), ("Estacion -1", "Morado"), ("Estacion  +7", "Azul"), ("estacion 1", "Otro"),
    ("Estacion", "Otro"), ("Estacion E1", "Otro"), ("Estacion 1 2", "Otro"), ("", "Otro"), (None, "Otro"),
])
def test_station_type(spark, name, kind):
    assert values(spark, [(name,)], "x string", labels.station_type(F.col("x"))) == [(kind,)]


def test_extra_stations_from_the_cutoff_on(spark):
    rows = [("Estacion E1", dt.datetime(2026, 4, 30, 23, 59)), (" estacion e6 ", dt.datetime(2026, 5, 1)), ("Estacion E7", dt.datetime(2026, 6, 1)),
            ("Estacion 1", dt.datetime(2026, 6, 1))]
    got = values(spark, rows, "x string, t timestamp_ntz", labels.operation_station_type(F.col("x"), F.col("t")))
    assert got == [("Otro",), ("Naranja",), ("Otro",), ("Azul",)]


def test_client_from_campaign(spark):
    rows = [("FDA MAR26",), ("Ñandú_1 x",), (" FDA",), ("",), (None,)]
    assert values(spark, rows, "x string", labels.client_from_campaign(F.col("x"))) == [("FDA",), ("Ñandú_1",), (None,), (None,), (None,)]


@pytest.mark.parametrize("z,category", [
    (1.2817, "critico"), (1.2816, "mejorable"), (0.5245, "mejorable"), (0.5244, "normal"), (-0.5244, "normal"), (-0.5245, "bueno"),
    (-1.2816, "bueno"), (-1.2817, "excelente"), (None, "sin_referencia"), (float("nan"), "sin_referencia"),
])
def test_zscore_category(spark, z, category):
    assert values(spark, [(z,)], "z double", labels.zscore_category(F.col("z"))) == [(category,)]


def t_tail(r, n):
    """Two-sided p value by numerical integration of the t density."""
    df = n - 2
    t = abs(r) * math.sqrt(df / (1 - r * r))
    u = np.linspace(0, math.atan(t / math.sqrt(df)), 200_001)
    density = np.cos(u) ** (df - 1)
    norm = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 1 - 2 * norm * np.trapezoid(density, u)


def test_correlation_p_value(spark):
    rows = [(0.1, 10), (0.5, 12), (-0.7, 30), (0.01, 1000), (0.06, 1000), (-0.02, 100_000), (0.3, 11), (0.9, 10), (0.05, 2_000_000)]
    got = values(spark, rows, "r double, n bigint", correlation_p_value(F.col("r"), F.col("n")))
    for (r, n), (p,) in zip(rows, got):
        assert p == pytest.approx(t_tail(r, n), abs=2e-9)
    edge = values(spark, [(1.0, 20), (0.0, 20), (None, 20), (0.5, 2)], "r double, n bigint", correlation_p_value(F.col("r"), F.col("n")))
    assert edge == [(0.0,), (1.0,), (None,), (None,)]


def test_stars_use_strict_limits(spark):
    rows = [(0.0009,), (0.001,), (0.01,), (0.05,), (None,)]
    assert values(spark, rows, "p double", labels.significance_stars(F.col("p"))) == [("***",), ("**",), ("*",), ("",), ("",)]
