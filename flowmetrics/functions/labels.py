"""Label expressions: station types, client names, categories of scores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowmetrics.schemas import CATEGORY_ORDER, UNMAPPED_STATION, lookup

# Numbered stations repeat their type every six positions.
TYPE_BY_POSITION = {1: "Azul", 2: "Rojo", 3: "Verde", 4: "Amarillo", 5: "Morado", 0: "Calidad"}
TYPE_BY_NAME = {
    "calidad": "Calidad",
    "pre-calidad": "Pre-Calidad",
    "pre calidad": "Pre-Calidad",
    "precalidad": "Pre-Calidad",
    "bg": "Morado",
    "morado": "Morado",
    "azul": "Azul",
    "rojo": "Rojo",
    "verde": "Verde",
    "amarillo": "Amarillo",
}
# Extra stations, and the day from which they count as one line.
EXTRA_STATIONS = ("estacion e1", "estacion e2", "estacion e3", "estacion e4", "estacion e5", "estacion e6")
EXTRA_STATIONS_FROM = "2026-05-01"
EXTRA_STATION_TYPE = "Naranja"
# Cuts of the standard normal at 10, 30, 70 and 90 percent.
Z_EXCELLENT, Z_GOOD, Z_IMPROVABLE, Z_CRITICAL = -1.2816, -0.5244, 0.5244, 1.2816


def stripped(text: Column) -> Column:
    """``text`` without white space of any kind (no-break spaces and separators too) at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def station_type(station: Column) -> Column:
    """Semantic type of a raw station name; ``Otro`` for anything unknown or missing."""
    name = stripped(station)
    digits = F.regexp_replace(F.regexp_extract(name, r"^Estacion \s*([+-]?\d+(?:_\d+)*)$", 1), "_", "")
    position = F.pmod(digits.try_cast("decimal(38,0)"), F.lit(6)).cast("int")
    return F.coalesce(
        lookup(F.lower(name), TYPE_BY_NAME), lookup(position, TYPE_BY_POSITION), F.lit(UNMAPPED_STATION)
    )


def operation_station_type(
    station: Column,
    started: Column,
    extra_from: str = EXTRA_STATIONS_FROM,
    extra_stations: Iterable[str] = EXTRA_STATIONS,
) -> Column:
    """``station_type``, but the extra stations form one line of their own from ``extra_from`` on."""
    is_extra = F.lower(stripped(station)).isin(*extra_stations)
    since = started >= F.lit(extra_from).cast("timestamp_ntz")
    return F.when(is_extra & since, F.lit(EXTRA_STATION_TYPE)).otherwise(station_type(station))


def client_from_campaign(campaign: Column) -> Column:
    """First word of the campaign name, NULL if it does not start with one."""
    return F.nullif(F.regexp_extract(campaign, r"(?U)^(\w+)", 1), F.lit(""))


def zscore_category(z: Column) -> Column:
    return (
        F.when(z.isNull() | F.isnan(z), "sin_referencia")
        .when(z > Z_CRITICAL, "critico")
        .when(z > Z_IMPROVABLE, "mejorable")
        .when(z >= Z_GOOD, "normal")
        .when(z >= Z_EXCELLENT, "bueno")
        .otherwise("excelente")
    )


def category_rank(category: Column) -> Column:
    """Position of a category in its fixed order, for sorting."""
    return lookup(category, {name: i for i, name in enumerate(CATEGORY_ORDER)})


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double, NULL where the denominator is 0 or missing."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
