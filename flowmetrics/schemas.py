"""Table contracts: column types, fixed vocabularies and column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabulary of station types and categories, as the users' tables carry them.
STATION_ORDER = {
    "Naranja": 1,
    "Azul": 2,
    "Rojo": 3,
    "Verde": 4,
    "Amarillo": 5,
    "Morado": 6,
    "Pre-Calidad": 7,
    "Calidad": 8,
}
LINE_STATIONS = ("Azul", "Rojo", "Amarillo", "Verde", "Morado", "Naranja")
CHECKPOINT_STATIONS = ("Calidad", "Pre-Calidad")
STATION_LAYOUT = {
    "Azul": "5x3",
    "Rojo": "5x3",
    "Amarillo": "9x3",
    "Verde": "9x3",
    "Morado": "1x1",
    "Calidad": "1x1",
    "Pre-Calidad": "1x1",
    "Naranja": "Not defined",
}
STATION_SHARE_COLUMN = {
    "Azul": "pct_azul",
    "Rojo": "pct_rojo",
    "Verde": "pct_verde",
    "Amarillo": "pct_amarillo",
    "Morado": "pct_morado",
    "Calidad": "pct_calidad",
    "Pre-Calidad": "pct_pc",
    "Naranja": "pct_naranja",
}
UNMAPPED_STATION = "Otro"
CATEGORY_ORDER = ("critico", "mejorable", "normal", "bueno", "excelente", "sin_referencia")
SCAN_TYPES = ("scan", "pick_ok")

EVENTS = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("box_id", T.StringType()),
    T.StructField("estacion", T.StringType()),
    T.StructField("campana", T.StringType()),
    T.StructField("id_campana", T.StringType()),
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("scan", T.StringType()),
    T.StructField("sku", T.StringType()),
    T.StructField("categoria", T.StringType()),
    T.StructField("material", T.StringType()),
    T.StructField("row", T.StringType()),
    T.StructField("consecutivo", T.LongType()),
])
STRATEGIES = T.StructType([
    T.StructField("Folio", T.StringType()),
    T.StructField("Campaña", T.StringType()),
    T.StructField("Estrategia", T.StringType()),
    T.StructField("fecha_arte", T.StringType()),
    T.StructField("fecha_preproyecto", T.StringType()),
    T.StructField("fecha_aprobado_arte", T.StringType()),
    T.StructField("fecha_aprobado_ODT", T.StringType()),
])
CLASSIFICATION = T.StructType([
    T.StructField("Cliente", T.StringType()),
    T.StructField("Campaña", T.StringType()),
    T.StructField("tradicional", T.IntegerType()),
])
BOX_DIFFICULTY = T.StructType([
    T.StructField("campana", T.StringType()),
    T.StructField("box_id", T.StringType()),
    T.StructField("n_skus_en_caja", T.LongType()),
    T.StructField("n_categorias_en_caja", T.LongType()),
    T.StructField("cambios_de_row", T.LongType()),
    T.StructField("n_filas_distintas", T.LongType()),
])
CAMPAIGN_COMPLEXITY = T.StructType([
    T.StructField("campana", T.StringType()),
    T.StructField("n_skus_distintos", T.LongType()),
    T.StructField("n_materiales_distintos", T.LongType()),
    T.StructField("n_categorias_distintas", T.LongType()),
    T.StructField("entropia_sku", T.DoubleType()),
    T.StructField("hhi_sku", T.DoubleType()),
    T.StructField("skus_por_caja_mediana", T.DoubleType()),
])


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    """Raise ``ValueError`` naming the columns that ``df`` lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found in the DataFrame: {missing}")


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add each absent column as a NULL of the given type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def quoted(name: str) -> Column:
    """Column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def lookup(key: Column, values: dict) -> Column:
    """Value of a small fixed mapping, NULL for any other key."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def station_dimension(spark: SparkSession) -> DataFrame:
    """One row per known station type: line flag, grid layout, share column, physical order."""
    rows = [
        (name, name in LINE_STATIONS, STATION_LAYOUT[name], STATION_SHARE_COLUMN[name], order)
        for name, order in STATION_ORDER.items()
    ]
    return spark.createDataFrame(
        rows, "tipo_estacion string, es_linea boolean, configuracion_estacion string, columna_pct string, orden int"
    )
