"""The given tables seen as the library's input tables.

``*_SQL`` is the same view in DuckDB SQL; the oracles start with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmetrics.schemas import STATION_ORDER

STATIONS = ["Azul", "Rojo", "Verde", "Amarillo", "Morado", "Pre-Calidad", "Calidad", "Naranja"]
assert set(STATIONS) == set(STATION_ORDER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a table held by fewer files than there are cores; a large table is left where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if len(df.inputFiles()) < min(cores, 64) else df


def _plus_seconds(instant, seconds):
    return instant + F.expr("interval '1' second") * seconds


def _element(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def ops(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    """Operations from one join of the raw tables; ``more`` are further columns from its rows."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q")
    )
    lines = spread(lines, "l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        customers, F.col("o_custkey") == F.col("c_custkey")
    )
    start = F.col("l_linenumber") * 3600 + F.col("l_partkey") % 1800
    stop = start + F.col("q") * 30 + F.col("l_suppkey") % 60 + F.when(F.col("l_partkey") % 97 == 0, 20000).otherwise(0)
    return rows.select(
        F.col("l_orderkey").cast("string").alias("box_id"),
        _element(STATIONS, (F.col("l_linenumber") + F.col("l_partkey") % 3) % 8).alias("tipo_estacion"),
        F.concat("c_mktsegment", F.lit(" "), F.date_format("o_orderdate", "yyyy-MM")).alias("campana"),
        F.col("c_mktsegment").alias("cliente"),
        _plus_seconds(F.col("o_orderdate"), start).alias("init_scan"),
        _plus_seconds(F.col("o_orderdate"), stop).alias("last_scan"),
        (F.col("q") % 10).alias("picks"),
        *[c.alias(name) for name, c in more.items()],
    )


OPS_SQL = """ops as (
  select cast(l_orderkey as varchar) box_id,
    ['Azul','Rojo','Verde','Amarillo','Morado','Pre-Calidad','Calidad','Naranja']
        [cast((l_linenumber + l_partkey % 3) % 8 as int) + 1] tipo_estacion,
    c_mktsegment || ' ' || strftime(o_orderdate, '%Y-%m') campana, c_mktsegment cliente,
    o_orderdate + to_seconds(l_linenumber*3600 + l_partkey%1800) init_scan,
    o_orderdate + to_seconds(l_linenumber*3600 + l_partkey%1800 + cast(l_quantity as bigint)*30
        + l_suppkey%60 + case when l_partkey%97=0 then 20000 else 0 end) last_scan,
    cast(l_quantity as bigint) % 10 picks
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    digit = F.col("event_id") % 10
    is_scan = F.col("event_type").isin("view", "click", "purchase")
    only = lambda c: F.when(is_scan, c)
    return raw.select(
        "event_id",
        F.when(F.col("event_type") == "signup", "box_open")
        .when(F.col("event_type") == "error", "box_close")
        .when(F.col("event_type") == "view", "scan")
        .otherwise("pick_ok")
        .alias("type"),
        F.col("user_id").cast("string").alias("box_id"),
        F.when(digit == 9, "bg")
        .when(digit == 8, "Pre-Calidad")
        .when(digit == 7, "Estacion E1")
        .when(digit == 0, "otra")
        .otherwise(F.concat(F.lit("Estacion "), digit.cast("string")))
        .alias("estacion"),
        F.concat(
            _element(["DQ", "FAB", "FDA"], F.col("user_id") % 3),
            F.lit(" W"),
            F.lpad(F.weekofyear("ts").cast("string"), 2, "0"),
        ).alias("campana"),
        (F.col("user_id") % 3).alias("id_campana"),
        F.col("ts").alias("time"),
        only(F.col("k")).alias("scan"),
        only(F.col("k") % 17).alias("sku"),
        only(F.col("k") % 7).alias("categoria"),
        only(F.col("k") % 5).alias("row"),
        only(F.col("k") % 4).alias("material"),
        only(F.col("event_id")).alias("consecutivo"),
    )


EVENTS_SQL = """ev as (
  select event_id,
    case event_type when 'signup' then 'box_open' when 'error' then 'box_close'
                    when 'view' then 'scan' else 'pick_ok' end as "type",
    cast(user_id as varchar) box_id,
    case event_id % 10 when 9 then 'bg' when 8 then 'Pre-Calidad' when 7 then 'Estacion E1'
                       when 0 then 'otra' else 'Estacion ' || (event_id % 10) end estacion,
    ['DQ','FAB','FDA'][cast(user_id % 3 as int) + 1] || ' W' || strftime(ts, '%V') campana,
    user_id % 3 id_campana, ts as "time",
    case when event_type in ('view','click','purchase') then cast(json_extract_string(props, '$.k') as int) end k
  from events),
evs as (
  select *, k as scan, k % 17 as sku, k % 7 as categoria, k % 5 as "row", k % 4 as material,
    case when k is not null then event_id end as consecutivo from ev)"""


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    key = F.col("o_orderkey")
    text = lambda seconds: F.date_format(_plus_seconds(F.col("o_orderdate"), seconds), "yyyy-MM-dd HH:mm:ss")
    return rows.select(
        key.cast("string").alias("Folio"),
        F.col("c_mktsegment").alias("Cliente"),
        F.year("o_orderdate").alias("Año"),
        F.concat("c_mktsegment", F.lit(" "), F.date_format("o_orderdate", "yyyy-MM")).alias("Campaña"),
        text(F.col("o_custkey") % 43200).alias("fecha_arte"),
        text(86400 * (key % 12) + (key * 7) % 86400).alias("fecha_preproyecto"),
        F.when(F.col("o_orderstatus") == "O", "")
        .otherwise(text(86400 * (key % 20) + (key * 13) % 86400))
        .alias("fecha_aprobado_arte"),
        F.when(F.col("o_orderstatus") == "F", "NaT").otherwise(text(86400 * (key % 25))).alias("fecha_aprobado_ODT"),
    )


STRATEGIES_SQL = """st as (
  select cast(o_orderkey as varchar) "Folio", c_mktsegment "Cliente", cast(year(o_orderdate) as int) "Año",
    c_mktsegment || ' ' || strftime(o_orderdate, '%Y-%m') "Campaña",
    strftime(o_orderdate + to_seconds(o_custkey % 43200), '%Y-%m-%d %H:%M:%S') fecha_arte,
    strftime(o_orderdate + to_seconds(86400*(o_orderkey%12) + (o_orderkey*7)%86400), '%Y-%m-%d %H:%M:%S') fecha_preproyecto,
    case when o_orderstatus = 'O' then ''
         else strftime(o_orderdate + to_seconds(86400*(o_orderkey%20) + (o_orderkey*13)%86400), '%Y-%m-%d %H:%M:%S') end fecha_aprobado_arte,
    case when o_orderstatus = 'F' then 'NaT'
         else strftime(o_orderdate + to_seconds(86400*(o_orderkey%25)), '%Y-%m-%d %H:%M:%S') end "fecha_aprobado_ODT"
  from orders join customer on o_custkey = c_custkey)"""


def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of hand-made classes: padded and lower-cased keys, some campaigns left out."""
    month = F.substring("Campaña", -2, 2).cast("int")
    keys = strategies(spark, sf_dir).select("Cliente", "Campaña").distinct()
    return keys.where((month % 3 == 0) | (month % 4 == 0)).select(
        F.concat(F.lit("  "), F.lower("Cliente"), F.lit(" ")).alias("Cliente"),
        F.concat(F.lower("Campaña"), F.lit("  ")).alias("Campaña"),
        F.when(month % 3 == 0, 1).otherwise(0).alias("tradicional"),
    )


CLASSIFICATION_SQL = """clas as (
  select distinct '  ' || lower("Cliente") || ' ' as "Cliente", lower("Campaña") || '  ' as "Campaña",
    case when cast(right("Campaña", 2) as int) % 3 = 0 then 1 else 0 end as tradicional
  from st where cast(right("Campaña", 2) as int) % 3 = 0 or cast(right("Campaña", 2) as int) % 4 = 0)"""


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event records with a struct inside a struct, a list of structs that is often empty, and NULL cells."""
    raw = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    tags = F.array(F.struct(F.lit("k").alias("nombre"), F.col("k").alias("peso")),
                   F.struct(F.lit("u").alias("nombre"), (F.col("user_id") % 9).cast("int").alias("peso")))
    user = F.struct(
        F.col("user_id").alias("user_id"),
        F.struct((F.col("user_id") % 7).alias("zona_id"), F.col("event_type").alias("tipo")).alias("lugar"),
    )
    return raw.select(
        F.col("event_id").alias("id"),
        F.col("value").alias("valor"),
        F.when(F.col("event_id") % 11 != 0, user).alias("usuario"),
        F.when(F.col("event_id") % 3 == 0, F.slice(tags, 1, 0))
        .when(F.col("event_id") % 5 == 0, F.lit(None))
        .otherwise(tags)
        .alias("tags"),
    )
