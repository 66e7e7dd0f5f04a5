"""Box events to operations, and the campaign tables built on operations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmetrics.functions.labels import (
    EXTRA_STATIONS,
    EXTRA_STATIONS_FROM,
    client_from_campaign,
    operation_station_type,
    ratio,
    station_type,
)
from flowmetrics.functions.time import seconds_between, working_days
from flowmetrics.operators.order_stats import quantiles
from flowmetrics.operators.stats import known_keys
from flowmetrics.schemas import LINE_STATIONS, SCAN_TYPES, STATION_SHARE_COLUMN, UNMAPPED_STATION, quoted

OPERATION_KEY = ["box_id", "estacion", "campana", "id_campana"]


def cast_ids(df: DataFrame) -> DataFrame:
    """Columns named ``id`` or ending in ``_id`` become text, so that they are never summed."""
    return df.withColumns({
        c: quoted(c).cast("string") for c in df.columns if c == "id" or c.endswith("_id")
    })


def scan_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("type").isin(*SCAN_TYPES))


def station_subset(events: DataFrame, types: Iterable[str]) -> DataFrame:
    """Raw events of the given semantic station types."""
    return events.where(station_type(F.col("estacion")).isin(*types))


def line_stations_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("tipo_estacion").isin(*LINE_STATIONS))


def positive_picks(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("picks") > 0)


def mapped_stations_only(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("tipo_estacion") != UNMAPPED_STATION)


def pair_operations(
    events: DataFrame,
    extra_from: str = EXTRA_STATIONS_FROM,
    extra_stations: Iterable[str] = EXTRA_STATIONS,
) -> DataFrame:
    """One row per box, station and campaign that was both opened and closed, raw station kept.

    A single conditional aggregation: first opening, last closing, number of events with a scan.
    """
    at = F.col("time")
    paired = (
        known_keys(events, OPERATION_KEY)
        .groupBy(*OPERATION_KEY)
        .agg(
            F.min(F.when(F.col("type") == "box_open", at)).alias("init_scan"),
            F.max(F.when(F.col("type") == "box_close", at)).alias("last_scan"),
            F.count("scan").alias("picks"),
        )
        .where(F.col("init_scan").isNotNull() & F.col("last_scan").isNotNull())
    )
    kind = operation_station_type(F.col("estacion"), F.col("init_scan"), extra_from, extra_stations)
    return paired.withColumn("tipo_estacion", kind)


def unmapped_stations(paired: DataFrame) -> DataFrame:
    """Operations per raw station that has no known type, most frequent first."""
    return (
        paired.where(F.col("tipo_estacion") == UNMAPPED_STATION)
        .groupBy("estacion")
        .agg(F.count("*").alias("operaciones"))
        .orderBy(F.desc("operaciones"), "estacion")
    )


def client_map(events: DataFrame) -> DataFrame:
    """``campana`` to ``cliente``: the recorded client if the events carry one, else the first word.

    A campaign recorded with several clients gets the first in alphabetical order and is counted in
    ``clientes_distintos``.
    """
    known = known_keys(events, ["campana"])
    if "cliente_db" in events.columns:
        # the distinct pairs are few; the text minimum is taken over them, not over the events
        pairs = known.select("campana", F.col("cliente_db").alias("cliente")).distinct()
    else:
        pairs = known.select("campana").distinct().withColumn("cliente", client_from_campaign(F.col("campana")))
    return pairs.groupBy("campana").agg(
        F.min("cliente").alias("cliente"), F.count("cliente").alias("clientes_distintos")
    )


def build_operations(
    events: DataFrame,
    extra_from: str = EXTRA_STATIONS_FROM,
    extra_stations: Iterable[str] = EXTRA_STATIONS,
) -> DataFrame:
    """Operations from raw events: keys, station type, first and last scan, picks, client."""
    paired = pair_operations(events, extra_from, extra_stations).drop("estacion")
    if "cliente_db" in events.columns:
        paired = paired.join(client_map(events).drop("clientes_distintos"), "campana", "left")
    else:
        paired = paired.withColumn("cliente", client_from_campaign(F.col("campana")))
    return paired.select(
        "box_id", "campana", "id_campana", "tipo_estacion", "init_scan", "last_scan", "picks", "cliente"
    )


def base_operations(ops: DataFrame, year_from: str = "scan") -> DataFrame:
    """Add ``año``, ``tiempo_total_seg`` and ``tiempo_total_min``; ids as text, scans as UTC timestamps.

    ``year_from="campaign"`` takes 2026 or 2025 from the campaign name instead of the year of the scan.
    """
    scans = ops.withColumns({
        "box_id": F.col("box_id").cast("string"),
        "init_scan": F.col("init_scan").cast("timestamp"),
        "last_scan": F.col("last_scan").cast("timestamp"),
    })
    named = F.when(F.col("campana").contains("26"), 2026).when(F.col("campana").contains("25"), 2025)
    year = named if year_from == "campaign" else F.year("init_scan")
    return scans.withColumns({"año": year, "tiempo_total_seg": seconds_between("init_scan", "last_scan")}).withColumn(
        "tiempo_total_min", F.col("tiempo_total_seg") / 60
    )


def exclude_campaigns(ops: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop the operations of the campaigns listed in ``excluded.campana``; NULL campaigns stay."""
    return ops.join(excluded.select("campana").distinct(), "campana", "left_anti").select(*ops.columns)


def efficiency_metrics(ops: DataFrame, overwrite_client: bool = False) -> DataFrame:
    """Add seconds per pick and picks per minute, and the client where it is absent."""
    added = {
        "tiempo_por_pick": ratio(F.col("tiempo_total_seg"), F.col("picks")),
        "picks_por_min": ratio(F.col("picks"), F.col("tiempo_total_min")),
    }
    if overwrite_client or "cliente" not in ops.columns:
        added["cliente"] = client_from_campaign(F.col("campana"))
    return ops.withColumns(added)


def campaign_summary(ops: DataFrame) -> DataFrame:
    """One row per campaign: dates, picks, operations, station shares, pace, hours and working days.

    ``cliente`` and ``año`` are the known ones of the first scan, the smaller one in a tie.

    The rows are added up per campaign, client and year first, with numbers and dates only, so that this
    runs as a hash aggregation; the few rows that remain per campaign are then merged.
    """
    known = known_keys(ops, ["campana"])
    at = lambda name: F.sum(F.when(F.col("tipo_estacion") == name, 1).otherwise(0))
    pace = F.col("picks_por_min")
    parts = known.groupBy("campana", "cliente", "año").agg(
        F.min("init_scan").alias("_start"),
        F.max("last_scan").alias("_end"),
        F.sum("picks").alias("_picks"),
        F.max("picks").alias("_max"),
        F.count("picks").alias("_ops"),
        F.count("*").alias("_rows"),
        at("Morado").alias("_morado"),
        at("Calidad").alias("_calidad"),
        at("Pre-Calidad").alias("_pc"),
        F.count(pace).alias("_n"),
        F.avg(pace).alias("_mean"),
        F.var_pop(pace).alias("_var"),
        F.sum("tiempo_total_seg").alias("_seconds"),
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("_start", c))).alias(c)
    share = lambda part, out: (F.sum(part) / F.sum("_rows")).alias(out)
    n, mean = F.sum("_n"), F.sum(F.col("_n") * F.col("_mean")) / F.sum("_n")
    squares = F.sum(F.col("_n") * (F.col("_var") + F.col("_mean") * F.col("_mean")))
    totals = parts.groupBy("campana").agg(
        F.min("_start").alias("inicio"),
        F.max("_end").alias("fin"),
        F.coalesce(F.sum("_picks"), F.lit(0)).alias("picks_total"),
        F.max("_max").alias("picks_max_op"),
        F.sum("_ops").alias("ops_total"),
        first("cliente"),
        first("año"),
        F.month(F.min("_start")).alias("mes_inicio"),
        share("_morado", "pct_estacion_morado"),
        share("_calidad", "pct_estacion_calidad"),
        share("_pc", "pct_estacion_pc"),
        F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), squares - n * mean * mean) / (n - 1))).alias("picks_por_min_std"),
        (F.coalesce(F.sum("_seconds"), F.lit(0.0)) / 3600).alias("tiempo_total_horas"),
    )
    medians = quantiles(
        known.withColumn("_hour", F.hour("init_scan")),
        ["campana"],
        {
            "picks_por_op_mediana": ("picks", 0.5),
            "picks_por_min_mediana": ("picks_por_min", 0.5),
            "hora_inicio_mediana": ("_hour", 0.5),
        },
    )
    return (
        totals.join(medians, "campana", "left")
        .withColumn("dias_habiles", working_days("inicio", "fin"))
        .select(
            "campana", "inicio", "fin", "picks_total", "picks_por_op_mediana", "picks_max_op", "ops_total",
            "cliente", "año", "mes_inicio", "hora_inicio_mediana", "pct_estacion_morado", "pct_estacion_calidad",
            "pct_estacion_pc", "picks_por_min_mediana", "picks_por_min_std", "tiempo_total_horas", "dias_habiles",
        )
    )


def campaign_station_median(
    ops: DataFrame,
    group_cols: Sequence[str] = ("campana", "tipo_estacion", "cliente", "año"),
    metric: str = "tiempo_por_pick",
) -> DataFrame:
    """Median of ``metric`` per group as ``mediana_tpp``; NULL keys form groups of their own."""
    return quantiles(ops, list(group_cols), {"mediana_tpp": (metric, 0.5)})


def station_shares(ops: DataFrame) -> DataFrame:
    """Per campaign, the share of operations at each station type, one column per type."""
    shares = [
        F.avg(F.when(F.col("tipo_estacion") == name, 1.0).otherwise(0.0)).alias(column)
        for name, column in STATION_SHARE_COLUMN.items()
    ]
    return known_keys(ops, ["campana"]).groupBy("campana").agg(*shares)
