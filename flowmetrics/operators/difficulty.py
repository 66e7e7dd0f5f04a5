"""Box difficulty, campaign complexity and their relation to picking time."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmetrics.functions.labels import ratio, significance_stars
from flowmetrics.functions.pvalue import correlation_p_value
from flowmetrics.functions.time import seconds_between
from flowmetrics.operators.order_stats import HOT_GROUP_ROWS, average_rank, previous_row, quantiles
from flowmetrics.operators.picking import client_map, line_stations_only, scan_events, station_subset
from flowmetrics.operators.stats import bounded_metric, known_keys
from flowmetrics.schemas import (
    BOX_DIFFICULTY,
    CAMPAIGN_COMPLEXITY,
    CHECKPOINT_STATIONS,
    LINE_STATIONS,
    SCAN_TYPES,
    empty,
    quoted,
    with_optional,
)
from flowmetrics.session import settle

BOX = ["campana", "box_id"]
DIFFICULTY_FEATURES = ("n_skus_en_caja", "n_categorias_en_caja", "cambios_de_row", "n_filas_distintas")
SEQUENCE_BLOCK = 10_000


def _selected(events: DataFrame, stations: Iterable[str] | None) -> DataFrame:
    return events if stations is None else station_subset(events, stations)


def _pick_order(scans: DataFrame) -> tuple[list[Column], Column]:
    """Order of the picks of a box, and the block of that order used to split very long boxes."""
    extra = [F.col(c) for c in ("time", "event_id") if c in scans.columns]
    if "consecutivo" in scans.columns:
        number = F.col("consecutivo").try_cast("long")
        return [number, F.col("consecutivo"), *extra, F.col("row")], F.floor(number / SEQUENCE_BLOCK)
    return [*extra, F.col("row")], F.floor(F.unix_seconds(F.col("time").cast("timestamp")) / 3600)


def row_changes(scans: DataFrame, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Mark each pick with ``_change`` = 1 if its shelf row differs from that of the pick before it.

    Two missing rows count as different; the first pick of a box is no change.
    """
    order, block = _pick_order(scans)
    linked = previous_row(scans, BOX, order, ["row"], block, "_previous", hot_rows)
    same = F.coalesce(F.col("row") == F.col("_previous.row"), F.lit(False))
    changed = F.when(F.col("_previous").isNotNull() & ~same, 1).otherwise(0)
    return linked.withColumn("_change", changed).drop("_previous")


def box_difficulty(events: DataFrame, stations: Iterable[str] | None = None) -> DataFrame:
    """Per campaign and box, from pick events: distinct SKUs, categories and rows, and row changes."""
    if not {"type", "box_id"} <= set(events.columns):
        return empty(events.sparkSession, BOX_DIFFICULTY)
    scans = known_keys(scan_events(_selected(events, stations)), BOX)
    scans = with_optional(scans, {"sku": "string", "categoria": "string", "row": "string"})
    return (
        row_changes(scans)
        .groupBy(*BOX)
        .agg(
            F.count_distinct("sku").alias("n_skus_en_caja"),
            F.count_distinct("categoria").alias("n_categorias_en_caja"),
            F.sum("_change").alias("cambios_de_row"),
            F.count_distinct("row").alias("n_filas_distintas"),
        )
        .withColumn("box_id", F.col("box_id").cast("string"))
    )


def concentration(df: DataFrame, by: Sequence[str], col: str, entropy: str, hhi: str) -> DataFrame:
    """Shannon entropy (base 2) and Herfindahl index of the value shares of ``col`` per group.

    Repeats are counted before the group is formed. With n_i rows per value and n in all, the entropy is
    log2(n) - sum(n_i*log2(n_i))/n. A group without any value has no row.
    """
    counts = df.where(quoted(col).isNotNull()).groupBy(*[quoted(c) for c in by], quoted(col)).agg(
        F.count("*").cast("double").alias("_n")
    )
    n = F.sum("_n")
    information = F.log2(n) - F.sum(F.col("_n") * F.log2("_n")) / n
    return counts.groupBy(*[quoted(c) for c in by]).agg(
        F.when(F.count("*") == 1, 0.0).otherwise(information).alias(entropy),
        (F.sum(F.col("_n") * F.col("_n")) / (n * n)).alias(hhi),
    )


def campaign_complexity(events: DataFrame, stations: Iterable[str] | None = None) -> DataFrame:
    """Per campaign, from pick events: distinct SKUs, materials and categories, SKU entropy and
    concentration, and the median number of SKUs per box."""
    if not {"type", "campana"} <= set(events.columns):
        return empty(events.sparkSession, CAMPAIGN_COMPLEXITY)
    scans = known_keys(scan_events(_selected(events, stations)), ["campana"])
    scans = with_optional(scans, {"sku": "string", "material": "string", "categoria": "string"})
    distinct = scans.groupBy("campana").agg(
        F.count_distinct("sku").alias("n_skus_distintos"),
        F.count_distinct("material").alias("n_materiales_distintos"),
        F.count_distinct("categoria").alias("n_categorias_distintas"),
    )
    mixed = concentration(scans, ["campana"], "sku", "entropia_sku", "hhi_sku")
    result = distinct.join(mixed, "campana", "left")
    if "box_id" in events.columns:
        per_box = known_keys(scans, ["box_id"]).groupBy(*BOX).agg(F.count_distinct("sku").alias("_skus"))
        result = result.join(quantiles(per_box, ["campana"], {"skus_por_caja_mediana": ("_skus", 0.5)}), "campana", "left")
    else:
        result = with_optional(result, {"skus_por_caja_mediana": "double"})
    return result.select(*CAMPAIGN_COMPLEXITY.fieldNames())


def station_features(difficulty: DataFrame, station_map: DataFrame) -> DataFrame:
    """Median categories and rows per campaign and line station; boxes are matched by ``box_id`` alone.

    The stations of a box travel as bits, and equal boxes are counted before they are told apart by station.
    """
    bit = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(LINE_STATIONS) for x in (c, 1 << i)]), F.col("tipo_estacion"))
    visited = line_stations_only(station_map.select("box_id", "tipo_estacion")).groupBy("box_id").agg(F.bit_or(bit).alias("_at"))
    values = ["n_categorias_en_caja", "n_filas_distintas"]
    counted = known_keys(difficulty.join(visited, "box_id"), ["campana"]).groupBy("campana", "_at", *values).agg(F.count("*").alias("_boxes"))
    stations = F.array_compact(F.array(*[F.when(F.col("_at").bitwiseAND(1 << i) != 0, F.lit(c)) for i, c in enumerate(LINE_STATIONS)]))
    return quantiles(
        counted.select("campana", *values, "_boxes", F.explode(stations).alias("tipo_estacion")),
        ["campana", "tipo_estacion"],
        {"n_categorias_mediana": ("n_categorias_en_caja", 0.5), "n_filas_mediana": ("n_filas_distintas", 0.5)},
        "_boxes",
    )


def first_checkpoints(base: DataFrame) -> DataFrame:
    """Per box, the first scan at Calidad (``t_cal``) and at Pre-Calidad (``t_pc``)."""
    at = lambda name: F.min(F.when(F.col("tipo_estacion") == name, F.col("init_scan")))
    checkpoints = base.where(F.col("tipo_estacion").isin(*CHECKPOINT_STATIONS))
    return known_keys(checkpoints, ["box_id"]).groupBy("box_id").agg(
        at("Calidad").alias("t_cal"), at("Pre-Calidad").alias("t_pc")
    )


def checkpoint_units(base: DataFrame) -> DataFrame:
    """Per box and checkpoint, ``denom_tramo``: line picks of the stretch that enters the checkpoint.

    Pre-Calidad takes the line scans before the first Pre-Calidad scan, Calidad those after it (or any)
    and before the first Calidad scan.
    """
    lines = known_keys(base.where(F.col("tipo_estacion").isin(*LINE_STATIONS)), ["box_id"]).select(
        "box_id", "init_scan", "picks"
    )
    timed = lines.join(first_checkpoints(base), "box_id")
    at, t_cal, t_pc = F.col("init_scan"), F.col("t_cal"), F.col("t_pc")
    after_pc = F.when(t_pc.isNull(), at > F.lit("1970-01-01").cast("timestamp_ntz")).otherwise(at > t_pc)
    sums = timed.groupBy("box_id").agg(
        F.sum(F.when(at < t_pc, F.col("picks"))).alias("Pre-Calidad"),
        F.sum(F.when(after_pc & (at < t_cal), F.col("picks"))).alias("Calidad"),
    )
    return sums.unpivot(["box_id"], ["Pre-Calidad", "Calidad"], "tipo_estacion", "denom_tramo").where(
        F.col("denom_tramo").isNotNull()
    )


def genuine_time_per_pick(base: DataFrame, clean: DataFrame) -> DataFrame:
    """Checkpoint seconds divided by the line units that entered it, NULL where there are none."""
    visits = clean.where(F.col("tipo_estacion").isin(*CHECKPOINT_STATIONS)).select(
        "box_id", "campana", "tipo_estacion", "tiempo_total_seg"
    )
    matched = visits.join(checkpoint_units(base), ["box_id", "tipo_estacion"], "left")
    units = F.nullif(F.col("denom_tramo"), F.lit(0))
    return matched.select(
        "campana",
        "box_id",
        "tipo_estacion",
        ratio(F.col("tiempo_total_seg"), units).alias("tpp_genuino"),
        units.alias("denom_tramo"),
    )


def box_time_per_pick(events: DataFrame) -> DataFrame:
    """Per box opened and closed: seconds open, picks and seconds per pick, and its campaign: that of its
    first event that has one, the smaller name in a tie."""
    at, kind = F.col("time"), F.col("type")
    parts = known_keys(events, ["box_id"]).groupBy("box_id", "campana").agg(
        F.min(at).alias("_start"),
        F.min(F.when(kind == "box_open", at)).alias("_open"),
        F.max(F.when(kind == "box_close", at)).alias("_close"),
        F.count(F.when(kind.isin(*SCAN_TYPES), 1)).alias("_picks"),
    )
    boxes = parts.groupBy("box_id").agg(
        F.min_by("campana", F.when(F.col("campana").isNotNull(), F.struct("_start", "campana"))).alias("campana"),
        F.min("_open").alias("t_open"),
        F.max("_close").alias("t_close"),
        F.sum("_picks").alias("n_picks"),
    ).where(F.col("t_open").isNotNull() & F.col("t_close").isNotNull())
    timed = boxes.withColumn("seg_caja", seconds_between("t_open", "t_close"))
    usable = (F.col("n_picks") > 0) & (F.col("seg_caja") > 0)
    return timed.select(
        "campana",
        "box_id",
        F.when(usable, ratio(F.col("seg_caja"), F.col("n_picks"))).alias("tiempo_por_pick"),
        "seg_caja",
        "n_picks",
    )


def rank_correlation(df: DataFrame, by: Sequence[str], x: str, y: str, min_pairs: int = 10) -> DataFrame:
    """Spearman correlation per group from tie-averaged ranks: ``r`` and ``n``, small groups left out."""
    pairs = df.where(quoted(x).isNotNull() & quoted(y).isNotNull()).select(*by, x, y)
    ranked = average_rank(pairs, by, {x: "_rx", y: "_ry"})
    return ranked.groupBy(*by).agg(
        F.corr("_rx", "_ry").alias("r"), F.count("*").alias("n")
    ).where(F.col("n") >= min_pairs)


def difficulty_correlation(
    difficulty: DataFrame, events: DataFrame, by_client: bool = True, tpp_max: float = 600.0
) -> DataFrame:
    """Rank correlation of each difficulty feature with the seconds per pick of the box.

    One row per feature for all boxes (``scope`` = global) and per client: r, p value, stars and n.
    Boxes are matched by ``box_id`` alone. The matched boxes, far fewer than the events, are settled, as
    the ranks read them five times.
    """
    pace = box_time_per_pick(events).select("box_id", "tiempo_por_pick")
    boxes = bounded_metric(difficulty.join(pace, "box_id"), "tiempo_por_pick", tpp_max)
    scopes = F.array(F.lit("global"))
    if by_client and "campana" in difficulty.columns:
        boxes = boxes.join(client_map(events).select("campana", "cliente"), "campana", "left")
        scopes = F.array_compact(F.array(F.lit("global"), F.col("cliente")))
    features = [c for c in DIFFICULTY_FEATURES if c in difficulty.columns]
    boxes = settle(boxes.select("tiempo_por_pick", scopes.alias("_scopes"), *features))
    values = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("valor")) for c in features])
    long = boxes.select("tiempo_por_pick", F.explode("_scopes").alias("scope"), values.alias("_values")).select(
        "tiempo_por_pick", "scope", F.inline("_values")
    )
    found = rank_correlation(long, ["scope", "feature"], "valor", "tiempo_por_pick")
    tested = found.withColumn("_p", correlation_p_value(F.col("r"), F.col("n")))
    return tested.select(
        "feature",
        "scope",
        F.bround("r", 3).alias("r"),
        F.bround("_p", 4).alias("p_value"),
        significance_stars(F.col("_p")).alias("sig"),
        "n",
    )
