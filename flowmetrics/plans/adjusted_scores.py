"""Difficulty-adjusted scores from raw events and the picking tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowmetrics.operators.adjust import adjusted_zscore_campaign, adjusted_zscore_station
from flowmetrics.operators.difficulty import box_difficulty, campaign_complexity, station_features
from flowmetrics.operators.picking import campaign_station_median
from flowmetrics.operators.stats import contextual_zscore
from flowmetrics.schemas import LINE_STATIONS
from flowmetrics.session import settle


def campaign_reference(clean: DataFrame) -> DataFrame:
    """Median seconds per pick of each campaign and its score within the client."""
    medians = settle(campaign_station_median(clean, ["campana", "cliente"])).withColumnRenamed("mediana_tpp", "mediana_seg_pick")
    return contextual_zscore(medians, ["cliente"], "mediana_seg_pick").drop("categoria", "categoria_orden")


def station_reference(clean: DataFrame) -> DataFrame:
    """Median seconds per pick of each campaign and station and its score within client and station."""
    medians = settle(campaign_station_median(clean, ["campana", "cliente", "tipo_estacion"]))
    return contextual_zscore(medians).drop("categoria", "categoria_orden")


def adjusted_campaign_scores(events: DataFrame, clean: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    return adjusted_zscore_campaign(campaign_complexity(events), campaign_reference(clean), **options)


def adjusted_station_scores(events: DataFrame, clean: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    features = station_features(box_difficulty(events, LINE_STATIONS), clean)
    return adjusted_zscore_station(features, station_reference(clean), **options)
