"""Picking times: operations to clean operations, campaign tables, scores and dead times."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from flowmetrics.operators.deadtime import (
    dead_time_by_destination,
    dead_time_delta,
    judge_gaps,
    link_operations,
    transition_outliers,
    transition_summary,
)
from flowmetrics.operators.picking import (
    base_operations,
    build_operations,
    campaign_station_median,
    campaign_summary,
    efficiency_metrics,
    exclude_campaigns,
    mapped_stations_only,
    positive_picks,
)
from flowmetrics.operators.stats import contextual_zscore, iqr_filter
from flowmetrics.session import settle


@dataclass
class PickingTables:
    clean: DataFrame
    campaigns: DataFrame
    station_scores: DataFrame
    transitions: DataFrame
    transition_deltas: DataFrame
    destinations: DataFrame
    outliers: DataFrame


def clean_operations(ops: DataFrame, excluded: DataFrame | None = None, k: float = 1.5) -> DataFrame:
    """Base columns, mapped stations, picks above 0, no listed campaigns, no IQR outliers, pace metrics."""
    rows = positive_picks(mapped_stations_only(base_operations(ops)))
    if excluded is not None:
        rows = exclude_campaigns(rows, excluded)
    return efficiency_metrics(iqr_filter(rows, k=k))


def station_scores(clean: DataFrame) -> DataFrame:
    """Campaign and station medians, scored against the campaigns of the same client and station.

    The medians, one row per campaign, station, client and year, are settled: four steps read them.
    """
    return contextual_zscore(settle(campaign_station_median(clean)))


def station_transitions(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operations with gaps and reasons, and the settled transition table built from them.

    The link to the previous operation needs the one shuffle of all rows, so it is settled: the
    percentiles, the gaps and the sums then read only the columns they need.
    """
    gaps = judge_gaps(settle(link_operations(ops)))
    return gaps, settle(transition_summary(gaps))


def picking_tables(events: DataFrame, excluded: DataFrame | None = None) -> PickingTables:
    """All tables of the picking flow from raw events; the tables that feed others are settled."""
    clean = settle(clean_operations(settle(build_operations(events)), excluded))
    gaps, transitions = station_transitions(clean)
    return PickingTables(
        clean=clean,
        campaigns=campaign_summary(clean),
        station_scores=station_scores(clean),
        transitions=transitions,
        transition_deltas=dead_time_delta(transitions),
        destinations=dead_time_by_destination(transitions),
        outliers=transition_outliers(gaps),
    )
