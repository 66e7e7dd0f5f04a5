"""Campaign life cycle: named sources to strategies, campaigns, clients and the written report."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from flowmetrics.operators.lifecycle import (
    build_strategies,
    campaign_durations,
    clean_strategies,
    client_averages,
    report_tables,
)
from flowmetrics.sources.tables import load_status, write_report_tables


@dataclass
class LifecycleTables:
    status: DataFrame
    strategies: DataFrame
    campaigns: DataFrame
    clients: DataFrame


def lifecycle_tables(sources: Mapping[str, DataFrame]) -> LifecycleTables:
    """Tables of the life-cycle flow from sources named ``cliente_año``."""
    strategies = clean_strategies(build_strategies(sources))
    campaigns = campaign_durations(strategies)
    return LifecycleTables(load_status(sources), strategies, campaigns, client_averages(campaigns))


def write_report(tables: LifecycleTables, out: str, format: str = "parquet") -> None:
    write_report_tables(*report_tables(tables.campaigns, tables.clients), out, format)
