"""The event study from bars to returns per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.event_study import compound, run_events, stress_grid
from ..operators.segments import continuous_segments
from ..operators.signals import evaluate_grid
from .fixtures import daily_bars

#: A shock in volume with a rise, on weekly bars; the registered thresholds are for hourly prices.
WEEKLY_SHOCK = {"volume_lookback": [24], "shock": [1.1, 1.2], "return_threshold": [0.05, 0.1]}


def volume_shock_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, mean and compound return by symbol, cell, cost case and delay."""
    seg = continuous_segments(daily_bars(spark, sf_dir, "week"), "7 day")
    events = run_events(evaluate_grid(seg, "hyp0005", WEEKLY_SHOCK), seg, stress_grid(spark))
    out = events.groupBy("symbol", "cell", "cost", "delay").agg(F.count("*").alias("events"), F.round(F.avg("ret"), 6).alias("mean_return"), F.round(compound(), 6).alias("compound_return"))
    return out
