"""A win classifier over bracket trades."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

FEATURES = ("atr", "rsi", "vol_ratio", "upper_wick_to_body", "lower_wick_to_body")


def chrono_split(trades: DataFrame, share: float = 0.7, least: int = 10, order: tuple[str, ...] = ("ts", "symbol")) -> DataFrame:
    """``trades`` with ``part``: 'train' for the first whole-numbered ``share`` by time, 'test' for the rest; null under ``least`` trades.

    Rows are dealt to tasks by ranges of time and numbered in each; a row's place is that after the rows of earlier
    ranges, whose counts are a row per task.
    """
    dealt = written(trades.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")
    counts = counts.select("_range", before.alias("_before"), F.sum("_rows").over(Window.partitionBy()).alias("_n"))
    ranked = dealt.join(F.broadcast(counts), "_range")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    part = F.when(F.col("_n") >= least, F.when(place <= F.floor(F.col("_n") * share), "train").otherwise("test"))
    return ranked.withColumn("part", part).drop("_range", "_before", "_n")


def fit_win_filter(train: DataFrame, trees: int = 100, depth: int = 3, rate: float = 0.05, seed: int = 42) -> PipelineModel:
    """Boosted trees for a positive result."""
    labelled = train.withColumn("label", (F.col("result") > 0).cast("double"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, labelCol="label", featuresCol="features")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep"), model]).fit(labelled)


def filter_report(test: DataFrame) -> DataFrame:
    """Trades, win rate in percent and net result of all ``test`` rows, and of those with ``prediction`` 1."""
    parts = [("before", test), ("after", test.filter("prediction = 1"))]
    out = None
    for name, df in parts:
        row = df.agg(F.lit(name).alias("stage"), F.count("*").alias("trades"), F.coalesce(F.try_divide(100.0 * F.count_if(F.col("result") > 0), F.count("*")), F.lit(0.0)).alias("win_rate"), F.coalesce(F.sum("result"), F.lit(0.0)).alias("net"))
        out = row if out is None else out.unionByName(row)
    return out
