"""Content identities of datasets and archive sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scans


def canonical_lines(bars: DataFrame) -> DataFrame:
    """``bars`` with ``line``: time, symbol and values joined by '|', values as decimals of 8 places."""
    values = [F.col(c).cast("decimal(20,8)").cast("string") for c in ("open", "high", "low", "close", "volume")]
    return bars.withColumn("line", F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "symbol", *values))


def dataset_identity(bars: DataFrame, version: str) -> DataFrame:
    """Per symbol ``rows`` and ``dataset_id``: a hash over the month hashes of its lines in order, and the version.

    Only one month of a symbol is put in order at a time, so the identity of any number of bars can be had.
    """
    months = canonical_lines(bars).groupBy("symbol", F.date_trunc("month", "ts").alias("month")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h"))
    root = F.concat(F.lit(f"version={version}\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("month", "h"))), lambda x: x["h"]), "\n"))
    return months.groupBy("symbol").agg(F.sum("n").alias("rows"), F.sha2(root, 256).alias("dataset_id"))


def archive_set_identity(hashes: DataFrame) -> DataFrame:
    """One hash of all files' names and hashes, and how many there are.

    Files are dealt by the first four signs of their name's hash; each deal's lines in order are hashed, then these
    hashes in the order of deals, 65,536 at most.
    """
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "file", "sha256")))
    deals = hashes.groupBy(F.substring(F.sha2("file", 256), 1, 4).alias("deal")).agg(F.count("*").alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("h"))
    root = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("deal", "h"))), lambda x: x["h"]), "\n")
    return deals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.sha2(root, 256).alias("identity"))


def dataset_metadata(bars: DataFrame, version: str, timeframe: str) -> DataFrame:
    """Per symbol: first and last time, rows, timeframe, version and identity."""
    span = bars.groupBy("symbol").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    return span.join(dataset_identity(bars, version), "symbol").withColumns({"timeframe": F.lit(timeframe), "normalization_version": F.lit(version)})


#: Levels of the tree of hashes; the last one has any number of nodes.
_LEVELS = 4


def _hash_of(hashes):  # noqa: ANN001, ANN202
    return F.sha2(F.array_join(hashes, "\n"), 256)


def tree_frontier(bars: DataFrame, before: DataFrame | None = None, run: int = 1_024) -> DataFrame:
    """What identifies any number of bars and lets more be added without reading them again: (symbol, ``level``, ``place``, ``h``).

    Lines in order are leaves, numbered by symbol; each full run of ``run`` nodes has one node a level higher that hashes
    it. Kept are the nodes whose run isn't full: fewer than ``run`` a level, but for the highest. ``before`` is the frontier of bars
    that all come earlier. Nodes meet by their run, so no task holds more than ``run`` hashes.
    """
    lines = canonical_lines(bars).select("symbol", "ts", "line")
    leaves = scans.number_runs(lines, ["symbol"], "line", scans.time_block("ts", "1 hour"), "true", [], "_r", "place").select("symbol", "place", F.sha2("line", 256).alias("h"))
    if before is not None:
        rows = before.groupBy("symbol").agg(F.sum(F.pow(F.lit(float(run)), "level").cast("bigint")).alias("_rows"))
        leaves = leaves.join(rows, "symbol", "left").select("symbol", (F.col("place") + F.coalesce("_rows", F.lit(0))).alias("place"), "h")
    kept, nodes = [], leaves
    for level in range(_LEVELS):
        if before is not None:
            nodes = nodes.unionByName(before.filter(F.col("level") == level).select("symbol", "place", "h"))
        group = nodes.groupBy("symbol", F.floor(F.col("place") / run).alias("_up")).agg(F.array_sort(F.collect_list(F.struct("place", "h"))).alias("own"))
        part = group.filter(F.size("own") < run).select("symbol", F.explode("own").alias("x"))
        kept.append(part.select("symbol", F.lit(level).alias("level"), "x.place", "x.h"))
        nodes = group.filter(F.size("own") == run).select("symbol", F.col("_up").alias("place"), _hash_of(F.transform("own", lambda x: x["h"])).alias("h"))
    if before is not None:
        nodes = nodes.unionByName(before.filter(F.col("level") == _LEVELS).select("symbol", "place", "h"))
    return reduce(DataFrame.unionByName, [*kept, nodes.select("symbol", F.lit(_LEVELS).alias("level"), "place", "h")])


def tree_identity(frontier: DataFrame, version: str, run: int = 1_024) -> DataFrame:
    """Per symbol of a frontier ``rows`` and ``dataset_id``: the root of its tree, the same however often bars were added."""
    every = F.array_sort(F.collect_list(F.struct("level", "place", "h")))
    df = frontier.groupBy("symbol").agg(F.sum(F.pow(F.lit(float(run)), "level").cast("bigint")).alias("rows"), every.alias("_nodes"))
    # level by level, the nodes of the open run and the one that the levels below add up to
    df = df.withColumn("_h", F.lit(None).cast("string"))
    for level in range(_LEVELS + 1):
        own = F.transform(F.filter("_nodes", lambda x: x["level"] == level), lambda x: x["h"])  # noqa: B023
        both = F.array_compact(F.concat(own, F.array("_h")))
        alone = F.ceil(F.col("rows") / F.pow(F.lit(float(run)), F.lit(level))) <= 1
        df = df.withColumn("_h", F.when(F.size(both) == 0, F.lit(None)).when(alone, both[0]).otherwise(_hash_of(both)))
    return df.select("symbol", "rows", F.sha2(F.concat_ws("\n", F.lit(f"version={version}"), F.col("rows").cast("string"), "_h"), 256).alias("dataset_id"))
