"""Streams of field snapshots: running time means, and whole analyses of each batch of snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_time_mean(cells: DataFrame, fields: list[str]) -> DataFrame:
    """(idepth, ilat, ilon, <f>_time_average, n) of a streaming table of cells; in complete or update mode each cell keeps a sum and a count."""
    return cells.groupBy("idepth", "ilat", "ilon").agg(*[F.avg(f).alias(f"{f}_time_average") for f in fields], F.count("*").alias("n"))


def windowed_time_mean(cells: DataFrame, fields: list[str], time: str, width: str, late: str) -> DataFrame:
    """(start, idepth, ilat, ilon, <f>_time_average, n) by windows of the timestamp column `time`; snapshots that come more than `late` behind the newest are left out, so that state stays bounded."""
    df = cells.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "idepth", "ilat", "ilon")
    means = df.agg(*[F.avg(f).alias(f"{f}_time_average") for f in fields], F.count("*").alias("n"))
    return means.select(F.col("w.start").alias("start"), "idepth", "ilat", "ilon", *[f"{f}_time_average" for f in fields], "n")


def analysed(cells: DataFrame, analysis: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes analysis(batch) of every batch of complete slices below path, one folder a batch.

    Analyses of slices do not depend on each other, so that a batch is as good as the whole. A batch that is repeated after a failure overwrites its own folder.
    """

    def one(batch: DataFrame, number: int) -> None:
        out = analysis(batch).write.mode("overwrite")
        out.parquet(f"{path}/batch={number}")

    return cells.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
