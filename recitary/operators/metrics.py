"""Aggregates over manifests, predictions and epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_groups(df: DataFrame, *cols: str) -> DataFrame:
    """Number of distinct combinations without a null."""
    return df.agg(F.count_distinct(*cols).alias("groups"))


def counters(df: DataFrame, error: Column, *groups: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.count("*").alias("total"), F.count_if(error.isNull()).alias("processed"), F.count_if(error.isNotNull()).alias("errors"))


def total_hours(df: DataFrame, frames: str = "n_frames", rate: str = "rate", error: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    failed = F.count_if(F.col(error).isNotNull()) if error else F.lit(0)
    return df.groupBy(*by).agg((F.sum(F.col(frames) / F.col(rate)) / 3600).alias("hours"), failed.alias("failed"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Long form: one row for each pair that occurs."""
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    return df.groupBy(truth).pivot(predicted, classes).count().na.fill(0)


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def mean_of_batch_means(df: DataFrame, batch: str, value: str, *groups: str) -> DataFrame:
    """The average over batches of each batch's average."""
    return df.groupBy(*groups, batch).agg(F.avg(value).alias("m")).groupBy(*groups).agg(F.avg("m").alias("mean"))


def early_stop(epochs: DataFrame, epoch: str = "epoch", loss: str = "loss", patience: int = 4) -> DataFrame:
    """Each epoch with `best` (a new lowest loss) and `stopped` (patience epochs without one came
    before). Epochs are few, so the unpartitioned window is bounded."""
    w = Window.orderBy(epoch)
    prior = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = epochs.withColumn("best", F.coalesce(F.col(loss) < prior, F.lit(True)))
    since = F.col(epoch) - F.max(F.when(F.col("best"), F.col(epoch))).over(w)
    out = out.withColumn("since", since)
    return out.withColumn("stopped", F.coalesce(F.max("since").over(w.rowsBetween(Window.unboundedPreceding, -1)) >= patience, F.lit(False))).drop("since")


def mean_pool(df: DataFrame, vectors: str, *groups: str) -> DataFrame:
    """Element-wise mean of vectors: one partial aggregate for each element, no row gathered."""
    return df.select(*groups, F.posexplode(vectors).alias("dim", "x")).groupBy(*groups, "dim").agg(F.avg("x").alias("mean"))


def frames_by_token(df: DataFrame, token: str = "token", value: str = "feat", order: str = "t") -> DataFrame:
    return df.groupBy(token).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("frames"))


def enough_frames(df: DataFrame, token: str = "token", least: int = 10) -> DataFrame:
    return df.groupBy(token).agg(F.count("*").alias("n")).where(F.col("n") >= least)
