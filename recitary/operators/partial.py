"""Sums of arrays that tasks have made, added in a tree: models and gradients are re-estimated from them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks whose sums one task of the next level adds.
FAN_IN = 64


def block_of(rows: list[tuple], keys: Sequence[str] = ()) -> pa.RecordBatch:
    """A task's sums, one at least, as rows for sum_tree: (*keys, array) each, under the number of the task."""
    columns = [pa.array([TaskContext.get().partitionId()] * len(rows), pa.int64())]
    for j, _ in enumerate(keys):
        own = [r[j] for r in rows]
        columns.append(pa.array(own, pa.string() if isinstance(own[0], str) else pa.int32()))
    columns.append(pa.array([np.asarray(r[-1], dtype=float) for r in rows], pa.list_(pa.float64())))
    return pa.record_batch(columns, ["block", *keys, "value"])


def sum_tree(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """parts: block, keys and value (array<double>, of one length for a key). (keys, value), the sums. In two
    levels of tasks, each in the order of the blocks, so that a rerun rounds alike."""
    kinds = dict(parts.dtypes)
    schema = ", ".join(["block long", *[f"{k} {kinds[k]}" for k in keys], "value array<double>"])

    def add(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("block").to_numpy(), kind="stable")
        total = None
        for i in order.tolist():
            v = t.column("value")[i].values.to_numpy()
            total = v.copy() if total is None else total + v
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int64()), **{k: t.column(k).slice(0, 1) for k in keys}, "value": pa.array([total], pa.list_(pa.float64()))})

    some = parts.withColumn("__into", F.floor(F.col("block") / FAN_IN)).groupBy("__into", *keys).applyInArrow(add, schema)
    return some.withColumn("__all", F.lit(0)).groupBy("__all", *keys).applyInArrow(add, schema).drop("block")
