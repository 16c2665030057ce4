"""Training of classifier heads: losses and gradients are summed over the rows by Spark, one
small update by step is made on the driver.

A head is a chain of linear layers with rectifiers between them, (768, 256, 8) for
instance; its input are pooled features or embeddings. A step is one job: each task runs
the head forwards and backwards over its rows in blocks and leaves one array, the sums of the
losses and of the gradient; arrays are added in a tree. What reaches the driver is of the size of the
weights, never of the data. Rows are dealt to the steps of an epoch by a hash, once, as
partitions of a written table, so a step reads its own rows only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recitary.sources.scratch import folder

from .models import Weights, load_weights, save_weights
from .partial import block_of, sum_tree

EPOCHS = "epoch int, train_loss double, valid_loss double, accuracy double, rate double, best boolean"
#: Rows that a task runs through the head at once.
ROWS = 4096


def new_head(layers: tuple[int, ...], seed: int = 42) -> Weights:
    """Weights `k.weight` and `k.bias`, drawn evenly within 1 / sqrt(inputs)."""
    rng, w = np.random.default_rng(seed), {}
    for k, (inn, out) in enumerate(zip(layers, layers[1:], strict=False)):
        w[f"{k}.weight"] = rng.uniform(-1, 1, (out, inn)) / np.sqrt(inn)
        w[f"{k}.bias"] = rng.uniform(-1, 1, out) / np.sqrt(inn)
    return w


def scores(x: np.ndarray, w: Weights) -> list[np.ndarray]:
    """The input of each layer, and the scores."""
    out, k = [x], 0
    while f"{k}.weight" in w:
        y = out[-1] @ w[f"{k}.weight"].T + w[f"{k}.bias"]
        k += 1
        out.append(np.maximum(y, 0) if f"{k}.weight" in w else y)
    return out


def loss_and_gradient(x: np.ndarray, label: np.ndarray, w: Weights, gradient: bool = True) -> tuple[float, int, Weights]:
    """The sum of the cross-entropies, the number of right answers, and the sum of the gradients."""
    held = scores(x, w)
    z = held[-1] - held[-1].max(1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    rows = np.arange(len(x))
    loss, right = float(-np.log(p[rows, label]).sum()), int((held[-1].argmax(1) == label).sum())
    out: Weights = {}
    if gradient:
        p[rows, label] -= 1
        back = p
        for k in range(len(held) - 2, -1, -1):
            out[f"{k}.weight"], out[f"{k}.bias"] = back.T @ held[k], back.sum(0)
            back = (back @ w[f"{k}.weight"]) * (held[k] > 0) if k else back
    return loss, right, out


def _names(w: Weights) -> list[str]:
    return sorted(w)


def _flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in _names(w)])


def _shaped(v: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in _names(like):
        out[k] = v[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def summed(rows: DataFrame, w: Weights, gradient: bool = True) -> tuple[int, float, int, Weights]:
    """rows: features (array<double>) and label. Number of rows, sums of losses and right answers, sum of gradients."""
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = sent.value, None
        width = own["0.weight"].shape[1]
        for b in batches:
            x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            y = b.column("label").to_numpy(zero_copy_only=False)
            for i in range(0, len(x), ROWS):
                loss, right, g = loss_and_gradient(x[i : i + ROWS], y[i : i + ROWS], own, gradient)
                part = np.r_[len(x[i : i + ROWS]), loss, right, _flat(g) if gradient else np.zeros(0)]
                total = part if total is None else total + part
        if total is not None:
            yield block_of([(total,)])

    got = sum_tree(rows.select("features", "label").mapInArrow(run, "block long, value array<double>")).collect()
    sent.unpersist()
    if not got:
        return 0, 0.0, 0, {}
    v = np.array(got[0]["value"])
    return int(v[0]), float(v[1]), int(v[2]), _shaped(v[3:], w) if gradient else {}


@dataclass
class AdamW:
    """Adam with decay of the weights apart from the gradient; decay 0 is plain Adam."""

    rate: float = 3e-4
    decay: float = 1e-2
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    step: int = 0
    first: Weights = field(default_factory=dict)
    second: Weights = field(default_factory=dict)

    def update(self, w: Weights, g: Weights) -> Weights:
        self.step += 1
        a, b = self.betas
        out = {}
        for k in w:
            self.first[k] = a * self.first.get(k, 0.0) + (1 - a) * g[k]
            self.second[k] = b * self.second.get(k, 0.0) + (1 - b) * g[k] ** 2
            move = self.first[k] / (1 - a**self.step) / (np.sqrt(self.second[k] / (1 - b**self.step)) + self.eps)
            out[k] = w[k] * (1 - self.rate * self.decay) - self.rate * move
        return out


def clipped(g: Weights, most: float = 5.0) -> Weights:
    """The gradient, scaled down to a norm of `most` over all weights."""
    norm = float(np.sqrt(sum((v**2).sum() for v in g.values())))
    return {k: v * min(1.0, most / (norm + 1e-6)) for k, v in g.items()}


@dataclass
class Plateau:
    """Lowers the rate by `factor` once the loss has not fallen by a share of 1e-4 for more than `patience` epochs."""

    factor: float = 0.5
    patience: int = 2
    best: float = float("inf")
    bad: int = 0

    def rate(self, rate: float, loss: float) -> float:
        if loss < self.best * (1 - 1e-4):
            self.best, self.bad = loss, 0
            return rate
        self.bad += 1
        if self.bad > self.patience:
            self.bad = 0
            return rate * self.factor
        return rate


class BestEpoch:
    """The weights of the best epoch so far, below a path. They are written beside it and appear by one rename as
    epoch-NNNNN, after which older ones go: a reader finds whole weights at any time, the last epoch being
    the best, and a run that writes an epoch again finds it there."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self.of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def epochs(self) -> list[int]:
        if not self.files.exists(self.of(self.path)):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(self.of(self.path))]
        return sorted(int(n[6:]) for n in names if n.startswith("epoch-") and n[6:].isdigit())

    def save(self, epoch: int, w: Weights) -> None:
        if epoch not in self.epochs():
            new = f"{self.path}/_new-{uuid.uuid4().hex}"
            save_weights(self.spark, w, new)
            if not self.files.rename(self.of(new), self.of(f"{self.path}/epoch-{epoch:05}")):
                raise OSError(f"{new} was not renamed")
        for old in self.epochs():
            if old < epoch:
                self.files.delete(self.of(f"{self.path}/epoch-{old:05}"), True)

    def load(self) -> tuple[int, Weights]:
        epoch = max(self.epochs())
        return epoch, load_weights(self.spark, f"{self.path}/epoch-{epoch:05}")


def train(
    rows: DataFrame, valid: DataFrame, weights: Weights, path: str, features: str = "features", label: str = "label", epochs: int = 30, steps: int = 1,
    optimiser: AdamW | None = None, plateau: Plateau | None = None, patience: int = 4, clip: float | None = 5.0,
) -> DataFrame:
    """Trains a head from `weights`; those of the epoch with the least loss over `valid` are left below path
    (BestEpoch). A row for each epoch: its mean losses, the share of right answers over `valid`, the rate after it and
    whether it was the best so far. Ends after `patience` epochs that were not.

    steps: updates an epoch, over rows dealt by hash; a step without rows is none. Rows without features or
    label are left out. Without training rows the weights stay as they are, and without rows in `valid`
    its loss is that of the training rows."""
    spark = rows.sparkSession
    clean = lambda df: df.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(F.col(features).cast("array<double>").alias("features"), F.col(label).cast("long").alias("label"))
    held = folder(spark, "training")
    dealt = clean(rows).withColumn("step", F.pmod(F.xxhash64("features", "label"), F.lit(steps)).cast("int"))
    dealt.write.partitionBy("step").parquet(held)
    read = spark.read.schema("features array<double>, label long, step int").parquet(held)
    other = folder(spark, "validation")
    clean(valid).write.parquet(other)
    test = spark.read.schema("features array<double>, label long").parquet(other)
    optimiser, plateau, best, worse, out = optimiser or AdamW(), plateau or Plateau(), BestEpoch(spark, path), 0, []
    w, least = weights, float("inf")
    for epoch in range(1, epochs + 1):
        n_all, loss_all = 0, 0.0
        for step in range(steps):
            n, loss, _, g = summed(read.where(F.col("step") == step), w)
            if n:
                g = {k: v / n for k, v in g.items()}
                w = optimiser.update(w, clipped(g, clip) if clip else g)
                n_all, loss_all = n_all + n, loss_all + loss
        n, loss, right, _ = summed(test, w, gradient=False)
        train_loss = loss_all / n_all if n_all else None
        valid_loss = loss / n if n else train_loss
        better = valid_loss is not None and valid_loss < least
        if valid_loss is not None:
            optimiser.rate = plateau.rate(optimiser.rate, valid_loss)
        out.append((epoch, train_loss, valid_loss, right / n if n else None, optimiser.rate, better))
        if better:
            least, worse = valid_loss, 0
            best.save(epoch, w)
        else:
            worse += 1
            if worse >= patience:
                break
    return spark.createDataFrame(out, EPOCHS)
