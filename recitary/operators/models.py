"""Inference of the sequence models in numpy, and losses: no deep-learning framework is
needed to run weights that come from elsewhere. Weights are a dict of arrays, named by
layer; dropout and masking of inputs belong to training and are absent here.

Arrays are (..., time, channels): utterances of one length are scored together, so nothing is
padded and none has an effect on another. Models go to the executors as one broadcast; their size is that of
the weights, never of the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sequence import LAYERS, once

Weights = dict[str, np.ndarray]


def _sub(w: Weights, prefix: str) -> Weights:
    return {k[len(prefix) + 1 :]: v for k, v in w.items() if k.startswith(prefix + ".")}


def linear(x: np.ndarray, w: Weights) -> np.ndarray:
    return x @ w["weight"].T + w["bias"]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def swish(x: np.ndarray) -> np.ndarray:
    return x * sigmoid(x)


_erf = np.vectorize(math.erf, otypes=[float])


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + _erf(x / math.sqrt(2)))


def layer_norm(x: np.ndarray, w: Weights, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps) * w["weight"] + w["bias"]


def batch_norm(x: np.ndarray, w: Weights, eps: float = 1e-5) -> np.ndarray:
    """Over the last axis, with the stored statistics."""
    return (x - w["mean"]) / np.sqrt(w["var"] + eps) * w["weight"] + w["bias"]


def conv1d(x: np.ndarray, w: Weights, stride: int = 1, pad: int = 0, depthwise: bool = False) -> np.ndarray:
    """x: (..., time, channels); weight: (out, in, kernel), or (channels, 1, kernel) if depthwise."""
    kernel = w["weight"].shape[-1]
    x = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(pad, pad), (0, 0)])
    n = (x.shape[-2] - kernel) // stride + 1
    if n < 1:
        return np.zeros((*x.shape[:-2], 0, w["weight"].shape[0]))
    windows = np.lib.stride_tricks.sliding_window_view(x, kernel, axis=-2)[..., ::stride, :, :][..., :n, :, :]
    return np.einsum("...tck,ck->...tc" if depthwise else "...tck,ock->...to", windows, w["weight"][:, 0] if depthwise else w["weight"]) + w["bias"]


def lstm(x: np.ndarray, w: Weights) -> np.ndarray:
    """One direction; gates are stacked as input, forget, cell, output."""
    size = w["hidden"].shape[1]
    h, c, out = np.zeros((*x.shape[:-2], size)), np.zeros((*x.shape[:-2], size)), np.empty((*x.shape[:-1], size))
    fed = x @ w["input"].T + w["bias"]
    for t in range(x.shape[-2]):
        i, f, g, o = np.split(fed[..., t, :] + h @ w["hidden"].T, 4, axis=-1)
        c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
        h = sigmoid(o) * np.tanh(c)
        out[..., t, :] = h
    return out


def bi_lstm(x: np.ndarray, w: Weights) -> np.ndarray:
    """Layers 0.. of both directions, side by side."""
    k = 0
    while f"{k}.forward.bias" in w:
        x = np.concatenate([lstm(x, _sub(w, f"{k}.forward")), lstm(x[..., ::-1, :], _sub(w, f"{k}.backward"))[..., ::-1, :]], axis=-1)
        k += 1
    return x


def attention(x: np.ndarray, w: Weights, heads: int) -> np.ndarray:
    *many, t, d = x.shape
    q, k, v = (linear(x, _sub(w, n)).reshape(*many, t, heads, d // heads).swapaxes(-2, -3) for n in ("query", "key", "value"))
    score = q @ k.swapaxes(-1, -2) / math.sqrt(d // heads)
    score = np.exp(score - score.max(-1, keepdims=True))
    mixed = (score / score.sum(-1, keepdims=True)) @ v
    return linear(mixed.swapaxes(-2, -3).reshape(*many, t, d), _sub(w, "out"))


def half_step(x: np.ndarray, w: Weights) -> np.ndarray:
    return x + 0.5 * linear(swish(linear(layer_norm(x, _sub(w, "norm")), _sub(w, "up"))), _sub(w, "down"))


def gated_convolution(x: np.ndarray, w: Weights) -> np.ndarray:
    a, gate = np.split(linear(layer_norm(x, _sub(w, "norm")), _sub(w, "up")), 2, axis=-1)
    y = conv1d(a * sigmoid(gate), _sub(w, "depth"), pad=w["depth.weight"].shape[-1] // 2, depthwise=True)
    return x + linear(swish(batch_norm(y, _sub(w, "batch"))), _sub(w, "down"))


def conformer_block(x: np.ndarray, w: Weights, heads: int = 4) -> np.ndarray:
    x = half_step(x, _sub(w, "first"))
    x = x + attention(layer_norm(x, _sub(w, "attention.norm")), _sub(w, "attention"), heads)
    x = gated_convolution(x, _sub(w, "convolution"))
    return layer_norm(half_step(x, _sub(w, "second")), _sub(w, "norm"))


def cnn_bilstm(signal: np.ndarray, w: Weights) -> np.ndarray:
    """Waveform to frame scores: four strided convolutions, a bidirectional chain, a classifier."""
    x = np.asarray(signal, dtype=float)[..., None]
    for k, (_, stride, pad) in enumerate(LAYERS):
        x = gelu(batch_norm(conv1d(x, _sub(w, f"front.{k}"), stride, pad), _sub(w, f"front.{k}.batch")))
    return linear(bi_lstm(x, _sub(w, "lstm")), _sub(w, "classifier"))


def feature_bilstm(features: np.ndarray, w: Weights) -> np.ndarray:
    return linear(bi_lstm(np.asarray(features, dtype=float), _sub(w, "lstm")), _sub(w, "classifier"))


def conformer(features: np.ndarray, w: Weights, heads: int = 4) -> np.ndarray:
    """Encoder frames to frame scores: projection, blocks 0.., classifier."""
    x, k = linear(np.asarray(features, dtype=float), _sub(w, "project")), 0
    while f"block.{k}.norm.weight" in w:
        x = conformer_block(x, _sub(w, f"block.{k}"), heads)
        k += 1
    return linear(x, _sub(w, "classifier"))


def pooled_classifier(features: np.ndarray, w: Weights) -> np.ndarray:
    """Mean over frames, one hidden layer, class scores."""
    return linear(np.maximum(linear(np.asarray(features, dtype=float).mean(-2), _sub(w, "hidden")), 0), _sub(w, "classifier"))


#: Numbers of input that a model gets at once.
INPUTS = 1 << 22


def scored(rows: list, model: Callable[[np.ndarray, Weights], np.ndarray], w: Weights) -> list[np.ndarray]:
    """The model's output for each row (nested lists, of whatever lengths): rows of one length go through it together."""
    arrays = [np.stack([np.asarray(f, dtype=float) for f in v]) if len(v) and np.ndim(v[0]) else np.asarray(v, dtype=float) for v in rows]
    by: dict[tuple, list[int]] = {}
    for k, x in enumerate(arrays):
        by.setdefault(x.shape, []).append(k)
    out: list = [None] * len(arrays)
    for shape, own in by.items():
        step = max(1, INPUTS // max(1, math.prod(shape)))
        for i in range(0, len(own), step):
            for k, y in zip(own[i : i + step], model(np.stack([arrays[k] for k in own[i : i + step]]), w), strict=True):
                out[k] = y
    return out


def frame_ids(df: DataFrame, key: str, value: str, model: Callable[[np.ndarray, Weights], np.ndarray], weights: Weights) -> DataFrame:
    """(key, t, id): each frame's best class under the model."""
    own = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            ids = [y.argmax(1) for y in scored(list(x[value]), model, own.value)]
            yield pd.DataFrame({key: x[key].repeat([len(i) for i in ids]).to_numpy(), "t": np.concatenate([np.arange(len(i)) for i in ids]) if ids else [], "id": np.concatenate(ids) if ids else []})

    return df.select(key, value).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, t int, id int")


def outputs(df: DataFrame, key: str, value: str, model: Callable[[np.ndarray, Weights], np.ndarray], weights: Weights) -> DataFrame:
    """(key, t, y): each frame's output under the model; one row with t = 0 where it gives one vector for all frames."""
    own = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            got = [np.atleast_2d(y) for y in scored(list(x[value]), model, own.value)]
            rows = [(k, t, v.tolist()) for k, y in zip(x[key], got, strict=True) for t, v in enumerate(y)]
            yield pd.DataFrame(rows, columns=[key, "t", "y"])

    return df.select(key, value).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, t int, y array<double>")


def save_weights(spark: SparkSession, weights: dict, path: str) -> None:
    """Weights as a table: name, shape and the values in row order."""
    rows = [(k, list(np.shape(v)), np.asarray(v, dtype=float).ravel().tolist()) for k, v in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").write.mode("overwrite").parquet(path)


def weight_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, shape array<int>, values array<double>").parquet(path)


#: Numbers that load_weights takes, 2 GB: the largest models here have some 100 million.
MOST_WEIGHTS = 1 << 28


def load_weights(spark: SparkSession, path: str) -> Weights:
    """A model's weights on the driver: they are broadcast whole to score, so they fit there. Counted before they are read."""
    table = weight_rows(spark, path)
    n = table.agg(F.sum(F.size("values"))).first()[0] or 0
    if n > MOST_WEIGHTS:
        raise ValueError(f"{path} holds {n} numbers, more than {MOST_WEIGHTS}")
    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in table.toLocalIterator()}


def ctc_loss(log_probs: np.ndarray, targets: list[int], blank: int = 0) -> float:
    """Negative log likelihood of the targets over all alignments; 0 where none exists."""
    ext = [blank]
    for t in targets:
        ext += [t, blank]
    n = len(ext)
    ids = np.array(ext)
    skip = np.r_[False, False, (ids[2:] != blank) & (ids[2:] != ids[:-2])][:n]
    a = np.full(n, -np.inf)
    a[:2] = log_probs[0, ids[:2]]
    for row in log_probs[1:]:
        one, two = np.r_[-np.inf, a[:-1]], np.r_[-np.inf, -np.inf, a[:-2]][:n]
        a = np.logaddexp(np.logaddexp(a, one), np.where(skip, two, -np.inf)) + row[ids]
    total = np.logaddexp(a[-1], a[-2] if n > 1 else -np.inf)
    return float(-total) if np.isfinite(total) else 0.0


def ctc_losses(scores: Column, targets: Column, blank: int = 0) -> Column:
    """Arrow UDF: frame scores (array<array<double>>) and target ids to the loss."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            out = []
            for s, t in zip(x, y, strict=True):
                z = np.stack([np.asarray(f, dtype=float) for f in s])
                z = z - z.max(1, keepdims=True)
                out.append(ctc_loss(z - np.log(np.exp(z).sum(1, keepdims=True)), list(t), blank))
            yield pd.Series(out, dtype="float64")

    return run(scores, targets)


def cross_entropy(scores: Column, label: Column) -> Column:
    """Native: minus the log share of the label's class."""
    loss = lambda top: F.log(F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top))) - (F.get(scores, label) - top)
    return once(F.array_max(scores), loss)


def classifier(train: DataFrame, features: str = "features", label: str = "label", layers=(768, 256, 8), seed: int = 42):
    """A trained pipeline over given embeddings (array<float>): its hidden layer is logistic."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    rows = train.select(array_to_vector(F.col(features)).alias("vector"), F.col(label).cast("double").alias(label))
    net = MultilayerPerceptronClassifier(featuresCol="vector", labelCol=label, layers=list(layers), seed=seed, maxIter=60)
    return Pipeline(stages=[net]).fit(rows)


def classify(model, df: DataFrame, features: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return model.transform(df.withColumn("vector", array_to_vector(F.col(features)))).drop("vector", "rawPrediction", "probability")
