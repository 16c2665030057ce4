from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from recitary.operators import models, sequence


def lin(rng, prefix, out, inn):
    return {f"{prefix}.weight": rng.normal(0, 0.3, (out, inn)), f"{prefix}.bias": rng.normal(0, 0.1, out)}


def norm(prefix, n, batch=False):
    w = {f"{prefix}.weight": np.ones(n), f"{prefix}.bias": np.zeros(n)}
    return w | ({f"{prefix}.mean": np.zeros(n), f"{prefix}.var": np.ones(n)} if batch else {})


def lstm(rng, prefix, inn, size):
    return {f"{prefix}.{d}.{k}": rng.normal(0, 0.3, s) for d in ("forward", "backward") for k, s in (("input", (4 * size, inn)), ("hidden", (4 * size, size)), ("bias", 4 * size))}


def test_cnn_bilstm_and_query(spark):
    rng, w, inn = np.random.default_rng(0), {}, 1
    for k, (kernel, _, _) in enumerate(sequence.LAYERS):
        out = 3
        w |= {f"front.{k}.weight": rng.normal(0, 0.3, (out, inn, kernel)), f"front.{k}.bias": np.zeros(out)} | norm(f"front.{k}.batch", out, True)
        inn = out
    w |= lstm(rng, "lstm.0", 3, 4) | lstm(rng, "lstm.1", 8, 4) | lin(rng, "classifier", 5, 8)
    x = rng.normal(size=3200)
    y = models.cnn_bilstm(x, w)
    n = spark.range(1).select(sequence.conv_length(F.lit(3200)).alias("n")).first().n
    assert y.shape == (n, 5)
    df = spark.createDataFrame([("u", x.tolist())], "utt string, samples array<double>")
    got = models.frame_ids(df, "utt", "samples", models.cnn_bilstm, w).orderBy("t").collect()
    assert [r.id for r in got] == y.argmax(1).tolist()
    assert models.feature_bilstm(rng.normal(size=(6, 3)), {k: v for k, v in w.items() if not k.startswith("front")}).shape == (6, 5)


def test_conformer():
    rng, d = np.random.default_rng(1), 8
    w = lin(rng, "project", d, 12) | lin(rng, "classifier", 5, d)
    for k in range(2):
        b = {}
        for half in ("first", "second"):
            b |= norm(f"{half}.norm", d) | lin(rng, f"{half}.up", 4 * d, d) | lin(rng, f"{half}.down", d, 4 * d)
        b |= norm("attention.norm", d)
        for n in ("query", "key", "value", "out"):
            b |= lin(rng, f"attention.{n}", d, d)
        b |= norm("convolution.norm", d) | lin(rng, "convolution.up", 2 * d, d) | lin(rng, "convolution.down", d, d) | norm("convolution.batch", d, True)
        b |= {"convolution.depth.weight": rng.normal(size=(d, 1, 31)), "convolution.depth.bias": np.zeros(d)} | norm("norm", d)
        w |= {f"block.{k}.{n}": v for n, v in b.items()}
    y = models.conformer(rng.normal(size=(9, 12)), w)
    assert y.shape == (9, 5) and np.isfinite(y).all()
    assert models.pooled_classifier(rng.normal(size=(9, 6)), lin(rng, "hidden", 4, 6) | lin(rng, "classifier", 3, 4)).shape == (3,)


def test_convolution_against_loops():
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(11, 2)), {"weight": rng.normal(size=(3, 2, 4)), "bias": rng.normal(size=3)}
    p = np.pad(x, ((1, 1), (0, 0)))
    want = [[sum(p[2 * t + k, c] * w["weight"][o, c, k] for c in range(2) for k in range(4)) + w["bias"][o] for o in range(3)] for t in range(5)]
    assert np.allclose(models.conv1d(x, w, 2, 1), want)


@pytest.mark.parametrize("targets", [[1], [1, 1], [1, 2], [], [2, 2, 2]])
def test_ctc_loss_is_the_sum_over_paths(spark, targets):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(4, 3))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)

    def collapse(path):
        return [c for i, c in enumerate(path) if c and (not i or path[i - 1] != c)]

    total = sum(np.prod([p[t, c] for t, c in enumerate(path)]) for path in itertools.product(range(3), repeat=4) if collapse(path) == targets)
    assert models.ctc_loss(np.log(p), targets) == pytest.approx(-np.log(total) if total else 0.0)
    df = spark.createDataFrame([(z.tolist(), targets)], "s array<array<double>>, t array<int>")
    assert df.select(models.ctc_losses(F.col("s"), F.col("t")).alias("x")).first().x == pytest.approx(-np.log(total) if total else 0.0)


def test_classifier(spark):
    rng = np.random.default_rng(4)
    rows = [((rng.normal(size=4) + 3 * (i % 2)).tolist(), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "features array<double>, label int")
    out = models.classify(models.classifier(df, layers=(4, 5, 2)), df)
    assert out.where("prediction = label").count() >= 76
    loss = df.select(models.cross_entropy(F.array(F.lit(0.0), F.lit(1.0)), F.col("label")).alias("x")).first().x
    assert loss == pytest.approx(np.log(1 + np.e))
