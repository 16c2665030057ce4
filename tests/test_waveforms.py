"""Filters, gates, resampling and draws against plain loops; files that are broken; words read once."""

from __future__ import annotations

import hashlib
import json
import math
import pickle
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from recitary.functions import phonemes as P
from recitary.functions.ship import ship
from recitary.operators import models, signal
from recitary.sources import audio


def loop(b, a, x, state):
    z, out = [*state, 0.0], []
    for v in x:
        y = b[0] * v + z[0]
        for k in range(len(z) - 1):
            z[k] = b[k + 1] * v + z[k + 1] - a[k + 1] * y
        out.append(y)
    return np.array(out)


@pytest.mark.parametrize("n", [1, 5, 127, 128, 129, 1000])
def test_scan_is_the_recursion(n):
    rng = np.random.default_rng(n)
    x, state = rng.normal(size=n), rng.normal(size=2)
    for sections in (signal.butterworth(4, (300, 4500), "band", 16000), signal.butterworth(3, 80, "high", 16000), signal.notch(50, 30, 16000)):
        for s in sections:
            assert np.allclose(signal._lfilter(s[:3], s[3:], x, state), loop(s[:3], s[3:], x, state), atol=1e-9)


def test_responses():
    for order in (1, 2, 3, 4):
        for sections, lows in ((signal.butterworth(order, 80, "high", 16000), (80,)), (signal.butterworth(order, (300, 4500), "band", 16000), (300, 4500))):
            w = np.exp(-2j * np.pi * np.array([*lows, 1162.0]) / 16000)
            h = np.abs(np.prod([np.polyval(s[2::-1], w) / np.polyval(s[:2:-1], w) for s in sections], axis=0))
            assert np.allclose(h[:-1], np.sqrt(0.5), atol=1e-6) and h[-1] > 0.99
    assert len(signal.band_pass(np.zeros(1))) == 1 and len(signal.high_pass(np.ones(3))) == 3 and np.abs(signal.high_pass(np.ones(500))).max() < 1e-9


def test_filters_are_quick():
    import time

    t = time.perf_counter()
    signal.band_pass(np.random.default_rng(0).normal(size=1_600_000))
    assert time.perf_counter() - t < 10


def test_gates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    assert np.allclose(signal.istft(signal.stft(x, 64, 16), 64, 16, len(x)), x)
    t = np.arange(16000) / 16000
    noisy = 0.01 * rng.normal(size=16000) + np.where(t > 0.5, np.sin(2 * np.pi * 440 * t), 0)
    for f in (lambda v: signal.stationary_gate(v, noise_seconds=0.3, amount=1.0, size=1024), signal.running_gate, signal.spectral_gate, lambda v: signal.spectral_gate(v, noise_seconds=None)):
        y = f(noisy)
        assert len(y) == len(noisy) and np.std(y[2000:6000]) < 0.6 * np.std(noisy[2000:6000])
    kept = signal.stationary_gate(noisy, noise_seconds=0.3, size=1024)[10000:15000]
    assert np.corrcoef(kept, noisy[10000:15000])[0, 1] > 0.99
    assert (signal.running_gate(np.zeros(2048)) == 0).all() and len(signal.stationary_gate(np.ones(10))) == 10


@pytest.mark.parametrize(("own", "rate"), [(44100, 16000), (8000, 16000), (48000, 16000), (16000, 11025)])
def test_resampling(own, rate):
    x = np.random.default_rng(2).normal(size=200)
    y = signal.resample(x, own, rate)
    g = math.gcd(own, rate)
    old, new = own // g, rate // g
    band = min(old, new) * 0.99
    assert len(y) == math.ceil(200 * rate / own)
    for m in (0, 1, 7, len(y) // 2, len(y) - 1):
        total = 0.0
        for n, v in enumerate(x):
            t = (n / old - m / new) * band
            if abs(t) < 6:
                total += v * band / old * math.cos(t * math.pi / 12) ** 2 * (math.sin(math.pi * t) / (math.pi * t) if t else 1)
        assert y[m] == pytest.approx(total, abs=1e-9)
    assert len(signal.resample(np.zeros(0), own, rate)) == 0 and signal.resample(x, own, own) is x


def test_draws(spark):
    df = spark.range(400).select("id", F.array(*[F.lit(1.0)] * 3).alias("x"))
    u = [r.u for r in df.select("id", signal.uniform(5, F.col("id"), "z").alias("u")).orderBy("id").collect()]
    want = [(int(hashlib.md5(f"5|{i}|z".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in range(400)]
    assert u == want and 0.4 < np.mean(u) < 0.6
    for parts in (1, 7):
        got = {r.id: r.a for r in df.repartition(parts).select("id", signal.augment(F.col("x"), seed=3, key=F.col("id")).alias("a")).collect()}
        if parts == 1:
            first = got
    assert got == first
    plain = sum(a == [1.0] * 3 for a in got.values())
    same = sum(len({round(v, 12) for v in a}) == 1 and a != [1.0] * 3 for a in got.values())
    assert 60 < plain < 140 and 60 < same < 140 and all(0.75 < v < 1.25 for a in got.values() for v in a)


def test_features_of_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(signal.encode_wav(np.sin(np.arange(2 * 44100) / 30), 44100, 2))
    (tmp_path / "short.wav").write_bytes(signal.encode_wav(np.ones(100)))
    (tmp_path / "none.wav").write_bytes(b"x")
    (tmp_path / "empty.wav").write_bytes(b"")  # Spark's reader leaves files without a byte out
    r = {row.path.rsplit("/", 1)[1]: row for row in audio.read_features(spark, str(tmp_path)).collect()}
    assert r["a.wav"].n_samples == 16000 and r["a.wav"].n_frames == len(r["a.wav"].features) and len(r["a.wav"].features[0]) == 39 and r["a.wav"].error is None
    assert r["short.wav"].n_samples == 100 and r["short.wav"].features is None and r["short.wav"].error and r["none.wav"].error and "empty.wav" not in r


def test_clips_of_every_length(spark, tmp_path):
    import duckdb

    from recitary.plans import catalogue

    rng = np.random.default_rng(4)
    rows = [(50 * k + i, rng.normal(0, 0.2, 64).astype(float).tolist()) for k, n in enumerate((1, 19, 20, 21, 25, 31, 32, 50)) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(str, map(tuple, catalogue.QUERIES["features_of_files"](spark, str(tmp_path)).collect())))
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = sorted(map(str, c.sql(catalogue.ORACLES["features_of_files"]).fetchall()))
    assert got == want and len(got) == 3 + 1 + 2 * 39


def test_chain_from_the_shipped_package():
    """As on an executor: nothing of the package but its zip file, by a relative path."""
    from recitary.plans import registry, waveforms

    sent = []
    ship(SimpleNamespace(sparkContext=SimpleNamespace(applicationId="shipped", addPyFile=lambda f: sent.append(Path(f)))))
    others = [p for p in sys.path if p and not (Path(p) / "recitary").exists()]
    code = """import json, pickle, sys
sys.path[:] = json.loads(sys.argv[1])
import numpy
f = pickle.loads(bytes.fromhex(sys.argv[2]))
from recitary.plans import registry
print(json.dumps([registry.__file__, registry.GOLDEN, f(numpy.zeros(1281), 16000).shape]))"""
    argv = [sys.executable, "-I", "-c", code, json.dumps([f"./{sent[0].name}", *others]), pickle.dumps(waveforms._nine_frames).hex()]
    done = subprocess.run(argv, cwd=sent[0].parent, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    where, golden, shape = json.loads(done.stdout)
    assert sent[0].name in where and list(map(tuple, golden)) == registry.GOLDEN and shape == [9, 39]


def test_words_are_read_once(spark):
    rows = [(0, "بَابٌ"), (1, None), (2, "نُور"), (3, "بَابٌ"), (4, "")]
    df = spark.createDataFrame(rows, "k int, word string")
    got = {r.k: (r.tokens, r.error) for r in P.distinct_phonemes(df, "word").collect()}
    want = {r.k: (r.p.tokens, r.p.error) for r in df.select("k", P.phonemes(F.col("word")).alias("p")).collect()}
    assert got == want and len(got) == 5


def test_models_of_many_rows():
    rng = np.random.default_rng(3)
    w = {f"{n}.{p}": rng.normal(size=(4, 4) if p == "weight" else 4) for n in ("query", "key", "value", "out") for p in ("weight", "bias")}
    w |= {f"0.{d}.{k}": rng.normal(size=s) for d in ("forward", "backward") for k, s in (("input", (8, 4)), ("hidden", (8, 2)), ("bias", 8))}
    rows = [rng.normal(size=(n, 4)) for n in (5, 3, 5, 1, 3, 5)]
    for f in (lambda x, w: models.attention(x, w, 2), models.bi_lstm, lambda x, w: models.conv1d(x, {"weight": np.ones((2, 4, 3)), "bias": np.zeros(2)}, 2, 1)):
        for got, x in zip(models.scored([r.tolist() for r in rows], f, w), rows, strict=True):
            assert np.allclose(got, f(x, w))
    assert models.scored([], models.bi_lstm, w) == []
