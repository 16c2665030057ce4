"""Array operators take time in proportion to their arrays, and give what plain loops give."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from recitary.operators import align, models, rules, sequence


def seconds(df):
    t = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def test_samples(spark):
    x = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(320_000)), lambda i: F.sin(i.cast("double"))).alias("samples"), F.lit("['ba']").alias("phonemes"))
    got = sequence.training_rows(x)
    assert seconds(got) < 20
    r = spark.createDataFrame([([3.0, -4.0, None], "['ba']"), ([], None), (None, "[]")], "samples array<double>, phonemes string")
    out = [row.signal for row in sequence.training_rows(r).collect()]
    assert out[0] == [pytest.approx(0.75), -1.0, None] and out[2] is None


@pytest.fixture(scope="module")
def utterance(spark):
    rng = np.random.default_rng(0)
    n = 50_000
    segments = [(int(i), int(k)) for i, k in zip(rng.choice([39, 42, 99, 192, 5], n), rng.integers(1, 30, n), strict=True)]
    pairs = [("x", "y", i, i if i % 3 else None) for i in range(n)]
    found = [(i, "tabeei", 2) for i in range(0, n + 10, 2)]
    return spark.createDataFrame([(segments, pairs, found)], "segments array<struct<id:int,frames:bigint>>, pairs array<struct<expected:string,predicted:string,expected_index:int,predicted_index:int>>, rules array<struct<phoneme_index:int,type:string,expected_harakat:int>>")


def test_segments(utterance):
    segments, pairs, found = utterance.first()
    short, long = F.array(F.lit(39), F.lit(42)), F.array(F.lit(192))
    x = utterance.select(
        sequence.observed_harakat(F.col("segments"), short, long).alias("h"), rules.judge_madd(F.col("rules"), F.col("segments"), short=[39, 42]).alias("m"),
        rules.judge_aligned(F.col("rules"), F.col("pairs"), F.col("segments")).alias("a"),
    )
    assert seconds(x) < 30
    r = x.first()
    mean = np.mean([s.frames for s in segments if s.id in (39, 42)])
    assert [(h.segment_index, h.phoneme_id, h.frames) for h in r.h] == [(i, s.id, s.frames) for i, s in enumerate(segments) if s.id == 192]
    assert r.h[7].observed_harakat == pytest.approx(r.h[7].frames / mean)
    assert [m.phoneme_index for m in r.m] == list(range(0, 50_000, 2)) and r.m[3].observed == pytest.approx(round(segments[6].frames / mean, 2), abs=0.011)
    assert [a.phoneme_index for a in r.a] == [i for i in range(0, 50_000, 2) if i % 3]


def test_empty_segments(spark):
    x = spark.createDataFrame([([], [], [(0, "tabeei", 2)])], "segments array<struct<id:int,frames:bigint>>, pairs array<struct<expected:string,predicted:string,expected_index:int,predicted_index:int>>, rules array<struct<phoneme_index:int,type:string,expected_harakat:int>>")
    r = x.select(rules.judge_madd(F.col("rules"), F.col("segments")).alias("m"), rules.judge_aligned(F.col("rules"), F.col("pairs"), F.col("segments")).alias("a"), sequence.observed_harakat(F.col("segments"), F.array(F.lit(1)), F.array(F.lit(2))).alias("h")).first()
    assert r.m == [] and r.a == [] and r.h == []


def test_losses_and_distances(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=20_000)
    x = spark.createDataFrame([(z.tolist(), 7)], "s array<double>, y int").select(models.cross_entropy(F.col("s"), F.col("y")).alias("l"))
    assert seconds(x) < 20 and x.first().l == pytest.approx(np.log(np.exp(z).sum()) - z[7])
    a, b = rng.choice(list("abc"), 3000).tolist(), rng.choice(list("abc"), 2900).tolist()
    d = spark.createDataFrame([(a, b), ([], b), (None, b)], "a array<string>, b array<string>").select(align.edit_distance(F.col("a"), F.col("b")).alias("d"))
    assert seconds(d) < 20 and [r.d for r in d.collect()] == [align.distance_table(a, b)[-1, -1], 2900, None]
