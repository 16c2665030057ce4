"""Filter audit, whitening and the mix against plain versions, and their edge cases."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute

from recitary.llm import op11_filter_audit as audit
from recitary.llm import op12_whitening as whitening
from recitary.llm import op13_cube_mix as mix
from recitary.llm.common import Workspace

CLASH = {"part": "x", "mask": 1, "fp": 2, "n": 3, "size": 4, "p": 5, "times": 6, "target": 7, "x": 8, "idx": 9, "__g": 1, "block": 2, "kind": 3}


def clashing(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, 400, n))


# -- 11


def audit_rows():
    rows = [(i, f"s{i % 3}", prose(i % 9, 150 + 10 * (i % 9))) for i in range(40)]
    rows += [(100, None, None), (101, "", ""), (102, "s1", ""), (103, "é", "Ü" * 5 + " A"), (None, "s0", prose(1, 160)), (None, "s0", prose(1, 160)), (5, "s2", prose(5, 200)), (5, "s2", prose(5, 200)), (3, "s1", prose(5, 200))]
    rows += [(200 + i, "hot", "the same text " * 90) for i in range(60)] + [(300, "hot", "long " * 100_000), (301, "hot", "long " * 100_000), (302, "hot", "a # b"), (303, "hot", "HELLO WORLD " * 200)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 320, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def figures(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[f] for f in audit.FIGURES) for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 9])
def test_audit(spark, parts, monkeypatch):
    rows, labels = audit_rows()
    docs = clashing(spark.createDataFrame(rows, "doc_id long, source string, text string")).repartition(parts)
    said = clashing(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    # fingerprints that collide: texts decide
    if parts == 9:
        monkeypatch.setattr(audit.F, "xxhash64", lambda c, f=F.length: f(c).cast("long") % 2)
    assert figures(audit.audit(docs, said)) == brute.audit(rows, labels)


def test_audit_ranges(spark, monkeypatch):
    """One group of copies over all ranges: every boundary lies within it."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(i, "s", "copy") for i in range(500, 0, -1)] + [(i, "t", "copy") for i in range(5)] + [(7, "t", "other"), (700, "t", "other")]
    found = figures(audit.audit(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7), spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == brute.audit(rows, [])


def test_audit_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aA #\t\n\x0b\x1c\xa0é|", max_size=300))
def test_masks(text):
    want = brute.audit([(1, "", text)], [])
    m = audit.mask_of(text)
    assert [want["", "".join(sorted("ABCDE", key=lambda c: c != f)), 1][1] for f in "ABCD"] == [m >> k & 1 for k in range(4)]


# -- 12


def whiten_plain(vectors: dict[int, list], most: int = 32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors.values()], dtype=np.float64)
    n, d = x.shape
    c = x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    s = [sum(int(r[k]) for r in x) for k in range(d)]
    return n, e, c @ u / np.sqrt(np.maximum(e, 1e-300)), [sum((n * int(a) - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]


@pytest.mark.parametrize("parts", [1, 23])
def test_whitening(spark, parts, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 16)
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    rng = np.random.default_rng(1)
    own = (rng.normal(size=(150, 7)) * [3, 2, 1, 0.5, 8, 0.3, 5] + rng.normal(size=7)).tolist()
    own[3] = own[4]
    good = dict(enumerate(own))
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0]), (902, [math.nan] * 7), (903, [math.inf] * 7), (904, [1.0] * 6), (905, []), (906, [1e300] * 7)]
    df = clashing(spark.createDataFrame([*good.items(), *bad], "vec_id long, embedding array<double>")).repartition(parts)
    got = whitening.whiten(df.withColumn("component", F.lit(1)).withColumn("vec", F.lit("x"))).collect()
    n, e, y, deviation = whiten_plain(good)
    assert len(got) == 150 * 7 and {r.component for r in got} == set(range(1, 8)) and {r.n for r in got} == {n}
    z = np.zeros((150, 7))
    for r in got:
        z[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id] and abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9
    assert np.abs(np.abs(z) - np.abs(y)).max() < 1e-6 and {r.identity_error for r in got} == {got[0].identity_error}
    assert got[0].identity_error < 1e-9 and abs(np.abs(z.T @ z / n - np.eye(7)).max() - got[0].identity_error) < 1e-9


def test_whitening_without_variance(spark):
    of = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert of([]).count() == 0 and of([(1, None)]).count() == 0 and of([(1, [1.0, 2.0])]).count() == 0
    assert of([(i, [1.0, 2.0]) for i in range(5)]).count() == 0
    rng = np.random.default_rng(0)
    rows = [(i, [float(a), 3.0, float(b), float(a)]) for i, (a, b) in enumerate(rng.integers(-9, 9, (20, 2)))]
    got = of([*rows, (None, rows[0][1])]).collect()
    assert len(got) == 21 * 2 and sum(r.vec_id is None for r in got) == 2 and got[0].identity_error < 1e-9
    wide = of([(i, rng.normal(size=40).tolist()) for i in range(9)]).collect()
    assert len(wide) == 9 * 8 and wide[0].identity_error < 1e-9
    high = of([(i, rng.normal(size=40).tolist()) for i in range(60)]).collect()
    assert {r.component for r in high} == set(range(1, 33))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(0, 10_000))
def test_jacobi(d, seed):
    rng = np.random.default_rng(seed)
    r = np.triu(rng.normal(size=(d, d)) * 10.0 ** rng.integers(-6, 6, d))
    size, v = whitening.jacobi(r)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-12) and np.allclose(np.linalg.norm(r @ v, axis=0), size, rtol=1e-9)
    assert np.allclose(size, np.linalg.svd(r, compute_uv=False), rtol=1e-6, atol=1e-12 * size[0])


def test_deviations_are_exact():
    w = whitening.Whitening(3 * 10**9, np.array([3 * 10**9 * 5 + 1, 7], dtype=object), np.array([5, 0]), np.zeros(2), np.eye(2), np.ones(2), 1.0)
    assert whitening.deviations(np.array([[5, 0], [6, 1], [5, 10]]), w) == [1 + 49, None, None]
    assert whitening.deviations(np.array([[5, 0]]), whitening.Whitening(3 * 10**9, np.array([3 * 10**9 * 5 + 1, 7], dtype=object), np.array([5, 0]), np.zeros(2), np.eye(2), np.ones(2), 1.0)) == [50]


# -- 13


def mix_rows():
    rng = np.random.default_rng(3)
    rows = [(i, f"s{min(int(rng.integers(0, 12)), 5)}", prose(i, int(rng.integers(0, 300) if i % 50 else 3000))) for i in range(900)]
    return [*rows, (2000, None, prose(1, 70)), (2001, None, prose(2, 90)), (2002, "empty", ""), (2003, "empty", None), (None, "s1", prose(3, 50)), (5, "s1", prose(4, 60)), (5, "s1", prose(4, 60)), (2004, "\U00010000", prose(5, 80)), (2005, "�", prose(6, 90)), (2006, "long", "x " * 200_000)]


def test_mix(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sorted(map(tuple, mix.mix(clashing(df).repartition(3)).collect()), key=str)
    again = sorted(map(tuple, mix.mix(df.repartition(11, "text")).collect()), key=str)
    assert got == again and len(got) == len(rows)
    sizes: dict = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute.mix_targets(sizes)
    source = {}
    for i, s, t in rows:
        source.setdefault((i, len((t or "").split())), s)
    taken: dict = {}
    for i, size, total, target, words, times in got:
        s = source[i, size]
        assert total == sizes[s] and target == pytest.approx(want[s]) and words == times * size and 0 <= times <= 2
        taken[s] = taken.get(s, 0) + words
    assert abs(sum(taken.values()) / sum(want.values()) - 1) < 0.5
    for s in [f"s{k}" for k in range(6)]:
        assert abs(taken[s] - want[s]) <= 3, s
    assert mix.mix(df.where("false")).count() == 0


def test_mix_of_many_small_sources(spark):
    """Sources of one document miss their targets, the mix doesn't."""
    rows = [(i, f"{i:04}", prose(i, 20 + i % 40)) for i in range(700)]
    got = mix.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block=64).collect()
    assert abs(sum(r.taken for r in got) - sum(r.target for r in got)) < 60
    assert abs(sum(r.times for r in got) - sum(r.target / r.source_size for r in got)) < 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2000), min_size=1, max_size=80), st.floats(0.01, 0.99), st.integers(0, 99))
def test_flight_keeps_its_constraints(sizes, p, round_):
    size = np.sort(np.array(sizes, dtype=float))[::-1].copy()
    out = mix.flight(size, np.full(len(size), p), np.arange(len(size)), round_)
    assert ((out > 0) & (out < 1)).sum() <= 2 and out.min() >= 0 and out.max() <= 1
    assert out.sum() == pytest.approx(p * len(size), abs=1e-6) and out @ size == pytest.approx(p * size.sum(), abs=1e-3)


def test_flight_is_without_drift():
    size = np.array([900.0, 500, 300, 200, 100, 90, 60, 30, 20, 10])
    mean = np.mean([mix.flight(size, np.full(10, 0.3), np.arange(10), k) for k in range(4000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.03


def test_targets_step_by_step(spark):
    sizes = {"a": 1, "b": 1000, "c": 30, "d": 5, "e": 0, None: 100}
    sized = spark.createDataFrame([(1, s, n) for s, n in sizes.items()], "doc_id long, source string, size long")
    got = {r.source: r.target for r in mix.targets(sized, Workspace(spark, "t")).collect()}
    want = brute.mix_targets(sizes)
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))
