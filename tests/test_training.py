"""Fitting of chains and training of heads against plain versions."""

from __future__ import annotations

import numpy as np
import pytest

from recitary.operators import hmm, training


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    w = training.new_head((5, 7, 3))
    x, y = rng.normal(size=(9, 5)), rng.integers(0, 3, 9)
    loss, right, g = training.loss_and_gradient(x, y, w)
    assert right == (training.scores(x, w)[-1].argmax(1) == y).sum()
    for k, v in w.items():
        for i in np.ndindex(v.shape):
            moved = []
            for step in (1e-6, -1e-6):
                other = {n: a.copy() for n, a in w.items()}
                other[k][i] += step
                moved.append(training.loss_and_gradient(x, y, other, False)[0])
            assert g[k][i] == pytest.approx((moved[0] - moved[1]) / 2e-6, abs=1e-5)


def test_updates():
    w, g = {"a": np.array([1.0, -2.0])}, {"a": np.array([30.0, 40.0])}
    cut = training.clipped(g)
    assert np.linalg.norm(cut["a"]) == pytest.approx(5) and training.clipped({"a": np.array([3.0])})["a"][0] == pytest.approx(3)
    o = training.AdamW(0.1, 0.01)
    m = v = np.zeros(2)
    for t in (1, 2, 3):
        m, v = 0.9 * m + 0.1 * cut["a"], 0.999 * v + 0.001 * cut["a"] ** 2
        want = w["a"] - 0.1 * 0.01 * w["a"] - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w = o.update(w, cut)
        assert np.allclose(w["a"], want)
    p, rate, seen = training.Plateau(), 1.0, []
    for loss in (5, 4, 4, 4, 4, 4, 3, 3, 3, 3):
        rate = p.rate(rate, loss)
        seen.append(rate)
    assert seen == [1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5, 0.5, 0.25]


def test_best_epoch(spark, tmp_path):
    path = f"file://{tmp_path}/best"
    best = training.BestEpoch(spark, path)
    assert best.epochs() == []
    best.save(1, {"x": np.array([[1.0, 2.0]])})
    training.save_weights(spark, {"x": np.array([9.0])}, f"{path}/_new-left-by-a-lost-run")
    best.save(3, {"x": np.array([[3.0, 4.0]])})
    best.save(3, {"x": np.array([[3.0, 4.0]])})
    assert best.epochs() == [3] and best.load()[0] == 3 and best.load()[1]["x"].tolist() == [[3.0, 4.0]]


def test_training(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [((rng.normal(size=4) + 2 * np.eye(4)[i % 3]).tolist(), i % 3) for i in range(300)]
    df = spark.createDataFrame([*rows, (None, 1), (rows[0][0], None)], "features array<double>, label int")
    start = training.new_head((4, 6, 3))
    path = f"file://{tmp_path}/head"
    e = training.train(df, df, start, path, epochs=12, steps=3, optimiser=training.AdamW(0.05)).collect()
    assert e[-1].accuracy > 0.8 and e[-1].valid_loss < e[0].valid_loss
    epoch, w = training.BestEpoch(spark, path).load()
    assert epoch == min(e, key=lambda r: r.valid_loss).epoch and [r.best for r in e][epoch - 1]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert training.loss_and_gradient(x, y, w, False)[0] / 300 == pytest.approx(min(r.valid_loss for r in e))
    # a step in Spark is the step over all rows, whatever the partitions
    n, loss, right, g = training.summed(df.where("label is not null and features is not null").select("features", df.label.cast("long").alias("label")).repartition(9), start)
    want = training.loss_and_gradient(x, y, start)
    assert (n, right) == (300, want[1]) and loss == pytest.approx(want[0]) and all(np.allclose(g[k], want[2][k]) for k in g)
    none = training.train(df.where("false"), df.where("false"), start, f"file://{tmp_path}/none", epochs=9).collect()
    assert len(none) == 4 and none[0].train_loss is None and not any(r.best for r in none)


def plain_fit(segments: list[np.ndarray], rounds: int, states: int = 3):
    every = np.concatenate(segments)
    paths = [np.minimum(np.arange(len(s)) * states // len(s), states - 1) for s in segments]
    for k in range(rounds):
        if k:
            paths = [hmm.viterbi(np.stack([hmm.log_gaussian(s, *m) for m in model], axis=1)) for s in segments]
        at, model = np.concatenate(paths), []
        for s in range(states):
            f = every[at == s] if (at == s).any() else every
            model.append((f.mean(0), np.cov(f.T, bias=True).reshape(f.shape[1], -1) + 1e-3 * np.eye(f.shape[1])))
    return model


def test_chains_on_all_frames(spark):
    rng = np.random.default_rng(2)
    rows, by = [], {}
    for u in range(25):
        for pos, token in enumerate("abca"):
            n = int(rng.integers(1, 12))
            x = np.concatenate([rng.normal(1e3 + 3 * k + ord(token), 0.5, (len(p), 3)) for k, p in enumerate(np.array_split(np.arange(n), 3))])
            by.setdefault(token, []).append(x)
            rows += [(f"u{u}", pos, token, t, v.tolist()) for t, v in enumerate(x)]
    rows += [("u0", 9, "rare", t, [0.0, 1.0, 2.0]) for t in range(9)] + [("u0", 10, "a", 0, None), ("u0", 11, None, 0, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "utt string, pos int, token string, t int, feat array<double>").repartition(13)
    for rounds in (1, 4):
        got = {(r.token, r.state): (r.mean, r.cov) for r in hmm.fit_models(df, rounds=rounds, tol=-1e9).collect()}
        assert {t for t, _ in got} == {"a", "b", "c"}
        for token in "abc":
            for s, (mean, cov) in enumerate(plain_fit(by[token], rounds)):
                assert np.allclose(got[token, s][0], mean) and np.allclose(got[token, s][1], cov.ravel(), atol=1e-8)
    # frames that are all alike, and no frames
    same = spark.createDataFrame([("u", 0, "x", t, [1.0]) for t in range(20)], "utt string, pos int, token string, t int, feat array<double>")
    assert [(r.mean, r.cov) for r in hmm.fit_models(same).collect()] == [([1.0], [pytest.approx(1e-3)])] * 3
    assert hmm.fit_models(same.where("false")).count() == 0


def test_best_paths_in_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 9, 40)
    log_b = rng.normal(size=(lengths.sum(), 3))
    want = np.concatenate([hmm.viterbi(log_b[e - n : e]) for e, n in zip(np.cumsum(lengths), lengths, strict=True)])
    for cells in (1, 60, 10**6):
        monkeypatch.setattr(hmm, "CELLS", cells)
        assert (hmm.best_paths(log_b, lengths)[0] == want).all()
