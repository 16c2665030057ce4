"""Sparse rule ensemble for quality: boosted shallow trees over text statistics give
paths, each a conjunctive rule; a lasso logistic fit keeps few of them; the kept rules
become one Spark column expression.

Labels, language, source and id are no inputs of the score. Fitting uses at most
`sample` labelled rows, taken in the order of a hash of the id.

Edge cases. Null text counts as empty and is scored like it. Without labels, or with
one class only, the score is the smoothed share of label 1 for all. Repeated rows are
scored row by row; of rows that repeat an id one is learned from, that of the least statistics; repeated labels
of a document count once, by the lowest value; null labels are left out. Ties of a statistic with a cutoff fall to the
rule's lower side. Very long texts are counted whole. Further columns, of whatever names, are not read.
Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, held_out, learning_rows
from .textstats import COUNTS, SHAPES, statistics

SAMPLE = 40_000

_per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    """Features by name, as Spark expressions over the counts."""
    return {
        "words": F.col("n_words").cast("double"),
        "lines": F.col("n_lines").cast("double"),
        "words_per_line": _per("n_words", "n_lines"),
        "chars_per_word": _per("word_chars", "n_words"),
        "symbols_per_word": _per("n_symbols", "n_words"),
        "dup_line_share": _per("n_dup_lines", "n_lines"),
        "repeat_share": _per("n_repeat_words", "n_words"),
        "distinct_share": _per("n_distinct", "n_words"),
        "upper_share": _per("n_upper", "word_chars"),
        "digit_share": _per("n_digits", "word_chars"),
        "punct_per_word": _per("n_punct", "n_words"),
        "ends_per_word": _per("n_ends", "n_words"),
        "top_share": _per("top_count", "n_words"),
        "long_share": _per("n_long", "n_words"),
        "short_share": _per("n_short", "n_words"),
        "caps_share": _per("n_caps", "n_words"),
        "other_share": _per("n_other", "word_chars"),
        "twice_share": _per("n_twice", "n_words"),
    }


Rule = tuple[tuple[str, str, float], ...]


def _tree(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, least: int):
    """A regression tree on gradients, by binned exact search: (feature, bin, left, right) or a leaf value."""
    leaf = -g[rows].sum() / (h[rows].sum() + 1.0)
    if depth == 0 or len(rows) < 2 * least:
        return leaf
    best, pick = 1e-6, None
    total_g, total_h = g[rows].sum(), h[rows].sum()
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        b = x[rows, j]
        gs = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
        hs = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
        ns = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
        gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
        gain[(ns < least) | (len(rows) - ns < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best:
            best, pick = gain[k], (j, k)
    if pick is None:
        return leaf
    j, k = pick
    left = x[rows, j] <= k
    return (j, k, _tree(x, cuts, g, h, rows[left], depth - 1, least), _tree(x, cuts, g, h, rows[~left], depth - 1, least))


def _predict(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, k, a, b = tree
    return np.where(x[:, j] <= k, _predict(a, x), _predict(b, x))


def _paths(tree, path=()):
    """Every node's path from the root, as ((feature, '<=' or '>', bin), ...)."""
    if path:
        yield path
    if isinstance(tree, tuple):
        j, k, a, b = tree
        yield from _paths(a, (*path, (j, "<=", k)))
        yield from _paths(b, (*path, (j, ">", k)))


def _holds(path, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, op, k in path:
        out &= (x[:, j] <= k) if op == "<=" else (x[:, j] > k)
    return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lasso(r: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """L1 logistic regression by accelerated proximal gradient; the intercept is free."""
    a = np.c_[r, np.ones(len(r))]
    w = v = np.zeros(a.shape[1])
    v0 = np.ones(a.shape[1])
    for _ in range(20):
        v0 = a.T @ (weight * (a @ v0))
        norm = np.linalg.norm(v0)
        v0 /= norm or 1
    step = 4 / (norm / weight.sum() or 1)
    t = 1.0
    for _ in range(steps):
        grad = a.T @ (weight * (_sigmoid(a @ v) - y)) / weight.sum()
        z = v - step * grad
        new = np.sign(z) * np.maximum(np.abs(z) - step * penalty, 0)
        new[-1] = z[-1]
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 60, depth: int = 3, seed: int = 7) -> tuple[list[tuple[Rule, float]], float]:
    """(rule, weight) pairs and the intercept. The lasso penalty is the largest whose loss on
    a fifth of the rows is within one percent of the best."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) < 20 or y.min() == y.max():
        return [], float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 40))) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    fit = rng.random(len(y)) > 0.2
    if y[fit].min() == y[fit].max() or y[~fit].size == 0:
        fit[:] = True
    raw = np.zeros(len(y))
    least = max(5, len(y) // 500)
    paths: dict = {}
    for _ in range(trees):
        p = _sigmoid(raw)
        rows = np.flatnonzero(fit & (rng.random(len(y)) < 0.6))
        if len(rows) < 2 * least:
            break
        tree = _tree(binned, cuts, p - y, p * (1 - p), rows, depth, least)
        raw += 0.2 * _predict(tree, binned)
        paths |= dict.fromkeys(_paths(tree))
    held = {}
    for p in paths:
        m = _holds(p, binned)
        if 0.002 < m[fit].mean() < 0.998:
            held.setdefault(m.tobytes(), (p, m))
    if not held:
        return [], float(np.log(share / (1 - share)))
    kept = [p for p, _ in held.values()]
    r = np.stack([m for _, m in held.values()], axis=1).astype(float)
    weight = np.ones(len(y))
    test = ~fit if (~fit).any() else fit
    tries = []
    for penalty in (0.01, 0.003, 0.001, 0.0003, 0.0001):
        w, b = _lasso(r[fit], y[fit], weight[fit], penalty)
        q = np.clip(_sigmoid(r[test] @ w + b), 1e-6, 1 - 1e-6)
        tries.append((float(-(y[test] * np.log(q) + (1 - y[test]) * np.log(1 - q)).mean()), penalty))
    best = min(tries)[0]
    penalty = max(p for loss, p in tries if loss <= best * 1.01 + 1e-4)
    w, b = _lasso(r, y, weight, penalty, 600)
    named = lambda path: tuple((names[j], op, float(cuts[j][k])) for j, op, k in path)
    return [(named(p), float(x)) for p, x in zip(kept, w, strict=True) if abs(x) > 1e-3], b


def compile_rules(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """The score as one Spark expression over the feature columns."""
    total = F.lit(intercept)
    for rule, w in rules:
        c = F.lit(True)
        for name, op, cut in rule:
            c = c & ((F.col(name) <= cut) if op == "<=" else (F.col(name) > cut))
        total = total + F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, and the features. The text is read once."""
    ws = Workspace(docs.sparkSession, "quality")
    stats = docs.select(F.col(doc_id).alias("doc_id"), statistics(F.col(text), shapes=True).alias("s"))
    stats = ws.write(stats.select("doc_id", *[f"s.{c}" for c in COUNTS + SHAPES]), "stats")
    named = features()
    stats = stats.select("doc_id", *[c.alias(k) for k, c in named.items()])
    known = labels.where(learning_rows() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("double").alias("__y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # of rows that repeat an id the one with the least statistics
    rows = stats.join(F.broadcast(known), "doc_id").groupBy("doc_id", "__y").agg(F.min(F.struct(*named)).alias("r")).select("doc_id", "__y", "r.*").toPandas().sort_values("doc_id")
    rules, intercept = fit_rules(rows[list(named)].to_numpy(float), rows["__y"].to_numpy(float), list(named))
    return stats.withColumns({"score": compile_rules(rules, intercept), "held_out": held_out()})


def query(spark, sf_dir):
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
