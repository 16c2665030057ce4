"""Convolutional toxicity classifier: hashed word embeddings, filters of several widths,
max pooling over the whole text and a logistic output, trained in numpy. A word's vector is
the sum of the rows of its own hash and of its first letters' hashes, so that forms of a
word which learning texts lack still say something.

All labelled documents are learned from. They are hashed on the executors. Up to ONE_DOCS documents of ONE_WORDS words together
are trained on in one place, the driver; more are dealt by a hash of the id into shards of about that size, and in each of ROUNDS rounds every shard
goes on from the same model, by one pass over its own documents, and Spark averages what comes out: an embedding row over the shards that have
it, all else over all. Words are counted, and unseen scores gathered, by Spark too; what reaches the driver is the model and counts of
rounded scores. `sample` and `words` bound the learning documents for callers who want that. Language, source, id and labels are no inputs of the score. Unseen ones among them scale the score
(Platt) and calibrate a threshold for each language. The query, which has one cutoff for all, moves its scores half
the way towards the best one (moved()).

Edge cases. A text without a word that the model knows, as a null or empty one, has nothing that
speaks for label 1: its score is 1 / (learning texts + 2). Very long texts are scored
whole, in blocks. With fewer than 20 usable labels, or one class, the score is the smoothed share
of label 1. Repeated documents are scored row by row and learned from once, by their least text;
repeated labels count once, by the highest value; null labels and ids are left out. Empty tables
give empty results; columns named like a new one are replaced.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, held_out, learning_rows, small
from .op10_decontaminate import folded

#: Documents, and their words together (16 bytes of memory for each), that are trained on in one place; rounds of training where there are more.
ONE_DOCS, ONE_WORDS, ROUNDS = 5_000, 3_000_000, 4
#: Places of scores that are gathered from many documents, and their bound.
ROUNDED, MOST = 3, 30.0
DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 8
#: Lengths of a word's first letters that have rows of their own, in words that are longer.
FIRST = (3, 4, 5)
#: Learning texts that must have a word or its first letters, and documents below which the scaling is cross-fitted.
LEAST_TEXTS, FEW = 3, 1_500
#: Of so many learning texts one must have a word or its first letters, so that the model doesn't grow with their number.
OF_TEXTS = 20_000
THRESHOLD = 0.7
#: Words scored at once.
BLOCK = 65_536
PAD, DROPOUT = 0, 0.1


def features(word: bytes) -> list[int]:
    """32-bit hashes of a word and of its first letters; 0 where it is too short."""
    u = word.decode("utf-8", "replace")
    return [xxhash.xxh32_intdigest(word), *(xxhash.xxh32_intdigest(u[:n].encode(), n) if len(u) > n else 0 for n in FIRST)]


class Rows(dict):
    """word -> its place in `found`, which holds the embedding rows of its features. Row 0 stands for padding
    and for all that too few learning texts have, so that nothing is learned by heart."""

    def __init__(self, kept: np.ndarray, limit: int = 100_000) -> None:
        super().__init__()
        self.index = {h: i for i, h in enumerate(kept.tolist(), 1)}
        self.found = np.zeros((limit, 1 + len(FIRST)), dtype=np.int32)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        if at >= len(self.found):
            self.found = np.concatenate([self.found, np.zeros_like(self.found)])
        get = self.index.get
        self.found[at] = [get(h, PAD) if h else PAD for h in features(word)]
        return at


def words_of(text: str | None, known: Rows) -> np.ndarray:
    """(words, features): embedding rows. What is known is forgotten between texts once it fills its table."""
    if len(known) >= len(known.found):
        known.clear()
    at = np.array([known[x] for x in folded(text).split()], dtype=np.int64)
    return known.found[at]


class Features(dict):
    """word -> its features, forgotten between texts once there are too many."""

    def __missing__(self, word: bytes) -> list[int]:
        out = self[word] = features(word)
        return out


def hashes_of(text: str | None, known: Features | None = None) -> np.ndarray:
    """(words, features): 32-bit hashes."""
    known = Features() if known is None else known
    if len(known) > 100_000:
        known.clear()
    words = folded(text).split()
    own = {w: k for k, w in enumerate(dict.fromkeys(words))}
    table = np.array([known[w] for w in own], dtype=np.uint32).reshape(-1, 1 + len(FIRST))
    return table[np.array([own[w] for w in words], dtype=np.int64)]


def hashed_vocabulary(docs: list[np.ndarray], least: int = LEAST_TEXTS) -> np.ndarray:
    """The sorted hashes that at least `least` documents have; a hash's row is its place plus 1."""
    values, counts = np.unique(np.concatenate([np.unique(d) for d in docs]), return_counts=True)
    return values[(counts >= least) & (values != 0)]


def rows_of(hashes: np.ndarray, kept: np.ndarray) -> np.ndarray:
    if not len(kept):
        return np.zeros(hashes.shape, dtype=np.int32)
    at = np.minimum(np.searchsorted(kept, hashes), len(kept) - 1)
    return np.where(kept[at] == hashes, at + 1, PAD).astype(np.int32)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class TextCnn:
    def __init__(self, kept: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.kept = kept
        self.e = rng.normal(0, 0.02, (len(kept) + 1, DIM)).astype(np.float32)
        self.e[PAD] = 0
        self.w = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.b = np.zeros((len(WIDTHS), FILTERS), dtype=np.float32)
        self.v = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.c = -2.0
        self.scale, self.shift = 1.0, 0.0
        self.prior: float | None = None
        self.least = 0.0

    def vectors(self, h: np.ndarray) -> np.ndarray:
        """Words' vectors: the sum over their features."""
        x = self.e.take(h[:, 0], axis=0)
        for k in range(1, h.shape[1]):
            x += self.e.take(h[:, k], axis=0)
        return x

    # -- training ---------------------------------------------------------------

    def fit(self, docs: list[np.ndarray], y: np.ndarray, updates: int = 2000, batch: int = 32, rate: float = 0.01, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        state = self.begin()
        epochs = min(40, max(4, -(-updates * batch // max(1, len(docs)))))
        for epoch in range(epochs):
            order = rng.permutation(len(docs))
            for i in range(0, len(order), batch):
                self._update([docs[j] for j in order[i : i + batch]], y[order[i : i + batch]], state, rate * (1 - epoch / epochs) + 1e-3, rng)

    def begin(self) -> dict:
        """The optimiser's state before the first step."""
        self.step = 0
        return {"e": np.zeros(len(self.e))}

    def one_pass(self, docs: list[np.ndarray], y: np.ndarray, state: dict, rate: float, seed: int, batch: int = 32) -> None:
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(docs))
        for i in range(0, len(order), batch):
            self._update([docs[j] for j in order[i : i + batch]], y[order[i : i + batch]], state, rate, rng)

    def _update(self, docs: list[np.ndarray], y: np.ndarray, state: dict, rate: float, rng) -> None:
        pad = max(WIDTHS) - 1
        sizes = [len(d) + pad for d in docs]
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        h = np.zeros((sum(sizes) + pad, 1 + len(FIRST)), dtype=np.int64)
        for s, d in zip(starts, docs, strict=True):
            h[s : s + len(d)] = d
        h[rng.random(h.shape) < DROPOUT] = PAD
        x = self.vectors(h)
        n = sum(sizes)
        pooled, where = [], []
        for k, w in enumerate(WIDTHS):
            r = sum(x[o : o + n] @ self.w[k][o] for o in range(w)) + self.b[k]
            best = np.stack([r[s : s + z].argmax(0) + s for s, z in zip(starts, sizes, strict=True)])
            where.append(best)
            pooled.append(np.maximum(r[best, np.arange(FILTERS)], 0))
        m = np.concatenate(pooled, axis=1)
        g = (_sigmoid(m @ self.v + self.c) - y) / len(docs)
        grads = {"v": m.T @ g + 1e-4 * self.v, "c": np.array(g.sum())}
        gm = np.outer(g, self.v) * (m > 0)
        rows, row_grads = [], []
        for k, w in enumerate(WIDTHS):
            gk = gm[:, k * FILTERS : (k + 1) * FILTERS]
            grads[f"b{k}"] = gk.sum(0)
            gw = np.zeros_like(self.w[k])
            for o in range(w):
                at = where[k] + o
                gw[o] = np.einsum("dfe,df->ef", x[at], gk)
                rows.append(h[at].reshape(-1, h.shape[1]))
                row_grads.append((gk[:, :, None] * self.w[k][o].T[None]).reshape(-1, DIM))
            grads[f"w{k}"] = gw + 1e-4 * self.w[k]
        self.step += 1
        for name, g1 in grads.items():
            p = {"v": self.v, "c": np.array(self.c)}.get(name, self.w[int(name[1:])] if name[0] == "w" else self.b[int(name[1:])] if name[0] == "b" else None)
            d = self._adam(state, name, g1, rate)
            if name == "c":
                self.c = float(p - d)
            else:
                p -= d.astype(np.float32)
        # a word's features share its gradient
        at, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        ge, own = np.zeros((len(at), DIM)), np.concatenate(row_grads)
        for place in inverse.reshape(len(own), -1).T:
            np.add.at(ge, place, own)
        second = state["e"]
        second[at] += (ge**2).mean(1)
        self.e[at] -= (4 * rate * ge / (np.sqrt(second[at])[:, None] + 1e-6)).astype(np.float32)
        self.e[PAD] = 0

    def _adam(self, state: dict, name: str, g: np.ndarray, rate: float) -> np.ndarray:
        m, v = state.get(name, (0.0, 0.0))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        state[name] = (m, v)
        return rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)

    def calibrate(self, raw: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> None:
        """Platt scaling by Newton steps, with smoothed targets; each output counts so many times."""
        times = np.ones(len(y)) if times is None else times
        pos, neg = (times * y).sum(), (times * (1 - y)).sum()
        if not pos or not neg:
            return
        t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
        mean = np.average(raw, weights=times)
        std = np.sqrt(np.average((raw - mean) ** 2, weights=times)) or 1.0
        z, a, b = (raw - mean) / std, 1.0, 0.0
        for _ in range(50):
            p = _sigmoid(a * z + b)
            w = (p * (1 - p) + 1e-9) * times
            g = np.array([((p - t) * times * z).sum() + 1e-3 * a, ((p - t) * times).sum()])
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(hess, g)
            step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
            a, b = a - step[0], b - step[1]
        if a > 0:
            self.scale, self.shift = a / std, b - a * mean / std

    # -- scoring ----------------------------------------------------------------

    def raw(self, h: np.ndarray) -> float:
        """The unscaled output for a whole text (words, features), in blocks that overlap by a window."""
        pad = max(WIDTHS) - 1
        h = np.concatenate([h, np.zeros((2 * pad, 1 + len(FIRST)), dtype=h.dtype)])
        n, best = len(h) - pad, [np.full(FILTERS, -np.inf, dtype=np.float32) for _ in WIDTHS]
        for s in range(0, n, BLOCK):
            e = min(s + BLOCK, n)
            x = self.vectors(h[s : e + pad])
            for k, w in enumerate(WIDTHS):
                r = x[: e - s] @ self.w[k][0]
                for o in range(1, w):
                    r += x[o : o + e - s] @ self.w[k][o]
                best[k] = np.maximum(best[k], r.max(0))
        m = np.concatenate([np.maximum(x + self.b[k], 0) for k, x in enumerate(best)])
        return float(m @ self.v + self.c)

    def score(self, h: np.ndarray) -> float:
        if self.prior is not None:
            return self.prior
        if not h.any():
            return self.least
        return float(_sigmoid(self.scale * self.raw(h) + self.shift))


def train(texts: list[str | None], y: np.ndarray, langs: list) -> tuple[TextCnn, dict]:
    return learn([hashes_of(t) for t in texts], y, langs)


def learn(docs: list[np.ndarray], y: np.ndarray, langs: list) -> tuple[TextCnn, dict]:
    """Of hashed documents: the model, and a threshold for each language with enough documents of both labels, and at
    None for all others if all documents are enough: the cutoff of the best F1 over documents that
    the scored model had not seen, of equal ones the nearest to THRESHOLD. Of few documents all are learned from, and unseen scores come from four folds."""
    if len(y) < 20 or y.min() == y.max():
        model = TextCnn(np.zeros(0, dtype=np.uint32))
        model.prior = float((y.sum() + 1) / (len(y) + 2))
        return model, {}
    fold = np.random.default_rng(3).integers(0, 4 if len(y) < FEW else 5, len(y))

    def learned(use: np.ndarray) -> TextCnn:
        own = [d for d, u in zip(docs, use, strict=True) if u]
        model = TextCnn(hashed_vocabulary(own))
        model.fit([rows_of(d, model.kept) for d in own], y[use])
        model.least = 1 / (len(own) + 2)
        return model

    def raws(model: TextCnn, use: np.ndarray) -> np.ndarray:
        return np.array([model.raw(rows_of(d, model.kept)) for d, u in zip(docs, use, strict=True) if u])

    raw = np.full(len(y), np.nan)
    if len(y) < FEW:
        for k in range(4):
            if (fold == k).any() and y[fold != k].min() != y[fold != k].max():
                raw[fold == k] = raws(learned(fold != k), fold == k)
        model = learned(np.ones(len(y), dtype=bool))
    else:
        model = learned(fold != 0)
        raw[fold == 0] = raws(model, fold == 0)
    seen = ~np.isnan(raw)
    model.calibrate(raw[seen], y[seen])
    score = _sigmoid(model.scale * raw[seen] + model.shift)
    return model, cutoffs(score, y[seen], np.array([str(x) for x in langs])[seen], np.ones(seen.sum()))


def cutoffs(score: np.ndarray, y: np.ndarray, lang: np.ndarray, times: np.ndarray) -> dict:
    """The cutoff of the best F1 for each language with enough documents of both labels, and at None for all."""
    out = {}
    for x in [None, *np.unique(lang).tolist()]:
        use = np.ones(len(y), dtype=bool) if x is None else lang == x
        order = np.argsort(score[use], kind="stable")
        s, t, n = score[use][order], (y * times)[use][order], times[use][order]
        if t.sum() >= 10 and (n - t).sum() >= 10:
            cuts = np.unique(np.r_[THRESHOLD, s])
            cuts = cuts[np.argsort(np.abs(cuts - THRESHOLD), kind="stable")]
            at = np.searchsorted(s, cuts)
            right, reached = np.r_[np.cumsum(t[::-1])[::-1], 0][at], np.r_[np.cumsum(n[::-1])[::-1], 0][at]
            f1 = 2 * right / np.maximum(1, reached + t.sum())
            out[x] = float(cuts[int(np.argmax(f1))])
    return out


# -- learning from many documents, in shards

#: Numbers in a row of what shards give: an embedding and its sum of squares, or so many of all other numbers one after the other.
WIDE = DIM + 1
GIVEN = "id long, " + ", ".join(f"x{k} double" for k in range(WIDE))


def _dense(model: TextCnn, state: dict) -> np.ndarray:
    """All numbers of model and optimiser but the embeddings: the parameters, then both means of each."""
    names = ["v", "c", *[f"{p}{k}" for k in range(len(WIDTHS)) for p in ("b", "w")]]
    own = {"v": model.v, "c": np.array(model.c)} | {f"b{k}": b for k, b in enumerate(model.b)} | {f"w{k}": w for k, w in enumerate(model.w)}
    means = [state.get(n, (np.zeros(own[n].shape), np.zeros(own[n].shape))) for n in names]
    return np.concatenate([np.ravel(own[n]).astype(float) for n in names] + [np.ravel(m[i]) for m in means for i in (0, 1)])


def _set_dense(model: TextCnn, state: dict, flat: np.ndarray) -> None:
    names = ["v", "c", *[f"{p}{k}" for k in range(len(WIDTHS)) for p in ("b", "w")]]
    shapes = [{"v": model.v.shape, "c": (), "b": model.b[0].shape, "w": ()}[n[0]] if n[0] != "w" else model.w[int(n[1:])].shape for n in names]
    at = 0

    def take(shape) -> np.ndarray:
        nonlocal at
        size = int(np.prod(shape))
        at += size
        return flat[at - size : at].reshape(shape)

    own = {n: take(s) for n, s in zip(names, shapes, strict=True)}
    for n, s in zip(names, shapes, strict=True):
        state[n] = (take(s).copy(), take(s).copy())
    model.v, model.c = own["v"].astype(np.float32), float(own["c"])
    model.w = [own[f"w{k}"].astype(np.float32) for k in range(len(WIDTHS))]
    model.b = np.stack([own[f"b{k}"] for k in range(len(WIDTHS))]).astype(np.float32)


def _of_bytes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4").reshape(-1, 1 + len(FIRST))


def _texts_with(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes and how many texts of a batch have them."""
    for df in batches:
        if len(df):
            h, n = np.unique(np.concatenate([np.unique(_of_bytes(x)) for x in df["hashes"]]), return_counts=True)
            yield pd.DataFrame({"h": h.astype(np.int64), "n": n})


def _embedded(own):
    """Embedding rows in place of hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield df[["shard", "y"]].assign(rows=[rows_of(_of_bytes(x), own.value).astype("<i4").tobytes() for x in df["hashes"]])

    return run


def _passes(own, rate: float, turn: int):
    """For each shard, whose rows follow each other: a pass from the round's model on, and what it changed."""

    def trained(shard: int, docs: list[np.ndarray], y: list[float]) -> pd.DataFrame:
        model, state = copy.deepcopy(own.value)
        before = state["e"].copy()
        model.one_pass(docs, np.array(y), state, rate, seed=1_000 * turn + shard)
        flat = _dense(model, state)
        at = np.flatnonzero(state["e"] != before)
        values = np.concatenate([np.c_[model.e[at], state["e"][at]], np.pad(flat, (0, -len(flat) % WIDE)).reshape(-1, WIDE)])
        ids = np.r_[at, -1 - np.arange(len(values) - len(at))]
        return pd.DataFrame({"id": ids} | {f"x{k}": values[:, k] for k in range(WIDE)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, docs, y = None, [], []
        for df in batches:
            for shard, truth, raw in zip(df["shard"], df["y"], df["rows"], strict=True):
                if shard != now and docs:
                    yield trained(now, docs, y)
                    docs, y = [], []
                now = shard
                docs.append(np.frombuffer(raw, dtype="<i4").reshape(-1, 1 + len(FIRST)))
                y.append(truth)
        if docs:
            yield trained(now, docs, y)

    return run


def _unseen(own):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = own.value
        for df in batches:
            raw = [model.raw(rows_of(_of_bytes(x), model.kept)) for x in df["hashes"]]
            yield pd.DataFrame({"lang": df["lang"].astype(str), "y": df["y"], "raw": np.clip(np.round(raw, ROUNDED), -MOST, MOST)})

    return run


def learn_in_shards(rows: DataFrame, n_docs: int, n_words: int, ws: Workspace, rounds: int | None = None) -> tuple[TextCnn, dict]:
    """learn() for rows (place, lang, y, hashes) that are too many for one place. A fifth, drawn by place, is not trained on: of it
    come the scaling and the thresholds."""
    rounds = rounds or ROUNDS
    sc = rows.sparkSession.sparkContext
    shards = max(1, math.ceil(max(n_docs / ONE_DOCS, n_words / ONE_WORDS)))
    drawn = F.xxhash64("place", F.lit("fold"))
    unseen = rows.where(F.pmod(drawn, F.lit(5)) == 0)
    seen = rows.where(F.pmod(drawn, F.lit(5)) != 0).select(F.pmod("place", F.lit(shards)).cast("int").alias("shard"), "place", "y", "hashes")
    # a shard's rows are in one file and follow each other, whatever the tasks that read it
    seen = ws.write(seen.repartition(shards, "shard").sortWithinPartitions("shard", "place"), "shards")
    counts = seen.mapInPandas(_texts_with, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where((F.col("n") >= max(LEAST_TEXTS, math.ceil(n_docs / OF_TEXTS))) & (F.col("h") != 0))
    model = TextCnn(np.sort(counts.select("h").toPandas()["h"].to_numpy(np.uint32)))
    own = sc.broadcast(model.kept)
    # each file is written by one task, so that a shard's rows stay together
    seen = ws.write(seen.select("shard", "y", "hashes").mapInPandas(_embedded(own), "shard int, y double, rows binary"), "rows")
    own.destroy()
    ws.drop("shards")
    state = model.begin()
    for turn in range(rounds):
        own = sc.broadcast((model, state))
        given = seen.mapInPandas(_passes(own, 0.01 * (1 - turn / rounds) + 1e-3, turn), GIVEN)
        got = given.groupBy("id").agg(*[F.avg(f"x{k}").alias(f"x{k}") for k in range(WIDE)]).toPandas().sort_values("id")
        own.destroy()
        ids, values = got["id"].to_numpy(), got.drop(columns="id").to_numpy()
        at = ids >= 0
        model.e[ids[at]], state["e"][ids[at]] = values[at, :DIM], values[at, DIM]
        _set_dense(model, state, values[~at][::-1].ravel())
        # the steps of a pass, for the bias of the optimiser's means
        model.step += max(1, n_docs * 4 // 5 // shards // 32)
    model.least = 1 / (n_docs + 2)
    own = sc.broadcast(model)
    found = unseen.select("lang", "y", "hashes").mapInPandas(_unseen(own), "lang string, y double, raw double").groupBy("lang", "y", "raw").count().toPandas()
    own.destroy()
    found = found.sort_values(["lang", "raw", "y"])
    y, raw, times = (found[c].to_numpy(float) for c in ("y", "raw", "count"))
    model.calibrate(raw, y, times)
    return model, cutoffs(_sigmoid(model.scale * raw + model.shift), y, found["lang"].to_numpy(), times)


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = Features()
    for df in batches:
        found = [hashes_of(t if isinstance(t, str) else None, known) for t in df["text"]]
        out = df[["doc_id", "lang", "y", "place"]].copy()
        yield out.assign(n=[len(f) for f in found], hashes=[f.astype("<u4").tobytes() for f in found])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int | None = None, words: int | None = None) -> tuple[TextCnn, dict]:
    """The model and the thresholds, from all labelled documents; of rows that repeat an id one is learned from. Given `sample` or `words`, from so
    many documents or words at most, in the order of a hash of the id."""
    known = labels.where(learning_rows() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    known = known.withColumn("place", F.xxhash64("doc_id"))
    if sample is not None:
        known = known.orderBy("place", "doc_id").limit(sample)
    ws = Workspace(docs.sparkSession, "toxicity")
    known = ws.write(known, "known")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", F.struct(F.col("text").isNotNull().alias("some"), F.col("text").cast("string").alias("text"), lang.alias("lang")).alias("d"))
    rows = rows.join(small(known), "doc_id").groupBy("doc_id", "y", "place").agg(F.min("d").alias("d"))
    rows = ws.write(rows.select("doc_id", "y", "place", "d.text", "d.lang").mapInPandas(_hashed, "doc_id long, lang string, y double, place long, n long, hashes binary"), "learning")
    n, total, ones = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if words is not None and total > words:
        # a text that would pass the bound is left out, and the next ones still count
        taken, total = [], 0
        for r in rows.select("place", "doc_id", "n").orderBy("place", "doc_id").toLocalIterator():
            if total + r["n"] <= words:
                taken.append((r["doc_id"],))
                total += r["n"]
        n = len(taken)
        rows = rows.join(docs.sparkSession.createDataFrame(taken, "doc_id long"), "doc_id")
    if n > ONE_DOCS or total > ONE_WORDS:
        if 0 < ones < n:
            out = learn_in_shards(rows, n, total, ws)
        else:
            out = learn([], np.full(n, float(ones > 0)), [])
    else:
        got = rows.toPandas().sort_values(["place", "doc_id"])
        out = learn([_of_bytes(h) for h in got["hashes"]], got["y"].to_numpy(float), got["lang"].tolist())
    ws.keep_only()
    return out


def score(docs: DataFrame, model: TextCnn, thresholds: dict, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with score, threshold (the language's) and rejected: the score reaches it. Columns of
    these names are replaced."""
    own = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cnn = own.value
        known = Rows(cnn.kept)
        for texts in batches:
            yield pd.Series([cnn.score(words_of(t if isinstance(t, str) else None, known)) for t in texts], dtype="float64")

    limit = F.lit(thresholds.get(None, THRESHOLD))
    if lang in docs.columns:
        for k, v in thresholds.items():
            if k is None:
                continue
            limit = F.when(F.col(lang) == k, F.lit(v)).otherwise(limit)
    return docs.withColumn("score", run(F.col(text))).withColumn("threshold", limit).withColumn("rejected", F.col("score") >= F.col("threshold"))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def moved(model: TextCnn, thresholds: dict) -> dict:
    """Moves the model's scores, in place and in their order, half the way that would put the threshold of all languages at
    THRESHOLD, if it lies below: the best cutoff of some hundred documents is uncertain, and rejects more
    than the one it replaces. The thresholds that go with them."""
    cut = min(max(thresholds.get(None, THRESHOLD), 1e-6), THRESHOLD)
    by = (_logit(THRESHOLD) - _logit(cut)) / 2
    model.shift += by
    return {k: 1 / (1 + math.exp(-(_logit(min(max(v, 1e-9), 1 - 1e-9)) + by))) for k, v in thresholds.items()}


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, thresholds = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    thresholds = moved(model, thresholds)
    out = score(docs.select("doc_id", "text", "lang"), model, thresholds)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "threshold", "rejected")
