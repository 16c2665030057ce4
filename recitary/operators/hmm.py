"""Left-to-right chains of small Gaussian models: fitting, joining, forced alignment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recitary.sources.scratch import written

from .partial import block_of, sum_tree

STAY, NEXT, STATES = 0.6, 0.4, 3
MODEL = "token string, state int, mean array<double>, cov array<double>"


def log_gaussian(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = len(mean)
    low = np.linalg.cholesky(cov)
    z = np.linalg.solve(low, (x - mean).T)
    return -0.5 * ((z**2).sum(0) + d * np.log(2 * np.pi)) - np.log(np.diag(low)).sum()


def viterbi(log_b: np.ndarray, stay: float = STAY, step: float = NEXT) -> np.ndarray:
    """Best path of a chain that starts in its first state; each state stays or moves to the
    next, the last one stays. log_b: (frames, states). Only the band i-1 -> i is looked at."""
    frames, n = log_b.shape
    stays = np.full(n, np.log(stay))
    stays[-1] = 0.0
    score = np.full(n, -np.inf)
    score[0] = log_b[0, 0]
    moved = np.zeros((frames, n), dtype=bool)
    for t in range(1, frames):
        a, b = score + stays, np.r_[-np.inf, score[:-1] + np.log(step)]
        moved[t] = b > a
        score = np.where(moved[t], b, a) + log_b[t]
    path = np.empty(frames, dtype=np.int64)
    at = int(score.argmax())
    for t in range(frames - 1, -1, -1):
        path[t] = at
        at -= int(moved[t, at])
    return path


#: Cells of (segment, frame, state) that the search for best paths holds at once.
CELLS = 2_000_000


def best_paths(log_b: np.ndarray, lengths: np.ndarray, stay: float = STAY, step: float = NEXT) -> tuple[np.ndarray, np.ndarray]:
    """viterbi() for many segments at once, whose frames lie one after the other in log_b:
    the states of all frames and each segment's score. Segments of like length go together."""
    starts, n = np.cumsum(lengths) - lengths, log_b.shape[1]
    states, scores = np.empty(len(log_b), dtype=np.int64), np.empty(len(lengths))
    stays = np.full(n, np.log(stay))
    stays[-1] = 0.0
    order = np.argsort(lengths, kind="stable")
    i = 0
    while i < len(order):
        # as many segments as fit, as long as the longest of them
        fits = np.arange(1, len(order) - i + 1) * lengths[order[i:]] * n <= CELLS
        own = order[i : i + max(1, int(fits.argmin()) if not fits.all() else len(fits))]
        i += len(own)
        frames = int(lengths[own[-1]])
        there = np.arange(frames) < lengths[own][:, None]
        at = np.where(there, starts[own][:, None] + np.arange(frames), 0)
        b = log_b[at]
        score = np.full((len(own), n), -np.inf)
        score[:, 0] = b[:, 0, 0]
        moved = np.zeros((len(own), frames, n), dtype=bool)
        none = np.full((len(own), 1), -np.inf)
        for t in range(1, frames):
            kept, came = score + stays, np.hstack([none, score[:, :-1] + np.log(step)])
            live = there[:, t, None]
            moved[:, t] = (came > kept) & live
            score = np.where(live, np.maximum(kept, came) + b[:, t], score)
        last, rows = score.argmax(1), np.arange(len(own))
        scores[own] = score[rows, last]
        path = np.empty((len(own), frames), dtype=np.int64)
        for t in range(frames - 1, -1, -1):
            path[:, t] = last
            last = last - moved[rows, t, last]
        states[at[there]] = path[there]
    return states, scores


#: Bytes of models that are sent to the executors: 250 tokens of 39 dimensions take some 9 MB.
MODEL_BYTES = 256 << 20


def _sums(models: dict | None, centre: dict, states: int):
    """A mapInArrow function over segments (token, n, x): for each token and state the number of frames, their
    sum and that of their outer products about the token's centre, and for the token the score of its best paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            lengths = batch.column("n").to_numpy().astype(np.int64)
            sizes = np.asarray(batch.column("x").value_lengths()).astype(np.int64)
            tokens = np.array(batch.column("token").to_pylist(), dtype=object)
            ends = np.cumsum(sizes)
            for token in dict.fromkeys(tokens.tolist()):
                if models is not None and token not in models:
                    continue
                own = np.flatnonzero(tokens == token)
                c = centre[token]
                frames = np.concatenate([x[ends[k] - sizes[k] : ends[k]] for k in own]).reshape(-1, len(c)) - c
                n = lengths[own]
                if models is None:
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    path, score = np.minimum(at * states // np.repeat(n, n), states - 1), 0.0
                else:
                    path, scores = best_paths(np.stack([log_gaussian(frames, m, v) for m, v in models[token]], axis=1), n)
                    score = float(scores.sum())
                for s in range(states):
                    f = frames[path == s]
                    held = total.setdefault((token, s), np.zeros(2 + len(c) * (1 + len(c))))
                    held += np.r_[len(f), score if s == 0 else 0.0, f.sum(0), (f.T @ f).ravel()]
        if total:
            yield block_of([(*k, v) for k, v in total.items()], ("token", "state"))

    return run


def fit_models(
    frames: DataFrame, token: str = "token", value: str = "feat", order: str = "t", segment: Sequence[str] | None = None,
    least: int = 10, rounds: int = 20, tol: float = 1e-3, states: int = STATES, ridge: float = 1e-3,
) -> DataFrame:
    """A model for each token with at least `least` frames: (token, state, mean, cov), from all of them.

    A segment, the frames of one token in a row, passes through the states from the first one on. From even
    parts as the start, each round re-estimates the states from the frames on them and finds each segment's
    best path anew, until a token's score gains less than `tol`. A round is one Spark job: tasks
    send sums by token and state, which are added in a tree; frames don't move. A state without frames takes the
    statistics of its token. The models of all tokens, a closed alphabet, go to every task (MODEL_BYTES at most).
    Frames without a vector are left out. A segment is a piece of one recording and fits a task: that of
    the columns `segment`, by default utt and pos if they are there."""
    spark = frames.sparkSession
    segment = [c for c in ("utt", "pos") if c in frames.columns] if segment is None else list(segment)
    own = frames.where(F.col(value).isNotNull() & F.col(token).isNotNull()).groupBy(*segment, F.col(token).cast("string").alias("__token"))
    held = own.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), F.col(value).cast("array<double>").alias("v")))).alias("f"))
    segments = written(held.select(F.col("__token").alias("token"), F.size("f").alias("n"), F.flatten(F.transform("f", lambda f: f["v"])).alias("x")), "segments")
    d = segments.select((F.size("x") / F.col("n")).cast("int").alias("d")).first()
    if d is None:
        return spark.createDataFrame([], MODEL)
    d = d["d"]
    cells = segments.select("token", "n", F.posexplode("x").alias("i", "v")).groupBy("token", (F.col("i") % d).alias("k")).agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    rows = cells.where(F.col("n") >= least).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("c")).collect()
    if len(rows) * states * d * (d + 1) * 8 > MODEL_BYTES:
        raise ValueError(f"{len(rows)} tokens of {d} dimensions make models of more than {MODEL_BYTES} bytes")
    centre = {r["token"]: np.array([c["v"] for c in r["c"]]) for r in rows}
    found, scores, live = {}, {}, set(centre)
    for done in range(rounds):
        if not live:
            break
        now = {t: [(m - centre[t], v) for m, v in found[t]] for t in live} if done else None
        part = segments.where(F.col("token").isin(sorted(live)))
        sums = sum_tree(part.mapInArrow(_sums(now, {t: centre[t] for t in live}, states), "block long, token string, state int, value array<double>"), ["token", "state"])
        by: dict = {}
        for r in sums.collect():
            by.setdefault(r["token"], {})[r["state"]] = np.array(r["value"])
        for t, own_sums in by.items():
            every = sum(own_sums.values())
            if done > 1 and every[1] - scores[t] < tol:
                live.discard(t)
                continue
            scores[t] = every[1]
            found[t] = []
            for s in range(states):
                v = own_sums[s] if own_sums[s][0] else every
                mean = v[2 : 2 + d] / v[0]
                cov = v[2 + d :].reshape(d, d) / v[0] - np.outer(mean, mean)
                found[t].append((mean + centre[t], cov + ridge * np.eye(d)))
    return spark.createDataFrame([(t, s, m.tolist(), c.ravel().tolist()) for t in sorted(found) for s, (m, c) in enumerate(found[t])], MODEL)


def join_models(sequence: DataFrame, models: DataFrame, utt: str = "utt", pos: str = "pos", token: str = "token") -> DataFrame:
    """Each utterance's chain: utt, state (numbered through), token, valid position, mean, cov.
    Tokens without a model are left out, the rest renumbered; transitions follow from the
    numbers and are never stored."""
    from pyspark.sql import Window

    known = sequence.join(models.select(F.col("token").alias(token)).distinct(), token, "left_semi")
    known = known.withColumn("valid", F.row_number().over(Window.partitionBy(utt).orderBy(pos)) - 1)
    out = known.join(models.withColumnRenamed("token", token).withColumnRenamed("state", "s"), token)
    return out.withColumn("state", F.col("valid") * STATES + F.col("s")).select(utt, "state", token, F.col("valid").alias("pos"), "mean", "cov")


def forced_alignment(frames: DataFrame, chains: DataFrame, utt: str = "utt", t: str = "t", value: str = "feat") -> DataFrame:
    """(utt, t, state): the best path of each utterance through its chain. An utterance is one
    recording, so its frames fit a task. Utterances without a chain have no rows."""

    def align(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({utt: [], "t": [], "state": []})
        x, y = x.sort_values(t), y.sort_values("state")
        feats = np.stack(x[value].to_numpy())
        d = feats.shape[1]
        log_b = np.stack([log_gaussian(feats, np.array(m), np.array(c).reshape(d, d)) for m, c in zip(y["mean"], y["cov"], strict=True)], axis=1)
        return pd.DataFrame({utt: key[0], "t": x[t].to_numpy(), "state": viterbi(log_b)})

    kind = dict(frames.dtypes)[utt]
    return frames.groupBy(utt).cogroup(chains.groupBy(utt)).applyInPandas(align, f"{utt} {kind}, t long, state int")
