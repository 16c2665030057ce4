"""Mixing sources to target weights by the cube method.

A source's target says how often each of its words should be taken on average: `rate`
times. Every document is taken floor(rate) times, and once more with probability
rate - floor(rate). Which documents that are is drawn by the cube method: the vector of
probabilities moves at random, without drift, through the null-space of the balancing
constraints until nearly all entries are 0 or 1. The constraints are the source's words and
its number of documents, so both stay at their expected totals all the way. A move follows
the projection of one document's axis on the null-space: the largest undecided document is
decided while all smaller ones of its block give way a little, so that those left at the
end are the smallest. Each move decides one document at least.

Blocks of some BLOCK documents of a source, by hash, are drawn independently of each other;
each leaves two documents undecided, which form the blocks of the next round, until a source has
two. Of these the constraint on documents is given up first: a move that keeps the words
leaves one. It is decided together with exchanges of documents within the source's last
block, as long as they bring the words nearer to the target: the one step that is not drawn. Where none helps,
in sources of few documents, the last ones are balanced against each other in the same
rounds, on the words and documents of the whole mix. The landing problem is one document
left of the whole mix, drawn by its probability. So a source misses its target by less than one of its
documents, as a rule by a few words, and the mix by less than one of the last ones.

Every draw is a hash of the document and the round, and blocks and their order
go by hashes and sizes, so reruns agree, whatever the layout. Nothing but totals reaches the
driver; sources are a table, however many.

Edge cases. Null text has no words; a document without words takes part in the draw and gives 0
words. A null source is a source of its own, after all others. Rows that repeat an id are drawn
row by row, those that also repeat the size in one block; a null id is an id like others. Sources without words have target 0. An empty table gives an empty
result. Very long texts are counted whole. Further columns, of whatever names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recitary.operators.split import ranked_by

from .common import Workspace, small

# Fixed values of the mix: weights of the sources in turn, the mix's share of all words, the most that a source repeats.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
BLOCK, SEED = 512, 13
WORD = "[^\\x20\\x09-\\x0D]+"
_UNIT = "doc_id long, no_id boolean, size long, source_size long, target double, times int, source long, p double"
_NAMES = [c.split()[0] for c in _UNIT.split(", ")]


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source and size, the number of words of the whole text."""
    n = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), n.alias("size"))


def targets(sized: DataFrame, ws: Workspace, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row for each source: source, idx (its place by code point, from 0, null last), source_size, n, target.

    A source's target is min(most * its size, level * its weight); the level at which targets add up
    is found from below: sources above their cap are set to it and the rest shares what is left,
    until none is above. Each step is one sum over the table."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    named = ranked_by(by.where(F.col("source").isNotNull()), "source").withColumn("idx", F.col("rank") - 1).drop("rank", "total")
    last = by.where(F.col("source").isNull()).withColumn("idx", F.lit(-1).cast("long"))
    every = ws.write(named.unionByName(last.select(*named.columns)), "sources")
    count = every.where("idx >= 0").count()
    every = every.withColumn("idx", F.when(F.col("idx") < 0, F.lit(count)).otherwise(F.col("idx")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    every = every.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    total = every.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") <= level * F.col("weight")
        r = every.agg(F.count_if(over).alias("k"), F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("used"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if r["open"] is None or r["k"] == capped:
            break
        level, capped = (share * total - r["used"]) / r["open"], r["k"]
    return every.select("source", "idx", "source_size", "n", F.least("cap", level * F.col("weight")).alias("target"))


def _draw(round_: int, doc_id: int, size: int, place: int = 0) -> float:
    return (xxhash.xxh64_intdigest(f"{SEED} {round_} {int(doc_id)} {int(size)} {place}") >> 11) / float(1 << 53)


EDGE = 1e-12


def _move(p: np.ndarray, u: np.ndarray, draw: float) -> np.ndarray:
    """p moved along u or against it to the next face of the cube, at random so that its expectation
    stays. All of p lie between 0 and 1, so at least one more entry is 0 or 1 then."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up, down = np.where(u != 0, (1 - p) / np.abs(u), np.inf), np.where(u != 0, p / np.abs(u), np.inf)
    ahead, back = np.where(u > 0, up, down), np.where(u > 0, down, up)
    to, fro = ahead.min(), back.min()
    along = draw * (to + fro) < fro
    k = int(ahead.argmin() if along else back.argmin())
    out = p + (to if along else -fro) * u
    out[k] = 1.0 if (u[k] > 0) == along else 0.0
    out[out < EDGE] = 0.0
    out[out > 1 - EDGE] = 1.0
    return out


def _direction(size: np.ndarray) -> tuple[int, np.ndarray] | None:
    """The first unit that can move while the number and the sizes of all are kept, and the projection of its own
    axis on the null-space of both constraints. None if there is no move."""
    n = len(size)
    off = size - size.mean()
    square = float(off @ off)
    for k in range(n if n < 4 else 2):
        u = -off * (off[k] / square) - 1 / n if square > 1e-9 else np.full(n, -1 / n)
        u[k] += 1
        u[np.abs(u) < EDGE] = 0.0
        if np.abs(u).max() > 1e-9:
            return k, u
    return None


def _exchange(size: np.ndarray, p: np.ndarray, k: int, most: int = 32) -> None:
    """Decides the last unit k either way, and then exchanges a unit that was taken for one that was not, the
    best pair each time, as long as that comes nearer to the words; keeps the nearer result. Where no
    exchange helps, k stays undecided."""
    tries = []
    for first in (0.0, 1.0):
        own, off, done = p.copy(), float((first - p[k]) * size[k]), 0
        own[k] = first
        while done < most:
            taken, left = np.flatnonzero(own == 1), np.flatnonzero(own == 0)
            if not len(taken) or not len(left):
                break
            after = np.abs(off + size[left][None, :] - size[taken][:, None])
            i, j = np.unravel_index(after.argmin(), after.shape)
            if after[i, j] >= abs(off):
                break
            off += float(size[left[j]] - size[taken[i]])
            own[taken[i]], own[left[j]], done = 0.0, 1.0, done + 1
        tries.append((abs(off), done, own))
    off, done, own = min(tries, key=lambda t: t[0])
    if done:
        p[:] = own


def flight(size: np.ndarray, p: np.ndarray, doc_id: np.ndarray, round_: int, ends: str = "") -> np.ndarray:
    """Decides units, the first ones first, by moves that keep the sums of p and of size * p, until there is
    none. ends: what is given up then: nothing, the constraint on documents ('one'), or both ('none')."""
    p, step = p.copy(), 0
    while True:
        open_ = np.flatnonzero((p > 0) & (p < 1))
        found = _direction(size[open_]) if len(open_) > 1 else None
        if found is None:
            break
        k, u = found
        p[open_] = _move(p[open_], u, _draw(round_, doc_id[open_[k]], size[open_[k]], step))
        step += 1
    if ends and len(open_) == 2:
        a, b = size[open_]
        p[open_] = _move(p[open_], np.array([b, -a]) if a or b else np.array([1.0, -1.0]), _draw(round_, doc_id[open_[1]], b, step + 1))
        open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
    if ends == "one" and len(open_) == 1:
        _exchange(size, p, int(open_[0]))
    if ends == "none":
        for k in open_:
            p[k] = 1.0 if _draw(round_, doc_id[k], size[k], step + 2) < p[k] else 0.0
    return p


def _flights(round_: int, key: list[str], ends: str = "", block: int = BLOCK):
    """A mapInPandas function over units sorted by key. A key's units are decided together; of a key that has
    more than two blocks' units, two blocks at a time, what is left joining the next ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        now = None

        def decided(last: bool) -> Iterator[pd.DataFrame]:
            if not held:
                return
            df = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
            df["p"] = flight(df["size"].to_numpy(float), df["p"].to_numpy(float), df["doc_id"].to_numpy(), round_, ends if last else "")
            left = (df["p"] > 0) & (df["p"] < 1)
            held[:] = [] if last or not left.any() else [df[left]]
            yield df[_NAMES] if last else df[~left][_NAMES]

        for df in batches:
            if not len(df):
                continue
            # where the key changes in this batch
            at = np.flatnonzero((df[key].to_numpy()[1:] != df[key].to_numpy()[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *at], [*at, len(df)], strict=True):
                part = df.iloc[a:b]
                k = tuple(part.iloc[0][key])
                if now is not None and k != now:
                    yield from decided(True)
                now = k
                for i in range(0, len(part), block):
                    held.append(part.iloc[i : i + block])
                    if sum(map(len, held)) > 2 * block:
                        yield from decided(False)
        yield from decided(True)

    return run


def draw(units: DataFrame, ws: Workspace, block: int = BLOCK) -> DataFrame:
    """units (as _UNIT) with p 0 or 1: what p was not, the cube method decided."""
    undecided = (F.col("p") > 0) & (F.col("p") < 1)
    held = ws.write(units, "units")
    out, left, round_ = held.where(~undecided), held.where(undecided), 0
    for scope in ("source", "mix"):
        group = F.col("source") if scope == "source" else F.lit(0).cast("long")
        while True:
            left = left.withColumn("__g", group)
            # blocks by hash: as many as the group's size asks for
            groups = ws.write(left.groupBy("__g").agg(F.count("*").alias("__n")), f"groups{round_}")
            most, total = groups.agg(F.max("__n"), F.sum("__n")).first()
            if not most:
                break
            blocks = F.ceil(F.col("__n") / block)
            dealt = left.join(small(groups), "__g").withColumn("__b", F.pmod(F.xxhash64("doc_id", "size", F.lit(round_)), blocks))
            last = most <= block
            order = [F.desc("size"), F.xxhash64("doc_id", F.lit(SEED)), "doc_id"]
            # units are small rows: tasks are dealt by their number, not by their bytes
            dealt = dealt.repartition(-(-total // (64 * block)), "__g", "__b").sortWithinPartitions("__g", "__b", *order)
            ends = ("one" if scope == "source" else "none") if last else ""
            done = ws.write(dealt.mapInPandas(_flights(round_, ["__g", "__b"], ends, block), _UNIT), f"round{round_}")
            out, left = out.unionByName(done.where(~undecided)), done.where(undecided)
            round_ += 1
            if last:
                break
    return out


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken and times, how often the document is taken."""
    ws = Workspace(docs.sparkSession, "mix")
    sized = ws.write(sizes(docs, doc_id, text, source), "docs")
    by = ws.write(targets(sized, ws, weights, share, most), "targets")
    named = by.withColumnRenamed("source", "__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = sized.join(small(named), F.col("source").eqNullSafe(F.col("__source"))).withColumn("rate", rate).withColumn("times", F.floor("rate").cast("int"))
    # rows that repeat an id and a size are alike: their order has no bearing
    units = units.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "size", "source_size", "target", "times", F.col("idx").alias("source"), (F.col("rate") - F.col("times")).alias("p"))
    out = draw(units, ws, block)
    times = F.col("times") + F.col("p").cast("int")
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def query(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
