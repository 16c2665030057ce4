"""Quality rules with risk-controlled thresholds: for each stratum, cutoffs of the
statistics together are tried from loose to strict on labelled holdouts; they stand
while an exact binomial test bounds the false rejection of good documents.

Guarantee. With probability 1 - DELTA over the holdout, every stratum loses at most
ALPHA of its good documents to the rules together. Several fixed sequences are tested
in each stratum. Those of joint cutoffs bound the documents that any of the statistics
rejects, by the whole ALPHA: the statistics one after the other in the grid's order (at
half of DELTA), in its rotations, and step by step in turn. One sequence for each
statistic alone, at ALPHA / their number, gives cutoffs that hold together by the union
bound. The sequences share DELTA (Bonferroni), also over strata; each ends at its
first failure, which needs no further correction. As all hold at once, the cutoffs that
reject most low-quality learning documents are taken. The grid is fixed, not read off the data.

Edge cases. Null text has no words and fails the base rule. A null stratum is a
stratum of its own; strata too small to certify a cutoff, or without labels, get none,
so nothing is rejected there. Documents without words have ratio 0. Very long texts are
counted whole. Repeated rows and copies are judged row by row, but are no independent trials: of rows
that repeat an id one is learned from, the one with the least statistics, and of a stratum's documents with the same
text one, good if any of them is (texts are told apart by a 128-bit hash). A label repeated for one
document counts once, by its lowest value. Empty tables give empty results. Further columns, of
whatever names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, learning_rows, small
from .textstats import COUNTS, statistics

ALPHA, DELTA = 0.01, 0.05
#: Cutoffs from loose to strict; a document is rejected above one.
GRID = {
    "symbols_per_word": (2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05),
    "dup_line_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeat_share": (0.19, 0.17, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04, 0.02, 0.01),
    "chars_per_word": (40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0),
}


def ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
}


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exact up to rounding."""
    if n == 0:
        return 1.0
    i = np.arange(0, k + 1)
    lg = np.array([math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i])
    return float(min(1.0, np.exp(lg + i * math.log(p) + (n - i) * math.log1p(-p)).sum()))


def certified(rejected: list[int], n: int, alpha: float, level: float) -> int:
    """How many cutoffs of a loose-to-strict sequence are certified: fixed-sequence testing."""
    for i, k in enumerate(rejected):
        if binomial_tail(int(k), int(n), alpha) > level:
            return i
    return len(rejected)


def places() -> list[dict[str, list[int]]]:
    """The joint sequences, the first one in the grid's order: where in it each statistic's cutoffs come."""
    names = list(GRID)
    out = []
    for k in range(len(names)):
        at = 0
        out.append({})
        for s in names[k:] + names[:k]:
            out[-1][s] = list(range(at, at + len(GRID[s])))
            at += len(GRID[s])
    turns = sorted((i, names.index(s), s) for s in names for i in range(len(GRID[s])))
    out.append({s: [at for at, t in enumerate(turns) if t[2] == s] for s in names})
    return out


def best_cutoffs(levels: np.ndarray, good: np.ndarray, bad: np.ndarray, alpha: float, delta: float) -> list[int]:
    """How many cutoffs of each statistic hold in a stratum. levels: by statistic, how many cutoffs of the
    grid a document stays within; good, bad: numbers of such documents."""
    n, joint = int(good.sum()), places()
    level = delta / 2 / (len(joint) - 1 + len(GRID))
    found = []
    for k, place in enumerate(joint):
        length = sum(map(len, GRID.values()))
        first = np.min([np.array([*place[s], length])[levels[:, j]] for j, s in enumerate(GRID)], axis=0)
        steps = certified(np.cumsum(np.bincount(first, good, length)[:length]).round().astype(int).tolist(), n, alpha, level if k else delta / 2)
        found.append([sum(at < steps for at in place[s]) for s in GRID])
    found.append([certified([int(good[levels[:, j] <= i].sum()) for i in range(len(cs))], n, alpha / len(GRID), level) for j, cs in enumerate(GRID.values())])
    return max(found, key=lambda c: (bad[(levels < np.array(c)).any(axis=1)].sum(), sum(c)))


def trials(labelled: DataFrame) -> DataFrame:
    """One row for each id, and of these one for each text of a stratum: stratum, quality and the ratios."""
    one = labelled.groupBy("doc_id").agg(F.min(F.struct(*RATIOS, "text_hash", "stratum", "quality")).alias("r")).select("r.*")
    return one.groupBy("stratum", "text_hash").agg(F.max("quality").alias("quality"), *[F.min(s).alias(s) for s in RATIOS]).drop("text_hash")


def thresholds(holdout: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """holdout: labelled documents that pass the base rule, with the ratios and quality. One row for
    each stratum: its cutoffs by name (null: none certified) and its number of good documents.
    Spark counts; only one row of counts for each stratum is tested."""
    # each cutoff that is kept narrows the next ones, so their number says which
    within = {s: sum((F.col(s) <= c).cast("int") for c in cs) for s, cs in GRID.items()}
    levels = holdout.select(F.col(stratum).alias("stratum"), (F.col("quality") == 1).alias("good"), *[w.alias(s) for s, w in within.items()])
    counts = levels.groupBy("stratum", *GRID).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    counted = counts.groupBy("stratum").agg(F.sum("good").alias("n"), F.collect_list(F.struct(*GRID, "good", "bad")).alias("rows")).where("n > 0")
    strata = holdout.where(F.col("quality") == 1).agg(F.count_distinct(F.coalesce(F.col(stratum).cast("string"), F.lit("\0null")))).first()[0]

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out, best = df[["stratum", "n"]].copy(), []
            for rows in df["rows"]:
                table = np.array([[r[x] for x in (*GRID, "good", "bad")] for r in rows], dtype=np.int64)
                best.append(best_cutoffs(table[:, :-2], table[:, -2], table[:, -1], alpha, delta / max(1, strata)))
            for j, (s, cs) in enumerate(GRID.items()):
                out[s] = [float(cs[b[j] - 1]) if b[j] else None for b in best]
                out[s] = out[s].astype("float64")
            yield out

    return counted.mapInPandas(test, f"stratum {dict(holdout.dtypes)[stratum]}, n long, " + ", ".join(f"{s} double" for s in GRID))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed, kept, stratum and the rules that rejected the
    document. The text is read once; labels meet the counts, never the text."""
    ws = Workspace(docs.sparkSession, "rules")
    same = F.struct(F.xxhash64(F.col(text)), F.xxhash64(F.col(text), F.lit(1)))
    stats = docs.select(F.col(doc_id).alias("doc_id"), F.col(stratum).alias("stratum"), same.alias("text_hash"), statistics(F.col(text)).alias("s"))
    stats = ws.write(stats.select("doc_id", "stratum", "text_hash", *[f"s.{c}" for c in COUNTS]), "stats")
    stats = stats.withColumns({k: ratio(a, b) for k, (a, b) in RATIOS.items()}).withColumn("base_failed", base_failed())
    learned = labels.where(learning_rows()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where(F.col("quality").isNotNull())
    cut = ws.write(thresholds(trials(stats.where(~F.col("base_failed")).join(learned, "doc_id")), "stratum", alpha, delta), "cutoffs")
    cut = cut.select(F.col("stratum").alias("__stratum"), *[F.col(s).alias(f"__{s}") for s in GRID])
    joined = stats.join(small(cut), stats["stratum"].eqNullSafe(cut["__stratum"]), "left")
    broken = F.array_compact(F.array(*[F.when(F.col(s) > F.col(f"__{s}"), F.lit(s)) for s in GRID]))
    return joined.select("doc_id", "stratum", *COUNTS, "base_failed", broken.alias("rules")).withColumn("kept", ~F.col("base_failed") & (F.size("rules") == 0))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
