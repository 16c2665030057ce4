"""Filter interaction audit: what each filter removes, keeps back from later ones and costs,
for every order of the filters and every part of the corpus.

One read of the texts gives each row a mask of the filters that it fails by itself and a
64-bit fingerprint. Duplicates (filter E) come from sorting: rows whose fingerprint occurs
under two ids or more are dealt by ranges of (fingerprint, id), so that a large group of
copies spans as many tasks as it needs, and sorted in each task by (fingerprint, text, id);
a row fails if the run of its text began at a smaller id. Only a range's first and last
fingerprint can go on in another range: for their texts each range leaves its smallest id
(under the text's SHA-256), and rows of a first fingerprint that found no smaller id in
their own range are held against those. Masks are merged as additive counters of (part,
mask, labels): all rows without E, less the rows that fail E, plus the same rows with it.
Sums over the 32 masks of a part give the figures of all 120 orders.

Edge cases. Null text is the empty text: no words, and identical to every empty text. A
null source is the part ''. Rows that repeat an id and a text all fail E or none does, as
only a smaller id counts; a null id neither fails E nor makes others fail. A document with
several label rows is good or toxic if one of them says so; labels of ids that are not
there count nowhere. Very long texts are read whole, one at a time. An empty table has no
parts and so no rows. Further columns, of whatever names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, small

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 2
DUPLICATE = 1 << FILTERS.index("E")
_upper = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_odd = re.compile("[#$%&*|]")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_FOUND = "kind int, doc_id long, part string, mask int, fp long, digest binary"
FAILS, OPEN, EDGE = 0, 1, 2


def mask_of(text: str) -> int:
    """Bits of the filters A to D that a text fails, bit 0 being A."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, _upper))
    return (len(words) < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1 | (100 * upper > MOST_UPPER * len(text)) << 2 | (_odd.search(text) is not None) << 3


def masks(text: Column) -> Column:
    """The masks of whole texts, which are not null."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([mask_of(t) for t in texts], dtype="int32")

    return run(text)


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range's rows in the order of fingerprint, text and id. Yields rows that fail E, rows of the
    first fingerprint that hold the smallest id of their text here, and the smallest ids of the
    texts of the first and the last fingerprint."""
    names = [c.split()[0] for c in _FOUND.split(", ")]
    fp = text = low = mask = None
    place, runs = 0, []  # which fingerprint of the range this is; its texts with their smallest ids here

    def edges():
        return [(EDGE, i, None, 0, fp, _digest(t)) for t, i in runs]

    for df in batches:
        out = []
        for f, t, i, part in zip(df["fp"].tolist(), df["text"], df["doc_id"].tolist(), df["part"], strict=True):
            if f != fp:
                out += edges() if place == 1 else []
                place, fp, text, runs = place + 1, f, None, []
            if text is None or t != text:
                text, low, mask = t, i, mask_of(t)
                runs.append((t, i))
            if i > low:
                out.append((FAILS, i, part, mask, f, None))
            elif place == 1:
                out.append((OPEN, i, part, mask, f, _digest(t)))
        yield pd.DataFrame(out, columns=names)
    yield pd.DataFrame(edges(), columns=names)


def duplicates(rows: DataFrame, ws: Workspace) -> DataFrame:
    """rows: doc_id, part, text, fp. The rows whose text a smaller id has: doc_id, part, mask of the
    filters A to D. Texts are moved only where their fingerprint has several ids."""
    ids = rows.where(F.col("doc_id").isNotNull())
    repeated = ids.groupBy("fp").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("fp")
    repeated = ws.write(repeated, "repeated")
    own = ids.join(small(repeated), "fp", "left_semi").select("fp", "text", "doc_id", "part")
    own = own.repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    found = ws.write(own.mapInPandas(_compare, _FOUND), "compared")
    smallest = found.where(F.col("kind") == EDGE).groupBy("fp", "digest").agg(F.min("doc_id").alias("low"))
    late = found.where(F.col("kind") == OPEN).join(smallest, ["fp", "digest"]).where("doc_id > low")
    return found.where(F.col("kind") == FAILS).select("doc_id", "part", "mask").unionByName(late.select("doc_id", "part", "mask"))


def _sums() -> np.ndarray:
    """For each order and step, which masks each figure sums: (orders * steps, figures, masks)."""
    out = np.zeros((len(ORDERS) * len(FILTERS), len(FIGURES), 1 << len(FILTERS)), dtype=np.int64)
    mask = np.arange(1 << len(FILTERS))
    bits = [1 << FILTERS.index(c) for c in FILTERS]
    for k, order in enumerate(ORDERS):
        before = 0
        for step, c in enumerate(order):
            own = bits[FILTERS.index(c)]
            fails, gone = mask & own > 0, mask & before > 0
            row = out[k * len(FILTERS) + step]
            row[0], row[1], row[2], row[3] = mask & (own | before) == 0, fails & ~gone, fails & gone, mask == own
            row[4] = row[5] = row[1]
            before |= own
    removed = {c: sum(out[k * len(FILTERS) + order.index(c), 1] for k, order in enumerate(ORDERS)) for c in FILTERS}
    for k, order in enumerate(ORDERS):
        for step, c in enumerate(order):
            out[k * len(FILTERS) + step, 6] = removed[c]
    return out


def _figures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums = _sums()
    orders, steps = np.repeat(ORDERS, len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
    for df in batches:
        for part, counts in zip(df["part"], df["counts"], strict=True):
            by = np.zeros((3, 1 << len(FILTERS)), dtype=np.int64)  # documents, good ones, toxic ones
            for c in counts:
                by[:, c["mask"]] += c["n"], c["good"], c["toxic"]
            weighed = [by[0]] * 4 + [by[1], by[2], by[0]]
            yield pd.DataFrame({"part": part, "filter_order": orders, "step": steps} | {name: sums[:, j] @ weighed[j] for j, name in enumerate(FIGURES)})


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step: part, filter_order, step and FIGURES."""
    ws = Workspace(docs.sparkSession, "audit")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"), F.xxhash64(body).alias("fp"))
    counts = ws.write(rows.select("doc_id", "part", "fp", masks(F.col("text")).alias("mask")), "masks")
    twice = duplicates(rows, ws)
    # a document that fails E moves from its mask to the mask with E
    moved = twice.select("doc_id", "part", F.explode(F.array(F.struct(F.col("mask"), F.lit(-1).alias("n")), F.struct((F.col("mask") + DUPLICATE).alias("mask"), F.lit(1).alias("n")))).alias("m"))
    every = counts.select("doc_id", "part", "mask", F.lit(1).alias("n")).unionByName(moved.select("doc_id", "part", "m.mask", "m.n"))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    every = every.join(said, "doc_id", "left")
    one = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    by = every.groupBy("part", "mask").agg(F.sum("n").alias("n"), one("good"), one("toxic"))
    # at most 32 masks a part
    return by.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts")).mapInPandas(_figures, "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIGURES))


def query(spark, sf_dir):
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def oracle() -> str:
    bit = " + ".join(f"CASE WHEN {c.lower()} THEN {1 << k} ELSE 0 END" for k, c in enumerate(FILTERS))
    return f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM t),
lab AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  len(words) < {LEAST_WORDS} AS a, 100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words) AS b,
  100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {MOST_UPPER} * length(text) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM w LEFT JOIN lab USING (doc_id)),
m AS (SELECT part, {bit} AS mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(c, v)),
o AS (SELECT p.c || q.c || r.c || s.c || z.c AS filter_order, [p.v, q.v, r.v, s.v, z.v] AS bits FROM l p, l q, l r, l s, l z
  WHERE len(list_distinct([p.c, q.c, r.c, s.c, z.c])) = 5),
st AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
x AS (SELECT part, filter_order, step, own,
  sum(CASE WHEN mask & CAST(own + before AS INTEGER) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & own > 0 AND mask & CAST(before AS INTEGER) = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & own > 0 AND mask & CAST(before AS INTEGER) > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & own > 0 AND mask & CAST(before AS INTEGER) = 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & own > 0 AND mask & CAST(before AS INTEGER) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, st GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM x
"""
