"""Exact repeated substrings over all texts, by the common-prefix interval tree of an
enhanced suffix array. Every byte covered by a string of `length` bytes that starts
anywhere else too is removed.

How the suffix array is dealt out. Of each window of `length` bytes the k-gram with the
least hash is its anchor, so equal windows have equal anchors at equal places, and it is
enough to sort the suffixes that start at anchors. An anchor's segment is what any window
around it can reach: length - gram bytes to its left, `length` from it on.
 1. Anchors that occur once in all texts go: no repeat passes through them.
 2. Equal segments collapse to one suffix with a count; from two on they are repeats whole.
 3. Where an anchor has different segments, these are sorted by what follows the anchor;
    the stack scan over the common prefixes of neighbours walks the interval tree, and
    within each interval (common prefix r) the left contexts are sorted to find each
    occurrence's longest common left extension l with another one. l + r >= length
    is a maximal repeat, reported for every occurrence, not for neighbours only.
An anchor with more than GROUP different segments is not sorted in one task: its windows
are counted by Spark instead, with partial aggregation. No text is broadcast or collected.

Edge cases. Null text has no bytes. Texts shorter than `length` lose nothing. Rows that
repeat id and text are documents of their own, and so repeat each other; a null id is a
value like any other. Texts of any length are cut into overlapping blocks. Empty
tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, mix64, powers, prefix_sums, small

LENGTH, GRAM = 200, 48
#: Different segments of one anchor that one task sorts (about 20 MB), and segments it takes up at a time.
GROUP, BATCH = 50_000, 20_000
#: Anchors up to which their hashes are broadcast (some 130 bytes each in memory); beyond, a join splits the frequent ones.
ANCHORS = 100_000
#: k-gram starts hashed at once.
BLOCK = 1 << 18

def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by running minima from both ends of blocks of w."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors, hashes of their k-grams, and hashes of their segments."""
    reach = length - gram
    if len(raw) < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    out: list[tuple[np.ndarray, ...]] = []
    last = len(raw) - length + 1  # window starts
    for s in range(0, last, BLOCK):
        e = min(s + BLOCK, last)
        # the segments of this block's anchors reach `reach` to the left and `length` beyond its last gram
        lo, hi = max(0, s - reach), min(len(raw), e + length + length)
        b = np.frombuffer(raw, dtype=np.uint8, count=hi - lo, offset=lo)
        total, down = prefix_sums(b), powers(len(b) + 1)[1]
        grams = e - 1 - s + length - gram + 1
        i = np.arange(s - lo, s - lo + grams)
        h = mix64((total[i + gram] - total[i]) * down[i])
        # equal least hashes: the rightmost, whatever surrounds the window
        place = np.uint64((1 << 20) - 1)
        packed = (h & ~place) | (place - np.arange(grams, dtype=np.uint64))
        at = np.unique((place - (sliding_min(packed, reach + 1) & place)).astype(np.int64))
        pos = at + s
        left, right = np.maximum(pos - reach, 0) - lo, np.minimum(pos + length, len(raw)) - lo
        seg = (total[right] - total[left]) * down[left]
        seg = mix64(seg + mix64((pos - lo - left).astype(np.uint64) * np.uint64(1 << 20) + (right - left).astype(np.uint64)))
        out.append((pos, h[at].view(np.int64), seg.view(np.int64)))
    pos, h, seg = (np.concatenate(x) for x in zip(*out, strict=True))
    pos, first = np.unique(pos, return_index=True)
    return pos, h[first], seg[first]


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    return start[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]


OCCURRENCES = "h long, seg long, id long, mark long, place long, k int, stop long"


def _occurrences(length: int, gram: int):
    """Rows (h, seg, document, place, k): one for each document and segment, k = 2 if the document
    repeats it. Those repeats are settled here and come as rows with h null: place to stop."""
    reach = length - gram

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in OCCURRENCES.split(", ")]
        for df in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            spans: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            for raw, doc, mark in zip(df["raw"], df["id"], df["mark"], strict=True):
                if raw is None or len(raw) < length:
                    continue
                pos, h, seg = anchors(raw, length, gram)
                order = np.lexsort((pos, seg, h))
                pos, h, seg = pos[order], h[order], seg[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (seg[1:] != seg[:-1])]
                size = np.diff(np.r_[np.flatnonzero(new), len(pos)])
                if (size > 1).any():
                    own = np.repeat(size > 1, size)
                    a, b = np.maximum(pos[own] - reach, 0), np.minimum(pos[own] + length, len(raw))
                    a, b = merge_spans(a, b)
                    spans.append((doc, mark, a, b))
                n = int(new.sum())
                for c, v in zip(cols, (h[new], seg[new], np.full(n, doc), np.full(n, mark), pos[new], np.minimum(size, 2)), strict=True):
                    c.append(v)
            if cols[0]:
                h, seg, doc, mark, pos, k = (np.concatenate(c) for c in cols)
                yield pd.DataFrame({"h": pd.array(h, dtype="Int64"), "seg": seg, "id": doc, "mark": mark, "place": pos, "k": k.astype(np.int32), "stop": pos}, columns=names)
            if spans:
                size = [len(s[2]) for s in spans]
                a, b = np.concatenate([s[2] for s in spans]), np.concatenate([s[3] for s in spans])
                doc, mark = np.repeat([s[0] for s in spans], size), np.repeat([s[1] for s in spans], size)
                yield pd.DataFrame({"h": pd.array([None] * len(a), dtype="Int64"), "seg": 0, "id": doc, "mark": mark, "place": a, "k": np.int32(0), "stop": b}, columns=names)

    return run


def _first_difference(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of padded rows."""
    differ = a != b
    at = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    return np.minimum(at, np.minimum(la, lb))


def _padded(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts], dtype=np.int64)
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), dtype=np.uint8).reshape(-1, width), size


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """The interval tree of a suffix array by a stack scan: (common prefix, first, last), children
    before parents. lcp[i] belongs to suffixes i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, x in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > x:
            value, first = stack.pop()
            yield value, first, i
        if x >= 0 and (not stack or stack[-1][0] < x):
            stack.append((x, first))


def repeats(groups: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each suffix the maximal repeats it occurs in, as (left, right) extents from its
    anchor. lefts are reversed left contexts; only suffixes of one group are compared."""
    m = len(rights)
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    order = sorted(range(m), key=lambda i: (groups[i], rights[i]))
    g = groups[order]
    r, rn = _padded([rights[i] for i in order], max(map(len, rights), default=1) or 1)
    l, ln = _padded([lefts[i] for i in order], max(map(len, lefts), default=1) or 1)  # noqa: E741
    same = g[1:] == g[:-1]
    lcp = np.where(same, _first_difference(r[1:], r[:-1], rn[1:], rn[:-1]), -1)
    bounds = np.flatnonzero(np.r_[True, ~same, True])
    size = np.diff(bounds)
    # groups of two are one interval each: all at once
    two = bounds[:-1][size == 2]
    ext = _first_difference(l[two], l[two + 1], ln[two], ln[two + 1])
    for i, a, b in zip(two.tolist(), ext.tolist(), lcp[two].tolist(), strict=True):
        if a + b >= length:
            out[order[i]].append((a, b))
            out[order[i + 1]].append((a, b))
    for s, n in zip(bounds[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
        for value, first, last in intervals(lcp[s : s + n - 1].tolist()):
            own = np.arange(s + first, s + last + 1)
            own = own[np.lexsort(l[own].T[::-1])]  # neighbours by left context
            near = _first_difference(l[own[1:]], l[own[:-1]], ln[own[1:]], ln[own[:-1]])
            best = np.maximum(np.r_[near, 0], np.r_[0, near])
            for k in np.flatnonzero(best + value >= length).tolist():
                out[order[own[k]]].append((int(best[k]), value))
    return out


def _sort_segments(length: int):
    """Rows sorted by h: batches of whole groups go through the suffix array; spans of single segments come out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def spans(df: pd.DataFrame) -> pd.DataFrame:
            cut = df["cut"].to_numpy()
            lefts = [s[:c][::-1] for s, c in zip(df["bytes"], cut, strict=True)]
            rights = [s[c:] for s, c in zip(df["bytes"], cut, strict=True)]
            found = repeats(df["h"].to_numpy(), lefts, rights, length)
            rows = [(d, m, p - a, p + b) for d, m, p, n, f in zip(df["id"], df["mark"], df["place"], df["n"], found, strict=True) if n == 1 for a, b in f]
            return pd.DataFrame(rows, columns=["id", "mark", "place", "stop"], dtype="int64")

        held, size = [], 0
        for df in batches:
            held.append(df)
            size += len(df)
            if size >= BATCH:
                every = pd.concat(held, ignore_index=True)
                whole = every["h"] != every["h"].iloc[-1]
                held, size = [every[~whole]], int((~whole).sum())
                if whole.any():
                    yield spans(every[whole])
        if size:
            yield spans(pd.concat(held, ignore_index=True))

    return run


def _cut_segments(length: int, gram: int):
    """From each text the segments asked for: wanted holds (h, place, n, groups)."""
    reach = length - gram

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for raw, doc, mark, wanted in zip(df["raw"], df["id"], df["mark"], df["wanted"], strict=True):
                for w in wanted:
                    a = max(0, w["place"] - reach)
                    rows.append((w["h"], doc, mark, w["place"], w["n"], w["groups"], w["place"] - a, raw[a : w["place"] + length]))
            yield pd.DataFrame(rows, columns=["h", "id", "mark", "place", "n", "groups", "cut", "bytes"])

    return run


def _windows(length: int):
    """All windows of the segments of hot anchors, by 128-bit hashes; the anchor and its place
    in the window tell apart what several anchors of one window report of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for h, doc, mark, place, n, cut, s in zip(df["h"], df["id"], df["mark"], df["place"], df["n"], df["cut"], df["bytes"], strict=True):
                for a in range(0, min(cut, len(s) - length) + 1):
                    x = hashlib.blake2b(s[a : a + length], digest_size=16).digest()
                    rows.append((h, cut - a, int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True), doc, mark, place - cut + a, n))
            yield pd.DataFrame(rows, columns=["h", "rel", "x", "y", "id", "mark", "place", "n"])

    return run


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove(raw: bytes, spans) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal removed runs."""
    if spans is None or not len(spans):
        return raw, 0
    v = np.asarray(spans, dtype=np.int64)
    start, end = merge_spans(v >> 32, v & 0xFFFFFFFF)
    keep = np.r_[0, end], np.r_[start, len(raw)]
    return b"".join(raw[a:b] for a, b in zip(*keep, strict=True)), len(start)


def digest():
    """Arrow UDF: the text's bytes and its spans -> n_bytes, n_removed, n_spans, kept_sha256."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            rows = []
            for raw, s in zip(texts, spans, strict=True):
                raw = raw or b""
                kept, n = remove(raw, s)
                rows.append((len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _keys(raw: Column, doc_id: Column) -> list[Column]:
    """A row's name, the same for rows that repeat id and text: the id, and a hash of the text."""
    return [F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id"), F.xxhash64(raw, doc_id.isNull()).alias("mark")]


def repeated_spans(docs: DataFrame, ws: Workspace, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """docs (id, mark, raw): id, mark and spans, an array of start * 2^32 + end, not merged."""
    found = ws.write(docs.mapInPandas(_occurrences(length, gram), OCCURRENCES), "occurrences")
    once = found.where(F.col("h").isNotNull()).select("h", "seg", "id", "mark", "place", "k")
    # written, so that the join's sides are plain exchanges, whose skewed partitions Spark splits
    often = ws.write(once.groupBy("h").agg(F.sum("k").alias("c")).where(F.col("c") > 1).select("h"), "often")
    shared = ws.write(once.join(small(often, bound=ANCHORS), "h", "left_semi"), "shared")
    ws.sweep()
    # one row for each different segment of a shared anchor, with one of its places
    segs = shared.groupBy("h", "seg").agg(F.sum("k").alias("n"), F.min(F.struct("id", "mark", "place")).alias("at"))
    segs = ws.write(segs, "segments")
    whole = segs.where(F.col("n") > 1).select("h", "seg")
    mixed = ws.write(segs.groupBy("h").agg(F.count("*").alias("groups")).where(F.col("groups") > 1), "mixed")
    wanted = segs.join(small(mixed, bound=ANCHORS), "h").select("at.id", "at.mark", F.struct("h", "at.place", F.col("n"), F.col("groups")).alias("w"))
    wanted = wanted.groupBy("id", "mark").agg(F.collect_list("w").alias("wanted"))
    # rows that repeat id and text give the same segments; one of them is enough
    cut = docs.join(wanted.hint("merge"), ["id", "mark"]).select("raw", "id", "mark", "wanted")
    schema = "h long, id long, mark long, place long, n long, groups long, cut int, bytes binary"
    cut = ws.write(cut.mapInPandas(_cut_segments(length, gram), schema).dropDuplicates(["h", "id", "mark", "place"]), "cut")
    ws.sweep()
    span = "id long, mark long, place long, stop long"
    sorted_ = cut.where(F.col("groups") <= group).repartition("h").sortWithinPartitions("h").mapInPandas(_sort_segments(length), span)
    window = cut.where(F.col("groups") > group).mapInPandas(_windows(length), "h long, rel int, x long, y long, id long, mark long, place long, n long")
    key = ["h", "rel", "x", "y"]
    again = window.groupBy(*key).agg(F.sum("n").alias("c")).where(F.col("c") > 1).select(*key)
    hot = window.join(again, key, "left_semi").select("id", "mark", "place", (F.col("place") + length).alias("stop"))
    reach = length - gram
    copied = shared.join(whole, ["h", "seg"], "left_semi").select("id", "mark", F.greatest(F.col("place") - reach, F.lit(0)).alias("place"), (F.col("place") + length).alias("stop"))
    own = found.where(F.col("h").isNull()).select("id", "mark", "place", "stop")
    spans = own.unionByName(copied).unionByName(sorted_).unionByName(hot)
    return spans.groupBy("id", "mark").agg(F.collect_list(F.col("place") * (1 << 32) + F.col("stop")).alias("spans"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """One row for each row of docs: doc_id, the text's bytes as raw, and spans."""
    ws = Workspace(docs.sparkSession, "substrings")
    raw = F.col(text).cast("binary")
    own = docs.select(F.col(doc_id).alias("doc_id"), raw.alias("raw"), *_keys(raw, F.col(doc_id)))
    spans = ws.write(repeated_spans(own.select("id", "mark", "raw"), ws, length, gram, group), "spans")
    ws.keep_only("spans")
    ws.sweep()
    return own.join(spans.hint("merge"), ["id", "mark"], "left").select("doc_id", "raw", "spans")


def query(spark, sf_dir):
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", digest()("raw", "spans").alias("d")).select("doc_id", "d.*")


def oracle() -> str:
    """Every window of every text by its md5, over hexadecimal texts; for small tables only."""
    return f"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
b AS (SELECT doc_id, j, least(256, n - 256 * j) AS n, substr(h, 512 * j + 1, {512 + 2 * LENGTH}) AS h
      FROM (SELECT doc_id, h, n, unnest(range(0, (n + 255) // 256)) AS j FROM (SELECT doc_id, h, len(h) // 2 - {LENGTH - 1} AS n FROM d) WHERE n > 0)),
w AS (SELECT doc_id, 256 * j + o AS i, md5(substr(h, 2 * o + 1, {2 * LENGTH})) AS v FROM (SELECT doc_id, j, h, unnest(range(0, n)) AS o FROM b)),
r AS (SELECT v FROM w GROUP BY v HAVING count(*) > 1),
p AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM w SEMI JOIN r USING (v)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM p),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + {LENGTH} AS b FROM g GROUP BY ALL),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
t AS (SELECT doc_id, count(*) AS n, sum(b - a) AS removed,
        string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
      FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)"""
