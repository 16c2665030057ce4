"""Benchmark decontamination with a generalised suffix automaton of the test items:
documents stream through it word by word, the longest match is tracked at each word,
and a document's word inside any occurrence of a window is hit.

A window is `window` consecutive words of an item; an item of fewer words, but not
none, is one window. The automaton is a linear-size machine of the whole benchmark;
it is broadcast only up to SHARD_BYTES of item text. A larger benchmark is dealt to
several automata by a hash of the item id, and documents pass them one after another.

Edge cases. Null texts have no words. Items without words have no window; items with
a null id count for hits, not for the list. Repeated items count once. Repeated
documents are judged row by row. Empty tables give no hits or no rows. Extra columns
of the documents pass through; one named hit is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

WINDOW = 10
#: Item text that one automaton may hold (some 190 bytes of memory for each).
SHARD_BYTES = 4_000_000
#: Spans are cut from a text; a document hit to a larger share is left out.
MAX_COVERAGE = 0.5

_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 97 <= c <= 122 or 65 <= c <= 90 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def folded(text: str | None) -> bytes:
    """UTF-8 bytes, byte for byte: A-Z lower-cased, everything below \\x80 but letters and digits a space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


class Automaton:
    """States are parallel lists: longest length, suffix link, transitions by word id,
    and the windows that end there as (length, item ids), those of suffix links included."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.length, self.link, self.next = [0], [-1], [{}]
        words = []
        for item, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary)) for x in folded(text).split()]
            if w:
                words.append((None if item is None else str(item), w))
                self._add(w)
        found: list[dict[int, set[str]]] = [{} for _ in self.length]
        for item, w in words:
            self._mark(found, item, w)
        self.out: list[list[tuple[int, frozenset[str]]]] = [[] for _ in self.length]
        for v in sorted(range(len(self.length)), key=self.length.__getitem__):
            above = self.out[self.link[v]] if v else []
            self.out[v] = [(m, frozenset(s)) for m, s in sorted(found[v].items())] + above
        self.shortest = min((m for f in found for m in f), default=0)
        self._pairs(words)

    def _add(self, word_ids: list[int]) -> None:
        """Appends one item: the online construction, restarted at the root, where a
        transition that exists already is reused or its state split."""
        last = 0
        for c in word_ids:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            cur = self._state(self.length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = cur

    def _state(self, length: int) -> int:
        self.length.append(length)
        self.link.append(0)
        self.next.append({})
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1)
        self.link[clone], self.next[clone] = self.link[q], dict(self.next[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _mark(self, found: list, item: str | None, w: list[int]) -> None:
        m, v = min(self.window, len(w)), 0
        for i, c in enumerate(w):
            v = self.next[v][c]
            if i + 1 >= m:
                while self.length[self.link[v]] >= m:
                    v = self.link[v]
                found[v].setdefault(m, set()).update(() if item is None else (item,))

    def _pairs(self, words: list) -> None:
        """A bit table of hashed word pairs that items hold: a cheap necessary condition for a match."""
        bits = max(16, (sum(len(w) for _, w in words) * 32).bit_length())
        self.pair_mask = (1 << bits) - 1
        self.pairs = np.zeros(1 << bits, dtype=bool)
        for _, w in words:
            a = np.array(w, dtype=np.int64)
            self.pairs[self._code(a[:-1], a[1:])] = True

    def _code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 2654435761 + b * 40503) & self.pair_mask

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words that might hold a window: every other word has no match that reaches `shortest`."""
        ok = ids >= 0
        if self.shortest > 1:
            pair = ok[:-1] & ok[1:]
            pair[pair] = self.pairs[self._code(ids[:-1][pair], ids[1:][pair])]
            edge = np.flatnonzero(np.diff(np.r_[0, pair.view(np.int8), 0]))
            return [(a, b + 1) for a, b in edge.reshape(-1, 2).tolist() if b + 1 - a >= self.shortest]
        edge = np.flatnonzero(np.diff(np.r_[0, ok.view(np.int8), 0]))
        return [tuple(x) for x in edge.reshape(-1, 2).tolist()]

    def stream(self, raw: bytes) -> tuple[int, list[tuple[int, int]], set[str], int]:
        """Of folded text: words, hit runs of words (ends exclusive), items met, longest match."""
        words = raw.split()
        if not self.shortest or len(words) < self.shortest:
            return len(words), [], set(), 0
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        hits: list[list[int]] = []
        items: set[str] = set()
        most = 0
        for a, b in self._runs(ids):
            v = n = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while v and c not in self.next[v]:
                    v = self.link[v]
                    n = self.length[v]
                if c in self.next[v]:
                    v, n = self.next[v][c], n + 1
                most = max(most, n)
                for m, found in self.out[v]:
                    if m <= n:
                        items |= found
                        if hits and i + 1 - m <= hits[-1][1]:
                            hits[-1][1] = i + 1
                            hits[-1][0] = min(hits[-1][0], i + 1 - m)
                            while len(hits) > 1 and hits[-2][1] >= hits[-1][0]:
                                x = hits.pop()
                                hits[-1] = [min(hits[-1][0], x[0]), x[1]]
                        else:
                            hits.append([i + 1 - m, i + 1])
        return len(words), [tuple(h) for h in hits], items, most


HIT = "n_words long, longest long, runs array<struct<a:long,b:long>>, items array<string>"


def _scan(broadcast):
    @F.pandas_udf(HIT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto = broadcast.value
        for texts in batches:
            rows = []
            for t in texts:
                n, runs, items, most = auto.stream(folded(t if isinstance(t, str) else None))
                rows.append((n, most, [{"a": a, "b": b} for a, b in runs], sorted(items)))
            yield pd.DataFrame(rows, columns=["n_words", "longest", "runs", "items"])

    return run


def _merged():
    """Arrow UDF: what two automata found of the same text."""

    @F.pandas_udf(HIT)
    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for n, p, q, r1, r2, i1, i2 in zip(x["n_words"], x["longest"], y["longest"], x["runs"], y["runs"], x["items"], y["items"], strict=True):
            runs: list[list[int]] = []
            for a, b in sorted((r["a"], r["b"]) for r in [*r1, *r2]):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            rows.append((n, max(p, q), [{"a": a, "b": b} for a, b in runs], sorted({*i1, *i2})))
        return pd.DataFrame(rows, columns=["n_words", "longest", "runs", "items"])

    return run


def _cleaned(broadcast):
    """Arrow UDF: words and hit words of a text, and the text cut until the automaton hits nothing in it."""

    @F.pandas_udf("n_words long, n_hit long, text string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto = broadcast.value
        for texts in batches:
            rows = []
            for t in texts:
                t = t if isinstance(t, str) else None
                n, runs, _, _ = auto.stream(folded(t))
                hit = sum(b - a for a, b in runs)
                while runs:
                    t = cut_runs(t, runs)
                    runs = auto.stream(folded(t))[1]
                rows.append((n, hit, t))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "text"])

    # else a filter on its result would run it once more
    return run.asNondeterministic()


def cut_runs(text: str | None, runs: list[tuple[int, int]]) -> str | None:
    """The text without the hit runs of words, a line feed in the place of each."""
    if not runs or text is None:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(folded(text))]
    out, done = [], 0
    for a, b in runs:
        out += [raw[done : at[a][0]], b"\n"]
        done = at[b - 1][1]
    return b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")


def automata(items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> list:
    """The benchmark as broadcast automata, each of at most about shard_bytes of item text."""
    spark = items.sparkSession
    items = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(1, -(-2 * total // shard_bytes)) if total > shard_bytes else 1
    out = []
    for k in range(shards):
        part = items if shards == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == k)
        out.append(spark.sparkContext.broadcast(Automaton([(r["i"], r["t"]) for r in part.distinct().toLocalIterator()], window)))
    return out


def match(docs: DataFrame, autos: list, text: str = "text") -> DataFrame:
    """docs with a struct column `hit`: n_words, longest, runs and items. A column of that name is replaced."""
    ws, out = Workspace(docs.sparkSession, "decontaminate"), docs
    for k, auto in enumerate(autos):
        found = _scan(auto)(F.col(text))
        out = out.withColumn("hit" if k == 0 else "__more", found)
        if k:
            out = out.withColumn("hit", _merged()(F.col("hit"), F.col("__more"))).drop("__more")
        if k < len(autos) - 1:
            out = ws.write(out, f"shard{k}")
            if k:
                ws.drop(f"shard{k - 1}")
    return out


def hit_words():
    return F.aggregate("hit.runs", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])


def decontaminate(docs: DataFrame, autos: list, text: str = "text", max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """docs with every hit run cut from the text; documents hit beyond max_coverage of
    their words are left out. What a cut brings together may form a window again, so
    texts are cut until nothing is hit: in one pass for one automaton, else in rounds.
    A column named hit is replaced and dropped."""
    if len(autos) == 1:
        out = docs.withColumn("hit", _cleaned(autos[0])(F.col(text))).where(F.col("hit.n_hit") <= max_coverage * F.col("hit.n_words"))
        return out.withColumn(text, F.col("hit.text")).drop("hit")
    out = match(docs, autos, text).where(hit_words() <= max_coverage * F.col("hit.n_words")).drop("hit")
    ws, k = Workspace(docs.sparkSession, "cut"), 0
    while True:
        before = out.withColumn("__before", F.col(text))
        for auto in autos:
            before = before.withColumn(text, _cleaned(auto)(F.col(text))["text"])
        step = ws.write(before, f"round{k}")
        if k:
            ws.drop(f"round{k - 1}")
        out, k = step.drop("__before"), k + 1
        if step.where(~F.col(text).eqNullSafe(F.col("__before"))).isEmpty():
            return out


def query(spark, sf_dir):
    out = match(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), automata(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    n_hit = hit_words()
    return out.select(
        "doc_id",
        F.col("hit.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hit.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit.items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def oracle() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
i AS (SELECT item_id, w, least({WINDOW}, len(w)) AS m FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS v FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM i)),
dw AS (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS v
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM i) WHERE len(w) >= m)),
h AS (SELECT doc_id, m, k, item_id FROM dw JOIN iw USING (m, v)),
p AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""
