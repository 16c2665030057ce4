"""Near duplicates by min-max hashing: each of 64 permutations of the shingle hashes gives
its minimum and its maximum, so 128 signature values cost 64 evaluations. Bands of 4
values propose candidates; links are confirmed on full shingle sets.

Documents with equal shingle sets form a class and one link settles them; only classes
are compared. Every band value that several classes share is a bucket:
 1. each class is tried against one hub of its buckets, a link for each class;
 2. components of the confirmed links are found;
 3. in each bucket that still holds several components, every member is compared with the
    bucket's hub and written as its difference from it: the hub's shingles that it lacks, as bits,
    and its own further ones. Sizes of intersections follow from two differences
    exactly, so from here on no text is needed. The members of buckets of one hub are
    dealt to pairs of chunks of bounded size. A task compares those outside the hub's
    component with all others by products of 0/1 matrices, joins what it links at once
    and emits links only, never the pairs it tries.
So every pair that shares a band lies in one component or was compared on full sets. A pair at
the threshold shares one of 32 bands but for 5 in 10^8 cases. Members of the hub's component are never
paired with each other, so copies of one text cost no more than their number; members outside
of it, close to the hub but linked with nothing, cost some ten nanoseconds a pair.

Edge cases. Null or wordless texts have empty sets: linked with nothing, kept. A null
id can't be a component's id; a class of null ids only has a null component and its
rows are kept. Rows that repeat an id are each a row of the result; rows of the kept
id are all kept. Very long texts are shingled whole, 8 bytes for each distinct shingle. Only id
and text are read, so extra columns can't clash. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Workspace, small, word_hashes
from .components import connected_components

SHINGLE, THRESHOLD = 4, 80
PERMUTATIONS, ROWS = 64, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Most members of one chunk (a sixteenth of them, a quarter of CHUNK at least), and columns of a
#: matrix product (float32: 4 MB each).
CHUNK, COLUMNS = 1024, 1024

_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_B = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)[:, None]
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles_of(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word shingles, from the hashes of the words; the whole sequence
    as one if it is shorter."""
    if not len(h):
        return np.zeros(0, dtype=np.uint64)
    n = max(len(h) - size + 1, 1)
    out = np.full(n, np.uint64(min(len(h), size)), dtype=np.uint64)
    for k in range(min(size, len(h))):
        out += h[k : k + n] * _M[k]
    out = mix(out)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def shingle_sets(texts, size: int = SHINGLE) -> Iterator[np.ndarray]:
    return (shingles_of(h, size) for h in word_hashes(t if isinstance(t, str) else None for t in texts))


def signature(s: np.ndarray) -> np.ndarray:
    """64 minima, then 64 maxima, of the permuted high halves."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, 2**32 - 1, dtype=np.uint32)
    high = np.zeros(PERMUTATIONS, dtype=np.uint32)
    for i in range(0, len(x), 4096):
        v = _A * x[None, i : i + 4096] + _B
        low, high = np.minimum(low, v.min(1)), np.maximum(high, v.max(1))
    return np.concatenate([low, high])


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band, its number hashed in."""
    r = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _M[4]
    for k in range(ROWS):
        h = mix((h + r[:, k]) * _M[k])
    return h.view(np.int64)


def set_key(s: np.ndarray) -> bytes:
    """Names a shingle set in 16 bytes: two independent sums over its hashes and its size."""
    if not len(s):
        return b""
    size = np.array([len(s)], dtype=np.uint64) * _M[0]
    return np.r_[s.sum(keepdims=True) + size, mix(s ^ _M[4]).sum(keepdims=True)].astype("<u8").tobytes()


def _profile(size: int):
    return lambda batches: _profiles(batches, size)


def _profiles(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for df in batches:
        rows = []
        for s in shingle_sets(df["text"], size):
            if len(s):
                rows.append((len(s), set_key(s), bands(signature(s))))
            else:
                rows.append((0, b"", None))
        out = pd.DataFrame(rows, columns=["n", "key", "bands"])
        out.insert(0, "doc_id", df["doc_id"].astype("Int64").to_numpy())
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def linked(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _confirm(threshold: int, size: int):
    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([linked(a, b, threshold) for a, b in zip(shingle_sets(x, size), shingle_sets(y, size), strict=True)], dtype=bool)

    return run


def _rekeyed(size: int):
    """Rows whose text has the expected set: a repeated id may stand for several texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            ok = [set_key(s) == k for s, k in zip(shingle_sets(df["text"], size), df["node"], strict=True)]
            yield df.loc[ok, ["node", "text"]]

    return run


DELTA = "n long, hub_n long, lacks binary, extra binary, near boolean"


def delta(own: np.ndarray, hub: np.ndarray, threshold: int = THRESHOLD) -> tuple[int, int, bytes, bytes, bool]:
    """A set as its difference from a hub's: both sizes, a bit for each hub shingle that it lacks, its
    shingles that the hub lacks, and whether the two are linked."""
    lacks = np.ones(len(hub), dtype=bool)
    at = np.minimum(np.searchsorted(hub, own), len(hub) - 1)
    shared = hub[at] == own
    lacks[at[shared]] = False
    both = int(shared.sum())
    return len(own), len(hub), np.packbits(lacks).tobytes(), own[~shared].tobytes(), 100 * both >= threshold * (len(own) + len(hub) - both)


def _deltas(threshold: int, size: int):
    """Rows with text and hub_text -> the same rows with DELTA."""
    names = [x.split()[0] for x in DELTA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, hub = None, np.zeros(0, dtype=np.uint64)
        for df in batches:
            rows = []
            for own, hub_text in zip(shingle_sets(df["text"], size), df["hub_text"], strict=True):
                if hub_text != last:
                    last, hub = hub_text, next(shingle_sets([hub_text], size))
                rows.append(delta(own, hub, threshold))
            yield pd.concat([df[["hub", "node", "comp", "low"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return run


def intersections(lacks: list[bytes], extra: list[bytes], n: np.ndarray, hub_n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left and right members of one hub, exactly."""
    size = np.array([len(e) // 8 for e in extra], dtype=np.int64)
    present = (n - size).astype(np.float32)  # of the hub's shingles
    out = present[left][:, None] + present[right] - np.float32(hub_n)
    bits = np.frombuffer(b"".join(lacks), dtype=np.uint8).reshape(len(lacks), -1)
    for c in range(0, bits.shape[1], COLUMNS // 8):
        part = np.unpackbits(bits[:, c : c + COLUMNS // 8], axis=1)[:, : hub_n - 8 * c].astype(np.float32)
        out += part[left] @ part[right].T
    # further shingles: only those that a left and a right member have in common
    values = np.frombuffer(b"".join(extra), dtype=np.uint64)
    whose = np.repeat(np.arange(len(extra)), size)
    on = lambda members: np.unique(values[np.isin(whose, members)])
    kept = np.intersect1d(on(left), on(right), assume_unique=True)
    at = np.searchsorted(kept, values)
    ok = (at < len(kept)) & (kept[np.minimum(at, max(len(kept) - 1, 0))] == values) if len(kept) else np.zeros(len(values), dtype=bool)
    at, whose = at[ok], whose[ok]
    for c in range(0, len(kept), COLUMNS):
        part = np.zeros((len(extra), min(COLUMNS, len(kept) - c)), dtype=np.float32)
        here = (at >= c) & (at < c + COLUMNS)
        part[whose[here], at[here] - c] = 1
        out += part[left] @ part[right].T
    return out.round().astype(np.int64)


def link_members(both: np.ndarray, n: np.ndarray, comp: list, left: np.ndarray, right: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links that join the components of left and right members, one for each two components joined;
    both holds the sizes of their intersections."""
    number = {c: k for k, c in enumerate(dict.fromkeys(comp))}
    part = np.array([number[c] for c in comp])
    root = list(range(len(number)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ok = (100 * both >= threshold * (n[left][:, None] + n[right] - both)) & (part[left][:, None] != part[right])
    out = []
    for k in np.flatnonzero(ok.any(axis=1)).tolist():
        near = right[ok[k]]
        other, first = np.unique(part[near], return_index=True)
        for y, j in zip(other.tolist(), near[first].tolist(), strict=True):
            a, b = find(int(part[left[k]])), find(y)
            if a != b:
                root[a] = b
                out.append((int(left[k]), j))
    return out


def _join_chunks(threshold: int):
    """Rows sorted by (hub, pair): whole groups are compared; links come out. side is 0 for members of
    the pair's first chunk, 1 for those of its second, which is the first one again for a pair of equals."""

    def links(df: pd.DataFrame) -> list[tuple[bytes, bytes]]:
        side, low = df["side"].to_numpy(), df["low"].to_numpy()
        left = np.flatnonzero((side == 0) & low)
        right = np.flatnonzero(side == int(side.any()))
        if not len(left) or not len(right):
            return []
        n, node = df["n"].to_numpy(np.int64), df["node"].tolist()
        both = intersections(df["lacks"].tolist(), df["extra"].tolist(), n, int(df["hub_n"].iloc[0]), left, right)
        return [(min(node[i], node[j]), max(node[i], node[j])) for i, j in link_members(both, n, df["comp"].tolist(), left, right, threshold)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for df in batches:
            if not len(df):
                continue
            held.append(df)
            every = pd.concat(held, ignore_index=True) if len(held) > 1 else df
            hub, pair = every["hub"].map(bytes).to_numpy(), every["pair"].to_numpy()
            new = np.flatnonzero(np.r_[True, (hub[1:] != hub[:-1]) | (pair[1:] != pair[:-1])])
            out = [x for a, b in zip(new[:-1], new[1:], strict=True) for x in links(every.iloc[a:b])]
            held = [every.iloc[new[-1] :]]
            yield pd.DataFrame(out, columns=["a", "b"])
        if held:
            yield pd.DataFrame(links(held[0]), columns=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    ws = Workspace(spark, "minhash")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    profile = ws.write(docs.mapInPandas(_profile(size), "doc_id long, n long, key binary, bands array<long>"), "profile")
    classes = ws.write(
        profile.where(F.col("n") > 0).groupBy("key").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes"
    )
    # nodes are class keys: a class is there whatever its ids are
    member = classes.select(F.col("key").alias("node"), "n", F.posexplode("bands").alias("band", "value"))
    counted = member.groupBy("value").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    bucket = ws.write(member.join(counted, "value").select("value", "node", "n", "members"), "buckets")
    ws.sweep()
    # one order of all classes, so that the buckets of a family have few hubs
    order = F.struct(F.xxhash64("node"), "node")
    hubs = bucket.groupBy("value").agg(F.min_by("node", order).alias("hub"))
    proposed = bucket.join(hubs, "value").where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("shared")).groupBy("node").agg(F.max_by("hub", F.struct("shared", "hub")).alias("hub"))
    edges = proposed.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()

    def texts_of(nodes: DataFrame, name: str) -> DataFrame:
        """node, text of each class among nodes; the ids asked for are broadcast while they are few."""
        needed = ws.write(classes.join(nodes.distinct(), classes["key"] == nodes["node"], "left_semi").select("key", "first"), f"{name}-needed")
        fetched = docs.join(small(needed), F.col("doc_id").eqNullSafe(F.col("first"))).select(F.col("key").alias("node"), "text")
        return ws.write(fetched.mapInPandas(_rekeyed(size), "node binary, text string").dropDuplicates(["node"]), f"{name}-texts")

    edges = ws.write(edges, "hub-edges")
    texts = texts_of(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))), "hub")
    x = edges.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    x = x.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    links = ws.write(x.where(_confirm(threshold, size)("ta", "tb")).select("a", "b"), "hub-links")
    ws.drop("hub-texts")
    comp = connected_components(links, ws, "first")
    # what is left: buckets of several components, by their hubs. min_by sees each hub's component too
    placed = ws.write(bucket.join(comp, "node", "left").select("value", "node", F.coalesce("component", "node").alias("comp")), "placed")
    ws.drop("buckets")
    mixed = placed.groupBy("value").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min_by(F.struct("node", "comp"), order).alias("hub"))
    mixed = ws.write(mixed.where("x <> y").select("value", "hub"), "mixed")
    rest = placed.join(small(mixed, bound=BROADCAST_ROWS // 4), "value").select(F.col("hub.node").alias("hub"), "node", "comp", (F.col("comp") != F.col("hub.comp")).alias("low"))
    rest = ws.write(rest.where("node <> hub").distinct(), "rest")
    ws.drop("placed")
    texts = texts_of(rest.select("node").unionByName(rest.select(F.col("hub").alias("node"))), "rest")
    own = rest.join(texts, "node").join(texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text")), "hub")
    deltas = ws.write(own.mapInPandas(_deltas(threshold, size), f"hub binary, node binary, comp binary, low boolean, {DELTA}"), "deltas")
    ws.drop("rest-texts")
    ws.drop("rest")
    links = links.unionByName(deltas.where("low and near").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")))
    # who is linked with the hub is in its component by now
    member = deltas.withColumn("low", F.col("low") & ~F.col("near")).drop("near")
    sizes = member.groupBy("hub").agg(F.count_if("low").alias("lows"), F.count_if(~F.col("low")).alias("highs")).where("lows > 0")
    every = F.col("lows") + F.col("highs")
    most = F.least(F.greatest(every / 16, F.lit(max(1, CHUNK // 4))), F.lit(CHUNK))
    sizes = sizes.select("hub", (every <= CHUNK // 4).alias("one"), *[F.ceil(F.col(c) / most).cast("int").alias(c) for c in ("lows", "highs")])
    member = member.join(small(ws.write(sizes, "sizes")), "hub")
    # chunks 0.. of the members outside the hub's component, then those of the others
    h = F.xxhash64("node")
    chunk = F.when(F.col("one"), 0).when(F.col("low"), F.pmod(h, F.col("lows"))).otherwise(F.col("lows") + F.pmod(h, F.col("highs"))).cast("int")
    member = member.withColumn("chunk", chunk).withColumns({"lows": F.when(F.col("one"), 1).otherwise(F.col("lows")), "highs": F.when(F.col("one"), 0).otherwise(F.col("highs"))})
    # a low chunk meets every chunk, a high one the low ones
    other = F.explode(F.when(F.col("chunk") < F.col("lows"), F.sequence(F.lit(0), F.col("lows") + F.col("highs") - 1)).otherwise(F.sequence(F.lit(0), F.col("lows") - 1)))
    dealt = member.withColumn("other", other)
    pair = F.least("chunk", "other").cast("long") * (1 << 31) + F.greatest("chunk", "other")
    dealt = dealt.select("hub", pair.alias("pair"), (F.col("chunk") > F.col("other")).cast("int").alias("side"), "node", "comp", "low", "n", "hub_n", "lacks", "extra")
    dealt = dealt.repartition("hub", "pair").sortWithinPartitions("hub", "pair")
    found = ws.write(dealt.mapInPandas(_join_chunks(threshold), "a binary, b binary"), "rest-links")
    comp = connected_components(links.unionByName(found), ws, "second")
    # component ids: the smallest document id of all classes in one
    ids = classes.select(F.col("key").alias("node"), "first").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = ids.join(least, "component").select(F.col("node").alias("key"), "component_id")
    ids = ws.write(ids, "components")
    ws.keep_only("profile", "components")
    out = profile.select("doc_id", "n", "key").join(ids, "key", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs less every document whose group keeps another one. An id goes if none of its rows
    is kept; rows with a null id can't be named and stay. The dropped ids are broadcast while
    they are proven few, else joined."""
    judged = near_duplicates(docs, **options)
    gone = judged.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where(~F.col("kept")).select("doc_id")
    gone = Workspace(docs.sparkSession, "dropped").write(gone, "ids")
    return docs.join(small(gone, bound=BROADCAST_ROWS), "doc_id", "left_anti")


def query(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """All pairs that share a shingle, counted; for small tables only."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + {SHINGLE - 1}], ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.v = b.v AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {THRESHOLD} * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id <= coalesce(least, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""
