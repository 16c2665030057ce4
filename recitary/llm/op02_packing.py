"""Best-fit packing by hierarchical residuals: each partition packs its pieces best-fit,
nearly full bins are final, and a tree of merge rounds packs the underfull bins, as
items, again.

Edge cases. Null text counts as empty and gives one piece, the separator alone.
Repeated rows are packed once each. Empty tables give no pieces. Only id and text
are read, so extra columns can't clash. Texts of any length are tokenised in blocks cut
between words; only their ids are held whole. Bins that tie in free places are taken in
any order; the number of sequences is the same.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, small, span_hashes

CAPACITY = 2048
SEPARATOR = 0
#: Bins with at most this many free places are final.
SLACK = 4
#: Items that one task packs at a time (about 50 MB), and partitions a merge round joins.
TASK_ITEMS, FAN_IN = 200_000, 8
#: Characters tokenised at once (some 120 bytes of memory for each).
BLOCK = 1 << 18


class CachedTokenizer:
    """The tokenizer of a file, with its results remembered by piece in flat arrays, some 40 bytes
    for each. Words are cut at spaces and line feeds, across which its tokens never reach.
    Plain words are lower-cased and cut to pieces by its own pattern, over the bytes of
    many texts at once; all others go through it as they are and are one piece each.
    Pieces are known by 64-bit hashes."""

    #: Printable ASCII and Latin-1: composed already, and lower-cased alike everywhere.
    PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u00ff]*")
    PLAIN_BYTES = b"\n" + bytes([*range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])
    LOWER = bytes(range(256)).decode("latin-1").lower().encode("latin-1")
    #: The tokenizer's own pattern by kinds of characters: 's 't 're 've 'm 'll 'd, runs of letters, single
    #: numbers, runs of others. MARK stands for a word that isn't plain.
    SPACE, LETTER, NUMBER, SIGN, MARK = range(5)
    KIND = np.full(256, SIGN, dtype=np.uint8)
    KIND[[10, 32]] = SPACE
    KIND[list("abcdefghijklmnopqrstuvwxyz\u00aa\u00b5\u00ba".encode("latin-1")) + [x for x in range(0xDF, 0x100) if x != 0xF7]] = LETTER
    KIND[list("0123456789\u00b2\u00b3\u00b9\u00bc\u00bd\u00be".encode("latin-1"))] = NUMBER
    KIND[1] = MARK

    def __init__(self, path: str, limit: int = 1_000_000) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.parts = Tokenizer.from_file(path)
        self.parts.normalizer = normalizers.Sequence([])
        self.parts.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        """Empties the tables: sorted keys of pieces, their rows, and each row's ids in `flat`."""
        self.keys, self.rows = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.starts, self.flat = np.zeros(1, dtype=np.int64), np.zeros(0, dtype="<u4")

    def _learn(self, plain: list[str], other: list[str]) -> None:
        """Appends a row for each piece, the plain ones first."""
        found, sizes = [self.flat], []
        for i in range(0, len(plain), 200):
            part = plain[i : i + 200]
            ids = np.array(self.parts.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            assert len(ends) == len(part) and ends[-1] == len(ids), "a piece did not end with a word end"
            found.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        for i in range(0, len(other), 1000):
            own = [e.ids for e in self.whole.encode_batch_fast(other[i : i + 1000], add_special_tokens=False)]
            found.append(np.fromiter((x for ids in own for x in ids), dtype="<u4"))
            sizes.append(np.array([len(ids) for ids in own], dtype=np.int64))
        self.flat = np.concatenate(found)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])

    def _pieces(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of lower-cased plain bytes, which end with a line feed."""
        kind = self.KIND[b]
        new = np.r_[True, kind[1:] != kind[:-1]] | (kind == self.NUMBER) | (kind == self.MARK)
        # an apostrophe by itself takes the letters of a contraction from the run that follows
        q = np.flatnonzero(new & (b == ord("'")))
        q = q[kind[q + 1] == self.LETTER]
        one = q[np.isin(b[q + 1], list(b"stmd"))]
        two = q[np.isin(b[q + 1].astype(np.uint16) << 8 | b[q + 2], [x << 8 | y for x, y in (b"re", b"ve", b"ll")])]
        for own, n in ((one, 2), (two, 3)):
            new[own + 1] = False
            new[own + n] |= kind[own + n] == self.LETTER
        at = np.flatnonzero(new | (kind == self.SPACE))
        piece = np.flatnonzero(kind[at] != self.SPACE)
        return at[piece], at[piece + 1]

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts one after the other, and where each part's end."""
        raws, other = [], []
        for p in parts:
            try:
                raw = p.encode("latin-1")
                plain = not raw.translate(None, self.PLAIN_BYTES) and b"<|" not in raw
            except UnicodeEncodeError:
                plain = False
            if not plain:
                words = p.replace("\n", " ").split(" ")
                for i, w in enumerate(words):
                    if not self.PLAIN.fullmatch(w) or "<|" in w:
                        other.append(w)
                        words[i] = "\1"
                raw = " ".join(words).encode("latin-1")
            raws.append(raw + b"\n")
        low = b"".join(raws).translate(self.LOWER)
        b = np.frombuffer(low, dtype=np.uint8)
        start, end = self._pieces(b)
        keys = span_hashes(b, start, end)
        marked = np.flatnonzero(b[start] == 1)
        keys[marked] = [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"), 1) for w in other]
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > self.limit:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            own = first[new]
            from_other = b[start[own]] == 1
            new, own = np.r_[new[~from_other], new[from_other]], np.r_[own[~from_other], own[from_other]]
            n, k = len(self.starts) - 1, int((~from_other).sum())
            spans = zip(start[own[:k]].tolist(), end[own[:k]].tolist(), strict=True)
            self._learn([low[x:y].decode("latin-1") for x, y in spans], [other[i] for i in np.searchsorted(marked, own[k:]).tolist()])
            rows = np.zeros(len(distinct), dtype=np.int32)
            rows[new] = np.arange(n, n + len(new))
            self.keys = np.insert(self.keys, at[~known], distinct[~known])
            self.rows = np.insert(self.rows, at[~known], rows[~known])
            at = np.searchsorted(self.keys, distinct)
        row = self.rows[at][inverse]
        size = self.starts[row + 1] - self.starts[row]
        done = np.r_[0, np.cumsum(size)]
        ids = self.flat[np.repeat(self.starts[row] - done[:-1], size) + np.arange(done[-1])]
        return ids, done[np.searchsorted(start, np.cumsum([len(r) for r in raws]))]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes. Texts are taken up in blocks of
        about BLOCK characters; a longer one is cut between words."""
        held: list[str] = []
        whose: list[int] = []
        size = 0

        def blocks():
            for k, t in enumerate(texts):
                t, at = t or "", 0
                while len(t) - at > BLOCK:
                    cut = max(t.rfind(" ", at, at + BLOCK), t.rfind("\n", at, at + BLOCK))
                    if cut < at:
                        cut = min((x for x in (t.find(" ", at), t.find("\n", at)) if x >= 0), default=len(t))
                    yield k, t[at:cut]
                    at = cut
                    if not at < len(t):
                        break
                    at += 1
                yield k, t[at:]

        def encoded():
            ids, ends = self._encode(held)
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            return zip(whose, (raw[x:y] for x, y in zip([0, *ends], ends, strict=False)), strict=True)

        last: list[bytes] = []
        now = 0
        for k, part in blocks():
            held.append(part)
            whose.append(k)
            size += len(part)
            if size >= BLOCK:
                for j, raw in encoded():
                    if j != now:
                        yield b"".join(last)
                        last, now = [], j
                    last.append(raw)
                held, whose, size = [], [], 0
        if held:
            for j, raw in encoded():
                if j != now:
                    yield b"".join(last)
                    last, now = [], j
                last.append(raw)
        if texts:
            yield b"".join(last)


_tokenizers: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    """One for each Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = CachedTokenizer(path)
    return _tokenizers[path]


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit in falling order of size: each item's bin and offset, each bin's fill.
    The open bins are stacks by free places; a bit mask finds the least that suffices."""
    bins, offsets, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fit = mask >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                mask ^= 1 << free
        else:
            free, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left = free - size
        if left:
            if not stacks[left]:
                mask |= 1 << left
            stacks[left].append(b)
    return bins, offsets, np.array(fills, dtype=np.int64)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, fill long"


def _pieces(path: str, capacity: int, ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizer(path)
        base, made = TaskContext.get().partitionId() << 36, 0
        end = np.array([SEPARATOR], dtype="<u4").tobytes()
        rows: list[tuple] = []

        def packed() -> pd.DataFrame:
            nonlocal made
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids])
            bins, places, fills = best_fit(out["length"].to_numpy(np.int64), capacity)
            out["bin"], out["place"], out["fill"] = bins + base + made, places, fills[bins]
            out["doc_id"] = out["doc_id"].astype("Int64")
            made += len(fills)
            rows.clear()
            return out

        for df in batches:
            for doc, raw in zip(df["doc_id"].astype("Int64"), own.encode(df["text"].where(df["text"].notna(), None).tolist()), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    x = raw[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(x) // 4, zlib.crc32(x), *[x] * ids))
            if len(rows) >= TASK_ITEMS or ids and len(rows) >= 5_000:
                yield packed()
                # sent by now: what Arrow keeps for later goes back to the system
                pa.default_memory_pool().release_unused()
        if rows:
            yield packed()

    return run


def _merge(capacity: int, limit: int):
    """Best fit over bins as items; each row: bin, the bin it joins, its place there, the new fill."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def packed() -> pd.DataFrame:
            x = pd.concat(held, ignore_index=True).sort_values(["fill", "bin"], ascending=False, ignore_index=True)
            held.clear()
            b, places, fills = best_fit(x["fill"].to_numpy(np.int64), capacity)
            first = np.zeros(len(fills), np.int64)
            at = places == 0
            first[b[at]] = x["bin"].to_numpy(np.int64)[at]
            return pd.DataFrame({"bin": x["bin"], "root": first[b], "shift": places, "fill": fills[b]})

        for df in batches:
            held.append(df)
            if sum(map(len, held)) >= limit:
                yield packed()
        if held:
            yield packed()

    return run


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, and with ids=True the ids themselves as little-endian 32-bit bytes.

    The first round runs where the text is tokenised. Each later round deals the
    underfull bins to an eighth of the tasks, never fewer than hold TASK_ITEMS
    each, until one task has seen all or no fewer tasks would do; every bin left then
    is a sequence as it is, so nothing is dropped and no task's memory grows."""
    ws = Workspace(docs.sparkSession, "pack")
    made = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = PIECES.replace("ids_crc32 long,", "ids_crc32 long, ids binary,") if ids else PIECES
    tasks = made.rdd.getNumPartitions()
    pieces = ws.write(made.mapInPandas(_pieces(path, capacity, ids), schema), "pieces")
    moved = None
    open_bins = pieces.where((F.col("place") == 0) & (F.col("fill") < capacity - SLACK)).select("bin", "fill")
    k = 0
    while True:
        n = open_bins.count()
        fewer = max(-(-tasks // FAN_IN), -(-n // TASK_ITEMS))
        if n < 2 or k and fewer >= tasks:
            break
        tasks, k = fewer, k + 1
        step = ws.write(open_bins.repartition(tasks).mapInPandas(_merge(capacity, TASK_ITEMS), "bin long, root long, shift long, fill long"), f"round{k}")
        links = step.select("bin", "root", "shift")
        if moved is None:
            moved = links
        else:
            again = links.toDF("mid", "top", "more")
            moved = moved.join(again, moved["root"] == again["mid"], "left").select(
                "bin", F.coalesce("top", "root").alias("root"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
            )
        open_bins = step.where((F.col("shift") == 0) & (F.col("fill") < capacity - SLACK)).select("bin", "fill")
    if moved is not None:
        # few bins move, a handful for each batch of items: while they are broadcast, no ids are shuffled
        pieces = pieces.join(small(ws.write(moved, "moved")), "bin", "left").withColumns({"bin": F.coalesce("root", "bin"), "place": F.col("place") + F.coalesce("shift", F.lit(0))})
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids in order; packed must carry ids. A sequence is at most CAPACITY tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
