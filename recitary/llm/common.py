"""Helpers the operators share: the folder for intermediate tables, size-checked
broadcasts, exact word splitting and cached word hashes."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recitary.sources.scratch import remover, shared_dir

#: Rows up to which a two- or three-column id table is broadcast (about 32 MB).
BROADCAST_ROWS = 1_000_000
TEXTS_PER_BATCH, BYTES_PER_BATCH = 2_000, str(16 << 20)


def text_batches(spark: SparkSession) -> SparkSession:
    """Smaller Arrow batches than Spark's defaults (10,000 rows, 64 MB), unless the session sets its
    own: rows hold whole texts, and a worker has a batch in several forms at once. It is a
    setting of the session and so holds for its other Arrow jobs too; results don't depend on it."""
    for name, default, own in (("maxRecordsPerBatch", "10000", str(TEXTS_PER_BATCH)), ("maxBytesPerBatch", "67108864", BYTES_PER_BATCH)):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, default) in (default, "64MB"):
            spark.conf.set(name, own)
    return spark


class Workspace:
    """Intermediate tables of one operator call, written as Parquet below the
    shared folder. They outlive lost executors and cut the lineage. drop()
    removes a table once nothing reads it, keep_only() all but some; the rest goes when the
    driver ends, be the session stopped by then or not."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        self._remove = remover(spark, self.root)
        atexit.register(self._remove, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self.names.add(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self.names.discard(name)
        self._remove(f"{self.root}/{name}")

    def keep_only(self, *names: str) -> None:
        for name in self.names - set(names):
            self.drop(name)

    def sweep(self) -> None:
        """Lets Spark's cleaner drop the shuffle files of jobs that are over: it goes by the
        driver's garbage, which may not be collected for long."""
        self.spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast where df is proven to have at most `bound` rows; beyond
    that Spark's shuffled join takes over."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= bound else df.hint("merge")


def lower_words(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and \\x09-\\x0D, A-Z lower-cased. bytes.lower
    and bytes.split touch ASCII only, so this is the exact word rule."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


_BASE = 0x9E3779B97F4A7C15 | 5
_BYTE = np.random.default_rng(99).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n at least, kept by each worker."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n, both = 1 << (n - 1).bit_length(), []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, np.uint64(b), dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers = both[0], both[1]
    return _powers


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def prefix_sums(b: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of bytes: a span's hash is a difference of two, times base^-start."""
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * powers(len(b) + 1)[0][: len(b)], out=total[1:])
    return total


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, their lengths hashed in. Spans of over 64 bytes are hashed one by
    one, as long strings can be made up that collide as polynomials modulo 2^64."""
    total = prefix_sums(b)
    out = mix64((total[end] - total[start]) * powers(len(b) + 1)[1][start] + mix64((end - start).astype(np.uint64)))
    for k in np.flatnonzero(end - start > 64).tolist():
        out[k] = xxhash.xxh3_64_intdigest(b[start[k] : end[k]])
    return out


_LOWER_SPACE = bytes(32 if c in b" \t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes hashed at once (some 40 bytes of memory for each).
HASH_BLOCK = 1 << 20


def word_hashes(texts: Iterable[str | None], block: int = HASH_BLOCK) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of its words, as lower_words() cuts them: over the bytes of
    many texts at once, longer ones cut between words."""
    held, whose, size = [], [], 0

    def parts():
        for k, t in enumerate(texts):
            raw = (t or "").encode("utf-8", "surrogatepass").translate(_LOWER_SPACE)
            at = 0
            while len(raw) - at > block:
                cut = raw.rfind(b" ", at, at + block)
                cut = cut if cut >= at else raw.find(b" ", at)
                if cut < 0:
                    break
                yield k, raw[at:cut]
                at = cut + 1
            yield k, raw[at:]

    def hashed():
        b = np.frombuffer(b" ".join([*held, b""]), dtype=np.uint8)
        edge = np.diff((b != 32).view(np.int8), prepend=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        at = np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in held)]))
        h = span_hashes(b, start, end)
        return [(k, h[x:y]) for k, x, y in zip(whose, at[:-1], at[1:], strict=True)]

    found: list[np.ndarray] = []
    now = 0
    for k, part in parts():
        held.append(part)
        whose.append(k)
        size += len(part) + 1
        if size >= block:
            for j, h in hashed():
                if j != now:
                    yield np.concatenate(found)
                    found, now = [], j
                found.append(h)
            held, whose, size = [], [], 0
    for j, h in hashed() if held else []:
        if j != now:
            yield np.concatenate(found)
            found, now = [], j
        found.append(h)
    if found:
        yield np.concatenate(found)


def learning_rows(col: str = "doc_id"):
    """Rows that labels may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return (F.crc32(F.col(col).cast("string")) % 3) != 1


def held_out(col: str = "doc_id"):
    return F.coalesce((F.crc32(F.col(col).cast("string")) % 3) == 1, F.lit(False))
