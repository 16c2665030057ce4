"""Frame and token sequences: collapse, segments, chunks, padding, lengths.

Long form is (utt, t, id), one row for each frame, the order column being explicit.
Window forms share one exchange and sort on (utt, t); array forms need none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recitary.functions.alphabet import encode
from recitary.functions.text import parse_list


def _w(utt: str, t: str):
    return Window.partitionBy(utt).orderBy(t)


def ctc_collapse(frames: DataFrame, utt: str = "utt", t: str = "t", id_: str = "id", blank=0) -> DataFrame:
    """Rows that a greedy decoder emits: not blank and unlike the frame before, blank included."""
    before = F.lag(id_).over(_w(utt, t))
    return frames.withColumn("__before", before).where((F.col(id_) != blank) & ~F.col(id_).eqNullSafe(F.col("__before"))).drop("__before")


def ctc_collapse_array(ids: Column, blank=0) -> Column:
    """The same over an array column."""
    return F.filter(ids, lambda x, i: (x != blank) & ((i == 0) | (x != F.get(ids, i - 1))))


def run_segments(frames: DataFrame, utt: str = "utt", t: str = "t", id_: str = "id", blank=0) -> DataFrame:
    """Runs of equal ids: utt, seg (from 0), id, frames, start. Blank runs end a run and are left
    out. One exchange on utt: the grouping keeps the windows' partitioning."""
    change = F.when(F.col(id_).eqNullSafe(F.lag(id_).over(_w(utt, t))) & F.lag(F.lit(1)).over(_w(utt, t)).isNotNull(), 0).otherwise(1)
    runs = frames.withColumn("__change", change).withColumn("__run", F.sum("__change").over(_w(utt, t)))
    segs = runs.where(F.col(id_) != blank).groupBy(utt, "__run", id_).agg(F.count("*").alias("frames"), F.min(t).alias("start"))
    return segs.withColumn("seg", F.row_number().over(_w(utt, "__run")) - 1).select(utt, "seg", id_, "frames", "start")


def segments_array(segments: DataFrame, utt: str = "utt", id_: str = "id") -> DataFrame:
    """array<struct<id, frames>> for each utterance, in order."""
    return segments.groupBy(utt).agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", F.col(id_).alias("id"), "frames"))), lambda s: F.struct(s["id"].alias("id"), s["frames"].alias("frames"))).alias("segments"))


def greedy_decode(logits: DataFrame, utt: str = "utt", t: str = "t", scores: str = "scores", blank=0) -> DataFrame:
    """Argmax of each frame, then segments with their frame counts."""
    return run_segments(logits.select(utt, t, argmax(F.col(scores)).alias("id")), utt, t, "id", blank)


def argmax(scores: Column) -> Column:
    """0-based place of the first largest value."""
    return F.when(F.size(scores) > 0, F.array_position(scores, F.array_max(scores)).cast("int") - 1)


def normalized_durations(segments: DataFrame, utt: str = "utt") -> DataFrame:
    return segments.withColumn("norm", F.col("frames") / F.avg("frames").over(Window.partitionBy(utt)))


def uniform_segment(t: Column, frames: Column, parts: Column) -> Column:
    """0-based part of frame t when `parts` tokens share the frames evenly; the last takes
    the rest. With fewer frames than parts all belong to the last; null for no parts."""
    width = F.floor(F.try_divide(frames, parts))
    return F.when(width == 0, parts - 1).otherwise(F.least(F.floor(F.try_divide(t, width)), parts - 1)).cast("int")


def ceil_chunk(ordinal: Column, total: Column, parts: int = 6) -> Column:
    """Chunk of a 0-based ordinal in `parts` contiguous pieces of the rounded-up size; the last may be short or empty."""
    return F.floor(ordinal / F.greatest(F.ceil(total / parts), F.lit(1))).cast("int")


def adjacent_pairs(tokens: DataFrame, utt: str = "utt", t: str = "t", id_: str = "id") -> DataFrame:
    """Non-overlapping equal neighbours: the first row of each pair, with `next` its partner's place."""
    w = _w(utt, t)
    runs = tokens.withColumn("__c", F.when(F.col(id_).eqNullSafe(F.lag(id_).over(w)), 0).otherwise(1))
    runs = runs.withColumn("__run", F.sum("__c").over(w)).withColumn("__next", F.lead(id_).over(w)).withColumn("next", F.lead(t).over(w))
    runs = runs.withColumn("__at", F.row_number().over(Window.partitionBy(utt, "__run").orderBy(t)) - 1)
    return runs.where((F.col("__at") % 2 == 0) & (F.col(id_) == F.col("__next"))).drop("__c", "__run", "__next", "__at")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: as the element of an array it is bound to a name. Within a lambda an
    expression over the whole array would be computed for each of its elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def short_average(segments: Column, short: Column) -> Column:
    """Mean frames of the segments whose id is in `short`; null without any."""
    own = F.filter(segments, lambda s: F.array_contains(short, s["id"]))
    total = F.aggregate(own, F.lit(0).cast("long"), lambda a, s: a + s["frames"])
    return F.when(F.size(own) > 0, total / F.size(own))


def observed_harakat(segments: Column, short: Column, long: Column) -> Column:
    """For long segments: place, id, frames and length in short vowels. Empty without short ones."""


    def of(mean: Column) -> Column:
        rows = F.transform(segments, lambda s, i: F.struct(i.alias("segment_index"), s["id"].alias("phoneme_id"), s["frames"].alias("frames"), (s["frames"] / mean).alias("observed_harakat")))
        return F.filter(rows, lambda r: mean.isNotNull() & F.array_contains(long, r["phoneme_id"]))

    return once(short_average(segments, short), of)


def pad_or_truncate(x: Column, n: int, zero=0.0) -> Column:
    return F.slice(F.concat(x, F.array_repeat(F.lit(zero), n)), 1, n)


def batch_of(ordinal: Column, size: int) -> Column:
    return F.floor(ordinal / size).cast("int")


def collate(rows: DataFrame, batch: str = "batch", signal: str = "signal", targets: str = "targets", order: str = "ordinal", cap: int | None = None) -> DataFrame:
    """One row for each batch: signals zero-padded to the longest (cut at cap first), targets
    joined, and both lengths. A batch is bounded by its size, so it is one row."""
    own = F.slice(F.col(signal), 1, cap) if cap else F.col(signal)
    x = rows.withColumn("__s", own).withColumn("__n", F.size("__s")).withColumn("__max", F.max("__n").over(Window.partitionBy(batch)))
    padded = F.concat("__s", F.array_repeat(F.lit(0.0).cast("float"), F.col("__max") - F.col("__n")))
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), padded.alias("s"), F.col("__n").alias("n"), F.col(targets).alias("t"))))
    got = x.groupBy(batch).agg(items.alias("i"))
    return got.select(
        batch,
        F.transform("i", lambda r: r["s"]).alias("signals"),
        F.flatten(F.transform("i", lambda r: r["t"])).alias("targets"),
        F.transform("i", lambda r: r["n"]).alias("signal_lengths"),
        F.transform("i", lambda r: F.size(r["t"])).alias("target_lengths"),
    )


def training_rows(manifest: DataFrame, samples: str = "samples", phonemes: str = "phonemes", cap: int | None = None) -> DataFrame:
    """A manifest's rows with signal (scaled to its peak, cut at cap), ids of the printed tokens, and
    both lengths: what collate() takes. Tokens outside the vocabulary are dropped."""
    x = F.slice(F.col(samples), 1, cap) if cap else F.col(samples)
    peak = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")))) + 1e-8
    signal = once(peak, lambda p: F.transform(x, lambda v: (v.cast("double") / p).cast("float")))
    out = manifest.withColumns({"signal": signal, "ids": encode(parse_list(F.col(phonemes)))})
    return out.withColumns({"signal_length": F.size("signal"), "target_length": F.size("ids")})


# Kernel, stride and padding of the four front-end layers.
LAYERS = ((11, 5, 5), (7, 4, 3), (5, 4, 2), (3, 2, 1))


def conv_length(samples: Column, layers=LAYERS) -> Column:
    """Frames after strided convolutions, at least 1."""
    n = samples
    for kernel, stride, pad in layers:
        n = F.floor((n + 2 * pad - kernel) / stride) + 1
    return F.greatest(n, F.lit(1)).cast("long")


def encoder_length(samples: Column) -> Column:
    """Frames of a 400-sample window every 320 samples, at least 1."""
    return F.greatest(F.floor((samples - 400) / 320) + 1, F.lit(1)).cast("long")


def padding_mask(length: Column, total: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), total - 1), lambda t: t >= length)
