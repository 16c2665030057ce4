"""From frame predictions and verse texts to verdicts, as one DataFrame plan.

Frames meet their utterance's text once, after they have become one array of segments for
each utterance, so the only exchange on frames is the one that orders them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recitary.functions import phonemes as P
from recitary.functions import text as T
from recitary.functions.alphabet import decode
from recitary.operators import align, rules, sequence


def evaluate(frames: DataFrame, verses: DataFrame, utt: str = "utt", t: str = "t", id_: str = "id", text: str = "text", blank: int = 0, intent: bool = False) -> DataFrame:
    """One row for each utterance: expected and predicted text and tokens, segments, aligned pairs,
    edit errors, word errors, and each long-vowel rule's verdict with those that failed.
    Utterances without a segment have empty predictions; those without a text are left out."""
    segments = sequence.segments_array(sequence.run_segments(frames, utt, t, id_, blank), utt, id_)
    x = verses.select(utt, F.col(text).alias("expected_text")).join(segments, utt, "left")
    none = F.array().cast("array<struct<id:int,frames:bigint>>")
    x = x.withColumn("segments", F.coalesce(F.transform("segments", lambda s: F.struct(s["id"].cast("int").alias("id"), s["frames"].alias("frames"))), none))
    x = x.withColumn("read", P.phonemes(F.col("expected_text")))
    x = x.select(utt, "expected_text", "segments", F.col("read.tokens").alias("expected"), F.col("read.meta").alias("meta"), decode(F.transform("segments", lambda s: s["id"])).alias("predicted"))
    x = x.withColumns(
        {
            "predicted_text": T.tokens_to_text(F.col("predicted")),
            "pairs": align.aligned_pairs(F.col("expected"), F.col("predicted")),
            "errors": align.edit_errors(F.col("expected"), F.col("predicted")),
            "rules": rules.madd_rules(F.col("expected_text"), F.col("meta"), intent),
        }
    )
    x = x.withColumn("word_errors", align.word_errors(T.words(T.normalize_arabic(F.col("expected_text"))), T.words(F.col("predicted_text"))))
    x = x.withColumn("madd_results", rules.judge_aligned(F.col("rules"), F.col("pairs"), F.col("segments")))
    return x.withColumn("madd_errors", F.filter("madd_results", lambda v: v["status"] != "Correct")).drop("meta")
