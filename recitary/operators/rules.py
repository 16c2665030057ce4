"""Pronunciation rules: expected lengths from text, observed ones from segments, verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recitary.functions.alphabet import HAMZAS, long_ids, short_ids
from recitary.functions.text import next_significant, normalize_arabic

from .align import partners
from .sequence import once, short_average

# Rule lengths in short vowels, and least durations in milliseconds.
EXPECTED = {"muttasil": 5, "munfasil": 5, "lazim": 6, "tabeei": 2}
TOLERANCE = 0.8
LEAST_MS = {"r": 10, "l": 10, "n": 20, "m": 20}
OTHER_LEAST_MS, MADD_MS, SHADDA_MS, NASAL_MS = 20, 150, 80, 120


def madd_rules(text: Column, meta: Column, intent: bool = False) -> Column:
    """array<struct<phoneme_index, type, expected_harakat>> for each long vowel of `meta`.
    Places refer to the normalised text. intent=True looks past the letter that writes
    the vowel, and sees a doubled or closed letter after it."""
    own = normalize_arabic(text)
    hamza = lambda c: c.isin(*HAMZAS)

    def rule(m: Column, i: Column) -> Column:
        at = m["char_index"]
        if intent:
            at = F.when(next_significant(own, at).isin("ا", "و", "ي"), at + F.length(F.regexp_extract(F.substring(own, at + 2, F.length(own)), "^(\\P{L}*)", 1)) + 1).otherwise(at)
        nxt = next_significant(own, at)
        over = next_significant(own, at + 1)
        closed = F.regexp_like(F.substring(own, at + 2, 4), F.lit("^[ً-ِٰ]*.[ّْ]")) if intent else F.lit(False)
        kind = F.when(hamza(nxt), "muttasil").when((nxt == "SPACE") & hamza(over), "munfasil").when(closed, "lazim").otherwise("tabeei")
        expected = F.when(kind.isin("muttasil", "munfasil"), 5).when(kind == "lazim", 6).otherwise(2)
        return F.struct(i.alias("phoneme_index"), kind.alias("type"), expected.alias("expected_harakat"), m["is_long_vowel"].alias("__long"))

    rows = F.filter(F.transform(meta, rule), lambda r: F.coalesce(r["__long"], F.lit(False)))
    return F.transform(rows, lambda r: F.struct(r["phoneme_index"].alias("phoneme_index"), r["type"].alias("type"), r["expected_harakat"].alias("expected_harakat")))


def verdict(observed: Column, expected: Column, tolerance: float = TOLERANCE) -> Column:
    return F.when(F.abs(observed - expected) <= tolerance, "Correct").when(observed < expected, "Too Short").otherwise("Too Long")


def judge_madd(rules: Column, segments: Column, tolerance: float = TOLERANCE, short: list[int] | None = None) -> Column:
    """Each rule against the segment of its place: struct<phoneme_index, type, expected, observed,
    status>. Rules beyond the segments, and all without short vowels, are left out."""
    ids = F.array(*[F.lit(i) for i in (short if short is not None else short_ids())])
    return _judged(rules, lambda i: i, segments, ids, lambda r, own: r["phoneme_index"] < F.size(own), tolerance)


def judge_aligned(rules: Column, pairs: Column, segments: Column, tolerance: float = TOLERANCE) -> Column:
    """The same, where a rule's place is one among the expected tokens: the segment is that of
    the predicted token which the alignment pairs with it. Unpaired rules are left out;
    phoneme_index stays the expected place."""
    ids = F.array(*[F.lit(i) for i in short_ids()])
    found = lambda places: _judged(rules, lambda i: F.get(places, i), segments, ids, lambda r, own: F.get(own, F.get(places, r["phoneme_index"])).isNotNull(), tolerance)
    return once(partners(pairs), found)


def _judged(rules: Column, place: Callable[[Column], Column], segments: Column, ids: Column, keep: Callable[[Column, Column], Column], tolerance: float) -> Column:
    """Verdicts of the rules to keep, each looking up the segment at its place; all is one pass over rules and segments."""

    def judge(own: Column, mean: Column) -> Column:
        def one(r: Column) -> Column:
            seen = F.get(own, place(r["phoneme_index"]))["frames"] / mean
            return F.struct(r["phoneme_index"].alias("phoneme_index"), r["type"].alias("type"), r["expected_harakat"].alias("expected"), F.round(seen, 2).alias("observed"), verdict(seen, r["expected_harakat"], tolerance).alias("status"))

        return F.transform(F.filter(rules, lambda r: mean.isNotNull() & keep(r, own)), one)

    return once(segments, lambda own: once(short_average(own, ids), lambda mean: judge(own, mean)))


def harakat_ids() -> tuple[Column, Column]:
    return F.array(*[F.lit(i) for i in short_ids()]), F.array(*[F.lit(i) for i in long_ids()])


def duration_map(states: DataFrame, utt: str = "utt", per_token: int = 3, hop: int = 160, rate: int = 16000, per_position: bool = False) -> DataFrame:
    """Milliseconds of each token from its states' frames. states: utt, pos, token, and
    state, a frame's state number. The interval test is an equality on the state's token
    number. Keyed by token, the last place of a token wins; per_position keeps all."""
    frames = states.select(utt, "state").where(F.col("state").isNotNull()).groupBy(utt, F.floor(F.col("state") / per_token).cast("int").alias("pos")).agg(F.count("*").alias("frames"))
    tokens = states.where(F.col("token").isNotNull()).select(utt, "pos", "token").distinct()
    own = tokens.join(frames, [utt, "pos"], "left").withColumn("ms", F.coalesce("frames", F.lit(0)) * (hop * 1000.0 / rate))
    if per_position:
        return own.select(utt, "pos", "token", "ms")
    return own.groupBy(utt, "token").agg(F.max_by("ms", "pos").alias("ms"), F.max("pos").alias("pos"))


def least_ms(token: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LEAST_MS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, token), F.lit(OTHER_LEAST_MS))


def check_durations(durations: DataFrame, pairs: DataFrame, utt: str = "utt") -> DataFrame:
    """All duration rules as rows (utt, rule_order, rule, token, ms): missing sounds, short
    long vowels, short nasals, weak doubled letters (pairs: utt, token), and one row "ok"
    for an utterance without any. The first three are one pass over the durations."""
    checks = F.array(
        F.when(F.col("ms") < least_ms(F.col("token")), F.struct(F.lit(1).alias("rule_order"), F.lit("missing").alias("rule"))),
        F.when(F.col("token").endswith("ː") & (F.col("ms") < MADD_MS), F.struct(F.lit(2).alias("rule_order"), F.lit("madd").alias("rule"))),
        F.when(F.col("token").isin("n", "m") & (F.col("ms") < NASAL_MS), F.struct(F.lit(3).alias("rule_order"), F.lit("ghunnah").alias("rule"))),
    )
    first = durations.select(utt, "token", "ms", F.explode(F.array_compact(checks)).alias("c")).select(utt, "c.rule_order", "c.rule", "token", "ms")
    doubled = pairs.join(durations, [utt, "token"], "left").withColumn("ms", 2 * F.coalesce("ms", F.lit(0.0)))
    doubled = doubled.where(F.col("ms") < SHADDA_MS).select(utt, F.lit(4).alias("rule_order"), F.lit("shadda").alias("rule"), "token", "ms")
    found = first.unionByName(doubled)
    ok = durations.select(utt).distinct().join(found.select(utt), utt, "left_anti")
    null = F.lit(None)
    return found.unionByName(ok.select(utt, F.lit(0).alias("rule_order"), F.lit("ok").alias("rule"), null.cast("string").alias("token"), null.cast("double").alias("ms")))
