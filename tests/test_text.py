from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from recitary.functions import alphabet, text
from recitary.functions.phonemes import best_analysis, model_phonemes, model_phonemise, phonemes, phonemise, with_analyses
from recitary.plans.registry import GOLDEN as STATED

GOLDEN = [(w, t.split(" ")) for w, t in STATED]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_vocabulary_sizes():
    v = alphabet.vocabulary()
    assert len(v) == 294 and v[0] == (0, "<blank>", "blank") and v[3][1] == "<wasl>"
    assert len(alphabet.short_ids()) == 174 and len(alphabet.short_ids(strict=True)) == 87 and len(alphabet.long_ids()) == 87


def test_golden_words(spark):
    df = spark.createDataFrame([(w, t) for w, t in GOLDEN], "word string, expected array<string>")
    got = df.select("word", "expected", phonemes(F.col("word")).alias("p")).collect()
    assert [(r.word, r.p.tokens, r.p.error) for r in got] == [(w, t, None) for w, t in GOLDEN]


def test_marks_filter_and_disjointed():
    assert phonemise("فِي كِتَاب", marks=False)[0] == ["fii", "ki", "taa", "b"]
    tokens, meta = phonemise("ب طه ب")
    assert tokens == ["b", "<space>", "tˤaa", "haa", "<space>", "b"] and meta[2][0] == "spelled"


def test_lexicon(spark):
    rows = [("وكتب", 1, "0", "0", "wa_sub", "0", "verb", "كتب", "كتب_1"), ("وكتب", 2, "0", "0", "0", "0", "unk", "", "")]
    lex = spark.createDataFrame(rows, "word string, rank int, prc0 string, prc1 string, prc2 string, prc3 string, pos string, stem string, lex string")
    df = with_analyses(spark.createDataFrame([(1, "وَكَتَبَ"), (2, "غَيْر")], "k int, t string"), "t", best_analysis(lex), "k")
    out = {r.k: r for r in df.select("k", "analyses", phonemes(F.col("t"), F.col("analyses")).alias("p")).collect()}
    assert out[1].analyses["وكتب"].prc2 == "wa_sub" and out[2].analyses == {}
    assert out[1].p.tokens == ["wa", "ka", "ta", "ba"]


def test_normalisers(spark):
    assert one(spark, text.normalize_arabic(F.lit(" a بـِ  \n ۖ  سم "))) == "بِ سم"
    assert one(spark, text.fold_letters(F.lit(" إِلَى "))) == "اِلَي"
    assert one(spark, text.normalize_name(F.lit("لِلَّهِ"))) == "لِلّٰهِ"
    assert one(spark, text.next_significant(F.lit("بَ ا"), F.lit(0))) == "SPACE"
    assert one(spark, text.madd_positions(F.lit("بَا بِي"))) == [2, 6]
    assert one(spark, text.words(F.lit("  "))) == [] and one(spark, text.words(F.lit("a  b"))) == ["a", "b"]
    assert one(spark, text.parse_list(F.lit("""['a', "b'c", 'd\\'e']"""))) == ["a", "b'c", "d'e"]
    assert one(spark, text.states(F.array(F.lit("b")), ends=True)) == ["sil_1", "sil_2", "sil_3", "b_1", "b_2", "b_3", "sil_1", "sil_2", "sil_3"]
    assert one(spark, text.states_to_tokens(text.states(F.array(F.lit("b"), F.lit("k"))))) == ["b", "k"]
    assert one(spark, text.tokens_to_text(F.array(F.lit("ba"), F.lit("<space>"), F.lit("sˤuu")))) == "بَ صُو"


@pytest.mark.parametrize(("word", "expected"), [("الش\u064e\u0651مس", "a l ʃ a m s"), ("الش\u0651\u064eمس", "a l ʃ ʃ a m s"), ("بّ", "b b"), ("هٰذَا", "h ð aː"), ("", "")])
def test_model_phonemes(spark, word, expected):
    assert " ".join(model_phonemise(word)) == expected
    assert " ".join(one(spark, model_phonemes(F.lit(word)))) == expected


def test_vocabulary_lookup(spark):
    tokens = F.array(F.lit("ba"), F.lit("T"), F.lit("<wasl>"))
    assert one(spark, alphabet.decode(alphabet.encode(tokens))) == ["ba", "<wasl>"]
    assert one(spark, alphabet.out_of_vocabulary(tokens)) == 1
