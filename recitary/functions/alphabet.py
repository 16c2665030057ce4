"""Letters, marks, sounds and the token vocabulary of recited Arabic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Marks by code point (never normalise: a doubling mark comes before its vowel).
FATHATAN, DAMMATAN, KASRATAN = "ً", "ٌ", "ٍ"
FATHA, DAMMA, KASRA, SHADDA, SUKOON, DAGGER = "َ", "ُ", "ِ", "ّ", "ْ", "ٰ"
VOWELS = FATHA + DAMMA + KASRA
TANWEEN = FATHATAN + DAMMATAN + KASRATAN
MARKS = FATHA + DAMMA + KASRA + SUKOON + SHADDA + FATHATAN + DAMMATAN + KASRATAN + DAGGER
PAUSES = "ۖۗۘۙۚۛۜ۝۞۩"
TATWEEL = "ـ"
WASL_LETTER = "ٱ"
SPACE, WASL, BLANK = "<space>", "<wasl>", "<blank>"
HAMZAS = "ءأإؤئ"
PREFIXES = "وفبكل"
SUN = "تثدذرزسشصضطظلن"
WASL_NOUNS = ("اسم", "ابن", "ابنة", "اثنان", "اثنين", "اثنتان", "اثنتين", "امرؤ", "امرأة")
SHORTENED = ("اولات", "اولي", "اولوا")
PREFIX_TAGS = {"wa_sub": "و", "fa_conj": "ف", "bi_prep": "ب", "li_prep": "ل", "ka_prep": "ك"}
SOUNDS = {
    "ء": "ʔ", "أ": "ʔ", "إ": "ʔ", "ؤ": "ʔ", "ئ": "ʔ", "ى": "aa", "ب": "b", "ت": "t", "ث": "θ", "ج": "j", "ح": "ħ", "خ": "x",
    "د": "d", "ذ": "ð", "ر": "r", "ز": "z", "س": "s", "ش": "ʃ", "ص": "sˤ", "ض": "dˤ", "ط": "tˤ", "ظ": "ðˤ", "ع": "ʕ", "غ": "ɣ",
    "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "ة": "T", "و": "w", "ي": "y",
}
DISJOINTED = {
    "ٱلم": "ʔa li f laa m mii m", "المص": "?a li f laa m mii m sˤaa d", "الر": "?a li f laa m raa", "المر": "?a li f laa m mii m raa",
    "كهيعص": "kaa f haa yaa ʕa yn sˤaa d", "طه": "tˤaa haa", "طسم": "tˤaa sii m mii m", "طس": "tˤaa sii n", "يس": "yaa sii n", "ص": "sˤaa d",
    "حم": "ħaa mii m", "ق": "qaa f", "ن": "nuu n", "عسق": "؟a yii n sii n qaa f",
}
LETTERS_OF_SOUNDS = {
    "ʔ": "ء", "ʔw": "ٱ", "b": "ب", "t": "ت", "θ": "ث", "j": "ج", "ħ": "ح", "x": "خ", "d": "د", "ð": "ذ", "r": "ر", "z": "ز", "s": "س",
    "ʃ": "ش", "sˤ": "ص", "dˤ": "ض", "tˤ": "ط", "ðˤ": "ظ", "ʕ": "ع", "ɣ": "غ", "f": "ف", "q": "ق", "k": "ك", "l": "ل", "m": "م",
    "n": "ن", "h": "ه", "T": "ة", "w": "و", "y": "ي", "aa": "ا", "a": FATHA, "i": KASRA, "u": DAMMA,
}
CONSONANTS = "ʔ ʔw b t θ j ħ x d ð r z s ʃ sˤ dˤ tˤ ðˤ ʕ ɣ f q k l m n h w y".split()
# The second, separate alphabet of the frame models.
MODEL_SOUNDS = {
    "ب": "b", "ت": "t", "ث": "θ", "ج": "dʒ", "ح": "ħ", "خ": "x", "د": "d", "ذ": "ð", "ر": "r", "ز": "z", "س": "s", "ش": "ʃ", "ص": "sˤ",
    "ض": "dˤ", "ط": "tˤ", "ظ": "ðˤ", "ع": "ʕ", "غ": "ɣ", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w",
    "ي": "j", "ء": "ʔ",
}
MODEL_VOWELS = {FATHA: "a", KASRA: "i", DAMMA: "u"}

_KINDS = (("short", ("a", "i", "u")), ("long", ("aa", "ii", "uu")), ("tanween", ("an", "in", "un")))


def vocabulary() -> list[tuple[int, str, str]]:
    """(id, token, kind) with the blank as id 0: specials, consonants, then consonants
    with each short vowel, long vowel and tanween."""
    tokens = [(BLANK, "blank"), ("sil", "special"), (SPACE, "special"), (WASL, "special"), *[(c, "consonant") for c in CONSONANTS]]
    tokens += [(c + v, kind) for kind, vowels in _KINDS for c in CONSONANTS for v in vowels]
    return [(i, t, k) for i, (t, k) in enumerate(tokens)]


def vocabulary_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(vocabulary(), "id int, token string, kind string")


def token_map() -> Column:
    """token -> id as a literal map."""
    return F.create_map(*[F.lit(x) for i, t, _ in vocabulary() for x in (t, i)])


def id_map() -> Column:
    return F.create_map(*[F.lit(x) for i, t, _ in vocabulary() for x in (i, t)])


def short_ids(strict: bool = False) -> list[int]:
    """Ids whose token ends in a short vowel. Long vowels end so too and count unless strict."""
    return [i for i, t, k in vocabulary() if (k == "short" if strict else t[-1] in "aiu" and k != "special" and k != "blank")]


def long_ids() -> list[int]:
    return [i for i, t, k in vocabulary() if k == "long"]


def encode(tokens: Column) -> Column:
    """Token ids; tokens outside the vocabulary are dropped."""
    ids = token_map()
    return F.filter(F.transform(tokens, lambda t: F.try_element_at(ids, t)), lambda i: i.isNotNull())


def out_of_vocabulary(tokens: Column) -> Column:
    ids = token_map()
    return F.size(F.filter(tokens, lambda t: F.try_element_at(ids, t).isNull()))


def decode(ids: Column) -> Column:
    names = id_map()
    return F.transform(ids, lambda i: F.try_element_at(names, i))
