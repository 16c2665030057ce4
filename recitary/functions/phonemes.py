"""Vocalised Arabic to sound tokens.

The text is read as units, a letter with its marks. An ordered list of rules looks at
the unit at hand and its neighbours; the first that applies emits tokens and says where
to go on. What rules remember (the last vowel, a block on the next long vowel) is in
the reader. The sequence is inherently serial, so it runs as one Arrow UDF; white space,
marks and the lexicon join are Spark columns before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recitary.sources.scratch import written

from . import text as T
from .alphabet import (
    DAGGER,
    DAMMA,
    DISJOINTED,
    FATHA,
    HAMZAS,
    KASRA,
    MARKS,
    MODEL_SOUNDS,
    MODEL_VOWELS,
    PREFIX_TAGS,
    PREFIXES,
    SHADDA,
    SHORTENED,
    SOUNDS,
    SPACE,
    SUKOON,
    SUN,
    TANWEEN,
    VOWELS,
    WASL,
    WASL_LETTER,
    WASL_NOUNS,
)

ALIF, LAM, HEH, WAW, YA, MAQSURA, MADDA = "ا", "ل", "ه", "و", "ي", "ى", "آ"
_FOLD = str.maketrans(dict.fromkeys("أإؤئء", ALIF))
_BARE = str.maketrans("", "", MARKS)
_FOLDED_NOUNS = tuple(n.translate(_FOLD) for n in WASL_NOUNS)

RESULT = "tokens array<string>, meta array<struct<kind:string,char:string,char_index:int,is_long_vowel:boolean>>, error string"


@dataclass(frozen=True)
class Unit:
    letter: str
    marks: str
    at: int

    def any(self, marks: str) -> bool:
        return any(m in marks for m in self.marks)


def units(text: str) -> list[Unit]:
    out: list[Unit] = []
    i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[j] in MARKS:
            j += 1
        out.append(Unit("", text[i:j], i) if text[i] in MARKS else Unit(text[i], text[i + 1 : j], i))
        i = j
    return out


# -- joining hamza: which words begin with one --------------------------------------


def prefix_of(analysis: dict) -> str:
    return "".join(PREFIX_TAGS.get(analysis.get(k) or "", "") for k in ("prc3", "prc2", "prc1", "prc0"))


def surface_analysis(word: str) -> dict:
    """What the written form alone says. A plain alif that begins a word is a joining one;
    behind a one-letter prefix it is so if the next letter has no vowel. A lam written
    with sukoon before a sun letter is no article."""
    u = units(word)
    lead = 1 if len(u) > 2 and u[0].letter in PREFIXES and u[1].letter == ALIF and not u[1].marks else 0
    if len(u) > lead + 1 and u[lead].letter == ALIF:
        nxt = u[lead + 1]
        closed = nxt.any(SUKOON + SHADDA)
        article = nxt.letter == LAM and not (SUKOON in nxt.marks and len(u) > lead + 2 and u[lead + 2].letter in SUN)
        if not article and (closed or not lead):
            return {"pos": "verb", "prc1": next((t for t, p in PREFIX_TAGS.items() if lead and p == u[0].letter), None)}
    return {"pos": "noun"}


def takes_wasl(word: str, bare: str, analysis: dict) -> bool:
    if analysis.get("prc2") == "ال" or bare.startswith("ال"):
        return True
    prefix = prefix_of(analysis)
    if prefix:
        stem = bare[len(prefix) :]
    else:
        stem = bare[1:] if len(bare) > 2 and bare[0] in PREFIXES and bare[1] == ALIF else bare
    if (analysis.get("lex") or "").split("_")[0] in WASL_NOUNS or stem.translate(_FOLD).startswith(_FOLDED_NOUNS):
        return True
    if (analysis.get("stem") or "").startswith(WASL_LETTER) or analysis.get("pos") == "verb" and bare[len(prefix) :].startswith(ALIF):
        return True
    u = units(word)
    # an imperative: alif with kasra or nothing, then a letter with sukoon
    return u[0].letter == ALIF and (not u[0].marks and len(word) == 1 or u[0].marks[:1] == KASRA) and len(u) > 1 and SUKOON in u[1].marks


def mark_wasl(text: str, lexicon: dict | None) -> str:
    """Writes the joining alif's own letter where a word has one. lexicon: bare word ->
    analysis; words it lacks stay as they are. Without a lexicon the surface decides."""
    out = []
    for word in text.split():
        bare = word.translate(_BARE)
        analysis = surface_analysis(word) if lexicon is None else lexicon.get(bare)
        if bare and analysis and takes_wasl(word, bare, analysis):
            at = 2 if len(word) >= 2 and word[0] in PREFIXES and word[1] in MARKS else 0
            while at < len(word) and word[at] in MARKS:
                at += 1
            if word[at : at + 1] == ALIF:
                word = word[:at] + WASL_LETTER + word[at + 1 :]
        out.append(word)
    return " ".join(out)


# -- the reader ------------------------------------------------------------------------


@dataclass
class Reader:
    text: str
    lexicon: dict | None = None
    tokens: list[str] = field(default_factory=list)
    meta: list[tuple[str | None, str | None, int | None, bool | None]] = field(default_factory=list)
    last_vowel: str | None = None
    block: bool = False

    def read(self) -> Reader:
        self.u = units(self.text)
        first = self.text.split(" ")[0]
        analysis = (self.lexicon or {}).get(first) or {}
        prefix = prefix_of(analysis)
        if prefix and first.startswith(prefix):
            first = first[len(prefix) :]
        # the word that a shortened spelling is looked up by is always the first one
        bare = first.translate(_BARE).translate(_FOLD)
        self.shortened = bare in SHORTENED or self.lexicon is None and bare[:1] in PREFIXES and bare[1:] in SHORTENED
        k = 0
        while k < len(self.u):
            k = self.step(k)
        return self

    def emit(self, token: str, unit: Unit, long: bool = False, char: str | None = None, at: int | None = None) -> None:
        self.tokens.append(token)
        self.meta.append(("sound", char or unit.letter, unit.at if at is None else at, long))

    def wasl(self, unit: Unit) -> None:
        if self.tokens[-1:] != [WASL]:
            self.emit(WASL, unit, char=ALIF)

    def get(self, k: int) -> Unit | None:
        return self.u[k] if 0 <= k < len(self.u) else None

    def step(self, k: int) -> int:
        unit = self.u[k]
        end = self.spelled(k, unit)
        if end is not None:
            return end
        blocked, self.block = self.block, False
        if unit.letter in (WASL_LETTER, " ", MADDA, MAQSURA, LAM, "س", ALIF) and unit.letter:
            for rule in (self.collapsed_article, self.prefixed_article, self.hidden_wasl, self.article, self.noun_wasl, self.plain):
                end = rule(k, unit)
                if end is not None:
                    if end >= 0:
                        return end
                    break  # a negative end: the letter is an ordinary one
        return self.letter(k, unit, blocked)

    def spelled(self, k: int, unit: Unit) -> int | None:
        """Disjointed letters: the word after a space; at the text's start its first letter is passed over."""
        if unit.at and unit.letter != " ":
            return None
        word = self.text[unit.at + 1 :].split(" ", 1)[0]
        if word not in DISJOINTED:
            return None
        sounds = DISJOINTED[word].split()
        self.tokens += [SPACE, *sounds]
        self.meta += [(None, None, None, None), *[("spelled", "muqattaat", None, None)] * len(sounds)]
        end = unit.at + 1 + len(word)
        return next((i for i in range(k, len(self.u)) if self.u[i].at >= end), len(self.u))

    # rules for single letters; None: does not apply

    def collapsed_article(self, k: int, unit: Unit) -> int | None:
        """Prefix with a mark, then an unvowelled lam: an article without its alif."""
        before, after = self.get(k - 1), self.get(k + 1)
        if unit.letter != LAM or before is None or not before.marks:
            return None
        if unit.any(VOWELS + SHADDA) or after and after.letter == HEH and DAGGER in unit.marks:
            return -1
        if not before.letter or before.letter not in PREFIXES:
            return None
        start = self.text.rfind(" ", 0, unit.at) + 1
        bare = self.text[start:].split(" ", 1)[0].translate(_BARE)
        known = ((self.lexicon or {}).get(bare) or {}).get("has_al", False)
        if not (known or after and after.letter in SOUNDS and after.letter != LAM):
            return None
        self.wasl(unit)
        # only a letter right behind the lam is looked at
        if not (not unit.marks and after and after.letter and after.letter in SUN):
            self.emit("l", unit)
        return k + 1

    def prefix_with_article(self, k: int) -> bool:
        """Is the alif at k the article's, behind a one-letter prefix with a short vowel that begins a word?"""
        p, lam, start = self.get(k - 1), self.get(k + 1), self.get(k - 2)
        if p is None or lam is None or self.u[k].marks or lam.letter != LAM:
            return False
        if len(p.marks) != 1 or p.marks not in VOWELS or not p.letter or p.letter not in PREFIXES:
            return False
        if start is not None and not (start.letter == " " and not start.marks):
            return False
        return not lam.marks or lam.any(SUKOON + SHADDA)

    def prefixed_article(self, k: int, unit: Unit) -> int | None:
        before, after = self.get(k - 1), self.get(k + 1)
        if unit.letter != LAM or before is None or before.letter != ALIF or not self.prefix_with_article(k - 1):
            return None
        if not (unit.any(SUKOON + SHADDA) or after and after.letter in SUN):
            return -1
        if after is None:
            return None
        self.wasl(unit)
        if SHADDA in unit.marks:
            self.emit("l", unit)
            self.emit("la", unit)
        elif after.letter not in SUN:
            self.emit("l", unit)
        return k + 1

    def hidden_wasl(self, k: int, unit: Unit) -> int | None:
        """A mark, alif, lam: the article inside a word."""
        before, lam, after = self.get(k - 1), self.get(k + 1), self.get(k + 2)
        if unit.letter != ALIF or unit.marks or before is None or not before.marks or lam is None or lam.letter != LAM:
            return None
        self.wasl(unit)
        if SHADDA in lam.marks:
            return k + 1
        if not (after and after.letter and after.letter in SUN):
            self.emit("l", unit, char=LAM, at=unit.at + 1)
        return k + 2

    def after_prefix(self, k: int) -> bool:
        p = self.get(k - 1)
        return p is not None and len(p.marks) == 1 and p.letter != "" and p.letter in PREFIXES

    def article(self, k: int, unit: Unit) -> int | None:
        lam, after = self.get(k + 1), self.get(k + 2)
        if unit.letter != WASL_LETTER or unit.marks or lam is None or lam.letter != LAM or self.after_prefix(k):
            return None
        if SHADDA in lam.marks and SUKOON not in lam.marks:
            self.wasl(unit)
            return k + 1
        if SUKOON not in lam.marks and after is None:
            return None
        self.wasl(unit)
        if SUKOON in lam.marks or not (after.letter and after.letter in SUN):
            self.emit("l", unit, char=LAM, at=unit.at + 1)
        return k + 2

    def noun_wasl(self, k: int, unit: Unit) -> None:
        """A noun with a joining alif behind a prefix, written with its alif or without; other rules go on."""
        if self.after_prefix(k):
            letters = "".join(u.letter for u in self.u[k : k + 4])
            if any(letters.startswith((n, n[1:])) for n in WASL_NOUNS):
                self.wasl(unit)

    def plain(self, k: int, unit: Unit) -> int | None:
        if unit.letter == " ":
            self.emit(SPACE, unit)
        elif unit.letter == WASL_LETTER:
            self.wasl(unit)
        elif unit.letter == MADDA:
            self.emit("ʔaa", unit, True)
        elif unit.letter == MAQSURA:
            last = self.tokens[-1] if self.tokens else ""
            if last.endswith("a") and last != "aa":
                # the token before is lengthened; the letter still has its own metadata
                self.tokens[-1] = last + "a" if not last.endswith("aa") else last[:-1] + "aa"
            else:
                self.tokens.append("aa")
            self.meta.append(("sound", unit.letter, unit.at, True))
        else:
            return None
        return k + 1

    # an ordinary letter

    def letter(self, k: int, unit: Unit, blocked: bool) -> int:
        base = SOUNDS.get(unit.letter)
        if base is None:
            return k + 1
        after = self.get(k + 1)
        nxt = after.letter if after else ""
        pure = after is not None and not after.any(VOWELS + TANWEEN + SHADDA)
        vowel = next((v for m, v in ((FATHA, "a"), (KASRA, "i"), (DAMMA, "u")) if m in unit.marks), None)
        nasal = next((v for m, v in zip(TANWEEN[0] + TANWEEN[2] + TANWEEN[1], ("an", "in", "un"), strict=True) if m in unit.marks), None)
        if SHADDA in unit.marks:
            self.emit(base, unit)
        if nasal:
            self.emit(base + nasal, unit)
            return k + 2 if nasal == "an" and nxt in (ALIF, MAQSURA) and nxt else k + 1
        if vowel == "a" and nxt == ALIF and pure:
            third = self.get(k + 2)
            if not self.prefix_with_article(k + 1) and not (third and third.marks[:1] == SUKOON):
                self.emit(base + "aa", unit, True)
                return k + 2
        if vowel == "i" and nxt == YA and not blocked:
            third = self.get(k + 2)
            if third and third.letter == YA:
                self.emit(base + "i", unit)
                return k + 1
            if pure:
                self.emit(base + "ii", unit, True)
                self.last_vowel = "ii"
                return k + 2
        if vowel == "u" and nxt == WAW and pure:
            self.emit(base + ("u" if self.shortened else "uu"), unit, not self.shortened)
            return k + 2
        if DAGGER in unit.marks:
            self.emit(base + "aa", unit, True)
        elif SUKOON in unit.marks:
            self.emit(base, unit)
            self.block = True
        elif unit.letter == HEH and vowel in ("u", "i") and self.letters_before(k) != LAM + LAM:
            long = self.lengthened(k)
            self.emit(base + vowel * (2 if long else 1), unit, long)
        elif vowel:
            self.emit(base + vowel, unit)
            self.last_vowel = vowel
        elif unit.letter == YA and self.last_vowel == "i":
            self.emit("yii", unit, True)
            self.last_vowel = "ii"
        else:
            self.emit(base, unit)
            self.last_vowel = None
        return k + 1

    def letters_before(self, k: int) -> str:
        return "".join(u.letter for u in reversed(self.u[max(0, k - 3) : k]) if u.letter)[:2]

    def lengthened(self, k: int) -> bool:
        """A pronoun's heh between vowels at a word's end: the next word begins with a vowelled letter."""
        before, space, nxt = self.get(k - 1), self.get(k + 1), self.get(k + 2)
        return before is not None and before.any(VOWELS) and space is not None and space.letter == " " and nxt is not None and nxt.any(VOWELS)


def phonemise(text: str, lexicon: dict | None = None, marks: bool = True) -> tuple[list[str], list[tuple]]:
    """Tokens and metadata of normalised text; marks=False drops wasl and space tokens."""
    r = Reader(mark_wasl(text, lexicon), lexicon).read()
    if marks:
        return r.tokens, r.meta
    kept = [(t, m) for t, m in zip(r.tokens, r.meta, strict=False) if t not in (WASL, SPACE)]
    return [t for t, _ in kept], [m for _, m in kept]


def phonemes(text: Column, analyses: Column | None = None, marks: bool = True) -> Column:
    """struct<tokens, meta, error> of raw text. analyses: map<bare word, struct<prc0, prc1, prc2,
    prc3, pos, stem, lex, has_al>>; null for the surface rules. A row that fails has an error."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, maps in batches:
            rows = []
            for t, m in zip(texts, maps, strict=True):
                try:
                    tokens, meta = phonemise(t or "", None if m is None else {k: dict(v) for k, v in dict(m).items() if v is not None}, marks)
                    rows.append((tokens, [dict(zip(("kind", "char", "char_index", "is_long_vowel"), x, strict=True)) for x in meta], None))
                except Exception as e:  # a row's failure is that row's result
                    rows.append(([], [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["tokens", "meta", "error"])

    null = F.lit(None).cast("map<string,struct<prc0:string,prc1:string,prc2:string,prc3:string,pos:string,stem:string,lex:string,has_al:boolean>>")
    return run(T.normalize_arabic(text), null if analyses is None else analyses)


#: Different words whose sounds a worker remembers.
REMEMBERED = 100_000


def phonemes_of_words(words: Column, marks: bool = True) -> Column:
    """array<string>: the sounds of each word of an array, joined by spaces, in its place; a word that fails has none. A worker reads a word
    once while it remembers it, and rows stay where they are: nothing is shuffled."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}

        def sounds(w: str | None) -> str:
            if (out := known.get(w)) is None:
                try:
                    out = " ".join(phonemise(w or "", None, marks)[0])
                except Exception:  # as in phonemes(): a word's failure is that word's result
                    out = ""
                if len(known) >= REMEMBERED:
                    known.clear()
                known[w] = out
            return out

        for rows in batches:
            for k in range(0, len(rows), 256):
                yield pd.Series([None if ws is None else [sounds(w) for w in ws] for ws in rows[k : k + 256]], dtype="object")

    return run(F.transform(words, T.normalize_arabic))


def distinct_phonemes(df: DataFrame, text: str, marks: bool = True) -> DataFrame:
    """df with the columns tokens, meta and error of `text`: each different text is read once and joined back. Worth it
    where texts are words, which repeat; the table of different ones is written, so that the reader runs once."""
    read = written(df.select(F.col(text).alias("__text")).distinct().withColumn("__r", phonemes(F.col("__text"), marks=marks)), "phonemes")
    out = df.join(read, F.col(text).eqNullSafe(F.col("__text")), "left")
    return out.select(*[df[c] for c in df.columns], "__r.tokens", "__r.meta", "__r.error")


def best_analysis(lexicon: DataFrame) -> DataFrame:
    """One analysis for each word by score, the first row winning ties (column rank orders
    rows); has_al if any analysis has the article."""
    score = (
        F.when(F.col("prc2") == "ال", 5).otherwise(0)
        + F.when(F.col("prc3").isNotNull() & (F.col("prc3") != "0"), 2).otherwise(0)
        + F.when(F.col("pos").isin("noun", "verb"), 2).otherwise(0)
        - F.when(F.col("pos") == "unk", 5).otherwise(0)
    )
    own = [c for c in ("prc0", "prc1", "prc2", "prc3", "pos", "stem", "lex")]
    best = F.max_by(F.struct(*own), F.struct(score, -F.col("rank")))
    return lexicon.groupBy("word").agg(best.alias("b"), F.bool_or(F.coalesce(F.col("prc2") == "ال", F.lit(False))).alias("has_al")).select("word", "b.*", "has_al")


def with_analyses(df: DataFrame, text: str, lexicon: DataFrame, key: str) -> DataFrame:
    """df with a column analyses: the words of each row that the lexicon knows. Words meet
    the lexicon once each, in a join Spark may broadcast; rows without known words get an empty map."""
    word = F.explode(F.array_distinct(T.words(T.remove_marks(T.normalize_arabic(F.col(text))))))
    known = df.select(key, word.alias("word")).join(lexicon, "word")
    entry = F.struct("word", F.struct("prc0", "prc1", "prc2", "prc3", "pos", "stem", "lex", "has_al"))
    maps = known.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("analyses"))
    return df.join(maps, key, "left").withColumn("analyses", F.coalesce("analyses", F.map_from_entries(F.array().cast("array<struct<word:string,a:struct<prc0:string,prc1:string,prc2:string,prc3:string,pos:string,stem:string,lex:string,has_al:boolean>>>"))))


# -- the frame models' own, simpler alphabet ----------------------------------------


def model_phonemise(text: str) -> list[str]:
    """Folded text to model sounds: a consonant, doubled by a doubling mark right behind it;
    a vowel, long before dagger alif or its own letter; all else is silent."""
    out = ["a"] if text.startswith("ال") else []
    i = 0
    lengthen = {"a": ALIF, "i": YA, "u": WAW}
    while i < len(text):
        c, nxt = text[i], text[i + 1 : i + 2]
        i += 1
        if c in MODEL_SOUNDS:
            out.append(MODEL_SOUNDS[c])
            if nxt == SHADDA:
                out.append(MODEL_SOUNDS[c])
                i += 1
        elif c in MODEL_VOWELS:
            v = MODEL_VOWELS[c]
            if nxt == DAGGER:
                out.append("aː")
                i += 1
            elif nxt == lengthen[v]:
                out.append(v + "ː")
                i += 1
            else:
                out.append(v)
    return out


def model_phonemes(text: Column) -> Column:
    """array<string> of raw text; null for null."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else model_phonemise(t) for t in texts])

    return run(T.fold_letters(text))
