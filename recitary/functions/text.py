"""Text functions as Spark columns. Java patterns, Unicode white space by (?U)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import DAGGER, DAMMA, FATHA, KASRA, LETTERS_OF_SOUNDS, MARKS, PAUSES, SHADDA, SPACE, TATWEEL, WASL

_M = f"[{MARKS}]"


def collapse_space(x: Column) -> Column:
    """Runs of Unicode white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize_name(x: Column) -> Column:
    """lam, lam, heh with marks between: the second lam gets doubling and dagger alif."""
    return F.regexp_replace(x, f"ل({_M}*)ل{_M}*ه", f"ل$1ل{SHADDA}{DAGGER}ه")


def normalize_arabic(x: Column) -> Column:
    """Pauses, tatweel and all outside the Arabic block go; spaces collapse; the name is written out."""
    x = F.translate(x, PAUSES + TATWEEL, "")
    x = F.regexp_replace(x, r"(?U)[^؀-ۿ\s]", "")
    return normalize_name(collapse_space(x))


def fold_letters(x: Column) -> Column:
    """For the frame models: alif forms, alif maqsura and taa marbuta folded, tatweel gone, ends stripped."""
    x = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    return F.translate(x, "إأآٱىة" + TATWEEL, "ااااي" + "ه")


def remove_marks(x: Column) -> Column:
    return F.translate(x, MARKS, "")


def fold_hamza(x: Column) -> Column:
    return F.translate(x, "أإؤئء", "ااااا")


def words(x: Column) -> Column:
    """Split at Unicode white space; no words for blank text."""
    flat = collapse_space(x)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def marks_at(x: Column, position: Column) -> Column:
    """The run of marks from a 1-based position on."""
    return F.regexp_extract(F.substring(x, position, F.length(x)), f"^({_M}*)", 1)


def short_vowel(marks: Column) -> Column:
    return F.when(F.instr(marks, FATHA) > 0, "a").when(F.instr(marks, KASRA) > 0, "i").when(F.instr(marks, DAMMA) > 0, "u")


def tanween(marks: Column) -> Column:
    return F.when(F.instr(marks, "ً") > 0, "an").when(F.instr(marks, "ٍ") > 0, "in").when(F.instr(marks, "ٌ") > 0, "un")


def next_significant(x: Column, index: Column) -> Column:
    """After a 0-based index: 'SPACE', the next character that is no mark, or null."""
    found = F.regexp_extract(F.substring(x, index + 2, F.length(x)), f"(?s)^{_M}*+(.)", 1)
    return F.when(found == " ", "SPACE").when(found != "", found)


def previous_letters(x: Column, index: Column, n: int = 2) -> Column:
    """Up to n characters that are no marks before a 0-based index, nearest first."""
    letters = F.reverse(remove_marks(F.substring(x, F.lit(1), index)))
    return F.filter(F.split(F.substring(letters, 1, n), ""), lambda c: c != "")


def madd_positions(x: Column) -> Column:
    """0-based places of a long-vowel letter right after its vowel mark."""
    pair = lambda i: F.substring(x, i + 1, 2)
    at = F.sequence(F.lit(0), F.length(x) - 2)
    hits = F.filter(at, lambda i: pair(i).isin(FATHA + "ا", KASRA + "ي", DAMMA + "و"))
    return F.when(F.length(x) >= 2, F.transform(hits, lambda i: i + 1)).otherwise(F.array().cast("array<int>"))


def states(tokens: Column, n: int = 3, ends: bool = False) -> Column:
    """Each token as token_1..token_n; with ends=True silence on both sides."""
    own = F.concat(F.array(F.lit("sil")), tokens, F.array(F.lit("sil"))) if ends else tokens
    return F.flatten(F.transform(own, lambda p: F.array(*[F.concat(p, F.lit(f"_{i}")) for i in range(1, n + 1)])))


def states_to_tokens(states_: Column, n: int = 3) -> Column:
    """Every n-th state without its suffix."""
    return F.transform(F.filter(states_, lambda s, i: i % n == 0), lambda s: F.substring_index(s, "_", 1))


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def parse_list(x: Column) -> Column:
    """A printed list of strings, single or double quoted, as array<string>."""
    quoted = F.regexp_extract_all(x, F.lit(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""), F.lit(0))
    return F.transform(quoted, lambda s: F.regexp_replace(F.substring(s, F.lit(2), F.length(s) - 2), r"\\(.)", "$1"))


def tokens_to_text(tokens: Column) -> Column:
    """Tokens written as letters and marks: the reading aid for reports. Silence and wasl vanish."""
    names = F.create_map(*[F.lit(x) for kv in LETTERS_OF_SOUNDS.items() for x in kv])
    vowel = lambda t: F.regexp_extract(t, "(aa|ii|uu|an|in|un|a|i|u)$", 1)
    letter = lambda t: F.coalesce(F.try_element_at(names, F.regexp_replace(t, "(aa|ii|uu|an|in|un|a|i|u)$", "")), F.lit(""))
    marks = F.create_map(*[F.lit(x) for x in ("a", FATHA, "i", KASRA, "u", DAMMA, "aa", FATHA + "ا", "ii", KASRA + "ي", "uu", DAMMA + "و", "an", "ً", "in", "ٍ", "un", "ٌ")])
    one = lambda t: F.when(t == SPACE, " ").when(t.isin(WASL, "sil"), "").otherwise(F.concat(letter(t), F.coalesce(F.try_element_at(marks, vowel(t)), F.lit(""))))
    return F.array_join(F.transform(tokens, one), "")
