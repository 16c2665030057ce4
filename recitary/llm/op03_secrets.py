"""Secret scan: fixed patterns, and dictionary-primed compression novelty. A candidate
string near a sensitive word is reported if compressing it after its surroundings,
with a dictionary of common identifiers and words, takes nearly as many bytes as it
has: then nothing around it and no identifier explains it. scan() cuts the candidate's own
copies out of its surroundings first, so a secret written twice doesn't explain itself, and
reports every occurrence of a string that is novel at one of them. Sensitive words count on
both sides; a line of a block, such as a private key's, is judged as they are if the line
next to it is reported.

Edge cases. Null text counts as empty: no spans. Texts of any length are scanned
whole. Repeated rows are scanned row by row; empty tables give empty results. Offsets
are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns in their order, and least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

# Words that make a context sensitive, and the identifier dictionary.
SENSITIVE = "access auth authorization bearer credential credentials key login passphrase password passwd private pwd secret signature token".split()
IDENTIFIERS = (
    "access_key api_key api_secret auth_token authorization bearer client_id client_secret config connection "
    "credential database default environment example export function header import localhost login message "
    "password private_key public_key request response return secret_key server session signature string "
    "username value variable version http https www com org net json yaml true false null none self this "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ aaaaaaaa 00000000 xxxxxxxx --------"
)
#: Most code points without letters or digits between adjoining lines.
ADJOIN = 40
#: Code points looked at on either side, shortest candidate, and marginal bytes for each of its characters.
CONTEXT, LEAST, NOVELTY = 160, 16, 0.72
#: Candidates with fewer than two digits need more, after prose that lets letters be coded by how common they are.
STRICT = 0.78
PROSE = (
    "The people who have been there before know that this would not be the first time, and Some of Them said so in their own words. "
    "Die Leute wissen, dass man nicht immer eine Antwort auf alle Fragen erwarten kann, und so ist Es auch heute noch geblieben. "
    "Les gens qui sont venus hier pour voir la maison ont dit que tout Cela leur avait beaucoup plu, mais sans vraiment y croire. "
    "La gente que vino ayer para ver la casa dijo que todo Esto les gustaba mucho, aunque no fuera como la que buscaban entonces. "
    "getValue setName ListItem isValid UserData HttpRequest FileReader onChange toString MainView ByteArray createObject "
)

_assign = re.compile(ASSIGN, re.I | re.A)
# Runs below the least length fail whole, so asking for the least length finds the same matches.
_access = re.compile(r"AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4))
_hex = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
_candidate = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: The end of a key block, less than a candidate's length.
_tail = re.compile(r"[^A-Za-z0-9]{1,40}([A-Za-z0-9+/]{1,%d}={0,2})\s*-----END" % (LEAST - 1))
_sensitive = re.compile("|".join(SENSITIVE), re.I | re.A)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Sorted by start, then by kind as listed."""
    out = [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in _access.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return [(a, b, KINDS[k]) for a, k, b in sorted(out)]


class Novelty:
    """Marginal compressed bytes of a candidate after its surroundings and the identifiers."""

    def __init__(self) -> None:
        dictionary = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=6, dict_data=dictionary, write_content_size=False, write_checksum=False).compress

    def strict(self, before: str, candidate: str, after: str) -> float:
        """The rate after PROSE too; one case throughout counts as small letters."""
        return self.rate(PROSE + before, candidate.lower() if candidate.isupper() else candidate, after)

    def rate(self, before: str, candidate: str, after: str) -> float:
        around = (before + after).encode("utf-8", "replace")
        return (len(self.compress(around + candidate.encode())) - len(self.compress(around))) / len(candidate)


def mixed(s: str) -> bool:
    """Not a number and not a single repeated shape."""
    return len(s) - sum(c.isdigit() for c in s) >= 4 and len(set(s)) >= 8


def value(s: str) -> str:
    """What a candidate name=value assigns, if that is long enough for a candidate, else all of it."""
    v = s.rstrip("=").rpartition("=")[2]
    return v if len(v) >= LEAST else s


def surroundings(text: str, a: int, b: int, apart: bool) -> tuple[str, str]:
    """CONTEXT code points on either side; apart: less what they hold of text[a:b] or its
    value, whole or cut by the window's edge."""
    if not apart:
        return text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    more = CONTEXT + b - a
    before, after = text[max(0, a - more) : a], text[b : b + more]
    for own in (text[a:b], value(text[a:b])):
        before, after = (x.replace(own, "\0" * len(own)) for x in (before, after))
    return before[-CONTEXT:].replace("\0", ""), after[:CONTEXT].replace("\0", "")


def novel(text: str, a: int, b: int, measure: Novelty, apart: bool) -> bool:
    before, after = surroundings(text, a, b, apart)
    if sum(c.isdigit() for c in text[a:b]) < 2:
        return measure.strict(before, text[a:b], after) >= STRICT
    return measure.rate(before, text[a:b], after) >= NOVELTY


def sensitive(text: str, a: int, b: int) -> bool:
    """Is a sensitive word near text[a:b], on either side or as the name it is assigned to?"""
    near = CONTEXT // 2
    return any(_sensitive.search(x) for x in (text[max(0, a - near) : a], text[b : b + near], text[a:b].rstrip("=").rpartition("=")[0]))


def novel_spans(text: str, base: list[tuple[int, int, str]], measure: Novelty, apart: bool = False) -> list[tuple[int, int, str]]:
    every, k = [], 0
    for m in _candidate.finditer(text):
        a, b = m.span()
        if not mixed(m[0]):
            continue
        while k < len(base) and base[k][1] <= a:
            k += 1
        if not any(x < b and y > a for x, y, _ in base[k : k + 4]):
            every.append((a, b))
    tested = {}

    def reported(a: int, b: int) -> bool:
        if (a, b) not in tested:
            tested[a, b] = novel(text, a, b, measure, apart)
        return tested[a, b]

    out = {(a, b) for a, b in every if sensitive(text, a, b) and reported(a, b)}
    # what adjoins a reported line, downwards and then upwards
    if every and (out or base):
        named = {(a, b) for a, b, kind in base if kind != "hex"}
        line = sorted({*every, *named})
        for pairs in (zip(line, line[1:]), zip(line[:0:-1], line[-2::-1])):
            for last, here in pairs:
                gap = text[min(last[1], here[1]) : max(last[0], here[0])]
                if (last in out or last in named) and here not in out and here not in named and len(gap) <= ADJOIN and not any(c.isalnum() for c in gap) and reported(*here):
                    out.add(here)
    if apart and out:
        found = {value(text[a:b]) for a, b in out}
        out |= {(a, b) for a, b in every if value(text[a:b]) in found}
    out |= {m.span(1) for _, b in out if (m := _tail.match(text, b))}
    return [(a, b, "novel") for a, b in sorted(out)]


def join_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(text: str | None, measure: Novelty, apart: bool = False) -> tuple[list, list]:
    """Base spans and all spans. apart: copies of a candidate don't explain it, as in scan()."""
    base = base_spans(text or "")
    every = base + novel_spans(text or "", sorted(base), measure, apart)
    return base, sorted(every, key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str | None, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str | None:
    """The text with each maximal covered run replaced by `mark`."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCAN = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256, spans, n_novel and redacted (the
    text with every span replaced). Columns of these names in docs are replaced."""
    new = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel", "redacted"]

    @F.pandas_udf(f"{SCAN}, redacted string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        measure = Novelty()
        for texts in batches:
            rows = []
            for t in texts:
                t = t if isinstance(t, str) else None
                base, every = find(t, measure, apart=True)
                n = [sum(s[2] == k for s in every) for k in KINDS]
                rows.append((*n[:3], hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(every), n[3], redact(t, every)))
            yield pd.DataFrame(rows, columns=new)

    return docs.withColumn("__scan", run(F.col(text))).drop(*new).select("*", "__scan.*").drop("__scan")


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")
