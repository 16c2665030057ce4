"""Exact statistics of whole texts, shared by the quality operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SHAPES = ("n_distinct", "n_upper", "n_digits", "n_punct", "n_ends", "top_count", "n_long", "n_short", "n_caps", "n_other", "n_twice")


def repeated_words(ids: np.ndarray, kinds: int) -> int:
    """Words inside 5-word windows that occur twice or more; ids are 0..kinds-1. Exact:
    windows are numbered without collisions, by rank where their code would overflow."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    code, size = ids[:n].astype(np.int64), max(kinds, 1)
    for k in range(1, WINDOW):
        if size > (2**62) // max(kinds, 1):
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            size = int(code.max()) + 1
        code = code * kinds + ids[k : n + k]
        size *= max(kinds, 1)
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, dtype=np.int32)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.subtract.at(edge, at + WINDOW, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def count_text(text: str | None, shapes: bool = False) -> tuple[int, ...]:
    """The statistics in the order of COUNTS, then SHAPES."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    # isspace also takes no other byte for space than SPACES, as bytes are judged as ASCII
    spaces = len(raw) - len(raw.translate(None, SPACES))
    out = (len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(ids, len(seen)))
    if not shapes:
        return out
    counts = np.bincount(ids, minlength=1)
    lengths = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
    removed = lambda chars: len(raw) - len(raw.translate(None, chars))
    return out + (
        len(seen),
        removed(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        removed(b"0123456789"),
        removed(b".,;:!?'\"()-"),
        removed(b".!?"),
        int(counts.max()),
        int((lengths > 12).sum()),
        int((lengths < 3).sum()),
        sum(w.isupper() and len(w) > 1 for w in words),
        removed(b"@/\\_=+{}[]~^`") + (len(raw) - len(text)),
        int((ids[1:] == ids[:-1]).sum()),
    )


def statistics(text: Column, shapes: bool = False) -> Column:
    """struct of long statistics of each whole text; null text counts as empty."""
    names = COUNTS + SHAPES * shapes

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [count_text(t if isinstance(t, str) else None, shapes) for t in texts]
            yield pd.DataFrame(np.array(rows, dtype=np.int64).reshape(-1, len(names)), columns=list(names))

    return run(text)
