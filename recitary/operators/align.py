"""Edit-distance alignment of token arrays: an Arrow UDF, parameterised by the order in
which the walk back through the table prefers its steps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from recitary.operators.sequence import once

#: Rows of a batch whose results are Python objects at once.
ROWS = 64
#: Steps tried in this order after a match.
ERRORS, PAIRS = ("delete", "insert", "replace"), ("replace", "delete", "insert")
EDIT = "array<struct<type:string,expected:string,predicted:string,position:int>>"
PHONEME_LABELS = {"delete": "Deletion", "insert": "Insertion", "replace": "Substitution"}
WORD_LABELS = {"delete": "Missing Word", "insert": "Extra Word", "replace": "Wrong Word"}


def distance_table(a: list, b: list) -> np.ndarray:
    """Unit-cost table by rows; within a row insertions are a running minimum, so each row is vectorised."""
    codes = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    x = np.array([codes[v] for v in a], dtype=np.int64)
    y = np.array([codes[v] for v in b], dtype=np.int64)
    steps = np.arange(len(y) + 1)
    table = np.empty((len(x) + 1, len(y) + 1), dtype=np.int64)
    table[0] = steps
    for i in range(len(x)):
        row = np.empty(len(y) + 1, dtype=np.int64)
        row[0] = i + 1
        row[1:] = np.minimum(table[i, 1:] + 1, table[i, :-1] + (y != x[i]))
        table[i + 1] = np.minimum.accumulate(row - steps) + steps
    return table


#: Places of the distance table, a byte each, up to which all of them are held at once.
WHOLE = 1 << 20
STEPS = ("match", "delete", "insert", "replace")


def _steps(x: np.ndarray, y: np.ndarray, row: np.ndarray, first: int, prefer: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For rows first + 1 to first + len(x) of the distance table, from row `first` on: the step that the walk takes at each place,
    as a byte, and the last row."""
    span, codes = np.arange(len(y) + 1, dtype=np.int32), np.empty((len(x), len(y) + 1), dtype=np.uint8)
    for k, v in enumerate(x):
        new = np.empty_like(row)
        new[0] = first + k + 1
        differ = y != v
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + differ)
        new = np.minimum.accumulate(new - span) + span
        here = new - 1
        open_ = {"delete": row == here, "insert": np.r_[False, new[:-1] == here[1:]], "replace": np.r_[False, row[:-1] == here[1:]]}
        code = codes[k]
        for s in reversed(prefer):
            code[open_[s]] = STEPS.index(s)
        code[1:][~differ] = 0
        row = new
    return codes, row


def walk(a: list, b: list, prefer: tuple[str, ...], to_start: bool) -> list[tuple[str, int, int]]:
    """Steps from start to end as (step, place in a, place in b). to_start=False stops as soon
    as one side is used up, so what leads the other is left out. Of a distance table of more than WHOLE places every n-th row is kept, n the
    root of their number, and the rows between are made again when the walk comes to them: memory grows with n * b, not with a * b."""
    known = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    x = np.array([known[v] for v in a], dtype=np.int32)
    y = np.array([known[v] for v in b], dtype=np.int32)
    span = np.arange(len(y) + 1, dtype=np.int32)
    size = max(1, len(x) if len(x) * len(y) <= WHOLE else math.isqrt(len(x)))
    kept = [span]
    for i, v in enumerate(x[: (len(x) - 1) // size * size] if len(x) else x):
        row = kept[-1] if i % size == 0 else row
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != v))
        row = np.minimum.accumulate(new - span) + span
        if (i + 1) % size == 0:
            kept.append(row)
    i, j, out, block = len(a), len(b), [], None
    while (i or j) if to_start else (i and j):
        if i == 0:
            step = "insert"
        else:
            if block != (i - 1) // size:
                block = (i - 1) // size
                codes, _ = _steps(x[block * size : i], y, kept[block], block * size, prefer)
            step = STEPS[codes[i - 1 - block * size, j]]
        i, j = i - (step != "insert"), j - (step != "delete")
        out.append((step, i, j))
    return out[::-1]


def find_errors(expected: list, predicted: list, labels: dict = PHONEME_LABELS) -> list[dict]:
    out = []
    for step, i, j in walk(expected, predicted, ERRORS, True):
        if step != "match":
            out.append(
                {
                    "type": labels[step],
                    "expected": expected[i] if step != "insert" else None,
                    "predicted": predicted[j] if step != "delete" else None,
                    "position": j if step == "insert" else i,
                }
            )
    return out


def pair_places(expected: list, predicted: list) -> tuple[np.ndarray, np.ndarray]:
    """The places of aligned tokens on both sides; -1 where the other has no partner."""
    steps = walk(expected, predicted, PAIRS, False)
    return tuple(np.array([-1 if s == lone else k for s, *at in steps for k in at[side : side + 1]], dtype=np.int32) for side, lone in enumerate(("insert", "delete")))


def find_pairs(expected: list, predicted: list) -> list[dict]:
    """Aligned tokens with their places; one side null where the other has no partner."""
    return [
        {"expected": expected[i] if s != "insert" else None, "predicted": predicted[j] if s != "delete" else None, "expected_index": i if s != "insert" else None, "predicted_index": j if s != "delete" else None}
        for s, i, j in walk(expected, predicted, PAIRS, False)
    ]


def edit_errors(expected: Column, predicted: Column, labels: dict = PHONEME_LABELS) -> Column:
    """array<struct<type, expected, predicted, position>>; null inputs count as empty."""

    @F.pandas_udf(EDIT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            for k in range(0, len(x), ROWS):
                yield pd.Series([find_errors(_list(a), _list(b), labels) for a, b in zip(x[k : k + ROWS], y[k : k + ROWS], strict=True)])

    return run(expected, predicted)


def word_errors(expected: Column, predicted: Column) -> Column:
    return edit_errors(expected, predicted, WORD_LABELS)


def aligned_pairs(expected: Column, predicted: Column) -> Column:
    """array<struct<expected, predicted, expected_index, predicted_index>>. Python gives places only; the tokens are taken from both arrays."""

    @F.pandas_udf("struct<i:array<int>,j:array<int>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in batches:
            for k in range(0, len(x), ROWS):
                yield pd.DataFrame([pair_places(_list(a), _list(b)) for a, b in zip(x[k : k + ROWS], y[k : k + ROWS], strict=True)], columns=["i", "j"])

    def pair(p: Column) -> Column:
        i, j = (F.when(p[k] >= 0, p[k]) for k in ("i", "j"))
        return F.struct(F.get(expected, i).alias("expected"), F.get(predicted, j).alias("predicted"), i.alias("expected_index"), j.alias("predicted_index"))

    return F.transform(once(run(expected, predicted), lambda r: F.arrays_zip(r["i"].alias("i"), r["j"].alias("j"))), pair)


def _place(x) -> int | None:
    """A place out of Arrow: a column of places with nulls may come as floats."""
    return None if x is None or x != x else int(x)


def partners(pairs: Column) -> Column:
    """array<int>: at each expected place the predicted one that aligned_pairs pairs with it, or null."""

    @F.pandas_udf("array<int>")
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for own in rows:
            held = [(i, _place(p["predicted_index"])) for p in _list(own) if (i := _place(p["expected_index"])) is not None]
            places = [None] * (max((i for i, _ in held), default=-1) + 1)
            for i, j in held:
                places[i] = j
            out.append(places)
        return pd.Series(out, dtype="object")

    return run(pairs)


def distance(a: list, b: list) -> int:
    """The last cell of distance_table, which is not kept: two rows at a time."""
    codes = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([codes[v] for v in b], dtype=np.int64)
    steps = np.arange(len(y) + 1)
    row = steps
    for i, v in enumerate(a):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != codes[v]))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def edit_distance(a: Column, b: Column) -> Column:
    """Unit-cost distance of two token arrays, in memory that grows with one of them. Null for a null array."""

    @F.pandas_udf("int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([None if p is None or q is None else distance(list(p), list(q)) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return run(a, b)


def _list(x) -> list:
    return [] if x is None else list(x)
