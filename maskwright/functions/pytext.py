"""Text functions that Spark SQL lacks, as Arrow-batched UDFs: NFKC and case folding."""

from __future__ import annotations

import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import validators
from maskwright.sources.rules import RegexRule


def normal_form(text: str) -> str:
    """NFKC, case-folded, without white space."""
    return "".join(unicodedata.normalize("NFKC", text).casefold().split())


def decode_mismatch(text: Column, decoded: Column) -> Column:
    """Whether a tokenizer's round trip lost more than form, case and white space."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else normal_form(x) != normal_form(y) for x, y in zip(a, b, strict=True)])

    return run(text, decoded)


def token_places(text: str, tokens: Sequence[str], special: frozenset[str]) -> tuple[list[int], list[int]]:
    """Starts and ends of word pieces that stand one after another in the NFKC form of a text.

    Special tokens and those that are not found are (0, 0); the next one is then looked
    for where the one before ended. A piece of several characters that one character's
    form has is that character.
    """
    forms = {ord(c): form for c in set(text) if (form := unicodedata.normalize("NFKC", c)) != c}
    whole = text.translate(forms) if forms else text
    starts, ends, last = [], [], 0
    for token in tokens:
        piece = "" if token in special else token.removeprefix("##")
        place = whole.find(piece, last) if piece else -1
        if place >= 0:
            last = place + len(piece)
        starts.append(max(place, 0))
        ends.append(last if place >= 0 else 0)
    if all(len(form) == 1 for form in forms.values()):
        return starts, ends
    until = np.cumsum([len(forms[ord(c)]) if ord(c) in forms else 1 for c in text], dtype=np.int64)
    first, end = np.array(starts, np.int64), np.array(ends, np.int64)
    # the character whose form holds a place is the first that ends beyond it
    known = end > first
    starts = np.where(known, np.searchsorted(until, first, side="right"), 0)
    ends = np.where(known, np.searchsorted(until, end - 1, side="right") + 1, 0)
    return starts.tolist(), ends.tolist()


def token_offsets(text: str, tokens: Sequence[str], special: frozenset[str]) -> list[dict]:
    """``token_places`` as a list of s and e."""
    return [{"s": s, "e": e} for s, e in zip(*token_places(text, tokens, special), strict=True)]


#: Result batches end at the row that fills so many elements, or after so many rows.
_ELEMENTS, _ROWS = 1 << 15, 1 << 10


def lists(rows: Iterable[Sequence[Sequence[int]] | None], names: Sequence[str]) -> Iterator[pa.ListArray]:
    """Arrays of lists of structs with int fields, from rows of equally long columns.

    A batch that Spark sends has 10,000 rows, however many elements they give: the
    results of all would take memory that grows with the rows, so they go out in parts.
    """
    columns, until, null = [array("i") for _ in names], array("i", [0]), []

    def built() -> pa.ListArray:
        values = pa.StructArray.from_arrays([pa.array(np.array(c, np.int32)) for c in columns], list(names))
        return pa.ListArray.from_arrays(pa.array(np.array(until, np.int32)), values, mask=pa.array(null))

    for row in rows:
        null.append(row is None)
        for column, values in zip(columns, row or (), strict=row is not None):
            column.extend(values)
        until.append(len(columns[0]))
        if len(columns[0]) >= _ELEMENTS or len(null) >= _ROWS:
            yield built()
            columns, until, null = [array("i") for _ in names], array("i", [0]), []
    if null:
        yield built()


def reconstructed_offsets(text: Column, tokens: Column, special: Sequence[str] = ("[CLS]", "[SEP]", "[PAD]", "[UNK]", "[MASK]")) -> Column:
    """``token_places`` over columns."""
    known = frozenset(special)

    def places(texts: pa.Array, pieces: pa.Array) -> Iterator[tuple[list[int], list[int]] | None]:
        """One row's text and tokens at a time become Python objects."""
        until, every = pieces.offsets, pieces.values
        for k in range(len(texts)):
            if not (texts[k].is_valid and pieces[k].is_valid):
                yield None
                continue
            first, end = until[k].as_py(), until[k + 1].as_py()
            yield token_places(texts[k].as_py(), every.slice(first, end - first).to_numpy(zero_copy_only=False).tolist(), known)

    @F.arrow_udf("array<struct<s: int, e: int>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, pieces in batches:
            yield from lists(places(texts, pieces), ("s", "e"))

    return run(text, tokens)


def chosen_spans(text: str, rules: Sequence[tuple[re.Pattern, RegexRule]], checks: dict) -> tuple[list[int], list[int], list[int]]:
    """One text's spans by Python's own regex engine: starts, ends and places of rules,
    by start."""
    keyed = []
    for ord, (pattern, rule) in enumerate(rules):
        for m in pattern.finditer(text):
            if m.end() > m.start() and (not rule.verify or checks[rule.verify](m.group())):
                keyed.append((-rule.priority, m.start() - m.end(), m.start(), ord, m.end()))
    keyed.sort()
    # disjoint and by start: only the last that starts before an end can overlap
    starts: list[int] = []
    ends: list[int] = []
    ords: list[int] = []
    for _, _, start, ord, end in keyed:
        k = bisect_left(starts, end)
        if not k or ends[k - 1] <= start:
            starts.insert(k, start)
            ends.insert(k, end)
            ords.insert(k, ord)
    return starts, ends, ords


def python_spans(text: str, rules: Sequence[tuple[re.Pattern, RegexRule]], checks: dict) -> list[dict]:
    """``chosen_spans`` as a list of label, start and end."""
    return [{"label": rules[ord][1].label, "start": s, "end": e} for s, e, ord in zip(*chosen_spans(text, rules, checks), strict=True)]


def _python_check(name: str):
    def luhn(value: str) -> bool:
        own = [int(c) for c in value if c in "0123456789"]
        doubled = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(own))]
        return bool(own) and sum(doubled) % 10 == 0

    def rrn(value: str) -> bool:
        own = [int(c) for c in value if c in "0123456789"]
        return len(own) == 13 and (11 - sum(a * b for a, b in zip(own, validators.RRN_WEIGHTS, strict=False)) % 11) % 10 == own[12]

    return {"luhn": luhn, "kr_rrn_valid": rrn}.get(name)


def regex_spans_arrow(text: Column, rules: Sequence[RegexRule]) -> Column:
    """``spans.regex_spans`` by Python's regex engine, in Arrow batches.

    For patterns that Java cannot run, custom validators, and as the other side of
    differential tests.
    """
    custom = {r.verify: validators._custom.get(r.verify) for r in rules if r.verify}

    def check(name: str):
        function = custom[name] or _python_check(name)

        def guarded(value: str) -> bool:
            try:
                return True if function is None else bool(function(value))
            except Exception:
                return True

        return guarded

    labels = pa.array([r.label for r in rules], pa.string())

    @F.arrow_udf("array<struct<label: string, start: int, end: int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compiled = [(re.compile(r.pattern), r) for r in rules]
        checks = {name: check(name) for name in custom}
        for texts in batches:
            rows = (chosen_spans(t.as_py(), compiled, checks) if t.is_valid else None for t in texts)
            for part in lists(rows, ("start", "end", "ord")):
                start, end, ord = part.values.flatten()
                named = pa.StructArray.from_arrays([labels.take(ord), start, end], ["label", "start", "end"])
                yield pa.ListArray.from_arrays(part.offsets, named, mask=part.is_null())

    return run(text)
