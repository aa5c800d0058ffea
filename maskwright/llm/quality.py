"""Quality rules as a short-circuit cascade, in SQL expressions only.

Metrics of a text, over words ``[^\\x20\\x09-\\x0D]+``: n_words, word_chars (code
points in words), n_symbols (characters of ``[#*$%&|<>]``), n_dup_lines (lines with a
word that equal an earlier line), n_lines (lines with a word), n_repeat_words (words
in 3-word windows that the text has twice or more).

A document is kept if no rule rejects it. Rules are independent, so their order
changes cost alone: on a bounded sample each rule's time is measured, less that of a
job that does nothing, and which rules reject each row together. The rule with most
rejections per second goes first, then the one with most among the rows that it lets
pass, and so on. The sample is the first rows that arrive from the tasks of a scan,
``SAMPLE_ROWS`` at most; no result depends on it. Texts of any length are exact.

A null text has no words and is rejected. Ties between rules keep their listed
order. An empty table gives no rows. Other columns are not read by ``metrics``; the
filter ``keep`` returns all columns unchanged.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import SPACE_CHARS, SPACES, WORD, documents_of

SAMPLE_ROWS = 512
SYMBOLS = "[#*$%&|<>]"
#: Bits of a window's place in the long that also holds its hash; longer texts sort structs.
_PLACE_BITS = 24


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACE_CHARS, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("long")


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def n_lines(text: Column) -> Column:
    return F.size(lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    found = lines(text)
    return (F.size(found) - F.size(F.array_distinct(found))).cast("long")


def _let(value: Column, body) -> Column:
    """``body(value)`` with value computed once, also where a lambda uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_repeat_words(text: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more.

    Windows are longs of a 40-bit hash and their place; sorting puts equal hashes side
    by side. Where all windows of a hash have the same words, these are the repeated
    ones. Texts in which two differ, or with more places than the long holds, sort
    structs of the 64-bit hash, the words and the place: equal windows are then side by
    side whatever their hashes, at about ten times the cost.
    """
    bits = _PLACE_BITS

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def like(x: Column, y: Column) -> Column:
        return F.coalesce(F.shiftright(x, bits) == F.shiftright(y, bits), F.lit(False))

    def differ(w: Column, x: Column, y: Column) -> Column:
        equal = F.lit(True)
        for k in range(3):
            equal = equal & (F.get(w, place(x) + k) == F.get(w, place(y) + k))
        return ~equal

    def covered(at: Column) -> Column:
        widths = F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3))))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda total, x: total + x)

    def key(w: Column, i: Column) -> Column:
        three = [F.get(w, i + k) for k in range(3)]
        return F.struct(F.struct(F.xxhash64(*three), *three).alias("window"), i.alias("place"))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce(x["window"] == y["window"], F.lit(False))

    def by_words(keys: Column) -> Column:
        found = F.filter(keys, lambda x, k: same(x, F.get(keys, k - 1)) | same(x, F.get(keys, k + 1)))
        return _let(F.sort_array(F.transform(found, lambda x: x["place"])), covered)

    def exact(w: Column) -> Column:
        return _let(F.sort_array(F.transform(starts(w), lambda i: key(w, i))), by_words)

    def shared(keys: Column) -> Column:
        return F.filter(keys, lambda x, k: like(x, F.get(keys, k - 1)) | like(x, F.get(keys, k + 1)))

    def settled(w: Column, found: Column) -> Column:
        clashes = F.filter(found, lambda x, k: like(x, F.get(found, k - 1)) & differ(w, x, F.get(found, k - 1)))
        return F.when(F.size(clashes) > 0, exact(w)).otherwise(_let(F.sort_array(F.transform(found, place)), covered))

    def starts(w: Column) -> Column:
        return F.sequence(F.lit(0), F.size(w) - 3)

    def by_hashes(w: Column) -> Column:
        keys = F.transform(starts(w), lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")))
        return _let(F.sort_array(keys), lambda x: _let(shared(x), lambda found: settled(w, found)))

    def windows(w: Column) -> Column:
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).when(F.size(w) - 2 <= 1 << bits, by_hashes(w)).otherwise(exact(w))

    return _let(words(text), windows)


METRICS = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_lines": n_lines, "n_repeat_words": n_repeat_words}


@dataclass(frozen=True)
class Rule:
    """``reject`` takes the named metrics; true for what the rule rejects."""

    name: str
    metrics: tuple[str, ...]
    reject: Callable[..., Column]
    base: bool = False


RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 50, base=True),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 50 * n, base=True),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 100 * s > 25 * n),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda n, d: 100 * d > 50 * n),
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c < 2 * n) | (c > 15 * n)),
)


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and every metric of each row."""
    return documents_of(docs, id_col, text_col).select("doc_id", *[f(F.col("text")).alias(name) for name, f in METRICS.items()])


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by rejections per second on what those before let pass, highest first."""
    sample = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).limit(sample_rows).cache()
    try:
        if not sample.count():
            return list(rules)

        def seconds(rejected: Column) -> float:
            began = time.perf_counter()
            sample.agg(F.count_if(rejected)).collect()
            return time.perf_counter() - began

        verdicts = [rejects(rule, {m: METRICS[m](F.col("text")) for m in rule.metrics}) for rule in rules]
        idle = min(seconds(F.length("text") < k) for k in (0, -1, -2))
        costs = [max(seconds(v) - idle, 1e-4) for v in verdicts]
        # how many rows each set of rules rejects: at most one row for each set
        together = sample.select(*[v.alias(f"r{k}") for k, v in enumerate(verdicts)]).groupBy(*[f"r{k}" for k in range(len(rules))]).count().collect()
        return [rules[k] for k in greedy(costs, [(tuple(row)[:-1], row["count"]) for row in together])]
    finally:
        sample.unpersist()


def greedy(costs: list[float], together: list[tuple[tuple[bool, ...], int]]) -> list[int]:
    """The order by rejections per cost among the rows that no earlier rule rejects;
    ``together`` counts the rows that a set of rules rejects. Ties go to the first."""
    order: list[int] = []
    while len(order) < len(costs):
        passed = [(flags, n) for flags, n in together if not any(flags[k] for k in order)]
        left = [k for k in range(len(costs)) if k not in order]
        order.append(max(left, key=lambda k: (sum(n for flags, n in passed if flags[k]) / costs[k], -k)))
    return order


def rejects(rule: Rule, values: dict[str, Column]) -> Column:
    """The rule's verdict over metrics given as columns."""
    return rule.reject(*[values[m] for m in rule.metrics])


def cascade(rules: list[Rule], values: dict[str, Column]) -> Column:
    """True for documents that no rule rejects; later rules run only for what
    earlier ones let pass."""
    verdict = None
    for rule in rules:
        rejected = rejects(rule, values)
        verdict = F.when(rejected, False) if verdict is None else verdict.when(rejected, False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.filter(cascade(ordered(docs, rules, text_col), {m: f(text) for m, f in METRICS.items()}))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Metrics with base_failed and kept."""
    table = metrics(docs, id_col, text_col)
    values = {m: F.col(m) for m in METRICS}
    base_failed = F.lit(False)
    for rule in rules:
        if rule.base:
            base_failed = base_failed | rejects(rule, values)
    return table.withColumns({"base_failed": base_failed, "kept": cascade(ordered(docs, rules, text_col), values)})
