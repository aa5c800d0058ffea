"""Span algebra over ``array<struct<label, start, end>>`` columns.

Offsets are code points, starts inclusive, ends exclusive. All functions are SQL
expressions within a row: they need no shuffle. A null text or array gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import validators
from maskwright.sources.rules import RegexRule

SPAN = "struct<label: string, start: int, end: int>"
SPANS = f"array<{SPAN}>"
DETECTED = "array<struct<label: string, start: int, end: int, text: string, placeholder: string>>"
REDACTED = "<REDACTED>"
#: What Python's str.strip takes away.
STRIPPED = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once per row, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty(kind: str = SPANS) -> Column:
    return F.expr(f"cast(array() as {kind})")


_BLOCK = 32


def places(first: Column, end: Column) -> Column:
    """The integers from first up to end, without it."""
    return F.when(end > first, F.sequence(first, end - 1)).otherwise(empty("array<int>"))


def before(values: Column, join: Callable[[Column, Column], Column], start: Column) -> Column:
    """For each element of an array of numbers, ``join`` over all before it, from ``start``,
    which adds nothing to a value that was joined with it.

    A fold that builds an array copies it at every step, but copies are cheap beside
    steps: folds run within blocks of 32, and over the last values of the blocks.
    """

    def running(v: Column) -> Column:
        """One value more than ``v`` has: the last is over all of it."""
        return F.aggregate(v, F.array(start), lambda acc, x: F.array_append(acc, join(F.get(acc, F.size(acc) - 1), x)))

    def blocks(v: Column) -> Column:
        count = F.floor((F.size(v) + _BLOCK - 1) / _BLOCK).cast("int")
        return F.transform(places(F.lit(0), count), lambda b: running(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))

    def joined(parts: Column, above: Column) -> Column:
        return F.flatten(F.transform(parts, lambda p, b: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: join(F.get(above, b), x))))

    return let(let(values, blocks), lambda parts: let(running(F.transform(parts, lambda p: F.get(p, F.size(p) - 1))), lambda above: joined(parts, above)))


def plus(a: Column, b: Column) -> Column:
    return a + b


def leading(size: Column, holds: Callable[[Column], Column]) -> Column:
    """How many of the places 0, 1, ... ``holds`` is true for, which it is up to some
    place and not beyond, by binary search."""
    steps = F.transform(F.sequence(F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)), lambda b: F.pow(F.lit(2), b).cast("int"))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= size) & holds(n + step - 1), n + step).otherwise(n))


def runs(size: Column, opens: Callable[[Column], Column]) -> Column:
    """array<struct<first, end>>: stretches of places, each from one that opens up to the next."""

    def closed(firsts: Column) -> Column:
        return F.transform(firsts, lambda k, j: F.struct(k.alias("first"), F.coalesce(F.get(firsts, j + 1), size).alias("end")))

    return let(F.filter(places(F.lit(0), size), opens), closed)


def span(label: Column, start: Column, end: Column) -> Column:
    return F.struct(label.alias("label"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def overlaps(a: Column, b: Column) -> Column:
    return (a["end"] > b["start"]) & (a["start"] < b["end"])


def checked(spans: Column) -> Column:
    """``spans``, failing the query on a span that starts below 0 or ends too early."""
    bad = F.exists(spans, lambda s: (s["start"] < 0) | (s["end"] < s["start"]))
    return F.when(bad, F.raise_error(F.lit("a span needs 0 <= start <= end"))).otherwise(spans)


# regex scan -------------------------------------------------------------------


#: Set around matches to split a text at them; a text that holds it takes a slower path.
_MARK = "\x01"


def regex_pieces(text: Column, pattern: str) -> Column:
    """The text before the first match, the match, the text up to the next one, and so on.

    One search marks the matches, and a split by the mark needs none.
    """
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)

    def woven(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        return F.flatten(F.transform(gaps, lambda gap, k: F.when(k < F.size(found), F.array(gap, F.get(found, k))).otherwise(F.array(gap))))

    return F.when(F.contains(text, F.lit(_MARK)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), woven)).otherwise(marked)


def regex_matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of leftmost non-overlapping matches.

    ``pattern`` is in Java's dialect and never matches the empty string: the texts
    between matches then give the offsets in code points.
    """
    kind = "struct<start: int, end: int, text: string>"

    def placed(pieces: Column) -> Column:
        def entry(at: Column, k: Column) -> Column:
            match = F.get(pieces, 2 * k + 1)
            start = at + F.length(F.get(pieces, 2 * k))
            return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("text"))

        count = F.floor(F.size(pieces) / 2).cast("int")
        sizes = F.transform(places(F.lit(0), count), lambda k: F.length(F.get(pieces, 2 * k)) + F.length(F.get(pieces, 2 * k + 1)))
        return F.transform(before(sizes, plus, F.lit(0)), entry)

    return let(regex_pieces(text, pattern), lambda pieces: F.when(F.size(pieces) > 1, placed(pieces)).when(pieces.isNotNull(), empty(f"array<{kind}>")))


_CANDIDATE = "struct<rank: int, shorter: int, start: int, ord: int, end: int, label: string>"


def candidates(text: Column, rule: RegexRule, ord: int) -> Column:
    """A rule's verified matches, as sort keys of the greedy choice."""
    found = regex_matches(text, rule.java)
    if rule.verify:
        found = F.filter(found, lambda m: validators.verify(rule.verify, m["text"]))
    return F.transform(
        found,
        lambda m: F.struct(
            F.lit(-rule.priority).alias("rank"), (m["start"] - m["end"]).alias("shorter"), m["start"].alias("start"), F.lit(ord).alias("ord"), m["end"].alias("end"), F.lit(rule.label).alias("label")
        ),
    )


def greedy(found: Column, kind: str) -> Column:
    """Elements in their own order, without those that overlap one already taken.

    Elements are structs of ``kind`` that sort by precedence. Only runs of elements
    that overlap one another are compared, so disjoint matches cost nothing.
    """

    def best(run: Column) -> Column:
        def step(kept: Column, x: Column) -> Column:
            return F.when(F.exists(kept, lambda k: overlaps(k, x)), kept).otherwise(F.array_append(kept, x))

        return F.aggregate(F.sort_array(run), empty(f"array<{kind}>"), step)

    def chosen(placed: Column) -> Column:
        def taken(run: Column) -> Column:
            one = F.array(F.get(placed, run["first"])["x"])
            several = F.transform(places(run["first"], run["end"]), lambda k: F.get(placed, k)["x"])
            return F.when(run["end"] - run["first"] == 1, one).otherwise(best(several))

        ends = F.transform(placed, lambda p: p["x"]["end"])
        parted = let(before(ends, F.greatest, F.lit(0)), lambda reach: runs(F.size(placed), lambda k: F.get(placed, k)["at"] >= F.get(reach, k)))
        return F.flatten(F.transform(parted, taken))

    def ordered(every: Column) -> Column:
        return F.sort_array(F.transform(every, lambda x: F.struct(x["start"].alias("at"), x.alias("x"))))

    return let(found, lambda every: F.when(F.size(every) <= 1, every).otherwise(let(ordered(every), chosen)))


def by_start(spans: Column) -> Column:
    """Label, start and end of each element, by start (then end and label)."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))
    return F.transform(F.sort_array(keyed), lambda s: span(s["label"], s["start"], s["end"]))


def regex_spans(text: Column, rules: Sequence[RegexRule]) -> Column:
    """Non-overlapping spans of all rules: higher priority, then longer, then earlier,
    then the rule that comes first."""
    if not rules:
        return F.when(text.isNotNull(), empty())
    every = F.concat(*[candidates(text, rule, ord) for ord, rule in enumerate(rules)])
    return F.when(text.isNotNull(), let(every, lambda found: by_start(greedy(found, _CANDIDATE))))


# filters and merging ----------------------------------------------------------


@dataclass(frozen=True)
class SpanTrim:
    """Cut a trailing suffix off a span that ends in ``after`` and one of suffixes."""

    label: str
    after: str
    suffixes: tuple[str, ...]
    min_keep: int = 1


@dataclass(frozen=True)
class NerPrecedence:
    """Model spans of ``label`` beat overlapping regex spans labelled one of over."""

    label: str
    over: tuple[str, ...]


def surface(text: Column, s: Column) -> Column:
    return F.substring(text, s["start"] + 1, s["end"] - s["start"])


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{STRIPPED}+|{STRIPPED}+$", "")


def filter_stopwords(spans: Column, text: Column, stopwords: Sequence[str]) -> Column:
    """Spans whose stripped text is none of ``stopwords``; a bounded list per pack."""
    if not stopwords:
        return spans
    words = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(spans, lambda s: ~F.array_contains(words, strip(surface(text, s))))


def trim_trailing(spans: Column, text: Column, trims: Sequence[SpanTrim]) -> Column:
    """Spans with at most one suffix cut: for the first rule in order whose longest
    matching suffix leaves ``min_keep`` characters."""
    if not trims:
        return spans

    def cut(s: Column) -> Column:
        own = surface(text, s)
        size = s["end"] - s["start"]
        chosen = None
        for trim in trims:
            longest = None
            for suffix in sorted(trim.suffixes, key=len, reverse=True):
                ends = own.endswith(trim.after + suffix)
                longest = F.when(ends, len(suffix)) if longest is None else longest.when(ends, len(suffix))
            applies = (s["label"] == trim.label) & (size - longest >= trim.min_keep)
            chosen = F.when(applies, longest) if chosen is None else chosen.when(applies, longest)
        return span(s["label"], s["start"], s["end"] - chosen.otherwise(0))

    return F.transform(spans, cut)


def apply_ner_precedence(regex: Column, ner: Column, rules: Sequence[NerPrecedence]) -> Column:
    """Regex spans without those that a model span of higher precedence overlaps."""
    if not rules:
        return regex

    def beaten(r: Column) -> Column:
        lost = F.lit(False)
        for rule in rules:
            lost = lost | (r["label"].isin(*rule.over) & F.exists(ner, lambda n: (n["label"] == rule.label) & overlaps(r, n)))
        return lost

    return F.filter(regex, lambda r: ~beaten(r))


_MERGING = "struct<origin: int, shorter: int, start: int, ord: int, end: int, label: string>"


def merge_union(df: DataFrame, regex: Column, ner: Column, out: str) -> DataFrame:
    """``df`` with both span sets without overlaps in the column ``out``.

    A regex span grows over overlapping model spans of its label, again and again as
    it grows; each of them is absorbed once, by the first regex span that reaches it.
    Then regex spans go before model spans, longer before shorter, earlier before later.

    Model spans of a label that overlap one another form chains, disjoint and in order:
    a regex span that overlaps a chain reaches all of it, and the first such takes it.
    Labels are set apart by adding a multiple of 2**32 to their offsets, so that one
    sweep serves all of them. The steps are projections of one narrow stage.
    """
    r, n, reach, chains, owners, temporary = (F.col(f"_mw_{x}") for x in ("r", "n", "reach", "chains", "owners", "labels"))
    apart = F.shiftleft(F.lit(1).cast("long"), 32)

    def lifted(spans: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            base = F.array_position(temporary, x["label"]) * apart
            return F.struct((base + x["start"]).alias("start"), (base + x["end"]).alias("end"), k.alias("ord"), x["start"].alias("s"), x["end"].alias("e"), x["label"].alias("label"))

        return F.sort_array(F.transform(spans, one))

    def highest(spans: Column) -> Column:
        return before(F.transform(spans, lambda x: x["end"]), F.greatest, F.lit(-1).cast("long"))

    def hull(c: Column) -> Column:
        first = F.get(n, c["first"])
        end = F.aggregate(places(c["first"], c["end"]), F.lit(-1).cast("long"), lambda acc, k: F.greatest(acc, F.get(n, k)["end"]))
        return F.struct(first["start"].alias("start"), end.alias("end"), (end - first["start"] + first["s"]).cast("int").alias("e"), first["s"].alias("s"), c["first"].alias("first"), c["end"].alias("last"))

    def owner(c: Column) -> Column:
        """The first regex span that overlaps a chain, among those that end after its
        start, by their running maximum, and start before its end."""
        low = leading(F.size(r), lambda k: F.greatest(F.get(reach, k), F.get(r, k)["end"]) <= c["start"])
        high = leading(F.size(r), lambda k: F.get(r, k)["start"] < c["end"])
        return F.aggregate(places(low, high), F.lit(None).cast("int"), lambda acc, k: F.when(overlaps(F.get(r, k), c), F.least(acc, F.get(r, k)["ord"])).otherwise(acc))

    def sorted_by(origin: int, start: Column, end: Column, ord: Column, label: Column) -> Column:
        return F.struct(F.lit(origin).alias("origin"), (start - end).alias("shorter"), start.alias("start"), ord.alias("ord"), end.alias("end"), label.alias("label"))

    def grown(x: Column) -> Column:
        low = leading(F.size(chains), lambda k: F.get(chains, k)["end"] <= x["start"])
        high = leading(F.size(chains), lambda k: F.get(chains, k)["start"] < x["end"])
        mine = F.filter(places(low, high), lambda k: F.get(owners, k) == x["ord"])

        def widened(m: Column) -> Column:
            start = F.least(x["s"], F.get(chains, F.get(m, F.lit(0)))["s"])
            return sorted_by(0, start, F.greatest(x["e"], F.get(chains, F.get(m, F.size(m) - 1))["e"]), x["ord"], x["label"])

        return let(mine, widened)

    free = F.filter(places(F.lit(0), F.size(chains)), lambda k: F.get(owners, k).isNull())
    left = F.flatten(F.transform(free, lambda k: F.transform(places(F.get(chains, k)["first"], F.get(chains, k)["last"]), lambda j: F.get(n, j))))
    every = F.concat(F.transform(r, grown), F.transform(left, lambda x: sorted_by(1, x["s"], x["e"], x["ord"], x["label"])))

    df = df.withColumns({"_mw_labels": F.array_distinct(F.transform(F.concat(regex, ner), lambda x: x["label"])), "_mw_r": regex, "_mw_n": ner})
    df = df.withColumns({"_mw_r": lifted(r), "_mw_n": lifted(n)})
    df = df.withColumns({"_mw_reach": highest(r), "_mw_chains": highest(n)})
    df = df.withColumn("_mw_chains", F.transform(runs(F.size(n), lambda k: F.get(n, k)["start"] >= F.get(chains, k)), hull))
    df = df.withColumn("_mw_owners", F.transform(chains, owner))
    df = df.withColumn("_mw_labels", every)
    return df.withColumn(out, by_start(greedy(temporary, _MERGING))).drop("_mw_r", "_mw_n", "_mw_reach", "_mw_chains", "_mw_owners", "_mw_labels")


def coalesce_adjacent(spans: Column) -> Column:
    """Spans of one label that touch or overlap, merged with the one before them."""

    def changed(s: Column, k: Column) -> Column:
        return (k == 0) | (F.get(s, k)["label"] != F.get(s, k - 1)["label"])

    def merged(s: Column) -> Column:
        # stretches of one label are numbered, so that ends of an earlier one never reach
        turns = F.transform(s, lambda _, k: changed(s, k).cast("long"))
        numbers = let(turns, lambda t: F.zip_with(before(t, plus, F.lit(0).cast("long")), t, plus))

        def joined(stretch: Column) -> Column:
            lifted = F.shiftleft(F.lit(1).cast("long"), 32)
            ends = F.transform(s, lambda x, k: F.get(stretch, k) * lifted + x["end"])

            def run(r: Column) -> Column:
                first = F.get(s, r["first"])
                end = F.aggregate(places(r["first"], r["end"]), first["end"], lambda acc, k: F.greatest(acc, F.get(s, k)["end"]))
                return span(first["label"], first["start"], end)

            return let(before(ends, F.greatest, F.lit(-1).cast("long")), lambda reach: F.transform(runs(F.size(s), lambda k: F.get(stretch, k) * lifted + F.get(s, k)["start"] > F.get(reach, k)), run))

        return let(numbers, joined)

    # stable order by start and end
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("ord"), s["label"].alias("label")))
    return let(F.sort_array(keyed), merged)


# results ----------------------------------------------------------------------


def assemble(text: Column, spans: Column, output_mode: str = "typed", entity_types: Sequence[str] | None = None) -> Column:
    """Detected spans with their text and placeholder, by start.

    ``entity_types`` filters after merging, so a label left out still suppresses what
    it overlapped; None is all, an empty list none.
    """
    if entity_types is not None:
        wanted = list(entity_types)
        spans = F.filter(spans, lambda s: s["label"].isin(*wanted)) if wanted else F.when(spans.isNotNull(), empty())

    def detected(s: Column) -> Column:
        generic = output_mode == "redacted"
        label = F.lit("redacted") if generic else s["label"]
        placeholder = F.lit(REDACTED) if generic else F.concat(F.lit("<"), s["label"], F.lit(">"))
        return F.struct(label.alias("label"), s["start"].alias("start"), s["end"].alias("end"), surface(text, s).alias("text"), placeholder.alias("placeholder"))

    return F.transform(spans, detected)


def rendered(text: Column, detected: Column, replace: Callable[[Column], Column]) -> Column:
    """``text`` with each of disjoint sorted spans replaced."""

    def part(s: Column, k: Column) -> Column:
        last = F.when(k > 0, F.get(detected, k - 1)["end"]).otherwise(0)
        return F.concat(F.substring(text, last + 1, s["start"] - last), replace(s))

    end = F.get(detected, F.size(detected) - 1)["end"]
    masked = F.concat(F.array_join(F.transform(detected, part), ""), F.substring(text, end + 1, F.length(text)))
    return F.when(F.size(detected) > 0, masked).otherwise(text)


def redacted_text(text: Column, detected: Column) -> Column:
    return rendered(text, detected, lambda s: s["placeholder"])


def highlighted(text: Column, detected: Column) -> Column:
    """``text`` with each span as [text](LABEL)."""
    return rendered(text, detected, lambda s: F.concat(F.lit("["), s["text"], F.lit("]("), s["label"], F.lit(")")))


def label_counts(detected: Column) -> Column:
    """Sorted array<struct<label, n>>."""
    labels = F.transform(detected, lambda s: s["label"])
    return F.transform(F.array_sort(F.array_distinct(labels)), lambda x: F.struct(x.alias("label"), F.size(F.filter(labels, lambda y: y == x)).alias("n")))


def exploded(df: DataFrame, keys: Sequence[str | Column], spans: str | Column) -> DataFrame:
    """A row for each span: keys, label, start, end.

    An outer explode and a filter on its output: for an inner one the optimizer adds
    a filter on the array below, which computes the array's expression again.
    """
    return df.select(*keys, F.explode_outer(spans).alias("_mw_span")).filter("_mw_span is not null").select(*keys, "_mw_span.label", "_mw_span.start", "_mw_span.end")


def summary(detected: Column, output_mode: Column, mismatch: Column) -> Column:
    counts = label_counts(detected)
    by_label = F.map_from_entries(counts)
    return F.struct(output_mode.alias("output_mode"), F.size(detected).alias("span_count"), by_label.alias("by_label"), mismatch.alias("decoded_mismatch"))
