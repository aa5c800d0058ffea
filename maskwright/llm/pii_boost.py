"""Personal data by boosted trees over candidate spans, in SQL expressions only.

High-recall generators propose spans, which may overlap: each is a pattern, and some
are refined by a check of their digits. Base spans (valid emails, IPv4 addresses,
card numbers and phone numbers) are final. Every other candidate is scored by
gradient-boosted trees over features of its format and of the words before it, and
stays where its calibrated probability reaches its kind's threshold.

The trees are trained here, on ``TRAINING_ROWS`` synthetic labelled spans that
``labelled_spans`` makes from a fixed seed, and then written as nested CASE
expressions; Platt scaling on a held-out third calibrates them. A kind's threshold is
the least at which ``PRECISION`` of what it selects is right among
``THRESHOLD_ROWS`` spans of another generator, ``written_spans``, whose sentences and
formats are others.

Offsets are code points, ends exclusive. A null text is empty and has no spans.
Repeated and overlapping spans of different kinds all stay; redaction takes their
union. Rows are independent, so ties and repeated rows need no rule: each has its own
result. Work grows with a text's length and its number of spans, times the logarithm of
that number. Columns other than the id and the text are not read; ``redact`` returns
all columns, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import before, documents_of, let, places

#: Kinds in the order that ties at one start are listed in.
BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider candidates; their matches that are not base spans are scored.
WIDE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}(?: ?\(at\) ?| ?\[at\] ?| AT | at )[A-Za-z0-9-]{1,63}(?:(?: ?\(dot\) ?| ?\[dot\] ?| DOT | dot |\.)[A-Za-z0-9-]{2,63}){1,4}",
    "card": r"(?<![0-9])[0-9]{4}(?:[0-9]{12}|(?: [0-9]{4}){3}|(?:-[0-9]{4}){3})(?![0-9])",
    "phone": r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "secret": r"[A-Za-z0-9_-]{20,}",
}
#: The base patterns as they are run: they match the same, but iterate where a group
#: repeats and start only where a run of the first class starts or a match ended, so
#: that long runs cost neither stack nor quadratic time.
RUN_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap signs that a text may have a kind's matches.
BASE_SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WIDE_SIGNS = {"email": r"(?:\(at\)|\[at\]| AT | at )", "card": r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", "phone": r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "secret": r"[A-Za-z0-9_-]{20}"}
ORDER = ("email", "ip", "card", "phone", "ssn", "secret")
CONTEXT_CHARS, AFTER_CHARS = 24, 2
FEATURES = ("length", "digits", "letters", "upper", "separators", "groups", "changes", "cue", "own_cue", "near_digits", "quoted", "glued", "continued", "checksum")
CUES = r"(?i)(?:phone|tel|call|fax|mobile|contact|mail|write|reach|ssn|social|token|secret|key|password|passwd|auth|bearer|card|account)\W{0,4}$|[=:]\s*[\"']?$"
#: Words shortly before a span that speak of its own kind.
OWN_CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|write|reach|contact|address)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|account|paid|charge[ds]?|credit)\b",
    "phone": r"(?i)\b(?:phone|tel|call|fax|mobile|cell|text|dial|ring)\b",
    "ssn": r"(?i)\b(?:ssn|social|security)\b",
    "secret": r"(?i)(?:token|secret|key|password|passwd|auth|bearer|credential)",
}
TRAINING_ROWS = 3000
THRESHOLD_ROWS = 3000
PRECISION = 0.98
TREES, DEPTH, RATE = 40, 3, 0.2
SEED = 5


def luhn(digits: str) -> bool:
    doubled = [int(c) * 2 for c in digits[-2::-2]]
    return digits != "" and (sum(map(int, digits[::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


# features, once for training and once in SQL ----------------------------------


def features(kind: str, span: str, before: str, after: str) -> list[float]:
    kinds = "".join("d" if c.isascii() and c.isdigit() else "l" if c.isascii() and c.isalpha() else "s" for c in span)
    return [
        float(len(span)),
        float(kinds.count("d")),
        float(kinds.count("l")),
        float(len(re.findall("[A-Z]", span))),
        float(kinds.count("s")),
        float(len(re.findall("[0-9]+", span))),
        float(len(re.findall("[0-9][A-Za-z]|[A-Za-z][0-9]", span))),
        float(re.search(CUES, before) is not None),
        float(re.search(OWN_CUES[kind], before) is not None),
        float(len(re.findall("[0-9]", before))),
        float(before[-1:] in ('"', "'") and after[:1] in ('"', "'") and before != "" and after != ""),
        float(re.match("[A-Za-z0-9]", after) is not None or re.search("[A-Za-z0-9]$", before) is not None),
        float(re.match("[.-]?[0-9]", after) is not None or re.search("[0-9][.-]?$", before) is not None),
        float(luhn(re.sub("[^0-9]", "", span))),
    ]


def feature_columns(kind: str, span: Column, before: Column, after: Column) -> dict[str, Column]:
    def count(pattern: str) -> Column:
        return F.regexp_count(span, F.lit(pattern))

    return {
        "length": F.length(span),
        "digits": count("[0-9]"),
        "letters": count("[A-Za-z]"),
        "upper": count("[A-Z]"),
        "separators": count("[^A-Za-z0-9]"),
        "groups": count("[0-9]+"),
        "changes": count("[0-9][A-Za-z]|[A-Za-z][0-9]"),
        "cue": before.rlike(CUES).cast("int"),
        "own_cue": before.rlike(OWN_CUES[kind]).cast("int"),
        "near_digits": F.regexp_count(before, F.lit("[0-9]")),
        "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("int"),
        "glued": (after.rlike("^[A-Za-z0-9]") | before.rlike("[A-Za-z0-9]$")).cast("int"),
        "continued": (after.rlike("^[.-]?[0-9]") | before.rlike("[0-9][.-]?$")).cast("int"),
        "checksum": F.call_function("luhn_check", _digits(span)).cast("int"),
    }


# training ---------------------------------------------------------------------


def labelled_spans(rows: int = TRAINING_ROWS, seed: int = SEED) -> tuple[list[list[float]], list[int], list[str]]:
    """Features, labels and kinds of synthetic candidates."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word(a: int = 2, b: int = 9) -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def prose() -> str:
        return " ".join(word() for _ in range(4))

    x, y, kinds = [], [], []
    for _ in range(rows):
        kind, good = rng.choice(("email", "card", "phone", "ssn", "secret")), rng.random() < 0.5
        before, after = prose() + " ", " " + prose()
        if kind == "email":
            at, dot = rng.choice(((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]")))
            span = f"{word()}{at}{word()}{dot}{rng.choice(('com', 'org', 'net'))}" if good else f"{word()} at {word()}.{word(2, 3)}"
            before = rng.choice((before, before + "mail ", before + "reach ")) if good else before
        elif kind == "card":
            sep, number = rng.choice(("", " ", "-")), digits(15)
            last = next(c for c in "0123456789" if luhn(number + c))
            number += last if good else str((int(last) + rng.randint(1, 9)) % 10)
            span = sep.join(number[k : k + 4] for k in range(0, 16, 4))
            before = rng.choice((before, before + "card ", before + digits(16) + " "))
        elif kind == "phone":
            sep = rng.choice("-. ")
            span = f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}"
            span = f"({span[:3]}) {span[4:]}" if rng.random() < 0.4 and good else span
            if good:
                before += rng.choice(("call ", "phone: ", "tel. ", "fax ", "")) if span[0] == "(" or sep == "-" else rng.choice(("call ", "tel. "))
            else:
                before += rng.choice(("", "", "call ", "tel. "))
                before, after = rng.choice(((before + digits(3) + rng.choice("-."), after), (before, rng.choice("-.") + digits(4)), (before + digits(1), after), (before, digits(2))))
        elif kind == "ssn":
            span = f"{digits(3)}-{digits(2)}-{digits(4)}"
            before += rng.choice(("ssn ", "social ", "SSN: ", ""))
            if not good:
                before, after = rng.choice(((before + digits(2), after), (before, digits(2) + after), (before + digits(3) + "-", after), (before, "-" + digits(2) + after)))
        elif good:
            alphabet = rng.choice(("0123456789abcdef", letters + letters.upper() + "0123456789"))
            span = "".join(rng.choice(alphabet) for _ in range(rng.randint(24, 48))) + digits(2)
            before += rng.choice(('token = "', "key: ", 'secret="', "password = '", "token "))
            after = before[-1] + after if before[-1] in "\"'" else after
        else:
            span = rng.choice((word(20, 30), "_" * rng.randint(20, 40), "-" * rng.randint(20, 60), digits(24), word(8, 12) + "-" + word(8, 12) + "-" + word(4, 9), word(18, 24) + digits(2)))
        x.append(features(kind, span, before[-CONTEXT_CHARS:], after[:AFTER_CHARS]))
        y.append(int(good))
        kinds.append(kind)
    return x, y, kinds


def written_spans(rows: int = THRESHOLD_ROWS, seed: int = SEED + 1) -> tuple[list[list[float]], list[int], list[str]]:
    """The same of sentences, records and log lines, for thresholds."""
    rng = random.Random(seed)
    names = ("ada", "boris", "chen.li", "d_okafor", "emma-lund", "farid", "greta99")
    hosts = ("harbor", "north-lake", "papermill", "quartz", "tidewater")

    def digits(*groups: int) -> list[str]:
        return ["".join(rng.choice("0123456789") for _ in range(n)) for n in groups]

    def card(valid: bool) -> str:
        number = rng.choice("3456") + digits(14)[0]
        last = next(c for c in "0123456789" if luhn(number + c))
        return number + (last if valid else rng.choice([c for c in "0123456789" if c != last]))

    def email(good: bool) -> tuple[str, str, str]:
        if good:
            at, dot = rng.choice(((" at ", " dot "), (" (at) ", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" AT ", " DOT ")))
            return rng.choice(("Please contact ", "send it to ", "Author: ", "Questions? Mail ", "")), f"{rng.choice(names)}{at}{rng.choice(hosts)}{dot}{rng.choice(('com', 'net', 'edu', 'io'))}", rng.choice((".", ", thanks", "\n", ""))
        return rng.choice(("We met ", "The sale ended ", "they stopped ", "She works ")), f"{rng.choice(('late', 'dinner', 'home', 'prices', 'desk'))} at {rng.choice(('noon', 'dawn', 'work', 'school'))}.{rng.choice(('The', 'It', 'We', 'Then', 'But'))}", " rest"

    def cards(good: bool) -> tuple[str, str, str]:
        own = card(good)
        own = rng.choice(("", " ", "-")).join(own[k : k + 4] for k in range(0, 16, 4))
        if good:
            return rng.choice(("Charged to ", "my visa ", '"card": "', "payment by credit card ", "no. ")), own, rng.choice((" today", '"', ".", ", exp 09/27"))
        return rng.choice(("order ", "tracking ", "ref ", "serial ", "batch ")), own, rng.choice((" shipped", ".", ";"))

    def phone(good: bool) -> tuple[str, str, str]:
        a, b, c = digits(3, 3, 4)
        if good:
            return rng.choice(("Ring me on ", "phone = ", "Tel: ", "cell ", "or dial ", "Contact: ")), rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}")), rng.choice((".", " after six", ",", "\n"))
        return rng.choice((f"part {digits(3)[0]}-", f"id {digits(2)[0]}", "range " + digits(4)[0] + ".")), rng.choice((f"{a}-{b}-{c}", f"{a}.{b}.{c}")), rng.choice((digits(2)[0], "-" + digits(3)[0], "." + digits(2)[0]))

    def ssn(good: bool) -> tuple[str, str, str]:
        own = "-".join(digits(3, 2, 4))
        if good:
            return rng.choice(("Social security number ", "SSN ", "ssn=", "SSN: ", "his social is ")), own, rng.choice((".", " on file", ",", "\n"))
        return rng.choice(("part " + digits(2)[0], "isbn 978-" + digits(1)[0], "lot " + digits(4)[0])), own, rng.choice((digits(1)[0], "-" + digits(1)[0], digits(3)[0]))

    def secret(good: bool) -> tuple[str, str, str]:
        if good:
            alphabet = rng.choice(("abcdef0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789_-"))
            own = digits(1)[0] + "".join(rng.choice(alphabet) for _ in range(rng.choice((31, 39, 43)))) + digits(1)[0]
            before, after = rng.choice((("api_key = '", "'"), ("export AUTH_TOKEN=", "\n"), ('"password": "', '"'), ("Authorization: Bearer ", "\n"), ("secret key ", " expired")))
            return before, own, after
        own = rng.choice(("_".join(rng.choices(("report", "summary", "final", "draft", "team", "north"), k=5)), "-".join(rng.choices(("state", "of", "the", "art", "kind", "once"), k=7)), "=" * 0 + "_" * rng.randint(20, 70), "x" * rng.randint(20, 50), "counter" * 4, digits(26)[0]))
        return rng.choice(("see ", "the ", "file ", "a ", "")), own.ljust(20, own[-1]), rng.choice((" end", ".", "\n"))

    makers = {"email": email, "card": cards, "phone": phone, "ssn": ssn, "secret": secret}
    x, y, kinds = [], [], []
    for k in range(rows):
        kind, good = tuple(makers)[k % len(makers)], rng.random() < 0.5
        before, span, after = makers[kind](good)
        if rng.random() < 0.15:
            # no cue at all, or that of the other label
            before = "" if good else makers[kind](True)[0]
        before = " ".join(rng.choices(("notes", "from", "our", "meeting", "with", "them"), k=5)) + rng.choice((" ", ". ", "\n")) + before
        x.append(features(kind, span, before[-CONTEXT_CHARS:], after[:AFTER_CHARS]))
        y.append(int(good))
        kinds.append(kind)
    return x, y, kinds


@dataclass(frozen=True)
class Node:
    """A split (feature <= limit goes left) or, with no feature, a leaf."""

    value: float = 0.0
    feature: int = -1
    limit: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def score(self, row) -> float:
        node = self
        while node.left is not None:
            node = node.left if row[node.feature] <= node.limit else node.right
        return node.value


def _grown(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int) -> Node:
    """The regression tree of Newton steps of the log loss."""
    g, h = gradient.sum(), weight.sum()
    leaf = Node(value=float(g / (h + 1.0)))
    if depth == 0 or len(x) < 16:
        return leaf
    best = (1e-6, -1, 0.0)
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for low, high in zip(values[:-1], values[1:], strict=True):
            limit = (low + high) / 2
            side = x[:, k] <= limit
            gl, hl = gradient[side].sum(), weight[side].sum()
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            if gain > best[0]:
                best = (gain, k, limit)
    if best[1] < 0:
        return leaf
    side = x[:, best[1]] <= best[2]
    return Node(0.0, best[1], float(best[2]), _grown(x[side], gradient[side], weight[side], depth - 1), _grown(x[~side], gradient[~side], weight[~side], depth - 1))


@dataclass(frozen=True)
class Boosted:
    """Trees whose rounded sum, scaled and shifted, is a log-odds."""

    trees: tuple[Node, ...]
    scale: float
    shift: float

    def probability(self, row) -> float:
        return 1 / (1 + np.exp(-(self.scale * sum(t.score(row) for t in self.trees) + self.shift)))


@cache
def model(kind: str, rows: int = TRAINING_ROWS, seed: int = SEED) -> Boosted:
    """The boosted trees of one kind, with Platt scaling on a held-out third."""
    x, y, kinds = labelled_spans(rows, seed)
    own = [i for i, k in enumerate(kinds) if k == kind]
    x, y = np.array(x)[own], np.array(y, float)[own]
    held = np.arange(len(x)) % 3 == 0
    fit, score, trees = x[~held], np.zeros((~held).sum()), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grown(fit, y[~held] - p, p * (1 - p), DEPTH))
        trees[-1] = _scaled(trees[-1], RATE)
        score = score + np.array([trees[-1].score(r) for r in fit])
    raw = np.array([sum(t.score(r) for t in trees) for r in x[held]])
    scale, shift = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(scale * raw + shift)))
        scale += 0.05 * ((y[held] - p) * raw).mean() - 0.001 * (scale - 1)
        shift += 0.05 * (y[held] - p).mean()
    return Boosted(tuple(trees), round(float(scale), 6), round(float(shift), 6))


@cache
def threshold(kind: str) -> float:
    """The least probability at which ``PRECISION`` of the selected spans is right."""
    x, y, kinds = written_spans()
    scored = sorted(((float(model(kind).probability(row)), label) for row, label, k in zip(x, y, kinds, strict=True) if k == kind), reverse=True)
    best, right = 1 - 1e-6, 0
    for n, (p, label) in enumerate(scored, 1):
        right += label
        below = scored[n][0] if n < len(scored) else 0.0
        if below < p and right >= PRECISION * n:
            # between what is selected and the next
            best = (p + below) / 2
    return round(best, 6)


def _scaled(node: Node, rate: float) -> Node:
    if node.left is None:
        return Node(value=round(node.value * rate, 6))
    return Node(0.0, node.feature, node.limit, _scaled(node.left, rate), _scaled(node.right, rate))


def _tree_column(node: Node, of: dict[str, Column]) -> Column:
    if node.left is None:
        return F.lit(node.value)
    return F.when(of[FEATURES[node.feature]] <= node.limit, _tree_column(node.left, of)).otherwise(_tree_column(node.right, of))


def log_odds(boosted: Boosted, of: dict[str, Column]) -> Column:
    """The calibrated log-odds as one SQL expression."""
    return reduce(lambda a, b: a + b, [_tree_column(t, of) for t in boosted.trees]) * boosted.scale + boosted.shift


# spans ------------------------------------------------------------------------


def matches(text: Column, pattern: str, context: bool = False) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, span, before, after>>.

    The texts between matches, from a split by the same pattern, give the offsets, and
    with ``context`` the characters before and after; without it these are null. A
    match of the wide patterns has a third of ``CONTEXT_CHARS`` or more.
    """

    def placed(found: Column, gaps: Column) -> Column:
        def last(array: Column, k: Column) -> Column:
            return F.right(F.coalesce(F.get(array, k), F.lit("")), F.lit(CONTEXT_CHARS))

        def near(array: Column, k: Column) -> Column:
            return F.left(F.coalesce(F.get(array, k), F.lit("")), F.lit(AFTER_CHARS))

        def entry(span: Column, k: Column, at: Column) -> Column:
            start = F.get(at, k) + F.length(F.get(gaps, k))
            ahead = behind = F.lit(None).cast("string")
            if context:
                behind = last(gaps, k)
                for n in range(1, 4):
                    behind = F.concat(last(gaps, k - n), last(found, k - n), behind)
                behind = F.right(F.when(F.length(F.get(gaps, k)) < CONTEXT_CHARS, behind).otherwise(last(gaps, k)), F.lit(CONTEXT_CHARS))
                ahead = F.left(F.concat(near(gaps, k + 1), near(found, k + 1)), F.lit(AFTER_CHARS))
            return F.struct(start.alias("start"), (start + F.length(span)).alias("end"), span.alias("span"), behind.alias("before"), ahead.alias("after"))

        sizes = F.transform(found, lambda span, k: F.length(F.get(gaps, k)) + F.length(span))
        return let(before(sizes, lambda a, b: a + b), lambda at: F.transform(found, lambda span, k: entry(span, k, at)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda gaps: placed(found, gaps)))


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def valid(kind: str, span: Column) -> Column:
    """The base check of a match's digits."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(span, r"\."), lambda part: F.ltrim(part, F.lit("0")).rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(span))
    if kind == "phone":
        return n.between(10, 15)
    return n.between(14, 19) & F.call_function("luhn_check", _digits(span))


def _typed(kind: str, spans: Column) -> Column:
    rank = ORDER.index(kind)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


_SPAN_TYPE = "array<struct<start: int, rank: int, kind: string, end: int>>"


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, RUN_PATTERNS[kind]), lambda s: valid(kind, s["span"]))
    return F.when(text.rlike(BASE_SIGNS[kind]), _typed(kind, found)).otherwise(F.expr(f"cast(array() as {_SPAN_TYPE})"))


def _meets(spans: Column, start: Column, end: Column) -> Column:
    """Whether one of disjoint spans in order overlaps [start, end), by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])

    def nearer(n: Column, step: Column) -> Column:
        return F.when((n + step <= F.size(spans)) & (F.get(spans, n + step - 1)["start"] < end), n + step).otherwise(n)

    # the last that starts before the end also ends last
    return F.coalesce(F.get(spans, F.aggregate(steps, F.lit(0), nearer) - 1)["end"] > start, F.lit(False))


def scored_spans(text: Column, kind: str, base: Column) -> Column:
    """Candidates of the wide pattern that reach their threshold and meet no base span.

    ``base`` is a struct of the base spans of each kind, disjoint and in order."""
    boosted, limit = model(kind), threshold(kind)
    limit = float(np.log(limit / (1 - limit)))

    def selected(s: Column) -> Column:
        of = F.struct(*[c.alias(n) for n, c in feature_columns(kind, s["span"], s["before"], s["after"]).items()])
        score = let(of, lambda row: log_odds(boosted, {n: row[n] for n in FEATURES}))
        free = F.lit(True)
        for k in BASE_PATTERNS:
            free = free & F.when(F.size(base[k]) > 0, ~_meets(base[k], s["start"], s["end"])).otherwise(True)
        return free & (score >= limit)

    found = F.filter(matches(text, WIDE_PATTERNS[kind], context=True), selected)
    return F.when(text.rlike(WIDE_SIGNS[kind]), _typed(kind, found)).otherwise(F.expr(f"cast(array() as {_SPAN_TYPE})"))


def with_spans(df: DataFrame, text: str) -> DataFrame:
    """(row, text, base, spans): rows of ``df`` as structs, so that no name clashes, with
    arrays of the base spans and of all spans, by start and kind."""
    held = df.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    held = held.withColumn("by_kind", F.struct(*[base_spans(F.col("text"), k).alias(k) for k in BASE_PATTERNS]))
    held = held.withColumn("base", F.sort_array(F.concat(*[F.col(f"by_kind.{k}") for k in BASE_PATTERNS])))
    added = [scored_spans(F.col("text"), k, F.col("by_kind")) for k in WIDE_PATTERNS]
    return held.select("row", "text", "base", F.sort_array(F.concat("base", *added)).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and all spans of each row."""
    table = with_spans(documents_of(docs, id_col, text_col), "text")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE_PATTERNS]
    return table.select("row.doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


#: Code points of the pieces that a text is cut into, as a substring counts from its start.
_PIECE = 1024


def redact(docs: DataFrame, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with each span's text replaced by its kind, as in <EMAIL>, and the new
    number of characters in ``count_col``.

    Where spans overlap, the union is replaced by the kind of the first.
    """
    table = with_spans(docs, text_col)

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / _PIECE).cast("int")
        last = F.floor((end - 1) / _PIECE).cast("int")
        near = F.array_join(F.transform(places(first, last + 1), lambda i: F.get(pieces, i)), "")
        return F.when(end > start, F.substring(near, start - first * _PIECE + 1, end - start)).otherwise("")

    def masked(pieces: Column) -> Column:
        def part(s: Column, k: Column, reach: Column) -> Column:
            own = F.concat(cut(pieces, F.get(reach, k), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
            return F.when(s["start"] >= F.get(reach, k), own).otherwise("")

        def joined(reach: Column) -> Column:
            end = F.aggregate("spans", F.lit(0), lambda acc, s: F.greatest(acc, s["end"]))
            return F.concat(F.array_join(F.transform("spans", lambda s, k: part(s, k, reach)), ""), cut(pieces, end, F.length("text")))

        return let(before(F.col("spans.end"), F.greatest), joined)

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    own = F.when(F.size("spans") > 0, let(pieces, masked)).otherwise(F.col("row")[text_col])
    table = table.select("row", own.alias("text"))
    columns = {c: F.col("row")[c] for c in docs.columns} | {text_col: F.col("text")}
    if count_col:
        columns[count_col] = F.length("text").cast("long")
    return table.select(*[value.alias(name) for name, value in columns.items()])
