"""BIOES labels, transitions, and conversion between tags and spans.

Tokens are ``array<struct<s, e>>``; (0, 0) marks a special token. SQL expressions,
but for Viterbi decoding, which runs in numpy on Arrow batches by default.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.spans import empty, leading, let, places, span

# Fixed values ------------------------------------------------------------------
ENTITIES = ("PER", "PHONE", "ID_NUM", "EMAIL", "LOC", "BANK", "DATE", "SECRET")
PREFIXES = ("B", "I", "E", "S")
CATEGORIES = ("outside", "begin", "single", "inside", "end", "exit")
OPERATING_POINTS = {
    "high_recall": (-0.5, 1.0, 1.0, 0.8, 0.3, -0.3),
    "balanced": (0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "high_precision": (0.5, -1.0, -1.0, 0.2, 0.5, 0.5),
}
ILLEGAL = -1.0e4

#: Which category leads from a state to a next prefix; a state is outside or inside.
_FROM_OUTSIDE = {"B": "begin", "S": "single"}
_FROM_INSIDE = {"I": "inside", "E": "end"}


def label_list(entities: Sequence[str] = ENTITIES) -> list[str]:
    return ["O", *[f"{p}-{e}" for e in entities for p in PREFIXES]]


def label_maps(entities: Sequence[str] = ENTITIES) -> tuple[dict[str, int], dict[int, str]]:
    by_id = dict(enumerate(label_list(entities)))
    return {label: i for i, label in by_id.items()}, by_id


def category(previous: str, following: str) -> str | None:
    """The category of a transition, None if it is illegal."""
    state, _, entity = previous.partition("-")
    prefix, _, wanted = following.partition("-")
    if state in ("B", "I"):
        return _FROM_INSIDE.get(prefix) if wanted == entity else None
    if prefix == "O":
        return "outside" if state == "O" else "exit"
    return _FROM_OUTSIDE.get(prefix)


def transition_matrix(labels: Sequence[str], biases: Sequence[float]) -> np.ndarray:
    """[label, next label] scores; illegal ones have a large finite penalty."""
    if len(biases) != len(CATEGORIES):
        raise ValueError(f"{len(CATEGORIES)} biases are needed, not {len(biases)}")
    of = dict(zip(CATEGORIES, map(float, biases), strict=True))
    kinds = [[category(a, b) for b in labels] for a in labels]
    return np.array([[of[k] if k else ILLEGAL for k in row] for row in kinds]).reshape(len(labels), len(labels))


def _preset(name: str) -> Sequence[float]:
    if name in OPERATING_POINTS:
        return OPERATING_POINTS[name]
    raise KeyError(f"no operating point {name!r}; there are {', '.join(sorted(OPERATING_POINTS))}")


#: What an operating point may be, and how its biases are read.
_POINT_KINDS = (
    (type(None), lambda _: (0,) * len(CATEGORIES)),
    (str, _preset),
    (Mapping, lambda point: [point.get(c, 0) for c in CATEGORIES]),
    (object, tuple),
)


def resolve_operating_point(point: str | Mapping[str, float] | Sequence[float] | None) -> list[float]:
    """Six biases of a preset's name, a mapping (missing ones are 0) or a sequence."""
    read = next(reader for kind, reader in _POINT_KINDS if isinstance(point, kind))
    biases = [float(x) for x in read(point)]
    if len(biases) != len(CATEGORIES):
        raise ValueError(f"{len(CATEGORIES)} biases are needed, not {len(biases)}")
    return biases


def effective_biases(baseline: Column, offset: Column) -> Column:
    return F.zip_with(baseline, offset, lambda a, b: a + b)


# columns ----------------------------------------------------------------------


def entity_of(tag: Column) -> Column:
    """What follows the first hyphen; null for O."""
    return F.when(tag != "O", F.substr(tag, F.instr(tag, "-") + 1))


def prefix_of(tag: Column) -> Column:
    return F.when(tag != "O", F.substring_index(tag, "-", 1))


def category_column(previous: Column, following: Column) -> Column:
    """``category`` over columns."""
    inside = F.substring_index(previous, "-", 1).isin("B", "I")
    prefix = F.substring_index(following, "-", 1)
    same = entity_of(previous) == entity_of(following)
    return (
        F.when(inside & same & (prefix == "I"), "inside")
        .when(inside & same & (prefix == "E"), "end")
        .when(inside, F.lit(None))
        .when((prefix == "O") & (previous == "O"), "outside")
        .when(prefix == "O", "exit")
        .when(prefix == "B", "begin")
        .when(prefix == "S", "single")
    )


def is_valid_sequence(tags: Column) -> Column:
    """Whether all transitions are legal and the last tag does not leave a span open."""
    steps = F.zip_with(F.slice(tags, 1, F.greatest(F.size(tags) - 1, F.lit(0))), F.slice(tags, 2, F.greatest(F.size(tags), F.lit(1))), lambda a, b: category_column(a, b).isNotNull())
    closed = ~F.substring_index(F.try_element_at(tags, F.lit(-1)), "-", 1).isin("B", "I")
    return F.forall(steps, lambda ok: ok) & F.coalesce(closed, F.lit(True))


def encode(spans: Column, offsets: Column) -> Column:
    """Tags of tokens: a span's tokens are those that it overlaps; later spans win.

    Special and empty tokens are O. A span finds its tokens by binary search where
    tokens are in order, and a token the last of its tags among all that are made.
    """

    def tagged(tokens: Column) -> Column:
        """array<struct<i, j, tag>>: a tag for each token i of each span j."""
        n = F.size(tokens)
        in_order = F.forall(places(F.lit(1), n), lambda k: (F.get(tokens, k)["s"] >= F.get(tokens, k - 1)["s"]) & (F.get(tokens, k)["e"] >= F.get(tokens, k - 1)["e"]))

        def hits(x: Column, ordered: Column) -> Column:
            first = leading(n, lambda k: F.get(tokens, k)["e"] <= x["start"])
            end = leading(n, lambda k: F.get(tokens, k)["s"] < x["end"])
            tried = F.filter(places(F.lit(0), n), lambda k: (F.get(tokens, k)["s"] < x["end"]) & (F.get(tokens, k)["e"] > x["start"]))
            return F.when(ordered, places(first, end)).otherwise(tried)

        def tags(x: Column, j: Column, own: Column) -> Column:
            def one(k: Column, p: Column) -> Column:
                last = F.size(own) - 1
                prefix = F.when(last == 0, "S").when(p == 0, "B").when(p == last, "E").otherwise("I")
                return F.struct(F.get(tokens, k)["i"].alias("i"), j.alias("j"), F.concat_ws("-", prefix, x["label"]).alias("tag"))

            return F.transform(own, one)

        return let(in_order, lambda ordered: F.flatten(F.transform(spans, lambda x, j: let(hits(x, ordered), lambda own: tags(x, j, own)))))

    def chosen(tags: Column) -> Column:
        def one(i: Column) -> Column:
            last = F.get(tags, leading(F.size(tags), lambda k: F.get(tags, k)["i"] <= i) - 1)
            return F.when(last["i"] == i, last["tag"]).otherwise("O")

        return F.transform(places(F.lit(0), F.size(offsets)), one)

    numbered = F.transform(offsets, lambda t, i: F.struct(t["s"].alias("s"), t["e"].alias("e"), i.alias("i")))
    real = F.filter(numbered, lambda t: t["e"] > t["s"])
    found = let(let(real, tagged), lambda tags: let(F.sort_array(tags), chosen))
    return F.when(spans.isNotNull() & offsets.isNotNull(), found)


def decode(tags: Column, offsets: Column) -> Column:
    """Spans of tags, lenient to broken sequences: an I or E that continues nothing
    opens a span, and one that is open ends before another label, O, B or S."""

    def outside(x: Column) -> Column:
        return (x["tag"] == "O") | ((x["o"]["s"] == 0) & (x["o"]["e"] == 0))

    def goes_on(x: Column, last: Column) -> Column:
        same = x["prefix"].isin("I", "E") & (last["label"] == x["label"]) & ~last["prefix"].isin("E", "S") & ~outside(last)
        return F.coalesce(same, F.lit(False))

    def found(x: Column) -> Column:
        # a token that does not go on ends what is before it, and opens a span if it can
        n = F.size(x)
        edges = F.filter(places(F.lit(0), n), lambda k: outside(F.get(x, k)) | ~goes_on(F.get(x, k), F.get(x, k - 1)))

        def spans(e: Column) -> Column:
            opened = F.filter(places(F.lit(0), F.size(e)), lambda j: ~outside(F.get(x, F.get(e, j))))

            def one(j: Column) -> Column:
                first, last = F.get(x, F.get(e, j)), F.get(x, F.coalesce(F.get(e, j + 1), n) - 1)
                return span(first["label"], first["o"]["s"], last["o"]["e"])

            return F.transform(opened, one)

        return let(edges, spans)

    n = F.least(F.size(tags), F.size(offsets))
    parts = F.zip_with(
        F.slice(tags, 1, n), F.slice(offsets, 1, n), lambda t, o: F.struct(t.alias("tag"), F.substring_index(t, "-", 1).alias("prefix"), entity_of(t).alias("label"), o.alias("o"))
    )
    return let(parts, found)


# Viterbi ----------------------------------------------------------------------


def viterbi(emissions: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The best path; the lowest label wins a tie."""
    steps = len(emissions)
    path = np.zeros(steps, np.int64)
    if not steps:
        return path
    emissions = np.asarray(emissions, np.float64)
    score, came = emissions[0], np.zeros(emissions.shape, np.int64)
    for t in range(1, steps):
        through = score[:, None] + transitions
        came[t] = through.argmax(axis=0)
        score = through.max(axis=0) + emissions[t]
    path[-1] = score.argmax()
    for t in range(steps - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def viterbi_tags(emissions: Column, labels: Sequence[str], biases: Sequence[float]) -> Column:
    """Tags of an array<array<double>> column, decoded in Arrow batches."""
    names, matrix = list(labels), transition_matrix(labels, biases)

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        def one(rows):
            return None if rows is None else [names[i] for i in viterbi(np.stack(rows) if len(rows) else np.zeros((0, len(names))), matrix)]

        return batch.map(one)

    return run(emissions)


def viterbi_tags_native(emissions: Column, labels: Sequence[str], biases: Sequence[float]) -> Column:
    """The same in SQL: a fold that keeps scores and the way back, then a walk back."""
    names = F.array(*[F.lit(x) for x in labels])
    columns = transition_matrix(labels, biases).T.tolist()
    table = F.array(*[F.array(*[F.lit(x) for x in column]) for column in columns])
    ids = "array<array<int>>"

    def forward(state: Column, emission: Column) -> Column:
        def best(column: Column, k: Column) -> Column:
            sums = F.zip_with(state["score"], column, lambda a, b: a + b)
            top = F.array_max(sums)
            return F.struct((top + F.get(emission, k)).alias("score"), (F.array_position(sums, top) - 1).cast("int").alias("back"))

        scored = F.transform(table, best)
        return F.get(
            F.transform(
                F.array(scored),
                lambda s: F.struct(F.transform(s, lambda x: x["score"]).alias("score"), F.array_append(state["back"], F.transform(s, lambda x: x["back"])).alias("back")),
            ),
            F.lit(0),
        )

    def backward(state: Column) -> Column:
        last = (F.array_position(state["score"], F.array_max(state["score"])) - 1).cast("int")
        walked = F.aggregate(F.reverse(state["back"]), F.array(last), lambda path, back: F.array_prepend(path, F.get(back, F.get(path, F.lit(0)))))
        return F.transform(walked, lambda i: F.get(names, i))

    start = F.struct(F.get(emissions, F.lit(0)).alias("score"), empty(ids).alias("back"))
    rest = F.slice(emissions, 2, F.greatest(F.size(emissions) - 1, F.lit(0)))
    found = F.aggregate(rest, start, forward, backward)
    return F.when(F.size(emissions) == 0, empty("array<string>")).otherwise(found)
