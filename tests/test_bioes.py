import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.functions import bioes, pytext
from maskwright.plans import queries

LABELS = bioes.label_list()
OFFSETS = "array<struct<s: int, e: int>>"
SPANS = "array<struct<label: string, start: int, end: int>>"


def test_label_space():
    assert len(LABELS) == 33 and LABELS[:5] == ["O", "B-PER", "I-PER", "E-PER", "S-PER"]
    ids, names = bioes.label_maps()
    assert all(names[i] == x for x, i in ids.items())


def test_transitions():
    assert bioes.category("O", "O") == "outside" and bioes.category("S-PER", "O") == "exit"
    assert bioes.category("O", "I-PER") is None and bioes.category("B-PER", "O") is None
    assert bioes.category("B-PER", "I-LOC") is None and bioes.category("I-PER", "E-PER") == "end"
    matrix = bioes.transition_matrix(LABELS, bioes.OPERATING_POINTS["high_recall"])
    assert matrix[0, 0] == -0.5 and matrix[0, 2] == bioes.ILLEGAL
    with pytest.raises(ValueError):
        bioes.transition_matrix(LABELS, [0.0] * 5)


def test_operating_points():
    assert bioes.resolve_operating_point(None) == [0.0] * 6
    assert bioes.resolve_operating_point("high_precision") == [0.5, -1.0, -1.0, 0.2, 0.5, 0.5]
    assert bioes.resolve_operating_point({"begin": 2, "other": 1}) == [0, 2, 0, 0, 0, 0]
    with pytest.raises(KeyError):
        bioes.resolve_operating_point("turbo")
    with pytest.raises(ValueError):
        bioes.resolve_operating_point([1, 2])


def emissions_of(tags, labels=LABELS):
    rows = np.full((len(tags), len(labels)), -5.0)
    for i, tag in enumerate(tags):
        rows[i, labels.index(tag)] = 5.0
    return rows


def paths(spark, cases, labels, biases):
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(cases)], "i int, e array<array<double>>")
    arrow = df.select("i", bioes.viterbi_tags(F.col("e"), labels, biases).alias("p"))
    native = df.select("i", bioes.viterbi_tags_native(F.col("e"), labels, biases).alias("p"))
    a, b = [[r.p for r in x.orderBy("i").collect()] for x in (arrow, native)]
    assert a == b
    return a


def test_viterbi(spark):
    clean = ["O", "B-PER", "I-PER", "E-PER", "O"]
    found = paths(spark, [emissions_of(clean), emissions_of(["O", "I-PER", "O"]), np.zeros((0, 33))], LABELS, [0.0] * 6)
    assert found[0] == clean and found[2] == []
    assert all(bioes.category(a, b) for a, b in zip(found[1], found[1][1:]))


def test_operating_points_change_the_path(spark):
    rows = np.zeros((2, 33))
    rows[0, 0], rows[1, LABELS.index("S-PHONE")] = 5, 0.2
    assert paths(spark, [rows], LABELS, bioes.OPERATING_POINTS["high_recall"])[0][1].startswith("S-")
    assert paths(spark, [rows], LABELS, bioes.OPERATING_POINTS["high_precision"])[0][1] == "O"


def test_viterbi_against_all_paths(spark):
    from itertools import product

    labels, rng = bioes.label_list(["A"]), np.random.default_rng(0)
    biases = bioes.OPERATING_POINTS["high_recall"]
    matrix = bioes.transition_matrix(labels, biases)
    cases = [rng.integers(0, 6, (4, 5)).astype(float) for _ in range(20)]
    for emissions, path in zip(cases, paths(spark, cases, labels, biases), strict=True):
        def score(p):
            return sum(emissions[i, k] for i, k in enumerate(p)) + sum(matrix[a, b] for a, b in zip(p, p[1:]))

        best = max(map(score, product(range(5), repeat=4)))
        assert abs(score([labels.index(x) for x in path]) - best) < 1e-9


def encode_by_hand(spans, offsets):
    tags = ["O"] * len(offsets)
    for label, start, end in spans:
        own = [i for i, (s, e) in enumerate(offsets) if e > s and s < end and e > start]
        for i in own:
            tags[i] = ("S" if len(own) == 1 else "B" if i == own[0] else "E" if i == own[-1] else "I") + "-" + label
    return tags


def decode_by_hand(tags, offsets):
    out, run = [], None
    for tag, (s, e) in zip(tags, offsets):
        if tag == "O" or (s, e) == (0, 0):
            run = None
            continue
        prefix, label = tag.split("-", 1)
        if prefix in "IE" and run is not None and run[0] == label:
            run[2] = e
        else:
            run = [label, s, e]
            out.append(run)
        if prefix in "ES":
            run = None
    return [tuple(x) for x in out]


def test_encode_and_decode_against_loops(spark):
    rng = random.Random(5)
    cases = []
    for i in range(300):
        offsets, at = [(0, 0)], 0
        for _ in range(rng.randint(0, 8)):
            width = rng.randint(0, 4)
            offsets.append((at, at + width))
            at += width + rng.randint(0, 1)
        spans = [(rng.choice(["A", "B-C"]), s := rng.randint(0, 15), s + rng.randint(0, 8)) for _ in range(rng.randint(0, 4))]
        tags = [rng.choice(["O", "B-A", "I-A", "E-A", "S-A", "B-B-C", "I-B-C", "E-B-C"]) for _ in offsets]
        cases.append((i, spans, offsets, tags))
    df = spark.createDataFrame(cases, f"i int, s {SPANS}, o {OFFSETS}, t array<string>")
    for row in df.select("i", bioes.encode(F.col("s"), F.col("o")).alias("e"), bioes.decode(F.col("t"), F.col("o")).alias("d")).collect():
        _, spans, offsets, tags = cases[row.i]
        assert row.e == encode_by_hand(spans, offsets)
        assert [tuple(x) for x in row.d] == decode_by_hand(tags, offsets)


def test_round_trip(spark):
    df = spark.createDataFrame([(["O", "S-EMAIL", "O"], [(0, 1), (1, 16), (16, 17)])], f"t array<string>, o {OFFSETS}")
    assert [tuple(x) for x in df.select(bioes.decode(F.col("t"), F.col("o")).alias("d")).first().d] == [("EMAIL", 1, 16)]


@pytest.mark.parametrize(
    ("tags", "valid"),
    [([], True), (["O"], True), (["B-A", "E-A"], True), (["B-A"], False), (["O", "I-A"], False), (["I-A", "E-A"], True), (["B-A", "E-B"], False), (["S-A", "B-A", "I-A", "E-A", "O"], True)],
)
def test_valid_sequences(spark, tags, valid):
    df = spark.createDataFrame([(tags,)], "t array<string>")
    assert df.select(bioes.is_valid_sequence(F.col("t")).alias("x")).first().x is valid


def test_tag_parts(spark):
    df = spark.createDataFrame([("B-A-C",), ("O",)], "t string")
    rows = df.select(bioes.entity_of(F.col("t")).alias("e"), bioes.prefix_of(F.col("t")).alias("p")).collect()
    assert [tuple(r) for r in rows] == [("A-C", "B"), (None, None)]


def test_decode_mismatch(spark):
    rows = [("她用Python写作", "她 用 python 写 作", False), ("Ｎｏ．９", "no.9", False), ("𝔘ber 𠀋", "uber [UNK]", True), (None, "x", None)]
    df = spark.createDataFrame(rows, "a string, b string, x boolean")
    assert all(r.x == r.y for r in df.select("x", pytext.decode_mismatch(F.col("a"), F.col("b")).alias("y")).collect())


def test_offsets_of_word_pieces():
    special = frozenset(["[CLS]"])
    for _, text, tokens, offsets in queries.PIECES:
        assert [(o["s"], o["e"]) for o in pytext.token_offsets(text, tokens, special | {"[SEP]"})] == list(offsets)
    assert pytext.token_offsets("", ["a"], special) == [{"s": 0, "e": 0}] and pytext.token_offsets("a", [], special) == []


def test_long_rows_take_linear_time(spark):
    n = 4000
    tags = [("B-A", "I-A", "E-A", "O")[k % 4] for k in range(n)]
    offsets = [(3 * k + 1, 3 * k + 3) for k in range(n)]
    df = spark.createDataFrame([(tags, offsets)], f"t array<string>, o {OFFSETS}")
    began = time.perf_counter()
    row = df.withColumn("d", bioes.decode(F.col("t"), F.col("o"))).withColumn("e", bioes.encode(F.col("d"), F.col("o"))).first()
    assert len(row.d) == n // 4 and row.e == tags and time.perf_counter() - began < 20
