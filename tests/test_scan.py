"""The native scan: one search for a rule, and prefix sums in few steps."""

import random
import time

from pyspark.sql import functions as F

from maskwright.functions import pytext, spans
from maskwright.sources.rules import RegexRule

RULES = (RegexRule("A", "[ab]{2,}", 1), RegexRule("N", "[b1]{2,}", 2), RegexRule("X", "[^a1 ]+", 0), RegexRule("M", "\x01b|(é)(1)", 3), RegexRule("W", r"\bb\b|(?<=a)😀", 4))


def test_native_spans_equal_those_of_python_with_the_mark_in_texts(spark):
    draw = random.Random(7)
    texts = [None, "", "\x01", "\x01\x01b1", "ab\x01", "no"] + ["".join(draw.choices("ab1 é😀\x01" if k % 2 else "ab1 é😀", k=draw.randrange(90))) for k in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rows = df.select(F.col("t"), spans.regex_spans(F.col("t"), RULES).alias("a"), pytext.regex_spans_arrow(F.col("t"), RULES).alias("b")).collect()
    assert len(rows) == len(texts) and all(r.a == r.b for r in rows) and sum(len(r.a or ()) for r in rows) > 2000


def test_values_before_each_element(spark):
    for size in (0, 1, 31, 32, 33, 64, 1023, 1024, 1025, 3000):
        values = [(k * 7919) % 101 for k in range(size)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        row = df.select(spans.before(F.col("v"), spans.plus, F.lit(0)).alias("s"), spans.before(F.col("v"), F.greatest, F.lit(-1)).alias("g")).first()
        assert row.s == [sum(values[:k]) for k in range(size)] and row.g == [max(values[:k], default=-1) for k in range(size)]


def test_hundreds_of_thousands_of_spans_in_a_row(spark):
    """Sums over all blocks before an element's own would take the square of the spans."""
    df = spark.createDataFrame([("12 é ",)], "t string").select(F.repeat("t", 300000).alias("t"))
    began = time.perf_counter()
    row = df.select(spans.regex_spans(F.col("t"), (RegexRule("N", "[0-9]+"),)).alias("s")).selectExpr("size(s) n", "s[299999].start at").first()
    assert (row.n, row.at) == (300000, 1499995) and time.perf_counter() - began < 40
