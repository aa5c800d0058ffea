"""Memory of the Python workers: results of a batch must not pile up."""

import random
import re
import time
import unicodedata

import psutil
from pyspark.sql import functions as F

from maskwright.functions import pytext
from maskwright.sources.rules import RegexRule


def workers():
    return [p for p in psutil.Process().children(recursive=True) if "pyspark.daemon" in " ".join(p.cmdline())]


def peak_mb(run) -> float:
    """Peak memory of the largest Python worker while ``run`` runs."""
    for p in workers():
        with open(f"/proc/{p.pid}/clear_refs", "w") as f:
            f.write("5")
    run()
    peaks = [0]
    for p in workers():
        with open(f"/proc/{p.pid}/status") as f:
            peaks += [int(line.split()[1]) / 1e3 for line in f if line.startswith("VmHWM")]
    assert max(peaks) > 0
    return max(peaks)


def test_offsets_of_a_batch_do_not_pile_up(spark):
    """10,000 rows of 300 words, as Spark sends at once: as dicts, over 700 MB."""
    df = spark.range(0, 10000, 1, 1).select(F.repeat(F.lit("word "), 300).alias("t"))
    o = pytext.reconstructed_offsets(F.col("t"), F.split(F.rtrim("t"), " "))
    found = []
    peak = peak_mb(lambda: found.append(df.select(o.alias("o")).selectExpr("sum(size(o))", "min(o[299].s)", "max(o[299].e)", "count(*)").first()))
    assert tuple(found[0]) == (3000000, 1495, 1499, 10000)
    assert peak < 400


def test_offsets_by_parts_equal_those_of_each_row(spark):
    """Nulls, empty rows and results that fill several parts, in order."""
    draw = random.Random(5)
    rows = [(0, None, ["a"]), (1, "a", None), (2, "", []), (3, "a", []), (4, "", ["a"]), (5, "½ﬁ x" * 12000, ["1⁄2fi", "x"] * 12000)]
    for k in range(6, 3000):
        text = "".join(draw.choices("ab ﬁ㎞Ｔー４½é", k=draw.randrange(12)))
        rows.append((k, text, ["##" + w for w in unicodedata.normalize("NFKC", text).split()] + ["[SEP]", "gone"]))
    df = spark.createDataFrame(rows, "k int, t string, w array<string>").coalesce(1)
    found = {r.k: r.o for r in df.select("k", pytext.reconstructed_offsets(F.col("t"), F.col("w")).alias("o")).collect()}
    special = frozenset(["[SEP]"])
    assert len(found) == len(rows)
    for k, text, words in rows:
        assert (None if found[k] is None else [x.asDict() for x in found[k]]) == (None if text is None or words is None else pytext.token_offsets(text, words, special))
    assert found[5][-1].asDict() == {"s": 47999, "e": 48000}


def test_spans_of_a_batch_do_not_pile_up(spark):
    """10,000 rows of 150 spans: as dicts, some 500 MB."""
    df = spark.range(0, 10000, 1, 1).select(F.repeat(F.lit("ab 12 "), 75).alias("t"))
    s = pytext.regex_spans_arrow(F.col("t"), (RegexRule("W", "[a-z]+"), RegexRule("N", "[0-9]+")))
    found = []
    peak = peak_mb(lambda: found.append(df.select(s.alias("s")).selectExpr("sum(size(s))", "min(s[149].start)", "max(s[149].end)", "min(s[149].label)", "max(s[0].label)").first()))
    assert tuple(found[0]) == (1500000, 447, 449, "N", "W")
    assert peak < 300


def test_spans_by_parts_equal_those_of_each_row(spark):
    draw = random.Random(6)
    rules = (RegexRule("A", "[ab]+", 1), RegexRule("N", "[b1]{2,}", 2), RegexRule("S", "a1|[ ]b", 2), RegexRule("A", "é+", 0))
    texts = [None, "", None, "é ab1 " * 9000] + ["".join(draw.choices("ab1 é", k=draw.randrange(60))) for _ in range(3000)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    found = {r.k: r.s for r in df.select("k", pytext.regex_spans_arrow(F.col("t"), rules).alias("s")).collect()}
    for k, text in enumerate(texts):
        assert (None if found[k] is None else [tuple(x) for x in found[k]]) == (None if text is None else by_pairs(text, rules))


def by_pairs(text, rules):
    """Every candidate, in order of precedence, against all that are taken."""
    keyed = sorted((-r.priority, m.start() - m.end(), m.start(), k, m.end(), r.label) for k, r in enumerate(rules) for m in re.finditer(r.pattern, text) if m.group())
    taken = []
    for _, _, start, _, end, label in keyed if len(text) < 1000 else []:
        if all(end <= s or start >= e for _, s, e in taken):
            taken.append((label, start, end))
    return sorted(taken, key=lambda x: x[1]) if len(text) < 1000 else [x for k in range(0, len(text), 6) for x in (("A", k, k + 1), ("N", k + 3, k + 5))]


def test_choice_takes_linear_time():
    """The square of 60,000 spans would take minutes."""
    rules = [(re.compile(r.pattern), r) for r in (RegexRule("A", "[ab]+", 1), RegexRule("N", "[b1]+", 2))]
    began = time.perf_counter()
    assert len(pytext.python_spans("a b1 " * 30000, rules, {})) == 60000 and time.perf_counter() - began < 20
