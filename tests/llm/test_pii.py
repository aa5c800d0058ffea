import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from maskwright.llm import pii_boost as pii


def base(text):
    found = []
    for rank, (kind, pattern) in enumerate(pii.BASE_PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), rank, kind, m.end()))
    return sorted(found)


def check(df):
    texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
    rows = pii.found(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = base(texts[r.doc_id])
        joined = ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in own)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (r, own)
        for kind in pii.BASE_PATTERNS:
            assert r[f"n_{kind}"] == sum(k == kind for _, _, k, _ in own)
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
        starts = [int(x.split(":")[1]) for x in r.spans.split(",") if x]
        assert starts == sorted(starts)


def test_documents(documents):
    check(documents)


def test_awkward_rows(awkward):
    check(awkward)


def test_random_texts(spark):
    rng = random.Random(6)
    pieces = ["a@b.c", "a.b%c@d-e.f.g", "@", ".", "1.2.3.4", "256.1.1.1", "001.02.3.4.5", "4532015112830366", "4532-0151-1283-0366", "4 5 3 2", "+1 (234) 555-1234", "+12", "12-34", " ", "-", "é", "😀", "x"]
    rows = [(i, "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_long_runs_need_no_stack(spark):
    rows = [(1, "1 " * 60000), (2, "1" * 120000), (3, "a." * 60000), (4, "a@" + "b." * 60000), (5, "@" * 50000 + "a" * 50000), (6, "1." * 40000)]
    assert pii.found(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 6


def test_the_model_adds_spans(spark):
    text = 'bob at example dot com or call (212) 555-1234, ssn 123-45-6789, token = "abcdef0123456789abcdef0123456789", 4532015112830366 4532015112830366'
    df = spark.createDataFrame([(1, text), (2, "they met at noon. The end of the long-winded-and-hyphenated-story-line was 1234567")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in pii.found(df).collect()}
    assert [x.split(":")[0] for x in rows[1].spans.split(",")] == ["email", "phone", "ssn", "secret", "card", "card"]
    assert rows[2].spans == ""


def spans_by_hand(text):
    """Base spans and those that Python's own matching, features and trees select."""
    own = base(text)
    found = list(own)
    for kind, pattern in pii.WIDE_PATTERNS.items():
        for m in re.finditer(pattern, text):
            s, e = m.span()
            row = pii.features(kind, m[0], text[max(0, s - pii.CONTEXT_CHARS) : s], text[e : e + pii.AFTER_CHARS])
            if not any(a < e and s < b for a, _, _, b in own) and pii.model(kind).probability(row) >= pii.threshold(kind):
                found.append((s, pii.ORDER.index(kind), kind, e))
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found))


def test_all_spans_of_whole_tables(spark, documents, awkward):
    for df in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), documents, awkward):
        texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        rows = pii.found(df).collect()
        assert len(rows) == len(texts) and all(r.spans == spans_by_hand(texts[r.doc_id]) for r in rows)


def test_all_spans_of_random_texts(spark):
    rng = random.Random(9)
    pieces = ["bob at ex dot com", "a(at)b(dot)org", "(212) 555-1234", "212-555-1234", "12", "-", " ", "123-45-6789", "call ", "ssn: ", 'token = "', '"', "ab12" * 6, "x_" * 12, "4532015112830366", "4532 0151 1283 0366", "5500-0000-0000-0004", "a@b.c", "é", "1.2.3.4"]
    rows = [(i, "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14)))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert all(r.spans == spans_by_hand(rows[r.doc_id][1]) for r in pii.found(df).collect())


def test_work_is_linear(spark):
    """Four times the spans of a text take about four times as long, here under eight."""

    def seconds(n):
        df = spark.createDataFrame([(1, "ab@c.de " * n + "call (212) 555-1234 " * (n // 4))], "doc_id bigint, text string")
        began = time.perf_counter()
        assert pii.redact(df).first().text == "<EMAIL> " * n + "call <PHONE> " * (n // 4)
        return time.perf_counter() - began

    seconds(1000)
    few, many = min(seconds(8000) for _ in range(2)), seconds(32000)
    assert many < 8 * few + 1


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "mail a@b.c now", 3, "r", "s")] * 3 + [(None, None, 0, "r", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, base int, `row` string, spans string")
    kept = pii.redact(df, count_col="base")
    assert kept.columns == df.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(1, "mail <EMAIL> now", 16, "r", "s")] * 3 + [(None, None, None, "r", "s")]))
    assert [r.spans for r in pii.found(df).collect()].count("email:5:10") == 3


def test_thresholds_hold_on_another_generator():
    """The precision that chose the thresholds, on other rows of that generator."""
    x, y, kinds = pii.written_spans(4000, seed=123)
    for kind in pii.WIDE_PATTERNS:
        own = [(pii.model(kind).probability(row) >= pii.threshold(kind), label) for row, label, k in zip(x, y, kinds, strict=True) if k == kind]
        right = [label for selected, label in own if selected]
        assert sum(right) >= 0.96 * len(right) and sum(right) >= 0.8 * sum(label for _, label in own), (kind, len(right), sum(right), len(own))


def test_held_out_accuracy():
    x, y, kinds = pii.labelled_spans(2000, seed=77)
    right = [(pii.model(kind).probability(row) >= pii.threshold(kind)) == bool(label) for row, label, kind in zip(x, y, kinds, strict=True)]
    assert sum(right) / len(right) > 0.97
    scores = [(pii.model(kind).probability(row), label) for row, label, kind in zip(x, y, kinds, strict=True)]
    high = [label for p, label in scores if p > 0.9]
    assert sum(high) / len(high) > 0.95


def test_trees_in_sql_equal_trees_in_python(spark):
    x, _, kinds = pii.labelled_spans(200, seed=3)
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], ", ".join(f"{f} double" for f in pii.FEATURES)).coalesce(1)
    for kind in pii.WIDE_PATTERNS:
        model = pii.model(kind)
        sql = [r.s for r in df.select(pii.log_odds(model, {f: F.col(f) for f in pii.FEATURES}).alias("s")).collect()]
        ours = [model.scale * sum(t.score(row) for t in model.trees) + model.shift for row in x]
        assert max(abs(a - b) for a, b in zip(sql, ours, strict=True)) < 1e-6
    assert set(kinds) == set(pii.WIDE_PATTERNS)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.c and 1.2.3.4", 19), (2, None, 0), (3, "none", 4)], "doc_id bigint, text string, n_chars bigint")
    rows = {r.doc_id: r for r in pii.redact(df, count_col="n_chars").collect()}
    assert rows[1].text == "é <EMAIL> and <IP>" and rows[1].n_chars == 18
    assert rows[2].text is None and rows[3].text == "none"
    assert pii.redact(df.limit(0)).count() == 0


def test_no_python_in_the_plan(documents):
    plan = pii.found(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
