import random
import re
from collections import Counter

from maskwright.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def check(df):
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    rows = quality.judged(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert found == by_hand(texts[r.doc_id]), r
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_documents(documents):
    check(documents)


def test_awkward_rows(awkward):
    check(awkward)


def test_random_texts(spark):
    rng = random.Random(4)
    pieces = ["a", "b", "a b c", "\n", "\t", " ", "é", "#", "x\x0by", "\x85", " "]
    rows = [(i, "".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 80)))) for i in range(200)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_order_changes_cost_alone(documents):
    first = quality.keep(documents, quality.RULES).select("doc_id")
    last = quality.keep(documents, quality.RULES[::-1]).select("doc_id")
    assert first.exceptAll(last).isEmpty() and last.exceptAll(first).isEmpty()
    judged = quality.judged(documents).filter("kept").select("doc_id")
    assert judged.exceptAll(first).isEmpty() and first.exceptAll(judged).isEmpty()


def test_rules_that_reject_nothing_come_last(spark):
    df = spark.createDataFrame([(i, "short text") for i in range(50)], "doc_id bigint, text string")
    assert quality.ordered(df)[0].name == "few_words"
    assert quality.ordered(df.limit(0)) == list(quality.RULES)


def test_columns_stay(awkward):
    assert quality.keep(awkward).columns == awkward.columns
    assert quality.judged(awkward.limit(0)).count() == 0


def test_no_python_in_the_plan(documents):
    plan = quality.judged(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_clean_documents_stay(spark):
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(120))
    df = spark.createDataFrame([(1, text), (2, "### $$$ " * 60 + text), (3, "same line of words\n" * 40)], "doc_id bigint, text string")
    assert {r.doc_id: r.kept for r in quality.judged(df).collect()} == {1: True, 2: False, 3: False}


def test_windows_whose_hashes_share_their_low_bits(spark):
    """xxhash64 of (w12622, x, y) and (w2005369, x, y) agree in the lowest 40 bits."""
    df = spark.createDataFrame([(1, "w12622 x y a w2005369 x y b w12622 x y c w2005369 x y")], "doc_id bigint, text string")
    check(df)
    assert quality.judged(df).first().n_repeat_words == 12


def test_more_places_than_a_long_holds(spark, documents, monkeypatch):
    monkeypatch.setattr(quality, "_PLACE_BITS", 5)
    check(documents.limit(60))
    check(spark.createDataFrame([(1, "a b c " + " ".join(f"w{k}" for k in range(200)) + " a b c"), (2, "a b c a b c")], "doc_id bigint, text string"))


def test_the_order_looks_at_what_is_left():
    """The second rule rejects most on its own, but nothing that the first lets pass."""
    together = [((True, True, False), 50), ((True, False, False), 10), ((False, False, True), 5), ((False, False, False), 35)]
    assert quality.greedy([1.0, 1.0, 1.0], together) == [0, 2, 1]
    assert quality.greedy([10.0, 1.0, 1.0], together) == [1, 2, 0]
    assert quality.greedy([1.0, 1.0], []) == [0, 1]
