from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import license_align as la


def test_longest_increasing_subsequence():
    for places in ([], [3], [1, 2, 3], [3, 2, 1], [2, 5, 3, 7, 11, 8, 10, 13, 6]):
        found = [places[i] for i in la.increasing(places)]
        best = max((len(c) for n in range(len(places) + 1) for c in combinations(places, n) if list(c) == sorted(set(c))), default=0)
        assert found == sorted(set(found)) and len(found) == best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=15), st.lists(st.sampled_from("abcdef"), max_size=15))
def test_alignments_are_common_subsequences(a, b):
    pairs = la.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    if a == b:
        assert len(pairs) == len(a)


def hits(text, **options):
    return list(la.Scanner(la.TEMPLATES).hits(text, options.get("coverage", 0.85), options.get("density", 0.7)))


def test_notices_are_found():
    for name, text in la.TEMPLATES.items():
        assert name in {h[0] for h in hits(f"some code the {text} and more")}, name
    assert hits("This is this. " * 30 + la.TEMPLATES["GPL-3.0"])
    twice = hits(la.TEMPLATES["MIT"] + " filler word" * 60 + " " + la.TEMPLATES["MIT"])
    assert [h[0] for h in twice] == ["MIT", "MIT"] and twice[1][3] > twice[0][4]


def test_a_framed_notice_is_found():
    """Words of the template stand shortly before and after it."""
    ten = "one two four five six seven eight nine ten eleven"
    text = f"this {ten} {la.TEMPLATES['GPL-3.0']} {ten} 3"
    (hit,) = [h for h in hits(text) if h[0] == "GPL-3.0"]
    assert (hit[1], hit[2], hit[3]) == (1.0, 1.0, 11)


def test_whole_license_texts():
    """With a holder's name put in, words left out and a clause added."""
    for name in ("MIT-full", "ISC-full", "BSD-2-Clause-full"):
        words = la.TEMPLATES[name].split()
        edited = [w for k, w in enumerate(words) if k % 17 != 5]
        edited[len(edited) // 2 : len(edited) // 2] = "this clause was put in by the company that changed the text".split()
        (hit,) = [h for h in hits("Copyright 2024 Someone\n\n" + " ".join(edited) + "\n\nimport os") if h[0] == name]
        assert 0.9 < hit[1] < 1 and hit[2] > 0.85


def test_edited_notices_have_partial_coverage():
    text = la.TEMPLATES["BSD-text"].replace("binary", "object").replace("permitted", "allowed")
    (hit,) = [h for h in hits(text) if h[0] == "BSD-text"]
    n = len(la.words(la.TEMPLATES["BSD-text"]))
    assert hit[1] == (n - 2) / n and hit[5] == n - 2


def test_ordinary_texts_have_none():
    assert not hits("the license of the public was released under general work version")
    assert not hits("licensed " + "word " * 40 + "apache " + "word " * 40 + "version")


def test_tables(spark, awkward, documents):
    assert la.scan(awkward).count() == 0 and la.scan(awkward.limit(0)).count() == 0
    found = {r.doc_id for r in la.scan(documents).collect()}
    marks = ("Released under the MIT License", "Apache License, Version 2.0", "GNU General Public License", "under CC BY-NC 4.0")
    assert found == {r.doc_id for r in documents.collect() if any(m in r.text for m in marks)}
    df = spark.createDataFrame([(1, la.TEMPLATES["MIT"]), (1, la.TEMPLATES["MIT"])], "doc_id bigint, text string")
    assert la.scan(df).count() == 2


def common(a, b):
    """Length of the longest common subsequence, by the table of all prefixes."""
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
    return row[-1]


def most_copies(own, template, coverage, density):
    """The largest number of disjoint stretches at the thresholds, trying all of them."""
    best = [0] * (len(own) + 1)
    for end in range(1, len(own) + 1):
        best[end] = best[end - 1]
        for start in range(end):
            n = common(own[start:end], template)
            if n / len(template) >= coverage and n / (end - start) >= density:
                best[end] = max(best[end], best[start] + 1)
    return best[-1]


def test_every_copy_is_found():
    prose = "some prose about the house that is near to a river under the old bridge and its use is for all of the people"
    between = "it is said that the work of a man is to be done under the sun and in the rain"
    assert len(la.words(between)) == 20
    for name, text in la.TEMPLATES.items():
        n = len(la.words(text))
        for parts in ([prose, text, between, text, prose], [prose, text, text, text, prose], [text, prose * 20, text]):
            own = la.words(" ".join(parts))
            starts = [len(la.words(" ".join(parts[:k]))) for k, part in enumerate(parts) if part is text]
            found = [h for h in hits(" ".join(parts)) if h[0] == name]
            assert [(h[1], h[2], h[3], h[4]) for h in found] == [(1.0, 1.0, s, s + n) for s in starts], name
            assert all(own[h[3] : h[4]] == la.words(text) for h in found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "d", "a b c a d", "a b c a d b e", "x"]), max_size=9), st.sampled_from([(0.85, 0.7), (0.6, 0.5), (1.0, 1.0), (0.7, 0.9)]))
def test_as_many_copies_as_brute_force(pieces, thresholds):
    own, template = " ".join(pieces).split(), "a b c a d b e".split()
    found = list(la.Scanner({"t": " ".join(template)}).hits(" ".join(pieces), *thresholds))
    assert len(found) == most_copies(own, template, *thresholds)
    assert all(x[4] <= y[3] for x, y in zip(found, found[1:]))
    for _, coverage, density, low, high, matched in found:
        assert coverage >= thresholds[0] and density >= thresholds[1] and matched == common(own[low:high], template)
        assert coverage == matched / len(template) and density == matched / (high - low)
