import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np

from maskwright.llm import minhash, shingles

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}


def classes(rows):
    """Component and set size of each id, by brute force."""
    sets = {i: shingle_set(t) for i, t in rows}
    where, common, parent = defaultdict(list), Counter(), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                common[a, b] += 1

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    expected = classes(rows)
    found = minhash.near_duplicates(df).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_shingles, r.component_id) == expected[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_awkward_rows(awkward):
    check(awkward)


def test_documents(documents):
    check(documents)


def test_copies_of_copies(spark):
    """Groups whose members are linked only over others, and families that share text."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    shared, rows = [rng.choice(vocabulary) for _ in range(60)], []
    for family in range(6):
        text = [rng.choice(vocabulary) for _ in range(90)] + shared
        for _ in range(30):
            rows.append((len(rows), " ".join(text)))
            text = list(text) if rng.random() < 0.5 else text
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                text = text[: len(text) - rng.randrange(5)]
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_empty_table_and_repeated_rows(spark, awkward):
    assert minhash.near_duplicates(awkward.limit(0)).count() == 0
    twice = awkward.union(awkward)
    found = minhash.near_duplicates(twice)
    assert found.count() == 20 and found.distinct().count() == 10


def test_one_document_of_each_group_stays(awkward):
    kept = minhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 7, 8, 9, 10]


def test_one_row_of_each_class_stays(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(5, same, "b"), (5, same, "a"), (5, same, "a"), (5, same.replace(" ", "  "), "c"), (5, "another text of eight words that stands alone", "d"), (3, same.upper(), "e"), (None, same, "f")]
    rows += [(None, "no id but words of its own in here", "g")] * 2 + [(None, None, "h"), (7, "", "i"), (7, "", "i")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept_id string")
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    expected = [(3, same.upper(), "e"), (5, rows[4][1], "d"), rows[7], (7, "", "i"), (7, "", "i"), (None, None, "h")]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, expected))
    alone = minhash.drop_near_duplicates(df.filter("doc_id = 5"))
    assert sorted(r.kept_id for r in alone.collect()) in (["a", "d"], ["c", "d"])


def test_a_template_that_many_share(spark):
    """Families whose members share 60 and 90 of 100 words, below and above the threshold."""
    rng = random.Random(4)

    def some(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    low, high, rows = some(60), some(92), []
    for _ in range(60):
        rows += [(len(rows), " ".join(low + some(40))), (len(rows) + 1, " ".join(high + some(8)))]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_string_ids(spark):
    df = spark.createDataFrame([("b", "x y z"), ("a", "x y z"), (None, "x y z")], "doc_id string, text string")
    assert {r.component_id for r in minhash.near_duplicates(df).collect()} == {"a"}


def test_pruning_bounds():
    bounds = minhash.least_matches(0.75, 1e-6)
    assert len(bounds) == 8 and bounds == sorted(bounds) and 60 < bounds[-1] < 96
    rng = np.random.default_rng(0)
    matches = (rng.random((20000, 128)) < 0.75).cumsum(axis=1)[:, 15::16]
    assert (matches >= np.array(bounds)).all(axis=1).mean() > 0.999


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 100, 100))
    x, y = minhash.signature(np.unique(np.concatenate([common, a]))), minhash.signature(np.unique(np.concatenate([common, b])))
    assert abs((x == y).mean() - 0.75) < 0.12


def test_shingles_do_not_cross_documents():
    texts = ["a b c d e", "f", "", "a b c d e f"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    assert [len(s) for s in shingles.shingle_sets(data, offsets)] == [1, 1, 0, 2]
    own = shingles.shingle_sets(data, offsets)
    assert own[0][0] in own[3]


def test_components_of_a_long_path(spark):
    digests = [hashlib.md5(str(i).encode()).digest() for i in range(60)]
    edges = spark.createDataFrame([(digests[i], digests[i + 1]) for i in range(59) if i != 30], "a binary, b binary")
    labels = {bytes(r.node): bytes(r.label) for r in minhash.components(edges).collect()}
    assert len(labels) == 60
    assert [len({labels[d] for d in part}) for part in (digests[:31], digests[31:], digests)] == [1, 1, 2]
