import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from maskwright.llm import suffix_dedup


def by_hand(rows):
    """Every 100-byte string in order of documents and starts."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            piece = data[s : s + 100]
            if piece in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(piece)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    expected, found = by_hand(rows), suffix_dedup.deduplicated(df).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id], r.doc_id


def test_documents(documents):
    check(documents)


def test_awkward_rows(awkward):
    check(awkward)


def test_passages_edits_and_periods(spark):
    rng = random.Random(8)

    def text(n):
        return "".join(rng.choice("abcd é") for _ in range(n))

    passages, rows = [text(n) for n in (98, 99, 100, 101, 150, 400)], []
    for i in range(60):
        parts = [text(rng.randint(0, 60)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randint(0, 5))]
        whole = list("".join(parts))
        for _ in range(rng.randint(0, 2)):
            if whole:
                whole[rng.randrange(len(whole))] = "#"
        rows.append((i, "".join(whole)))
    rows += [(100, "x" * 300), (101, "xy" * 120), (102, "x" * 100), (103, "xyz" * 100), (104, "yx" * 120)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))


def test_empty_table_and_rows_without_id(spark, awkward):
    assert suffix_dedup.deduplicated(awkward.limit(0)).count() == 0
    df = spark.createDataFrame([(None, "z" * 300), (1, "z" * 300), (1, "z" * 300)], "doc_id bigint, text string")
    rows = suffix_dedup.deduplicated(df).collect()
    # starts 1 to 200 repeat start 0; a row without an id comes last
    assert sorted((r.doc_id is None, r.n_removed) for r in rows) == [(False, 299), (False, 299), (True, 300)]


def keyed_check(spark, rows, kind):
    """Rows of any ids, in order of the id, nulls last, and the text's hash."""
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    distinct = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]]) if kind == "bigint" else (r[0] is None, r[0] or "", hashes[r[1]]))
    by_rank = by_hand(list(enumerate(text for _, text in distinct)))
    expected = Counter((row[0], *by_rank[distinct.index(row)]) for row in rows)
    found = Counter(tuple(r) for r in suffix_dedup.deduplicated(df.repartition(3)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert found == expected


def test_repeated_and_missing_ids(spark):
    rng = random.Random(3)
    some = ["".join(rng.choice("abc ") for _ in range(160)) for _ in range(4)]
    rows = [(1, "q" * 300), (1, "q" * 120 + some[0]), (1, "q" * 300), (2, some[0] + some[1]), (None, some[1] + "x"), (None, some[1] + some[2]), (None, None), (0, some[2] * 2), (3, "")]
    keyed_check(spark, rows, "bigint")


def test_string_ids(spark):
    rng = random.Random(5)
    some = ["".join(rng.choice("abc ") for _ in range(130)) for _ in range(3)]
    keyed_check(spark, [("b", some[0] + some[1]), ("a", some[1]), ("10", some[0] * 3), (None, some[2]), ("9", some[2])], "string")


def test_ranks_leave_as_they_become_unique():
    a, b, c = np.array([0, 0, 1, 1, 2, 3, 3, 3]), np.array([5, 5, 6, 7, 1, 2, 2, 4]), np.array([1, 1, 0, 0, 0, 9, 9, 9])
    assert [list(x) for x in suffix_dedup.reranked([a])] == [[0, 1, 2, 3, 5, 6, 7], [0, 0, 1, 1, 3, 3, 3]]
    alive, rank = suffix_dedup.reranked([a, b, c])
    assert list(alive) == [0, 1, 5, 6, 7] and list(rank) == [0, 0, 1, 1, 2]


def test_a_passage_that_many_rows_share(spark):
    """Passages of 60, 99 and 140 bytes in 300 documents, with different surroundings."""
    rng = random.Random(6)

    def text(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    passages = [text(60), text(99), text(140)]
    rows = [(i, text(rng.randint(0, 80)) + passages[i % 3] + text(rng.randint(0, 80)) + passages[i % 2]) for i in range(300)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7))

def test_every_start_is_in_one_run():
    data = np.random.default_rng(0).integers(97, 103, 5000, dtype=np.uint8)
    offsets = np.array([0, 50, 150, 150, 3000, 5000])
    _, _, of, s0, n = suffix_dedup.anchored_runs(data, offsets)
    starts = sorted((int(d), int(s) + k) for d, s, m in zip(of, s0, n) for k in range(int(m)))
    assert starts == [(d, s) for d, (a, b) in enumerate(zip(offsets, offsets[1:])) for s in range(b - a - 99)]
    assert n.max() <= suffix_dedup.PLACES
