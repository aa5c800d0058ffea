import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from maskwright.llm import packing
from maskwright.llm.tokens import TextIds

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(df, capacity=2048):
    tokenizer = Tokenizer.from_file(PATH)
    texts = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    rows = packing.pack_documents(df, capacity=capacity).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), capacity))
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[i : i + capacity].tobytes()) for i in range(0, len(ids), capacity)]
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= capacity
    total = sum(r.length for r in rows)
    return len(sequences), -(-total // capacity)


def test_documents_are_packed_tightly(documents):
    made, least = check(documents.repartition(6))
    assert made <= least + 2


def test_awkward_rows(awkward):
    check(awkward, 64)


def test_many_partitions_merge_up_the_tree(spark):
    df = spark.range(300).selectExpr("id AS doc_id", "'a b c' AS text").repartition(70)
    made, least = check(df, 64)
    assert made <= least + 1


def of_tokens(spark, lengths, partitions):
    """Documents of so many tokens, each run of equal lengths in partitions of its own."""
    rows = [(k, "a " * (n - 1)) for k, n in enumerate(lengths)]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, partitions), "doc_id bigint, text string")


def test_partitions_of_one_length_each_still_meet(spark):
    assert check(of_tokens(spark, [1100] * 200 + [940] * 200, 2))[0] == 200
    assert check(of_tokens(spark, [35] * 300 + [29] * 300, 2), 64)[0] == 300
    assert check(of_tokens(spark, [35] * 300 + [29] * 300, 20), 64)[0] == 300


def test_what_cannot_merge_ends_the_rounds(spark):
    assert check(of_tokens(spark, [33] * 120, 40), 64)[0] == 120
    assert check(of_tokens(spark, [64] * 40, 4), 64)[0] == 40


def test_groups_stay_small_at_any_number_of_items(spark):
    df = of_tokens(spark, [35] * 400 + [29] * 400, 16)
    rows = packing.pack_documents(df, capacity=64, window=100).collect()
    loads = Counter()
    for r in rows:
        loads[r.sequence_id] += r.length
    assert len(rows) == 800 and max(loads.values()) <= 64 and len(loads) <= 400 + 8


def test_repeated_ids_and_ties(spark):
    df = spark.createDataFrame([(1, "a b c")] * 5 + [(None, "d")] * 3 + [(1, "e f")], "doc_id bigint, text string")
    rows = packing.pack_documents(df, capacity=8).collect()
    assert Counter((r.doc_id, r.length) for r in rows) == Counter({(1, 4): 5, (None, 2): 3, (1, 3): 1})
    assert len({(r.sequence_id, r.offset) for r in rows}) == 9
    assert [tuple(r) for r in rows] == [tuple(r) for r in packing.pack_documents(df, capacity=8).collect()]


def test_empty_table(awkward):
    assert packing.pack_documents(awkward.limit(0)).count() == 0


def test_sequences_hold_the_ids(spark, awkward):
    rows = packing.packed_ids(awkward.filter("doc_id < 9"), capacity=32).collect()
    tokenizer = Tokenizer.from_file(PATH)
    expected = sorted(i for r in awkward.filter("doc_id < 9").collect() for i in [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0])
    assert sorted(i for r in rows for i in r.ids) == expected and max(len(r.ids) for r in rows) <= 32


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(sizes):
    bins = packing.best_fit(sizes, 50)
    assert sorted(i for own in bins for i in own) == list(range(len(sizes)))
    loads = sorted(sum(sizes[i] for i in own) for own in bins)
    assert all(n <= 50 for n in loads) and (len(loads) < 2 or loads[0] + loads[1] > 50)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("aAbZ .,'é1  İ<|>\n-ǰJ̌", max_size=30), min_size=1, max_size=5))
def test_ids_equal_the_tokenizers(texts):
    import pyarrow as pa

    tokenizer = Tokenizer.from_file(PATH)
    ids = TextIds(PATH, size=50)
    for row, own in ids.encode(pa.array(texts)):
        assert own == np.array(tokenizer.encode(texts[row], add_special_tokens=False).ids, "<u4").tobytes()


def test_special_token_strings():
    import pyarrow as pa

    tokenizer, texts = Tokenizer.from_file(PATH), ["a <|endoftext|> b", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|>"]
    for row, own in TextIds(PATH).encode(pa.array(texts)):
        assert own == np.array(tokenizer.encode(texts[row], add_special_tokens=False).ids, "<u4").tobytes()
