import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_level(sizes):
    """Targets by repeated sharing of the excess: sizes in order of their sources."""
    weights, caps, total = [1 + i % 3 for i in range(len(sizes))], [3.0 * s for s in sizes], float(sum(sizes))
    fixed: dict[int, float] = {}
    while True:
        left = total - sum(fixed.values())
        free = [i for i in range(len(sizes)) if i not in fixed]
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free} if free else {}
        over = [i for i in free if share[i] > caps[i]]
        if not over:
            return [fixed.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        fixed.update({i: caps[i] for i in over})


def check(df):
    rows = df.select("doc_id", "text", "source").collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    of = {r.doc_id: r.source for r in rows}
    names = sorted({s for s in of.values() if s is not None}) + ([None] if None in of.values() else [])
    sizes = [sum(size[d] for d in of if of[d] == name) for name in names]
    targets = dict(zip(names, water_level(sizes), strict=True))
    found = {r.doc_id: r for r in mixing.mix_digest(df).collect()}
    assert set(found) == set(of)
    taken = dict.fromkeys(names, 0)
    for doc, r in found.items():
        assert r.size == size[doc] and r.source_size == sizes[names.index(of[doc])]
        assert abs(r.target - targets[of[doc]]) <= 1e-6 * max(1, targets[of[doc]])
        assert 0 <= r.taken <= 3 * r.size
        taken[of[doc]] += r.taken
    for name, target in targets.items():
        largest = max(size[d] for d in of if of[d] == name)
        assert abs(taken[name] - target) <= largest
    assert mixing.mix_digest(df).select("doc_id", "taken").exceptAll(mixing.mix_digest(df).select("doc_id", "taken")).isEmpty()


def test_documents(documents):
    check(documents)


def test_awkward_rows(awkward):
    check(awkward)


def test_caps(spark):
    df = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate([(1, "a"), (2, "b"), (500, "c"), (3, None), (40, "d"), (0, "e")])], "doc_id bigint, text string, source string")
    check(df)


def test_empty_table(awkward):
    assert mixing.mix_digest(awkward.limit(0)).count() == 0


def test_shards_get_even_quotas():
    quotas = np.array([100, 7, 0, 53])
    split = mixing.split_quotas(quotas, 8, np.random.default_rng(0))
    assert (split.sum(axis=1) == quotas).all() and split.sum(axis=0).max() - split.sum(axis=0).min() <= 1
    assert (split == mixing.split_quotas(quotas, 8, np.random.default_rng(0))).all()


def test_the_mix_holds_whole_documents(documents):
    digest = {r.doc_id: r for r in mixing.mix_digest(documents).collect()}
    mixed = mixing.mix_documents(documents)
    assert mixed.columns == ["row", "shard", "position"] and mixed.select("row.*").columns == documents.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("row.doc_id").count().collect()}
    for doc, r in digest.items():
        if r.size:
            assert counts.get(doc, 0) * r.size == r.taken
    shards = [r["count"] for r in mixed.groupBy("shard").count().collect()]
    assert len(shards) == mixing.SHARDS or sum(shards) < 10 * mixing.SHARDS


@pytest.mark.parametrize("sizes", [[0, 0], [5], [1, 1, 1000]])
def test_targets_add_up(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n, 1) for i, n in enumerate(sizes)], "source string, source_size bigint, n_docs bigint")
    rows = mixing.targets(df).collect()
    assert abs(sum(r.target or 0 for r in rows) - sum(sizes)) < 1e-6


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c", "x")] * 4 + [(1, "d e", "x"), (1, "a b c", "y"), (2, "f", "y"), (2, "g", "y")]
    rows += [(None, "h i", "x")] * 3 + [(None, f"w{k} " * (k % 5 + 1), s) for k in range(90) for s in ("x", "z", None)] + [(k, "v " * (k % 7), "z") for k in range(3, 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    count = Counter(rows)
    size = {r: len(WORD.findall(r[1])) for r in count}
    result = mixing.mix_digest(df).collect()
    assert Counter((r.doc_id, r.size) for r in result) == Counter((r[0], size[r]) for r in rows)
    mixed = Counter((r.doc_id, r.text, r.source) for r in mixing.mix_documents(df).select("row.*").collect())
    for r, n in mixed.items():
        assert n % count[r] == 0 and n <= 3 * count[r]
    in_result, in_mix = Counter(), Counter()
    for r in result:
        in_result[r.doc_id, r.size] += r.taken
    for r, n in mixed.items():
        in_mix[r[0], size[r]] += n * size[r]
    assert +in_result == +in_mix
    for name in ("x", "y", "z", None):
        (target,) = {r.target for r in result if r.source_size == sum(size[x] for x in rows if x[2] == name)}
        largest = max(size[r] * n for r, n in count.items() if r[2] == name)
        assert abs(sum(n * size[r] for r, n in mixed.items() if r[2] == name) - target) <= largest


def test_shards_are_the_quotas(spark):
    df = spark.createDataFrame([(k, "w " * (k % 9 + 1), "abcd"[k * k % 7 % 4]) for k in range(400)], "doc_id bigint, text string, source string")
    mix = mixing.Mix(df, shards=5)
    draws = mix.draws().collect()
    ordinals = sorted({r.ordinal for r in draws})
    quotas = np.array([sum(r.ordinal == o for r in draws) for o in ordinals])
    split = mixing.split_quotas(quotas, 5, np.random.default_rng(mixing.SEED))
    assert [[sum(r.ordinal == o and r.shard == k for r in draws) for k in range(5)] for o in ordinals] == split.tolist()
    of = {(r.ordinal, r.block): [] for r in draws}
    for r in draws:
        of[r.ordinal, r.block].append((r["pass"], r.room is None, r.shard))
    places = {r.doc_id: of.get((r.ordinal, r.block), []) for r in mix.docs.collect()}
    for r in mixing.mix_digest(df, shards=5).collect():
        whole = [shard for _, is_whole, shard in sorted(places[r.doc_id]) if is_whole]
        assert r.shards[: len(whole)] == whole and len(r.shards) * r.size == r.taken
        assert r.shards[len(whole) :] in ([], [shard for _, is_whole, shard in places[r.doc_id] if not is_whole])


def test_partitions_are_the_shards(documents):
    named = Counter((r.doc_id, s) for r in mixing.mix_digest(documents).collect() for s in r.shards)
    rows = mixing.shuffled(documents).select("doc_id", F.spark_partition_id().alias("k")).collect()
    assert mixing.shuffled(documents).rdd.getNumPartitions() == mixing.SHARDS
    assert Counter((r.doc_id, r.k) for r in rows) == named
    ordered = [r.doc_id for r in mixing.mix_documents(documents).orderBy("shard", "position").select("row.*").collect()]
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.k)] == ordered
    assert mixing.shuffled(documents).columns == documents.columns


def test_the_stage_writes_shards(spark, documents):
    import corpus_pipeline

    named = Counter((r.doc_id, s) for r in mixing.mix_digest(documents).collect() for s in r.shards)
    stage = corpus_pipeline.source_mix(spark, documents, "").select("doc_id", F.spark_partition_id().alias("k")).collect()
    assert Counter((r.doc_id, r.k) for r in stage) == named


def test_clashing_columns_keep_their_values(spark):
    rows = [(k, "w " * (k % 5 + 1), "s", k, -k, "x", k * 2) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, shard int, position int, `row` string, _draw int")
    mixed = mixing.shuffled(df)
    assert mixed.columns == df.columns
    assert {tuple(r) for r in mixed.collect()} == set(rows)


def test_the_table_of_shards_needs_no_python(documents):
    draws = mixing.Mix(documents).draws()
    assert "LocalRelation" in draws._jdf.queryExecution().optimizedPlan().toString()
