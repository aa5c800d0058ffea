"""Near-duplicate detection: banded MinHash, Bayesian pruning, exact verification.

A document's set holds its distinct 5-word shingles. Documents whose sets have a
Jaccard similarity of 0.75 or more are linked; a component of links is a class.

1. One pass over the texts makes each set's 128-bit digest and a signature of 128
   MinHash values. Rows of one digest have one set; a digest stands for them all.
2. 32 bands of 4 values put digests into buckets. Each member of a bucket is
   compared with the bucket's hub, the member that meets most others over all its
   buckets, as the original of a group of copies does; so a group yields pairs in
   proportion to its size. Only where a bucket still holds several components
   afterwards are their members compared across components: a pair within one
   component can add nothing. Of these pairs only those are formed that may reach the
   threshold by the number and the rarity of the shingles that both components have,
   an exact bound.
3. Signatures of a pair are compared 16 values at a time. After m matches in n the
   posterior of the similarity under a uniform prior is Beta(m + 1, n - m + 1); a
   pair goes once the chance that it reaches the threshold falls below
   ``miss_probability``.
4. Survivors are compared on their full sets.

What is lost: a pair whose similarity is exactly at the threshold shares no bucket
with probability 5e-6, and pruning misses at most ``miss_probability`` a batch.

The index of step 2 holds only shingles that sets of different components share, each
set's in one order, rarest first. A template that a large family shares stands last in
it; where the rest of the members' texts differs, they have too few shared shingles to
reach the threshold and form no pair, and where the template alone reaches it, the hub
has linked them before. What remains are members that share a rare shingle, enough
others, and a bucket: pairs that are compared, less those of one component.

Nulls and ties: a null text is empty. A document without words is linked with
nothing. Rows that repeat a doc_id are separate rows of one document. Of the rows of
one class ``drop_near_duplicates`` keeps one: that of the least id (a null id last),
then of the least text hash; of rows that agree in both, the first by their other
columns. Rows without words all stay. Columns other than the id and the text are not
read by ``near_duplicates``; names of other columns never clash with its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import checkpoint, documents_of, text_slices
from maskwright.llm.shingles import shingle_sets

PERMUTATIONS, ROWS = 128, 4
BANDS = PERMUTATIONS // ROWS
BATCH = 16
THRESHOLD = (75, 100)
MISS_PROBABILITY = 1e-6

_rng = np.random.Generator(np.random.PCG64(7))
_FACTOR = (_rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_SHIFT = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)[:, None]
_RUN = 2048
#: Most bytes of ids that are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20


def signature(hashes: np.ndarray) -> np.ndarray:
    """The low 16 bits of the least value of each of 128 permutations over a set."""
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for first in range(0, len(folded), _RUN):
        np.minimum(least, (_FACTOR * folded[None, first : first + _RUN] + _SHIFT).min(axis=1), out=least)
    return least.astype(np.uint16)


def least_matches(threshold: float, miss_probability: float, batch: int = BATCH, total: int = PERMUTATIONS) -> list[int]:
    """For n = batch, 2 batch, ...: the fewest matches at which a pair stays.

    P(similarity >= t | m of n) of Beta(m + 1, n - m + 1) is the chance of at most m
    successes in n + 1 trials of probability t.
    """
    found = []
    for n in range(batch, total + 1, batch):
        chance, m = 0.0, -1
        while chance < miss_probability:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found.append(m)
    return found


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in text_slices(batch.column(1)):
            sizes, digests, signatures = [], [], []
            for own in shingle_sets(data, offsets):
                sizes.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                signatures.append(signature(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[first:end], batch.column(2)[first:end], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "digest", "sig"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wanted = batch.column(0)
        for first, end, data, offsets in text_slices(batch.column(1)):
            own = shingle_sets(data, offsets)
            rows = [i for i, x in enumerate(own) if xxhash.xxh3_128_digest(x.tobytes()) == wanted[first + i].as_py()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([wanted[first + i].as_py() for i in rows], pa.binary()), pa.array([own[i].view(np.int64) for i in rows], pa.list_(pa.int64()))],
                    names=["digest", "hashes"],
                )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), PERMUTATIONS)


def _pruner(bounds: list[int]):
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            left, right = _matrix(batch.column(2)), _matrix(batch.column(3))
            alive, matches = np.arange(len(batch)), np.zeros(len(batch), np.int64)
            for step, least in enumerate(bounds):
                part = slice(step * BATCH, (step + 1) * BATCH)
                matches = matches + (left[alive, part] == right[alive, part]).sum(axis=1)
                stay = matches >= least
                alive, matches = alive[stay], matches[stay]
            kept = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], names=["a", "b"])

    return prune


_PAIR = "a binary, b binary"


def components(edges: DataFrame) -> DataFrame:
    """Label each node of ``edges`` (a, b) with one node of its component.

    Every round merges each node into its least neighbour and contracts the edges, cut
    at each round. Nodes are digests, so their order has nothing to do with the edges:
    a round leaves at most local minima, a constant share of any component, and a star
    is gone after two. Groups are only ever aggregated.
    """
    edges = checkpoint(edges.filter("a <> b").distinct())
    nodes = edges.select("a").union(edges.select("b")).distinct()
    labels = checkpoint(nodes.select(F.col("a").alias("node"), F.col("a").alias("label")))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")))
        labels = checkpoint(
            labels.join(parents.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label"))
        )
        to_a = parents.select("a", F.col("p").alias("pa"))
        to_b = parents.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(to_a, "a").join(to_b, "b").filter("pa <> pb")
        edges = checkpoint(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    return labels


class NearDuplicates:
    """The tables of one run of near-duplicate detection over ``docs``."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD, miss_probability: float = MISS_PROBABILITY):
        self.over, self.under = threshold
        self.bounds = least_matches(self.over / self.under, miss_probability)
        self.docs = documents_of(docs, id_col, text_col)
        id_type = self.docs.schema["doc_id"].dataType
        kinds = {"doc_id": id_type, "text_key": T.LongType(), "n_shingles": T.LongType(), "digest": T.BinaryType(), "sig": T.BinaryType()}
        out = T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])
        self.sketches = checkpoint(self.docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(_sketches, out))
        #: one row for each distinct set
        self.sets = checkpoint(
            self.sketches.filter("digest is not null")
            .groupBy("digest")
            .agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
        )

    def _buckets(self) -> DataFrame:
        """The members and the hub of each bucket that holds two sets or more."""
        width = ROWS * 2
        keys = F.array(*[F.xxhash64(F.lit(band), F.substring("sig", band * width + 1, width)) for band in range(BANDS)])
        banded = self.sets.select("digest", "n", F.explode(keys).alias("bucket"))
        shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        members = checkpoint(banded.join(shared, "bucket"))
        met = members.groupBy("digest").agg(F.sum("members").alias("met"))
        hubs = members.join(met, "digest").groupBy("bucket").agg(F.max(F.struct("met", "digest")).getField("digest").alias("hub"))
        return members.drop("members").join(hubs, "bucket")

    def _across(self, rest: DataFrame, hashes: DataFrame) -> DataFrame:
        """Pairs (a, b) of members of different components that may reach the threshold.

        Sets of n and m shingles need 3 (n + m) / 7 in common at a threshold of 0.75, all
        of them shingles that members of different components have. In one order of
        these, rarest first, two such sets have a common one among the first
        p - common + 1 of the one and q - common + 1 of the other, where they have p and q.
        """
        labels = checkpoint(rest.select("digest", "n", F.xxhash64("digest").alias("owner"), F.xxhash64("label").alias("part")).distinct())
        own = hashes.join(labels, "digest").select("owner", "part", "n", "hashes")
        rows = own.select("owner", "part", "n", F.explode("hashes").alias("shingle"))
        known = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"), F.min("part").alias("low"), F.max("part").alias("high"))
        # cut here, so that a shingle which a whole family has is a skew that the join splits
        known = checkpoint(known.filter("low <> high").select("shingle", "sets"))
        if known.count() * 16 <= BROADCAST_BYTES:
            known = F.broadcast(known)
        rows = rows.join(known, "shingle")
        rarest = Window.partitionBy("owner").orderBy("sets", "shingle")
        rows = rows.withColumns({"place": F.row_number().over(rarest), "most": F.count(F.lit(1)).over(Window.partitionBy("owner"))})
        least = F.ceil(self.over * F.col("n") / self.under)
        firsts = checkpoint(rows.filter((F.col("most") >= least) & (F.col("place") <= F.col("most") - least + 1)).select("owner", "part", "n", "shingle", "place", "most"))
        # each pair has a member outside the component that has most sets of the shingle
        largest = firsts.groupBy("shingle", "part").agg(F.count(F.lit(1)).alias("sets")).groupBy("shingle").agg(F.max(F.struct("sets", "part")).getField("part").alias("largest"))
        x, y = firsts.join(largest, "shingle").filter("part <> largest").alias("x"), firsts.alias("y")
        common = F.ceil(self.over * (F.col("x.n") + F.col("y.n")) / (self.over + self.under))
        reach = (F.col("x.place") <= F.col("x.most") - common + 1) & (F.col("y.place") <= F.col("y.most") - common + 1)
        pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.part") != F.col("y.part")) & reach & self._could_link("x.n", "y.n"))
        pairs = pairs.select(F.least("x.owner", "y.owner").alias("oa"), F.greatest("x.owner", "y.owner").alias("ob")).distinct()
        names = labels.select("owner", "digest")
        pairs = pairs.join(names.toDF("oa", "da"), "oa").join(names.toDF("ob", "db"), "ob")
        return pairs.select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b"))

    def _could_link(self, n: str, m: str):
        """Sets so different in size cannot reach the threshold."""
        return self.under * F.least(n, m) >= self.over * F.greatest(n, m)

    def _linked(self, pairs: DataFrame, hashes: DataFrame) -> DataFrame:
        """Those of ``pairs`` that survive pruning and are confirmed on full sets."""
        sig = self.sets.select("digest", "sig", "n")
        left = sig.select(F.col("digest").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
        right = sig.select(F.col("digest").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
        near = pairs.join(left, "a").join(right, "b").filter(self._could_link("n_a", "n_b")).select("a", "b", "sig_a", "sig_b").mapInArrow(_pruner(self.bounds), _PAIR)
        near = checkpoint(near)
        sets_a = hashes.select(F.col("digest").alias("a"), F.col("hashes").alias("x"))
        sets_b = hashes.select(F.col("digest").alias("b"), F.col("hashes").alias("y"))
        # whole sets stay in the JVM, a pair at a time; batches of them would fill the workers
        common = F.size(F.array_intersect("x", "y"))
        enough = self.under * common >= self.over * (F.size("x") + F.size("y") - common)
        return near.join(sets_b, "b").join(sets_a, "a").filter(enough).select("a", "b")

    def classes(self) -> DataFrame:
        """(digest, label, component_id) for each distinct set that is not alone; label
        is one digest of the class."""
        members = checkpoint(self._buckets())
        wanted = checkpoint(members.select("digest").distinct().join(self.sets.select("digest", "first_id"), "digest"))
        if wanted.count() * 64 <= BROADCAST_BYTES:
            wanted = F.broadcast(wanted)
        found = self.docs.join(wanted, self.docs["doc_id"].eqNullSafe(wanted["first_id"]))
        hashes = checkpoint(found.select("digest", "text").mapInArrow(_sets, "digest binary, hashes array<bigint>").dropDuplicates(["digest"]))

        to_hub = checkpoint(members.filter("digest <> hub").select(F.col("hub").alias("a"), F.col("digest").alias("b")).distinct())
        links = checkpoint(self._linked(to_hub, hashes))
        labels = components(links)

        labelled = members.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
        split = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
        rest = labelled.join(split, "bucket", "left_semi").select("digest", "n", "label")
        across = self._across(rest, hashes).join(to_hub, ["a", "b"], "left_anti").join(to_hub.toDF("b", "a"), ["a", "b"], "left_anti")
        more = checkpoint(self._linked(across, hashes))
        if not more.isEmpty():
            labels = components(reduce(DataFrame.union, [links, more]))
        named = labels.withColumnRenamed("node", "digest").join(self.sets.select("digest", "first_id"), "digest")
        least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
        return named.join(least, "label").select("digest", "label", "component_id")

    def rows(self) -> DataFrame:
        """doc_id, text_key, n_shingles, digest, label and component_id of each row."""
        own = self.sets.select("digest", "first_id")
        ids = own.join(self.classes(), "digest", "left").select("digest", F.coalesce("label", "digest").alias("label"), F.coalesce("component_id", "first_id").alias("component_id"))
        return (
            self.sketches.select("doc_id", "text_key", "n_shingles", "digest")
            .join(ids, "digest", "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        )

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id and kept of each row."""
        return self.rows().select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    return NearDuplicates(docs, id_col, text_col, **options).result()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, and all rows without words."""
    rows = checkpoint(NearDuplicates(docs, id_col, text_col, **options).rows())
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    chosen = rows.filter("digest is not null").groupBy("label").agg(F.min(first).alias("x")).select("x.doc_id", "x.text_key")
    empty = rows.filter("digest is null").select("doc_id", "text_key").distinct()
    times = rows.filter("digest is not null").groupBy("doc_id", "text_key").agg((F.count(F.lit(1)) > 1).alias("again"))
    same = chosen["doc_id"].eqNullSafe(times["doc_id"]) & (chosen["text_key"] == times["text_key"])
    kept = checkpoint(chosen.join(times, same).select(chosen["doc_id"], chosen["text_key"], "again").union(empty.withColumn("again", F.lit(False))))
    # ids and hashes only, under names that no column of docs has
    taken = {c.lower() for c in docs.columns}
    key, text_key, again, turn = (_free(name, taken) for name in ("kept_id", "kept_key", "again", "turn"))
    kept = kept.toDF(key, text_key, again)
    on = docs[id_col].eqNullSafe(kept[key]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == kept[text_key])
    if kept.filter(again).isEmpty():
        return docs.join(kept, on, "left_semi")
    # of rows that agree in id and text, the first by the columns that can be sorted
    sortable = [c.name for c in docs.schema if isinstance(c.dataType, T.AtomicType)]
    once = docs.join(kept.filter(~F.col(again)), on, "left_semi")
    several = docs.join(kept.filter(again), on, "left_semi")
    order = Window.partitionBy(F.col(id_col), F.xxhash64(F.col(text_col))).orderBy(*[F.col(f"`{c}`") for c in sortable])
    return once.union(several.withColumn(turn, F.row_number().over(order)).filter(F.col(turn) == 1).drop(turn))


def _free(name: str, taken: set[str]) -> str:
    while name in taken:
        name = "_" + name
    return name
