"""Removal of repeated 100-byte strings by prefix doubling over position ranks.

A byte goes if a 100-byte string over it also starts earlier, in an earlier document or
at a smaller start of the same one. Positions are sorted by the ranks of what they
start with at growing lengths and leave as soon as their rank is unique:

1. Of the 53 places where a 48-byte string can start within a 100-byte string, the one
   whose string has the least hash is its anchor. Equal 100-byte strings have equal
   anchors at equal distances, so starts form runs that share an anchor, about one in
   25 bytes. Runs are sorted by the rank of their anchor's 48 bytes and of all bytes
   they cover. Runs with a unique anchor hold no repeat. A run that covers the same
   bytes as one before it repeats at all its starts; those that a task already sees
   among its own texts are not sent to the sort by anchor, so that a string which
   many texts share makes no large group. What is left are runs that differ from others
   in part.
2. All starts of those are doubled. Spark sorts them by what they start with; a pass
   gives dense ranks at 25 bytes, drops the unique ones, pairs the rank with that of the
   25 bytes at offset 25, drops the unique ones, and pairs the rank at 50 with that of
   the 50 bytes at offset 50. Equal ranks at 100 are equal strings, and all but the
   first of a class repeat.
3. Repeated starts become maximal removed runs of bytes in each document.

The second of a pair is a fingerprint of the bytes, computed where the text is read: a
self-join that fetches the other position's rank would move every position at every
offset. Equal strings lie in one partition, so a rank that is unique within it has no
equal anywhere, and one sort serves all lengths. Two different 100-byte strings are taken for equal only where 128 bits of
fingerprints agree (64 for whole runs); bytes are not compared again.

Null and empty texts keep all of nothing. Documents are in order of doc_id, those
without one last; among rows that share an id, of texts' 64-bit hashes, and rows that
agree in both are one document, each with its result. Ids may be of any type that
sorts. Texts under 100 bytes are kept whole. Columns other than the id and the text are
not read. An empty table gives no rows. Texts of any length are read in runs; a text
alone is the least unit of a task. Rows move in sorts alone; a document's runs are the
largest group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import checkpoint, documents_of, text_slices
from maskwright.llm.shingles import mixed, prefix_sums

LENGTH = 100
ANCHOR = 48
PLACES = LENGTH - ANCHOR + 1
#: Offsets at which ranks are paired; each doubles the length that is ranked.
OFFSETS = (25, 50)
#: Most bytes of runs that are broadcast to the texts; beyond it the join shuffles.
BROADCAST_BYTES = 24 << 20
_N_BITS = 7  # a run has at most PLACES starts
_RANK_BITS = 24  # low bits of the covering rank that the first sort key holds


class Fingerprints:
    """Fingerprints of the substrings of a run of texts."""

    def __init__(self, data: np.ndarray):
        self.sums, self.inverses = prefix_sums(data)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverses[start] + (end - start).astype(np.uint64))


def anchored_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor rank, covering rank, document, first start, number of starts) of runs."""
    n = len(data)
    none = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    if n < LENGTH:
        return none
    ranks = Fingerprints(data)
    place = np.arange(n - ANCHOR + 1)
    anchor = ranks(place, place + ANCHOR)
    # the least hash of each window, the first of equal ones; places in the low bits
    least = (anchor >> np.uint64(32) << np.uint64(32)) | place.astype(np.uint64)
    wide = 1
    while wide * 2 <= PLACES:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < PLACES:
        least = np.minimum(least[: len(least) - (PLACES - wide)], least[PLACES - wide :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(at))
    of = np.searchsorted(offsets, start, side="right") - 1
    inside = start + LENGTH <= offsets[of + 1]
    start, at, of = start[inside], at[inside], of[inside]
    if not len(start):
        return none
    fresh = np.ones(len(start), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    s0, s1 = start[first], start[last]
    return anchor[at[first]], ranks(s0, s1 + LENGTH), of[first], s0 - offsets[of[first]], s1 - s0 + 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, _, data, offsets in text_slices(batch.column(1)):
            anchor, cover, of, s0, n = anchored_runs(data, offsets)
            # sort keys: 40 bits of the anchor's rank, the covering rank, the length
            low = np.uint64((1 << _RANK_BITS) - 1)
            key = (anchor & ~low) | (cover & low)
            rest = (cover & ~low) | n.astype(np.uint64)
            key, rest = key.view(np.int64), rest.view(np.int64)
            doc = ids.take(pa.array(of + first)).to_numpy(zero_copy_only=False)
            # what this run of texts repeats within itself is known before the sort
            order = np.lexsort((s0, doc, rest, key))
            a, b = order[:-1], order[1:]
            again, kept = np.zeros(len(key), bool), np.ones(len(key), bool)
            again[b] = (key[b] == key[a]) & (rest[b] == rest[a])
            kept[b] = ~(again[b] & (doc[b] == doc[a]) & (s0[b] == s0[a]))
            whole = pa.array((s0 << _N_BITS | n)[kept], mask=~again[kept])
            # rows stay in the texts' order, and known runs need no keys: both shrink the shuffle
            key, rest = np.where(again, 0, key), np.where(again, 0, rest)
            yield pa.RecordBatch.from_arrays([*[pa.array(x[kept]) for x in (key, rest, doc, np.where(again, 0, s0))], whole], names=["key", "rest", "doc", "s0", "whole"])


def _repeated(column: np.ndarray, last) -> np.ndarray:
    """Whether each value equals the one before it; ``last`` precedes the first."""
    same = np.empty(len(column), bool)
    same[1:] = column[1:] == column[:-1]
    same[0] = last is not None and column[0] == last
    return same


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted runs: those that repeat one before them, and those that may in part.

    A run beside the edge of a batch counts as one that may, which costs work only.
    """
    last = (None,) * 4
    for batch in batches:
        known = batch.filter(pa.compute.is_valid(batch.column(4)))
        if len(known):
            yield pa.RecordBatch.from_arrays([known.column(2), known.column(4), pa.nulls(len(known), pa.int64())], names=["doc", "whole", "part"])
        batch = batch.filter(pa.compute.is_null(batch.column(4)))
        if not len(batch):
            continue
        key, rest, doc, s0 = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        anchor = key >> _RANK_BITS
        same_anchor = _repeated(anchor, None if last[0] is None else last[0] >> _RANK_BITS)
        same_cover = _repeated(key, last[0]) & _repeated(rest, last[1])
        again = same_cover & _repeated(doc, last[2]) & _repeated(s0, last[3])
        last = key[-1], rest[-1], doc[-1], s0[-1]
        group = np.cumsum(~same_anchor) - int(not same_anchor[0])
        covers = np.bincount(group, ~same_cover)
        open_ended = (group == 0) | (group == group[-1])
        partly = ~same_cover & ((covers[group] > 1) | open_ended)
        packed = s0 << _N_BITS | rest & ((1 << _N_BITS) - 1)
        kept = (same_cover | partly) & ~again
        whole = pa.array(packed[kept], mask=~same_cover[kept])
        part = pa.array(packed[kept], mask=same_cover[kept])
        yield pa.RecordBatch.from_arrays([pa.array(doc[kept]), whole, part], names=["doc", "whole", "part"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, tail, doc, start) of each start of the given runs of each text: 32 bits for
    each of the first two 25 bytes, 64 for the 50 after them."""
    for batch in batches:
        ids, runs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
        for first, end, data, offsets in text_slices(batch.column(1)):
            ranks = Fingerprints(data)
            part = runs.slice(first, end - first)
            packed = part.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(end - first), pa.compute.list_value_length(part).to_numpy(zero_copy_only=False))
            n = packed & ((1 << _N_BITS) - 1)
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat((packed >> _N_BITS) + offsets[row], n) + inner
            row = np.repeat(row, n)
            for a in range(0, len(start), 1 << 18):
                s, r = start[a : a + (1 << 18)], row[a : a + (1 << 18)]
                near, far = OFFSETS
                head = ranks(s, s + near) >> np.uint64(32) << np.uint64(32) | ranks(s + near, s + far) >> np.uint64(32)
                tail = ranks(s + far, s + LENGTH)
                yield pa.RecordBatch.from_arrays([pa.array(head.view(np.int64)), pa.array(tail.view(np.int64)), pa.array(ids[first + r]), pa.array(s - offsets[r])], names=["head", "tail", "doc", "start"])


def reranked(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of sorted keys that are not unique, and their dense ranks by all keys.

    Each key refines the ranks of those before it, and rows whose rank is unique then
    leave. The first and the last rank may go on beyond the rows given and stay.
    """
    alive, rank = np.arange(len(keys[0])), np.zeros(len(keys[0]), np.int64)
    for key in keys:
        own = key[alive]
        fresh = np.ones(len(alive), bool)
        fresh[1:] = (rank[1:] != rank[:-1]) | (own[1:] != own[:-1])
        rank = np.cumsum(fresh) - 1
        stay = (np.bincount(rank)[rank] > 1) | (rank == 0) | (rank == rank[-1])
        alive, rank = alive[stay], rank[stay]
    return alive, rank


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted starts: all but the first of each class of equal 100 bytes."""
    last = (None,) * 4
    for batch in batches:
        if not len(batch):
            continue
        head, tail, doc, start = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        alive, rank = reranked([head >> 32, head, tail])
        same = _repeated(rank, None)
        same[0] = last[0] is not None and (head[0], tail[0]) == last[:2]
        again = same & _repeated(doc[alive], last[2]) & _repeated(start[alive], last[3])
        last = head[-1], tail[-1], doc[-1], start[-1]
        kept = alive[same & ~again]
        yield pa.RecordBatch.from_arrays([pa.array(doc[kept]), pa.array(start[kept] << _N_BITS | 1)], names=["doc", "run"])


def maximal(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal byte runs that runs of repeated starts cover."""
    start = packed >> _N_BITS
    end = start + (packed & ((1 << _N_BITS) - 1)) - 1 + LENGTH
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, ends = [], []
        for own in batch.column(1):
            a, b = maximal(own.values.to_numpy(zero_copy_only=False))
            starts.append(a)
            ends.append(b)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, kind), pa.array(ends, kind)], names=["doc", "starts", "ends"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, starts, ends in zip(batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            data = text.as_py()
            starts, ends = starts or [], ends or []
            kept = b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)], strict=True))
            rows.append((len(data), len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _sized(df: DataFrame, arrays: list[str]) -> DataFrame:
    """``df``, to be broadcast if a count of its bytes allows it."""
    total = df.agg(F.sum(sum((F.size(a) for a in arrays), F.lit(5)) * 8)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with doc, a long in the documents' order.

    Integer ids that are given and unique are that number. Others are numbered by a sort
    of the ids and the texts' hashes.
    """
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    least, most, unnamed = counts.agg(F.count(F.lit(1)), F.max("n"), F.count_if(F.col("doc_id").isNull())).first()
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) and not unnamed and (not least or most == 1):
        return docs.withColumn("doc", F.col("doc_id").cast("long"))
    keyed = docs.withColumn("hash", F.xxhash64("text"))
    order = keyed.select(F.col("doc_id").alias("id"), F.col("hash").alias("own")).distinct().orderBy(F.col("id").asc_nulls_last(), "own")
    order = checkpoint(order.withColumn("doc", F.monotonically_increasing_id()))
    same = keyed["doc_id"].eqNullSafe(order["id"]) & (keyed["hash"] == order["own"])
    return checkpoint(keyed.join(order, same).select("doc_id", "text", "doc"))


def removed_runs(table: DataFrame) -> DataFrame:
    """(doc, starts, ends): the byte runs to remove from each document of a
    ``numbered`` table that has any."""
    texts = table.filter(F.octet_length("text") >= LENGTH).select("doc", "text")
    ranked = texts.mapInArrow(_runs, "key bigint, rest bigint, doc bigint, s0 bigint, whole bigint")
    # runs that are known to repeat go apart by their document, not with their anchor
    place = F.when(F.col("whole").isNotNull(), F.xxhash64("doc")).otherwise(F.shiftright("key", _RANK_BITS))
    ranked = ranked.repartition(place).sortWithinPartitions("key", "rest", "doc", "s0")
    judged = ranked.mapInArrow(_judge, "doc bigint, whole bigint, part bigint")
    by_doc = checkpoint(judged.groupBy("doc").agg(F.collect_list("whole").alias("whole"), F.collect_list("part").alias("part")))

    parts = by_doc.select("doc", "part").filter(F.size("part") > 0)
    open_texts = texts.join(_sized(parts, ["part"]), "doc").select("doc", "text", "part")
    pairs = open_texts.mapInArrow(_pairs, "head bigint, tail bigint, doc bigint, start bigint")
    later = pairs.repartition("head").sortWithinPartitions("head", "tail", "doc", "start").mapInArrow(_later, "doc bigint, run bigint")
    starts = later.groupBy("doc").agg(F.collect_list("run").alias("runs"))
    both = by_doc.select("doc", "whole").join(starts, "doc", "full")
    none = F.expr("cast(array() as array<bigint>)")
    runs = both.select("doc", F.concat(F.coalesce("whole", none), F.coalesce("runs", none)).alias("runs")).filter(F.size("runs") > 0)
    return runs.mapInArrow(_merged, "doc bigint, starts array<bigint>, ends array<bigint>")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    table = numbered(documents_of(docs, id_col, text_col))
    runs = checkpoint(removed_runs(table))
    joined = table.join(_sized(runs, ["starts", "ends"]), "doc", "left").select("doc_id", "text", "starts", "ends")
    id_type = table.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_digest, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
