"""Hierarchical best-fit packing of tokenized documents into fixed sequences.

Each partition cuts its documents' ids into pieces of at most ``capacity`` and packs
them best-fit, longest first. Sequences that are nearly full are final. All others go
up a tree as items of further best-fit rounds, in which the groups of a level are an
eighth of those before, or as many more as keep a group below ``window`` pieces. Where
fewer sequences come out if the items are opened, a group packs their pieces instead.
The rounds end with a single group, or where as many groups as before no longer merge
a tenth of their sequences.

A level's sequences are numbered by their length and dealt to the groups in turn, so
each group gets lengths in the proportions of the whole: where every partition holds
documents of one length, as after a sort, those still meet. Groups are bounded and no
piece is ever dropped.

A document is its ids and then ``end_id``. Null and empty texts are ``end_id``
alone. Rows of the same doc_id are packed as separate documents. Among items of one
length the first goes first, by partition and number; sequences of equal room are
taken last in first out. Columns other than the id and the text are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import checkpoint, documents_of
from maskwright.llm.tokens import text_ids

CAPACITY = 2048
FAN_IN = 8
NEARLY_FULL = 0.98
#: Pieces that a task holds at once.
WINDOW = 200_000
#: A round at as many groups must merge this share of its sequences to be followed by another.
WORTH_WHILE = 0.1
_NUMBER_BITS = 26
TOKENIZER = "word_bpe_49k.json"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the members of each bin, as positions in ``sizes``."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    bins: list[list[int]] = []
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while a bin has room r
    for item in order:
        size = sizes[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
            bins[chosen].append(item)
        else:
            chosen, room = len(bins), capacity
            bins.append([item])
        if left := room - size:
            open_by_room[left].append(chosen)
            rooms |= 1 << left
    return bins


def _bin_type(id_type: T.DataType) -> str:
    piece = f"struct<doc_id: {id_type.simpleString()}, piece: int, start: bigint, length: bigint, ids_crc32: bigint>"
    return f"node bigint, number bigint, size bigint, final boolean, pieces array<{piece}>"


def _numbered(bins: list[list[int]], sizes: list[int]) -> tuple[list[list[int]], list[int]]:
    """Bins and their sizes, longest first."""
    total = [sum(sizes[i] for i in own) for own in bins]
    order = sorted(range(len(bins)), key=total.__getitem__, reverse=True)
    return [bins[k] for k in order], [total[k] for k in order]


def _bins(node: int, first: int, sizes: list[int], capacity: int, pieces: pa.Array) -> list[pa.Array]:
    """The columns of new sequences, numbered from ``first``."""
    if first + len(sizes) > 1 << _NUMBER_BITS:
        raise ValueError("a task made more sequences than an id can number")
    final = [size >= NEARLY_FULL * capacity for size in sizes]
    return [pa.array([node] * len(sizes), pa.int64()), pa.array(range(first, first + len(sizes)), pa.int64()), pa.array(sizes, pa.int64()), pa.array(final, pa.bool_()), pieces]


_COLUMNS = ["node", "number", "size", "final", "pieces"]


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    width = 4 * capacity
    for piece, first in enumerate(range(0, len(ids), width)):
        part = ids[first : first + width]
        yield piece, first // 4, len(part) // 4, zlib.crc32(part)


def _leaf(path: str | None, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_ids(path or public_tokenizers.path(TOKENIZER)).encode
        node, made = TaskContext.get().partitionId(), 0
        ids, held, lengths = [], [], []
        id_type = None

        def packed() -> pa.RecordBatch:
            nonlocal made
            bins, sizes = _numbered(best_fit(lengths, capacity), lengths)
            order = [i for own in bins for i in own]
            flat = pa.StructArray.from_arrays(
                [pa.array([ids[i] for i in order], id_type), pa.array([held[i][0] for i in order], pa.int32())] + [pa.array([held[i][k] for i in order], pa.int64()) for k in (1, 2, 3)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
            edges = pa.array(np.cumsum([0, *map(len, bins)]), pa.int32())
            first, made = made, made + len(bins)
            return pa.RecordBatch.from_arrays(_bins(node, first, sizes, capacity, pa.ListArray.from_arrays(edges, flat)), names=_COLUMNS)

        for batch in batches:
            id_type = batch.column(0).type
            doc_ids = batch.column(0).to_pylist()
            for row, tokens in encode(batch.column(1)):
                for own in pieces_of(tokens + end, capacity):
                    ids.append(doc_ids[row])
                    held.append(own)
                    lengths.append(own[2])
                if len(lengths) >= WINDOW:
                    yield packed()
                    ids, held, lengths = [], [], []
        if lengths:
            yield packed()

    return pack


def _merge(capacity: int):
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("node", "ascending"), ("number", "ascending")]).combine_chunks()
        lists = table["pieces"].combine_chunks()
        held = pa.compute.list_value_length(lists).to_pylist()
        ends = np.cumsum([0, *held]).tolist()
        own_sizes = table["size"].to_pylist()
        bins = best_fit(own_sizes, capacity)
        flat = lists.flatten()
        lengths = flat.field("length").to_pylist()
        opened = best_fit(lengths, capacity) if len(bins) * capacity > sum(lengths) + capacity else bins
        if len(opened) < len(bins):
            bins, sizes = _numbered(opened, lengths)
        else:
            bins, sizes = _numbered(bins, own_sizes)
            bins = [[k for i in own for k in range(ends[i], ends[i + 1])] for own in bins]
        order = pa.array([k for own in bins for k in own], pa.int64())
        pieces = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bins)]), pa.int32()), flat.take(order))
        return pa.table(_bins(key[0].as_py(), 0, sizes, capacity, pieces), names=_COLUMNS)

    return merge


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    docs = documents_of(docs, id_col, text_col)
    schema = _bin_type(docs.schema["doc_id"].dataType)
    level = checkpoint(docs.mapInArrow(_leaf(tokenizer, capacity, end_id), schema))
    done, depth, last_groups, last_open = [], 0, 0, 0
    while True:
        top, made = level.agg(F.max("node"), F.count(F.lit(1))).first()
        still, pieces = level.filter("not final").agg(F.count(F.lit(1)), F.sum(F.size("pieces"))).first()
        groups = max(-(-((top or 0) + 1) // FAN_IN), -(-(pieces or 0) // window))
        idle = groups == last_groups and made > (1 - WORTH_WHILE) * last_open
        if still < 2 or last_groups == 1 or idle:
            done.append(level.withColumn("depth", F.lit(depth)))
            break
        done.append(level.filter("final").withColumn("depth", F.lit(depth)))
        group = F.pmod(F.col("node") + F.col("number"), F.lit(groups)).alias("group")
        level = checkpoint(level.filter("not final").groupBy(group).applyInArrow(_merge(capacity), schema))
        last_groups, last_open, depth = groups, still, depth + 1
    bins = reduce(DataFrame.union, done)
    sequence = F.shiftleft(F.col("depth").cast("long"), 58).bitwiseOR(F.shiftleft("node", _NUMBER_BITS)).bitwiseOR(F.col("number"))
    laid = F.expr(
        "aggregate(pieces, struct(0L as at, cast(array() as array<bigint>) as offsets),"
        " (s, p) -> struct(s.at + p.length as at, array_append(s.offsets, s.at) as offsets), s -> s.offsets)"
    )
    rows = bins.select(sequence.alias("sequence_id"), F.explode(F.arrays_zip("pieces", laid.alias("offset"))).alias("x"))
    return rows.select("x.pieces.*", "sequence_id", F.col("x.offset").alias("offset"))


def packed_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id, ids (array of int). doc_id must be unique."""
    plan = pack_documents(docs, id_col, text_col, tokenizer, capacity, end_id)
    source = documents_of(docs, id_col, text_col)
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, ids array<int>"
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = text_ids(tokenizer or public_tokenizers.path(TOKENIZER)).encode, 4 * capacity
        for batch in batches:
            doc_ids = batch.column(0)
            for row, tokens in encode(batch.column(1)):
                doc_id, ids = doc_ids[row], tokens + end
                parts = [np.frombuffer(ids[i : i + width], "<u4").astype(np.int32) for i in range(0, len(ids), width)]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()] * len(parts), batch.column(0).type), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.int32()))], names=["doc_id", "piece", "ids"])

    pieces = source.mapInArrow(cut, schema)
    joined = plan.join(pieces, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return joined.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
