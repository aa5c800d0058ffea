"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; a local
    one is set only where that is unset, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.conf.get("spark.checkpoint.dir", None) and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="maskwright-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once, also where a lambda uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def places(first: Column, end: Column) -> Column:
    """The integers from first up to end, without it."""
    return F.when(end > first, F.sequence(first, end - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def before(values: Column, join: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """For each element of an int array, ``join`` over all before it, from ``start``.

    A fold copies its state at every step, so one that builds an array takes quadratic
    time. Here folds only add up numbers: over blocks of 64, over 64 blocks, and within
    a block, about 32 steps an element.
    """

    def over(v: Column, first: Column, end: Column) -> Column:
        return F.aggregate(places(first, end), F.lit(start), lambda acc, i: join(acc, F.get(v, i)))

    def blocks(v: Column) -> Column:
        count = F.floor((F.size(v) + _BLOCK - 1) / _BLOCK).cast("int")
        return F.transform(places(F.lit(0), count), lambda b: over(v, b * _BLOCK, F.least(F.size(v), (b + 1) * _BLOCK)))

    def within(v: Column, above: Column) -> Column:
        def one(_: Column, k: Column) -> Column:
            b = F.floor(k / _BLOCK).cast("int")
            return join(F.get(above, b), over(v, b * _BLOCK, k))

        return F.transform(v, one)

    def plain(v: Column) -> Column:
        return F.transform(v, lambda _, k: over(v, F.lit(0), k))

    def three(v: Column) -> Column:
        return let(blocks(v), lambda v1: let(blocks(v1), lambda v2: let(plain(v2), lambda p2: let(within(v1, p2), lambda p1: within(v, p1)))))

    return let(values, lambda v: F.when(F.size(v) <= _BLOCK, plain(v)).otherwise(three(v)))


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so that other columns of any name do no harm."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def count_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_slices(text: pa.Array, most_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into runs of rows of about ``most_bytes``.

    Yields (first row, end row, the run's UTF-8 bytes, row offsets into them). A
    row is never cut, so a run is larger only where one text is.
    """
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    whole = text.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(text):
        end = int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1
        end = min(max(end, first + 1), len(text))
        low = int(offsets[first])
        yield first, end, data[low : int(offsets[end])], offsets[first : end + 1] - low
        first = end
