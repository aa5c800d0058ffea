"""Mixing sources to target weights with a hypergeometric splitting tree.

1. Sources in code-point order, null last, have weights 1, 2, 3, 1, ... and share the
   total size; a target stops at ``most_repeats`` times its source's size and the
   excess goes to the others by weight. With caps c and weights w the targets are
   min(level * w, c) at the level where they add up to the total; sorted by c / w,
   prefix sums give that level directly.
2. Each source is hashed into blocks. A source with target ratio r draws all of its
   blocks floor(r) times, and once more the first blocks of a permutation until the
   target is reached; the last of these gives only its first documents, in permuted
   order, so that a source misses its target by less than one document.
3. The draws of a pass over a source are its quota. A binary tree splits the quotas
   of all sources among the shards: at each node the left half of the shards gets
   its exact number of draws by a multivariate hypergeometric draw. A shard takes the
   next blocks of each source's permutation, so shards are disjoint. The result names
   the shards of each row; ``shuffled`` writes a partition for each shard, in which
   rows are ordered by a hash.

Everything random comes from ``seed`` and stable hashes; reruns agree. A null text
has size 0; a source of size 0 has target 0 and is not drawn. Null sources form one
source. Rows that agree in doc_id, source and text are drawn together, as one document
of their common size; rows that share only a doc_id, null included, are documents of
their own. Every row has a row in the result. An empty table gives no rows.
``mix_documents`` holds rows as structs and ``shuffled`` returns their columns, so other
columns keep their names whatever these are. The driver holds one row of numbers per
source and one number per source and shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import checkpoint, count_words

MOST_REPEATS = 3
WEIGHT_CYCLE = 3
BLOCK_DOCS = 64
MOST_BLOCKS = 1 << 16
#: Shards at least, and the words of one where that makes more.
SHARDS = 16
SHARD_WORDS = 1 << 23
SEED = 11


def targets(sizes: DataFrame, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, n_docs, ordinal, target) from one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("ordinal", F.row_number().over(by_name).cast("long"))
    ranked = ranked.withColumn("weight", ((F.col("ordinal") - 1) % WEIGHT_CYCLE + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most_repeats)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "ordinal")
    above = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(above)
    # the level of the first source, by cap / weight, that stays below its cap
    ranked = ranked.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    ranked = ranked.withColumn("level", F.first("level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return ranked.select("source", "source_size", "n_docs", "ordinal", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Draws of each source for each shard, [source, shard]; rows add up to quotas."""
    out = np.zeros((len(quotas), shards), np.int64)

    def descend(counts: np.ndarray, first: int, end: int) -> None:
        if end - first == 1:
            out[:, first] = counts
            return
        half, total = (first + end) // 2, int(counts.sum())
        wanted = total * (half - first) // (end - first)
        left = rng.multivariate_hypergeometric(counts, wanted, method="marginals") if wanted else np.zeros_like(counts)
        descend(left, first, half)
        descend(counts - left, half, end)

    if len(quotas):
        descend(np.asarray(quotas, np.int64), 0, shards)
    return out


def _hash(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


class Mix:
    """The draws of one mix over ``docs``."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, seed: int = SEED):
        self.seed = seed
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("digest"), count_words(F.col(text_col)).alias("size"))
        sized = checkpoint(rows.groupBy("doc_id", "source", "digest", "size").agg(F.count(F.lit(1)).alias("n_rows")))
        per_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.sum("n_rows").alias("n_docs"))
        self.sources = checkpoint(targets(per_source))
        words = self.sources.agg(F.sum("source_size")).first()[0] or 0
        self.shards = shards or max(SHARDS, -(-words // SHARD_WORDS))
        blocks = F.least(F.ceil(F.col("n_docs") / BLOCK_DOCS), F.lit(MOST_BLOCKS)).cast("long")
        # rows without an id are spread over the blocks by their texts
        place = F.when(F.col("doc_id").isNotNull(), _hash(seed, F.col("doc_id"))).otherwise(_hash(seed, F.col("digest")))
        named = self.sources.withColumn("blocks", blocks).withColumnRenamed("source", "_source")
        self.docs = checkpoint(
            sized.join(named, sized["source"].eqNullSafe(named["_source"]), "inner")
            .select("doc_id", "source", "digest", "n_rows", "size", "ordinal", "source_size", "target", F.pmod(place, F.col("blocks")).alias("block"))
        )
        self.blocks = checkpoint(self._drawn_blocks())

    def _drawn_blocks(self) -> DataFrame:
        """(ordinal, block, rank, passes, room): passes over the whole block, and the
        words that one further, partial pass may take (null where there is none)."""
        sums = self.docs.groupBy("ordinal", "block").agg(F.sum(F.col("size") * F.col("n_rows")).alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
        permuted = Window.partitionBy("ordinal").orderBy(_hash(self.seed + 1, F.col("ordinal"), F.col("block")), "block")
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        before = F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = sums.select("ordinal", "block", "words", F.row_number().over(permuted).alias("rank"), whole.alias("whole"), (F.col("target") - whole * F.col("source_size") - before).alias("left"))
        full = (F.col("left") >= F.col("words")) & (F.col("words") > 0)
        part = (F.col("left") > 0) & ~full
        return ranked.select("ordinal", "block", "rank", (F.col("whole") + full.cast("long")).alias("passes"), F.when(part, F.col("left")).alias("room"))

    def draws(self) -> DataFrame:
        """(ordinal, block, pass, room, shard): each block draw and its shard."""
        every = F.sequence(F.lit(1), (F.col("passes") + F.col("room").isNotNull().cast("long")).cast("int"))
        drawn = self.blocks.filter("passes > 0 or room is not null").select("ordinal", "block", "rank", "passes", "room", F.explode(every).alias("pass"))
        drawn = drawn.withColumn("room", F.when(F.col("pass") > F.col("passes"), F.col("room")))
        turn = Window.partitionBy("ordinal").orderBy("pass", "rank")
        drawn = drawn.withColumn("turn", F.row_number().over(turn))
        quotas = sorted((r["ordinal"], r["n"]) for r in drawn.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n")).collect())
        split = split_quotas(np.array([n for _, n in quotas], np.int64), self.shards, np.random.default_rng(self.seed))
        ends = np.cumsum(split, axis=1).tolist()
        # an Arrow table is a local relation of the plan; a list would need Python workers
        columns = [pa.array([o for o, _ in quotas], pa.int64()), pa.array(ends, pa.list_(pa.int64()))]
        table = self.docs.sparkSession.createDataFrame(pa.table(columns, names=["ordinal", "ends"]))
        # the shard whose share of the permutation holds this turn
        shard = F.size(F.filter("ends", lambda e: e < F.col("turn")))
        return drawn.join(table, "ordinal").select("ordinal", "block", "pass", "room", shard.alias("shard"))

    def drawn_documents(self) -> DataFrame:
        """(doc_id, source, digest, n_rows, size, source_size, target, draws): a row for
        each document, with an array of (pass, shard), one for each time it is taken."""
        words = F.col("size") * F.col("n_rows")
        inside = Window.partitionBy("ordinal", "block").orderBy(_hash(self.seed + 2, F.col("doc_id")), "doc_id", "digest", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = self.docs.withColumn("up_to", F.sum(words).over(inside))
        drawn = self.draws().groupBy("ordinal", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "room"))).alias("drawn"))
        # a partial pass takes the documents whose middle lies within the room
        fits = F.filter("drawn", lambda d: d["room"].isNull() | (F.col("up_to") - words / 2 <= d["room"]))
        taken = F.coalesce(F.transform(fits, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"))), F.expr("cast(array() as array<struct<pass int, shard int>>)"))
        joined = placed.join(drawn, ["ordinal", "block"], "left")
        return joined.select("doc_id", "source", "digest", "n_rows", "size", "source_size", "target", taken.alias("draws"))

    def result(self) -> DataFrame:
        """doc_id, size, source_size, target, taken and shards of each row; shards has
        one number for each time the row is taken."""
        rows = self.drawn_documents().withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
        return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.col("draws.shard").alias("shards"))


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    return Mix(docs, **options).result()


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: (row, shard, position), a row of ``docs`` for each draw."""
    return _placed(Mix(docs, id_col, text_col, source_col, **options), docs, id_col, text_col, source_col)


def shuffled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix with the columns of ``docs``: partition k holds shard k in its order."""
    mix = Mix(docs, id_col, text_col, source_col, **options)
    dealt = _placed(mix, docs, id_col, text_col, source_col).repartitionById(mix.shards, F.col("shard"))
    return dealt.sortWithinPartitions("position").select("row.*")


def _placed(mix: Mix, docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, shard, position): the rows of ``docs`` as structs, so that no name clashes."""
    taken = mix.drawn_documents().filter(F.size("draws") > 0).select("doc_id", "source", "digest", "draws")
    held = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("of"), F.xxhash64(F.col(text_col)).alias("text"))
    # one row of taken at most for each row of docs
    same = held["id"].eqNullSafe(taken["doc_id"]) & held["of"].eqNullSafe(taken["source"]) & (held["text"] == taken["digest"])
    rows = held.join(taken, same).select("row", "id", "text", F.explode("draws").alias("draw"))
    return rows.select("row", "draw.shard", _hash(mix.seed + 3, F.col("draw.shard"), F.col("draw.pass"), F.col("id"), F.col("text")).alias("position"))
