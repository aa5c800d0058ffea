"""Preparation of token-classifier training data, its loss as a column, and a trainer.

Fine-tuning a transformer needs torch; here a multinomial logistic regression of
``pyspark.ml`` on hashed token features is trained instead, with the same labels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import bioes
from maskwright.functions.spans import span

IGNORED = -100


def remap_labels(spans: Column, label_map: Mapping[str, str]) -> Column:
    """Spans with their labels mapped; unmapped ones go; an empty map changes nothing."""
    if not label_map:
        return spans
    table = F.create_map(*[F.lit(x) for pair in label_map.items() for x in pair])
    mapped = F.transform(spans, lambda s: span(F.try_element_at(table, s["label"]), s["start"], s["end"]))
    return F.filter(mapped, lambda s: s["label"].isNotNull())


def label_ids(spans: Column, offsets: Column, labels: Sequence[str]) -> Column:
    """Each token's label id; special tokens (0, 0) are ignored."""
    names = F.array(*[F.lit(x) for x in labels])
    ids = F.transform(bioes.encode(spans, offsets), lambda tag: (F.array_position(names, tag) - 1).cast("int"))
    return F.zip_with(ids, offsets, lambda i, o: F.when((o["s"] == 0) & (o["e"] == 0), IGNORED).otherwise(i))


def padded(df: DataFrame, batch_col: str, columns: Mapping[str, int], mask_col: str = "attention_mask") -> DataFrame:
    """Array columns filled up to the longest row of their batch, and a mask.

    ``columns`` gives each array column's filling. A batch has a bounded size.
    """
    first = next(iter(columns))
    longest = F.max(F.size(first)).over(Window.partitionBy(batch_col))
    df = df.withColumn("_mw_longest", longest)
    mask = F.concat(F.array_repeat(F.lit(1), F.size(first)), F.array_repeat(F.lit(0), F.col("_mw_longest") - F.size(first)))
    filled = {name: F.concat(name, F.array_repeat(F.lit(fill), F.col("_mw_longest") - F.size(name))) for name, fill in columns.items()}
    return df.withColumns({mask_col: mask, **filled}).drop("_mw_longest")


def focal_terms(logits: Column, target: Column, gamma: float = 2.0) -> Column:
    """-(1 - p)^gamma log p of the target's probability; null where it is ignored."""
    top = F.array_max(logits)
    log_sum = F.log(F.aggregate(logits, F.lit(0.0), lambda total, x: total + F.exp(x - top)))
    log_p = F.get(logits, target) - top - log_sum
    return F.when(target != IGNORED, -F.pow(1 - F.exp(log_p), F.lit(gamma)) * log_p)


def focal_loss(rows: DataFrame, logits_col: str, target_col: str, gamma: float = 2.0) -> DataFrame:
    """One row: the mean focal loss, 0 if every target is ignored."""
    return rows.agg(F.coalesce(F.avg(focal_terms(F.col(logits_col), F.col(target_col), gamma)), F.lit(0.0)).alias("focal_loss"))


def token_features(text: Column, offsets: Column) -> Column:
    """array<array<string>>: simple features of each token for a linear classifier."""

    def of(o: Column) -> Column:
        word = F.substring(text, o["s"] + 1, o["e"] - o["s"])
        before = F.substring(text, F.greatest(o["s"] - 7, F.lit(1)), F.least(o["s"], F.lit(8)))
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "0")
        return F.array(F.concat(F.lit("w="), F.lower(word)), F.concat(F.lit("s="), shape), F.concat(F.lit("b="), F.lower(before)), F.concat(F.lit("n="), F.length(word)))

    return F.transform(offsets, of)


@dataclass
class TokenClassifier:
    """Multinomial logistic regression on hashed token features; trained in Spark."""

    labels: Sequence[str]
    features: int = 1 << 12
    epochs: int = 20
    regularization: float = 1e-3

    def fit(self, records: DataFrame):
        """``records``: text, offsets, spans. Returns a fitted pyspark.ml pipeline."""
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import HashingTF

        stages = [HashingTF(numFeatures=self.features, inputCol="words", outputCol="features"), LogisticRegression(maxIter=self.epochs, regParam=self.regularization, family="multinomial")]
        return Pipeline(stages=stages).fit(self.tokens(records).filter(F.col("label") != IGNORED))

    def tokens(self, records: DataFrame) -> DataFrame:
        """A row for each token: words (its features) and label."""
        ids = label_ids(F.col("spans"), F.col("offsets"), self.labels)
        zipped = F.arrays_zip(token_features(F.col("text"), F.col("offsets")).alias("words"), ids.cast("array<double>").alias("label"))
        return records.select(F.explode(zipped).alias("x")).select("x.words", "x.label")
