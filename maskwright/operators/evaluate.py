"""Strict span scores: precision, recall and F1, by label and in total.

``gold`` and ``pred`` are span rows (id, label, start, end). Matching is a full outer
join on whole keys after a distinct; counts are aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.spans import exploded


def span_rows(df: DataFrame, id_col: str, spans_col: str) -> DataFrame:
    """A row for each span of an array column."""
    return exploded(df.select(F.col(id_col).alias("id"), spans_col), ["id"], spans_col)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1 (rounded to 4 places, from unrounded values) and counts."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0)
    return [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn")]


def _matched(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct key with in_gold and in_pred."""
    g = gold.select(*keys).distinct().withColumn("in_gold", F.lit(True))
    p = pred.select(*keys).distinct().withColumn("in_pred", F.lit(True))
    return g.join(p, keys, "full").fillna(False, ["in_gold", "in_pred"])


def _counts() -> list[Column]:
    g, p = F.col("in_gold"), F.col("in_pred")
    return [F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn")]


def typed_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Scores by label, and of all labels under ``micro``; label and offsets must match."""
    rows = _matched(gold, pred, ["id", "label", "start", "end"])
    total = rows.rollup("label").agg(*_counts(), F.grouping("label").alias("all"))
    return total.select(F.when(F.col("all") == 1, "micro").otherwise(F.col("label")).alias("label"), *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def untyped_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row of scores where offsets alone must match."""
    return _matched(gold, pred, ["id", "start", "end"]).agg(*_counts()).select(*prf(F.col("tp"), F.col("fp"), F.col("fn")))


def source_recall(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(label, recall): the share of each source label's spans, repeated ones counted
    each, whose offsets are predicted."""
    hits = pred.select("id", "start", "end").distinct().withColumn("hit", F.lit(1.0))
    return gold.join(hits, ["id", "start", "end"], "left").groupBy("label").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 4).alias("recall"))


def evaluate(engine, records: DataFrame, mode: str = "typed", dataset: str = "") -> tuple[dict, DataFrame]:
    """A report and the score rows of an engine on (doc_id, text, spans) records."""
    if mode not in ("typed", "untyped"):
        raise ValueError("mode is typed or untyped")
    found = engine.redact(records.select("doc_id", "text", "spans"))
    gold = span_rows(found, "doc_id", "spans")
    pred = span_rows(found, "doc_id", "detected_spans")
    report = {"dataset": dataset, "eval_mode": mode, "examples": records.count(), "ner_enabled": engine.has_ner}
    if mode == "typed":
        scores = typed_scores(gold, pred)
        rows = {r["label"]: {k: r[k] for k in ("precision", "recall", "f1", "tp", "fp", "fn")} for r in scores.collect()}
        return report | {"micro": rows.pop("micro"), "per_label": dict(sorted(rows.items()))}, scores
    scores = untyped_scores(gold, pred)
    recall = {r["label"]: r["recall"] for r in source_recall(gold, pred).collect()}
    return report | {"span_level": scores.first().asDict(), "ground_truth_label_recall": dict(sorted(recall.items()))}, scores
