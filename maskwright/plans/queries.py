"""The registered queries: each operator over the whole tables of a directory."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.functions import bioes, language, pytext, spans, validators
from maskwright.operators import evaluate, training
from maskwright.operators.emissions import GivenSpans
from maskwright.operators.engine import AutoEngine, RedactionEngine, summary_by_label
from maskwright.sources.packs import EntityConfig, load_label_space
from maskwright.sources.rules import RegexRule
from maskwright.sources.text import eval_records
from maskwright.streaming import redact as streaming

# Shared with the SQL in oracles.py; patterns mean the same to Java, RE2 and Python.
RULES = (
    RegexRule("SECRET", "[0-9a-f]{40}", 95),
    RegexRule("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 80),
    RegexRule("BANK", "[0-9]{16}", 65),
    RegexRule("PHONE", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 50),
    RegexRule("ID_NUM", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 40),
)
#: Rules whose matches overlap one another.
CROSSING = (
    RegexRule("NUM", "[0-9]{3,}", 10),
    RegexRule("MIX", "[0-9a-z]{6,9}", 10),
    RegexRule("PAIR", "[a-z]+ [0-9]+", 20),
    RegexRule("SECRET", "[0-9a-f]{40}", 15),
)
CHECKED = (RegexRule("BANK", "[0-9]{16}", 65, "luhn"), RegexRule("NUM", "[0-9]{4}", 10))
KINDS = ("PER", "LOC", "DATE")
TAGS = ("O", "B-PER", "I-PER", "E-PER", "S-PER", "B-LOC", "I-LOC", "E-LOC", "S-LOC")
VITERBI_LABELS = ("O", "B-PER", "I-PER", "E-PER", "S-PER")
PRECEDENCE = (spans.NerPrecedence("PER", ("LOC",)), spans.NerPrecedence("DATE", ("PER", "LOC")))
STOPWORDS = ("ring", "red", "widget")
TRIMS = (spans.SpanTrim("PER", "", ("t", "et", "g"), 3), spans.SpanTrim("PER", "i", ("n",), 1), spans.SpanTrim("DATE", "n", ("g",), 1))
LABEL_MAP = {"PER": "PERSON", "LOC": "PLACE"}
LANGUAGES = ("en", "ja", "ko", "zh-Hans", "zh-Hant")
ROUTED = (
    (1, "박서준 고객 번호 77-20"),
    (2, "Ada Lovelace wrote 12 notes"),
    (3, "佐藤さん は 元気"),
    (4, "这里的学习时间还不够"),
    (5, "這裡的學習時間還不夠"),
    (6, "山水"),
    (7, "2024/05 ???"),
    (8, "서울 office@c.org"),
    (9, ""),
    (10, "カタカナー と 漢字漢字漢字"),
)
#: (id, text, tokens, (s, e) of each) of word pieces over normalized forms.
PIECES = (
    (1, "ＴＥＬ ４５ー６", ("[CLS]", "TEL", "45", "##ー6", "[SEP]"), ((0, 0), (0, 3), (4, 6), (6, 8), (0, 0))),
    (2, "ﬁve ㎞", ("fi", "##ve", "k", "##m", "gone"), ((0, 1), (1, 3), (4, 5), (4, 5), (0, 0))),
)
#: (id, text, decoded text, whether something was lost).
DECODED = ((1, "她用Python写作", "她 用 python 写 作", False), (2, "Ｎｏ．９", "no.9", False), (3, "𝔘ber 𠀋", "uber [UNK]", True))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _rows(df: DataFrame, key: str, column: str) -> DataFrame:
    return spans.exploded(df, [key], column)


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans made of line items: l_orderkey, label, start, end, and a place in order."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    label = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_partkey") % 3 + 1).cast("int"))
    start = ((F.col("l_suppkey") * 7 + F.col("l_linenumber") * 3) % 40).cast("int")
    return lines.select("l_orderkey", label.alias("label"), start.alias("start"), (start + F.col("l_quantity").cast("int") % 7).alias("end"), "l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("place"))


def _collected(rows: DataFrame) -> DataFrame:
    """An array of an order's spans, in order of place."""
    listed = F.sort_array(F.collect_list(F.struct("place", "label", "start", "end")))
    return rows.groupBy("l_orderkey").agg(F.transform(listed, lambda s: spans.span(s["label"], s["start"], s["end"])).alias("spans"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, tags, offsets: a token for each line item."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    grouped = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("x"))
    tags = F.transform("x", lambda t: F.element_at(F.array(*map(F.lit, TAGS)), (t["l_partkey"] % 9 + 1).cast("int")))
    special = F.transform("x", lambda t, i: F.when(t["l_suppkey"] % 11 == 0, F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"))).otherwise(F.struct((i * 3).alias("s"), (i * 3 + 2).alias("e"))))
    return grouped.select("l_orderkey", tags.alias("tags"), special.alias("offsets"))


def regex_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return _rows(docs.withColumn("s", spans.regex_spans(F.col("text"), RULES)), "doc_id", "s")


def greedy_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return _rows(docs.withColumn("s", spans.regex_spans(F.col("text"), CROSSING)), "doc_id", "s")


def luhn_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return _rows(docs.withColumn("s", spans.regex_spans(F.col("text"), CHECKED)), "doc_id", "s")


def verify_fail_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown validator keeps every match."""
    docs = _documents(spark, sf_dir)
    return _rows(docs.withColumn("s", spans.regex_spans(F.col("text"), (RegexRule("BANK", "[0-9]{16}", 65, "no_such_check"),))), "doc_id", "s")


def rrn_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    value = F.concat(F.lpad((key * 104729 % 1000000).cast("string"), 6, "0"), F.lit("-"), F.lpad((key * 1299709 % 10000000).cast("string"), 7, "0"))
    return _table(spark, sf_dir, "customer").select("c_custkey", value.alias("value")).withColumn("valid", validators.verify("kr_rrn_valid", F.col("value")))


def redact_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RedactionEngine(RULES).redact(_documents(spark, sf_dir)).select("doc_id", "redacted_text", "span_count")


def redact_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RedactionEngine(RULES).redact(_documents(spark, sf_dir), output_mode="redacted").select("doc_id", "redacted_text", "span_count")


def redact_entity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RedactionEngine(RULES).redact(_documents(spark, sf_dir), entity_types=["EMAIL", "PHONE"]).select("doc_id", "redacted_text", "span_count")


def redact_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return RedactionEngine(RULES).redact(turns).select("conv_id", "turn", "role", "redacted_text", "span_count")


def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole result struct as JSON."""
    made = RedactionEngine(RULES).result(_documents(spark, sf_dir))
    return made.select("doc_id", F.to_json("result.summary").alias("summary"), F.to_json("result.detected_spans").alias("detected_spans"), F.col("result.schema_version").alias("schema_version"))


def highlight_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = RedactionEngine(RULES).detected(_documents(spark, sf_dir))
    return found.select("doc_id", spans.highlighted(F.col("text"), F.col("detected_spans")).alias("highlighted"))


def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_by_label(RedactionEngine(RULES).detected(_documents(spark, sf_dir)))


def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("id", language.script_counts(F.col("text")).alias("n")).select("id", *[F.col(f"n.{s}").alias(s.lower()) for s in language.SCRIPTS])


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts above under negative ids, and all documents."""
    texts = spark.createDataFrame(ROUTED, "id bigint, text string").select((-F.col("id")).alias("id"), "text")
    return texts.union(_documents(spark, sf_dir))


def simp_trad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("id", language.form_counts(F.col("text")).alias("n")).select("id", "n.*")


def route_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _routed(spark, sf_dir).select("id", language.detect_language(F.col("text"), LANGUAGES, "").alias("detected"))
    return found.withColumn("routed", language.routed(F.col("detected"), LANGUAGES))


def auto_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows routed to a language's rules: en has all rules, others have emails only."""
    auto = AutoEngine(lambda code: RedactionEngine(RULES if code == "en" else RULES[1:2]), LANGUAGES, "")
    return auto.redact(_documents(spark, sf_dir)).select("doc_id", "language", "redacted_text", "span_count")


def label_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(list(load_label_space().labels),)], "labels array<string>").select(F.posexplode("labels").alias("id", "label"))


def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in bioes.label_list()])
    pairs = spark.range(1).select(F.explode(names).alias("previous")).select("previous", F.explode(names).alias("following"))
    kind = bioes.category_column(F.col("previous"), F.col("following"))
    point = bioes.resolve_operating_point("high_recall")
    score = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in zip(bioes.CATEGORIES, point, strict=True) for x in p]), kind), F.lit(bioes.ILLEGAL))
    return pairs.select("previous", "following", kind.alias("category"), score.alias("score"))


def effective_biases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(name, list(point)) for name, point in bioes.OPERATING_POINTS.items()]
    points = spark.createDataFrame(rows, "name string, point array<double>")
    baseline = F.array(*[F.lit(x) for x in (0.25, -0.5, 0.0, 1.0, 2.0, -1.5)])
    return points.select("name", F.posexplode(bioes.effective_biases(baseline, F.col("point"))).alias("place", "bias"))


def _emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    scores = F.array(*[((F.col("l_partkey") * (j + 1) + F.col("l_suppkey")) % 7).cast("double") for j in range(5)])
    listed = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", scores.alias("scores"))))
    return lines.groupBy("l_orderkey").agg(F.transform(listed, lambda t: t["scores"]).alias("emissions"))


def viterbi_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = bioes.resolve_operating_point("high_recall")
    return _emissions(spark, sf_dir).select("l_orderkey", F.array_join(bioes.viterbi_tags(F.col("emissions"), VITERBI_LABELS, point), ",").alias("path"))


def viterbi_path_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = bioes.resolve_operating_point("high_recall")
    return _emissions(spark, sf_dir).select("l_orderkey", F.array_join(bioes.viterbi_tags_native(F.col("emissions"), VITERBI_LABELS, point), ",").alias("path"))


def bioes_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten tokens of three characters, the first special, tagged by an order's spans."""
    offsets = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((i * 4).cast("int").alias("s"), F.when(i == 0, 0).otherwise(i * 4 + 3).cast("int").alias("e")))
    found = _collected(line_spans(spark, sf_dir)).withColumn("tags", bioes.encode(F.col("spans"), offsets))
    return found.select("l_orderkey", F.array_join("tags", ",").alias("tags"))


def bioes_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_tagged(spark, sf_dir).withColumn("s", bioes.decode(F.col("tags"), F.col("offsets"))), "l_orderkey", "s")


def valid_bioes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("l_orderkey", bioes.is_valid_sequence(F.col("tags")).alias("valid"))


def coalesce_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_collected(line_spans(spark, sf_dir)).withColumn("s", spans.coalesce_adjacent(F.col("spans"))), "l_orderkey", "s")


def _word_spans(label: Column) -> Column:
    """The first word of p_name and the whole of it, as spans."""
    first = F.length(F.substring_index("p_name", " ", 1))
    return F.array(spans.span(label, F.lit(0), first), spans.span(label, first, F.length("p_name")))


def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_name")
    kept = spans.filter_stopwords(_word_spans(F.lit("PER")), F.col("p_name"), STOPWORDS)
    return _rows(parts.withColumn("s", kept), "p_partkey", "s")


def span_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_name")
    label = F.when(F.col("p_partkey") % 2 == 0, "PER").otherwise("DATE")
    return _rows(parts.withColumn("s", spans.trim_trailing(_word_spans(label), F.col("p_name"), TRIMS)), "p_partkey", "s")


def _two_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, regex and ner spans: line items of return flag A, and the others."""
    own = F.sort_array(F.collect_list(F.struct("place", "label", "start", "end", "l_returnflag")))
    grouped = line_spans(spark, sf_dir).groupBy("l_orderkey").agg(own.alias("every"))

    def of(flag: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter("every", lambda s: flag(s["l_returnflag"])), lambda s: spans.span(s["label"], s["start"], s["end"]))

    return grouped.select("l_orderkey", of(lambda f: f == "A").alias("regex"), of(lambda f: f != "A").alias("ner"))


def ner_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _two_sets(spark, sf_dir)
    return _rows(both.withColumn("s", spans.apply_ner_precedence(F.col("regex"), F.col("ner"), PRECEDENCE)), "l_orderkey", "s")


def merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _two_sets(spark, sf_dir)
    return _rows(spans.merge_union(both, F.col("regex"), F.col("ner"), "s"), "l_orderkey", "s")


def hybrid_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and given model spans, with precedence, stopwords and trimming, end to end."""
    docs = _documents(spark, sf_dir)
    word = F.length(F.regexp_extract("text", "^[^ ]*", 0))
    docs = docs.withColumn("model", F.array(spans.span(F.lit("PER"), F.lit(0), word), spans.span(F.lit("LOC"), word, word + 6)))
    config = EntityConfig(frozenset(("The", "An")), (spans.SpanTrim("PER", "", ("es", "s"), 2),), PRECEDENCE)
    return RedactionEngine(RULES, config, GivenSpans("model")).redact(docs).select("doc_id", "redacted_text", "span_count")


def label_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _collected(line_spans(spark, sf_dir))
    return _rows(found.withColumn("s", training.remap_labels(F.col("spans"), LABEL_MAP)), "l_orderkey", "s")


def _gold_and_pred(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = line_spans(spark, sf_dir).withColumnRenamed("l_orderkey", "id")
    gold, pred = rows.filter("l_returnflag <> 'R'"), rows.filter("l_returnflag <> 'A'")
    return gold.select("id", "label", "start", "end"), pred.select("id", "label", "start", "end")


def eval_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.typed_scores(*_gold_and_pred(spark, sf_dir))


def eval_untyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.untyped_scores(*_gold_and_pred(spark, sf_dir))


def eval_source_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.source_recall(*_gold_and_pred(spark, sf_dir))


def train_label_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label ids of the tokens of ``bioes_encode``, special ones ignored."""
    offsets = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((i * 4).cast("int").alias("s"), F.when(i == 0, 0).otherwise(i * 4 + 3).cast("int").alias("e")))
    labels = bioes.label_list(KINDS)
    found = _collected(line_spans(spark, sf_dir)).withColumn("ids", training.label_ids(F.col("spans"), offsets, labels))
    return found.select("l_orderkey", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("label_ids"))


def pad_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of orders, padded within batches of eight orders."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("ids"))
    filled = training.padded(lines.withColumn("batch", F.floor(F.col("l_orderkey") / 8)), "batch", {"ids": 0})

    def joined(name: str) -> Column:
        return F.array_join(F.transform(name, lambda x: x.cast("string")), ",").alias(name)

    return filled.select("l_orderkey", joined("ids"), joined("attention_mask"))


def focal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    logits = F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 10)
    target = F.when(F.col("l_linenumber") % 4 == 3, training.IGNORED).otherwise(F.col("l_linenumber") % 4)
    rows = lines.select(logits.alias("logits"), target.cast("int").alias("target"))
    return training.focal_loss(rows, "logits", "target").select(F.round("focal_loss", 4).alias("focal_loss"))


def nfkc_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and sums of the offsets of a text's pieces: those above, and the words of
    every document, which its normal form has at the same places."""
    rows = [(-i, text, list(tokens)) for i, text, tokens, _ in PIECES]
    words = F.filter(F.split("text", " "), lambda w: w != "")
    texts = spark.createDataFrame(rows, "id bigint, text string, tokens array<string>").union(_documents(spark, sf_dir).select("doc_id", "text", words))
    found = texts.select("id", pytext.reconstructed_offsets(F.col("text"), F.col("tokens")).alias("o"))

    def total(of: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.transform("o", of), F.lit(0).cast("long"), lambda a, x: a + x)

    return found.select("id", F.size("o").alias("n"), total(lambda o: o["s"]).alias("starts"), total(lambda o: o["e"]).alias("ends"), F.coalesce(F.array_max("o.e"), F.lit(0)).alias("last"))


def decode_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases above, and every document against a decoded form: in lower case, without
    blanks, or with a character more."""
    texts = spark.createDataFrame([(-i, text, decoded) for i, text, decoded, _ in DECODED], "id bigint, text string, decoded string")
    turn = F.col("doc_id") % 3
    decoded = F.when(turn == 0, F.lower("text")).when(turn == 1, F.replace("text", F.lit(" "), F.lit(""))).otherwise(F.concat("text", F.lit("x")))
    every = texts.union(_documents(spark, sf_dir).select("doc_id", "text", decoded))
    return every.select("id", pytext.decode_mismatch(F.col("text"), F.col("decoded")).alias("mismatch"))


def eval_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine's scores on records that are written as JSON lines and read again: the
    rules against a gold standard of emails and phone numbers."""
    gold = _documents(spark, sf_dir).select("text", spans.regex_spans(F.col("text"), (RULES[1], RULES[3])).alias("spans")).filter("text is not null")
    folder = f"{streaming.shared_folder(spark)}/records-{uuid.uuid4().hex}"
    gold.write.json(folder)
    return evaluate.evaluate(RedactionEngine(RULES), eval_records(spark, folder))[1]


def arrow_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules in Python's regex engine, the other side of ``greedy_priority``."""
    docs = _documents(spark, sf_dir)
    return _rows(docs.withColumn("s", pytext.regex_spans_arrow(F.col("text"), CROSSING)), "doc_id", "s")


def stream_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as a stream, redacted, written and read back."""
    folder = f"{streaming.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    docs = streaming.table_stream(spark, sf_dir, "documents.parquet").select("doc_id", "text")
    redacted = RedactionEngine(RULES).redact(docs).select("doc_id", "redacted_text", "span_count")
    streaming.write_stream(redacted, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(redacted.schema).parquet(f"{folder}/out")


def latest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three spans of each document, by start: a top-k report."""
    found = regex_spans(spark, sf_dir)
    last = Window.partitionBy("doc_id").orderBy(F.col("start").desc())
    return found.withColumn("place", F.row_number().over(last)).filter("place <= 3")


QUERIES = {
    f.__name__: f
    for f in (
        regex_spans, greedy_priority, arrow_spans, luhn_gate, verify_fail_open, rrn_gate, redact_typed, redact_generic, redact_entity_filter, redact_conversations,
        result_json, highlight_plain, label_summary, script_counts, simp_trad, route_language, auto_redact, label_space, transition_matrix, effective_biases, viterbi_path,
        viterbi_path_native, bioes_encode, bioes_decode, valid_bioes, coalesce_spans, stopword_filter, span_trim, ner_precedence, merge_union, hybrid_redact, label_remap,
        eval_typed, eval_untyped, eval_source_recall, train_label_ids, pad_batches, focal_loss, nfkc_offsets, decode_mismatch, eval_run, stream_redact, latest_spans,
    )
}
