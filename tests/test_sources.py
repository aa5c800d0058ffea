import json

import pytest
from pyspark.sql import functions as F

from maskwright.cli import main, parse_operating_point, parser
from maskwright.functions import render, sqlapi
from maskwright.functions.bioes import label_list
from maskwright.functions.spans import NerPrecedence, SpanTrim
from maskwright.operators import evaluate, training
from maskwright.operators.emissions import TaggedTokens
from maskwright.operators.engine import RedactionEngine, summary_by_label
from maskwright.sources import packs, text
from maskwright.sources.rules import RegexRule
from maskwright.streaming import redact as streaming

RULES = [RegexRule("EMAIL", r"[a-z]+@[a-z.]+", 2), RegexRule("PHONE", r"[0-9]{3}-[0-9]{4}", 1)]
SPANS = "array<struct<label: string, start: int, end: int>>"


def test_precedence_parser():
    good = packs.parse_ner_precedence({"ner_precedence": [{"label": "BANK", "over": ["ID_NUM", "BANK", 3, ""]}]})
    assert good == (NerPrecedence("BANK", ("ID_NUM",)),)
    for bad in ({"label": ""}, {"over": ["A"]}, {"label": "A"}, {"label": "A", "over": []}, {"label": "A", "over": ["A"]}, {"label": "A", "over": "B"}, "x"):
        assert packs.parse_ner_precedence({"ner_precedence": [bad]}) == ()
    assert packs.parse_ner_precedence(None) == ()


def test_trim_parser():
    good = {"label": "DATE", "after": "일", "suffixes": ["이", "", 3]}
    assert packs.parse_span_trims({"span_trim": [good]}) == (SpanTrim("DATE", "일", ("이",), 1),)
    for bad in ({"after": ""}, {"suffixes": []}, {"suffixes": "이"}, {"min_keep": "2"}, {"min_keep": True}, {"min_keep": 0}, {"label": 1}):
        assert packs.parse_span_trims({"span_trim": [good | bad]}) == ()
    assert packs.parse_span_trims({"span_trim": ["x"]}) == ()
    assert packs.parse_span_trims({"span_trim": [{"label": "P", "suffixes": ["a"], "min_keep": 2}]})


def test_pack_files_and_registry(tmp_path, monkeypatch):
    (tmp_path / "regex_rules.yaml").write_text("rules: [{label: A, pattern: 'a'}]\n")
    (tmp_path / "entity_config.yaml").write_text("stopwords: [' x ', '', 3]\ndefault_operating_point: high_recall\n")
    pack = packs.LanguagePack("xx", folder=str(tmp_path))
    assert pack.rules() == [RegexRule("A", "a")]
    assert pack.config().stopwords == frozenset(["x"]) and pack.config().operating_point == "high_recall"
    assert packs.LanguagePack("yy", folder=str(tmp_path / "none")).config() == packs.EntityConfig()
    assert packs.parse_operating_point({"default_operating_point": "turbo"}) is None
    with pytest.raises(ValueError, match="no language pack"):
        packs.resolve_language()
    packs.register_language(pack)
    try:
        assert packs.resolve_language() is pack and packs.resolve_language("xx") is pack
        with pytest.raises(ValueError, match="xx"):
            packs.resolve_language("zz")
        packs.register_language(packs.LanguagePack("yy"))
        with pytest.raises(ValueError, match="several"):
            packs.resolve_language()
        assert RedactionEngine.from_pack("xx").rules == [RegexRule("A", "a")]
        other = tmp_path / "other.yaml"
        other.write_text("rules: [{label: B, pattern: 'b'}]\n")
        monkeypatch.setenv("MASKWRIGHT_REGEX_RULES", str(other))
        assert RedactionEngine.from_pack("xx").rules == [RegexRule("B", "b")]
    finally:
        packs.unregister_language("xx")
        packs.unregister_language("yy")


def test_label_space(tmp_path):
    assert len(packs.load_label_space().labels) == 33
    path = tmp_path / "space.json"
    path.write_text(json.dumps({"label_map": {"name": "PER", "city": "LOC", "first": "PER"}}))
    space = packs.load_label_space(path)
    assert list(space.labels) == label_list(["PER", "LOC"])
    assert space.remap("first") == "PER" and space.remap("other") is None
    assert packs.load_label_space().remap("any") == "any"


def test_weights_are_local(tmp_path):
    with pytest.raises(FileNotFoundError):
        packs.resolve_weights(str(tmp_path))
    (tmp_path / "bundle.json").write_text("{}")
    assert packs.resolve_weights(str(tmp_path)) == tmp_path
    assert packs.resolve_weights("remote", lambda name: "/x/" + name).as_posix() == "/x/remote"


def test_records(spark, tmp_path):
    path = tmp_path / "data.jsonl"
    path.write_text('{"text": "a@b.c", "spans": [{"label": "EMAIL", "start": 0, "end": 5}]}\n\n  \n{"text": "none"}\n{"text": "last"}\n')
    rows = text.eval_records(spark, str(path)).collect()
    assert sorted(r.text for r in rows) == ["a@b.c", "last", "none"]
    rows = text.eval_records(spark, str(path), limit=4).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, len(r.spans)) for r in rows] == [(0, "a@b.c", 1), (3, "none", 0)]
    path.write_text('{"spans": []}\n')
    with pytest.raises(Exception, match="no text"):
        text.eval_records(spark, str(path)).collect()


def test_whole_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n\n")
    assert text.whole_files(spark, str(tmp_path)).first().text == "one\ntwo"


def test_typed_and_untyped_scores(spark):
    schema = "id int, label string, start int, end int"
    gold = spark.createDataFrame([(1, "PER", 0, 3), (1, "PHONE", 4, 17), (1, "PHONE", 4, 17)], schema)
    pred = spark.createDataFrame([(1, "PHONE", 4, 17), (2, "PER", 0, 3)], schema)
    rows = {r.label: r for r in evaluate.typed_scores(gold, pred).collect()}
    assert (rows["micro"].tp, rows["micro"].fp, rows["micro"].fn) == (1, 1, 1)
    assert rows["PER"].recall == 0.0 and rows["PHONE"].f1 == 1.0 and rows["micro"].f1 == 0.5
    gold = spark.createDataFrame([(1, "given_name", 0, 3), (1, "mobile", 4, 17)], schema)
    pred = spark.createDataFrame([(1, "PER", 0, 3)], schema)
    assert {r.label: r.recall for r in evaluate.source_recall(gold, pred).collect()} == {"given_name": 1.0, "mobile": 0.0}
    row = evaluate.untyped_scores(gold, pred).first()
    assert (row.tp, row.fp, row.fn, row.precision, row.recall) == (1, 0, 1, 1.0, 0.5)
    none = evaluate.untyped_scores(gold.limit(0), pred.limit(0)).first()
    assert (none.precision, none.recall, none.f1, none.tp) == (0.0, 0.0, 0.0, 0)


def test_evaluation_report(spark):
    records = spark.createDataFrame([(1, "x@y.z 123-4567", [("EMAIL", 0, 5)]), (2, "none", [])], f"doc_id int, text string, spans {SPANS}")
    report, _ = evaluate.evaluate(RedactionEngine(RULES), records)
    assert report["examples"] == 2 and report["micro"]["tp"] == 1 and report["per_label"]["PHONE"]["fp"] == 1 and report["ner_enabled"] is False
    report, _ = evaluate.evaluate(RedactionEngine(RULES), records, "untyped")
    assert report["ground_truth_label_recall"] == {"EMAIL": 1.0}
    with pytest.raises(ValueError):
        evaluate.evaluate(RedactionEngine(RULES), records, "other")


def test_tagged_tokens(spark):
    labels = ["O", "B-PER", "I-PER", "E-PER", "S-PER"]
    rows = [("ab cd", [[0.0, 9.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 9.0, 0.0]], [(0, 2), (3, 5)])]
    df = spark.createDataFrame(rows, "text string, e array<array<double>>, o array<struct<s: int, e: int>>")
    for native in (True, False):
        assert RedactionEngine([], provider=TaggedTokens("e", "o", labels, native=native)).redact(df).first().redacted_text == "<PER>"


def test_training_columns(spark):
    df = spark.createDataFrame([(1, "ab cd", [("name", 0, 2), ("zip", 3, 5)], [(0, 0), (0, 2), (3, 5)])], f"b int, text string, spans {SPANS}, offsets array<struct<s: int, e: int>>")
    df = df.withColumn("spans", training.remap_labels(F.col("spans"), {"name": "PER"}))
    df = df.withColumn("ids", training.label_ids(F.col("spans"), F.col("offsets"), label_list(["PER"])))
    assert df.first().ids == [-100, 4, 0]
    both = df.select("b", "ids").union(spark.createDataFrame([(1, [1])], "b int, ids array<int>"))
    rows = {len([m for m in r.attention_mask if m]): r for r in training.padded(both, "b", {"ids": -100}).collect()}
    assert rows[1].ids == [1, -100, -100] and rows[1].attention_mask == [1, 0, 0] and rows[3].ids == [-100, 4, 0]
    logits = spark.createDataFrame([([0.0, 0.0], 0), ([9.0, 9.0], -100)], "l array<double>, t int")
    import math

    assert abs(training.focal_loss(logits, "l", "t").first()[0] - 0.25 * math.log(2)) < 1e-9
    assert training.focal_loss(logits.filter("t < 0"), "l", "t").first()[0] == 0.0


def test_token_classifier_learns(spark):
    rows = [(f"call {w} now", [("PER", 5, 5 + len(w))], [(0, 4), (5, 5 + len(w)), (6 + len(w), 9 + len(w))]) for w in ("Ann", "Bob", "Cat", "Dan") * 3]
    df = spark.createDataFrame(rows, f"text string, spans {SPANS}, offsets array<struct<s: int, e: int>>")
    trainer = training.TokenClassifier(label_list(["PER"]), epochs=10)
    scored = trainer.fit(df).transform(trainer.tokens(df))
    assert scored.filter("prediction = label").count() == scored.count()


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"mail a{'b' * i}@c.d") for i in range(20)], "id int, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    engine = RedactionEngine([RegexRule("EMAIL", r"[a-z]+@[a-z.]+")])
    stream = engine.redact(streaming.table_stream(spark, str(tmp_path), "in", 1)).select("id", "redacted_text")
    streaming.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, engine.redact(docs).select("id", "redacted_text").collect()))


def test_stream_of_lines_and_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("a@b.c\n\nx\n")
    lines = streaming.text_lines(spark, str(tmp_path / "in"))
    query = RedactionEngine(RULES).redact(lines).select("redacted_text").writeStream.format("memory").queryName("lines").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r[0] for r in spark.table("lines").collect()) == ["<EMAIL>", "x"]
    batch = spark.createDataFrame([("a@b.c",), ("d@e.f",)], "text string").withColumn("at", F.to_timestamp(F.lit("2024-01-01 00:01:00")))
    counts = streaming.windowed_label_counts(RedactionEngine(RULES).redact(batch), "at").collect()
    assert [(r.label, r.n) for r in counts] == [("EMAIL", 2)]


def test_sql_functions(spark):
    sqlapi.register(spark, RedactionEngine(RULES), "mask")
    spark.createDataFrame([(1, "a@b.c 123-4567"), (2, None)], "id int, text string").createOrReplaceTempView("mask_texts")
    rows = spark.sql("SELECT id, s.label, s.start, s.text FROM mask_texts, LATERAL mask_rows(text) s ORDER BY id, s.start").collect()
    assert [tuple(r) for r in rows] == [(1, "EMAIL", 0, "a@b.c"), (1, "PHONE", 6, "123-4567")]
    assert [len(r.s) if r.s is not None else None for r in spark.sql("SELECT mask_spans(text) AS s FROM mask_texts ORDER BY id").collect()] == [2, None]


def test_summary_by_label(spark):
    df = spark.createDataFrame([("a@b.c d@e.f",), ("g@h.i",), ("",)], "text string")
    assert [tuple(r) for r in summary_by_label(RedactionEngine(RULES).detected(df)).collect()] == [("EMAIL", 3, 2)]


def test_rendering(spark):
    result = render.as_dict(RedactionEngine(RULES).result(spark.createDataFrame([("é a@b.c",)], "text string")).first().result)
    assert render.highlight(result, color=False) == "é [a@b.c](EMAIL)"
    assert "\x1b[48;5;28m" in render.highlight(result)
    assert "é" in render.render_json(result) and json.loads(render.render_json(result))["summary"]["by_label"] == {"EMAIL": 1}
    assert "spans: 1" in render.render_human(result, color=False)


def test_command_line(spark, tmp_path, capsys):
    rules = tmp_path / "rules.yaml"
    rules.write_text("rules: [{label: EMAIL, pattern: '[a-z]+@[a-z.]+'}]\n")
    assert main(["redact", "--rules", str(rules), "--json", "mail a@b.c"]) == 0
    assert json.loads(capsys.readouterr().out)["redacted_text"] == "mail <EMAIL>"
    data = tmp_path / "d.jsonl"
    data.write_text('{"text": "a@b.c", "spans": [{"label": "EMAIL", "start": 0, "end": 5}]}\n')
    assert main(["eval", str(data), "--rules", str(rules)]) == 0
    assert json.loads(capsys.readouterr().out)["micro"]["f1"] == 1.0
    assert parse_operating_point("1,2,3,4,5,6") == [1, 2, 3, 4, 5, 6] and parse_operating_point("balanced") == "balanced"
    assert parser().parse_args(["redact", ""]).text == ""
