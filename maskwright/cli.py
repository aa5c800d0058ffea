"""Command line: redact, eval and train over the DataFrame operations."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from maskwright.functions.bioes import OPERATING_POINTS
from maskwright.functions.render import as_dict, render_human, render_json, supports_color
from maskwright.operators.emissions import OnnxBundle
from maskwright.operators.engine import AutoEngine, RedactionEngine
from maskwright.operators.evaluate import evaluate
from maskwright.operators.training import TokenClassifier, remap_labels
from maskwright.sources.packs import installed_languages, load_label_space, resolve_weights
from maskwright.sources.text import eval_records

PROVIDERS = {"cpu": ("CPUExecutionProvider",), "cuda": ("CUDAExecutionProvider", "CPUExecutionProvider"), "coreml": ("CoreMLExecutionProvider", "CPUExecutionProvider")}


def parse_operating_point(value: str | None):
    """A preset's name, or six numbers with commas."""
    return [float(x) for x in value.split(",")] if value and "," in value else value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="maskwright", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    redact = commands.add_parser("redact", help="mask personal data in a text")
    redact.add_argument("text", nargs="?")
    redact.add_argument("-f", "--file")
    redact.add_argument("--output-mode", choices=("typed", "redacted"), default="typed")
    redact.add_argument("--entity-types", default="", help="labels with commas; all by default")
    redact.add_argument("--json", action="store_true")
    score = commands.add_parser("eval", help="score an engine on a JSON-lines file")
    score.add_argument("dataset")
    score.add_argument("--eval-mode", choices=("typed", "untyped"), default="typed")
    score.add_argument("--limit", type=int)
    for command in (redact, score):
        command.add_argument("--lang")
        command.add_argument("--rules", help="a rules file in place of a pack's")
        command.add_argument("--model", help="a folder with a model bundle")
        command.add_argument("--device", choices=tuple(PROVIDERS), default="cpu")
        command.add_argument("--operating-point", help=f"{', '.join(OPERATING_POINTS)} or six numbers")
        command.add_argument("--regex-only", action="store_true")
    train = commands.add_parser("train", help="train a token classifier on a JSON-lines file with offsets")
    train.add_argument("dataset")
    train.add_argument("--label-space-json")
    train.add_argument("--output-dir", required=True)
    train.add_argument("--epochs", type=int, default=3)
    return top


def _engine(args):
    provider = None
    if args.model and not args.regex_only:
        provider = OnnxBundle(str(resolve_weights(args.model)), PROVIDERS[args.device])
    options = {"regex_only": args.regex_only, "provider": provider, "operating_point": parse_operating_point(args.operating_point), "rules_path": args.rules}
    if args.rules and args.lang is None and not installed_languages():
        return RedactionEngine.regex_only(args.rules)
    if args.lang is None and len(installed_languages()) > 1:
        return AutoEngine(**options)
    return RedactionEngine.from_pack(args.lang, **options)


def _show(spark: SparkSession, engine, text: str, args, as_json: bool) -> None:
    kinds = args.entity_types.split(",") if args.entity_types else None
    df = spark.createDataFrame([(text,)], "text string")
    if isinstance(engine, AutoEngine):
        code = df.select(engine.route(df["text"]).alias("code")).first()["code"]
        engine = engine.engine_for(code)
    result = as_dict(engine.result(df, entity_types=kinds, output_mode=args.output_mode).first()["result"])
    print(render_json(result) if as_json else render_human(result, supports_color()))


def _input(args) -> str | None:
    if args.text is not None:
        return args.text
    if args.file:
        return Path(args.file).read_text(encoding="utf-8").rstrip("\n")
    if sys.stdin.isatty():
        return None
    return sys.stdin.read().rstrip("\n") or None


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("maskwright").getOrCreate()
    if args.command == "redact":
        engine, text, as_json = _engine(args), _input(args), args.json or not supports_color()
        for line in [text] if text is not None else filter(None, (x.rstrip("\n") for x in sys.stdin)):
            _show(spark, engine, line, args, as_json)
        return 0
    if args.command == "eval":
        report, _ = evaluate(_engine(args), eval_records(spark, args.dataset, args.limit), args.eval_mode, args.dataset)
        print(json.dumps(report, ensure_ascii=False, indent=2))
        return 0
    space = load_label_space(args.label_space_json)
    schema = "text string, spans array<struct<label: string, start: int, end: int>>, offsets array<struct<s: int, e: int>>"
    records = spark.read.schema(schema).json(args.dataset)
    records = records.withColumn("spans", remap_labels(records["spans"], space.label_map))
    model = TokenClassifier(space.labels, epochs=args.epochs).fit(records)
    model.write().overwrite().save(f"{args.output_dir}/model")
    spark.createDataFrame([(list(space.labels), dict(space.label_map), records.count())], "labels array<string>, label_map map<string, string>, examples bigint").write.mode("overwrite").json(f"{args.output_dir}/summary")
    return 0
