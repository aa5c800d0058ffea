"""Redaction from SQL: functions and a table function for a session."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from maskwright.functions import pytext, validators


def register(spark: SparkSession, engine, prefix: str = "redact") -> None:
    """Register ``<prefix>_spans(text)`` as a function and ``<prefix>_rows(text)`` as a
    table function for LATERAL joins: label, start, end, text.

    Both run in Python workers, the function in Arrow batches. DataFrame code should
    use the engine, whose expressions need no Python.
    """
    rules = list(engine.rules)

    def spans_of(text: str | None) -> list[dict]:
        compiled = [(re.compile(r.pattern), r) for r in rules]

        def check(name: str):
            own = pytext._python_check(name)
            return own or (lambda value: validators.safe_call(name, value))

        checks = {r.verify: check(r.verify) for r in rules if r.verify}
        return [] if text is None else pytext.python_spans(text, compiled, checks)

    @F.udf("array<struct<label: string, start: int, end: int>>", useArrow=True)
    def find(text: str):
        return None if text is None else [(s["label"], s["start"], s["end"]) for s in spans_of(text)]

    @F.udtf(returnType="label string, start int, end int, text string")
    class Rows:
        def eval(self, text: str):
            for s in spans_of(text):
                yield s["label"], s["start"], s["end"], text[s["start"] : s["end"]]

    spark.udf.register(f"{prefix}_spans", find)
    spark.udtf.register(f"{prefix}_rows", Rows)
