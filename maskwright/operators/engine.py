"""Redaction of a text column: regex rules, model spans, merging and rendering."""

from __future__ import annotations

import os
import threading
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import bioes, language, spans, validators
from maskwright.functions.pytext import regex_spans_arrow
from maskwright.operators.emissions import EmissionProvider
from maskwright.sources.packs import EntityConfig, LanguagePack, installed_languages, resolve_language
from maskwright.sources.rules import RegexRule, load_rules

SCHEMA_VERSION = 1
RULES_VARIABLE = "MASKWRIGHT_REGEX_RULES"
_REGEX, _NER, _MISMATCH, _MERGED, _DETECTED = ("_mw_regex", "_mw_ner", "_mw_mismatch", "_mw_merged", "_mw_detected")
OperatingPoint = str | Mapping[str, float] | Sequence[float] | None


@dataclass(frozen=True)
class RedactionEngine:
    """Immutable; ``transform`` and ``redact`` only build expressions on a DataFrame.

    ``backend``: "native" runs rules as SQL expressions, "arrow" in Python's regex
    engine; "auto" is native unless a rule's pattern or validator needs Python.
    """

    rules: Sequence[RegexRule] = ()
    config: EntityConfig = field(default_factory=EntityConfig)
    provider: EmissionProvider | None = None
    operating_point: OperatingPoint = None
    backend: str = "auto"

    @classmethod
    def from_pack(cls, lang: str | None = None, *, regex_only: bool = False, provider: EmissionProvider | None = None, operating_point: OperatingPoint = None, rules_path: str | None = None, backend: str = "auto") -> RedactionEngine:
        """The engine of a language pack. Rules come from ``rules_path``, the
        environment variable or the pack; the configuration of model spans is only
        read if there are any."""
        return cls.of_pack(resolve_language(lang), regex_only=regex_only, provider=provider, operating_point=operating_point, rules_path=rules_path, backend=backend)

    @classmethod
    def of_pack(cls, pack: LanguagePack, *, regex_only: bool = False, provider: EmissionProvider | None = None, operating_point: OperatingPoint = None, rules_path: str | None = None, backend: str = "auto") -> RedactionEngine:
        path = rules_path or os.environ.get(RULES_VARIABLE)
        rules = load_rules(path) if path else pack.rules()
        if regex_only or provider is None:
            return cls(rules, backend=backend, operating_point=operating_point)
        config = pack.config()
        if operating_point is None:
            operating_point = config.operating_point or "balanced"
        return cls(rules, config, provider, operating_point, backend)

    @classmethod
    def regex_only(cls, rules_path: str) -> RedactionEngine:
        return cls(load_rules(rules_path))

    @property
    def has_ner(self) -> bool:
        return self.provider is not None

    def regex_column(self, text: Column) -> Column:
        python = self.backend == "arrow" or (self.backend == "auto" and not all(r.native and not validators.is_custom(r.verify) for r in self.rules))
        return regex_spans_arrow(text, self.rules) if python else spans.regex_spans(text, self.rules)

    def biases(self, operating_point: OperatingPoint = None) -> list[float]:
        """The provider's biases plus the operating point's."""
        point = bioes.resolve_operating_point(self.operating_point if operating_point is None else operating_point)
        return [a + b for a, b in zip(self.provider.default_biases, point, strict=True)]

    def merged(self, df: DataFrame, text_col: str = "text", operating_point: OperatingPoint = None) -> DataFrame:
        """``df`` with merged spans (_mw_merged) and the mismatch flag (_mw_mismatch)."""
        text = F.col(text_col)
        df = df.withColumn(_REGEX, self.regex_column(text))
        if self.provider is None:
            return df.withColumns({_MERGED: F.col(_REGEX), _MISMATCH: F.lit(False)}).drop(_REGEX)
        df = self.provider.add_spans(df, text, self.biases(operating_point), _NER, _MISMATCH)
        ner = spans.filter_stopwords(F.col(_NER), text, sorted(self.config.stopwords))
        df = df.withColumn(_NER, spans.trim_trailing(ner, text, self.config.span_trims))
        regex = spans.apply_ner_precedence(F.col(_REGEX), F.col(_NER), self.config.ner_precedence)
        return spans.merge_union(df, regex, F.col(_NER), _MERGED).drop(_REGEX, _NER)

    def detected(self, df: DataFrame, text_col: str = "text", entity_types: Iterable[str] | None = None, output_mode: str = "typed", operating_point: OperatingPoint = None, out: str = "detected_spans") -> DataFrame:
        """``df`` with an array of detected spans and ``decoded_mismatch``."""
        kinds = None if entity_types is None else list(entity_types)
        df = self.merged(df, text_col, operating_point)
        return df.withColumns({out: spans.assemble(F.col(text_col), F.col(_MERGED), output_mode, kinds), "decoded_mismatch": F.col(_MISMATCH)}).drop(_MERGED, _MISMATCH)

    def redact(self, df: DataFrame, text_col: str = "text", entity_types: Iterable[str] | None = None, output_mode: str = "typed", operating_point: OperatingPoint = None) -> DataFrame:
        """``df`` with detected_spans, redacted_text, span_count and decoded_mismatch."""
        df = self.detected(df, text_col, entity_types, output_mode, operating_point)
        return df.withColumns({"redacted_text": spans.redacted_text(F.col(text_col), F.col("detected_spans")), "span_count": F.size("detected_spans")})

    def result(self, df: DataFrame, text_col: str = "text", entity_types: Iterable[str] | None = None, output_mode: str = "typed", operating_point: OperatingPoint = None, out: str = "result") -> DataFrame:
        """``df`` with one struct: schema_version, summary, text, detected_spans,
        redacted_text."""
        df = self.redact(df, text_col, entity_types, output_mode, operating_point)
        whole = F.struct(
            F.lit(SCHEMA_VERSION).alias("schema_version"),
            spans.summary(F.col("detected_spans"), F.lit(output_mode), F.col("decoded_mismatch")).alias("summary"),
            F.col(text_col).alias("text"),
            F.col("detected_spans"),
            F.col("redacted_text"),
        )
        return df.withColumn(out, whole).drop("detected_spans", "redacted_text", "span_count", "decoded_mismatch")


def summary_by_label(detected: DataFrame, spans_col: str = "detected_spans") -> DataFrame:
    """(label, n_spans, n_rows) over a table; aggregated before the shuffle."""
    per_row = detected.select(F.explode_outer(spans.label_counts(F.col(spans_col))).alias("x")).filter("x is not null")
    return per_row.groupBy("x.label").agg(F.sum("x.n").alias("n_spans"), F.count(F.lit(1)).alias("n_rows"))


class AutoEngine:
    """Routes each row to its language's engine; engines are built once each."""

    def __init__(self, build: Callable[[str], RedactionEngine] | None = None, languages: Sequence[str] | None = None, fallback: str | None = None, **options):
        self._languages = sorted(languages if languages is not None else installed_languages())
        if not self._languages:
            raise ValueError("no language pack is installed or registered")
        self._build = build or (lambda code: RedactionEngine.from_pack(code, **options))
        self._regex_only = options.get("regex_only", False)
        self._fallback, self._engines, self._lock = fallback, {}, threading.Lock()

    @property
    def available_languages(self) -> list[str]:
        return list(self._languages)

    @property
    def has_ner(self) -> bool:
        return not self._regex_only

    def engine_for(self, code: str) -> RedactionEngine:
        if code not in self._engines:
            with self._lock:
                if code not in self._engines:
                    self._engines[code] = self._build(code)
        return self._engines[code]

    def preload(self, codes: Iterable[str] | None = None) -> AutoEngine:
        for code in self._languages if codes is None else codes:
            self.engine_for(code)
        return self

    def route(self, text: Column) -> Column:
        return language.route(text, self._languages, self._fallback)

    def redact(self, df: DataFrame, text_col: str = "text", entity_types: Iterable[str] | None = None, output_mode: str = "typed", operating_point: OperatingPoint = None) -> DataFrame:
        """``RedactionEngine.redact`` by each row's language, with a language column.

        Rules alone are one projection of CASE expressions; a model's rows are
        filtered by language first, as no plan pushes filters through Python.
        """
        df = df.withColumn("language", self.route(F.col(text_col)))
        engines = {code: self.engine_for(code) for code in self._languages}
        if not any(e.has_ner for e in engines.values()):
            merged = None
            for code, engine in engines.items():
                own = engine.regex_column(F.col(text_col))
                merged = F.when(F.col("language") == code, own) if merged is None else merged.when(F.col("language") == code, own)
            kinds = None if entity_types is None else list(entity_types)
            df = df.withColumn(_MERGED, merged)
            df = df.withColumns({"detected_spans": spans.assemble(F.col(text_col), F.col(_MERGED), output_mode, kinds), "decoded_mismatch": F.lit(False)}).drop(_MERGED)
            return df.withColumns({"redacted_text": spans.redacted_text(F.col(text_col), F.col("detected_spans")), "span_count": F.size("detected_spans")})
        parts = [engine.redact(df.filter(F.col("language") == code), text_col, entity_types, output_mode, operating_point) for code, engine in engines.items()]
        return reduce(DataFrame.unionByName, parts)
