"""Stage 2 providers: where the model spans of a text come from.

A provider adds two columns to a DataFrame: model spans and whether the tokenizer's
round trip lost something. ``TaggedTokens`` decodes emissions that a column already
holds; ``OnnxBundle`` runs a local ONNX token classifier in Arrow batches, one session
per Python worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import bioes
from maskwright.functions.pytext import normal_form
from maskwright.functions.spans import SPANS, coalesce_adjacent


class EmissionProvider(Protocol):
    default_biases: Sequence[float]

    def add_spans(self, df: DataFrame, text: Column, biases: Sequence[float], spans: str, mismatch: str) -> DataFrame: ...


@dataclass(frozen=True)
class GivenSpans:
    """Model spans that a column already holds."""

    column: str
    default_biases: Sequence[float] = (0.0,) * 6

    def add_spans(self, df: DataFrame, text: Column, biases: Sequence[float], spans: str, mismatch: str) -> DataFrame:
        return df.withColumns({spans: F.col(self.column).cast(SPANS), mismatch: F.lit(False)})


@dataclass(frozen=True)
class TaggedTokens:
    """Emissions (array<array<double>>) and offsets (array<struct<s, e>>) in columns."""

    emissions: str
    offsets: str
    labels: Sequence[str]
    default_biases: Sequence[float] = (0.0,) * 6
    native: bool = False

    def add_spans(self, df: DataFrame, text: Column, biases: Sequence[float], spans: str, mismatch: str) -> DataFrame:
        decoder = bioes.viterbi_tags_native if self.native else bioes.viterbi_tags
        df = df.withColumn("_mw_tags", decoder(F.col(self.emissions), self.labels, biases))
        found = coalesce_adjacent(bioes.decode(F.col("_mw_tags"), F.col(self.offsets)))
        return df.withColumns({spans: found, mismatch: F.lit(False)}).drop("_mw_tags")


_sessions: dict = {}


@dataclass(frozen=True)
class OnnxBundle:
    """A folder with ``bundle.json`` (labels, transition_biases, max_length, onnx_file,
    tokenizer_file), an ONNX graph and a tokenizer file. Texts are cut at max_length
    tokens, as the classifier needs; the regex stage sees them whole."""

    folder: str
    providers: tuple[str, ...] = ("CPUExecutionProvider",)
    batch: int = 16

    @property
    def meta(self) -> dict:
        return json.loads((Path(self.folder) / "bundle.json").read_text(encoding="utf-8"))

    @property
    def default_biases(self) -> Sequence[float]:
        return self.meta["transition_biases"]

    @staticmethod
    def available_providers() -> list[str]:
        import onnxruntime

        return list(onnxruntime.get_available_providers())

    def _session(self):
        if self.folder not in _sessions:
            import onnxruntime
            from tokenizers import Tokenizer

            meta = self.meta
            tokenizer = Tokenizer.from_file(str(Path(self.folder) / meta["tokenizer_file"]))
            tokenizer.enable_truncation(int(meta.get("max_length", 256)))
            _sessions[self.folder] = meta, tokenizer, onnxruntime.InferenceSession(str(Path(self.folder) / meta["onnx_file"]), providers=list(self.providers))
        return _sessions[self.folder]

    def _predict(self, texts: list[str], biases: Sequence[float]) -> list[tuple]:
        """(tags, offsets, mismatch) of each text, padded to the batch's longest."""
        meta, tokenizer, session = self._session()
        encoded = tokenizer.encode_batch(texts)
        longest = max(1, *(len(e.ids) for e in encoded))
        ids = np.zeros((len(texts), longest), np.int64)
        mask = np.zeros_like(ids)
        for row, e in enumerate(encoded):
            ids[row, : len(e.ids)], mask[row, : len(e.ids)] = e.ids, 1
        emissions = session.run(None, {"input_ids": ids, "attention_mask": mask})[0]
        matrix = bioes.transition_matrix(meta["labels"], biases)
        found = []
        for text, e, scores in zip(texts, encoded, emissions, strict=True):
            tags = [meta["labels"][i] for i in bioes.viterbi(scores[: len(e.ids)], matrix)]
            found.append((tags, [{"s": s, "e": t} for s, t in e.offsets], normal_form(tokenizer.decode(e.ids)) != normal_form(text)))
        return found

    def add_spans(self, df: DataFrame, text: Column, biases: Sequence[float], spans: str, mismatch: str) -> DataFrame:
        @F.pandas_udf("struct<tags: array<string>, offsets: array<struct<s: int, e: int>>, mismatch: boolean>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for first in range(0, len(batch), self.batch):
                    part = batch.iloc[first : first + self.batch]
                    rows += self._predict([t or "" for t in part], biases)
                yield pd.DataFrame(rows, columns=["tags", "offsets", "mismatch"])

        df = df.withColumn("_mw_model", run(text))
        found = coalesce_adjacent(bioes.decode(F.col("_mw_model.tags"), F.col("_mw_model.offsets")))
        return df.withColumns({spans: found, mismatch: F.col("_mw_model.mismatch")}).drop("_mw_model")
