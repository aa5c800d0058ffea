import json

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from maskwright.functions import bioes
from maskwright.operators import emissions

LABELS = ["O", "B-NAME", "I-NAME", "E-NAME", "S-NAME"]
WORDS = {"[UNK]": 0, "meet": 1, "ada": 2, "lovelace": 3, "at": 4, "noon": 5}


class Session:
    """Scores that follow from the ids alone: ada begins a name and lovelace ends it."""

    def __init__(self):
        self.shapes = []

    def run(self, outputs, inputs):
        ids, mask = inputs["input_ids"], inputs["attention_mask"]
        self.shapes.append(ids.shape)
        assert ids.dtype == mask.dtype == np.int64 and ids.shape == mask.shape
        scores = np.full((*ids.shape, len(LABELS)), -5.0)
        best = {WORDS["ada"]: 1, WORDS["lovelace"]: 3}
        for row, place in np.ndindex(ids.shape):
            scores[row, place, best.get(int(ids[row, place]), 0)] = 5.0
        return [scores]


@pytest.fixture
def bundle(tmp_path):
    tokenizer = Tokenizer(models.WordLevel(WORDS, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    meta = {"labels": LABELS, "transition_biases": [0.0] * 6, "max_length": 4, "onnx_file": "model.onnx", "tokenizer_file": "tokenizer.json"}
    (tmp_path / "bundle.json").write_text(json.dumps(meta), encoding="utf-8")
    tokenizer.enable_truncation(meta["max_length"])
    found = emissions.OnnxBundle(str(tmp_path))
    emissions._sessions[found.folder] = meta, tokenizer, Session()
    yield found
    del emissions._sessions[found.folder]


def test_predictions_of_a_batch(bundle):
    assert list(bundle.default_biases) == [0.0] * 6
    first, second, third = bundle._predict(["meet ada lovelace", "noon", ""], bundle.default_biases)
    assert first == (["O", "B-NAME", "E-NAME"], [{"s": 0, "e": 4}, {"s": 5, "e": 8}, {"s": 9, "e": 17}], False)
    # shorter texts are padded, and what is padded is not decoded
    assert second[0] == ["O"] and third == ([], [], False)
    assert emissions._sessions[bundle.folder][2].shapes == [(3, 3)]


def test_long_texts_are_cut_and_unknown_words_are_a_mismatch(bundle):
    ((tags, offsets, mismatch),) = bundle._predict(["meet ada lovelace at noon"], bundle.default_biases)
    assert len(tags) == len(offsets) == 4 and mismatch is True
    ((tags, _, mismatch),) = bundle._predict(["meet grace"], bundle.default_biases)
    assert tags == ["O", "O"] and mismatch is True


def test_biases_change_the_path(bundle):
    """Biases against opening a span outweigh the scores."""
    biases = dict.fromkeys(bioes.CATEGORIES, 0.0) | {"begin": -50.0, "single": -50.0}
    ((tags, _, _),) = bundle._predict(["meet ada lovelace"], [biases[c] for c in bioes.CATEGORIES])
    assert not any(t.startswith(("B-", "S-")) for t in tags[1:])
