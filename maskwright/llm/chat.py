r"""Chat formatting with loss masks aligned by token offsets.

A conversation is rendered whole: each turn is ``### Role: text </turn>`` with a line
end. Inside roles and texts a backslash becomes ``\\``, ``#`` becomes ``\h`` and ``<``
becomes ``\l``, so no control string of the template can occur in them, and parsing
reads back every text exactly. The rendered text is encoded once, with offsets; the
sorted spans of the assistant's texts are then intersected with the sorted token
spans by binary search. A token that reaches over a span's edge counts with the part
inside, so the mask covers each assistant text exactly.

Turns are ordered by turn, then role and text. Null texts and roles are empty. Rows of
the same turn all stay. A conversation is one row of the result, so its rows meet in
one task; nothing else of a conversation does. Other columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", " </turn>\n"
ESCAPES = (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"))
_UNESCAPED = {"\\": "\\", "h": "#", "l": "<", "c": ":"}
ASSISTANT = "assistant"
TOKENIZER = "byte_bpe_50k.json"
#: Conversations taken from a batch, and characters encoded, at a time.
_ROWS, _TOGETHER = 64, 1 << 20


def escape(text: str) -> str:
    for plain, escaped in ESCAPES:
        text = text.replace(plain, escaped)
    return text


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    parts = text.split("\\")
    out, i = [parts[0]], 1
    while i < len(parts):
        if parts[i] == "":
            # an escaped backslash: the next part follows it as it is
            out.append("\\" + (parts[i + 1] if i + 1 < len(parts) else ""))
            i += 2
        else:
            out.append(_UNESCAPED[parts[i][0]] + parts[i][1:])
            i += 1
    return "".join(out)


def _role(role: str) -> str:
    return escape(role).replace(":", "\\c")


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + _role(role) + AFTER_ROLE, escape(text)
        if role == ASSISTANT:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(CLOSE)[:-1]:
        role, _, text = part.removeprefix(OPEN).partition(AFTER_ROLE)
        turns.append((unescape(role), unescape(text)))
    return turns


def intersect(spans: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens meet which span, and the character ranges they share.

    Both are sorted [n, 2] arrays; a token's start and end never decrease. Returns
    (token numbers, [m, 3] of span, start and end).
    """
    if not len(spans) or not len(tokens):
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    first = np.searchsorted(tokens[:, 1], spans[:, 0], side="right")
    last = np.maximum(np.searchsorted(tokens[:, 0], spans[:, 1], side="left"), first)
    n = last - first
    which = np.repeat(np.arange(len(spans)), n)
    own = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    start, end = np.maximum(tokens[own, 0], spans[which, 0]), np.minimum(tokens[own, 1], spans[which, 1])
    some = end > start
    return own[some], np.stack([which, start, end], axis=1)[some]


@cache
def _tokenizer(name: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tokenizer = Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


def masked(rendered: list[tuple[str, list[tuple[int, int]]]], tokenizer: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, the loss mask of each token, and the shared character ranges of each text."""
    for (_, spans), encoded in zip(rendered, _tokenizer(tokenizer).encode_batch([x for x, _ in rendered], add_special_tokens=False), strict=True):
        tokens = np.fromiter(chain.from_iterable(encoded.offsets), np.int64, 2 * len(encoded)).reshape(-1, 2)
        hit, ranges = intersect(np.array(spans, np.int64).reshape(-1, 2), tokens)
        mask = np.zeros(len(tokens), bool)
        mask[hit] = True
        yield np.array(encoded.ids, np.int32), mask, ranges


def covered(formatted: str, ranges: np.ndarray) -> list[str]:
    """The text under the mask, a string for each span, each character once.

    Tokens that share a character, as parts of one that needs several bytes, overlap;
    ranges that touch or overlap are read as one.
    """
    span, start, end = ranges.T
    reach = np.maximum.accumulate(end)
    opens = np.flatnonzero((np.diff(span, prepend=-1) != 0) | (start > np.append(0, reach)[:-1]))
    texts: dict[int, str] = {}
    for own, a, b in zip(span[opens].tolist(), start[opens].tolist(), reach[np.append(opens, len(span))[1:] - 1].tolist(), strict=True):
        texts[own] = texts.get(own, "") + formatted[a:b]
    return list(texts.values())


Made = tuple[str, np.ndarray, np.ndarray, np.ndarray]


def _made(batch: pa.RecordBatch, tokenizer: str) -> Iterator[tuple[pa.Array, list[Made]]]:
    """Conversation ids, and what is made of them, about ``_TOGETHER`` characters at a time."""
    for first in range(0, len(batch), _ROWS):
        part = batch.slice(first, _ROWS)
        rendered = [render([(t["role"], t["text"]) for t in turns]) for turns in part.column(1).to_pylist()]
        sizes = np.cumsum([len(x) for x, _ in rendered]) // _TOGETHER
        edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(rendered)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield part.column(0).slice(a, b - a), [(x, *rest) for (x, _), rest in zip(rendered[a:b], masked(rendered[a:b], tokenizer), strict=True)]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list of each array's elements, or rows."""
    offsets = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
    whole = np.concatenate(parts)
    values = pa.array(whole.reshape(-1), kind)
    if whole.ndim == 2:
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1) * whole.shape[1], pa.int32()), values)
    return pa.ListArray.from_arrays(offsets, values)


_FORMATTED = "conv_id {}, formatted string, ids array<int>, mask array<boolean>, ranges array<array<int>>"


def _formatter(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for convs, made in _made(batch, tokenizer):
                formatted, ids, mask, ranges = map(list, zip(*made, strict=True))
                columns = [convs, pa.array(formatted, pa.string()), _lists(ids, pa.int32()), _lists(mask, pa.bool_()), _lists(ranges, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "formatted", "ids", "mask", "ranges"])

    return run


def _turns(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))


def format_conversations(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """conv_id, formatted, ids, mask (loss, by token) and ranges of each conversation.

    A range is (assistant span, start, end) in characters of formatted. ``tokenizer`` is
    an absolute path that all machines have, or a name that each looks up.
    """
    return _turns(turns).mapInArrow(_formatter(tokenizer), _FORMATTED.format(turns.schema["conv_id"].dataType.simpleString()))


def _read_back(formatted: str, ids: np.ndarray, mask: np.ndarray, ranges: np.ndarray) -> tuple:
    turns = parse(formatted)
    said = "".join(f"{role}\n{text}\n" for role, text in turns)
    under = "".join(map(unescape, covered(formatted, ranges)))
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(formatted), len(ids), int(mask.sum())


_DIGEST = "conv_id {}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, loss_tokens bigint"


def _digester(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            for convs, made in _made(batch, tokenizer):
                rows = list(zip(*[_read_back(*x) for x in made], strict=True))
                columns = [pa.array(c, t) for c, t in zip(rows, types, strict=True)]
                yield pa.RecordBatch.from_arrays([convs, *columns], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"])

    return run


def digest(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """What the formatted conversations hold, read back from them in the task that makes
    them, so that ids and masks need not pass through the JVM."""
    return _turns(turns).mapInArrow(_digester(tokenizer), _DIGEST.format(turns.schema["conv_id"].dataType.simpleString()))
