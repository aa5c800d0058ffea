import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import chat

NASTY = st.text("\\#<>/hlc:tun r\n#A ssistant: </turn>é😀", max_size=40)


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, extra int")
    found = {r.conv_id: r for r in chat.digest(df).collect()}
    groups = {}
    for conv, turn, role, text, _ in rows:
        groups.setdefault(conv, []).append((turn, role or "", text or ""))
    assert set(found) == set(groups)
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        under = "".join(text for _, role, text in turns if role == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(under), hashlib.sha256(under.encode()).hexdigest())


def test_conversations(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [
        (-7, 0, "user", said, 1),
        (-7, 1, "assistant", said, 1),
        (1, 1, "assistant", None, 1),
        (1, 0, None, "é😀 한글", 1),
        (2, 0, "assistant", "", 1),
        (3, 0, "assistant", " lead and trail \n", 1),
        (3, 0, "assistant", " lead and trail \n", 1),
        (3, 1, "odd: role#", "<|endoftext|>", 1),
        (4, 0, "assistant", "<|endoftext|> 😀😀 " * 4000, 1),
    ]
    check(spark, rows)
    check(spark, [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a: #b"]), NASTY), max_size=5))
def test_rendering_is_reversible(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [text for role, text in turns if role == "assistant"]
    body = "".join(chat.escape(text) for _, text in turns)
    assert "### " not in body and "</turn>" not in body
    assert formatted.count(chat.CLOSE) == len(turns) and formatted.count("### ") == len(turns)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), NASTY), max_size=4))
def test_masks_cover_assistant_texts(turns):
    formatted, spans = chat.render(turns)
    ((ids, mask, ranges),) = chat.masked([(formatted, spans)], chat.TOKENIZER)
    assert len(ids) == len(mask)
    assert chat.covered(formatted, ranges) == [formatted[a:b] for a, b in spans if b > a]


def test_intersection_by_binary_search():
    tokens = np.array([[0, 3], [3, 5], [5, 5], [5, 9], [9, 12]])
    hit, ranges = chat.intersect(np.array([[2, 5], [5, 6], [12, 12]]), tokens)
    assert hit.tolist() == [0, 1, 3] and ranges.tolist() == [[0, 2, 3], [0, 3, 5], [1, 5, 6]]


def test_token_masks(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "hello there")], "conv_id bigint, turn bigint, role string, text string")
    r = chat.format_conversations(df).first()
    assert r.formatted == "### user: hi </turn>\n### assistant: hello there </turn>\n"
    assert len(r.ids) == len(r.mask) and 0 < sum(r.mask) < 5


def test_texts_under_ranges_that_overlap_touch_or_part():
    ranges = np.array([[0, 1, 3], [0, 1, 3], [0, 3, 4], [1, 6, 8], [1, 7, 9], [1, 10, 11]])
    assert chat.covered("0123456789ab", ranges) == ["123", "678a"]
    assert chat.covered("abc", np.zeros((0, 3), np.int64)) == []


def test_formatted_conversations_equal_digests(spark):
    """The general output, decoded by its own ranges, gives what the digest gives."""
    rows = [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c} <é😀>" * (c % 5), 7) for c in range(150) for t in range(c % 4 + 1)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, ids int")
    digests = {r.conv_id: r for r in chat.digest(df).collect()}
    made = chat.format_conversations(df).collect()
    assert len(made) == len(digests) == 150
    for r in made:
        d = digests[r.conv_id]
        under = "".join(map(chat.unescape, chat.covered(r.formatted, np.array(r.ranges, np.int64).reshape(-1, 3))))
        assert (d.n_turns, d.n_tokens, d.loss_tokens, d.loss_chars) == (len(chat.parse(r.formatted)), len(r.ids), sum(r.mask), len(under))
        assert d.loss_sha256 == hashlib.sha256(under.encode()).hexdigest()
