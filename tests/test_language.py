import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from maskwright.functions import language

ALL, ZH = ["ko", "en", "ja", "zh"], ["zh-Hans", "zh-Hant", "en", "ko"]


@pytest.mark.parametrize(
    ("text", "available", "expected"),
    [
        ("박서준 고객 77-20", ALL, "ko"),
        ("Ada Lovelace 12 notes", ALL, "en"),
        ("佐藤さん は 元気", ALL, "ja"),
        ("学习时间", ALL, "zh"),
        ("学习时间", ["zh", "en"], "zh"),
        ("서울", ["en"], "en"),
        ("서울", ["en", "ja"], None),
        ("2024/05 ???", ["en", "ja"], None),
        ("서울 12 office@c.org", ["ko", "en"], "ko"),
        ("Oslo at 12 tomorrow", ["ko", "en"], "en"),
        ("Übermäßig größer", ["ko", "en"], "en"),
        ("", ["ko"], "ko"),
        ("   ", ["ko"], "ko"),
        ("... !!", ["ko"], "ko"),
        ("这里的学习时间还不够", ZH, "zh-Hans"),
        ("电话 12 个", ZH, "zh-Hans"),
        ("這裡的學習時間還不夠", ZH, "zh-Hant"),
        ("電話 12 個", ZH, "zh-Hant"),
        ("山水", ZH, "zh-Hans"),
        ("電話", ["zh-Hans", "en"], "zh-Hans"),
        ("电话", ["zh-Hant", "en"], "zh-Hant"),
        (None, ALL, None),
    ],
)
def test_detection(spark, text, available, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(language.detect_language(F.col("t"), available, "").alias("x")).first().x == expected


def test_fallback_variable(spark, monkeypatch):
    df = spark.createDataFrame([("12345",)], "t string")
    monkeypatch.setenv(language.FALLBACK_VARIABLE, "en")
    assert df.select(language.detect_language(F.col("t"), ["en", "ja"]).alias("x")).first().x == "en"
    monkeypatch.setenv(language.FALLBACK_VARIABLE, "xx")
    row = df.select(language.detect_language(F.col("t"), ["en", "ja"]).alias("x"), language.route(F.col("t"), ["ja", "en"]).alias("y")).first()
    assert (row.x, row.y) == (None, "en")


def test_script_counts_against_character_names(spark):
    rng = random.Random(0)
    pools = [range(0x20, 0x250), range(0x3040, 0x3130), range(0xAC00, 0xAD00), range(0x4E00, 0x4F00), range(0xFF00, 0xFFE0), range(0x1100, 0x1200)]
    texts = ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(40)) for _ in range(100)]

    def counts(text):
        n = dict.fromkeys(language.SCRIPTS, 0)
        for c in text:
            name = unicodedata.name(c, "") if c.isalpha() else ""
            key = next((k for k, word in (("Hangul", "HANGUL"), ("Hiragana", "HIRAGANA"), ("Katakana", "KATAKANA"), ("Han", "CJK"), ("Latin", "LATIN")) if word in name), None)
            if key:
                n[key] += 1
        return n

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for row in df.select("i", language.script_counts(F.col("t")).alias("n")).collect():
        assert row.n.asDict() == counts(texts[row.i])
