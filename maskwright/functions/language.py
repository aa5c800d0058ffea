"""Language routing by Unicode script, as SQL expressions.

Routing only ever picks an available language. Hangul means ko; kana means ja; Han
means ja beside kana and else Chinese, in the simplified or traditional form; then
Latin means en. Scripts outrank Latin, which occurs in every language's texts.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points of alphabetic characters by script, in hexadecimal ------
SCRIPTS = {
    "Hangul": (
        "1100-11FF 3131-318E A960-A97C AC00-D7A3 D7B0-D7C6 D7CB-D7FB FFA0-FFBE FFC2-FFC7 FFCA-FFCF FFD2-FFD7 FFDA-FFDC"
    ),
    "Hiragana": (
        "3041-3096 309D-309F 30FC FF70 1B001 1B11F 1B132 1B150-1B152"
    ),
    "Katakana": (
        "30A1-30FA 30FD-30FF 31F0-31FF FF66-FF6F FF71-FF9F 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B000 1B120-1B122 1B155 "
        "1B164-1B167"
    ),
    "Han": (
        "3400-4DBF 4E00-9FFF F900-FA6D FA70-FAD9 20000-2A6DF 2A700-2B739 2B740-2B81D 2B820-2CEA1 2CEB0-2EBE0 "
        "2EBF0-2EE5D 2F800-2FA1D 30000-3134A 31350-323AF"
    ),
    "Latin": (
        "41-5A 61-7A C0-D6 D8-F6 F8-2AF 1D00-1D25 1D62-1D65 1D6B-1D77 1D79-1D9A 1E00-1EFF 2071 207F 2090-209C 2184 2C2E "
        "2C5E 2C60-2C7C 2C7E-2C7F A722-A76F A771-A787 A78B-A7CA A7D0-A7D1 A7D3 A7D5-A7D9 A7F5-A7F7 A7FA-A7FF AB30-AB5A "
        "AB60-AB64 AB66-AB68 FB00-FB06 FF21-FF3A FF41-FF5A 1DF00-1DF1E 1DF25-1DF2A"
    ),
}
# Characters of only one Chinese form -------------------------------
SIMPLIFIED = (
    "们这国时还会个东车门长马问说见证过当后样经现边师应关习书实战报"
    "觉让认识语务写单价众节约级纪线练组细给继续维绿罗职专业达迁运"
    "电话来开学区湾体义医难头买卖红钱银铁极标楼龙岛县镇党团设计议"
    "讯询谁课读资际处备杂台湾湾们对发欢爱乐离开关闭历题点击网络营"
)
TRADITIONAL = (
    "們這國時還會個東車門長馬問說見證過當後樣經現邊師應關習書實戰報"
    "覺讓認識語務寫單價眾節約級紀線練組細給繼續維綠羅職專業達遷運"
    "電話來開學區灣體義醫難頭買賣紅錢銀鐵極標樓龍島縣鎮黨團設計議"
    "訊詢誰課讀資際處備雜臺灣彎們對發歡愛樂離開關閉歷題點擊網絡營"
)
#: Environment variable that names the language of texts without a signal.
FALLBACK_VARIABLE = "MASKWRIGHT_LANG"


def script_class(script: str) -> str:
    """A regex class of the script's characters, for Java and RE2."""
    ranges = [part.split("-") for part in SCRIPTS[script].split()]
    return "[" + "".join("-".join(f"\\x{{{x}}}" for x in r) for r in ranges) + "]"


#: No script but Latin has a character below it.
_ABOVE_LATIN = r"[\x{1100}-\x{10FFFF}]"


def script_count(text: Column, script: str) -> Column:
    return F.regexp_count(text, F.lit(script_class(script)))


def script_counts(text: Column) -> Column:
    """struct of the number of characters of each script."""
    return F.struct(*[script_count(text, s).alias(s) for s in SCRIPTS])


def form_counts(text: Column) -> Column:
    """struct<simplified, traditional>: characters that only one form has."""

    def count(characters: str) -> Column:
        return F.length(text) - F.length(F.translate(text, characters, ""))

    return F.struct(count(SIMPLIFIED).alias("simplified"), count(TRADITIONAL).alias("traditional"))


def chinese_form(text: Column, available: Sequence[str]) -> Column:
    """The available Chinese code for a Han text; null if there is none."""
    forms = [code for code in ("zh-Hans", "zh-Hant") if code in available]
    if len(forms) == 2:
        n = form_counts(text)
        return F.when(n["traditional"] > n["simplified"], "zh-Hant").otherwise("zh-Hans")
    return F.lit(forms[0] if forms else "zh" if "zh" in available else None).cast("string")


def detect_language(text: Column, available: Sequence[str], fallback: str | None = None) -> Column:
    """The best of ``available`` for each text; null if nothing tells.

    Texts without a signal get ``fallback`` (by default the environment variable's
    value on the driver) if available, or the only available language.
    """
    available = list(dict.fromkeys(available))
    fallback = fallback if fallback is not None else os.environ.get(FALLBACK_VARIABLE)
    other = fallback if fallback and fallback in available else available[0] if len(available) == 1 else None

    def chosen(n: Column) -> Column:
        kana = n["Hiragana"] + n["Katakana"]
        signals = (
            ("ko", F.lit("ko"), n["Hangul"]),
            ("ja", F.lit("ja"), kana),
            ("ja", F.lit("ja"), F.when(kana > 0, n["Han"]).otherwise(0)),
            ("zh", F.when(n["Han"] > 0, chinese_form(text, available)), F.when(kana > 0, 0).otherwise(n["Han"])),
        )
        # most characters first; the listed order breaks ties
        ranked = F.array(*[F.struct((-count).alias("rank"), F.lit(i).alias("ord"), code.alias("code")) for i, (_, code, count) in enumerate(signals)])
        fit = F.filter(F.array_sort(ranked), lambda s: (s["rank"] < 0) & s["code"].isin(*available)) if available else F.filter(ranked, lambda s: F.lit(False))
        return F.get(fit, F.lit(0))["code"]

    # most texts have no character of the other scripts, which one search tells
    scripts = F.struct(*[script_count(text, s).alias(s) for s in SCRIPTS if s != "Latin"])
    by_script = F.when(text.rlike(_ABOVE_LATIN), F.get(F.transform(F.array(scripts), chosen), F.lit(0)))
    latin = F.when(text.rlike(script_class("Latin")), "en") if "en" in available else F.lit(None).cast("string")
    return F.when(text.isNotNull(), F.coalesce(by_script, latin, F.lit(other).cast("string")))


def route(text: Column, available: Sequence[str], fallback: str | None = None) -> Column:
    """``detect_language``, or the alphabetically first language."""
    return routed(detect_language(text, available, fallback), available)


def routed(detected: Column, available: Sequence[str]) -> Column:
    """The detected language, or the alphabetically first one."""
    return F.coalesce(detected, F.lit(min(available)))
