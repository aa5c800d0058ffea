"""Regex rules from YAML, and their translation from Python's to Java's dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

import yaml


def to_java(pattern: str) -> str:
    r"""The pattern as Java reads it, with Unicode classes as Python has them.

    Named groups and back-references, \Z, and characters that only Java treats as
    special inside classes are rewritten.
    """
    out, i, in_class, first = ["(?U)"], 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(r"\z" if pattern[i + 1] == "Z" and not in_class else pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            if c == "]" and i > first:
                in_class = False
            elif c == "[" or (c == "&" and pattern[i : i + 2] == "&&"):
                c = "\\" + c
            elif c == "]":
                c = r"\]"
        elif c == "[":
            in_class = True
            first = i + (2 if pattern[i + 1 : i + 2] == "^" else 1)
            out.append(pattern[i:first])
            i = first
            continue
        elif pattern.startswith("(?P<", i):
            end = pattern.index(">", i)
            out.append("(?<" + pattern[i + 4 : end].replace("_", "0") + ">")
            i = end + 1
            continue
        elif pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(r"\k<" + pattern[i + 4 : end].replace("_", "0") + ">")
            i = end + 1
            continue
        out.append(c)
        i += 1
    return "".join(out)


@dataclass(frozen=True)
class RegexRule:
    """One rule. Rules keep the order of their file, which breaks ties."""

    label: str
    pattern: str
    priority: int = 0
    verify: str | None = None
    rule_id: str = ""

    def __post_init__(self):
        re.compile(self.pattern)

    @property
    def java(self) -> str:
        return to_java(self.pattern)

    @property
    def native(self) -> bool:
        """Whether Java can run it: no conditionals, and no match of the empty string."""
        return re.search(r"\(\?\(", self.pattern) is None and not may_be_empty(self.pattern)


def may_be_empty(pattern: str) -> bool:
    """Whether a pattern can match no characters at all."""
    from re import _parser

    return _parser.parse(pattern).getwidth()[0] == 0


def parse_rules(data: dict | None) -> list[RegexRule]:
    """Rules of a mapping with ``rules``; label and pattern are required."""
    return [RegexRule(r["label"], r["pattern"], int(r.get("priority", 0)), r.get("verify"), r.get("id", "")) for r in (data or {}).get("rules", [])]


def load_rules(path: str | Path) -> list[RegexRule]:
    return parse_rules(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
