"""Terminal and JSON forms of one result."""

from __future__ import annotations

import json
import sys

# Background colours by label -----------------------------------------
COLOURS = {"PER": 31, "PHONE": 130, "ID_NUM": 90, "EMAIL": 28, "LOC": 24, "BANK": 94, "DATE": 55, "SECRET": 124}
OTHER_COLOUR = 240
RESET, DIM, BOLD = "\x1b[0m", "\x1b[2m", "\x1b[1m"


def supports_color(stream=None) -> bool:
    stream = stream or sys.stdout
    return bool(getattr(stream, "isatty", lambda: False)())


def as_dict(result) -> dict:
    """A result row as plain values in the order of its fields."""
    return result.asDict(recursive=True)


def highlight(result: dict, color: bool = True) -> str:
    text, parts, at = result["text"], [], 0
    for s in sorted(result["detected_spans"], key=lambda x: x["start"]):
        own, label = text[s["start"] : s["end"]], s["label"]
        mark = f"\x1b[48;5;{COLOURS.get(label, OTHER_COLOUR)}m{own}{RESET}{DIM}[{label}]{RESET}" if color else f"[{own}]({label})"
        parts += [text[at : s["start"]], mark]
        at = s["end"]
    return "".join([*parts, text[at:]])


def render_json(result: dict) -> str:
    return json.dumps(result, ensure_ascii=False, indent=2)


def render_human(result: dict, color: bool = True) -> str:
    bold, dim, reset = (BOLD, DIM, RESET) if color else ("", "", "")
    n = result["summary"]
    lost = "  (decode mismatch)" if n["decoded_mismatch"] else ""
    return f"{highlight(result, color)}\n\n{bold}redacted:{reset} {result['redacted_text']}\n{dim}spans: {n['span_count']}  by_label: {dict(sorted(n['by_label'].items()))}{lost}{reset}"
