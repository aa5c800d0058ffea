"""Validators of regex matches, by name; a match whose validator is false is dropped.

Built-in ones are SQL expressions. Custom ones are Python functions that run in an
Arrow-batched UDF. An unknown name, or a validator that fails, keeps the match: in
redaction too much is safer than too little.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_log = logging.getLogger(__name__)
_native: dict[str, Callable[[Column], Column]] = {}
_custom: dict[str, Callable[[str], bool]] = {}

#: Weights of the twelve leading digits of a Korean resident registration number.
RRN_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Mod-10 check; separators are ignored, a value without digits fails."""
    own = digits(value)
    return (F.length(own) > 0) & F.call_function("luhn_check", own)


def kr_rrn_valid(value: Column) -> Column:
    """Thirteen digits whose last is (11 - weighted sum mod 11) mod 10."""
    own = digits(value)
    terms = [F.substring(own, k + 1, 1).try_cast("int") * w for k, w in enumerate(RRN_WEIGHTS)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return (F.length(own) == 13) & ((11 - total % 11) % 10 == F.substring(own, 13, 1).try_cast("int"))


_native.update(luhn=luhn, kr_rrn_valid=kr_rrn_valid)


def register(name: str, function: Callable[[str], bool]) -> None:
    """Make a Python predicate available to rules under ``name``."""
    _custom[name] = function


def register_words(name: str, accepted: list[str]) -> None:
    """A validator that accepts the given words only; for dictionaries of bounded size."""
    words = [F.lit(w) for w in accepted]
    _native[name] = lambda value: F.array_contains(F.array(*words), value) if words else F.lit(False)


def unregister(name: str) -> None:
    _custom.pop(name, None)
    _native.pop(name, None)


def available() -> list[str]:
    return sorted({*_native, *_custom})


def is_custom(name: str | None) -> bool:
    return name in _custom


def safe_call(name: str, value: str) -> bool:
    """A custom validator's verdict; True where it raises or is not known."""
    function = _custom.get(name)
    if function is None:
        return True
    try:
        return bool(function(value))
    except Exception:
        _log.warning("validator %s raised on a match, which stays", name, exc_info=True)
        return True


def verify(name: str, value: Column) -> Column:
    """Whether a match passes; true for unknown names and failing validators."""
    if name in _native:
        return F.coalesce(_native[name](value), F.lit(True))
    if name in _custom:
        function = _custom[name]

        def guarded(x: str) -> bool:
            try:
                return bool(function(x))
            except Exception:
                return True

        return F.udf(guarded, "boolean", useArrow=True)(value)
    _log.warning("no validator %s; its matches stay", name)
    return F.lit(True)
