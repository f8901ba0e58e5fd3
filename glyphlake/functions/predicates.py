"""Predicates on texts of drawings, as native column expressions.

Every predicate is false for null and blank text, except ``is_non_textual``
and ``is_blank``, which are true.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# What counts as a number, unit, code, symbol and letter range.
SPACE = r"[\t-\r\x{85}\p{Z}]"
UNITS = ("mm", "cm", "m", "kg", "kpa", "mpa", "pa", "v", "kv", "a", "hz", "kw", "w", "%", "deg", "°")
CODE_PATTERNS = (
    r"^[A-Z]{1,8}-[0-9]{1,6}[A-Z]?(?:-[0-9]+)?$",
    r"^[A-Z]{2,5}[0-9]{2,6}[A-Z]?$",
    r"^[A-Z]{1,4}\.[0-9]{1,3}(?:\.[0-9]{1,3})?$",
    r"^(?i:DWG[\t-\r\x{85}\p{Z}]*NO)",
    r"^(?i:REV[.-]?[0-9]+)$",
    r"^[0-9]+[.,]?[0-9]*[\t-\r\x{85}\p{Z}]*(?i:mm|cm|m|kg|kpa|mpa|pa|v|kv|a|hz|kw|w|%|deg|°)$",
)
SYMBOLS = " -+=_/\\|*#@&^~()[]{}<>:;,.!?\"'`$£€¥°±×÷≤≥≈≠∞∑∏√∫∂∇πΩµΔΦλθω"
LANGUAGE_RANGES = {
    "zh": r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]",
    "en": r"[A-Za-z]",
    "ja": r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}]",
    "ko": r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]",
}
TEXTUAL = r"[A-Za-z\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"

_PLAIN = r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
NUMBER = rf"(?:[+-]?{_PLAIN}(?:[eE][+-]?[0-9]+)?|(?i:nan|[+-]?infinity))"
#: A number that a later hyphen can be told apart from.
_LEFT = rf"\+?{_PLAIN}(?:[eE]\+?[0-9]+)?"
_UNIT = "(?i:" + "|".join(UNITS) + ")"
NUMBER_PATTERN = (
    rf"^(?:{NUMBER}|[0-9]+[.,]?[0-9]*{SPACE}*{_UNIT}|{NUMBER}{SPACE}*{_UNIT}"
    rf"|{_LEFT}{SPACE}*-{SPACE}*{NUMBER}|{NUMBER}{SPACE}*[~～:/]{SPACE}*{NUMBER})$"
)
SYMBOL_PATTERN = r"^[\t-\r\x{85}\p{Z}" + "".join("\\" + c if c in "\\-^[]/" else c for c in SYMBOLS) + "]+$"
CODE_PATTERN = "|".join(f"(?:{p})" for p in CODE_PATTERNS)
INTEGER_LINE = r"^[\t-\r\x{85}\p{Z}]*[+-]?[0-9]+[\t-\r\x{85}\p{Z}]*$"


def trim_all(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | c.rlike(rf"^{SPACE}*$")


def _holds(c: Column, pattern: str) -> Column:
    return ~is_blank(c) & F.coalesce(trim_all(c).rlike(pattern), F.lit(False))


def is_number(c: Column) -> Column:
    """A number, with or without a unit; a range; a ratio."""
    return _holds(c, NUMBER_PATTERN)


def is_code(c: Column) -> Column:
    """An engineering code, drawing number, revision or parameter."""
    return _holds(c, CODE_PATTERN)


def is_symbol(c: Column) -> Column:
    return ~is_blank(c) & F.coalesce(c.rlike(SYMBOL_PATTERN), F.lit(False))


def is_tag(c: Column) -> Column:
    """A tag: it has # or @, or capitals and figures and no small letters."""
    t = trim_all(c)
    return ~is_blank(c) & F.coalesce(t.rlike("[#@]") | (t.rlike(r"\p{Lu}") & t.rlike(r"\p{Nd}") & ~t.rlike(r"\p{Ll}")), F.lit(False))


def is_non_textual(c: Column, unicode_letters: bool = False) -> Column:
    """No letter to translate. ``unicode_letters`` counts the letters of all scripts, not the fixed ranges only."""
    return is_blank(c) | ~F.coalesce(c.rlike(r"\p{L}" if unicode_letters else TEXTUAL), F.lit(False))


def matches_language(c: Column, lang: str) -> Column:
    """Whether a text has a character of the language's range; false for languages without one."""
    pattern = LANGUAGE_RANGES.get((lang or "").lower())
    return F.coalesce(c.rlike(pattern), F.lit(False)) if pattern else F.lit(False)


def is_integer_line(c: Column) -> Column:
    """A line that parses as an integer and must not be overwritten."""
    return F.coalesce(c.rlike(INTEGER_LINE), F.lit(False))


@dataclass(frozen=True)
class CleanConfig:
    """Switches of the cleaning cascade."""

    source_lang: str = "en"
    target_lang: str = "zh"
    filter_empty: bool = True
    filter_number: bool = True
    filter_symbol: bool = True
    filter_code: bool = True
    filter_target_lang: bool = True
    filter_non_source_lang: bool = False
    skip_patterns: tuple[str, ...] = ()


def usable_patterns(patterns: tuple[str, ...]) -> list[str]:
    """The skip patterns that compile where they are matched, on the JVM; the others are ignored."""
    session = SparkSession.getActiveSession()
    compile_ = session._jvm.java.util.regex.Pattern.compile if session is not None else re.compile
    good = []
    for p in patterns:
        try:
            compile_(p)
        except (re.error, Py4JJavaError, PySparkException):
            continue
        good.append(p)
    return good


def filter_reason(c: Column, config: CleanConfig = CleanConfig()) -> Column:
    """The first reason for which a text needs no translation; null if it is kept."""
    t = trim_all(c)
    # A blank text is decided by the first rule or kept; no other rule holds for it.
    out = F.when(is_blank(c), F.lit("Empty") if config.filter_empty else F.lit(None).cast("string"))
    for p in usable_patterns(config.skip_patterns):
        out = out.when(t.rlike(p), "CustomSkip")
    if config.filter_symbol:
        out = out.when(is_symbol(c), "Symbol")
    if config.filter_number:
        out = out.when(is_number(c), "Number")
    if config.filter_code:
        out = out.when(is_code(c), "Code").when(is_tag(c), "EngineeringTag")
    if config.filter_target_lang:
        out = out.when(matches_language(t, config.target_lang), f"TargetLang({config.target_lang})")
    if config.filter_non_source_lang:
        out = out.when(~matches_language(t, config.source_lang), f"NonSourceLang({config.source_lang})")
    return out


def parse_ai_decisions(c: Column) -> Column:
    """``array<struct<index, decision, reason>>`` of a reply that holds a JSON array; null if it holds none."""
    body = F.regexp_extract(c, r"(?s)\[.*\]", 0)
    rows = F.from_json(body, "array<struct<index: int, decision: string, reason: string>>")
    kept = F.filter(rows, lambda r: r["index"] >= 0)
    return F.transform(kept, lambda r: F.struct(r["index"].alias("index"), F.upper(F.coalesce(r["decision"], F.lit("KEEP"))).alias("decision"), F.coalesce(r["reason"], F.lit("")).alias("reason")))
