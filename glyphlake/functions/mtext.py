r"""Format codes of paragraph texts: taking them out, putting them back, rebuilding a text.

These codecs number tokens and carry state through a text, so they are Python
functions, wrapped in Arrow-batched UDFs.

Defined cases: a null raw text strips to null; a blank text restores to an empty
one; a skeleton without slot stays as it is; a translation with fewer paragraphs
than slots empties the rest, with more loses the surplus.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Token marks, slot marks, the codes' shapes, widths.
TOKEN_OPEN, TOKEN_CLOSE = "\x02MFMT\x02", "\x03"
SLOT_OPEN, SLOT_CLOSE = "\x02VT\x02", "\x03"
FONT_GROUP = re.compile(r"\{(\\F[^;]*;)([^}]*)\}", re.I)
STACK = re.compile(r"\\S[^;]*;")
PARAMETER = re.compile(r"\\[WHATQCSplLoOkK][^;]*;")
#: With ``strict``, toggles take no text with them and small or bare font codes count.
STRICT_PARAMETER = re.compile(r"\\[WHATQCSpwhcFf][^;]*;|\\[LlOoKk]")
SIMPLE = re.compile(r"\\[PpnN~]")
BRACES = re.compile(r"[{}]")
COMMAND = re.compile(r"\{\\[HCFWATQSp][^;]*;|\\[WHATQCSplLoOkK][^;]*;|\\P|\\~|[{}]")
TOKEN = re.compile(re.escape(TOKEN_OPEN) + r"\d+" + re.escape(TOKEN_CLOSE))
WIDTHS = {"space": 0.35, "ascii": 0.55, "wide": 1.0}


def strip_codes(raw: str | None, strict: bool = False) -> tuple[str | None, list[tuple[str, str]]]:
    """The text with a numbered token for every code, and ``(token, code)`` in their order."""
    if not raw:
        return raw, []
    codes: list[tuple[str, str]] = []

    def token(code: str) -> str:
        codes.append((f"{TOKEN_OPEN}{len(codes)}{TOKEN_CLOSE}", code))
        return codes[-1][0]

    def group(m: re.Match) -> str:
        opened, closed = token("{" + m[1]), token("}")
        return opened + m[2] + closed

    text = FONT_GROUP.sub(group, raw)
    for shape in (STACK, STRICT_PARAMETER if strict else PARAMETER, SIMPLE, BRACES):
        text = shape.sub(lambda m: token(m[0]), text)
    return re.sub(r"\\([\\;])", r"\1", text), codes


def escape(text: str) -> str:
    return re.sub(r"([\\{}])", r"\\\1", text)


def restore_codes(text: str | None, codes: list[tuple[str, str]]) -> str:
    """A translated text with its codes: what stands between tokens is escaped, line breaks become paragraph marks."""
    if not text:
        return ""
    out, at = [], 0
    for m in TOKEN.finditer(text):
        out += [escape(text[at : m.start()]), m[0]]
        at = m.end()
    whole = "".join([*out, escape(text[at:])]).replace("\n", "\\P")
    for token, code in codes:
        whole = whole.replace(token, code)
    return whole


def skeleton(raw: str | None) -> str | None:
    """The text with a slot around each visible run; commands stay."""
    if not raw:
        return raw
    slot = lambda s: f"{SLOT_OPEN}{s}{SLOT_CLOSE}" if s else ""
    out, at = [], 0
    for m in COMMAND.finditer(raw):
        out += [slot(raw[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, slot(raw[at:])])


def normalize(text: str) -> str:
    """Escaped for a drawing: line breaks as paragraph marks, tabs as spaces, no other controls."""
    marked = escape(text.replace("\r\n", "\n").replace("\r", "\n")).replace("\n", "\\P").replace("\t", " ")
    return re.sub(r"[\x00-\x1f]", "", marked)


_SLOT = re.compile(re.escape(SLOT_OPEN) + r".*?" + re.escape(SLOT_CLOSE), re.S)


def fill_slots(shape: str | None, text: str | None) -> str:
    """A skeleton with a translation in its slots: one slot takes it whole, several take a paragraph each."""
    if not shape:
        return normalize(text or "")
    slots = len(_SLOT.findall(shape))
    if not text or not slots:
        return shape
    parts = [normalize(text)] if slots == 1 else normalize(text).split("\\P")
    left = iter(parts)
    return _SLOT.sub(lambda m: next(left, ""), shape)


def char_width(c: str) -> float:
    return WIDTHS["space"] if c.isspace() else WIDTHS["ascii"] if c <= "\x7f" else WIDTHS["wide"]


_WRAP_COMMAND = re.compile(r"\\[Pp~OoLlKkNn]|\\[HWATQCSFhwatqcsf][^;]*;|\\.?|\}", re.S)


def _group_end(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return i + 1
    return len(text)


def wrap(text: str | None, width: float | None) -> str | None:
    """Paragraph marks where a line grows wider than ``width``; commands and braced groups have no width. No width, no wrapping."""
    if not text or not width or width <= 0:
        return text
    lines = []
    for paragraph in text.split("\\P"):
        out, used, at = [], 0.0, 0
        while at < len(paragraph):
            c = paragraph[at]
            if c == "{":
                end = _group_end(paragraph, at)
            elif c in "\\}":
                # An unknown command counts as its backslash alone.
                m = _WRAP_COMMAND.match(paragraph, at)
                end = m.end() if m and (m[0] == "}" or len(m[0]) > 2 or m[0][1:2] in "Pp~OoLlKkNn") else at + 1
            else:
                w = char_width(c)
                if used and used + w > width:
                    out.append("\\P")
                    used = 0.0
                used += w
                end = at + 1
            out.append(paragraph[at:end])
            at = end
        lines.append("".join(out))
    return "\\P".join(lines)


def rebuild(raw: str | None, text: str | None, width: float | None = 0.0) -> str | None:
    """A translation in the shape of the original, wrapped; a blank original gives the translation, a blank translation the original."""
    if not (raw or "").strip():
        return text
    if not (text or "").strip():
        return raw
    return wrap(fill_slots(skeleton(raw), text), width)


_STRIPPED = "struct<text: string, codes: array<struct<token: string, code: string>>>"


def strip_codes_udf(raw: Column, strict: bool = False) -> Column:
    @F.pandas_udf(_STRIPPED)
    def run(s: pd.Series) -> pd.DataFrame:
        pairs = [strip_codes(x, strict) for x in s]
        return pd.DataFrame({"text": [t for t, _ in pairs], "codes": [[{"token": a, "code": b} for a, b in c] for _, c in pairs]})

    return run(raw)


def restore_codes_udf(stripped: Column) -> Column:
    """The codes put back into a struct of ``text`` and ``codes``."""

    @F.pandas_udf("string")
    def run(s: pd.DataFrame) -> pd.Series:
        return pd.Series([restore_codes(t, [(x["token"], x["code"]) for x in (c if c is not None else [])]) for t, c in zip(s["text"], s["codes"])], dtype=object)

    return run(stripped)


def rebuild_udf(raw: Column, text: Column, width: Column) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([rebuild(x, y, None if z != z else z) for x, y, z in zip(a, b, w)], dtype=object)

    return run(raw, text, width.cast("double"))


def rebuild_paragraphs_udf(parts: Column, texts: Column, width: Column) -> Column:
    """Paragraphs with the translation of each; one without stays as it is."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series(["\\P".join(rebuild(x, y, z) if y else x for x, y in zip(p, t)) for p, t, z in zip(a, b, w)], dtype=object)

    return run(parts, texts, width.cast("double"))


def wrap_udf(text: Column, width: Column) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([wrap(x, None if z != z else z) for x, z in zip(a, w)], dtype=object)

    return run(text, width.cast("double"))
