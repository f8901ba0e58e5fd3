"""String functions on drawing texts, as native column expressions. Null gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphlake.functions.predicates import SPACE, trim_all

# Scripts by character range in the order of their names, fonts, widths in hundredths, language codes.
SCRIPT_RANGES = {
    "CJK": r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]",
    "Arabic": r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}]",
    "Devanagari": r"[\x{0900}-\x{097F}]",
    "Thai": r"[\x{0E00}-\x{0E7F}]",
    "Greek": r"[\x{0370}-\x{03FF}]",
    "Korean": r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]",
    "Japanese": r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}]",
}
SCRIPT_FONTS = {"CJK": "SimSun", "Arabic": "Arial", "Devanagari": "Mangal", "Thai": "Tahoma", "Greek": "Arial", "Korean": "Batang", "Japanese": "MS Mincho"}
WIDTH_SPACE, WIDTH_ASCII, WIDTH_WIDE = 35, 55, 100
MIN_SCALE = 0.65
CHUNK = 250
PROVIDER_CODES = (
    ("ZH", True, "ZH", "zh", "zh", "zh-Hans"),
    ("EN", True, "EN", "en", "en", "en"),
    ("RU", True, "RU", "ru", "ru", "ru"),
    ("ES", True, "ES", "es", "es", "es"),
    ("PT", True, "PT", "pt", "pt", "pt"),
    ("AR", True, "AR", "ara", "ar", "ar"),
    ("FR", False, "FR", "fra", "fr", "fr"),
    ("KO", False, "KO", "kor", "ko", "ko"),
    ("JA", False, "JA", "jp", "ja", "ja"),
    ("DE", False, "DE", "de", "de", "de"),
    ("UK", False, None, "uk", "uk", "uk"),
)
PROVIDERS = ("deepl", "baidu", "tencent", "microsoft")


def sanitize_line(c: Column) -> Column:
    """One line: line breaks and tabs become spaces, other C0 controls go."""
    return F.regexp_replace(F.translate(c, "\r\n\t", "   "), r"[\x{00}-\x{1F}]", "")


def strip_for_translation(c: Column) -> Column:
    """Readable text of a format-coded one: groups and codes go, paragraph marks become line breaks."""
    steps = (
        (r"(?i)\{\\F[^;]*;([^}]*)\}", "$1"),
        (r"\\S[^;]*;", ""),
        (r"\\[WHATQCSplLoOkK][^;]*;", ""),
        (r"\\[Pp]", "\n"),
        (r"\\~", "\u00a0"),
        (r"\\[nN]", ""),
        (r"[{}]", ""),
    )
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    held = F.replace(F.replace(c, F.lit("\\\\"), F.lit("\u0001")), F.lit("\\;"), F.lit(";"))
    return trim_all(F.replace(held, F.lit("\u0001"), F.lit("\\")))


def escape_codes(c: Column) -> Column:
    for x in ("\\", "{", "}"):
        c = F.replace(c, F.lit(x), F.lit("\\" + x))
    return c


def escape_and_normalize(c: Column) -> Column:
    """Escaped, with paragraph marks for line breaks, a space for a tab, and no other C0 controls."""
    lines = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    marked = F.replace(F.replace(escape_codes(lines), F.lit("\n"), F.lit("\\P")), F.lit("\t"), F.lit(" "))
    return F.regexp_replace(marked, r"[\x{00}-\x{1F}]", "")


def visual_width(c: Column) -> Column:
    """The width of a text in hundredths of a wide character; counted by what is left of it, without a loop."""
    total = F.length(c)
    spaces = total - F.length(F.regexp_replace(c, SPACE, ""))
    ascii_ = total - spaces - F.length(F.regexp_replace(c, r"[\x{00}-\x{08}\x{0E}-\x{1F}!-\x{7F}]|" + SPACE, ""))
    return (spaces * WIDTH_SPACE + ascii_ * WIDTH_ASCII + (total - spaces - ascii_) * WIDTH_WIDE).cast("bigint")


def chunks(c: Column, size: int = CHUNK) -> Column:
    """``array<struct<code, text>>`` of at most ``size`` characters each; the last has code 1, others 3; empty gives one empty piece."""
    n = F.greatest(F.lit(1), F.ceil(F.length(c) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.when(i == n - 1, "1").otherwise("3").alias("code"), F.substring(c, i * size + 1, F.lit(size)).alias("text")))


def detect_script(c: Column) -> Column:
    """The script of the first character in a known range; Latin if there is none, or no text."""
    union = "[" + "".join(p[1:-1] for p in SCRIPT_RANGES.values()) + "]"
    first = F.regexp_extract(F.coalesce(c, F.lit("")), union, 0)
    out = F.when(first == "", "Latin")
    for name, pattern in SCRIPT_RANGES.items():
        out = out.when(first.rlike(pattern), name)
    return out.otherwise("Latin")


def unicode_style(text: Column, style: Column) -> Column:
    """The style a text with characters beyond ASCII needs; its own style otherwise."""
    script = detect_script(text)
    base = F.when(F.coalesce(F.trim(style), F.lit("")) == "", "Standard").otherwise(style)
    return F.when(text.rlike(r"[^\x{00}-\x{7F}]") & (script != "Latin"), F.concat(script, F.lit("_"), base)).otherwise(style)


def encode_unicode(c: Column) -> Column:
    r"""``\U+XXXX`` for characters beyond ASCII; a character beyond the first plane gives its two surrogates, eight digits each."""
    def one(x: Column) -> Column:
        code = F.ascii(x)
        over = code - 0x10000
        high = (F.shiftright(over, 10) + 0xD800).cast("int")
        low = (over.bitwiseAND(F.lit(0x3FF)) + 0xDC00).cast("int")
        return (
            F.when(code < 128, x)
            .when(code < 0x10000, F.concat(F.lit("\\U+"), F.lpad(F.hex(code), 4, "0")))
            .otherwise(F.concat(F.lit("\\U+"), F.lpad(F.hex(high), 8, "0"), F.lit("\\U+"), F.lpad(F.hex(low), 8, "0")))
        )

    return F.when(c.rlike(r"[^\x{00}-\x{7F}]"), F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), one), "")).otherwise(c)


def id_string(handles: Column) -> Column:
    """``@_<handle>_&f0`` of each handle; empty if there are none."""
    return F.coalesce(F.array_join(F.transform(handles, lambda h: F.concat(F.lit("@_"), h, F.lit("_&f0"))), ","), F.lit(""))


def cell_reference(row: Column, column: Column) -> Column:
    return F.when((row >= 0) & (column >= 0), F.concat(F.lit("R"), row.cast("string"), F.lit(":C"), column.cast("string"))).otherwise("")


def owner_handle(handle: Column) -> Column:
    """The entity handle of a cell's, leader's or paragraph's handle."""
    return F.regexp_replace(handle, r"(?i)::(?:R[0-9]+::C[0-9]+|CTX)$|:P[0-9]+$", "")


def text_for_translation(raw: Column, original: Column) -> Column:
    return F.when(F.coalesce(raw, F.lit("")) != "", strip_for_translation(raw)).otherwise(original)


def replace_ignore_case(c: Column, old: Column, new: Column) -> Column:
    """Every occurrence of a literal replaced, in any letter case; an empty literal changes nothing."""
    quoted = F.concat(F.lit("(?iu)\\Q"), F.replace(old, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    safe = F.regexp_replace(new, r"([\\$])", r"\\$1")
    return F.when(old == "", c).otherwise(F.regexp_replace(c, quoted, safe))


def normalize_language(c: Column) -> Column:
    """The main part of a language code in small letters; jp is ja."""
    main = F.split_part(F.lower(F.trim(c)), F.lit("-"), F.lit(1))
    return F.when(main == "jp", "ja").otherwise(main)


def source_language(source: Column, target: Column) -> Column:
    """The source language, guessed from the target if it is ``auto`` or null."""
    s, t = F.lower(F.trim(F.coalesce(source, F.lit("auto")))), F.lower(F.trim(F.coalesce(target, F.lit("en"))))
    return normalize_language(F.when(s == "auto", F.when(t == "en", "zh").otherwise("en")).otherwise(s))


def strip_quotes(c: Column) -> Column:
    """Without one pair of double quotes around it."""
    return F.regexp_replace(c, r'(?s)^"(.*)"$', "$1")


def ellipsis(c: Column, size: int) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def layout_scale(width: Column, bound: Column) -> Column:
    """How much a text must shrink to fit its bound; null if it fits or there is no bound."""
    return F.when((bound > 0) & (width > bound), F.greatest(F.lit(MIN_SCALE), bound / width))


def is_modern_table(version: Column) -> Column:
    """Whether tables are stored in the newer cell format; drawings without version are."""
    return (F.coalesce(version, F.lit("")) == "") | (version >= "AC1021")


def output_name(path: Column, suffix: str) -> Column:
    """``name<suffix>.ext`` of a path."""
    return F.regexp_replace(path, r"(?s)^(.*?)(\.[^./\\]*)?$", f"$1{suffix}$2")
