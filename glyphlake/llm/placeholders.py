"""Texts that stand where a translation is missing."""

from __future__ import annotations

import re

# Customary words for "no translation yet", in lower case.
WORDS = (
    "n/a", "na", "n.a.", "n.a", "null", "none", "nil", "nan", "empty", "blank", "tbd", "tba", "tbc", "todo", "to do", "to be translated", "to be done", "to be determined", "to be confirmed", "not translated", "untranslated", "missing", "pending", "translation missing",
    "no translation", "translation pending", "placeholder", "#n/a", "undefined", "xxx", "待翻译", "待译", "未翻译", "无", "空", "暂无", "待定", "暂无翻译", "未訳", "翻訳待ち", "未翻訳", "なし", "미번역", "번역 대기", "번역 필요", "없음", "не переведено", "нет перевода", "нет", "a traducir", "sin traducir", "pendiente",
    "à traduire", "non traduit", "zu übersetzen", "nicht übersetzt", "leer", "fehlt", "vide", "vacío", "a traduzir", "não traduzido", "vazio",
)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_KNOWN = frozenset(_EDGE.sub("", w) for w in WORDS)


def is_placeholder(text: str | None) -> bool:
    """Whether a text is null, blank, marks only, or only a word for a missing translation. Signs such as ± or ° are marks."""
    if text is None:
        return True
    bare = _EDGE.sub("", text.lower())
    return not bare or " ".join(bare.split()) in _KNOWN
