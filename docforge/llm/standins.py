"""Texts in which nothing is said: nothing visible, or only a stand-in."""

from __future__ import annotations

import re

from docforge.llm.words import words

# Stand-ins for a missing text, as lower-cased words.
STAND_INS = {
    "n a", "na", "none", "null", "nil", "nan", "tbd", "tba", "todo", "to do", "to be done", "to be determined", "to be decided", "to be provided",
    "to be completed", "empty", "blank", "no response", "no answer", "no reply", "no text", "no content", "no data", "not available",
    "not applicable", "not provided", "not specified", "missing", "undefined", "unknown", "pending", "placeholder", "response", "answer",
    "no comment", "nothing", "void", "x", "xxx", "keine antwort", "keine angabe", "k a", "aucune réponse", "néant", "sin respuesta", "ninguno",
    "ninguna", "无", "无回答", "没有", "暂无", "待定", "未提供",
}
_TAG = re.compile(r"<[^<>]*>|&[#\w]+;")


def says_nothing(text: str | None) -> bool:
    """True for null, for texts without a letter or digit outside of markup, and for stand-ins."""
    if text is None:
        return True
    if len(text) > 200 and not text.isspace():
        return not any(c.isalnum() for c in _TAG.sub(" ", text))
    ws = words(_TAG.sub(" ", text))
    return not ws or (len(ws) <= 4 and " ".join(ws) in STAND_INS)
