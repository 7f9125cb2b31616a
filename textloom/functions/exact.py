"""The same functions in plain Python: for queries, which are one short text, for text beyond the column forms, and as a check on them."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from textloom.functions.text import STOPWORDS

_KEPT = {"Ll", "Lu", "Lo", "Nd"}


@lru_cache(maxsize=65536)
def _word_part(c: str) -> str:
    parts = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
    return "".join(x.lower() if len(x.lower()) == 1 else x for x in parts if unicodedata.category(x) in _KEPT)


def tokenize(text: str, stopwords=STOPWORDS) -> list[tuple[str, int, int]]:
    """(token, start, end) in order."""
    out: list[tuple[str, int, int]] = []
    n, i = len(text or ""), 0
    dot = None  # where the dots before a word begin
    while i < n:
        part = _word_part(text[i])
        if part:
            start = i if dot is None else dot
            token = "." * (dot is not None)
            while i < n and (part := _word_part(text[i])):
                token += part
                i += 1
            end = i
            while i < n and text[i] in "#+":
                i += 1
            if i > end and not (i < n and _word_part(text[i])):
                token, end = token + text[end:i], i
            if len(token) >= 2 and token not in stopwords:
                out.append((token, start, end))
            dot = None
            i += i < n and text[i] == "."
        else:
            dot = (i if dot is None else dot) if text[i] == "." else None
            i += 1
    return out


def fold(text: str) -> str:
    kept = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFC", "".join(c.lower() if len(c.lower()) == 1 else c for c in kept))


def word_ngrams(tokens: list[str], size: int) -> list[str]:
    return ["_".join(tokens[i : i + size]) for i in range(len(tokens) - size + 1)] if size > 1 else []


def best_window(lists: list[list[int]]) -> tuple[int, int] | None:
    """(start, end) of the smallest range with an element of each sorted list, the earliest of several."""
    merged = sorted((p, k) for k, own in enumerate(lists) for p in own)
    last: dict[int, int] = {}
    best = None
    for p, k in merged:
        last[k] = p
        if len(last) == len(lists):
            low = min(last.values())
            if best is None or p - low < best[1] - best[0]:
                best = low, p
    return best


def edit_budget(length: int, most: int) -> int:
    return 0 if length < 3 else min(1, most) if length < 5 else most
