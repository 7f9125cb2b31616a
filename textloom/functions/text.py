"""Text functions as column expressions: folding, tokens, n-grams, windows, previews."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

#: The words that the index leaves out.
STOPWORDS = ("o", "a", "os", "as", "um", "uma", "uns", "umas", "de", "do", "da", "dos", "das", "em", "no", "na", "nos", "nas", "ao", "aos", "por", "para", "com", "e")

#: What a word consists of, after folding.
W = r"\p{Ll}\p{Lu}\p{Lo}\p{Nd}"
#: Leading dots, a word, trailing # or + if no word follows, and the dot that ends it.
TOKEN = rf"(\.+)?([{W}]+)((?:[#+]+(?![#+{W}]))?)\.?"


def _fold_table() -> tuple[str, str]:
    """Characters of the basic plane whose decomposition is one base letter with marks, and those letters."""
    source, target = [], []
    for n in range(0x80, 0x10000):
        c = chr(n)
        if 0xD800 <= n < 0xE000:
            continue
        base = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if len(base) == 1 and base[0] != c:
            source.append(c)
            target.append(base[0])
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _fold_table()


def _capitals() -> tuple[str, str]:
    """Characters whose capital is one character, and those capitals."""
    source, target = [], []
    for n in range(0x61, 0x11000):
        c = chr(n)
        # of a letter whose capital is written with several, the title case may be one character; sharp s has its own
        up = "ẞ" if c == "ß" else c.upper() if len(c.upper()) == 1 else c.title()
        if not 0xD800 <= n < 0xE000 and len(up) == 1 and up != c:
            source.append(c)
            target.append(up)
    return "".join(source), "".join(target)


UPPER_FROM, UPPER_TO = _capitals()


def case_key(c) -> Column:
    """Equal for texts that differ in case alone, character by character: sharp s isn't two letters."""
    return F.translate(c, UPPER_FROM, UPPER_TO)


def unaccent(c) -> Column:
    """Letters without their accents, character by character, so that offsets stay."""
    return F.translate(c, FOLD_FROM, FOLD_TO)


def fold(c) -> Column:
    """Without accents and in lower case; punctuation stays."""
    return F.lower(unaccent(c))


def _clean(t) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(t, r"\.$", ""), r"^\.+", "."))


def token_values(c, stopwords=STOPWORDS) -> Column:
    """The array of a text's tokens: technical terms keep their leading dot and trailing # or +; one character and stop words go."""
    found = F.transform(F.regexp_extract_all(unaccent(c), F.lit(TOKEN), F.lit(0)), _clean)
    return F.coalesce(F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*stopwords)), F.array().cast("array<string>"))


def token_parts(c) -> Column:
    """The text cut so that every second part is a token with its dots."""
    return F.split(F.regexp_replace(F.translate(unaccent(c), "\x01", " "), TOKEN, "\x01$0\x01"), "\x01")


def clean_part(part) -> Column:
    return _clean(part)


def word_ngrams(tokens, size: int) -> Column:
    """Runs of size tokens joined by underscores."""
    runs = tokens
    for k in range(1, size):
        runs = F.zip_with(runs, F.slice(tokens, F.lit(k + 1), F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.slice(runs, F.lit(1), F.greatest(F.size(tokens) - (size - 1), F.lit(0)))


def letter_words(c) -> Column:
    """Runs of letters in lower case; accents stay."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))


def char_ngrams(word, longest: int = 3) -> Column:
    """All character n-grams of the word between underscores."""
    w = F.concat(F.lit("_"), word, F.lit("_"))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.when(i + n - 1 <= F.length(w), F.substring(w, i, F.lit(n))))
    return F.filter(F.flatten(F.array(*[of(n) for n in range(1, longest + 1)])), lambda g: g.isNotNull())


def split_words(c) -> Column:
    """Cut at ASCII characters that are no letter or digit; everything beyond ASCII stays."""
    return F.filter(F.split(c, r"[\x00-\x7F&&[^A-Za-z0-9]]+"), lambda x: x != "")


def common_prefix_length(a, b) -> Column:
    n = F.least(F.length(a), F.length(b))
    return F.when(n <= 0, 0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(k)))


def collapse(c) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def truncate(c, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most), F.lit("…")))


def last_word(c) -> Column:
    return F.substring_index(c, " ", -1)


def replace_last_word(c, by) -> Column:
    return F.concat(F.substring(c, F.lit(1), F.length(c) - F.length(last_word(c))), by)


def url_escape(c) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


_LISTS = 1 << 12  # more lists than a query has terms


def best_window(lists) -> Column:
    """The smallest (span, start) that covers an element of each sorted list; the earliest of several. Null without lists.

    One sweep over all elements in order, with the last element of each list so far as the state.
    """
    merged = F.array_sort(F.flatten(F.transform(lists, lambda x, k: F.transform(x, lambda p: p.cast("long") * _LISTS + k))))
    none, far = F.lit(-1).cast("long"), F.lit((1 << 31) - 1).cast("long")
    start = F.struct(F.array_repeat(none, F.size(lists)).alias("last"), far.alias("span"), none.alias("start"))

    def step(s, x):
        p = F.shiftright(x, 12)
        last = F.transform(s["last"], lambda v, k: F.when(x.bitwiseAND(_LISTS - 1) == k, p).otherwise(v))
        low = F.array_min(last)
        better = (low >= 0) & (p - low < s["span"])
        return F.struct(last.alias("last"), F.when(better, p - low).otherwise(s["span"]).alias("span"), F.when(better, low).otherwise(s["start"]).alias("start"))

    best = F.aggregate(merged, start, step, lambda s: F.struct(s["span"].cast("int").alias("span"), s["start"].cast("int").alias("start")))
    return F.when(best["start"] >= 0, best)


def preview(content, window_start, window_end, before: int = 60, after: int = 140, most: int = 300, plain: int = 200) -> Column:
    """The content around a window with ellipses where it is cut; without a window, its beginning."""
    start, end = F.greatest(F.lit(0), window_start - before), F.least(F.length(content), window_end + after)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), collapse(F.substring(content, start + 1, end - start)), F.when(end < F.length(content), "…").otherwise(""))
    return F.when(window_start.isNull(), truncate(collapse(content), plain)).otherwise(truncate(cut, most))


def match_rank(folded, prefix: str) -> Column:
    """0: begins with prefix; 1: prefix begins at a later word boundary; -1: neither."""
    import re

    later = "[^\\p{L}\\p{Nd}]" + re.sub(r"([^\w\s])", r"\\\1", prefix)
    return F.when(F.startswith(folded, F.lit(prefix)), 0).when(F.regexp_like(folded, F.lit(later)), 1).otherwise(-1)
