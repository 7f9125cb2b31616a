"""Whole texts in Arrow batches: tokens and places are found where a text stands, and only what is asked for leaves it.

The column forms in text.py cut a text in the JVM, which takes several times as long, and need a shuffle of all tokens for
a running offset. These functions give the same tokens and offsets (text.py for signs of the basic plane, exact.py beyond).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import exact
from textloom.functions.text import FOLD_FROM, FOLD_TO, STOPWORDS

#: Rows of an Arrow batch of texts, and entries of a count before it is sent on: both bound a worker's memory.
BATCH, MOST_COUNTS = 1000, 200_000


def lean(spark: SparkSession, rows: int = BATCH) -> None:
    """Smaller Arrow batches for the session (results are lazy): JVM and worker each hold one batch of texts, and what is found in it."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_FOLD = dict(zip(FOLD_FROM, FOLD_TO, strict=True))
_ASCII = {chr(n) for n in range(128)}


def _token_pattern(w: str) -> re.Pattern:
    """text.TOKEN with the token itself as its group: the last of the leading dots, the word, and no dot that ends it."""
    return re.compile(rf"(\.?[{w}]+(?:[#+]+(?![#+{w}]))?)\.?")


def _ranges(kept) -> str:
    """The signs of the basic plane beyond ASCII for which kept holds, for a character class."""
    out, start = [], None
    for n in range(0x80, 0x10001):
        inside = n < 0x10000 and not 0xD800 <= n < 0xE000 and kept(chr(n))
        if inside and start is None:
            start = n
        elif not inside and start is not None:
            out.append(f"\\u{start:04x}-\\u{n - 1:04x}")
            start = None
    return "".join(out)


_in_word = lambda c: unicodedata.category(c) in ("Ll", "Lu", "Lo", "Nd")


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern, set[str]]:
    """Tokens of ASCII text in lower case, of folded text, signs for exact.py, and signs that lower case must not meet before the cut."""
    odd = {chr(n) for n in range(0x80, 0x10000) if not 0xD800 <= n < 0xE000 and (len(chr(n).lower()) != 1 or _in_word(chr(n)) != _in_word(chr(n).lower()))}
    return _token_pattern("a-z0-9"), _token_pattern("a-zA-Z0-9" + _ranges(_in_word)), re.compile("[가-힣\U00010000-\U0010ffff]"), odd


_STOP = frozenset(STOPWORDS)


def _folded(text: str, signs: set[str]) -> str:
    for c in signs:
        if c in _FOLD:
            text = text.replace(c, _FOLD[c])
    return text


def _ready(text: str) -> tuple[re.Pattern | None, str]:
    """A text as the pattern cuts it; no pattern: exact.py has to."""
    plain, wide, beyond, odd = _patterns()
    if text.isascii():
        return plain, text.lower()
    if beyond.search(text):
        return None, text
    text = _folded(text, set(text) - _ASCII)
    if text.isascii():
        return plain, text.lower()
    text = text.replace("Σ", "σ")  # sign by sign, wherever it stands
    return wide, text if odd.intersection(text) else text.lower()


def words(text: str | None) -> list[str]:
    """The tokens of a text in order."""
    if not text:
        return []
    pattern, own = _ready(text)
    if pattern is None:
        return [t for t, _, _ in exact.tokenize(text)]
    found = pattern.findall(own)
    if pattern is not _patterns()[0]:  # else it is in lower case already
        found = map(str.lower, found)
    return [t for t in found if len(t) > 1 and t not in _STOP]


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(token, start, end) in order; a token begins at the first of its dots."""
    if not text:
        return []
    pattern, own = _ready(text)
    if pattern is None:
        return exact.tokenize(text)
    out, last = [], 0
    for m in pattern.finditer(own):
        t = m[1]
        if len(t) > 1 and (t := t.lower()) not in _STOP:
            start, end = m.span(1)
            if t[0] == ".":
                while start > last and own[start - 1] == ".":
                    start -= 1
            out.append((t, start, end))
        last = m.end()
    return out


def places(text: str, wanted: set[str]) -> list[tuple[str, int, int]]:
    """Those of spans() whose token is wanted."""
    pattern, own = _ready(text)
    if pattern is not _patterns()[0]:
        return [x for x in spans(text) if x[0] in wanted]
    hits = [m.span(1) for m in pattern.finditer(own) if m[1] in wanted]
    if not any(t[0] == "." for t in wanted):
        return [(own[s:e], s, e) for s, e in hits]
    return [x for x in spans(text) if x[0] in wanted] if hits else []


# -- Arrow arrays ------------------------------------------------------------------------------------------------------


def _list(sizes: list[int], values: pa.Array) -> pa.ListArray:
    at = np.zeros(len(sizes) + 1, "int32")
    np.cumsum(np.asarray(sizes, "int32"), out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), values)


def _struct(**columns: pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def _ints(values) -> pa.Array:
    return pa.array(np.asarray(values, "int32"))


def _row(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_INT, _TEXT = T.IntegerType(), T.StringType()


@F.arrow_udf(T.ArrayType(_TEXT))
def token_list(text: pa.Array) -> pa.Array:
    sizes, out = [], []
    for t in text.to_pylist():
        own = words(t)
        sizes.append(len(own))
        out += own
    return _list(sizes, pa.array(out, pa.string()))


@F.arrow_udf(_INT)
def token_count(text: pa.Array) -> pa.Array:
    return pa.array([len(words(t)) for t in text.to_pylist()], pa.int32())


@F.arrow_udf(T.ArrayType(_row(pos=_INT, token=_TEXT, start=_INT, end=_INT)))
def token_spans(text: pa.Array) -> pa.Array:
    sizes, pos, token, start, end = [], [], [], [], []
    for t in text.to_pylist():
        own = spans(t)
        sizes.append(len(own))
        pos += range(len(own))
        for w, s, e in own:
            token.append(w)
            start.append(s)
            end.append(e)
    return _list(sizes, _struct(pos=_ints(pos), token=pa.array(token, pa.string()), start=_ints(start), end=_ints(end)))


_PLACES = T.ArrayType(_row(start=_INT, end=_INT))
_FOUND = T.ArrayType(_row(key=_TEXT, tf_title=_INT, tf_content=_INT, positions_title=_PLACES, positions_content=_PLACES))


class _Postings:
    """Columns of the postings of a batch of pages."""

    def __init__(self):
        self.sizes, self.keys, self.counts, self.at = [], [], ([], []), ([], [])

    def add(self, places: dict[str, tuple[list[int], list[int]]]) -> None:
        """places: by key, start and end in turn, in the title and in the content."""
        self.sizes.append(len(places))
        self.keys += places
        for own in places.values():
            for k in (0, 1):
                self.counts[k].append(len(own[k]) >> 1)
                self.at[k].extend(own[k])

    def arrow(self) -> pa.Array:
        lists = []
        for k in (0, 1):
            flat = np.asarray(self.at[k], "int32").reshape(-1, 2)
            lists.append(_list(self.counts[k], _struct(start=pa.array(np.ascontiguousarray(flat[:, 0])), end=pa.array(np.ascontiguousarray(flat[:, 1])))))
        return _list(self.sizes, _struct(key=pa.array(self.keys, pa.string()), tf_title=_ints(self.counts[0]), tf_content=_ints(self.counts[1]), positions_title=lists[0], positions_content=lists[1]))


@F.arrow_udf(_FOUND)
def all_postings(title: pa.Array, content: pa.Array) -> pa.Array:
    """Each page's terms with all their places."""
    out = _Postings()
    for texts in zip(title.to_pylist(), content.to_pylist(), strict=True):
        places: dict = {}
        for k, text in enumerate(texts):
            for t, s, e in spans(text):
                own = places.get(t)
                if own is None:
                    own = places[t] = ([], [])
                own[k].extend((s, e))
        out.add(places)
    return out.arrow()


def asked_postings(terms: list[str], runs: list[str], positions: bool = True):
    """A function of (title, content): both lengths in tokens, the postings of terms (places in the content alone, if at all), and how often runs of tokens (joined by underscores) stand in both."""
    wanted, sizes = set(terms) - set(STOPWORDS), sorted({r.count("_") + 1 for r in runs})
    phrases, firsts = set(runs), {r.split("_")[0] for r in runs}

    @F.arrow_udf(_row(length_title=_INT, length_content=_INT, terms=_FOUND, phrases=_FOUND))
    def found(title: pa.Array, content: pa.Array) -> pa.Array:
        own, more, lengths = _Postings(), _Postings(), ([], [])
        for texts in zip(title.to_pylist(), content.to_pylist(), strict=True):
            here: dict = {}
            there: dict = {}
            for k, text in enumerate(texts):
                tokens = words(text)
                lengths[k].append(len(tokens))
                if not wanted.isdisjoint(tokens):
                    for t, s, e in places(text, wanted) if positions and k == 1 else [(t, 0, 0) for t in tokens if t in wanted]:
                        here.setdefault(t, ([], []))[k].extend((s, e))
                if not firsts.isdisjoint(tokens):
                    for i, t in enumerate(tokens):
                        if t in firsts:
                            for n in sizes:
                                if i + n <= len(tokens) and (r := "_".join(tokens[i : i + n])) in phrases:
                                    there.setdefault(r, ([], []))[k].extend((0, 0))
            own.add(here)
            more.add(there)
        return _struct(length_title=_ints(lengths[0]), length_content=_ints(lengths[1]), terms=own.arrow(), phrases=more.arrow())

    return found


# -- counts ------------------------------------------------------------------------------------------------------------


def counts(pages: DataFrame, keys) -> DataFrame:
    """key, n: in how many pages each of keys(title, content), an iterable without repeats, is; added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        send = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["key", "n"])
        for b in batches:
            for title, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.update(keys(title, content))
                if len(held) > MOST_COUNTS:
                    yield send()
                    held.clear()
        yield send()

    lean(pages.sparkSession)
    return pages.select("title", "content").mapInArrow(run, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def distinct_words(title: str | None, content: str | None) -> set[str]:
    return {*words(title), *words(content)}


def phrases_of(kept: set[str] | None):
    """For counts(): a page's runs of two and three tokens; of kept words alone if given."""

    def runs(title, content):
        out = set()
        for text in (title, content):
            own = words(text)
            if kept is None:
                two = list(map("_".join, zip(own, own[1:], strict=False)))
                out.update(two)
                out.update(map("_".join, zip(two, own[2:], strict=False)))
            else:
                good = [t if t in kept else None for t in own]
                for i in range(len(good) - 1):
                    if (a := good[i]) is not None and (b := good[i + 1]) is not None:
                        out.add(two := f"{a}_{b}")
                        if i + 2 < len(good) and (c := good[i + 2]) is not None:
                            out.add(f"{two}_{c}")
        return out

    return runs


# -- words by standard breaks ------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _standard_patterns():
    """The pattern standard.WORD for ASCII, for the basic plane, and for all signs."""
    import regex

    from textloom.operators.standard import WORD

    def of(letters: str, digits: str) -> re.Pattern:
        # the same words: a run of letters or digits, which a mark may join to the next of its kind
        return re.compile(rf"(?:[{letters}]+(?:[.:'’·][{letters}]+)*|[{digits}]+(?:[.,;'’][{digits}]+)*|_+)+")

    letters, digits = (_ranges(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
    return of("a-z", "0-9"), of("a-zA-Z" + letters, "0-9" + digits), regex.compile(WORD)


def standard_list(text: str | None) -> list[str]:
    """standard_words() of a text."""
    if not text:
        return []
    plain, wide, full = _standard_patterns()
    if not text.isascii():
        text = _folded(text, set(text) - _ASCII)
    text = text.lower()
    if text.isascii():
        return plain.findall(text)
    return (full if max(text) > "￿" else wide).findall(text)


def one_edit(a: str, b: str) -> bool:
    """Whether at most one insertion, deletion, change or transposition of neighbours leads from a to b: a distance of 1 in damerau_distance()."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    if len(a) < len(b):
        return a[k:] == b[k + 1 :]
    return a[k + 1 :] == b[k + 1 :] or a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :]


class _Near(dict):
    """Whether a word is asked for, or within some edits of an asked one with the same beginning."""

    def __init__(self, asked: list[str], edits: int | None, prefix: int):
        super().__init__()
        self.asked, self.edits, self.prefix = asked, edits, prefix
        #: What words begin with that can be meant; None: anything.
        self.firsts = {w[0] for w in asked} if edits is None or prefix else None

    def __missing__(self, token: str) -> bool:
        from textloom.functions.distance import damerau_distance

        if len(self) > MOST_COUNTS:
            self.clear()
        out = token in self.asked
        if not out and self.edits is not None:
            for w in self.asked:
                if abs(len(token) - len(w)) <= self.edits and token.startswith(w[: self.prefix]) and (one_edit(token, w) or self.edits > 1 and damerau_distance(token, w) <= self.edits):
                    out = True
                    break
        self[token] = out
        return out


def standard_found(asked: list[str], edits: int | None, prefix: int):
    """A function of a text: its length in standard words, and (pos, token) of those that are asked for or near (edits None: no others)."""

    @F.arrow_udf(_row(length=_INT, at=T.ArrayType(_row(pos=_INT, token=_TEXT))))
    def found(text: pa.Array) -> pa.Array:
        near = _Near(asked, edits, prefix)
        lengths, sizes, pos, token = [], [], [], []
        for t in text.to_pylist():
            own = standard_list(t)
            lengths.append(len(own))
            at = [k for k, w in enumerate(own) if (near.firsts is None or w[0] in near.firsts) and near[w]]
            sizes.append(len(at))
            pos += at
            token += [own[k] for k in at]
        return _struct(length=_ints(lengths), at=_list(sizes, _struct(pos=_ints(pos), token=pa.array(token, pa.string()))))

    return found
