"""The second engine: standard word breaks, one BM25 score a field and clause, slop phrases, highlights, completion.

The service that it models scores by constants that aren't published; they stand in StandardOptions, so that this is a
model of its clauses and not a copy of its numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from textloom.functions import exact, scan
from textloom.functions.distance import damerau, damerau_distance, may_be_within
from textloom.functions.language import detect
from textloom.functions.text import collapse, fold, split_words, truncate
from textloom.operators.search import Response
from textloom.sources.shared import fresh


@dataclass(frozen=True)
class StandardOptions:
    k1: float = 1.2
    b: float = 0.75
    w_title: float = 3.0
    fuzzy_edits: int = 1
    fuzzy_prefix: int = 1
    fuzzy_boost: float = 0.3
    slop: int = 2
    phrase_boost: float = 2.0
    language_boost: float = 2.0
    gram_least: int = 2
    gram_most: int = 15
    constant: float = 1.0


#: Unicode word breaks: letters, digits and underscores, with one mark between two letters or two digits.
WORD = r"(?:\p{L}(?:[.:'’·]\p{L})*|\p{N}(?:[.,;'’]\p{N})*|_)+"


def standard_words(c):
    """Folded words by Unicode word breaks; no stop words, any length."""
    return F.coalesce(F.regexp_extract_all(fold(c), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def tokens(pages: DataFrame) -> DataFrame:
    """doc_id, field, pos, token."""
    fields = F.array(F.struct(F.lit("title").alias("field"), standard_words(F.col("title")).alias("w")), F.struct(F.lit("content").alias("field"), standard_words(F.col("content")).alias("w")))
    return pages.select("doc_id", F.explode(fields).alias("f")).select("doc_id", "f.field", F.posexplode("f.w").alias("pos", "token"))


def query_words(query: str) -> list[str]:
    import regex

    return regex.findall(WORD, exact.fold(query))


def sizes(words: DataFrame) -> DataFrame:
    """field, doc_id, length of all words."""
    return words.groupBy("field", "doc_id").agg(F.count("*").alias("length"))


def field_stats(size: DataFrame) -> DataFrame:
    """field, docs, average: pages with the field and its mean length."""
    return size.groupBy("field").agg(F.count("*").alias("docs"), F.avg("length").alias("average"))


def narrowed(words_of: DataFrame, asked: list[str], fuzzy: bool, o: StandardOptions) -> tuple[DataFrame, DataFrame]:
    """(words, sizes) of pages (doc_id, title, content), or of stored words: those words alone that are asked for, or that expand() finds.

    One pass, written to the shared folder; what is left is small.
    """
    spark = words_of.sparkSession
    path = fresh(spark, "found")
    if "token" in words_of.columns:
        near = F.col("token").isin(asked)
        for w in asked if fuzzy else []:
            near = near | F.startswith("token", F.lit(w[: o.fuzzy_prefix])) & may_be_within(F.col("token"), F.lit(w), o.fuzzy_edits)
        words_of.where(near).select("doc_id", "field", "pos", "token").write.parquet(f"{path}/words")
        sizes(words_of).write.parquet(f"{path}/sizes")
        return spark.read.parquet(f"{path}/words"), spark.read.parquet(f"{path}/sizes")
    scan.lean(spark)
    found = scan.standard_found(list(dict.fromkeys(asked)), o.fuzzy_edits if fuzzy else None, o.fuzzy_prefix)
    words_of.select("doc_id", found(F.col("title")).alias("title"), found(F.col("content")).alias("content")).write.parquet(f"{path}/pages")
    made = spark.read.parquet(f"{path}/pages")
    fields = made.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("f")) for f in ("title", "content")])).alias("x")).select("doc_id", "x.field", "x.f.length", "x.f.at").where("length > 0")
    # rows with the same id count together, as everywhere in this engine
    return fields.select("doc_id", "field", F.explode("at").alias("a")).select("doc_id", "field", "a.pos", "a.token"), fields.groupBy("field", "doc_id").agg(F.sum("length").alias("length"))


def _bm25(tf, df, docs, length, average, o: StandardOptions):
    return F.log(1 + (docs - df + 0.5) / (df + 0.5)) * tf * (o.k1 + 1) / (tf + o.k1 * (1 - o.b + o.b * length / average))


def text_clauses(words: DataFrame, weights: DataFrame, o: StandardOptions, size: DataFrame | None = None) -> DataFrame:
    """doc_id, part of words weighted by (field, token, weight); df is the field's own. size: sizes() of all words, if words aren't all."""
    size = sizes(words) if size is None else size
    tf = words.join(F.broadcast(weights), ["field", "token"]).groupBy("field", "doc_id", "token").agg(F.count("*").alias("tf"), F.max("weight").alias("weight"))
    df = tf.groupBy("field", "token").agg(F.count("*").alias("df"))
    rows = tf.join(df, ["field", "token"]).join(size, ["field", "doc_id"]).join(F.broadcast(field_stats(size)), "field")  # two rows
    return rows.select("doc_id", (F.col("weight") * _bm25(F.col("tf"), F.col("df"), F.col("docs"), F.col("length"), F.col("average"), o)).alias("part"))


def expand(words: DataFrame, asked: list[str], o: StandardOptions) -> DataFrame:
    """word, token, distance: indexed words within the edits that share the fixed first characters."""
    known = words.select("token").distinct()
    pairs = []
    for w in dict.fromkeys(asked):
        near = known.where(F.startswith("token", F.lit(w[: o.fuzzy_prefix])) & may_be_within(F.col("token"), F.lit(w), o.fuzzy_edits))
        pairs.append(near.select(F.lit(w).alias("word"), "token", damerau(F.col("token"), F.lit(w)).alias("distance")).where(F.col("distance") <= o.fuzzy_edits))
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out


def _then(positions):
    """Goes on to the next of positions."""
    return lambda s: F.struct(s["first"].alias("first"), F.array_min(F.filter(positions, lambda x: x > s["last"])).alias("last"))


def phrase_matches(words: DataFrame, asked: list[str], slop: int) -> DataFrame:
    """field, doc_id, n: how often the words stand in order within slop extra positions, each pair by the nearest next one."""
    at = words.where(F.col("token").isin(asked)).groupBy("field", "doc_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("token") == w, F.col("pos")))).alias(f"p{k}") for k, w in enumerate(asked)])
    found = F.transform("p0", lambda p: F.struct(p.alias("first"), p.alias("last")))
    for k in range(1, len(asked)):
        found = F.transform(found, _then(F.col(f"p{k}")))
    good = F.filter(found, lambda s: s["last"].isNotNull() & (s["last"] - s["first"] - (len(asked) - 1) <= slop))
    return at.select("field", "doc_id", F.size(good).alias("n")).where("n > 0")


def phrase_clauses(words: DataFrame, asked: list[str], o: StandardOptions, size: DataFrame | None = None) -> DataFrame:
    size = sizes(words) if size is None else size
    found = phrase_matches(words, asked, o.slop)
    df = found.groupBy("field").agg(F.count("*").alias("df"))
    rows = found.join(df, "field").join(size, ["field", "doc_id"]).join(F.broadcast(field_stats(size)), "field")
    weight = o.phrase_boost * F.when(F.col("field") == "title", o.w_title).otherwise(1.0)
    return rows.select("doc_id", (weight * _bm25(F.col("n"), F.col("df"), F.col("docs"), F.col("length"), F.col("average"), o)).alias("part"))


def scores(pages: DataFrame, query: str, fuzzy: bool = True, o: StandardOptions = StandardOptions(), words: DataFrame | None = None, size: DataFrame | None = None) -> DataFrame:
    """doc_id, score: the sum of all clauses that match; pages (doc_id, title, content, language if any), words: their tokens if stored, or with size what narrowed() has of them."""
    spark, asked = pages.sparkSession, query_words(query)
    if size is None:
        words, size = narrowed(pages if words is None else words, asked, fuzzy, o)
    fields = (("title", o.w_title), ("content", 1.0))
    exact_weights = spark.createDataFrame([(f, w, wt) for f, wt in fields for w in dict.fromkeys(asked)], "field string, token string, weight double")
    parts = text_clauses(words, exact_weights, o, size)
    if fuzzy and asked:
        near = expand(words, asked, o).groupBy("token").agg(F.min("distance").alias("distance"))
        both = near.crossJoin(F.broadcast(spark.createDataFrame(fields, "field string, base double")))  # two rows
        parts = parts.unionByName(text_clauses(words, both.select("field", "token", (F.col("base") * o.fuzzy_boost).alias("weight")), o, size))
    if len(asked) > 1 and o.phrase_boost > 0:
        parts = parts.unionByName(phrase_clauses(words, asked, o, size))
    total = parts.groupBy("doc_id").agg(F.sum("part").alias("score"))
    language, sure = detect(query)
    if sure and "language" in pages.columns:
        total = total.join(pages.select("doc_id", "language"), "doc_id").select("doc_id", (F.col("score") + F.when(F.col("language") == language, o.language_boost * o.constant).otherwise(0.0)).alias("score"))
    return total


def best_of(scored: DataFrame, top: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "doc_id").limit(max(top, 0))


def highlights(content, asked) -> F.Column:
    """The content's passages with hits, (hits, text), the best two first."""
    passages = F.split(content, r"(?<=[.!?])\s+|\n")
    rated = F.transform(passages, lambda p, k: F.struct((-F.size(F.filter(standard_words(p), lambda w: w.isin(*asked)))).alias("less"), k.alias("k"), p.alias("text")))
    return F.slice(F.array_sort(F.filter(rated, lambda r: r["less"] < 0)), 1, 2)


def search(pages: DataFrame, query: str, top: int = 20, correct: bool = True, o: StandardOptions = StandardOptions(), words: DataFrame | None = None) -> Response:
    """Ranked pages with highlights; words: the tokens of the pages if they are stored (tokens(pages) as a table is this engine's index)."""
    if not query or not query.strip():
        raise ValueError("empty query")
    asked = query_words(query)
    if not asked:
        return Response(query)
    words, size = narrowed(pages if words is None else words, asked, correct, o)
    near = [r.token for r in expand(words, asked, o).select("token").distinct().collect()] if correct else []
    found = best_of(scores(pages, query, correct, o, words, size), top).collect()
    best = pages.sparkSession.createDataFrame(found, "doc_id long, score double")
    marked = pages.where(F.col("doc_id").isin([r.doc_id for r in found])).join(F.broadcast(best), "doc_id").withColumn("h", highlights(F.col("content"), list(dict.fromkeys(asked + near))))  # at most top rows
    text = F.when(F.size("h") == 0, truncate(collapse(F.col("content")), 200)).otherwise(truncate(F.array_join(F.transform("h", lambda r: collapse(r["text"])), " … "), 300))
    rows = marked.select("doc_id", "url", "title", text.alias("preview"), "score", F.transform("h", lambda r: r["text"]).alias("passages")).orderBy(F.desc("score"), "doc_id").collect()
    other = did_you_mean(query, [p for r in rows for p in r.passages], set(asked + near)) if correct else None
    return Response(query, rows, (query, other) if other else None)


def did_you_mean(query: str, passages: list[str], hits: set[str]) -> str | None:
    """The query with words replaced by the nearest word that was highlighted: within two edits and fewer than its length."""
    import re

    known: dict[str, str] = {}
    for p in passages:
        for w in re.split(r"[^A-Za-z0-9\x80-\U0010FFFF]+", p):
            if w and exact.fold(w) in hits:
                known.setdefault(exact.fold(w), w.lower())
    words, changed = query.split(), False
    for k, w in enumerate(words):
        own = exact.fold("".join(re.split(r"[^A-Za-z0-9\x80-\U0010FFFF]+", w)))
        if len(own) < 2 or own in known or not known:
            continue
        away, best = min((damerau_distance(own, f), f) for f in known)
        if away <= 2 and away < len(own):
            words[k], changed = known[best], True
    return " ".join(words) if changed else None


def complete(titles: DataFrame, prefix: str, o: StandardOptions = StandardOptions()) -> DataFrame:
    """title, words of the titles (title) that have a word whose beginning is within the edits of prefix."""
    own = exact.fold(prefix)
    most = exact.edit_budget(len(own), o.fuzzy_edits)
    cut = own[: o.gram_most]
    words = titles.select("title", F.posexplode(standard_words(F.col("title"))).alias("pos", "word"))
    start = F.substring("word", 1, len(cut))
    near = words.where(F.startswith("word", F.lit(cut[: o.fuzzy_prefix])) & may_be_within(start, F.lit(cut), most)).withColumn("distance", damerau(start, F.lit(cut)))
    return near.where(F.col("distance") <= most).select("title", "pos", "word", "distance")


def autocomplete(titles: DataFrame, prefix: str, top: int = 10, o: StandardOptions = StandardOptions()) -> DataFrame:
    """ord, text, is_correction: up to five words made from matching titles, then those titles."""
    if not prefix or not prefix.strip():
        raise ValueError("empty prefix")
    found = complete(titles, prefix, o)
    own = found.groupBy("title").agg(F.min("distance").alias("distance")).orderBy("distance", F.length("title"), "title").limit(2 * max(top, 0))
    made = found.join(own.select("title"), "title", "left_semi").groupBy("word").agg(F.min("distance").alias("distance"), F.count("*").alias("n"))
    words = made.orderBy("distance", F.desc("n"), F.length("word"), "word").limit(5)
    both = words.select(F.lit(0).alias("src"), F.struct(F.col("distance").cast("long").alias("a"), (-F.col("n")).alias("b"), F.length("word").alias("c"), F.col("word").alias("d")).alias("o"), F.col("word").alias("text"), (F.col("distance") > 0).alias("is_correction")).unionByName(
        own.select(F.lit(1).alias("src"), F.struct(F.col("distance").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.length("title").alias("c"), F.col("title").alias("d")).alias("o"), F.col("title").alias("text"), F.lit(False).alias("is_correction"))
    )
    once = both.withColumn("k", F.row_number().over(Window.partitionBy(F.lower("text")).orderBy("src", "o"))).where("k = 1")  # at most 5 + 2 top rows
    placed = once.withColumn("ord", F.row_number().over(Window.orderBy("src", "o")))
    return placed.where((F.col("src") == 0) | (F.col("ord") <= top)).select("ord", "text", "is_correction")
