"""Search with correction, spelling and completion over the index."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from textloom.functions import exact
from textloom.functions.distance import damerau, deletions, may_be_within, osa
from textloom.functions.language import detect
from textloom.functions.text import common_prefix_length, match_rank
from textloom.operators.index import Index, lookup
from textloom.operators.rank import Bm25Options, hits, narrowed, runs_of, scores, top as top_of

WORDS, MOST_EDITS = 5, 2


class IndexNotReady(RuntimeError):
    """Completion was asked for before a vocabulary was built."""


@dataclass
class Response:
    query: str
    results: list[Row] = field(default_factory=list)
    did_you_mean: tuple[str, str] | None = None


def missing(vocab: DataFrame, terms: DataFrame) -> DataFrame:
    """Those of terms (term) that no page has."""
    return terms.distinct().join(vocab, "term", "left_anti")


def within(vocab: DataFrame, words: DataFrame | list[str], most: int = MOST_EDITS) -> DataFrame:
    """word, term, distance: vocabulary within most edits (with transpositions) of words.

    A list is that of a query: its few words meet each term at the built-in guard, in one pass over the vocabulary.
    Of a table, both sides meet on what is left of them after up to most deletions, so that no pair is formed that can't match;
    the distance itself is computed on what a built-in guard lets through.
    """
    if isinstance(words, list):
        few = F.array(*[F.lit(w) for w in dict.fromkeys(words)]).cast("array<string>")
        pairs = vocab.select(F.explode(few).alias("word"), "term").where(may_be_within(F.col("word"), F.col("term"), most))
        return pairs.withColumn("distance", damerau(F.col("word"), F.col("term"))).where(F.col("distance") <= most)
    own = words.select("word").where("word IS NOT NULL").distinct()
    left = own.select("word", F.explode(deletions(F.col("word"), most)).alias("key"))
    # only terms as long as some word is, give or take: what is left of a long string is the square of its length
    span = own.agg(F.min(F.length("word")).alias("least"), F.max(F.length("word")).alias("longest"))
    near = vocab.select("term").join(F.broadcast(span), F.length("term").between(F.col("least") - most, F.col("longest") + most))  # one row
    right = near.select("term", F.explode(deletions(F.col("term"), most)).alias("key"))
    pairs = left.join(right, "key").select("word", "term").distinct().where(may_be_within(F.col("word"), F.col("term"), most))
    return pairs.withColumn("distance", damerau(F.col("word"), F.col("term"))).where(F.col("distance") <= most)


def spell(vocab: DataFrame, words: DataFrame | list[str]) -> DataFrame:
    """word, correction, distance: the term that wins by 10 for an edit less 2 for each shared first character; fewer edits, then the term, break ties."""
    near = within(vocab, words).where("distance > 0")
    weight = 10 * F.col("distance") - 2 * common_prefix_length(F.col("word"), F.col("term"))
    best = near.withColumn("weight", weight).groupBy("word").agg(F.min(F.struct("weight", "distance", "term")).alias("b"))
    return best.select("word", F.col("b.term").alias("correction"), F.col("b.distance").alias("distance"))


def searches(index: Index, queries: list[str], top: int = 20, correct: bool = True, o: Bm25Options = Bm25Options()) -> list[tuple[list[Row], str | None]]:
    """For each query the best rows of scores(), and the corrected query if its results are these.

    All lost words are looked up at once, and an index that is but plans is read in one pass for all queries.
    """
    terms = [[t for t, _, _ in exact.tokenize(q)] for q in queries]
    by: dict[str, str] = {}
    if correct and any(terms):
        every = list(dict.fromkeys(t for own in terms for t in own))
        vocab = index.known_terms()
        known = {r.term for r in lookup(vocab, "term", every).select("term").collect()}
        if lost := [t for t in every if t not in known]:
            by = {r.word: r.correction for r in spell(vocab, lost).collect()}
    others = [[by.get(t, t) for t in own] for own in terms]
    languages = [language if sure else None for language, sure in map(detect, queries)]
    if index.lazy and any(terms):
        lists = [*terms, *others]
        index = narrowed(index, [t for own in lists for t in own], runs_of(lists, o), languages=any(languages))
    out = []
    for own, other, language in zip(terms, others, languages, strict=True):
        ranked = lambda ts: top_of(scores(index, ts, language, o), top).collect() if ts else []  # noqa: B023, E731
        if other != own and (found := ranked(other)):
            out.append((found, " ".join(other)))
        else:
            out.append((ranked(own), None))
    return out


def search(index: Index, query: str, top: int = 20, correct: bool = True, o: Bm25Options = Bm25Options()) -> Response:
    """Ranked pages with any of the query's terms. Terms that the index lacks are corrected, if that finds anything."""
    if not query or not query.strip():
        raise ValueError("empty query")
    ((best, other),) = searches(index, [query], top, correct, o)
    return Response(query, hits(index, best).collect() if best else [], (query, other) if other is not None else None)


def fuzzy_words(prefixes: DataFrame, prefix: str, most: int) -> DataFrame:
    """term, df, distance: the frequent terms of every vocabulary prefix with the same first character within most edits of prefix."""
    near = prefixes.where(F.startswith("prefix", F.lit(prefix[:1])) & F.length("prefix").between(len(prefix) - most, len(prefix) + most))
    if most:
        near = near.where(may_be_within(F.col("prefix"), F.lit(prefix), most)).withColumn("distance", osa(F.col("prefix"), F.lit(prefix))).where(F.col("distance") <= most)
    else:
        near = near.where(F.col("prefix") == prefix).withColumn("distance", F.lit(0))
    return near.groupBy("term").agg(F.max("df").alias("df"), F.min("distance").alias("distance"))


def match_titles(titles: DataFrame, prefix: str) -> DataFrame:
    """title, rank of the titles that prefix begins, or begins a word of."""
    return titles.withColumn("rank", match_rank(F.col("folded"), prefix)).where("rank >= 0").select("title", "rank")


def autocomplete(index: Index | None, prefix: str, top: int = 10, most_edits: int = MOST_EDITS) -> DataFrame:
    """ord, text, is_correction: up to five words, then titles; what was there in another case isn't repeated."""
    if not prefix or not prefix.strip():
        raise ValueError("empty prefix")
    if index is None:
        raise IndexNotReady("no vocabulary yet")
    folded = exact.fold(prefix)
    words = fuzzy_words(index.prefixes, folded, exact.edit_budget(len(folded), most_edits)).orderBy("distance", F.desc("df"), F.length("term"), "term").limit(WORDS)
    words = words.select(F.lit(0).alias("src"), F.struct(F.col("distance").cast("long").alias("distance"), (-F.col("df")).alias("less"), F.length("term").alias("n"), F.col("term").alias("t")).alias("ord"), F.col("term").alias("text"), (F.col("distance") > 0).alias("is_correction"))
    own = match_titles(index.titles, folded)
    if own.limit(1).count() == 0 and (first := words.orderBy("ord").first()):
        own = match_titles(index.titles, first.text)
    own = own.orderBy("rank", F.length("title"), "title").limit(max(top, 0) + WORDS)
    own = own.select(F.lit(1).alias("src"), F.struct(F.col("rank").cast("long").alias("distance"), F.lit(0).cast("long").alias("less"), F.length("title").alias("n"), F.col("title").alias("t")).alias("ord"), F.col("title").alias("text"), F.lit(False).alias("is_correction"))
    both = words.unionByName(own)  # a few rows by now
    once = both.withColumn("k", F.row_number().over(Window.partitionBy(F.lower("text")).orderBy("src", "ord"))).where("k = 1")
    placed = once.withColumn("ord", F.row_number().over(Window.orderBy("src", "ord")))
    return placed.where((F.col("src") == 0) | (F.col("ord") <= top)).select("ord", "text", "is_correction")
