"""The positional index as tables: postings by term, phrases, statistics, vocabulary, prefixes, titles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import scan
from textloom.functions.language import detect_languages
from textloom.functions.text import case_key, fold
from textloom.sources.shared import fresh

TOP = 10
VERSION = 1
#: top_phrases: the words whose phrases are counted first, and the most words that workers look up; beyond that all phrases are counted.
FREQUENT, MOST_WORDS = 500, 1 << 18


def tokens(pages: DataFrame) -> DataFrame:
    """doc_id, field, pos, token, start, end. Offsets count characters; a token begins at its first dot. Nothing is shuffled."""
    scan.lean(pages.sparkSession)
    fields = pages.select("doc_id", F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("text")), F.struct(F.lit("content").alias("field"), F.col("content").alias("text")))).alias("f"))
    own = fields.select("doc_id", "f.field", scan.token_spans(F.col("f.text")).alias("s")).select("doc_id", "field", F.explode("s").alias("s"))
    return own.select("doc_id", "field", "s.pos", "s.token", "s.start", "s.end")


def token_arrays(pages: DataFrame) -> DataFrame:
    """doc_id, title_tokens, content_tokens: enough for counts and phrases, without a shuffle."""
    scan.lean(pages.sparkSession)
    return pages.select("doc_id", scan.token_list(F.col("title")).alias("title_tokens"), scan.token_list(F.col("content")).alias("content_tokens"))


def lengths(pages: DataFrame) -> DataFrame:
    """doc_id, length_title, length_content: tokens after the removals; 0 for pages without any."""
    scan.lean(pages.sparkSession)
    return pages.select("doc_id", scan.token_count(F.col("title")).alias("length_title"), scan.token_count(F.col("content")).alias("length_content"))


def stats(lengths: DataFrame) -> DataFrame:
    """One row; pages without tokens count."""
    return lengths.agg(F.count("*").alias("total_docs"), F.coalesce(F.avg("length_title"), F.lit(0.0)).alias("avg_length_title"), F.coalesce(F.avg("length_content"), F.lit(0.0)).alias("avg_length_content"))


def _grouped(rows: DataFrame, *keys: str) -> DataFrame:
    place = F.struct("start", "end")
    of = lambda field: F.array_sort(F.collect_list(F.when(F.col("field") == field, place)))
    return rows.groupBy(*keys, "doc_id").agg(F.count_if(F.col("field") == "title").cast("int").alias("tf_title"), F.count_if(F.col("field") == "content").cast("int").alias("tf_content"), of("title").alias("positions_title"), of("content").alias("positions_content"))


def postings(tokens: DataFrame) -> DataFrame:
    return _grouped(tokens.withColumnRenamed("token", "term"), "term")


def page_postings(pages: DataFrame, *more: str) -> DataFrame:
    """postings(tokens(pages)) of pages that have each doc_id once, and more of their columns: each page's are put together where its text stands, without a shuffle."""
    scan.lean(pages.sparkSession)
    own = pages.select("doc_id", *more, F.explode(scan.all_postings(F.col("title"), F.col("content"))).alias("p"))
    return own.select(F.col("p.key").alias("term"), "doc_id", "p.tf_title", "p.tf_content", "p.positions_title", "p.positions_content", *more)


def ngrams(tokens: DataFrame, sizes=(2, 3)) -> DataFrame:
    """doc_id, field, phrase, size, start, end: runs of tokens as they stand after the removals."""
    order = Window.partitionBy("doc_id", "field").orderBy("pos")
    ahead = tokens
    for k in range(1, max(sizes)):
        ahead = ahead.withColumn(f"t{k}", F.lead("token", k).over(order)).withColumn(f"e{k}", F.lead("end", k).over(order))
    runs = F.array(*[F.struct(F.concat_ws("_", "token", *[f"t{k}" for k in range(1, n)]).alias("phrase"), F.lit(n).alias("size"), F.col(f"e{n - 1}").alias("end")) for n in sizes])
    return ahead.select("doc_id", "field", "start", F.explode(runs).alias("r")).where("r.end IS NOT NULL").select("doc_id", "field", "r.phrase", "r.size", "start", "r.end")


def phrase_postings(tokens: DataFrame) -> DataFrame:
    return _grouped(ngrams(tokens), "phrase", "size")


def vocabulary(postings: DataFrame) -> DataFrame:
    """term, df: pages with the term in either field."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def prefix_top(vocab: DataFrame, top: int = TOP) -> DataFrame:
    """prefix, term, df, rnk: for each prefix its most frequent terms."""
    all_prefixes = vocab.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda n: F.substring("term", F.lit(1), n))).alias("prefix"), "term", "df")
    order = Window.partitionBy("prefix").orderBy(F.desc("df"), "term")
    return all_prefixes.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= top)


def titles(pages: DataFrame) -> DataFrame:
    """title, folded: distinct whatever the case, in the spelling of the first page; blank ones left out."""
    own = pages.where(F.trim("title") != "").groupBy(case_key(F.col("title")).alias("key")).agg(F.min_by("title", "doc_id").alias("title"))
    return own.select("title", fold(F.col("title")).alias("folded"))


@dataclass
class Index:
    pages: DataFrame
    tokens: DataFrame
    postings: DataFrame
    phrases: DataFrame
    meta: DataFrame
    stats: DataFrame
    vocab: DataFrame
    prefixes: DataFrame
    titles: DataFrame
    stored: bool = False
    #: The tables are plans over pages, so that reading any of them reads all texts.
    lazy: bool = False
    _vocab_written: bool = False

    def known_terms(self) -> DataFrame:
        """The vocabulary; one that is but a plan is written to the shared folder at its first use and stays with this object."""
        if self.lazy and not self._vocab_written:
            spark, path = self.pages.sparkSession, fresh(self.pages.sparkSession, "vocab")
            self.vocab.write.parquet(path)
            self.vocab, self._vocab_written = spark.read.parquet(path), True
        return self.vocab

    def refresh(self) -> Index:
        """A new object with vocabulary, prefixes and titles of the tables as they are; readers keep the old one until they take it."""
        vocab = vocabulary(self.postings)
        return Index(self.pages, self.tokens, self.postings, self.phrases, self.meta, self.stats, vocab, prefix_top(vocab), titles(self.pages))


def build(pages: DataFrame, languages: bool = True) -> Index:
    """All tables of pages (doc_id, url, title, content), lazily."""
    pages = pages.where("doc_id IS NOT NULL")
    own = tokens(pages)
    posts, meta = postings(own), lengths(pages)
    if languages:
        guess = detect_languages(pages.select("doc_id", F.concat_ws(" ", "title", "content").alias("text")))
        meta = meta.join(guess.select("doc_id", "language"), "doc_id", "left")
    else:
        meta = meta.withColumn("language", F.lit(None).cast("string"))
    vocab = page_terms(pages)
    return Index(pages, own, posts, phrase_postings(own), meta, stats(meta), vocab, prefix_top(vocab), titles(pages), lazy=True)


def page_terms(pages: DataFrame) -> DataFrame:
    """vocabulary() of pages that aren't indexed yet."""
    return scan.counts(pages, scan.distinct_words).select(F.col("key").alias("term"), F.col("n").alias("df"))


def top_phrases(pages: DataFrame, top: int) -> DataFrame:
    """phrase, size, df of the runs of two and three tokens that most pages have; of fewer tokens, then by the phrase, if as many have them.

    No phrase is in more pages than each of its words. So the phrases of frequent words are counted first, all of them; as
    many pages as have the last of the best of these are needed at least, and words of fewer pages can't be in the result.
    """
    spark = pages.sparkSession
    order = (F.desc("df"), "size", "phrase")

    def best(kept) -> DataFrame:
        # tokens have no underscores
        own = scan.counts(pages, scan.phrases_of(kept)).select(F.col("key").alias("phrase"), F.size(F.split("key", "_")).alias("size"), F.col("n").alias("df"))
        return own.orderBy(*order).limit(top)

    path = fresh(spark, "vocab")
    page_terms(pages).write.parquet(path)
    vocab = spark.read.parquet(path)
    first = {r.term for r in vocab.orderBy(F.desc("df"), "term").limit(FREQUENT).collect()}
    found = best(first).collect()
    least = found[-1].df if len(found) == top else 0
    enough = vocab.where(F.col("df") >= least).select("term").limit(MOST_WORDS + 1).collect() if least > 1 else []
    if 0 < len(enough) <= FREQUENT:  # the words of the first count, or some of them
        return spark.createDataFrame(found, "phrase string, size int, df long").orderBy(*order)
    return best({r.term for r in enough} if 0 < len(enough) <= MOST_WORDS else None)


def asked(pages: DataFrame, terms: list[str], runs: list[str], positions: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings of terms, postings of runs, lengths) of pages that aren't indexed, in one pass over their texts, written to the shared folder.

    Places are those in the content, if asked for; of runs only the counts are there.
    """
    spark = pages.sparkSession
    scan.lean(spark)
    path = fresh(spark, "asked")
    pages.select("doc_id", scan.asked_postings(terms, runs, positions)(F.col("title"), F.col("content")).alias("f")).select("doc_id", "f.*").write.parquet(path)
    all_found = spark.read.parquet(path)

    def of(column: str, key: str) -> DataFrame:
        rows = all_found.select("doc_id", F.explode(column).alias("p")).select(F.col("p.key").alias(key), "doc_id", "p.tf_title", "p.tf_content", "p.positions_content")
        return rows.groupBy(key, "doc_id").agg(F.sum("tf_title").cast("int").alias("tf_title"), F.sum("tf_content").cast("int").alias("tf_content"), F.array_sort(F.flatten(F.collect_list("positions_content"))).alias("positions_content"))

    return of("terms", "term"), of("phrases", "phrase"), all_found.select("doc_id", "length_title", "length_content")


TABLES = ("pages", "tokens", "postings", "phrases", "meta", "stats", "vocab", "prefixes", "titles")
#: What lookups filter on: files are sorted by it, so that Parquet's statistics skip what doesn't match.
KEYS = {"postings": "term", "phrases": "phrase", "vocab": "term", "prefixes": "prefix", "meta": "doc_id", "pages": "doc_id"}


def save(index: Index, base: str) -> None:
    """All tables below base. Texts are tokenized once: the other tables are made of the tokens, and of each other, as written."""
    spark = index.pages.sparkSession
    _write(index.tokens, base, "tokens")
    written = lambda name: spark.read.parquet(f"{base}/{name}")
    own = written("tokens")
    for name, table in (("postings", postings(own)), ("phrases", phrase_postings(own)), ("meta", index.meta), ("pages", index.pages), ("titles", index.titles)):
        _write(table, base, name)
    for name, of, make in (("stats", "meta", stats), ("vocab", "postings", vocabulary), ("prefixes", "vocab", prefix_top)):
        _write(make(written(of)), base, name)
    spark.createDataFrame([(VERSION,)], "version int").coalesce(1).write.mode("overwrite").json(f"{base}/version")


def _write(df: DataFrame, base: str, name: str) -> None:
    if key := KEYS.get(name):
        df = df.repartitionByRange(key).sortWithinPartitions(key)
    df.write.mode("overwrite").parquet(f"{base}/{name}")


def load(spark: SparkSession, base: str) -> Index:
    return Index(**{name: spark.read.parquet(f"{base}/{name}") for name in TABLES}, stored=True)


def ensure(spark: SparkSession, pages: DataFrame, base: str) -> tuple[Index, str]:
    """Build what isn't there, rebuild what another version or other columns made, else leave it; and which of these it was."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.schema("version int").json(f"{base}/version").first()
        made, there = build(pages), load(spark, base)
        same = all({(f.name, f.dataType.simpleString()) for f in getattr(made, n).schema} == {(f.name, f.dataType.simpleString()) for f in getattr(there, n).schema} for n in TABLES)
        state = "kept" if found and found.version == VERSION and same else "updated"
    except AnalysisException:
        state = "created"
    if state != "kept":
        save(build(pages), base)
    return load(spark, base), state


def lookup(table: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows of an index table for a list of terms or phrases; the filter reaches the scan."""
    return table.where(F.col(column).isin(list(dict.fromkeys(values))))


def replaced_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages (columns of new) with all rows of new's pages replaced by new. Ids meet in a hash table, so that texts are neither sorted nor shuffled more than once."""
    ids = new.select("doc_id").distinct().hint("shuffle_hash")
    return old.join(ids, "doc_id", "left_anti").select(new.columns).unionByName(new)


def replace(old: DataFrame, new: DataFrame, pages: DataFrame) -> DataFrame:
    """A table with all rows of these pages (doc_id) replaced by new."""
    return old.join(pages.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)
