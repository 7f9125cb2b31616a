"""From raw documents to training ids: judge quality, drop repeated lines and near copies, mix the sources, encode.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, as the next stage's docs; the last gives ids.
The fourth puts the documents in training order: that of its rows, file by file as Spark numbers them; the last reads the
order off the files, gives it as position and sorts by it. Nulls, empty and very long texts, ties, repeated rows, empty
tables and other columns are treated as each operator's docstring says; of rows alike in doc_id and text the one whose
columns have the smallest hash stays. A row that comes to the last stage from no file has the place it has in docs.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import jaccard, lines, mixing, pieces, quality
from textloom.llm.common import settled, table


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality field accepts; it learns from those that are labelled and not held out."""
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("score") >= quality.THRESHOLD).select("doc.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that occur earlier; those that were nothing else go."""
    return _measured(lines.without_copies(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by Jaccard similarity the one with the smallest id; documents without an id all stay."""
    found = jaccard.groups(docs)
    first = found.where("component_id = doc_id").select(F.col("doc_id").alias("__id")).distinct()
    rows = docs.join(first.hint("merge"), docs.doc_id == first["__id"], "left_semi")
    # rows alike in doc_id and text are aggregated before they meet: one document may be any part of the rows
    whole = F.struct(*docs.columns)
    once = rows.groupBy(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text")).agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("__row"))
    return once.select("__row.*").unionByName(docs.where("doc_id IS NULL"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, whole, repeated or left out as the weights of their sources ask."""
    return _measured(mixing.mixture(docs, whole=True))


def _in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and position, the place of each row: file, then row."""
    try:
        own = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # not read from files
        return docs.select("doc_id", "text").withColumn("position", F.monotonically_increasing_id())
    number = lambda pattern: F.coalesce(F.regexp_extract("file", pattern, 1).try_cast("long"), F.lit(0))
    return own.select("doc_id", "text", (number(r"^part-(\d+)") * (1 << 44) + number(r"-c(\d+)\.") * (1 << 32) + F.col("row")).alias("position"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, position (rising in training order) and SentencePiece ids, sorted by position."""
    ids = pieces.encode(_in_order(docs), carry=("position",))
    return ids.repartitionByRange("position").sortWithinPartitions("position")


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mixed_sources),
    ("SentencePiece encoding", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settled(docs, f"stage-{k}")
    return docs
