"""Line dedup: runs of lines that occur earlier in the corpus are deleted, by prefix doubling over line ids.

The corpus is one sequence of line ids, cut at the ends of documents; lines without words aren't part of it. Level k of
the doubling names the class of the 2**k lines that begin at a position by the classes of its two halves, as in sorting a
suffix array; only positions whose class has several members go on, until none are left. A class is an interval of
suffixes with a common prefix of 2**k lines or more, and all its members but the earliest are later copies. For every
position the largest k with an earlier copy is enough: the union of these stretches is the union of the maximal repeated
runs, because the last 2**k lines of a longer run are such a stretch of their own. A run counts from min_lines lines
(a power of two; by default one: every later copy of a line goes), or if it is a line of at least long_line words. Lines
without words between deleted ones go as well.

Classes are digests of 128 bits, counted with partial aggregation and joined back, so that a line that a third of all
documents share is one counter. All of it is SQL functions. Texts are shuffled once, to meet their ranges.

Nulls: a null text has no lines and stays null; an empty text stays empty. A null doc_id comes after all others. Rows that
agree in doc_id and text are one document and are treated alike. Long texts cost time in proportion to their lines. Other
columns, whatever their names, are carried along. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import WORD, settled, table

MIN_LINES, LONG_LINE = 1, 30
_DOC = ["d", "h"]


def _lines(text):
    """The array of (at, line) of the lines with words; at: the place among all lines."""
    every = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    return F.filter(every, lambda x: F.regexp_like(x["line"], F.lit(WORD)))


def _identity(documents: DataFrame) -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64("text").alias("h")]


def _repeated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (d, h, pos, a, b) whose class (a, b) has several places, with the earliest of them; and what of them is later."""
    place = F.struct("d", "h", "pos")
    # written first: a join of two plain shuffles is one whose hot keys Spark can split
    classes = settled(rows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last"), "classes")
    own = settled(rows.join(classes.select("a", "b", "first").hint("merge"), ["a", "b"]), "lines")
    return own.drop("first"), own.where(place > F.col("first"))


def copied_ranges(documents: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """d, h (a document), ranges: array of (s, e) over its lines with words that are later copies; longest: the longest stretch found."""
    low = min_lines.bit_length() - 1
    if min_lines != 1 << low:
        raise ValueError("min_lines must be a power of two")
    ids = documents.select(*_identity(documents), "text").where("text IS NOT NULL")
    lines = ids.select(*_DOC, F.posexplode(_lines(F.col("text"))).alias("pos", "l"))
    words = F.regexp_count("l.line", F.lit(WORD))
    rows = lines.select(*_DOC, "pos", F.xxhash64("l.line").alias("a"), F.xxhash64(F.lit(7), "l.line").alias("b"), (words >= long_line).alias("long"))
    active, later = _repeated(rows)
    found = [later.select(*_DOC, "pos", F.lit(1).alias("n")) if low == 0 else later.where("long").select(*_DOC, "pos", F.lit(1).alias("n"))]
    active, k = active.drop("long"), 0
    while active.limit(1).count():
        step = 1 << k
        ahead = active.select(*_DOC, (F.col("pos") - step).alias("pos"), F.col("a").alias("a2"), F.col("b").alias("b2")).where("pos >= 0")
        both = active.join(ahead, [*_DOC, "pos"]).select(*_DOC, "pos", F.xxhash64("a", "b", "a2", "b2").alias("a"), F.xxhash64(F.lit(7), "b2", "a2", "b", "a").alias("b"))
        active, later = _repeated(both)
        k += 1
        if k >= low:
            found.append(later.select(*_DOC, "pos", F.lit(1 << k).alias("n")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    # of one place, the longest; then places that meet make one range
    longest = every.groupBy(*_DOC, "pos").agg(F.max("n").alias("n"))
    before = Window.partitionBy(*_DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    opened = longest.withColumn("open", (F.col("pos") > F.coalesce(F.max(F.col("pos") + F.col("n")).over(before), F.lit(-1))).cast("int"))
    numbered = opened.withColumn("run", F.sum("open").over(Window.partitionBy(*_DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*_DOC, "run").agg(F.min("pos").alias("s"), F.max(F.col("pos") + F.col("n")).alias("e"), F.max("n").alias("n"))
    return runs.groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("ranges"), F.max("n").alias("longest"))


def dedup(documents: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """doc (the whole row), kept (its text without later copies), n_lines (with words), n_removed, n_runs, longest."""
    ranges = settled(copied_ranges(documents, min_lines, long_line), "ranges")
    rows = documents.select(F.struct("*").alias("doc"), "text", *_identity(documents))
    # a merge join at every size: a broadcast of the ranges would only hold for small inputs
    both = rows.join(ranges.hint("merge"), _DOC, "left").withColumn("w", _lines(F.col("text")))
    # over all lines: kept up to a range, then gone as far as its last line
    edge = lambda i: F.element_at("cut", i)
    both = both.withColumn("cut", F.transform("ranges", lambda r: F.struct(F.element_at("w", r["s"] + 1)["at"].alias("s"), (F.element_at("w", r["e"])["at"] + 1).alias("e"))))
    ahead = F.transform("cut", lambda r, i: F.concat(F.array_repeat(F.lit(True), r["s"] - F.when(i == 0, 0).otherwise(edge(F.greatest(i, F.lit(1)))["e"])), F.array_repeat(F.lit(False), r["e"] - r["s"])))
    both = both.withColumn("stay", F.flatten(ahead))
    lines = F.filter(F.split("text", "\n"), lambda x, i: F.coalesce(F.try_element_at("stay", i + 1), F.lit(True)))
    kept = F.when(F.col("ranges").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    removed = F.coalesce(F.aggregate("ranges", F.lit(0), lambda n, r: n + r["e"] - r["s"]), F.lit(0))
    return both.select("doc", kept.alias("kept"), F.coalesce(F.size("w"), F.lit(0)).alias("n_lines"), removed.alias("n_removed"), F.coalesce(F.size("ranges"), F.lit(0)).alias("n_runs"), F.coalesce("longest", F.lit(0)).alias("longest"))


def without_copies(documents: DataFrame, **options) -> DataFrame:
    """The documents with their later copies of lines deleted; those of which nothing with words is left go."""
    out = dedup(documents, **options)
    kept = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return kept.select(*[(F.col("kept") if c == "text" else F.col("doc").getField(c)).alias(c) for c in documents.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc.doc_id", "n_lines", "n_removed", "n_runs", F.length("kept").cast("long").alias("kept_chars"), F.md5("kept").alias("kept_md5"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS spot FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot) - 1 AS pos FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
g AS (SELECT *, min(struct_pack(d := doc_id, p := pos)) OVER (PARTITION BY line) < struct_pack(d := doc_id, p := pos) AS gone FROM w),
-- lines that meet belong to one run
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM g),
b AS (SELECT l.doc_id, l.spot, l.line, r.gone, last_value(r.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.spot ROWS UNBOUNDED PRECEDING) AS before,
        first_value(r.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.spot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.spot = r.spot),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY spot) AS kept FROM b WHERE NOT coalesce(gone, before AND after, false) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_runs FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed, coalesce(n_runs, 0)::INT AS n_runs,
  CASE WHEN d.text IS NOT NULL THEN length(coalesce(kept, '')) END AS kept_chars, CASE WHEN d.text IS NOT NULL THEN md5(coalesce(kept, '')) END AS kept_md5
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
