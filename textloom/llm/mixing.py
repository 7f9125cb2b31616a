"""Mixing sources to target weights: a time-varying curriculum in words.

Every source has a target in words (weights share the total; a source gives at most max_repeats times its size, and what
it can't give goes to the others by weight). Its documents, in an order drawn by hash, pass by up to max_repeats times
until the target is reached; the last of them counts with the words that still fit or, if whole is set, with all its
words or none, whichever is nearer to the target (with all on a tie). Each occurrence then has a place x
in its source's demand, from 0 to 1, and the source's weight schedule w(t), integrated over training time and inverted
at x, gives the time t at which it is read. Sorting by t mixes the sources at each moment by their weights then.

A hot source is no hot task: running sums go over the source's 4096 hash buckets first, then within each bucket.

Nulls: a null text has 0 words; a null source is a source of its own, after all others; a null doc_id is drawn as ''.
Documents without words are never taken. Ties and repeated rows: rows with one doc_id follow each other by size.
Other columns, whatever their names, are carried along. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import WORD, settled, table

#: Knots (time, weight) of the schedules of the sources that weigh 1, 2 and 3: the lighter come early, the heavier late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))


def targets(sizes: DataFrame, weights=(1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """source, source_size, slot (its place in weights), target. One row a source passes through one task, no more."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    slot = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    own = by_source.withColumn("slot", slot).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("slot") + 1).cast("double"))
    own = own.withColumn("most", F.col("source_size") * max_repeats).withColumn("level", F.col("most") / F.col("weight"))
    # Water filling: from the source that is full first; level: the share per weight at which it is
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    own = own.withColumn("reach", (F.sum("source_size").over(every) - before) / left).withColumn("full", F.col("level") < F.col("reach"))
    share = F.min_by(F.when(~F.col("full"), F.col("reach")), F.when(~F.col("full"), F.struct("level", F.col("source").isNull(), "source"))).over(every)
    return own.withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("weight") * share))).select("source", "source_size", "slot", "target")


def _time(x, knots):
    """The t at which the integral of the schedule, as a part of the whole, is x."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole, done, out = sum(areas), 0.0, F.lit(float(knots[-1][0]))
    for k in reversed(range(len(areas))):
        done = sum(areas[:k])
        (t, a), (u, b) = knots[k], knots[k + 1]
        r = F.greatest(x * whole - done, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(float(a * a)) + r * (2.0 * (b - a) / (u - t)), F.lit(0.0)))
        inside = F.lit(float(t)) + 2.0 * r / (F.lit(float(a)) + root)
        out = inside if k == len(areas) - 1 else F.when(x * whole < done + areas[k], inside).otherwise(out)
    return out


def mix(documents: DataFrame, weights=(1, 2, 3), max_repeats: int = 3, schedules=SCHEDULES, carry=None, whole: bool = False) -> DataFrame:
    """doc (the row, or those of its columns that carry names), size, source_size, target, taken (words), occurrences: array of (copy, words, position)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # a key that is never null: the window's partitioning then serves the join too
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    rows = documents.select(F.struct(*(carry or ["*"])).alias("doc"), F.col("doc_id").alias("id"), key.alias("key"), F.substring(draw, 1, 3).alias("bucket"), draw.alias("draw"), size.alias("size"))
    if carry:  # without texts: counted once
        rows = settled(rows, "sizes")
        counted = rows
    else:
        counted = documents.select(key.alias("key"), F.substring(draw, 1, 3).alias("bucket"), size.alias("size"))
    source = F.when(F.col("key") != "", F.expr("substring(key, 2)"))
    sums = settled(counted.groupBy("key", "bucket").agg(F.sum("size").alias("size")), "sums").withColumn("source", source)
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("key", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    goals = targets(sums, weights, max_repeats).withColumn("key", key)
    plan = offsets.join(goals, "key").select("key", "bucket", "offset", "source_size", "slot", "target")
    within = Window.partitionBy("key", "bucket").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    both = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(plan, ["key", "bucket"])
    goal = F.floor(F.col("target") + 0.5)
    passes = []
    for k in range(max_repeats):
        begin = F.col("source_size") * k + F.col("offset") + F.col("before")
        if whole:  # at least half fits; the middle of the document is then within the demand
            words = F.when(2 * (goal - begin) >= F.col("size"), F.col("size")).otherwise(0).cast("long")
        else:
            words = F.greatest(F.least(goal - begin, F.col("size")), F.lit(0)).cast("long")
        x = (begin + words / 2) / F.greatest(goal, F.lit(1))
        at = F.coalesce(*[F.when(F.col("slot") == s, _time(x, knots)) for s, knots in enumerate(schedules)])
        passes.append(F.struct(F.lit(k).alias("copy"), words.alias("words"), at.alias("position")))
    occurrences = F.filter(F.array(*passes), lambda o: o["words"] > 0)
    taken = F.aggregate("occurrences", F.lit(0).cast("long"), lambda n, o: n + o["words"])
    out = both.select("doc", "size", "source_size", "target", occurrences.alias("occurrences"))
    return out.withColumn("taken", taken)


def mixture(documents: DataFrame, **options) -> DataFrame:
    """The documents in training order, a row for each time that one is read. Where a source's target ends within a document, its text ends there, unless whole is set."""
    read = mix(documents, **options).select("doc", "size", F.explode("occurrences").alias("o"))
    # cut before the space after the last word that fits
    words = F.split("doc.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col("o.words") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("o.words").cast("int")), "")).otherwise(F.col("doc.text"))
    columns = [text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in documents.columns]
    kept = read.select(F.struct(*columns).alias("doc"), F.col("o.position").alias("position"), F.col("o.copy").alias("copy"))
    order = ["position", "doc.doc_id", "copy"]
    return kept.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("doc.*")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it, range-sorted by the time at which it is first read; those not taken come last."""
    first = F.round(F.element_at("occurrences.position", 1), 9)
    out = mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    placed = out.select("doc.doc_id", "size", "source_size", "target", "taken", F.when(F.size("occurrences") > 0, first).alias("first_position"))
    order = [F.col("first_position").asc_nulls_last(), F.col("doc_id")]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order)


SQL = r"""
WITH d AS (SELECT doc_id, source, md5(doc_id::VARCHAR) AS draw,
             coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS slot FROM d GROUP BY source),
l AS (SELECT *, 3 * source_size AS most, 3 * source_size / (slot + 1)::DOUBLE AS level FROM s),
r AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(slot + 1) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS reach FROM l),
f AS (SELECT *, CASE WHEN level < reach THEN most::DOUBLE ELSE least(most::DOUBLE, (slot + 1) *
           (SELECT reach FROM r WHERE NOT level < reach ORDER BY level, source NULLS LAST LIMIT 1)) END AS target FROM r),
w AS (SELECT d.*, source_size, slot, target, floor(target + 0.5)::BIGINT AS goal, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
t AS (SELECT *, greatest(least(goal - start, size), 0) + greatest(least(goal - start - source_size, size), 0)
           + greatest(least(goal - start - 2 * source_size, size), 0) AS taken,
           (start + greatest(least(goal - start, size), 0) / 2) / greatest(goal, 1)::DOUBLE AS x FROM w)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, CASE WHEN taken > 0 THEN round(CASE slot
    WHEN 0 THEN 2 * x / (1.5 + sqrt(2.25 - 2 * x))
    WHEN 1 THEN x
    ELSE CASE WHEN x < 0.3125 / 1.0 * 1.0 AND x * 1.0 < 0.3125 THEN 2 * x / (0.5 + sqrt(0.25 + x)) ELSE 0.5 + 2 * (x - 0.3125) / (0.75 + sqrt(0.5625 + 5 * (x - 0.3125))) END END, 9) END AS first_position
FROM t
"""
