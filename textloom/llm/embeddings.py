"""Embedding near-dedup: an exact range join on unit vectors under the angle between them.

Within a label, pivots partition the vectors: each belongs to its nearest pivot if that is within 2 r (r: the angle of the
threshold), else to the label's rest. By the triangle inequality a neighbour of a pivot's vector lies within 3 r of the
pivot and at most 2 r farther from it than from its own pivot, and a neighbour of the rest is more than r from its own
pivot; it is copied into each such cell. So a cell holds all neighbours of its own vectors, and cells join independently,
as blocks of bounded size. In many dimensions vectors that are far from all pivots are about as far from each other, so
that no bound separates them: the rest is compared block by block. Equal vectors are one class.

Pivots only steer the work. They are fitted on a bounded sample (SAMPLE rows a label and salt) and sent to the workers:
MOST_PIVOTS of them at most. Labels with fewer than SMALL classes have one cell.

Nulls: a null label, and a vector that is null, empty, zero or holds null or non-finite numbers, links with nothing.
Vectors of different lengths don't link. Repeated rows, also of one vec_id, are vectors of their own and count as links.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import settled, table
from textloom.llm.components import components

SMALL, SAMPLE, SALTS, PIVOTS, MOST_PIVOTS, BLOCK = 2048, 128, 16, 64, 16384, 1024


def _valid(batches):
    for b in batches:
        out = {"vec_id": [], "label": [], "key": [], "vector": []}
        for i, label, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            x = None
            if v and label is not None and None not in v:
                x = np.array(v, dtype=np.float64) + 0.0
                top = np.abs(x).max()
                x = x / top if np.isfinite(top) and top > 0 else None
            out["vec_id"].append(i)
            out["label"].append(label)
            out["vector"].append(None if x is None else (x / np.sqrt((x * x).sum())).tobytes())
            out["key"].append(None if x is None else hashlib.blake2b(np.array(v, dtype=np.float64).tobytes(), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([pa.array(out["vec_id"], pa.int64()), pa.array(out["label"], b.schema.field(1).type), pa.array(out["key"], pa.binary()), pa.array(out["vector"], pa.binary())], list(out))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _pivots(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one label's sample: farthest-first pivots, so that each dense region gets one."""
    dims = rows["vector"].map(len).mode()[0]
    rows = rows[rows["vector"].map(len) == dims].sort_values("rep")
    x = _matrix(rows["vector"])
    chosen, far = [0], _angles(x, x[:1])[:, 0]
    while len(chosen) < min(PIVOTS, len(x)) and far.max() > 0.3:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _angles(x, x[chosen[-1:]])[:, 0])
    return rows.iloc[chosen][["label", "vector"]]


def _cells(angle: float, pivots: dict):
    """Sends each class to its own cell, and as a visitor to all that may hold a neighbour. Cell -1 is the rest."""
    core = 2 * angle

    def places(x: np.ndarray, p: np.ndarray | None):
        """(who, cell, whether it is who's own)."""
        n = len(x)
        if p is None or p.shape[1] != x.shape[1]:
            return np.arange(n), np.full(n, -1), np.ones(n, dtype=bool)
        d = _angles(x, p)
        home = d.argmin(axis=1)
        base = d[np.arange(n), home]
        inner = base <= core
        who, to = np.nonzero((d <= base[:, None] + 2 * angle + 1e-9) & (d <= core + angle + 1e-9))
        mine = inner[who] & (home[who] == to)
        rest = np.flatnonzero(base > core - angle - 1e-9)
        return np.concatenate([who, rest]), np.concatenate([to, np.full(len(rest), -1)]), np.concatenate([mine, ~inner[rest]])

    def run(batches):
        for b in batches:
            labels, sizes = b.column("label").to_pylist(), pc.binary_length(b.column("vector")).to_pylist()
            by: dict = {}
            for k, at in enumerate(zip(labels, sizes, strict=True)):
                by.setdefault(at, []).append(k)
            for (label, dims), own in by.items():
                part = b.take(pa.array(own))
                who, cell, home = places(_matrix(part.column("vector").to_pylist()), pivots.get(label))
                out = part.select(["label", "rep", "n", "vector"]).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array([f"{dims}/{c}" for c in cell.tolist()]), pa.array(home)], ["label", "rep", "n", "vector", "cell", "home"])

    return run


def _join(threshold: float):
    """Of one block of a cell: the weight of the links of its own vectors, and for each the smallest id of its part of the block's graph."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mine, other = rows[rows["side"] == 0], rows[rows["side"] == 1]
        empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "n_links": pd.Series(dtype="int64")})
        if not len(mine) or not len(other):
            return empty
        x, y = _matrix(mine["vector"]), _matrix(other["vector"])
        near = x @ y.T
        # a product of matrices rounds by the shape of the block: what is close to the threshold is summed alike in every block
        edge = np.nonzero(np.abs(near - threshold) < 1e-9)
        near = near >= threshold
        near[edge] = (x[edge[0]] * y[edge[1]]).sum(axis=1) >= threshold
        ids, others = mine["rep"].to_numpy(), other["rep"].to_numpy()
        near &= ids[:, None] != others[None, :]
        weight = near @ other["n"].to_numpy().astype(np.float64)
        low, high = ids.copy(), others.copy()
        top = np.iinfo(np.int64).max
        while True:
            a = np.minimum(low, np.where(near, high[None, :], top).min(axis=1))
            b = np.minimum(high, np.where(near, a[:, None], top).min(axis=0))
            if (a == low).all() and (b == high).all():
                break
            low, high = a, b
        linked, met = near.any(axis=1), near.any(axis=0)
        return pd.concat([
            pd.DataFrame({"a": ids[linked], "b": low[linked], "n_links": weight[linked].astype(np.int64)}),
            pd.DataFrame({"a": others[met], "b": high[met], "n_links": np.zeros(met.sum(), dtype=np.int64)}),
        ])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, label, embedding)."""
    angle = float(np.arccos(threshold))
    kind = vectors.schema["label"].dataType.simpleString()
    rows = settled(vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>")).mapInArrow(_valid, f"vec_id long, label {kind}, key binary, vector binary"), "vectors")
    classes = settled(rows.where("key IS NOT NULL").groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min("vector").alias("vector")), "classes")
    # pivots of the labels that need them: a bounded sample by hash
    large = classes.groupBy("label").count().where(F.col("count") > SMALL).orderBy(F.desc("count"), "label").limit(MOST_PIVOTS // PIVOTS)
    salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS))
    sample = classes.join(large, "label", "left_semi").withColumn("draw", F.xxhash64("rep", F.lit(7)))
    sample = _few(sample, salt)
    found = sample.groupBy("label").applyInPandas(_pivots, f"label {kind}, vector binary").collect()
    by_label: dict = {}
    for r in found:
        by_label.setdefault(r["label"], []).append(bytes(r["vector"]))
    pivots = {k: _matrix(v) for k, v in by_label.items()}
    dealt = settled(classes.select("label", "rep", "n", "vector").mapInArrow(_cells(angle, pivots), f"label {kind}, rep long, n long, vector binary, cell string, home boolean"), "cells")
    sizes = dealt.groupBy("label", "cell").agg(F.count("*").alias("all"), F.count_if("home").alias("own")).where("own > 0").select("label", "cell", F.ceil(F.col("own") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("all") / BLOCK).cast("int").alias("cols"))
    sized = dealt.join(sizes, ["label", "cell"])
    at = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    mine = sized.where("home").withColumn("row", at("rows", 1)).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))).withColumn("side", F.lit(0))
    other = sized.withColumn("col", at("cols", 2)).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("side", F.lit(1))
    # dealt by block: what is dealt by cell would keep all blocks of a large cell in one task
    blocks = mine.unionByName(other).select("label", "cell", "row", "col", "side", "rep", "n", "vector").repartition("label", "cell", "row", "col")
    joined = settled(blocks.groupBy("label", "cell", "row", "col").applyInPandas(_join(threshold), "a long, b long, n_links long"), "joined")
    parts = components(joined.select("a", "b"))
    links = joined.groupBy(F.col("a").alias("rep")).agg(F.sum("n_links").alias("n_links"))
    known = classes.select("label", "key", "rep", "n").join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    out = rows.select("vec_id", "label", "key").join(known, ["label", "key"], "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", F.when(F.col("rep").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _few(sample: DataFrame, salt) -> DataFrame:
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("label", "salt").orderBy("draw", "rep"))
    return sample.withColumn("salt", salt).withColumn("k", order).where(F.col("k") <= SAMPLE).select("label", "rep", "vector")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        AND list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id, vec_id <= coalesce(least.b, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id
"""
