"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. A line's features are shares of byte classes, word statistics and repetition, of itself and of
its two neighbours; transitions tie neighbouring labels. Forward-backward gives each line's probability of being good,
and a document's score is their mean, weighted by the lines' bytes. The field is trained by gradient ascent on documents
whose label all their lines take: a bounded sample, at most PER_CLASS documents of each label and LINES lines in all.

Nulls: a null text is an empty one, and that is one empty line with a score like any other. Labels that are null or not
0 or 1 teach nothing; a null doc_id is never held out. Repeated rows are scored one by one and equal texts alike. Of a
very long text the features of PART lines stand in memory at once, and two numbers for each line. Other columns, whatever
their names, are carried along in the struct doc. Without any usable label all scores are 0.5; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import lean_batches, settled, table
from textloom.llm.words import pieces, powers

PER_CLASS, LINES, ROUNDS, PART = 1500, 60_000, 250, 50_000
#: Bytes of text that are treated together.
TOGETHER = 1 << 20
THRESHOLD = 0.7

_LETTER, _DIGIT, _UPPER, _SYMBOL, _POINT, _BLANK, _HIGH = range(7)
_CLASS = np.zeros((7, 256), dtype=bool)
for _c in range(256):
    _s = chr(_c)
    _CLASS[_LETTER, _c] = _c > 127 or _s.isalpha()
    _CLASS[_DIGIT, _c] = _c < 128 and _s.isdigit()
    _CLASS[_UPPER, _c] = _c < 128 and _s.isupper()
    _CLASS[_POINT, _c] = _s in ".,;:!?'\"-()"
    _CLASS[_BLANK, _c] = _s in " \t\n\x0b\x0c\r"
    _CLASS[_HIGH, _c] = _c > 127
    _CLASS[_SYMBOL, _c] = _c < 128 and not (_CLASS[_LETTER, _c] or _CLASS[_DIGIT, _c] or _CLASS[_POINT, _c] or _CLASS[_BLANK, _c])
_ODD = 0x9E3779B97F4A7C15
OWN = 17
FEATURES = 1 + 3 * OWN


def line_features(data: np.ndarray, lines_of: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """[line, FEATURES] of lines data[starts:ends]; lines_of: each line's document. data ends with a newline."""
    n = len(starts)
    size = (ends - starts).astype(np.float64)
    share = np.zeros((7, n))
    for k in range(7):
        total = np.concatenate([[0], np.cumsum(_CLASS[k][data], dtype=np.int32)])
        share[k] = (total[ends] - total[starts]) / np.maximum(size, 1)
    blank = _CLASS[_BLANK][data]
    edge = np.diff(np.concatenate([[True], blank, [True]]).view(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    line = np.searchsorted(starts, begin, side="right") - 1
    code = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_ODD, len(data)))])
    word = (code[end] - code[begin]) * powers(pow(_ODD, -1, 1 << 64), len(data) + 1)[begin]
    words = np.bincount(line, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    key = (word ^ (word >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + line.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(key)
    first = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, dtype=bool)
    distinct = np.bincount(line[order][first], minlength=n)
    again = lambda k: np.bincount(line[k:][(word[k:] == word[:-k]) & (line[k:] == line[:-k])], minlength=n) / some
    single = np.bincount(line[end - begin == 1], minlength=n) / some
    length = np.bincount(line, weights=end - begin, minlength=n) / some
    lone = np.where(words > 0, distinct / some, 1.0)
    own = np.stack([
        np.log1p(size) / 5, share[_LETTER], share[_DIGIT], share[_UPPER], np.sqrt(share[_SYMBOL]), share[_POINT], share[_HIGH],
        np.minimum(length / 10, 4), lone, np.minimum(again(1) * 2, 1), np.minimum(again(2) * 2, 1), single,
        size == 0, words < 4, share[_SYMBOL] > 0.05, (lone < 0.5) & (words > 4), length > 12,
    ], axis=1)
    same = np.zeros(n, dtype=bool)
    same[1:] = lines_of[1:] == lines_of[:-1]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1] * same[1:, None]
    after[:-1] = own[1:] * same[1:, None]
    return np.concatenate([np.ones((n, 1)), own, before, after], axis=1)


def lines_of_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts: their bytes, each line's document, and where each line begins and ends."""
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    data = np.frombuffer(b"\n".join(raw.to_pylist()) + b"\n", dtype=np.uint8)
    sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    text_ends = np.cumsum(sizes + 1)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    return data, np.searchsorted(text_ends - 1, ends, side="left"), starts, ends


def features_by_part(data, lines_of, starts, ends, part: int = PART):
    """(begin, end, features) of the lines, so many at a time: a very long text isn't one matrix."""
    n = len(starts)
    for a in range(0, n, part):
        b = min(a + part, n)
        low, high = max(a - 1, 0), min(b + 1, n)  # with the neighbours
        at = starts[low]
        x = line_features(data[at : ends[high - 1] + 1], lines_of[low:high], starts[low:high] - at, ends[low:high] - at)
        yield a, b, x[a - low : b - low]


def marginals(emit: np.ndarray, counts: np.ndarray, trans: np.ndarray):
    """Forward-backward over chains in step. emit: log-odds of good of each line, chains after each other; trans: 2 x 2 log scores.

    Returns each line's probability of being good, the expected transitions [2, 2], and the log of all normalisers.
    """
    order = np.argsort(-counts, kind="stable")
    firsts = np.concatenate([[0], np.cumsum(counts)])[:-1][order]
    longest = counts[order]
    t = np.exp(trans)
    up, down = 1 / (1 + np.exp(-emit)), 1 / (1 + np.exp(emit))
    logs = float(np.logaddexp(0, emit).sum())
    alpha = np.empty((len(emit), 2))
    steps = int(longest[0]) if len(longest) else 0
    live = np.searchsorted(-longest, -np.arange(steps), side="left")  # chains longer than each step
    for k in range(steps):
        at = firsts[: live[k]] + k
        a = np.stack([down[at], up[at]], axis=1)
        if k:
            a *= alpha[at - 1] @ t
        else:
            a *= 0.5
        total = a.sum(axis=1, keepdims=True)
        logs += float(np.log(total).sum())
        alpha[at] = a / total
    beta, pairs = np.ones((len(emit), 2)), np.zeros((2, 2))
    for k in range(steps - 2, -1, -1):
        at = firsts[: live[k + 1]] + k
        right = beta[at + 1] * np.stack([down[at + 1], up[at + 1]], axis=1)
        b = right @ t.T
        both = alpha[at][:, :, None] * t[None] * right[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[at] = b / b.sum(axis=1, keepdims=True)
    post = alpha * beta
    return post[:, 1] / post.sum(axis=1), pairs, logs


def train(x: np.ndarray, counts: np.ndarray, good: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights [FEATURES] and transitions [2, 2]; good: the label of each chain. Both labels weigh the same; penalty 2e-4."""
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    if not len(counts) or good.all() or not good.any():
        return w, trans
    y = np.repeat(good, counts).astype(np.float64)
    groups = [good, ~good]
    rows = [np.repeat(g, counts) for g in groups]
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, rounds + 1):
        grad = np.zeros(len(w) + 4)
        for k, (g, r) in enumerate(zip(groups, rows, strict=True)):
            p, pairs, _ = marginals(x[r] @ w, counts[g], trans)
            seen = np.zeros((2, 2))
            seen[1 - k, 1 - k] = (counts[g] - 1).sum()
            scale = 0.5 / r.sum()
            grad[: len(w)] += scale * (x[r].T @ (y[r] - p))
            grad[len(w) :] += scale * (seen - pairs).ravel()
        grad -= 2e-4 * np.concatenate([w, trans.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.15 * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, trans = w + move[: len(w)], trans + move[len(w) :].reshape(2, 2)
    return w, trans


def _gather(batches):
    for b in pieces(batches, TOGETHER):
        data, lines_of, starts, ends = lines_of_texts(b.column("text"))
        x = np.concatenate([f.astype(np.float32) for _, _, f in features_by_part(data, lines_of, starts, ends)])
        cut = np.searchsorted(lines_of, np.arange(b.num_rows + 1))
        yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())], ["quality", "x"])


def _scorer(w: np.ndarray, trans: np.ndarray):
    def run(batches):
        for b in pieces(batches, TOGETHER):
            data, lines_of, starts, ends = lines_of_texts(b.column("text"))
            weight, emit = (ends - starts + 1).astype(np.float64), np.empty(len(starts))
            for i, j, x in features_by_part(data, lines_of, starts, ends):
                emit[i:j] = x @ w
            p, _, _ = marginals(emit, np.bincount(lines_of, minlength=b.num_rows), trans)
            score = np.bincount(lines_of, weights=weight * p, minlength=b.num_rows) / np.bincount(lines_of, weights=weight, minlength=b.num_rows)
            keep = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.clip(score, 0, 1))], [*b.schema.names[:-1], "score"])

    return run


def crc(c):
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")))


def held_out(c):
    return c.isNotNull() & (crc(c) % 4 == 2)


def fit(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The field's weights, from a bounded sample of the documents that are labelled and not held out."""
    lean_batches(documents.sparkSession)
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    draw = F.md5(F.col("doc_id").cast("string"))
    known = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    present = documents.where(F.col("doc_id").isNotNull()).select("doc_id")
    known = known.join(present, "doc_id", "left_semi")
    chosen = known.where("quality = 0").orderBy(draw, "doc_id").limit(PER_CLASS).unionByName(known.where("quality = 1").orderBy(draw, "doc_id").limit(PER_CLASS))
    # broadcast: at most 2 * PER_CLASS rows; of rows that share a doc_id one text, so that the sample stays bounded
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    sample = settled(texts.withColumn("lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(1))), "sample")
    # which documents the driver gets is settled by their numbers of lines, before any features are sent
    ids, total = [], [0, 0]
    for r in sample.select("doc_id", "quality", "lines").orderBy(F.md5(F.concat(F.lit("lines"), F.col("doc_id").cast("string"))), "doc_id").collect():
        if total[r["quality"]] + r["lines"] <= LINES // 2:
            total[r["quality"]] += r["lines"]
            ids.append(r["doc_id"])
    rows = sample.where(F.col("doc_id").isin(ids)).select("quality", "text").mapInArrow(_gather, "quality int, x binary").collect()
    rows.sort(key=lambda r: (bytes(r["x"]), r["quality"]))
    xs = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, FEATURES) for r in rows]
    good = [r["quality"] == 1 for r in rows]
    x = np.concatenate(xs).astype(np.float64) if xs else np.zeros((0, FEATURES))
    return train(x, np.array([len(a) for a in xs], dtype=np.int64), np.array(good, dtype=bool))


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """All columns of documents, each in the struct doc, and score."""
    from pyspark.sql import types as T

    shape = T.StructType([T.StructField("doc", documents.schema), T.StructField("score", T.DoubleType())])
    return documents.select(F.struct("*").alias("doc"), "text").mapInArrow(_scorer(*model), shape)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(documents, table(spark, sf_dir, "labels"))
    ids = documents.select("doc_id", "text").mapInArrow(_scorer(*model), "doc_id long, score double")
    return ids.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
