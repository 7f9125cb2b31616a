"""LM scoring: an interpolated modified Kneser-Ney trigram model, counted in Spark, kept as sorted hash arrays.

Two passes over the training texts count words, then trigrams; tasks count what they read in arrays before anything is
shuffled. Trigrams meet by their middle word, so that one task sees all contexts of its trigrams and all left neighbours
of its bigrams; frequent middle words are spread by their left neighbour, and only their bigrams meet once more. Words
are numbered by frequency within their hash bucket, so that one number tells which are frequent. Each task writes its part
of the model to the shared folder as sorted hash arrays; the scoring pass maps those files into memory, looks up whole
batches of n-grams and sums log10 probabilities by document. Nothing is pruned, and what is kept grows with the corpus.
The driver sees a few numbers for each bucket.

Nulls: a null text is an empty one: one token, the end. A null doc_id counts as the text ''. Repeated rows count and are
scored each. Very long texts are one row each and cost memory in proportion to their words. An empty corpus leaves the
uniform probability 1 / (words + 1). More than 2**32 - 2 numbers of words raise an error. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import hashstore as hs
from textloom.llm.common import lean_batches, scratch, settled, table, tidy
from textloom.llm.words import hash_strings, pieces, split

TOGETHER, FLUSH, BUCKET, HOT, TEXT = 1 << 20, 2_000_000, 2_000_000, 4, 128 << 20
STATS = ("id", "total", "one", "two", "more")
BEGIN, UNKNOWN = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)
END_HASH = np.uint64(0xE0D0E0D0E0D0E0D1)
BLOBS = "bucket int, kind string, blob binary, n array<bigint>"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("blob", pa.binary()), ("n", pa.list_(pa.int64()))])


def _rows(rows) -> pa.RecordBatch:
    """Rows of packed columns for a bucket, or of a few numbers to be added up."""
    columns = list(zip(*((k, kind, x if isinstance(x, bytes) else None, None if isinstance(x, bytes) else x) for k, kind, x in rows), strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _columns(own: pa.Table, kind: str, *kinds) -> list[np.ndarray]:
    """The packed columns of all rows of a kind, one after the other; empty ones of these types without any."""
    parts = [hs.unpack(x.as_buffer()) for x, k in zip(own.column("blob"), own.column("kind").to_pylist(), strict=True) if k == kind]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=t) for t in kinds]


def _every_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    """With a row for each bucket, so that each has its file, and nobody needs to know which are there."""
    numbers = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit("").alias("kind"))
    return rows.unionByName(numbers, allowMissingColumns=True)


def _small(x: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where they fit."""
    return x.astype(np.uint32 if not len(x) or int(x.max()) < 1 << 32 else np.uint64)


def _by_bucket(at: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
    """The order by bucket and, within it, by key."""
    small = at.astype(np.uint16) if not len(at) or int(at.max()) < 1 << 16 else at  # a radix sort
    if keys is None:
        return np.argsort(small, kind="stable")
    order = np.argsort(keys)
    return order[np.argsort(small[order], kind="stable")]


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _cuts(buckets: np.ndarray):
    """Of sorted buckets: each value with its range."""
    edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]])) if len(buckets) else np.zeros(1, dtype=np.int64)
    return [(int(buckets[i]), int(i), int(j)) for i, j in zip(edges[:-1], edges[1:], strict=True)]


# -- words --------------------------------------------------------------------------------------------------------------


def _count_words(buckets: int):
    def run(batches):
        held: list = []
        size = 0

        def flush():
            keys, counts = _sums(np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]))
            at = keys % np.uint64(buckets)
            order = _by_bucket(at)
            keys, counts, at = keys[order], counts[order], at[order]
            return _rows([(k, "w", hs.pack(keys[i:j], counts[i:j].astype(np.uint32 if counts.max() < 1 << 32 else np.uint64))) for k, i, j in _cuts(at)])

        for b in pieces(batches, TOGETHER):
            _, place, distinct = split(b.column("text"))
            held.append((np.append(hash_strings(distinct), END_HASH), np.append(np.bincount(place, minlength=len(distinct)), b.num_rows).astype(np.int64)))
            size += len(distinct) + 1
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _keep_words(base: str, buckets: int):
    def run(own: pa.Table) -> pa.Table:
        k = own.column("bucket")[0].as_py()
        keys, counts = _columns(own, "w", np.uint64, np.int64)
        keys, counts = _sums(keys, counts.astype(np.int64))
        rank = np.empty(len(keys), dtype=np.int64)
        rank[np.lexsort([keys, -counts])] = np.arange(len(keys))
        if len(keys) * buckets >= int(UNKNOWN):
            raise OverflowError("more words than 32-bit numbers")
        ids = (rank * buckets + k).astype(np.uint32)  # frequent words get small numbers
        hs.save(f"{base}/words-{k}", {"key": keys, "id": ids, "count": counts.astype(np.uint64)})
        often = int((counts * HOT > BUCKET).sum())
        return pa.Table.from_batches([_rows([(k, "n", [len(keys), int(counts.sum()), int(counts[keys == END_HASH].sum()), often])])])

    return run


def _lookup_words(model: dict, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and training count of each word hash; unknown ones: UNKNOWN and 0."""
    ids, counts = np.full(len(keys), UNKNOWN, dtype=np.uint32), np.zeros(len(keys), dtype=np.int64)
    at = keys % np.uint64(model["word_buckets"])
    order = _by_bucket(at, keys)
    for k, i, j in _cuts(at[order]):
        own, who = hs.load(f"{model['base']}/words-{k}"), order[i:j]
        if not len(own["key"]):
            continue
        spot = np.minimum(np.searchsorted(own["key"], keys[who]), len(own["key"]) - 1)
        hit = own["key"][spot] == keys[who]
        ids[who[hit]], counts[who[hit]] = own["id"][spot[hit]], own["count"][spot[hit]]
    return ids, counts


def _sequences(model: dict, texts: pa.Array):
    """The texts' tokens as trigrams (u, v, w), the text of each, and the training count of each w."""
    owner, place, distinct = split(texts)
    ids, counts = _lookup_words(model, np.append(hash_strings(distinct), END_HASH))
    n = len(texts)
    words = np.bincount(owner, minlength=n)
    starts = np.concatenate([[0], np.cumsum(words + 3)])
    seq = np.full(starts[-1], BEGIN, dtype=np.uint32)
    known = np.zeros(starts[-1], dtype=np.int64)
    firsts = np.concatenate([[0], np.cumsum(words)])[:-1]
    at = starts[owner] + 2 + np.arange(len(owner)) - firsts[owner]
    seq[at], known[at] = ids[place], counts[place]
    ends = starts[1:] - 1
    seq[ends], known[ends] = ids[-1], counts[-1]
    at = np.sort(np.concatenate([at, ends]))
    return seq[at - 2], seq[at - 1], seq[at], np.repeat(np.arange(n), words + 1), known[at]


# -- n-grams --------------------------------------------------------------------------------------------------------------


def _hot(model: dict, v):
    """Frequent words: those with small numbers, and the beginning where there are many texts."""
    return (v < model["hot"]) | (v == BEGIN) if model["many_texts"] else v < model["hot"]


def _bucket3(model: dict, u, v):
    """Trigrams and their contexts: by the middle word; those of frequent middle words by both words of the context."""
    alone, both = hs.mix(v.astype(np.uint64)), hs.mix(hs.pair(u, v))
    return (np.where(_hot(model, v), both, alone) % np.uint64(model["buckets"])).astype(np.int64)


def _bucket2(model: dict, v, w):
    """Bigrams: with the trigrams that have v in the middle, or, for frequent v, in as many buckets after those."""
    n = np.uint64(model["buckets"])
    return np.where(_hot(model, v), n + hs.mix(hs.pair(v, w) + np.uint64(1)) % n, hs.mix(v.astype(np.uint64)) % n).astype(np.int64)


def _key3(u, v, w):
    with np.errstate(over="ignore"):
        return hs.mix(hs.mix(hs.pair(u, v)) + w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _distinct(*columns_and_counts):
    """Rows of two or three columns in order without repeats, with the sums of the last column."""
    a, b, *c, counts = columns_and_counts
    key = hs.pair(a, b)
    if c:  # the rank of the first two leaves room for the third
        order = np.argsort(key)
        first = np.zeros(len(key), dtype=bool)
        first[1:] = key[order][1:] != key[order][:-1]
        own, key = key[order], hs.pair(np.cumsum(first), c[0][order])
        counts = counts[order]
    order = np.argsort(key)
    key, counts = key[order], counts[order]
    at = _runs(key)
    counts = np.add.reduceat(counts, at) if len(at) else counts
    if not c:
        return (key[at] >> np.uint64(32)).astype(np.uint32), key[at].astype(np.uint32), counts
    pairs = own[order[at]]
    return (pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32), key[at].astype(np.uint32), counts


def _count_trigrams(model: dict):
    def run(batches):
        held: list = []
        size = 0

        def flush():
            u, v, w = (np.concatenate(x) for x in zip(*held, strict=True))
            v, u, w, n = _distinct(v, u, w, np.ones(len(u), dtype=np.uint32))
            at = _bucket3(model, u, v)
            order = _by_bucket(at)
            v, u, w, n, at = v[order], u[order], w[order], n[order], at[order]
            return _rows([(k, "t", hs.pack(v[i:j], u[i:j], w[i:j], n[i:j])) for k, i, j in _cuts(at)])

        for b in pieces(batches, TOGETHER):
            u, v, w, _, _ = _sequences(model, b.column("text"))
            held.append((u, v, w))
            size += len(u)
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _runs(*columns):
    """Where each run of equal rows begins."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _stats(first: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """For each run: the sum of its counts and how many are 1, 2 and more."""
    if not len(first):
        return [np.zeros(0, dtype=np.uint64)] * 4
    return [np.add.reduceat(x.astype(np.uint64), first) for x in (counts, counts == 1, counts == 2, counts > 2)]


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _neighbours(model: dict, w: np.ndarray):
    """Rows that say how many distinct left neighbours w has among these bigrams."""
    ids, n = _sums(w, np.ones(len(w), dtype=np.int64))
    at = ids % np.uint32(model["word_buckets"])
    order = _by_bucket(at)
    return [(k, "u", hs.pack(ids[order][i:j], n[order][i:j].astype(np.uint32))) for k, i, j in _cuts(at[order])]


def _keep_trigrams(model: dict):
    def run(own: pa.Table) -> pa.Table:
        k = own.column("bucket")[0].as_py()
        v, u, w, n = _columns(own, "t", *[np.uint32] * 4)
        v, u, w, n = _distinct(v, u, w, n.astype(np.int64))
        arrays = {f"t.{a}": x for a, x in hs.keyed(_key3(u, v, w), n=n).items()}
        first = _runs(v, u)
        total, *several = _stats(first, n)
        # a context seen once needs no entry of its own: its bigram tells that it was seen, but for the beginning of texts
        more = (total > 1) | ((u[first] == BEGIN) & (v[first] == BEGIN))
        order = np.argsort(keys := hs.mix(hs.pair(u[first], v[first]))[more])
        arrays |= {"c.key": keys[order]} | {f"c.{name}": _small(x[more][order]) for name, x in zip(("total", "one", "two", "more"), [total, *several], strict=True)}
        said = [(k, "3", _of_counts(n))]
        v2, w2, left = _distinct(v, w, np.ones(len(v), dtype=np.int64))
        hot = _hot(model, v2)
        if hot.any():
            at = _bucket2(model, v2[hot], w2[hot]) - model["buckets"]
            order = _by_bucket(at)
            hv, hw, hn = v2[hot][order], w2[hot][order], _small(left[hot][order])
            said += [(b, "h", hs.pack(hv[i:j], hw[i:j], hn[i:j])) for b, i, j in _cuts(at[order])]
        arrays_2, said_2, contexts = _bigrams(model, k, v2[~hot], w2[~hot], left[~hot])
        arrays_2 |= {f"v.{name}": x for name, x in zip(STATS, contexts, strict=True)}
        hs.save(f"{model['base']}/gram-{k}", arrays | arrays_2)
        return pa.Table.from_batches([_rows(said + said_2)])

    return run


def _bigrams(model: dict, k: int, v, w, left):
    """Arrays of bigrams (in order of v, w) with their numbers of left neighbours, of the contexts v, and what to say of them."""
    arrays = {f"b.{a}": x for a, x in hs.keyed(hs.mix(hs.pair(v, w)), n=left).items()}
    first = _runs(v)
    stats = _stats(first, left)
    return arrays, [(k, "2", _of_counts(left)), *_neighbours(model, w)], [v[first], *stats]


def _keep_frequent(model: dict):
    """Bigrams of frequent left words: their parts meet, and the sums for each left word go to that word's bucket."""

    def run(own: pa.Table) -> pa.Table:
        k = own.column("bucket")[0].as_py()
        v, w, n = _columns(own, "h", *[np.uint32] * 3)
        v, w, n = _distinct(v, w, n.astype(np.int64))
        arrays, said, contexts = _bigrams(model, k + model["buckets"], v, w, n)
        hs.save(f"{model['base']}/gram-{k + model['buckets']}", arrays)
        at = contexts[0] % np.uint32(model["word_buckets"])
        order = _by_bucket(at)
        said += [(b, "v", hs.pack(*(x[order][i:j] for x in contexts))) for b, i, j in _cuts(at[order])]
        return pa.Table.from_batches([_rows(said)])

    return run


def _keep_unigrams(model: dict):
    """Of a bucket's words: their numbers of left neighbours, and the sums for the frequent ones as contexts."""

    def run(own: pa.Table) -> pa.Table:
        k = own.column("bucket")[0].as_py()
        ids, n = (x.astype(np.int64) for x in _columns(own, "u", np.uint32, np.uint32))
        ids, n = _sums(ids, n)
        dense = np.zeros(int(ids.max(initial=-1)) // model["word_buckets"] + 1, dtype=np.int64)
        dense[ids // model["word_buckets"]] = n
        contexts, *stats = _columns(own, "v", np.uint32, *[np.uint64] * 4)
        arrays = {f"v.{name}": x for name, x in zip(STATS, [np.unique(contexts), *(_sums(contexts, x)[1] for x in stats)], strict=True)}
        hs.save(f"{model['base']}/left-{k}", arrays | {"n": _small(dense)})
        return pa.Table.from_batches([_rows([(k, "1", [*_of_counts(n), int(n.sum()), int((n > 2).sum())])])])

    return run


def _discounts(counts: np.ndarray) -> list[float]:
    """Of n1 to n4: what is taken off a count of 1, 2 and more."""
    n1, n2, n3, n4 = (float(x) for x in counts[:4])
    if not (n1 and n2 and n3):
        return [0.0, 0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))]


def train(texts: DataFrame) -> dict:
    """What workers need to use the model; the model itself lies in the shared folder."""
    spark = texts.sparkSession
    lean_batches(spark)
    base = scratch(spark, "lm")
    texts = texts.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    word_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TEXT))
    counted = _every_bucket(texts.mapInArrow(_count_words(word_buckets), BLOBS), word_buckets).groupBy("bucket").applyInArrow(tidy(_keep_words(base, word_buckets)), BLOBS)
    words, tokens, ends, often = settled(counted, "lm-words").agg(*[F.sum(F.col("n")[k]) for k in range(3)], F.max(F.col("n")[3])).first()
    buckets = -(-tokens // BUCKET) or 1
    model = {"base": base, "word_buckets": word_buckets, "buckets": buckets, "words": words, "tokens": tokens}
    # numbers below this are the most frequent words of each bucket, all those with more than a part of a bucket among them
    model |= {"hot": often * word_buckets if buckets > 1 else 0, "many_texts": buckets > 1 and ends * HOT > BUCKET}
    grams = settled(_every_bucket(texts.mapInArrow(_count_trigrams(model), BLOBS), buckets).groupBy("bucket").applyInArrow(tidy(_keep_trigrams(model)), BLOBS), "lm-grams")
    every = grams
    if model["hot"] or model["many_texts"]:
        frequent = _every_bucket(grams.where("kind = 'h'"), buckets).groupBy("bucket").applyInArrow(tidy(_keep_frequent(model)), BLOBS)
        every = grams.unionByName(settled(frequent, "lm-frequent"))
    lefts = _every_bucket(every.where("kind IN ('u', 'v')"), word_buckets)
    every = every.unionByName(settled(lefts.groupBy("bucket").applyInArrow(tidy(_keep_unigrams(model)), BLOBS), "lm-left"))
    added = every.where("kind IN ('1', '2', '3')").groupBy("kind").agg(F.array(*[F.sum(F.get("n", F.lit(k))) for k in range(6)]).alias("n")).collect()
    sums = {r["kind"]: r["n"] for r in added}
    model |= {f"d{k}": _discounts(sums[k]) for k in "123"}
    n1, n2, _, _, total, more = (float(x) for x in sums["1"])
    d = model["d1"]
    model |= {"left_total": total, "left_rest": (d[1] * n1 + d[2] * n2 + d[3] * more) / total if total else 1.0}
    return model


# -- scoring --------------------------------------------------------------------------------------------------------------


def _by_file(model: dict, at: np.ndarray, keys: np.ndarray, name: str = "gram"):
    """For each file that is needed: its arrays, and who asks, in order of their keys."""
    order = _by_bucket(at, keys)
    for k, i, j in _cuts(at[order]):
        yield hs.load(f"{model['base']}/{name}-{k}"), order[i:j]


def _contexts(own: dict, keys: np.ndarray, prefix: str, name: str = "id"):
    """Of the keys that a file has as contexts: which, and their sums."""
    known = own[f"{prefix}.{name}"]
    if not len(known):
        return np.zeros(0, dtype=np.int64), []
    spot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = np.flatnonzero(known[spot] == keys)
    return hit, [own[f"{prefix}.{x}"][spot[hit]] for x in STATS[1:]]


def _off(d: list[float], n: np.ndarray) -> np.ndarray:
    return np.array(d)[np.minimum(n, 3)]


def _rest(d: list[float], total, one, two, more) -> np.ndarray:
    return (d[1] * one + d[2] * two + d[3] * more) / np.maximum(total, 1)


def probabilities(model: dict, u, v, w) -> np.ndarray:
    """p(w | u v) of each trigram."""
    n = len(w)
    # unigrams
    left = np.zeros(n, dtype=np.int64)
    known = np.flatnonzero(w < UNKNOWN)
    width = np.uint32(model["word_buckets"])
    for own, who in _by_file(model, w[known] % width, w[known], "left"):
        if len(dense := own["n"]):
            spot = w[known[who]] // width
            left[known[who]] = np.where(spot < len(dense), dense[np.minimum(spot, len(dense) - 1)], 0)
    p = np.maximum(left - _off(model["d1"], left), 0) / max(model["left_total"], 1) + model["left_rest"] / (model["words"] + 1)
    # bigrams
    has = (v != UNKNOWN) & (w != UNKNOWN)
    count, seen = np.zeros(n, dtype=np.int64), np.zeros((4, n))
    key = hs.mix(hs.pair(v, w))
    for own, who in _by_file(model, _bucket2(model, v, w), key):
        b = hs.part(own, "b.")
        count[who] = hs.value(b, "n", hs.find(b, key[who]))
    count[~has] = 0
    hot = _hot(model, v)
    for name, who in (("gram", np.flatnonzero(~hot & (v != UNKNOWN))), ("left", np.flatnonzero(hot))):
        for own, asks in _by_file(model, _bucket2(model, v[who], w[who]) if name == "gram" else v[who] % width, v[who], name):
            hit, stats = _contexts(own, v[who[asks]], "v")
            if len(hit):
                seen[:, who[asks[hit]]] = stats
    d = model["d2"]
    p = np.where(seen[0] > 0, np.maximum(count - _off(d, count), 0) / np.maximum(seen[0], 1) + _rest(d, *seen) * p, p)
    # trigrams; the context u v was seen if that bigram was, and once if it has no entry
    count3, context = np.zeros(n, dtype=np.int64), np.zeros((4, n))
    here, key = _bucket3(model, u, v), _key3(u, v, w)
    for own, who in _by_file(model, here, key):
        t = hs.part(own, "t.")
        count3[who] = hs.value(t, "n", hs.find(t, key[who]))
    pair = hs.mix(hs.pair(u, v))
    for own, who in _by_file(model, here, pair):
        if "c.key" in own:
            hit, stats = _contexts(own, pair[who], "c", "key")
            if len(hit):
                context[:, who[hit]] = stats
    before = np.zeros(n, dtype=bool)
    before[1:] = (count[:-1] > 0) & (u[1:] == v[:-1]) & (v[1:] == w[:-1])
    once = (context[0] == 0) & (before | (count3 > 0))
    context[0][once] = context[1][once] = 1
    valid = (u != UNKNOWN) & (v != UNKNOWN)
    count3[~valid | (w == UNKNOWN)] = 0
    d = model["d3"]
    return np.where(valid & (context[0] > 0), np.maximum(count3 - _off(d, count3), 0) / np.maximum(context[0], 1) + _rest(d, *context) * p, p)


SCORED = "n_tokens long, n_known long, base_score double, score double"


def _scorer(model: dict):
    def run(batches):
        for b in pieces(batches, TOGETHER):
            u, v, w, owner, known = _sequences(model, b.column("text"))
            n, m = b.num_rows, model["tokens"] + 0.5 * (model["words"] + 1)
            add = lambda x: np.bincount(owner, weights=x, minlength=n)  # noqa: B023, E731
            got = [pa.array(np.bincount(owner, minlength=n)), pa.array(add(known > 0).astype(np.int64)), pa.array(add(np.log10((known + 0.5) / m))), pa.array(add(np.log10(probabilities(model, u, v, w))))]
            keep = [i for i, x in enumerate(b.schema.names) if x != "text"]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + got, [b.schema.names[i] for i in keep] + [x.split()[0] for x in SCORED.split(", ")])

    return run


def score(texts: DataFrame, model: dict) -> DataFrame:
    """doc_id, tokens, known tokens, the unigram base score and the model's log10 probability of every text."""
    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(model), f"doc_id long, {SCORED}")


def held_out(c):
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 5 == 1


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(documents.where(~held_out(F.col("doc_id"))))
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return score(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))
