"""SentencePiece encoding and decoding as a relational lattice.

Texts fall into units that no piece crosses (a run of spaces with the word that follows, or a run of other signs); each
distinct unit of the corpus is treated once. Its substrings of bounded length are exploded and joined by equality to the
piece table, which makes the edges of a lattice; the edges are grouped by unit, and a higher-order aggregate folds them:

* for unigram models, Viterbi (best_spans): the best sum of scores for every end, the path of the last;
* for BPE models, whose scores are merge ranks and whose segmentation is not the best sum (merged_spans): one pass over the
  edges in the order of their merges, which the piece table gives (schedule), with the set of boundaries that are left as
  the state. This gives the ids of the sentencepiece library, for units of any length.

The results are written to the shared folder as sorted hash arrays, dealt by the units' hashes to as many files as the
number of units asks for, and a scan of the texts maps them into memory and puts the ids of each document together. Only the
piece table, whose size the model fixes, is broadcast. Units are looked up by 64-bit hashes; the decoded ids are compared
with the text, and a text that differs (two units with one hash) is encoded where it stands.

Nulls: a null text is an empty one and has no ids. Signs that the model lacks are bytes. Repeated rows are encoded each.
Very long texts are one row each; a unit of n signs that is very long costs n bytes a merge. Other columns, whatever their
names, are ignored. An empty table gives an empty result. decode() is exact: it gives the text back, but for signs U+2581
in a text, which the model reads as spaces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import hashstore as hs
from textloom.llm.common import lean_batches, scratch, settled, table, tidy, trim
from textloom.llm.words import hash_strings, pieces as slices

SPACE, LONGEST, WINDOW, TOGETHER, FLUSH, BUCKET = "▁", 60, 48, 1 << 20, 400_000, 200_000
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Model:
    """A model's pieces: what an encoder and a decoder need. Sent to workers; its size is the vocabulary's."""

    score: dict[str, tuple[float, int]]
    byte: list[int]
    text: list[bytes]
    pattern: str
    bpe: bool

    @property
    def longest(self) -> int:
        return max((len(p) for p in self.score), default=1)


def load(path: str = MODEL, bpe: bool = True) -> Model:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    score, byte, text = {}, [0] * 256, []
    for i in range(p.vocab_size()):
        piece = p.id_to_piece(i)
        if p.is_byte(i):
            byte[int(piece[3:5], 16)] = i
            text.append(bytes([int(piece[3:5], 16)]))
        elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
            text.append(b"")
        else:
            score[piece] = p.get_score(i), i
            text.append(piece.replace(SPACE, " ").encode())
    return Model(score, byte, text, unit_pattern(score), bpe)


def unit_pattern(known) -> str:
    """A pattern for the units: no piece of known crosses from one to the next."""
    several = [p for p in known if len(p) > 1]
    if any(SPACE in p.lstrip(SPACE) for p in several):
        return r"(?s).+"
    if any(a.isalpha() != b.isalpha() and SPACE not in (a, b) for p in several for a, b in zip(p, p[1:], strict=False)):
        return rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
    # a pattern takes numbers that aren't decimal digits for word signs: those in pieces of several signs are named
    odd = re.escape("".join(sorted({c for p in several for c in p if c.isalnum() and not c.isalpha() and not re.match(r"\d", c)})))
    return rf"{SPACE}*[^\W\d_{odd}]+|{SPACE}*(?:[\W\d_{odd}](?<!{SPACE}))+|{SPACE}+"


def units(text: str, pattern: re.Pattern) -> list[str]:
    return pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []


def merge(unit: str, model: Model, done: list | None = None) -> list[str]:
    """The BPE pieces of one unit: always the best pair, of equals the first. done gets each merge's place and piece."""
    n = len(unit)
    part, left, right = list(unit), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and (found := model.score.get(part[i] + part[j])):
            heapq.heappush(heap, (-found[0], i, part[i], part[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i] if part[i] == a else n
        if j >= n or part[j] != b or not a:
            continue
        part[i], part[j] = a + b, ""
        if done is not None:
            done.append((i, a + b))
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [p for p in part if p]


def ids_of(parts: list[str], model: Model) -> list[int]:
    out: list[int] = []
    for p in parts:
        found = model.score.get(p)
        out += [found[1]] if found else [model.byte[x] for x in p.encode()]
    return out


# -- the lattice --------------------------------------------------------------------------------------------------------------


def schedule(model: Model) -> list[tuple[str, int, int, int, int]]:
    """(piece, time, offset, depth, index) of all pieces of several signs that merges can make, for BPE.

    What happens within a piece before it is whole happens in every text as it does in the piece alone, as no merge has
    crossed its ends. So its own merges give its place in the order of all merges: time is the rank of the last merge that
    was worse than all before it, offset where that merge begins, depth how many better ones it made possible since.
    """
    several = sorted((p for p in model.score if len(p) > 1), key=lambda p: (-model.score[p][0], model.score[p][1]))
    rank, last = {}, None
    for p in several:
        if last is None or model.score[p][0] != last:
            last = model.score[p][0]
            time = len(rank)
        rank[p] = time
    out = []
    for index, p in enumerate(several):
        done: list[tuple[int, str]] = []
        if merge(p, model, done) != [p]:
            continue
        at, depth = (-1, -1), 0
        for place, made in done:
            if (rank[made], place) > at:
                at, depth = (rank[made], place), 0
            else:
                depth += 1
        out.append((p, at[0], at[1], depth, index))
    return out


def edges(distinct: DataFrame, known: DataFrame, longest: int, least: int) -> DataFrame:
    """distinct (unit, ...) with n (its length) and, for all its substrings of least to longest signs that are pieces, s, e and what known (piece, ...) has of them."""
    n, m, step = F.length("unit"), F.length("w.part"), F.lit(WINDOW)
    # long units are cut into windows first: a substring costs time in proportion to its place
    whole = F.array(F.struct(F.lit(0).alias("base"), F.col("unit").alias("part")))
    windows = F.transform(F.sequence(F.lit(0), (n - 1) - F.pmod(n - 1, step), step), lambda b: F.struct(b.cast("int").alias("base"), F.substring("unit", b + 1, F.lit(WINDOW + longest - 1)).alias("part")))
    own = distinct.where(n >= least).select("*", n.alias("n"), F.explode(F.when(n <= step, whole).otherwise(windows)).alias("w")).where(m >= least)
    own = own.select("*", F.explode(F.sequence(F.lit(0), F.least(m - least, step - 1))).alias("x"))
    own = own.select("*", F.explode(F.sequence(F.lit(least), F.least(F.lit(longest), m - F.col("x")))).alias("k"))
    s = F.col("w.base") + F.col("x")
    cut = own.select(*distinct.columns, "n", s.alias("s"), (s + F.col("k")).alias("e"), F.substring("w.part", F.col("x") + 1, F.col("k")).alias("piece"))
    return cut.join(F.broadcast(known), "piece").drop("piece")  # the vocabulary: its size is the model's


def merged_spans(units: DataFrame, known: DataFrame, longest: int, short: int = LONGEST) -> DataFrame:
    """bucket, u, unit, spans: s << 20 | index of the pieces of several signs that BPE leaves of each unit (bucket, u, unit); single signs fill the gaps.

    The edges in the order of their merges; each is made if no merge before it has crossed its ends. What is folded is the
    set of boundaries that are left: the bits of a number for units of up to `short` signs, a byte each for longer ones.
    """
    lattice = edges(units, known, longest, 2)
    brief = F.col("n") <= short
    shift = lambda c, k: F.shiftleft(c.cast("long"), k)
    key = shift(F.col("time"), 34).bitwiseOR(shift(F.col("s") + F.col("offset"), 28)).bitwiseOR(shift(F.col("depth"), 24)).bitwiseOR(shift(F.col("index"), 6)).bitwiseOR(F.col("s").cast("long"))
    # numbers: bit k is the boundary before sign k
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c)
    place = lambda c: F.when(brief, c).otherwise(0)
    begin, end = bit(place(F.col("s"))), bit(place(F.col("e")))
    narrow = F.struct(key.alias("key"), begin.bitwiseOR(end).alias("ends"), F.when(brief, end - begin - begin).alias("inner"))
    wide = F.struct("time", (F.col("s") + F.col("offset")).alias("anchor"), "depth", "index", "s", "e")
    grouped = lattice.groupBy("bucket", "u").agg(F.first("unit").alias("unit"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.when(brief, narrow))).alias("narrow"), F.sort_array(F.collect_list(F.when(~brief, wide))).alias("wide"))
    ends = lambda m, x: m.bitwiseAND(x["ends"]) == x["ends"]
    inside = lambda m, x: m.bitwiseAND(x["inner"])
    left = F.aggregate("narrow", bit(place(F.col("n") + 1)) - 1, lambda m, x: F.when(ends(m, x), m - inside(m, x)).otherwise(m))
    # bytes: byte k is the boundary before sign k
    at = lambda m, k: F.substring(m, k + 1, F.lit(1)) == F.lit(b"1")
    gone = lambda x: F.call_function("repeat", F.lit("0"), x["e"] - x["s"] - 1).cast("binary")
    open_ends = lambda m, x: at(m, x["s"]) & at(m, x["e"])
    start = F.call_function("repeat", F.lit("1"), F.when(~brief, F.col("n") + 1).otherwise(0)).cast("binary")
    bytes_left = F.aggregate("wide", start, lambda m, x: F.when(open_ends(m, x), F.overlay(m, gone(x), x["s"] + 2, x["e"] - x["s"] - 1)).otherwise(m))
    done = grouped.select("bucket", "u", "unit", "narrow", "wide", left.alias("left"), bytes_left.alias("bytes"))
    spans = F.transform(F.filter("narrow", lambda x: ends(F.col("left"), x) & (inside(F.col("left"), x) == 0)), lambda x: shift(x["key"].bitwiseAND(63), 20).bitwiseOR(F.shiftright(x["key"], 6).bitwiseAND((1 << 18) - 1)))
    whole = F.filter("wide", lambda x: open_ends(F.col("bytes"), x) & (F.substring("bytes", x["s"] + 2, x["e"] - x["s"] - 1) == gone(x)))
    return done.select("bucket", "u", "unit", F.concat(spans, F.transform(whole, lambda x: shift(x["s"], 20).bitwiseOR(x["index"].cast("long")))).alias("spans"))


def best_spans(distinct: DataFrame, known: DataFrame, longest: int, unknown: float) -> DataFrame:
    """unit, spans of the Viterbi path; a sign without a piece costs unknown and is a gap. Of equal paths, the longer last piece wins."""
    lattice = edges(distinct, known, longest, 1)
    grouped = lattice.groupBy("unit", "n").agg(F.collect_list(F.struct("s", "e", "score", "id")).alias("edges"))
    state = "array<struct<score:double,from:int,id:int>>"
    none = F.lit(-1).cast("int")
    start = F.array(F.struct(F.lit(0.0).alias("score"), none.alias("from"), none.alias("id"))).cast(state)

    def step(table, e):
        reached = lambda s: F.element_at(table, s + 1)["score"]
        gap = F.array(F.struct((reached(e - 1) + unknown).alias("score"), (e - 1).cast("int").alias("from"), none.alias("id")))
        own = F.transform(F.filter("edges", lambda x: x["e"] == e), lambda x: F.struct((reached(x["s"]) + x["score"]).alias("score"), x["s"].cast("int").alias("from"), x["id"].cast("int").alias("id")))
        ranked = F.array_sort(F.transform(F.concat(own, gap), lambda x: F.struct((-x["score"]).alias("cost"), x["from"].alias("from"), x["id"].alias("id"))))
        best = F.element_at(ranked, 1)
        return F.concat(table, F.array(F.struct((-best["cost"]).alias("score"), best["from"].alias("from"), best["id"].alias("id")).cast("struct<score:double,from:int,id:int>")))

    table = F.aggregate(F.sequence(F.lit(1), F.col("n")), start, step)
    done = grouped.withColumn("t", table)
    empty = F.struct(F.col("n").cast("int").alias("at"), F.array().cast("array<struct<s:int,e:int,id:int>>").alias("path"))

    def back(p, _):
        here = F.element_at("t", F.greatest(p["at"], F.lit(0)) + 1)
        more = F.when(here["id"] >= 0, F.array(F.struct(here["from"].alias("s"), p["at"].alias("e"), here["id"].alias("id")))).otherwise(F.array().cast("array<struct<s:int,e:int,id:int>>"))
        return F.when(p["at"] > 0, F.struct(here["from"].alias("at"), F.concat(more, p["path"]).alias("path"))).otherwise(p)

    return done.select("unit", F.aggregate(F.sequence(F.lit(1), F.col("n")), empty, back)["path"].alias("spans"))


# -- the corpus -----------------------------------------------------------------------------------------------------------------


def _units_of(texts: pa.Array, find: re.Pattern):
    """What the texts consist of: for each distinct segment (a word between single spaces, or a whole text that has others) its units; and each text's segments.

    Gives units (one after the other), their number in each segment, the segments of all texts and their number in each text.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lists = pc.split_pattern(texts, " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), counts)
    plain = pc.invert(pc.match_substring(texts, SPACE)).to_numpy(zero_copy_only=False) & find.pattern.startswith(f"{SPACE}*[")
    plain[owner[pc.equal(flat, "").to_numpy(zero_copy_only=False)]] = False
    words = flat.filter(pa.array(plain[owner])).dictionary_encode()
    # words of ASCII letters are units as they stand
    simple = pc.ascii_is_alpha(words.dictionary)
    number = np.argsort(~simple.to_numpy(zero_copy_only=False), kind="stable")
    place = np.empty(len(number), dtype=np.int64)
    place[number] = np.arange(len(number))
    rest = np.flatnonzero(~plain)
    # no unit reaches over a space: all other words are searched at once, and units that begin with one begin a word
    mixed = words.dictionary.filter(pc.invert(simple)).to_pylist()
    mixed = pa.array(find.findall(SPACE + SPACE.join(mixed)) if mixed else [], pa.large_string())
    begin = np.flatnonzero(pc.starts_with(mixed, SPACE).to_numpy(zero_copy_only=False))
    parts = [units(t, find) for t in texts.take(pa.array(rest)).to_pylist()]
    counts[rest] = 1
    segments = np.empty(int(counts.sum()), dtype=np.int64)
    inside = np.repeat(plain, counts)
    segments[inside] = place[words.indices.to_numpy(zero_copy_only=False)]
    segments[~inside] = len(number) + np.arange(len(rest))
    own = pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), words.dictionary.filter(simple), pa.scalar("", pa.large_string()))
    sizes = np.concatenate([np.ones(len(own), dtype=np.int64), np.diff(begin, append=len(mixed)), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))])
    return pa.concat_arrays([own, mixed, pa.array([u for x in parts for u in x], pa.large_string())]), sizes, segments, counts


def _distinct_units(pattern: str):
    def run(batches):
        find, held, size = re.compile(pattern), [], 0

        def flush():
            own = pa.chunked_array(held).unique()
            own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
            return pa.RecordBatch.from_arrays([own.cast(pa.string()), pa.array(hash_strings(own).view(np.int64))], ["unit", "key"])

        for b in slices(batches, TOGETHER):
            held.append(_units_of(b.column("text"), find)[0].unique())
            size += len(held[-1])
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        held = []
        trim()

    return run


def _gathered(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of flat, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(begins - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _filled(own: pa.Array, spans: np.ndarray, counts: np.ndarray, model: Model, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units, one after the other, and how many each has: of their spans, and of the single signs between. index: each span's id and length."""
    texts = own.to_pylist()
    signs = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.cumsum(lengths) - lengths
    at = np.repeat(begins, counts) + (spans >> 20)
    which = spans & ((1 << 20) - 1)
    order = np.argsort(at)
    at, which = at[order], which[order]
    covered = np.zeros(len(signs) + 1, dtype=np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + index[which, 1], -1)
    alone = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    kinds, kind = np.unique(signs[alone], return_inverse=True)
    single = [ids_of([chr(c)], model) for c in kinds.tolist()]
    several = np.array([len(x) for x in single], dtype=np.int64)
    flat = np.array([i for x in single for i in x] or [0], dtype=np.uint32)
    # items in the order of their places: spans have one id, signs one or one for each byte
    place = np.concatenate([at, alone])
    size = np.concatenate([np.ones(len(at), dtype=np.int64), several[kind] if len(alone) else np.zeros(0, dtype=np.int64)])
    begin = np.concatenate([np.arange(len(at)), len(at) + (np.cumsum(several) - several)[kind] if len(alone) else np.zeros(0, dtype=np.int64)])
    order = np.argsort(place)
    ids = _gathered(np.concatenate([index[which, 0].astype(np.uint32), flat]), begin[order], size[order])
    owner = np.searchsorted(begins, place, side="right") - 1
    return ids, np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64)


def _keep_units(base: str, model: Model, index: np.ndarray):
    def run(own: pa.Table) -> pa.Table:
        k = own.column("bucket")[0].as_py()
        names, spans = own.column("unit").combine_chunks(), own.column("spans").combine_chunks()
        names, spans = (x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in (names, spans))
        counts = pc.list_value_length(spans).to_numpy(zero_copy_only=False).astype(np.int64)
        ids, sizes = _filled(names, spans.flatten().to_numpy(zero_copy_only=False), counts, model, index)
        keys = hash_strings(names)
        order = np.argsort(keys)
        ids = _gathered(ids, (np.cumsum(sizes) - sizes)[order], sizes[order])
        hs.save(f"{base}/units-{k}", {"key": keys[order], "ends": np.concatenate([[0], np.cumsum(sizes[order])]).astype(np.uint64), "ids": ids})
        return pa.table({"bucket": pa.array([k], pa.int32())})

    return run


def fit(documents: DataFrame, model: Model) -> dict:
    """Encodes all distinct units of documents (text); returns what the encoder needs."""
    spark = documents.sparkSession
    lean_batches(spark)
    base = scratch(spark, "pieces")
    plan = schedule(model)
    index = np.zeros((max([i for *_, i in plan], default=0) + 1, 2), dtype=np.int64)
    for p, _, _, _, i in plan:
        index[i] = model.score[p][1], len(p)
    if len(index) > 1 << 18:
        raise ValueError("more than 2**18 pieces of several signs")
    short = LONGEST if max([d for *_, d, _ in plan], default=0) < 16 else 0
    known = spark.createDataFrame(plan, "piece string, time int, offset int, depth int, index int")
    distinct = settled(documents.select("text").mapInArrow(_distinct_units(model.pattern), "unit string, key long").distinct(), "units")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() // BUCKET))
    dealt = distinct.select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "unit").repartition(buckets, "bucket")
    spans = merged_spans(dealt.withColumn("u", F.monotonically_increasing_id()), known, model.longest, short)
    kept = settled(spans.groupBy("bucket").applyInArrow(tidy(_keep_units(base, model, index)), "bucket int"), "pieces-of-units")
    return {"base": base, "buckets": buckets, "files": {r.bucket for r in kept.collect()}, "index": index}


def _ids_of_units(own: pa.Array, model: Model, store: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of distinct units: one array, and where each unit's ids begin and how many there are. Units without any piece of several signs aren't in the store."""
    keys = hash_strings(own)
    sizes, begins = np.zeros(len(own), dtype=np.int64), np.full(len(own), -1, dtype=np.int64)
    found, done = [], 0
    bucket = keys.view(np.int64) % store["buckets"]
    order = np.lexsort([keys, bucket])
    edge = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if (k := int(bucket[order[i]])) not in store["files"]:
            continue
        f, who = hs.load(f"{store['base']}/units-{k}"), order[i:j]
        spot = np.minimum(np.searchsorted(f["key"], keys[who]), len(f["key"]) - 1)
        hit = f["key"][spot] == keys[who]
        who, spot = who[hit], spot[hit]
        first = f["ends"][spot].astype(np.int64)
        n = f["ends"][spot + 1].astype(np.int64) - first
        found.append(_gathered(f["ids"], first, n))
        sizes[who], begins[who] = n, done + np.cumsum(n) - n
        done += len(found[-1])
    rest = np.flatnonzero(begins < 0)
    ids, n = _filled(own.take(pa.array(rest)), np.zeros(0, dtype=np.int64), np.zeros(len(rest), dtype=np.int64), model, store["index"])
    sizes[rest], begins[rest] = n, done + np.cumsum(n) - n
    return np.concatenate([*found, ids]), begins, sizes


def decode(ids, model: Model) -> str:
    """The text of ids: the first space is the one that encoding put in front."""
    raw = b"".join([model.text[i] for i in ids]).decode(errors="replace")
    return raw[1:] if raw[:1] == " " else raw


def _encoder(model: Model, store: dict, digest: bool):
    def run(batches):
        find, said = re.compile(model.pattern), pa.array(model.text, pa.large_binary())
        for b in slices(batches, TOGETHER):
            texts = b.column("text")
            flat, inside, segments, counts = _units_of(texts, find)
            coded = flat.dictionary_encode()
            every, begins, sizes = _ids_of_units(coded.dictionary, model, store)
            # of each distinct segment, then of each text
            at = coded.indices.to_numpy(zero_copy_only=False)
            every = _gathered(every, begins[at], sizes[at])
            first = np.concatenate([[0], np.cumsum(inside)])
            ends = np.concatenate([[0], np.cumsum(sizes[at])])[first]
            n = np.diff(ends)[segments]
            ids = _gathered(every, ends[:-1][segments], n)
            cut = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
            rows = [ids[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            back = said.take(pa.array(ids))
            where = np.frombuffer(back.buffers()[1], dtype=np.int64)[cut].tolist() if len(back) else [0] * len(cut)
            raw = back.buffers()[2].to_pybytes() if len(back) and back.buffers()[2] else b""
            texts = [t or "" for t in texts.to_pylist()]
            same = [raw[i:j] == (b" " + t.encode() if t else b"") for t, i, j in zip(texts, where[:-1], where[1:], strict=True)]
            for k, t in enumerate(texts):
                if not same[k] and SPACE not in t:  # two units with one hash
                    rows[k] = np.array([i for u in units(t, find) for i in ids_of(merge(u, model), model)], dtype=np.uint32)
                    same[k] = decode(rows[k].tolist(), model) == t
            keep = [b.column(i) for i, x in enumerate(b.schema.names) if x != "text"]
            names = [x for x in b.schema.names if x != "text"]
            if digest:
                extra = [pa.array([len(r) for r in rows], pa.int64()), pa.array([hashlib.sha256(r.astype("<i4").tobytes()).hexdigest() for r in rows], pa.string()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*keep, *extra], [*names, "n_ids", "ids_sha256", "round_trip"])
            else:
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([*rows, ids[:0]]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*keep, lists], [*names, "ids"])
            del flat, coded, every, ids, rows, back, raw, texts, b
        trim()

    return run


def encode(documents: DataFrame, path: str = MODEL, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns that carry names, and ids of every document (doc_id, text)."""
    model = load(path)
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, "text")
    kinds = "".join(f"`{c}` {own.schema[c].dataType.simpleString()}, " for c in carry)
    return own.mapInArrow(_encoder(model, fit(own, model), False), f"doc_id long, {kinds}ids array<int>")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number and digest (of little-endian 32-bit ids) of every document's ids, and whether decoding gives its text."""
    model = load()
    own = table(spark, sf_dir, "documents").select("doc_id", "text")
    return own.mapInArrow(_encoder(model, fit(own, model), True), "doc_id long, n_ids long, ids_sha256 string, round_trip boolean")
