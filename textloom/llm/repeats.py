"""Suffix-array dedup: every byte in a 100-byte string that also starts earlier in the corpus is removed, exactly.

Three scans of the texts in the workers, and no shuffle of texts:

1. Every window of 100 bytes has an anchor: the least, by hash, of its 32-byte grams. Windows that are equal have equal
   anchors. Anchors are counted by hash range; those that occur twice, and the digests of whole texts that do, are
   written to the shared folder as sorted arrays.
2. Only the surroundings of repeated anchors (up to 68 bytes on each side) can hold repeated windows. They are sent to
   their anchor's bucket, equal ones once for a task. Whole copies of an earlier text are known already and sent nothing.
   In a bucket, all windows are sorted by 128-bit digests of their 100 bytes; equal ones are one class, and all but the
   earliest are removed.
3. The removed ranges, merged by document, are looked up from the shared folder, and what remains is hashed.

The method named for this operator, matching statistics against a run-length compressed BWT (an r-index), can't give these
results: a text that is streamed against an index that holds it matches itself everywhere, and an index of what is earlier
alone would have to be another one for every text. See the README.

Nulls: a null text is an empty one; texts below 100 bytes keep all. A null doc_id comes after all others. Rows that agree
in doc_id and text are one document and are treated alike. Long texts are scanned in overlapping slices. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import hashstore as hs
from textloom.llm.common import lean_batches, scratch, settled, table, tidy
from textloom.llm.words import pieces, powers

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
TOGETHER, SLICE, FLUSH, ROWS = 1 << 20, 1 << 20, 60_000, 4096
LAST = np.iinfo(np.int64).max
BLOBS = "bucket int, kind string, blob binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("blob", pa.binary())])
_ODD = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 24) - 1)


def _rows(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _cuts(keys: np.ndarray):
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, dtype=np.int64)
    return [(int(keys[i]), int(i), int(j)) for i, j in zip(edges[:-1], edges[1:], strict=True)]


def _by_bucket(kind: str, at: np.ndarray, *columns: np.ndarray):
    order = np.argsort(at, kind="stable")
    own = [c[order] for c in columns]
    return [(k, kind, hs.pack(*(c[i:j] for c in own))) for k, i, j in _cuts(at[order])]


class Documents:
    """The texts of a piece as bytes, with ids and digests."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids = np.array([LAST if x is None else x for x in batch.column("doc_id").to_pylist()], dtype=np.int64)
        self.raw = [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
        digests = [hashlib.blake2b(x, digest_size=16).digest() for x in self.raw]
        self.digests = np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2)
        self.sizes = np.array([len(x) for x in self.raw], dtype=np.int64)

    def keys(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return hs.mix(hs.mix(self.ids.astype(np.uint64)) + self.digests[:, 0])


def anchors(raw: list[bytes], who: list[int], cut: int = SLICE):
    """(hash, document, position, data, local position) of the anchors of documents; long ones by overlapping slices."""
    parts = []
    for k in who:
        n = len(raw[k])
        for begin in range(0, max(n - LENGTH + 1, 0), cut):
            low, high = max(begin - LENGTH, 0), min(begin + cut + 3 * LENGTH, n)
            parts.append((k, low, begin, min(begin + cut, n - LENGTH + 1), raw[k][low:high]))
    group: list = []
    size = 0
    for p in [*parts, None]:
        if p is None or size + len(p[4]) > 2 * cut and group:
            if group:
                yield _scan(group)
            group, size = [], 0
        if p is not None:
            group.append(p)
            size += len(p[4])


def _scan(group: list):
    data = np.frombuffer(b"".join(p[4] for p in group), dtype=np.uint8)
    n = len(data)
    sizes = np.array([len(p[4]) for p in group])
    firsts = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_ODD, n))])
        code = hs.mix((sums[GRAM:] - sums[:-GRAM]) * powers(pow(_ODD, -1, 1 << 64), n + 1)[: n - GRAM + 1])
    best = (code & ~_LOW) | np.arange(len(code), dtype=np.uint64)  # of equal grams, the first
    step = 1
    while 2 * step <= SPAN:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    best = np.minimum(best[: len(code) - SPAN + 1], best[SPAN - step : SPAN - step + len(code) - SPAN + 1])
    starts = np.concatenate([np.arange(f + p[2] - p[1], f + p[3] - p[1]) for p, f in zip(group, firsts, strict=True)])
    at = (best[starts] & _LOW).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    part = np.searchsorted(firsts, at, side="right") - 1
    doc = np.array([p[0] for p in group])[part]
    return code[at], doc, at - firsts[part] + np.array([p[1] for p in group])[part], data, at, firsts[part], (firsts + sizes)[part]


# -- what occurs twice ------------------------------------------------------------------------------------------------------


def _first_scan(buckets: int):
    def run(batches):
        for b in pieces(batches, TOGETHER):
            docs = Documents(b)
            long = np.flatnonzero(docs.sizes >= LENGTH)
            out = _by_bucket("d", (docs.digests[long, 0] % np.uint64(buckets)).astype(np.int64), docs.digests[long, 0], docs.digests[long, 1], docs.ids[long])
            # equal texts of this piece count once: the rest of a copy is no news
            _, first = np.unique(docs.digests[long, 0], return_index=True)
            codes = [x[0] for x in anchors(docs.raw, long[np.sort(first)].tolist(), SLICE)]
            if codes:
                code, times = np.unique(np.concatenate(codes), return_counts=True)
                # with the digest of the text it stands in, an anchor of copies in other pieces is told from a repeated one
                out += _by_bucket("a", (code % np.uint64(buckets)).astype(np.int64), code, np.minimum(times, 2).astype(np.uint8))
            yield _rows(out)

    return run


def _keep_repeated(base: str):
    def run(own: pa.Table) -> pa.Table:
        k = own.column("bucket")[0].as_py()
        own = own.filter(own.column("blob").is_valid())
        kinds = own.column("kind").to_pylist()
        blobs = [hs.unpack(x.as_buffer()) for x in own.column("blob")]
        arrays = {}
        texts = [b for b, kind in zip(blobs, kinds, strict=True) if kind == "d"]
        if texts:
            d1, d2, ids = (np.concatenate(c) for c in zip(*texts, strict=True))
            order = np.lexsort([ids, d2, d1])
            d1, d2, ids = d1[order], d2[order], ids[order]
            new = np.concatenate([[True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])])
            more = new & np.concatenate([~new[1:], [False]])
            arrays |= {"d1": d1[more], "d2": d2[more], "first": ids[more]}
        grams = [b for b, kind in zip(blobs, kinds, strict=True) if kind == "a"]
        if grams:
            code, times = (np.concatenate(c) for c in zip(*grams, strict=True))
            order = np.argsort(code)
            code, times = code[order], times[order]
            edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            arrays["anchor"] = code[edge][np.add.reduceat(times.astype(np.int64), edge) > 1]
        for name, kind in (("d1", np.uint64), ("d2", np.uint64), ("first", np.int64), ("anchor", np.uint64)):
            arrays.setdefault(name, np.zeros(0, dtype=kind))
        hs.save(f"{base}/twice-{k}", arrays)
        return pa.Table.from_batches([_rows([(k, "n", b"")])])

    return run


def _every_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    """With a row for each bucket, so that each has its file, and nobody needs to know which are there."""
    return rows.unionByName(rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit("").alias("kind"), F.lit(None).cast("binary").alias("blob")))


def _spots(base: str, buckets: int, name: str, keys: np.ndarray):
    """For each bucket that is needed: its arrays, who asks, and where each key is, or -1."""
    at = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort([keys, at])
    for k, i, j in _cuts(at[order]):
        own, who = hs.load(f"{base}/{name.split('.')[0]}-{k}"), order[i:j]
        table = own[name.split(".")[1]]
        if len(table):
            spot = np.minimum(np.searchsorted(table, keys[who]), len(table) - 1)
            yield own, who, np.where(table[spot] == keys[who], spot, -1)


def _later_copies(model: dict, docs: Documents) -> np.ndarray:
    """Which documents repeat the whole text of an earlier one."""
    out = np.zeros(len(docs.ids), dtype=bool)
    for own, who, spot in _spots(model["base"], model["buckets"], "twice.d1", docs.digests[:, 0]):
        hit = spot >= 0
        w, s = who[hit], spot[hit]
        out[w] = (own["d2"][s] == docs.digests[w, 1]) & (own["first"][s] < docs.ids[w])
    return out & (docs.sizes >= LENGTH)


# -- surroundings -----------------------------------------------------------------------------------------------------------


def _digests(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row of 64-bit words."""
    one, two = np.zeros(len(words), dtype=np.uint64), np.ones(len(words), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words.shape[1]):
            one = hs.mix(one ^ words[:, k])
            two = hs.mix(two + words[:, k] * np.uint64(0xD6E8FEB86659FD93))
    return one, two


def _earliest(body: np.ndarray, left: np.ndarray, right: np.ndarray, order: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Of equal surroundings: the earliest by order (a lexsort key), and those that are not."""
    one, two = _digests(np.ascontiguousarray(body).view(np.uint64))
    place = hs.mix(left.astype(np.uint64) * np.uint64(256) + right.astype(np.uint64) + np.uint64(1))
    at = np.lexsort((*order, two, one ^ place))
    a, b = (one ^ place)[at], two[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.sort(at[new]), np.sort(at[~new])


WIDE = 2 * (SPAN - 1) + GRAM


def _second_scan(model: dict):
    buckets = model["buckets"]

    def run(batches):
        held: list = []
        size = 0

        def flush():
            code, key, ids, start, left, right, body = (np.concatenate(c) for c in zip(*held, strict=True))
            first, later = _earliest(body, left, right, (start, key, ids))
            # a copy in this task is removed here; it holds nothing that its earliest one doesn't hold
            whole = later[left[later] + right[later] + GRAM >= LENGTH]
            whole = whole[~_same_place(whole, first, key, start)]
            out = _by_bucket("r", (key[whole] % np.uint64(buckets)).astype(np.int64), key[whole], start[whole], start[whole] + left[whole] + right[whole] + GRAM)
            first = first[np.argsort(code[first], kind="stable")]
            at = (code[first] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            f = first[order]
            for k, i, j in _cuts(at[order]):
                w = f[i:j]
                out.append((k, "c", hs.pack(key[w], ids[w], start[w], left[w].astype(np.uint8), right[w].astype(np.uint8)) + _packed_rows(body[w])))
            return _rows(out)

        for b in pieces(batches, TOGETHER):
            docs = Documents(b)
            todo = np.flatnonzero((docs.sizes >= LENGTH) & ~_later_copies(model, docs))
            keys = docs.keys()
            for code, doc, pos, data, at, low, high in anchors(docs.raw, todo.tolist(), SLICE):
                twice = np.zeros(len(code), dtype=bool)
                for _, who, spot in _spots(model["base"], buckets, "twice.anchor", code):
                    twice[who] = spot >= 0
                w = np.flatnonzero(twice)
                if not len(w):
                    continue
                left = np.minimum(at[w] - low[w], SPAN - 1)
                right = np.minimum(high[w] - at[w] - GRAM, SPAN - 1)
                spot = at[w][:, None] + np.arange(-(SPAN - 1), GRAM + SPAN - 1)[None, :]
                inside = (spot >= (at[w] - left)[:, None]) & (spot < (at[w] + GRAM + right)[:, None])
                body = np.where(inside, data[np.clip(spot, 0, len(data) - 1)], 0).astype(np.uint8)
                held.append((code[w], keys[doc[w]], docs.ids[doc[w]], pos[w] - left, left, right, body))
                size += len(w)
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _same_place(later: np.ndarray, first: np.ndarray, key, start) -> np.ndarray:
    """Which of later are the same place of the same document as an earliest one (rows that agree in doc_id and text)."""
    if not len(later):
        return np.zeros(0, dtype=bool)
    place = hs.mix(key ^ hs.mix(start.astype(np.uint64)))
    return np.isin(place[later], place[first])


def _packed_rows(body: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(body).tobytes()
    return pa.compress(raw, "zstd", asbytes=True)


def _contexts(blob):
    """The columns and the bytes of one blob."""
    columns, at = [], 0
    for _ in range(5):
        size = int.from_bytes(blob[at + 12 : at + 20].to_pybytes(), "little")
        columns += hs.unpack(blob[at : at + 20 + size])
        at += 20 + size
    raw = pa.decompress(blob[at:], decompressed_size=len(columns[0]) * WIDE, codec="zstd", asbytes=True)
    return [*columns, np.frombuffer(raw, dtype=np.uint8).reshape(-1, WIDE)]


def window_classes(body: np.ndarray, left: np.ndarray, right: np.ndarray):
    """(row, offset, class) of all windows inside the rows. Classes are numbered in the order of the windows' digests."""
    several = np.maximum(left + right + GRAM - LENGTH + 1, 0)
    done = np.cumsum(several)
    row = np.repeat(np.arange(len(body)), several)
    offset = np.arange(len(row)) - (done - several)[row]
    digests = [np.empty(len(row), dtype=np.uint64) for _ in range(2)]
    for i in range(0, len(body), ROWS):  # so many rows at a time: what is summed up is eight times as large as they are
        j = min(i + ROWS, len(body))
        here = slice(int(done[i] - several[i]), int(done[j - 1]))
        at = (row[here] - i) * WIDE + (SPAN - 1 - left)[row[here]] + offset[here]
        flat = body[i:j].ravel().astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            for d, base in zip(digests, (_ODD, 0xD1342543DE82EF95), strict=True):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(flat * powers(base, len(flat)))])
                d[here] = (sums[at + LENGTH] - sums[at]) * powers(pow(base, -1, 1 << 64), len(flat) + 1)[at]
    order = np.lexsort((digests[1], digests[0]))
    new = np.zeros(len(row), dtype=bool)
    for d in digests:
        new[1:] |= d[order][1:] != d[order][:-1]
    group = np.empty(len(row), dtype=np.int64)
    group[order] = np.cumsum(new)
    return row, offset, group


def _mark(buckets: int):
    def run(own: pa.Table) -> pa.Table:
        parts = [_contexts(x.as_buffer()) for x in own.column("blob")]
        key, ids, start, left, right, body = (np.concatenate(c) for c in zip(*parts, strict=True))
        left, right = left.astype(np.int64), right.astype(np.int64)
        del parts
        first, later = _earliest(body, left, right, (start, key, ids))
        whole = later[(left + right + GRAM >= LENGTH)[later]]
        whole = whole[~_same_place(whole, first, key, start)]
        cut_key, cut_from, cut_to = [key[whole]], [start[whole]], [(start + left + right + GRAM)[whole]]
        # one number for each (document, start): equal places are no copies of each other
        row, offset, group = window_classes(body[first], left[first], right[first])
        if len(row):
            at = start[first][row] + offset
            order = np.lexsort([at, key[first][row], ids[first][row]])
            k, s = key[first][row][order], at[order]
            place = np.empty(len(row), dtype=np.int64)
            place[order] = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]) | (s[1:] != s[:-1])]))
            least = np.full(int(group.max()) + 1, len(row), dtype=np.int64)
            np.minimum.at(least, group, place)
            gone = np.flatnonzero(place > least[group])
            if len(gone):
                run_first = np.flatnonzero(np.concatenate([[True], (row[gone][1:] != row[gone][:-1]) | (offset[gone][1:] != offset[gone][:-1] + 1)]))
                run_last = np.append(run_first[1:] - 1, len(gone) - 1)
                cut_key.append(key[first][row[gone[run_first]]])
                cut_from.append(at[gone[run_first]])
                cut_to.append(at[gone[run_last]] + LENGTH)
        key, low, high = np.concatenate(cut_key), np.concatenate(cut_from), np.concatenate(cut_to)
        return pa.Table.from_batches([_rows(_by_bucket("r", (key % np.uint64(buckets)).astype(np.int64), key, low, high))])

    return run


def merged(key: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Ranges of each key, joined where they meet or touch."""
    order = np.lexsort([low, key])
    key, low, high = key[order], low[order], high[order]
    if not len(key):
        return key, low, high
    own = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    big = int(high.max()) + 2
    reach = np.maximum.accumulate(high + own * big)
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (low[1:] + own[1:] * big > reach[:-1])])
    first = np.flatnonzero(new)
    return key[first], low[first], (reach - own * big)[np.append(first[1:] - 1, len(key) - 1)]


def _keep_cuts(base: str):
    def run(own: pa.Table) -> pa.Table:
        k = own.column("bucket")[0].as_py()
        parts = [hs.unpack(x.as_buffer()) for x in own.column("blob") if x.is_valid]
        none = [np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int64)]
        key, low, high = merged(*([np.concatenate(c) for c in zip(*parts, strict=True)] or none))
        hs.save(f"{base}/cuts-{k}", {"key": key, "low": low, "high": high})
        return pa.Table.from_batches([_rows([(k, "n", b"")])])

    return run


def fit(documents: DataFrame) -> dict:
    """Finds all ranges to remove; they lie in the shared folder, and workers need this to use them."""
    spark = documents.sparkSession
    lean_batches(spark)
    base = scratch(spark, "repeats")
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (4 << 20))
    settled(_every_bucket(documents.mapInArrow(_first_scan(buckets), BLOBS), buckets).groupBy("bucket").applyInArrow(tidy(_keep_repeated(base)), BLOBS), "twice")
    model = {"base": base, "buckets": buckets}
    around = settled(documents.mapInArrow(_second_scan(model), BLOBS), "around")
    cuts = around.where("kind = 'r'").unionByName(around.where("kind = 'c'").groupBy("bucket").applyInArrow(tidy(_mark(buckets)), BLOBS))
    settled(_every_bucket(cuts, buckets).groupBy("bucket").applyInArrow(tidy(_keep_cuts(base)), BLOBS), "cuts")
    return model


def _ranges(model: dict, docs: Documents):
    """For each document: the ranges to remove, as arrays."""
    later, keys = _later_copies(model, docs), docs.keys()
    none = np.zeros(0, dtype=np.int64)
    out = [(np.zeros(1, dtype=np.int64), np.array([n])) if c else (none, none) for c, n in zip(later, docs.sizes.tolist(), strict=True)]
    for own, who, spot in _spots(model["base"], model["buckets"], "cuts.key", keys):
        ends = np.searchsorted(own["key"], keys[who], side="right")
        for w, i, j in zip(who.tolist(), spot.tolist(), ends.tolist(), strict=True):
            if i >= 0 and not later[w]:
                i = int(np.searchsorted(own["key"], keys[w]))
                out[w] = own["low"][i:j], own["high"][i:j]
    return out


def _left(raw: bytes, low, high) -> bytes:
    edges = [0, *(x for r in zip(low.tolist(), high.tolist(), strict=True) for x in r), len(raw)]
    return b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _third_scan(model: dict):
    def run(batches):
        for b in pieces(batches, TOGETHER):
            docs = Documents(b)
            ranges = _ranges(model, docs)
            rows = [(len(raw), int((high - low).sum()), len(low), hashlib.sha256(_left(raw, low, high)).hexdigest()) for raw, (low, high) in zip(docs.raw, ranges, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], [x.split()[0] for x in OUT.split(", ")])

    return run


def removed(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what remains, for every document (doc_id, text)."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(_third_scan(fit(own)), OUT)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))
