"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, exactly.

A shingle is a 64-bit hash of its words. First, sets that cannot have a partner go: at least 0.8 of a set's shingles must
occur in a second document, and compressed arrays of shingles, met by hash range, tell how many do. Equal sets become one
class. Then the pigeonhole principle on a partition of the universe: sizes fall into bands by a ratio of 1.25; in a band,
sets that are similar differ by at most H shingles, and a hash deals all shingles to M = 1.3 (H + 1) segments. Every set
indexes its segments' subsets. A set probes its own band and the next, with segments that are allocated by their cost (the
number of sets that share the subset): each takes one unit of as many as its own size asks for, H + 1 at most, so that one
of them is equal in a similar set. Where subsets that more than HOT sets share would be needed, cheaper segments take two
units instead: they also match with one shingle more or less, through one-deletion neighbourhoods of the probe and of the
index. Empty segments, which sets share that have nothing else in common, come last; those with fewer than two shingles,
which are empty with one less, never take two units.

Candidates are verified on the whole sets. Not all pairs that share a subset are looked at: first each set against those
MEETS leads (smallest ids of subsets) with which it shares most, then, of each subset that lies in several components
still, those pairs that are in different ones. Links give the components by star steps. All groups are joined or aggregated
by keys, none is collected.

Nulls: a null text, and one without words, has an empty set and links with nothing. A null doc_id is dropped from the
join and returned as its own component (null). Fewer than five words are one shingle. Repeated rows are equal sets.
Very long texts give long arrays, one row each. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import hashstore as hs
from textloom.llm.common import discard, lean_batches, settled, table, tidy, trim
from textloom.llm.components import components
from textloom.llm.words import hash_strings, pieces, split

TOGETHER, CHUNK, BUCKET, BLOCK, SHINGLES = 1 << 20, 3_000_000, 2_000_000, 512, 1_000_000
WIDTH, PERCENT, RATIO, SLACK, HOT, MEETS = 5, 80, 1.25, 1.3, 64, 2


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, in order of text and hash, and each one's text."""
    owner, place, distinct = split(texts)
    words = hash_strings(distinct)[place]
    counts = np.bincount(owner, minlength=len(texts))
    starts = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        sums = words.copy()
        for k in range(1, width):
            sums[:-k] = hs.mix(sums[:-k] * np.uint64(3) + words[k:]) if k < len(words) else sums[:-k]
        at = np.arange(len(words)) - starts[owner]
        whole = at + width <= counts[owner]
        who, code = owner[whole], sums[whole]
        short = np.flatnonzero((counts > 0) & (counts < width))
        few = [(np.bitwise_xor.reduce(hs.mix(words[starts[i] : starts[i] + counts[i]] + np.arange(1, counts[i] + 1, dtype=np.uint64) * np.uint64(0xABCDEF1234567))) + np.uint64(counts[i])) for i in short]
    who, code = np.concatenate([who, short]), np.concatenate([code, np.array(few, dtype=np.uint64)])
    order = np.lexsort([code, who])
    who, code = who[order], code[order]
    new = np.ones(len(who), dtype=bool)
    new[1:] = (who[1:] != who[:-1]) | (code[1:] != code[:-1])
    return code[new], who[new]


def _cuts(keys: np.ndarray):
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, dtype=np.int64)
    return [(int(keys[i]), int(i), int(j)) for i, j in zip(edges[:-1], edges[1:], strict=True)]


# -- which sets can have a partner ------------------------------------------------------------------------------------

_PART = "bucket long, chunk string, ids binary, blob binary"


def _deal(width: int, buckets: int):
    """Shingles of chunks of documents, by hash range; for each chunk also its documents and their sizes."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()  # a second attempt reads the same rows under the same number
        held, size, turn = [], 0, 0

        def flush():
            n = np.cumsum([0, *(len(i) for i, _, _ in held)])
            ids, code = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            who = np.concatenate([x[2] + m for x, m in zip(held, n[:-1], strict=True)])
            chunk, n = f"{part}/{turn}", int(n[-1])
            order = np.argsort(code)
            code, who = code[order], who[order].astype(np.uint16 if n < 1 << 16 else np.uint32)
            # the range of a hash is its bucket; 32 bits within the range are enough here, chance hits only keep more sets
            at = ((code >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            low = ((code >> np.uint64(8)) * np.uint64(buckets) >> np.uint64(24)).astype(np.uint32)
            rows = [((part * 131 + turn) % buckets, chunk, hs.pack(ids, np.bincount(who, minlength=n).astype(np.uint32)), None)]
            rows += [(k, chunk, None, hs.pack(np.diff(low[i:j], prepend=np.uint32(0)), who[i:j]) + n.to_bytes(4, "little")) for k, i, j in _cuts(at)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk", "ids", "blob"])

        for b in pieces(batches, TOGETHER):
            code, who = shingles(b.column("text"), width)
            held.append((b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), code, who))
            size += len(code) + b.num_rows
            if size > CHUNK:
                yield flush()
                held, size, turn = [], 0, turn + 1
        if held:
            yield flush()
        held = []
        trim()

    return run


def _shared(own: pa.Table) -> pa.Table:
    """For each chunk: how many of each document's shingles in this range a second document has. What tells a chunk's documents passes through."""
    heads, own = own.filter(own.column("ids").is_valid()), own.filter(own.column("ids").is_null())
    if not own.num_rows:
        return heads.select(["chunk", "ids", "blob"])
    blobs = [x.as_buffer() for x in own.column("blob")]
    parts = [hs.unpack(x[: x.size - 4]) for x in blobs]
    sizes = [int.from_bytes(x[x.size - 4 :].to_pybytes(), "little") for x in blobs]
    code = np.concatenate([np.cumsum(p[0], dtype=np.uint32) for p in parts])
    order = np.argsort(code)
    code = code[order]
    same = np.concatenate([[False], code[1:] == code[:-1], [False]])
    twice = np.empty(len(code), dtype=bool)
    twice[order] = same[1:] | same[:-1]
    at, out = 0, []
    for p, n in zip(parts, sizes, strict=True):
        hit = twice[at : at + len(p[1])]
        at += len(p[1])
        out.append(hs.pack(np.bincount(p[1][hit], minlength=n).astype(np.uint32)))
    counts = pa.table({"chunk": own.column("chunk").combine_chunks(), "ids": pa.nulls(len(out), pa.binary()), "blob": pa.array(out, pa.binary())})
    return pa.concat_tables([heads.select(["chunk", "ids", "blob"]).cast(counts.schema), counts])


def _survivors(percent: int):
    def run(own: pa.Table) -> pa.Table:
        total, ids, sizes = 0, None, None
        for head, blob in zip(own.column("ids"), own.column("blob"), strict=True):
            if head.is_valid:
                ids, sizes = hs.unpack(head.as_buffer())
            else:
                total = total + hs.unpack(blob.as_buffer())[0].astype(np.int64)
        total = total if isinstance(total, np.ndarray) else np.zeros(len(ids), dtype=np.int64)
        sizes = sizes.astype(np.int64)
        return pa.table({"doc_id": ids, "n_shingles": sizes, "may": (sizes > 0) & (100 * total >= percent * sizes)})

    return run


def candidates(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, may: whether enough of its shingles occur elsewhere for any partner."""
    scanned = documents.select("doc_id", "text").where("doc_id IS NOT NULL")
    total = scanned.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = scanned.mapInArrow(_deal(width, max(1, -(-total // 6 // BUCKET))), _PART)
    counts = dealt.groupBy("bucket").applyInArrow(tidy(_shared), "chunk string, ids binary, blob binary")
    return counts.groupBy("chunk").applyInArrow(tidy(_survivors(percent)), "doc_id long, n_shingles long, may boolean")


# -- classes of equal sets ------------------------------------------------------------------------------------------------


def _sets(width: int):
    """Each document's set, sorted, its size and a digest of it (null for an empty set, which equals no other)."""

    def run(batches):
        for b in pieces(batches, TOGETHER):
            code, who = shingles(b.column("text"), width)
            cut = np.searchsorted(who, np.arange(b.num_rows + 1))
            blobs = [code[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
            keys = [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in blobs]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(cut)), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], ["doc_id", "n", "key", "shingles"])

    return run


# -- segments ---------------------------------------------------------------------------------------------------------------


def band_of(n: int) -> int:
    """The band of a size; band k holds sizes from about RATIO**k."""
    return int(math.floor(math.log(n) / math.log(RATIO) + 1e-9))


def difference(band: int, percent: int = PERCENT) -> int:
    """The most shingles by which a set of a band and a similar one that isn't larger than the band's largest can differ."""
    largest = math.ceil(RATIO ** (band + 1) * (1 + 1e-9))
    return (100 - percent) * 2 * largest // (100 + percent)


def units(n: int, band: int, percent: int = PERCENT) -> int:
    """One more than the shingles by which a set of size n and a similar one of a band can differ."""
    largest = min(math.ceil(RATIO ** (band + 1) * (1 + 1e-9)), 100 * n // percent)
    return (100 - percent) * (n + largest) // (100 + percent) + 1


def segments(code: np.ndarray, band: int, percent: int = PERCENT):
    """The segment of each shingle in a band, and its share in the subset's hash (a sum, so that one can be taken off)."""
    m = int(math.ceil(SLACK * (difference(band, percent) + 1)))
    return (hs.mix(code + np.uint64(band)) % np.uint64(m)).astype(np.int64), hs.mix(code ^ np.uint64(0x5851F42D4C957F2D)), m


def _index(percent: int):
    """Subset hashes of each set's segments in its own band and in the next, the units it needs there, and the segments with fewer than two shingles. Segments that are empty have the hash 0."""

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("rep", "band", "own", "need")}
            sigs, weak = [], []
            for rep, blob in zip(b.column("rep").to_pylist(), b.column("shingles"), strict=True):
                code = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
                own = band_of(len(code))
                for band in (own, own + 1):
                    seg, value, m = segments(code, band, percent)
                    order = np.argsort(seg, kind="stable")
                    sums = np.zeros(m, dtype=np.uint64)
                    cut = np.flatnonzero(np.concatenate([[True], seg[order][1:] != seg[order][:-1]]))
                    with np.errstate(over="ignore"):
                        sums[seg[order][cut]] = np.add.reduceat(value[order], cut)
                    for k, x in zip(out, (rep, band, band == own, units(len(code), band, percent)), strict=True):
                        out[k].append(x)
                    sigs.append(sums.view(np.int64))
                    weak.append(np.flatnonzero(np.bincount(seg, minlength=m) < 2).astype(np.int32))
            if sigs:
                lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)], dtype=np.int32), np.concatenate(x)) for x in (weak, sigs)]
                scalars = [pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int32(), pa.bool_(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*scalars, *lists], [*out, "weak", "sigs"])
        trim()

    return run


def _deletions(percent: int):
    """Hashes of the asked segments (rep, band, seg lists) with one shingle taken off."""

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("rep", "band", "seg", "sig")}
            for rep, blob, band, segs in zip(b.column("rep").to_pylist(), b.column("shingles"), b.column("band").to_pylist(), b.column("segs"), strict=True):
                code = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
                seg, value, m = segments(code, band, percent)
                sums = np.zeros(m, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    np.add.at(sums, seg, value)
                    asked = np.isin(seg, np.array(segs.as_py(), dtype=np.int64))
                    less = (sums[seg] - value)[asked]
                out["rep"].append(np.full(len(less), rep))
                out["band"].append(np.full(len(less), band, dtype=np.int32))
                out["seg"].append(seg[asked].astype(np.int32))
                out["sig"].append(less.view(np.int64))
            if out["rep"]:
                yield pa.RecordBatch.from_pydict({k: np.concatenate(v) for k, v in out.items()})

    return run


# -- verification -------------------------------------------------------------------------------------------------------------


def _codes(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in column]


def _whole_groups(batches, names: list[str]):
    """Tables of whole groups (rows that agree in names) from batches in which groups follow each other."""
    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
        new = np.zeros(b.num_rows, dtype=bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        if held:
            new[0] = any(held[-1].column(c)[-1].as_py() != k[0] for c, k in zip(names, keys, strict=True))
        edge = np.flatnonzero(new)
        cut = int(edge[-1]) if len(edge) else 0
        if len(edge):
            if whole := [x for x in [*held, b.slice(0, cut)] if x.num_rows]:
                yield pa.Table.from_batches(whole).combine_chunks()
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _stars(percent: int, kind: str):
    """Links of each group's first row (its lead) with the others."""

    def run(batches):
        for own in _whole_groups(batches, ["lead", "block"]):
            lead, rep, sets = own.column("lead").to_pylist(), own.column("rep").to_pylist(), _codes(own.column("shingles"))
            keep, x = [], None
            for k, (a, b, y) in enumerate(zip(rep, lead, sets, strict=True)):
                if a == b:
                    x = y
                elif len(x) * percent <= len(y) * 100 and len(y) * percent <= len(x) * 100:
                    same = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                    if 100 * same >= percent * (len(x) + len(y) - same):
                        keep.append(k)
            yield pa.RecordBatch.from_pydict({"a": pa.array([rep[k] for k in keep], kind), "b": pa.array([lead[k] for k in keep], kind)})
        trim()

    return run


def common(rows: list[np.ndarray], columns: list[np.ndarray], chunk: int = 4096, most: int = 4 << 20) -> np.ndarray:
    """The number of common codes of each row's set and each column's."""
    n, m = len(rows), len(columns)
    out = np.zeros(n * m, dtype=np.int64)
    if not n or not m:
        return out.reshape(n, m)
    r, c = np.concatenate(rows), np.concatenate(columns)
    both = np.intersect1d(r, c)
    if not len(both):
        return out.reshape(n, m)

    def entries(codes, sets):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(both, codes), len(both) - 1)
        hit = both[at] == codes
        at, owner = at[hit], owner[hit]
        order = np.argsort(at, kind="stable")
        return at[order], owner[order]

    (r, row), (c, column) = entries(r, rows), entries(c, columns)
    in_rows, in_columns = np.bincount(r, minlength=len(both)), np.bincount(c, minlength=len(both))
    begin = np.cumsum(in_columns) - in_columns
    heavy = in_rows * in_columns > max(64, n * m // 256)  # a product of matrices is cheaper for these
    light = np.flatnonzero(~heavy[r])
    size = in_columns[r[light]]
    done = np.cumsum(size)
    for k in range(int(done[-1]) // most + 1 if len(done) else 0):
        i, j = np.searchsorted(done, [k * most, (k + 1) * most], side="right")
        who, times = light[i:j], size[i:j]
        if len(who):
            met = column[np.repeat(begin[r[who]] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
            out += np.bincount(np.repeat(row[who], times) * m + met, minlength=n * m)
    out = out.reshape(n, m)
    number = np.cumsum(heavy) - 1
    r_heavy, c_heavy = np.flatnonzero(heavy[r]), np.flatnonzero(heavy[c])
    for k in range(0, int(heavy.sum()), chunk):
        x, y = np.zeros((n, chunk), dtype=np.float32), np.zeros((m, chunk), dtype=np.float32)
        for z, code, who, at in ((x, r, row, r_heavy), (y, c, column, c_heavy)):
            here = at[(number[code[at]] >= k) & (number[code[at]] < k + chunk)]
            z[who[here], number[code[here]] - k] = 1
        out += (x @ y.T).astype(np.int64)
    return out


def _blocks(percent: int, kind: str):
    """Links of the rows of each block (side 0) with its columns (side 1) of other parts: not all, but as many as connect what they connect."""

    def run(batches):
        for own in _whole_groups(batches, ["lead", "row", "col"]):
            side, ids, parts = (own.column(c).to_numpy() for c in ("side", "rep", "part"))
            sets = _codes(own.column("shingles"))
            mine, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            same = common([sets[k] for k in mine], [sets[k] for k in other])
            size = np.array([len(x) for x in sets])
            near = (100 * same >= percent * (size[mine][:, None] + size[other][None, :] - same)) & (parts[mine][:, None] != parts[other][None, :])
            a, b = np.nonzero(near)
            # a link for each row and column of a part of the graph, to its smallest id
            low, high = ids[mine].copy(), ids[other].copy()
            while len(a):
                l, h = low.copy(), high.copy()
                np.minimum.at(low, a, high[b])
                np.minimum.at(high, b, low[a])
                if (l == low).all() and (h == high).all():
                    break
            rows, columns = np.unique(a), np.unique(b)
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate([ids[mine][rows], ids[other][columns]]), kind), "b": pa.array(np.concatenate([low[rows], high[columns]]), kind)})
        trim()

    return run


def _first_links(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among pairs (rep, lead, hits): each lead meets its own in blocks of bounded size, each set the leads with most hits."""
    size = classes.select(F.col("rep").alias("lead"), F.col("n").alias("m"))
    fit = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    near = pairs.where("rep <> lead").join(size, "lead").join(classes.select("rep", "n"), "rep").where(fit)
    best = F.slice(F.sort_array(F.collect_list(F.struct("hits", F.negative("lead").alias("lead"))), asc=False), 1, MEETS)
    own = settled(near.groupBy("rep").agg(F.first("n").alias("n"), best.alias("best")).select("rep", "n", F.explode("best.lead").alias("lead")).withColumn("lead", F.negative("lead")), "stars")
    sizes = own.groupBy("lead").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("blocks"))
    member = own.join(sizes, "lead").select("lead", "rep", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"))
    heads = sizes.select("lead", F.col("lead").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = member.unionByName(heads).hint("merge").join(classes.select("rep", "shingles"), "rep")
    dealt = rows.repartition("lead", "block").sortWithinPartitions("lead", "block", F.col("rep") != F.col("lead"))
    return settled(dealt.select("lead", "block", "rep", "shingles").mapInArrow(_stars(percent, pa.int64()), "a long, b long"), "first-links")


def _other_links(spots: DataFrame, parts: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join different parts, found in blocks of groups.

    Subsets (spots) within one part need nothing more. Those that share another are in the group of its largest part: near
    copies share many subsets, and would be compared for each; sets that have nothing else in common with them stay out.
    """
    named = classes.select("rep", "n").join(parts, "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component")
    # the settled sizes of parts let Spark split the join at a large part
    member = settled(named.join(settled(named.groupBy("part").agg(F.count("*").alias("size")), "sizes").hint("merge"), "part"), "named")
    spread = settled(spots.join(member.select("rep", "part", "size").hint("merge"), "rep").select("spot", "rep", "part", "size"), "spread")
    main = spread.groupBy("spot").agg(F.max(F.struct("size", F.negative("part").alias("part"))).alias("main"), F.min("part").alias("low"), F.max("part").alias("high"))
    met = spread.join(main.where("low < high").select("spot", F.negative("main.part").alias("lead")).hint("merge"), "spot").select("lead", "rep").distinct()
    own = settled(met.join(member.drop("size").hint("merge"), "rep").select("lead", "rep", "part", "n"), "groups")
    discard(spread)
    by_part = own.groupBy("lead", "part").agg(F.count("*").alias("k"), F.sum("n").alias("m"))
    # the largest part's members needn't meet each other: all others meet the whole group
    most = by_part.groupBy("lead").agg(F.max(F.struct("k", "part", "m")).alias("most"), F.sum("k").alias("k"), F.sum("m").alias("m"), F.count("*").alias("parts")).where("parts > 1")
    number = lambda k, m: F.greatest(F.ceil(k / BLOCK), F.ceil(m / SHINGLES)).cast("int")
    plan = settled(most.select("lead", F.col("most.part").alias("main"), number(F.col("k") - F.col("most.k"), F.col("m") - F.col("most.m")).alias("rows"), number(F.col("k"), F.col("m")).alias("cols")), "plan")
    all_of = own.join(plan, "lead")
    at = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    mine = all_of.where("part <> main").select("lead", at("rows", 1).alias("row"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"), F.lit(0).alias("side"), "rep", "part")
    other = all_of.select("lead", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), at("cols", 2).alias("col"), F.lit(1).alias("side"), "rep", "part")
    rows = mine.unionByName(other).hint("merge").join(classes.select("rep", "shingles"), "rep")
    dealt = rows.repartition("lead", "row", "col").sortWithinPartitions("lead", "row", "col")
    return settled(dealt.select("lead", "row", "col", "side", "rep", "part", "shingles").mapInArrow(_blocks(percent, pa.int64()), "a long, b long"), "other-links")


def similar_pairs(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between classes (rep long, n, shingles; distinct sets, none empty) that connect all classes which similarity connects."""
    kind = "bigint"
    sets = settled(classes.mapInArrow(_index(percent), f"rep {kind}, band int, own boolean, need int, weak array<int>, sigs array<long>"), "subsets")
    subsets = sets.select("rep", "band", "own", F.posexplode("sigs").alias("seg", "sig"))
    key = ["band", "seg", "sig"]
    cost = subsets.groupBy(*key).agg(F.count_if("own").alias("n"), F.count("*").alias("all")).where("all > 1 AND n > 0")
    # Segments whose subset nobody else has cost nothing and find nothing: a set's own bands' number of segments tells how many there are
    told = subsets.join(cost.hint("merge"), key).where("n > CAST(own AS INT)")
    by_set = told.groupBy("rep", "band").agg(F.sort_array(F.collect_list(F.struct((F.col("sig") == 0).alias("empty"), "n", "seg", "sig"))).alias("met"))
    by_set = by_set.join(sets.select("rep", "band", "need", "weak", F.size("sigs").alias("m")).hint("merge"), ["rep", "band"])
    is_cheap = lambda s: (s["n"] <= HOT) & ~s["empty"]
    segs = lambda c: F.transform(c, lambda s: s["seg"])
    by_set = by_set.withColumn("cheap", F.filter("met", is_cheap)).withColumn("lack", F.greatest(F.col("need") - F.col("m") + F.size("met"), F.lit(0)))
    # one unit from each: the cheapest; where hot subsets would be among them, the free and the cheap ones take a second unit first
    free = F.array_except(F.sequence(F.lit(0), F.col("m") - 1), F.concat(segs("met"), "weak"))
    by_set = by_set.withColumn("sturdy", F.when(F.col("lack") > F.size("cheap"), F.concat(free, F.array_except(segs("cheap"), "weak"))).otherwise(F.array().cast("array<int>")))
    by_set = by_set.withColumn("second", F.greatest(F.least(F.col("lack") - F.size("cheap"), F.size("sturdy")), F.lit(0)))
    by_set = by_set.withColumn("hot", F.greatest(F.col("lack") - F.size("cheap") - F.col("second"), F.lit(0)))
    chosen = F.concat(F.slice("cheap", F.lit(1), F.least("lack", F.size("cheap"))), F.slice(F.filter("met", lambda s: ~is_cheap(s)), F.lit(1), F.col("hot")))
    plan = settled(by_set.select("rep", "band", chosen.alias("chosen"), F.slice("sturdy", F.lit(1), F.col("second")).alias("segs")), "plan")
    probes = plan.select("rep", "band", F.explode("chosen").alias("s")).select("rep", "band", "s.seg", "s.sig", F.lit("F").alias("space"))
    index = subsets.where("own").select("rep", *key, F.lit("F").alias("space"))
    twice = settled(plan.where("size(segs) > 0").select("rep", "band", "segs"), "twice")
    if twice.limit(1).count():
        asked = twice.select("band", F.explode("segs").alias("seg")).distinct().groupBy("band").agg(F.collect_list("seg").alias("segs"))
        shape = f"rep {kind}, band int, seg int, sig long"
        minus = classes.join(twice, "rep").select("rep", "shingles", "band", "segs").mapInArrow(_deletions(percent), shape)
        own = sets.where("own").select("rep", "band").join(asked, "band")
        indexed = classes.join(own, "rep").select("rep", "shingles", "band", "segs").mapInArrow(_deletions(percent), shape)
        # the asked subsets are read off the arrays of the sets that ask: few do, and the rest stays folded
        taken = F.transform("segs", lambda s: F.struct(s.alias("seg"), F.get("sigs", s).alias("sig")))
        full = sets.select("rep", "band", "sigs").join(twice, ["rep", "band"]).select("rep", "band", F.explode(taken).alias("s")).select("rep", "band", "s.seg", "s.sig")
        both = full.withColumn("space", F.explode(F.array(F.lit("F"), F.lit("D"))))
        probes = probes.unionByName(both).unionByName(minus.withColumn("space", F.lit("F")))
        index = index.unionByName(indexed.withColumn("space", F.lit("D")))
    spot = F.xxhash64("space", "band", "seg", "sig").alias("spot")
    probes = settled(probes.select("rep", spot).distinct(), "probes")
    index = settled(index.select("rep", spot).join(probes.select("spot").distinct(), "spot", "left_semi").distinct(), "index")
    for x in (sets, plan, twice):
        discard(x)
    # each subset's lead is the smallest class that has it; all that share the subset meet the lead first
    spots = probes.unionByName(index)
    leads = spots.groupBy("spot").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last")
    pairs = settled(spots.join(leads, "spot").groupBy("lead", "rep").agg(F.count("*").alias("hits")), "spots")
    links = _first_links(pairs, classes, percent)
    discard(pairs)
    parts = settled(components(links).withColumnRenamed("node", "rep"), "parts")
    other = _other_links(spots, parts, classes, percent)
    for x in (probes, index):
        discard(x)
    return links.unionByName(other)


def groups(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every document (doc_id long, text)."""
    lean_batches(documents.sparkSession)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = settled(candidates(documents, width, percent), "shared")
    may = known.where("may").select("doc_id").distinct()
    own = documents.join(may.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id long, n long, key binary, shingles binary")
    sets = settled(own.withColumn("row", F.monotonically_increasing_id()), "sets")
    # a class is numbered by one of its rows: several classes may have the same smallest doc_id
    rows = settled(sets.select("doc_id", "n", "key", "row"), "rows")
    reps = settled(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("row").alias("rep"), F.min("doc_id").alias("first")), "reps")
    classes = settled(sets.join(reps.select(F.col("rep").alias("row")).hint("merge"), "row", "left_semi").select(F.col("row").alias("rep"), "n", "shingles"), "classes")
    discard(sets)
    parts = settled(components(similar_pairs(classes, percent)).withColumnRenamed("node", "rep"), "parts")
    discard(classes)
    named = reps.join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    # written first: a join of two plain shuffles is one whose hot keys Spark can split
    member = settled(named.join(smallest, "component").select("key", "component_id"), "members")
    linked = rows.join(member.hint("merge"), "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = known.join(may.hint("merge"), "doc_id", "left_anti").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    loose = documents.where("doc_id IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return alone.unionByName(linked).unionByName(loose)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
