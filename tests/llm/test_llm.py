"""The operators against brute force, with nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import components, embeddings, jaccard, jpeg, lines, lm, media, mixing, pieces, quality, repeats, urlfilter
from textloom.llm.common import settled

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, doc string"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def make_docs(seed=1, n=70):
    """Random prose with exact and near copies, shared passages, nulls, empty and long texts and repeated rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéÀñ.") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    sentence = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = sentence(60)
    texts = []
    for k in range(n):
        kind = k % 10
        if kind == 0 or not texts:
            t = "\n".join(sentence(rng.randint(3, 40)) for _ in range(rng.randint(1, 6)))
        elif kind == 1:
            t = rng.choice([x for x in texts if x])
        elif kind == 2:
            w = rng.choice([x for x in texts if x]).split(" ")
            w[rng.randrange(len(w))] = "CHANGED"
            t = " ".join(w)
        elif kind == 3:
            t = sentence(10) + "\n" + passage + "\n" + sentence(10)
        elif kind == 4:
            t = rng.choice([None, "", " \n\t ", "one", "two words", "Y " * 200, "x" * 2000, "end  😀 \x01", "ab" * 150])
        else:
            t = "\n".join(sentence(rng.randint(3, 40)) for _ in range(rng.randint(1, 6)))
        texts.append(t)
    texts.append(" ".join(rng.choice(vocab) for _ in range(9000)))
    rows = [(k, t, "en", rng.choice(["a", "b", "ç", None]) if k % 3 else "hot", 1, 0.5, 7, "x") for k, t in enumerate(texts)]
    return rows + [rows[5], rows[12]] + [(None, "a null id " * 30, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_docs(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# -- 1 --------------------------------------------------------------------------------------------------------------------


def kneser_ney(rows, trains):
    """log10 probabilities by dictionaries."""
    tokens = [WORD.findall(lower(t)) + ["</s>"] for _, t in rows]
    tri, count = collections.Counter(), collections.Counter()
    for (i, _), tok in zip(rows, tokens, strict=True):
        if trains(i):
            s = ["<s>", "<s>", *tok]
            count.update(tok)
            tri.update(zip(s, s[1:], s[2:], strict=False))
    left = collections.Counter((v, w) for _, v, w in tri)
    uni = collections.Counter(w for _, w in left)

    def off(counts):
        n = collections.Counter(counts)
        if not (n[1] and n[2] and n[3]):
            return [0.0, 0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        return [0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate((1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]), 1))]

    d1, d2, d3 = off(uni.values()), off(left.values()), off(tri.values())

    def sums(counts, d, key):
        total, rest = collections.Counter(), collections.Counter()
        for g, n in counts.items():
            total[key(g)] += n
            rest[key(g)] += d[min(n, 3)]
        return total, rest

    t3, r3 = sums(tri, d3, lambda g: g[:2])
    t2, r2 = sums(left, d2, lambda g: g[0])
    t1 = sum(uni.values())
    r1 = sum(d1[min(n, 3)] for n in uni.values()) / t1 if t1 else 1.0
    out = []
    for tok in tokens:
        s, total = ["<s>", "<s>", *tok], 0.0
        for u, v, w in zip(s, s[1:], s[2:], strict=False):
            p = max(uni[w] - d1[min(uni[w], 3)], 0) / max(t1, 1) + r1 / (len(count) + 1)
            if t2[v]:
                n = left[v, w]
                p = max(n - d2[min(n, 3)], 0) / t2[v] + r2[v] / t2[v] * p
            if t3[u, v]:
                n = tri[u, v, w]
                p = max(n - d3[min(n, 3)], 0) / t3[u, v] + r3[u, v] / t3[u, v] * p
            total += math.log10(p)
        out.append(total)
    return tokens, count, out


@pytest.mark.parametrize("bucket", [2_000_000, 300, 100])
def test_lm(docs, none, monkeypatch, bucket):
    monkeypatch.setattr(lm, "BUCKET", bucket)
    monkeypatch.setattr(lm, "FLUSH", 2000)
    monkeypatch.setattr(lm, "TOGETHER", 4000)
    model = lm.train(docs.where(~lm.held_out(F.col("doc_id"))))
    if bucket <= 300:
        assert model["buckets"] > 1 and model["hot"] > 0 and model["many_texts"] == (bucket == 100)
    got = sorted((tuple(r) for r in lm.score(docs, model).collect()), key=lambda r: (r[0] is None, r))
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    tokens, count, want = kneser_ney(rows, lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1)
    assert model["tokens"] == sum(count.values()) and model["words"] == len(count)
    base = [sum(math.log10((count[w] + 0.5) / (model["tokens"] + 0.5 * (len(count) + 1))) for w in t) for t in tokens]
    for g, (i, _), t, b, s in zip(got, rows, tokens, base, want, strict=True):
        assert g[0] == i and g[1] == len(t) and g[2] == sum(count[w] > 0 for w in t)
        assert math.isclose(g[3], b, rel_tol=1e-9) and math.isclose(g[4], s, rel_tol=1e-9)
    empty = lm.train(none)
    assert lm.score(none, empty).count() == 0 and abs(lm.score(docs, empty).where("doc_id = 0").first().score) < 1e-9


def test_lm_of_one_document(spark):
    """The beginning of texts is a context that one training text has seen once."""
    rows = [(0, "a b c a b d a b c"), (1, "d q"), (2, "b a"), (3, ""), (4, None), (5, "a b c a b d a b c")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.train(texts.where("doc_id = 0"))
    got = {r.doc_id: r.score for r in lm.score(texts, model).collect()}
    _, _, want = kneser_ney(rows, lambda i: i == 0)
    assert all(math.isclose(got[i], x, rel_tol=1e-9) for (i, _), x in zip(rows, want, strict=True))


def test_op1_query(spark, sf_dir):
    """The query's columns against plain counts and the model by dictionaries."""
    got = {r.doc_id: r for r in lm.op1_lm_scoring(spark, sf_dir).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    trains = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    tokens, count, want = kneser_ney(rows, trains)
    total = sum(count.values())
    assert len(got) == len(rows)
    for (i, _), tok, x in zip(rows, tokens, want, strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not trains(i), len(tok), sum(count[w] > 0 for w in tok), total)
        assert math.isclose(r.score, x, rel_tol=1e-9)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in tok), rel_tol=1e-9)


# -- 2 --------------------------------------------------------------------------------------------------------------------


def line_copies(rows, low=2, long=30):
    """Later copies by looking at all windows of `low` lines and all long lines."""
    seen_one, seen_run, out = set(), set(), {}
    for i, t in sorted({(1 << 63 if r is None else r, t) for r, t in rows if t is not None}):
        own = [(k, x) for k, x in enumerate(t.split("\n")) if WORD.search(x)]
        gone = set()
        for p, (_, x) in enumerate(own):
            if x in seen_one and len(WORD.findall(x)) >= long:
                gone.add(p)
            run = tuple(y for _, y in own[p : p + low])
            if len(run) == low and run in seen_run:
                gone |= set(range(p, p + low))
            seen_one.add(x)
            if len(run) == low:
                seen_run.add(run)
        cut = {own[p][0] for p in gone} | {k for p in gone if p + 1 in gone for k in range(own[p][0], own[p + 1][0])}
        out[i, t] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut), len(own), len(gone)
    return out


@pytest.mark.parametrize("low", [1, 2, 4])
def test_lines(spark, docs, none, low):
    more = [(1000 + k, "\n".join(x), "en", "a", 1, 0.0, 0, "") for k, x in enumerate([list("ab cd ef gh".split()), ["zz", "", "cd", "", "ef", "gh"], ["ab", "cd", "ab", "cd", "ab"], ["ef", "gh", "ef", "gh"]])]
    own = docs.unionByName(spark.createDataFrame(more, DOCS))
    got = lines.dedup(own, min_lines=low).collect()
    want = line_copies([(r.doc_id, r.text) for r in own.collect()], low)
    for r in got:
        if r.doc.text is None:
            assert r.kept is None and r.n_lines == 0
        else:
            assert (r.kept, r.n_lines, r.n_removed) == want[1 << 63 if r.doc.doc_id is None else r.doc.doc_id, r.doc.text], r
    assert len(got) == own.count() and lines.dedup(none).count() == 0
    assert lines.without_copies(own).columns == own.columns


def test_every_repeated_line(spark, none, tmp_path):
    """A short line alone between differing neighbours is a run too, in op2 and in the pipeline's stage 2."""
    import corpus_pipeline as cp

    texts = ["one\nshared by all\ntwo", "three\nshared by all\nfour", "shared by all\nfive\nshared by all", "shared by all"]
    own = spark.createDataFrame([(k, x, "en", "a", 1, 0.0, 0, "") for k, x in enumerate(texts)], DOCS)
    own.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in lines.op2_line_dedup(spark, str(tmp_path)).collect()}
    want = {k: v for (k, _), v in line_copies(list(enumerate(texts)), 1).items()}
    assert {k: (r.n_lines, r.n_removed, r.kept_md5) for k, r in got.items()} == {k: (n, m, hashlib.md5(t.encode()).hexdigest()) for k, (t, n, m) in want.items()}
    assert [got[k].n_removed for k in range(4)] == [0, 1, 2, 1]
    assert {r.doc_id: r.text for r in cp.without_repeated_lines(spark, own, str(tmp_path)).collect()} == {0: texts[0], 1: "three\nfour", 2: "five"}


# -- 3 --------------------------------------------------------------------------------------------------------------------


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for r in got:
        assert r.size == len(WORD.findall(r.doc.text or "")) and 0 <= r.taken <= 3 * r.size
        sizes[r.doc.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        target = {s: 3.0 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    taken = collections.Counter()
    for r in got:
        taken[r.doc.source] += r.taken
        assert r.source_size == sizes[r.doc.source] and math.isclose(r.target, target[r.doc.source])
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in order)
    places = [o.position for r in got for o in r.occurrences]
    assert all(0 <= p <= 1 for p in places)
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns and sum(len(WORD.findall(r.text)) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix(none).count() == mixing.mixture(none).count() == 0


def test_mixing_whole(spark, docs, sf_dir):
    """No text of the pipeline's mixture is a fragment; each source's last document is in or out, whichever is nearer."""
    import corpus_pipeline as cp

    texts = collections.Counter(r.text for r in docs.collect())
    mixed = collections.Counter(r.text for r in cp.mixed_sources(spark, docs, sf_dir).collect())
    assert mixed and set(mixed) <= set(texts)
    got = mixing.mix(docs, whole=True).collect()
    want = collections.Counter()
    by_source = collections.defaultdict(list)
    for r in got:
        assert all(o.words == r.size and 0 <= o.position <= 1 for o in r.occurrences)
        want[r.doc.text] += len(r.occurrences)
        by_source[r.doc.source].append(r)
    assert mixed == +want
    for own in by_source.values():
        goal, most = math.floor(own[0].target + 0.5), max(r.size for r in own)
        assert abs(sum(r.taken for r in own) - goal) <= most / 2


def test_schedule_inverts(spark):
    knots = ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0))
    xs = [k / 100 for k in range(101)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(mixing._time(F.col("x"), knots)).collect()]
    t = np.linspace(0, 1, 200001)
    area = np.concatenate([[0], np.cumsum((np.interp(t[1:], *zip(*knots, strict=True)) + np.interp(t[:-1], *zip(*knots, strict=True))) / 2 * np.diff(t))])
    assert np.allclose(np.interp(got, t, area / area[-1]), xs, atol=1e-6)


# -- 4 --------------------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(docs, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    model = pieces.load()
    got = pieces.encode(docs).collect()
    want = collections.Counter((r.doc_id, tuple(library.encode(r.text or ""))) for r in docs.collect())
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    by = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(pieces.decode(r.ids, model) == by[r.doc_id] for r in got)
    assert pieces.encode(none).count() == 0


def test_units_and_merges():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    model, rng = pieces.load(), random.Random(5)
    for _ in range(500):
        t = "".join(rng.choice("ab the in ing  ²3.,(\n\té中😀’s=") for _ in range(rng.randint(1, 80)))
        own = pieces.units(t, re.compile(model.pattern))
        assert "".join(own) == "▁" + t.replace(" ", "▁")
        assert [i for u in own for i in pieces.ids_of(pieces.merge(u, model), model)] == library.encode(t), t


def test_units_of_any_length(spark):
    """The fold gives what merging each pair in turn gives, within windows, across them and beyond the bits of a number."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(9)
    several = [p for p in pieces.load().score if 2 < len(p) < 12 and p.isalpha()]
    texts = ["".join(rng.choice(several) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    texts += ["".join(rng.choice("aeinst") for _ in range(n)) for n in (47, 48, 49, 59, 60, 61, 62, 63, 64, 65, 200, 3000)]
    texts += ["=" * 500, "a" * 61, " " * 70 + "x" + " " * 3, "▁▁ ▁x", "-" * 59 + "=" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in pieces.encode(docs).collect()}
    assert got == {i: library.encode(t) for i, t in enumerate(texts)}


def test_one_hash_for_two_units(docs, monkeypatch):
    """Texts whose units are mistaken for others are found by decoding and encoded where they stand."""
    want = {(r.doc_id, r.text or ""): r.ids for r in docs.join(pieces.encode(docs), "doc_id").select("doc_id", "text", "ids").collect()}
    model = pieces.load()
    store = pieces.fit(docs.select("text"), model)
    store["files"] = set()  # nothing is found: all are taken for units without pieces, which decodes well
    batch = docs.select("doc_id", "text").where("doc_id IS NOT NULL").toArrow().to_batches()
    plain = [r for b in pieces._encoder(model, store, False)(batch) for r in b.to_pylist()]
    assert len(plain) and all(pieces.decode(r["ids"], model) == next(t for i, t in want if i == r["doc_id"]) for r in plain)
    store = pieces.fit(docs.select("text"), model)
    monkeypatch.setattr(pieces, "_ids_of_units", lambda own, m, s: (np.full(len(own), 5, dtype=np.uint32), np.arange(len(own)), np.ones(len(own), dtype=np.int64)))
    wrong = [r for b in pieces._encoder(model, store, False)(batch) for r in b.to_pylist()]
    assert all(any(r["ids"] == x for (i, _), x in want.items() if i == r["doc_id"]) for r in wrong)


def test_op4_query(spark, sf_dir):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r.doc_id: r for r in pieces.op4_sentencepiece(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "")
        x = got[r.doc_id]
        assert (x.n_ids, x.ids_sha256, x.round_trip) == (len(ids), hashlib.sha256(np.array(ids, dtype="<i4").tobytes()).hexdigest(), True)


def test_viterbi(spark):
    rng = random.Random(2)
    score = {p: -rng.randint(1, 9) + rng.random() for p in ["a", "b", "ab", "ba", "aba", "bb", "abb", "c", "bc", "cab"]}
    own = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)]

    def best(u):
        table = [(0.0, [])]
        for e in range(1, len(u) + 1):
            options = [(table[s][0] + score[u[s:e]], table[s][1] + [(s, e)]) for s in range(max(0, e - 3), e) if u[s:e] in score]
            table.append(max([*options, (table[e - 1][0] - 20.0, table[e - 1][1])]))
        return table[-1][1]

    distinct = spark.createDataFrame([(u,) for u in set(own)], "unit string")
    known = spark.createDataFrame([(p, s, k) for k, (p, s) in enumerate(score.items())], "piece string, score double, id int")
    got = {r.unit: [(x.s, x.e) for x in r.spans] for r in pieces.best_spans(distinct, known, 3, -20.0).collect()}
    assert got == {u: best(u) for u in set(own) if set(u) & set("abc")}


# -- 5 --------------------------------------------------------------------------------------------------------------------


def clouds(seed=4):
    rng = np.random.default_rng(seed)
    centres, rows = rng.normal(size=(6, 8)), []
    for k in range(260):
        v = centres[rng.integers(6)] + rng.normal(size=8) * rng.choice([0.02, 0.2, 1.0])
        rows.append([k, int(rng.integers(3)), v.tolist()])
    rows += [[k, 0, (np.array(rows[3][2]) * s).tolist()] for k, s in ((300, 2.0), (301, 0.5), (302, 1.0))]
    rows += [[400, None, rows[0][2]], [401, 0, None], [402, 0, [0.0] * 8], [403, 0, [float("nan")] * 8], [404, 0, [None] + [1.0] * 7], [405, 0, [float("inf")] + [0.0] * 7], [406, 1, []], [407, 1, [1.0, 2.0]], rows[7]]
    return rows


@pytest.mark.parametrize("small", [2048, 10])
def test_embeddings(spark, monkeypatch, small):
    monkeypatch.setattr(embeddings, "SMALL", small)
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    rows = clouds()
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    ok = [r for r in rows if r[1] is not None and r[2] and None not in r[2] and np.isfinite(r[2]).all() and any(r[2])]
    cos = lambda a, b: len(a) == len(b) and np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98
    links = collections.Counter()
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[1] == b[1] and (a[2] == b[2] or cos(a[2], b[2])):
                links[a[0]] += 1
                links[b[0]] += 1
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    twice = rows[-1][0]
    want = collections.Counter((r[0], links[r[0]] // (2 if r[0] == twice else 1), find(r[0]), find(r[0]) == r[0]) for r in rows)
    assert collections.Counter(tuple(r) for r in got) == want
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<double>")).count() == 0


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(500, 560)] + [(None, 1), (7, 7)]
    root = list(range(600))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a is not None and a != b for x in (a, b)}


# -- 6 --------------------------------------------------------------------------------------------------------------------


def test_media(docs, none):
    by = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = media.media_features(media.store_media(docs)).collect()
    assert len(got) == docs.count() and media.media_features(media.store_media(none)).count() == 0
    features = collections.defaultdict(set)
    for r in got:
        raw = by[r.doc_id]
        full = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        features[raw].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(f) == 1 for f in features.values())


def plain_decode(data):
    """Coefficients of a baseline JPEG, bit by bit."""
    p = jpeg.Picture(data)
    codes = {}
    for table in {t for _, dc, ac in p.blocks for t in (dc, ac)}:
        code, k = 0, 16
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                codes[table, format(code, f"0{n}b")] = table[k]
                code, k = code + 1, k + 1
            code <<= 1
    out = []
    for part in re.split(rb"\xff[\xd0-\xd7]", data[p.scan : -2]):
        bits = "".join(f"{b:08b}" for b in part.replace(b"\xff\x00", b"\xff"))
        at, pred = 0, [0] * len(p.parts)

        def symbol(table):
            nonlocal at
            n = 1
            while (table, bits[at : at + n]) not in codes:
                n += 1
            at += n
            return codes[table, bits[at - n : at]]

        def number(n):
            nonlocal at
            at += n
            v = int(bits[at - n : at] or "0", 2)
            return v - (1 << n) + 1 if n and v < 1 << (n - 1) else v

        for _ in range(min(p.every, p.mcus - len(out))):
            mcu = []
            for c, dc, ac in p.blocks:
                block, k = [0] * 64, 1
                pred[c] += number(symbol(dc))
                block[0] = pred[c]
                while k < 64:
                    s = symbol(ac)
                    if s == 0:
                        break
                    k += s >> 4
                    if s & 15:
                        block[k] = number(s & 15)
                    k += 1
                mcu.append(block)
            out.append(mcu)
    return np.array(out)


def test_jpeg_reader():
    rng = np.random.default_rng(0)
    raw = [rng.integers(0, 256, 192 * n, dtype=np.uint8).tobytes() for n in (1, 7, 30)]
    for data, (_, got) in zip(files := jpeg.encode(raw, [1, 2, 3]), jpeg.read(files), strict=True):
        assert (plain_decode(data) == got).all()


def test_jpeg_with_runs_and_without_restarts():
    """A grey picture with zero runs, ends of blocks and one interval, written by hand."""
    table = bytes([0, 2, 2, 2] + [0] * 12) + bytes([0, 1, 2, 0x21, 0xF0, 3])
    code = {}
    value, k = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            code[table[k]] = format(value, f"0{n}b")
            value, k = value + 1, k + 1
        value <<= 1
    bits = code[3] + "101" + code[0x21] + "1" + code[0xF0] + code[1] + "0" + code[0]  # 5; two zeros, 1; sixteen zeros, -1; end
    bits += code[2] + "00" + code[0]  # 5 - 3
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = jpeg._segment
    data = b"\xff\xd8" + seg(0xDB, b"\0" + b"\x08" * 64) + seg(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0])) + seg(0xC4, b"\0" + table + b"\x10" + table) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    (picture, got), = jpeg.read([data])
    assert got[0, 0, 0] == 5 and got[0, 0, 3] == 1 and got[0, 0, 20] == -1 and got[1, 0, 0] == 2 and (got == plain_decode(data)).all()
    assert jpeg.thumbnail(picture, got).tolist() == [[133, 130]]


# -- 7 --------------------------------------------------------------------------------------------------------------------


def test_field_by_enumeration():
    rng = np.random.default_rng(3)
    counts = np.array([3, 1, 5, 2])
    emit, trans = rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    p, pairs, _ = quality.marginals(emit, counts, trans)
    at, want_pairs = 0, np.zeros((2, 2))
    for n in counts:
        mass, good, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(1 << n):
            y = [code >> k & 1 for k in range(n)]
            w = math.exp(sum(emit[at + k] * y[k] for k in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
            mass += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                both[a, b] += w
        assert np.allclose(p[at : at + n], good / mass)
        want_pairs += both / mass
        at += n
    assert np.allclose(pairs, want_pairs)


def test_quality(spark, docs, none, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(table, labels)
    got = quality.score(table, model).select("doc.doc_id", "score").join(labels, "doc_id").toPandas()
    assert ((got.score >= quality.THRESHOLD).astype(int) == got.quality).mean() > 0.95
    again = quality.score(docs, model).collect()
    assert len(again) == docs.count() and all(0 <= r.score <= 1 for r in again)
    same = collections.defaultdict(set)
    for r in again:
        same[r.doc.text or ""].add(round(r.score, 9))
    assert all(len(s) == 1 for s in same.values())
    blank = quality.fit(table, labels.limit(0))
    assert quality.score(docs, blank).where("abs(score - 0.5) > 1e-9").count() == 0 and quality.score(none, model).count() == 0


def test_features_by_part():
    """Parts of a long text give what the whole gives."""
    import pyarrow as pa

    rng = random.Random(6)
    texts = pa.array(["\n".join(" ".join(rng.choice(["ab", "Xy.", "7", "--", "é"]) for _ in range(rng.randint(0, 6))) for _ in range(n)) for n in (1, 40, 3, 100)])
    own = quality.lines_of_texts(texts)
    whole = quality.line_features(*own)
    for part in (1, 7, 1000):
        got = np.concatenate([x for _, _, x in quality.features_by_part(*own, part)])
        assert np.allclose(got, whole)


def test_quality_score_is_the_weighted_mean():
    """The score of a text against its lines' marginals by enumeration."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    w, trans = rng.normal(size=quality.FEATURES) * 0.3, rng.normal(size=(2, 2))
    text = "A first line.\n\n-- -- 77\nlast words here"
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    (got,) = quality._scorer(w, trans)([batch])
    data, lines_of, starts, ends = quality.lines_of_texts(pa.array([text]))
    emit = quality.line_features(data, lines_of, starts, ends) @ w
    mass, good = 0.0, np.zeros(4)
    for code in range(16):
        y = np.array([code >> k & 1 for k in range(4)])
        p = math.exp(float(emit @ y) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
        mass, good = mass + p, good + p * y
    size = np.array([len(x.encode()) + 1 for x in text.split("\n")])
    assert math.isclose(got.column("score")[0].as_py(), float((good / mass) @ size / size.sum()), rel_tol=1e-9)


# -- 8 --------------------------------------------------------------------------------------------------------------------


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        out[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, 64), (2, 0), (3, 1)])
def test_jaccard(spark, none, monkeypatch, seed, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rng = random.Random(seed)
    rows = [(r[0], r[1]) for r in make_docs(seed, 60)]
    base = [f"w{k}" for k in range(60)]
    for k in range(60):  # around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 3)}"
        rows.append((200 + k, " ".join(w[rng.randint(0, 3) :])))
    own = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.groups(own).collect()
    sets = shingle_sets([r for r in rows if r[0] is not None])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id)), r
    if seed == 1:
        assert jaccard.groups(none).count() == 0


def test_jaccard_of_one_doc_id_with_several_texts(spark):
    """Rows that share a doc_id are documents of their own: each has its class, and no link is lost."""
    text = lambda c, k: " ".join(f"{c}{i}" for i in range(60)) + f" end{k}"
    rows = [(1, text("w", 1)), (1, text("v", 1)), (5, text("w", 2)), (6, text("v", 2)), (1, ""), (7, None), (7, text("w", 1))]
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 0, 1), (1, 57, 1), (1, 57, 1), (5, 57, 1), (6, 57, 1), (7, 0, 7), (7, 57, 1)]


def test_common_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60 + 40 * k, rng.integers(0, 90))).astype(np.uint64) for k in range(40)]
    for chunk, most in ((4096, 1 << 20), (7, 50)):
        got = jaccard.common(sets[:25], sets[10:], chunk, most)
        assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[10:]] for x in sets[:25]]
    assert jaccard.common([], sets).shape == (0, 40) and jaccard.common(sets[:1], [sets[0][:0]]).tolist() == [[0]]


def test_jaccard_units():
    """The most shingles by which two similar sets of given sizes can differ are fewer than the larger's band asks units of the other."""
    for n in range(1, 80):
        for m in range(n, 100):
            same = -(-80 * (n + m) // 180)
            if same <= n:
                band = jaccard.band_of(m)
                assert band - jaccard.band_of(n) in (0, 1)
                assert n + m - 2 * same < jaccard.units(n, band) <= jaccard.difference(band) + 1
                assert band > jaccard.band_of(n) or n + m - 2 * same < jaccard.units(m, band)


def test_jaccard_keeps_sets_apart_that_share_empty_segments_only(spark, monkeypatch):
    """Near copies in plenty need hot subsets; the groups that are compared must not take in sets that share nothing with them."""
    monkeypatch.setattr(jaccard, "HOT", 4)
    seen, real = {}, jaccard.settled

    def keep(df, name):
        out = real(df, name)
        seen[name] = out.collect() if name in ("stars", "groups") else None
        return out

    monkeypatch.setattr(jaccard, "settled", keep)
    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 1 << 63, 200).astype(np.uint64) for _ in range(150)]  # the last 110 have nothing in common
    for k in range(40):
        sets[k] = np.concatenate([sets[0][:190] if k < 20 else sets[0][rng.permutation(200)[: 200 - k // 2]], sets[k][: 10 + k // 4]])
    sets = [np.unique(x) for x in sets]
    classes = spark.createDataFrame([(k, len(x), x.tobytes()) for k, x in enumerate(sets)], "rep long, n long, shingles binary")
    parts = {r.node: r.component for r in jaccard.components(jaccard.similar_pairs(classes)).collect()}
    links = [(a, b) for a in range(40) for b in range(a) if 100 * len(x := np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - len(x))]
    least = list(range(len(sets)))
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert len(links) > 200 and [parts.get(k, k) for k in range(len(sets))] == least
    assert {r.rep for r in seen["groups"]} <= set(range(40))
    met = [r.rep for r in seen["stars"]]
    assert max(met.count(k) for k in set(met)) <= 2


def exploded(spark, action):
    """What action() gives, and the rows that Spark made of subsets' arrays meanwhile, over all plans."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    runs = lambda: [store.executionsList().apply(k).executionId() for k in range(store.executionsList().size())]
    bus.waitUntilEmpty()
    before = max(runs(), default=-1)
    out = action()
    bus.waitUntilEmpty()
    made = {}
    for run in (k for k in runs() if k > before):
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if "posexplode(sigs" in node.desc() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    made[run, node.id()] = int(values.get(m.accumulatorId()).get().replace(",", ""))
    return out, sum(made.values())


def test_jaccard_second_units_unfold_only_what_is_asked(spark, monkeypatch):
    """A few sets that take second units don't make Spark unfold all sets' subsets once more."""
    rng = np.random.default_rng(8)
    sets = [rng.integers(0, 1 << 63, 200).astype(np.uint64) for _ in range(60)]
    for k in range(12):
        sets[k] = np.unique(np.concatenate([sets[0][: 200 - k], sets[k][:k]]))
    classes = spark.createDataFrame([(k, len(x), np.unique(x).tobytes()) for k, x in enumerate(sets)], "rep long, n long, shingles binary")
    asking, real, got = [], jaccard.settled, {}

    def keep(df, name):
        out = real(df, name)
        if name == "twice":
            asking.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "settled", keep)
    for hot in (64, 4):
        monkeypatch.setattr(jaccard, "HOT", hot)
        got[hot] = exploded(spark, lambda: sorted(map(tuple, jaccard.components(jaccard.similar_pairs(classes)).collect())))
    assert asking[0] == 0 < asking[1] < 60
    assert got[4][0] == got[64][0] == [(k, 0) for k in range(12)]
    assert got[4][1] == got[64][1] > 0


def test_jaccard_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Many near copies, few of them linked: blocks find what pairs would."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 40)}"
        rows.append((k * 7 % 150, " ".join(w)))
    got = {r.doc_id: r.component_id for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    sets, root = shingle_sets(rows), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in root}


# -- 9 --------------------------------------------------------------------------------------------------------------------


def test_repeats(docs, none, monkeypatch):
    monkeypatch.setattr(repeats, "TOGETHER", 4000)
    monkeypatch.setattr(repeats, "SLICE", 1500)
    monkeypatch.setattr(repeats, "FLUSH", 30)
    got = collections.Counter(tuple(r) for r in repeats.removed(docs).collect())
    seen, want, done = set(), collections.Counter(), {}
    for i, t in sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        if (i, b) not in done:
            gone = np.zeros(len(b), dtype=bool)
            for p in range(len(b) - 99):
                if b[p : p + 100] in seen:
                    gone[p : p + 100] = True
                seen.add(b[p : p + 100])
            edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
            done[i, b] = int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()).hexdigest()
        n, spans, sha = done[i, b]
        want[i, len(b), n, spans, sha] += 1
    assert got == want and sum(x[2] for x in want) > 0
    assert repeats.removed(none).count() == 0


# -- 10 -------------------------------------------------------------------------------------------------------------------


def test_url_filters(spark):
    from datetime import date

    day = lambda n: date(2024, 1, n)
    log = [("host", "a.x.org", "spam", "add", day(5)), ("host", "a.x.org", "spam", "remove", day(9)), ("domain", "x.org", "adult", "add", day(7)), ("domain", "x.org", "adult", "add", day(7)), ("path", "b.org/p", None, "add", day(1)), ("host", "c.org", "spam", "add", day(3)), ("host", "c.org", "spam", "remove", day(3)), (None, "x", "s", "add", day(1)), ("host", "d.org", "s", "add", None)]
    captures = [(1, "http://A.x.org:80/q", day(4)), (2, "http://a.x.org/q", day(5)), (3, "http://a.x.org/q", day(8)), (4, "http://a.x.org/q", day(9)), (5, "https://u@b.org/P/z?x", day(2)), (6, "https://b.org/pp", day(2)), (7, "http://c.org", day(4)), (8, None, day(4)), (9, "nonsense", day(4)), (10, "http://x.org./", None), (2, "http://a.x.org/q", day(5))]
    entries = spark.createDataFrame(log, "kind string, value string, category string, action string, day date")
    asked = spark.createDataFrame([(*c, "mine") for c in captures], "capture_id long, url string, day date, kind string")
    got = sorted((r.capture.capture_id, r.active, r.categories, r.blocked) for r in urlfilter.judge(asked, entries).collect())
    assert got == [(1, 0, [], False), (2, 1, ["spam"], True), (2, 1, ["spam"], True), (3, 2, ["adult", "spam"], True), (4, 1, ["adult"], True), (5, 1, [""], True), (6, 0, [], False), (7, 0, [], False), (8, 0, [], False), (9, 0, [], False), (10, 0, [], False)]
    assert urlfilter.judge(asked, entries.limit(0)).where("blocked").count() == 0 and urlfilter.judge(asked.limit(0), entries).count() == 0


def test_url_filters_of_reused_ids_and_clashing_names(spark):
    """Captures are judged by URL and day, however they are numbered; a caller's host, active, categories and blocked stay its own."""
    from datetime import date

    day = date(2024, 1, 3)
    entries = spark.createDataFrame([("host", "bad.org", "spam", "add", date(2024, 1, 1)), ("path", "deep.org/" + "/".join("p" * 120), "spam", "add", date(2024, 1, 1))], "kind string, value string, category string, action string, day date")
    rows = [(1, "http://bad.org/", day, "x", 5, "c", None), (1, "http://good.org/", day, "x", 5, "c", None), (None, "http://bad.org/", day, "x", 5, "c", None), (None, "http://good.org/", day, "x", 5, "c", None), (None, None, None, None, None, None, None), (7, "http://deep.org/" + "/".join("p" * 130), day, "x", 5, "c", None)]
    asked = spark.createDataFrame(rows, "capture_id long, url string, day date, host string, active int, categories string, blocked boolean")
    got = urlfilter.judge(asked, entries).collect()
    assert sorted((str(r.capture.capture_id), str(r.capture.url)[:15], r.blocked, r.active, r.host) for r in got) == [("1", "http://bad.org/", True, 1, "bad.org"), ("1", "http://good.org", False, 0, "good.org"), ("7", "http://deep.org", True, 1, "deep.org"), ("None", "None", False, 0, None), ("None", "http://bad.org/", True, 1, "bad.org"), ("None", "http://good.org", False, 0, "good.org")]
    assert {(r.capture.host, r.capture.active, r.capture.categories) for r in got if r.capture.url} == {("x", 5, "c")}


# -- queries and pipeline -------------------------------------------------------------------------------------------------


def test_sql_twins(spark, sf_dir):
    import duckdb
    from conftest import rows_of

    from textloom.llm import queries

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        assert rows_of(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows_of(c.execute(sql).df()), name


def test_pipeline(spark, docs, sf_dir):
    import corpus_pipeline as cp

    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    assert [k for k, _ in cp.STAGES] and len(cp.STAGES) == 5
    one = cp.without_repeated_lines(spark, own, sf_dir)
    two = cp.one_of_each_group(spark, own, sf_dir)
    assert one.columns == two.columns == own.columns
    sets = shingle_sets([(r.doc_id, r.text) for r in own.collect() if r.doc_id is not None])
    kept = [r.doc_id for r in two.collect()]
    assert len([k for k in kept if k is not None]) == len({k for k in kept if k is not None})
    full = [k for k in kept if k is not None and sets[k]]
    assert all(100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b]) for a in full for b in full if a < b)
    three = cp.mixed_sources(spark, own, sf_dir)
    assert three.columns == own.columns
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = cp.good_documents(spark, table, sf_dir)
    assert good.columns == table.columns and good.join(labels.where("quality = 1"), "doc_id").count() > 0
    out = cp.run(spark, sf_dir)
    model = pieces.load()
    rows = out.collect()
    assert rows and [r.position for r in rows] == sorted(r.position for r in rows)
    # the last stage again by hand: the same documents, texts and order as the fourth's files hold
    docs = table
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        before, docs = docs, settled(stage(spark, docs, sf_dir), f"again-{k}")
        assert docs.columns == table.columns
    import glob

    import pyarrow.parquet as pq

    files = sorted(glob.glob(docs.settled_at.removeprefix("file://") + "/part-*"))
    want = [(i, t) for f in files for i, t in zip(*pq.read_table(f, columns=["doc_id", "text"]).to_pydict().values(), strict=True)]
    assert [(r.doc_id, pieces.decode(r.ids, model)) for r in rows] == want
    # each source's words near its target, in the order of the schedules
    plan = mixing.mix(before, whole=True).collect()
    taken = collections.Counter()
    for i, _ in want:
        taken[i] += 1
    assert taken == collections.Counter({r.doc.doc_id: len(r.occurrences) for r in plan if r.occurrences})
    position = sorted((o.position, r.doc.doc_id, o.copy) for r in plan for o in r.occurrences)
    assert [i for _, i, _ in position] == [i for i, _ in want]
