"""The registered queries of the operators, columns and all, against brute force over the whole tables of a small scale."""

import hashlib
import os
import zlib

import numpy as np
import pytest
from test_llm import shingle_sets

from textloom.llm import queries


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())


def run(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir)


def test_op5(spark, sf_dir):
    """Also by SQL; here by numpy."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    got = run(spark, sf_dir, "op5_embedding_dedup")
    assert [(n, t) for n, t in got.dtypes[:4]] == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    x = np.array([r.embedding for r in table], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([-1 if r.label is None else r.label for r in table])
    near = (x @ x.T >= 0.98) & (label[:, None] == label) & (label >= 0) & ~np.eye(len(x), dtype=bool)
    ids = np.array([r.vec_id for r in table])
    least = ids.copy()
    while True:
        new = np.minimum(least, np.where(near, least[None, :], least.max()).min(axis=1))
        if (new == least).all():
            break
        least = new
    assert {tuple(r) for r in got.collect()} == {(int(i), int(n), int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(axis=1), least, strict=True)}


def test_op6(spark, sf_dir, rows):
    got = {r.doc_id: r for r in run(spark, sf_dir, "op6_media_columns").collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        raw = (t or "").encode()
        full = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64 and r.feature


def test_op7(spark, sf_dir):
    """Accuracy on rows whose labels were held out."""
    larger = sf_dir.replace("sf0.001", "sf0.01")
    larger = larger if os.path.exists(larger) else sf_dir
    got = run(spark, larger, "op7_quality_classifier")
    assert dict(got.dtypes) | {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"} == dict(got.dtypes)
    table = {r.doc_id: r for r in got.collect()}
    assert len(table) == spark.read.parquet(f"{larger}/documents.parquet").count()
    for i, r in table.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    held = [i for i, q in labels.items() if q is not None and i in table and table[i].held_out]
    assert len(held) > 10 and np.mean([table[i].predicted == labels[i] for i in held]) >= 0.95
    same = {}
    texts = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "text").collect()
    assert all(abs(same.setdefault(r.text, table[r.doc_id].score) - table[r.doc_id].score) < 1e-9 for r in texts)


def test_op8(spark, sf_dir, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, sf_dir, "op8_ngram_jaccard_join").collect()}
    sets = shingle_sets(rows)
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert links
    while True:
        new = dict(least)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == least:
            break
        least = new
    assert got == {i: (len(sets[i]), least[i]) for i in sets}


def test_op9(spark, sf_dir, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, sf_dir, "op9_suffix_array_dedup").collect()}
    seen, want = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 99):
            h = hashlib.blake2b(b[p : p + 100], digest_size=12).digest()
            if h in seen:
                gone[p : p + 100] = True
            seen.add(h)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        want[i] = len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()).hexdigest()
    assert got == want


def test_names(sf_dir):
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)] and set(queries.SQL) <= set(queries.QUERIES)


def test_mixing_of_null_sources_alone(spark):
    from textloom.llm import mixing

    rows = [(k, "w " * k, None) for k in range(1, 30)] + [(40, None, None), (None, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    total = sum(range(1, 30)) + 2
    assert len(got) == len(rows) and {r.source_size for r in got} == {total} and {r.target for r in got} == {float(total)}
    assert sum(r.taken for r in got) == total and all(r.taken == r.size for r in got)


def test_clashing_columns(spark):
    """Columns of the caller that are named like those inside."""
    from textloom.llm import embeddings, jaccard, mixing, pieces, quality, repeats

    vectors = spark.createDataFrame([(1, 0, [1.0, 0.0], 5, 6, "c"), (2, 0, [1.0, 0.001], 5, 6, "c")], "vec_id long, label int, embedding array<double>, rep int, n int, cell string")
    assert sorted(map(tuple, embeddings.near_duplicates(vectors).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]
    text = " ".join(f"w{k}" for k in range(40))
    names = ["key", "row", "rep", "n", "doc", "score", "size", "bucket", "u", "unit", "chunk", "position", "__position", "first", "component"]
    kinds = ", ".join(f"`{c}` string" for c in names)
    docs = spark.createDataFrame([(k, text, "s", *names) for k in (1, 2)], f"doc_id long, text string, source string, {kinds}")
    assert sorted(r.component_id for r in jaccard.groups(docs).collect()) == [1, 1]
    assert sorted(r.n_removed for r in repeats.removed(docs).collect()) == [0, len(text)]
    assert {len(r.ids) for r in pieces.encode(docs).collect()} == {len(pieces.encode(docs).first().ids)}
    scored = quality.score(docs, (np.zeros(quality.FEATURES), np.zeros((2, 2)))).collect()
    assert {r.doc.doc for r in scored} == {"doc"} and {r.score for r in scored} == {0.5}
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns and {r.position for r in mixed.collect()} == {"position"}


def test_lines_take_powers_of_two(spark):
    from textloom.llm import lines

    with pytest.raises(ValueError):
        lines.copied_ranges(spark.createDataFrame([(1, "a")], "doc_id long, text string"), min_lines=3)


def test_stages_of_the_pipeline_on_odd_tables(spark, sf_dir):
    """Empty tables, nulls, blank texts and repeated rows go through every stage."""
    import corpus_pipeline as cp

    shape = "doc_id long, text string, lang string, source string, n_chars long"
    good = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(5).collect()
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, " \\n ", None, "a", 3), (None, "x y z", "en", None, 5), (3, "one", "en", "b", 3), (3, "one", "de", "c", 3)]
    for rows in ([], odd, [tuple(r) for r in good] + [tuple(r) for r in good]):
        docs = spark.createDataFrame(rows, shape)
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            assert out.count() <= 3 * len(rows), name
        ids = cp.encoded(spark, docs, sf_dir)
        assert ids.columns == ["doc_id", "position", "ids"] and ids.count() == len(rows)
    once = cp.one_of_each_group(spark, spark.createDataFrame(odd, shape), sf_dir).collect()
    # of rows alike in doc_id and text one stays; those without an id all stay
    assert sorted((str(r.doc_id), str(r.text)) for r in once) == [("1", ""), ("2", " \\n "), ("3", "one"), ("None", "None"), ("None", "x y z")]
