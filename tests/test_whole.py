"""Registered queries return the whole job: against brute force on small tables."""

import collections
import re

import pytest
from conftest import DATA

import __spark_entry__ as entry
from textloom.functions import exact
from textloom.functions.distance import damerau_distance
from textloom.operators import index as ix
from textloom.plans import catalog

TEXTS = [
    "teß stß ashore\nadnß froß qeß qeß tho thorough thoroughly",
    "the thonre erand\nteß привет мир thorough thoroughbred",
    "Ofthst\nqeß adnö frø thoroughly thoroughgoing " + " ".join(f"thorou{c}" for c in "abcdefghijkl"),
    "",
]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("small"))
    rows = [(k, t, "en", "a", len(t)) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def frequencies():
    """Documents of each term, by the plain tokenizer."""
    return collections.Counter(w for t in TEXTS for w in {x for part in (t.split("\n")[0], t) for x, _, _ in exact.tokenize(part)})


def test_prefixes_of_every_length(spark, small):
    got = sorted(map(tuple, entry.queries()["prefix_top10"](spark, small).collect()))
    df, want = frequencies(), []
    for p in {t[:n] for t in df for n in range(1, len(t) + 1)}:
        best = sorted((-k, t) for t, k in df.items() if t.startswith(p))[:10]
        want += [(p, t, -k, r + 1) for r, (k, t) in enumerate(best)]
    assert got == sorted(want) and any(len(p) > 3 for p, *_ in got)


def test_near_terms_of_any_script(spark, small):
    terms = frequencies()
    near = {(w, t, n) for w in catalog.TYPOS for t in terms if (n := damerau_distance(w, t)) <= 2}
    got = {tuple(r) for r in entry.queries()["vocab_within_distance"](spark, small).collect()}
    assert got == near and ("hte", "teß", 2) in got
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    best = {}
    for w, t, n in near:
        if n:
            best.setdefault(w, []).append((10 * n - 2 * shared(w, t), n, t))
    want = {(w, min(x)[2], min(x)[1]) for w, x in best.items()}
    assert {tuple(r) for r in entry.queries()["spell_correct"](spark, small).collect()} == want and ("qeu", "qeß", 1) in want


def test_replaced_postings(spark, small):
    """The replaced table is the index of the pages as they are after the batch, posting for posting."""
    rows = [(k, t.split("\n")[0], t.split("\n")[0] if "\n" in t else t) for k, t in enumerate(TEXTS)]
    want = ix.postings(ix.tokens(spark.createDataFrame(rows, "doc_id long, title string, content string")))
    got = entry.queries()["upsert_replace"](spark, small)
    assert set(got.columns) == set(want.columns)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and got.count() > 0
    assert {r.term for r in got.collect()} < set(frequencies())


def plain_walk(raw):
    canon = lambda u: re.match(r"(?i)(https?://[^?#]*)?", u)[0]
    out, known = collections.defaultdict(set), collections.defaultdict(set)
    for r in raw:
        known[canon(r.url)].add(r.html)
        host = re.match(r"https?://[^/?#]*", r.url)[0]
        for x in re.findall(r'(?i)<a [^>]*?href="([^"]*)"', r.html):
            x = canon(x if re.match(r"(?i)https?://", x) else host + x if re.match(r"/(?!/)", x) else "")
            if x:
                out[canon(r.url)].add(x)
    seen, now, depth = {}, {}, 0
    for u in sorted(known, reverse=True):
        now[u.lower()] = u
    while now:
        seen |= dict.fromkeys(now, depth)
        new = sorted({x for u in now.values() for x in out[u] if x.lower() not in seen}, reverse=True)
        now, depth = {x.lower(): x for x in new}, depth + 1
    return seen


def test_frontier_of_all_pages(spark, tmp_path):
    link = lambda *x: "<html><body>" + " ".join(f'<a href="{u}">x</a>' for u in x) + "</body></html>"
    rows = [(k, f"http://h{k}.org/p{k}", link(f"/only{k}", "http://h0.org/p0")) for k in range(20)]
    # one address in two cases is one visit, of the lesser spelling
    rows += [(20, "http://a.org/X?q=1", link("/new")), (21, "http://a.org/x", link("/other"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for d in (str(tmp_path), DATA):
        got = {r.url_key: r.depth for r in entry.queries()["crawl_frontier"](spark, d).collect()}
        assert got == plain_walk(spark.read.parquet(f"{d}/pages.parquet").collect())


def test_distance_of_whole_titles(spark, small):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    got = {r.doc_id: r.distance for r in entry.queries()["text_functions"](spark, small).collect()}
    assert got == {k: plain(exact.fold(t.split("\n")[0]), "the of and") for k, t in enumerate(TEXTS)}
