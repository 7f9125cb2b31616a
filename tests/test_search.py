"""The engines end to end on a small corpus, and the index's upkeep."""

import pytest

from textloom.functions import exact
from textloom.functions.distance import damerau_distance, osa_distance
from textloom.operators import index as ix
from textloom.operators import rank, search, standard
from textloom.operators.evaluate import QUERIES
from textloom.sources import pages as pg

CORPUS = [
    (1, "u1", "Linguagem de programação", "C# é uma linguagem de programação da plataforma .NET com classes"),
    (2, "u2", "Biblioteca de classes", "uma biblioteca de classes oferece tipos para a linguagem e para a programação"),
    (3, "u3", "Sistema operacional", "o sistema operacional controla a máquina virtual e os processos"),
    (4, "u4", "What is dotnet", "dotnet is a platform. The asp.net core tutorial shows how to build cloud infrastructure"),
    (5, "u5", "Tutorial introdutório", "como instalar o dotnet em um sistema operacional passo a passo"),
    (6, "u6", "Generative AI", "generative ai models write code in c# and c++"),
    (7, "u7", "", "máquina de lavar"),
    (8, "u8", "Vazio", ""),
]


@pytest.fixture(scope="module")
def index(spark):
    built = ix.build(spark.createDataFrame(CORPUS, "doc_id long, url string, title string, content string"))
    for name in ("postings", "phrases", "meta", "vocab", "prefixes", "titles"):
        setattr(built, name, getattr(built, name).cache())
    return built


def test_bm25_golden(spark):
    from pyspark.sql import functions as F

    one = lambda *a: spark.range(1).select(rank.bm25(*[F.lit(x) for x in a])).first()[0]
    assert abs(one(1, 1, 2, 2, 2.0) - 0.693147) < 1e-6
    assert one(0, 1, 2, 2, 2.0) == one(1, 1, 2, 0, 2.0) == one(1, 1, 2, 2, 0.0) == one(1, 1, 0, 2, 2.0) == 0


def test_rank_and_phrases(index):
    got = search.search(index, "linguagem de programação")
    assert [r.doc_id for r in got.results][:2] == [1, 2] and got.did_you_mean is None
    assert [r.doc_id for r in search.search(index, "C#").results] == [6, 1] or {r.doc_id for r in search.search(index, "C#").results} == {1, 6}
    assert search.search(index, "o a").results == []
    with pytest.raises(ValueError):
        search.search(index, " ")


def test_correction(index):
    got = search.search(index, "lingagem")
    assert got.did_you_mean == ("lingagem", "linguagem") and got.results[0].doc_id == 1
    assert search.search(index, "lingagem", correct=False).results == []


def test_all_queries_run(index):
    for _, q in QUERIES[:6]:
        assert search.search(index, q, 10).results, q


def test_within_is_exact(spark, index):
    vocab = [r.term for r in index.vocab.collect()]
    words = ["lingagem", "clases", "sitsema", "tutorail", "xx"]
    got = {(r.word, r.term, r.distance) for r in search.within(index.vocab, spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(w, t, d) for w in words for t in vocab if (d := damerau_distance(w, t)) <= 2}


def test_fuzzy_words_follow_prefixes(index):
    tops = {}
    for r in index.prefixes.collect():
        tops.setdefault(r.prefix, []).append(r.term)
    want: dict = {}
    for q, terms in tops.items():
        if q[0] == "p" and (d := osa_distance(q, "porg")) <= 1:
            for t in terms:
                want[t] = min(want.get(t, 9), d)
    assert {r.term: r.distance for r in search.fuzzy_words(index.prefixes, "porg", 1).collect()} == want


def test_autocomplete(index):
    rows = search.autocomplete(index, "prog").orderBy("ord").collect()
    assert rows[0].text == "programacao" and "Linguagem de programação" in [r.text for r in rows]
    with pytest.raises(search.IndexNotReady):
        search.autocomplete(None, "x")


def test_standard_engine(index):
    got = standard.search(index.pages, "sistema operacional", 5)
    assert got.results[0].doc_id == 3
    assert standard.search(index.pages, "sistemo operacional", 5).did_you_mean == ("sistemo operacional", "sistema operacional")
    rows = standard.autocomplete(index.titles.select("title"), "bibl").orderBy("ord").collect()
    assert rows[0].text == "biblioteca"


def test_save_load_and_ensure(spark, index, tmp_path):
    base = f"file://{tmp_path}/ix"
    _, first = ix.ensure(spark, index.pages, base)
    again, second = ix.ensure(spark, index.pages, base)
    assert (first, second) == ("created", "kept")
    assert [r.doc_id for r in search.search(again, "máquina").results] == [r.doc_id for r in search.search(index, "máquina").results]


def test_stream_upserts(spark, index, tmp_path):
    from datetime import datetime

    from textloom.sources.pages import PAGES
    from textloom.streaming import maintain

    put = lambda rows, k: spark.createDataFrame([(*r, datetime(2024, 1, 1), None, None, None) for r in rows], PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    base, args = f"file://{tmp_path}/tables", (f"{tmp_path}/in", f"file://{tmp_path}/tables", f"{tmp_path}/ck")
    put(CORPUS[:4], 0)
    maintain.follow(spark, *args).awaitTermination(120)
    put([(1, "u1", "Outra", "texto novo")], 1)
    maintain.follow(spark, *args).awaitTermination(120)
    now = maintain.snapshot(spark, base)
    assert {r.doc_id for r in now.pages.collect()} == {1, 2, 3, 4}
    assert {r.doc_id for r in now.postings.where("term = 'novo'").collect()} == {1}
    assert {r.doc_id for r in now.postings.where("term = 'linguagem'").collect()} == {2}


def test_crawl(spark):
    raw = spark.createDataFrame([("http://h/a", '<a href="/b">b</a><a href="#x">x</a>'), ("http://h/b", '<a href="/A">a</a><a href="/c?q=1">c</a>'), ("http://h/c", "")], "url string, html string")
    seeds = spark.createDataFrame([("http://h/a",)], "url string")
    visited, _ = pg.crawl(seeds, pg.table_fetcher(raw))
    assert {(r.url, r.depth) for r in visited.collect()} == {("http://h/a", 0), ("http://h/b", 1), ("http://h/c", 2)}
    few, _ = pg.crawl(seeds, pg.table_fetcher(raw), options=pg.CrawlOptions(max_pages=2))
    assert few.count() == 2


def test_exact_fold():
    assert exact.fold("Ação É") == "acao e"


def test_resolve_as_a_column(spark):
    """The column form against the parser's, for links of every kind."""
    import itertools

    from pyspark.sql import functions as F

    from textloom.functions import html as H

    bases = ["http://h/a/b", "https://H.org", "http://h/", "http://h/a/b/?q=1#f", "http://h:8080/x.html"]
    hrefs = ["/x", "/x?y#z", "x.html", "../c?x=1#f", "./d/./e/..", "../../../up", "//other/z", "?q=2", "#top", "", "  /s  ", "javascript:x", "mailto:a@b", "ftp://f/x", "HTTP://K/a/../b", "http://k", "/a/../b/./c", "a/b/../../..", "c:d", "..", "."]
    rows = [(b, h) for b, h in itertools.product(bases, hrefs)]
    got = [r[0] for r in spark.createDataFrame(rows, "base string, href string").select(H.canonical_expr(F.col("base"), F.col("href"))).collect()]
    show = lambda u: "" if not u else u.split("://")[0].lower() + "://" + (u.split("://")[1] if "/" in u.split("://")[1] else u.split("://")[1] + "/")
    assert [(r, show(g)) for r, g in zip(rows, got, strict=True)] == [(r, show(H.resolve(*r))) for r in rows]


def test_crawl_into_the_index(spark, tmp_path):
    from textloom.streaming import maintain

    raw = spark.createDataFrame([("http://h/a", "<title>Um</title><body>linguagem de programação <a href='b.html'>b</a></body>"), ("http://h/b.html", "<title>Dois</title><body>sistema operacional e linguagem</body>")], "url string, html string")
    base = f"file://{tmp_path}/crawled"
    fetch = lambda f: f.join(raw, "url").selectExpr("url", "200 AS status", "'text/html' AS media_type", "html")
    visited = maintain.crawl_into(spark.createDataFrame([("http://h/a",)], "url string"), fetch, base)
    assert visited.count() == 1 or visited.count() == 2
    now = maintain.snapshot(spark, base)
    rows = {r.title: r for r in now.pages.collect()}
    assert rows["Um"].crawled_at is not None and [r.title for r in search.search(now, "programação").results] == ["Um"]


def test_http_fetcher_waits_no_longer_than_asked(spark):
    seen = []

    def get(url, timeout_s):
        seen.append((url, timeout_s))
        raise TimeoutError

    one = pg.http_fetcher(get, pg.CrawlOptions(retries=1, backoff_ms=1, jitter_ms=1, timeout_s=7))
    got = one(spark.createDataFrame([("http://h/a",)], "url string")).collect()
    assert [(r.url, r.status) for r in got] == [("http://h/a", 599)]


def test_batches_replace_all_or_nothing(spark, index, tmp_path):
    """An emptied page loses its postings, a failed batch changes nothing, and a snapshot stays what it was."""
    from textloom.operators import index as ixm
    from textloom.streaming import maintain

    base = f"file://{tmp_path}/versions"
    pages = index.pages
    assert maintain.manifest(spark, base)["version"] == 0
    assert maintain.upsert(pages, base) == 1
    first = maintain.snapshot(spark, base)
    before = sorted(map(str, first.postings.collect()))
    assert before == sorted(map(str, index.postings.collect())) and {r.language for r in first.meta.collect()} >= {"pt", "en"}
    from pyspark.sql import functions as F

    empty = pages.where("doc_id = 1").withColumn("title", F.lit("")).withColumn("content", F.lit(None).cast("string"))
    assert maintain.upsert(empty, base) == 2
    now = maintain.snapshot(spark, base)
    assert now.postings.where("doc_id = 1").count() == 0 and now.phrases.where("doc_id = 1").count() == 0 and now.pages.where("doc_id = 1").first().content == ""
    assert now.stats.first().total_docs == len(CORPUS)
    assert sorted(map(str, first.postings.collect())) == before
    broken = pages.where("doc_id = 2").withColumn("title", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        maintain.upsert(broken, base)
    assert maintain.manifest(spark, base)["version"] == 2
    keeper = maintain.Refresher(spark, base)
    assert keeper.refresh() and keeper.version == 2
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(maintain, "manifest", lambda *_: 1 / 0)
        assert not keeper.refresh() and keeper.failures == 1 and keeper.current.pages.count() == len(CORPUS)
    assert keeper.refresh()
    want = ixm.postings(ixm.tokens(now.pages)).count()
    maintain.upsert(pages.where("doc_id = 3"), base)
    maintain.vacuum(spark, base, 1)
    assert maintain.snapshot(spark, base).postings.count() == want


def test_server_and_client(spark, index, tmp_path):
    from textloom import api
    from textloom.operators.rank import Bm25Options

    held = [None]
    server = api.serve(api.own_engine(lambda: held[0]))
    client = api.Client(f"http://127.0.0.1:{server.server_address[1]}")
    try:
        assert client.search("dotnet") is None  # 503
        held[0] = index
        assert client.search(" ") is None and client._get("/other") is None
        got = client.search("lingagem", 5)
        assert got["didYouMean"] == {"original": "lingagem", "corrected": "linguagem"} and got["results"][0]["url"] == "u1"
        assert client.autocomplete("prog")["suggestions"][0] == {"text": "programacao", "isCorrection": False}
        clock = [0.0]
        box = api.SearchBox({"own": client}, "own", lambda: clock[0])
        box.typed("a prog")
        assert box.poll() is None
        clock[0] = 0.3
        assert "programacao" in box.poll() and box.poll() is None
        assert box.pick("programacao") == "a programacao" and box.pick("Biblioteca de classes") == "Biblioteca de classes" and box.submit()["results"]
    finally:
        server.shutdown()
    (tmp_path / "o.json").write_text('{"Bm25Options": {"k1": 2, "b": 0.5}}')
    got = api.options(Bm25Options, str(tmp_path / "o.json"), env={"TEXTLOOM_B": "0.25"})
    assert (got.k1, got.b, got.w_title) == (2.0, 0.25, 3.0)
    (tmp_path / "o.json").write_text('{"Bm25Options": {"k9": 2}}')
    with pytest.raises(ValueError):
        api.options(Bm25Options, str(tmp_path / "o.json"))


def test_tokens_beyond_the_columns(spark):
    """Index and query cut Hangul and signs beyond the basic plane alike."""
    text = "한국어 검색 엔진 𝐀𝐁 c# 😀 linguagem.net"
    pages = spark.createDataFrame([(1, "u", "한국어", text), (2, "u", "plain", "linguagem simples")], "doc_id long, url string, title string, content string")
    got = sorted((r.token, r.start, r.end) for r in ix.tokens(pages).where("doc_id = 1 AND field = 'content'").collect())
    assert got == sorted(exact.tokenize(text)) and len(got) > 4
    arrays = {r.doc_id: r.content_tokens for r in ix.token_arrays(pages).collect()}
    assert arrays == {1: [t for t, _, _ in exact.tokenize(text)], 2: ["linguagem", "simples"]}
    assert [r.doc_id for r in search.search(ix.build(pages), "검색").results] == [1]


def test_derived_columns_and_appended_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", None), (2, "b", "pt")], "doc_id long, title string, language string")
    derived = spark.createDataFrame([(1, "en", 5)], "doc_id long, language string, length_title int")
    assert sorted(map(tuple, pg.with_derived(pages, derived).collect())) == [(1, "a", "en", 5), (2, "b", "pt", None)]
    for _ in range(2):
        pg.append(pages, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 4


def test_frontier_beyond_capacity_is_dropped(spark):
    raw = spark.createDataFrame([("http://h/a", "".join(f'<a href="/{k}">x</a>' for k in range(9)))] + [(f"http://h/{k}", "") for k in range(9)], "url string, html string")
    visited, _ = pg.crawl(spark.createDataFrame([("http://h/a",)], "url string"), pg.table_fetcher(raw), options=pg.CrawlOptions(capacity=4))
    assert visited.count() == 1 + 4
