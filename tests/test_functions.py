"""Golden cases and properties of the column functions against their plain counterparts."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import distance, exact, html, language
from textloom.functions import text as X
from textloom.operators import evaluate, index

GOLDEN = {
    "C#": [("c#", 0, 2)],
    ".NET": [(".net", 0, 4)],
    "..net": [(".net", 0, 5)],
    "a..net": [(".net", 2, 6)],
    ". net": [("net", 2, 5)],
    "#net": [("net", 1, 4)],
    "c#.": [("c#", 0, 2)],
    "c++11": [("11", 3, 5)],
    "c++": [("c++", 0, 3)],
    "C": [],
    "asp.net core": [("asp", 0, 3), ("net", 4, 7), ("core", 8, 12)],
    "linguagem de programação": [("linguagem", 0, 9), ("programacao", 13, 24)],
    "foo_bar": [("foo", 0, 3), ("bar", 4, 7)],
    "x²": [],
    "c#x": [],
    "": [],
}


def test_tokens_by_state_machine():
    for text, want in GOLDEN.items():
        assert exact.tokenize(text) == want, text


def _spark_tokens(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string").withColumn("title", F.lit(""))
    out = {k: [] for k in range(len(texts))}
    for r in index.tokens(df).orderBy("doc_id", "pos").collect():
        out[r.doc_id].append((r.token, r.start, r.end))
    values = {r.doc_id: r.content_tokens for r in index.token_arrays(df).collect()}
    return [out[k] for k in range(len(texts))], [values[k] for k in range(len(texts))]


def test_tokens_by_expressions(spark):
    rng = random.Random(7)
    texts = [*GOLDEN, *("".join(rng.choice("aBé#+.. _çÀ1ß") for _ in range(rng.randint(1, 24))) for _ in range(400))]
    placed, values = _spark_tokens(spark, texts)
    for t, p, v in zip(texts, placed, values, strict=True):
        assert p == exact.tokenize(t), t
        assert v == [x for x, _, _ in exact.tokenize(t)], t


def test_ngrams(spark):
    assert exact.word_ngrams(["a", "b", "c"], 2) == ["a_b", "b_c"] and exact.word_ngrams(["a", "b"], 3) == []
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(X.word_ngrams(F.col("t"), 2)).collect()] == [["a_b", "b_c"], [], []]


def test_distances():
    assert distance.damerau_distance("ca", "abc") == 2 and distance.osa_distance("ca", "abc") == 3
    assert distance.damerau_distance("ab", "ba") == 1 and distance.damerau_distance("", "abc") == 3


words = st.text(alphabet="abcd", max_size=6)


@settings(max_examples=200, deadline=None)
@given(words, words, words)
def test_damerau_is_a_metric(a, b, c):
    d = distance.damerau_distance
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)


def test_window(spark):
    rng = random.Random(3)
    cases = [[[0, 10], [4, 12]], [[7, 9]], *([sorted(rng.sample(range(60), rng.randint(1, 6))) for _ in range(rng.randint(1, 4))] for _ in range(200))]
    df = spark.createDataFrame(list(enumerate(cases)), "k int, l array<array<int>>")
    for r in df.select("k", "l", X.best_window(F.col("l")).alias("w")).collect():
        assert (r.w.start, r.w.start + r.w.span) == exact.best_window(r.l), r.l
    assert exact.best_window([[0, 10], [4, 12]]) == (10, 12) and exact.best_window([[7, 9]]) == (7, 7)


def test_preview(spark):
    df = spark.createDataFrame([("x" * 500, 100, 120), ("y" * 250, None, None), ("a  b\nc", 0, 3)], "c string, s int, e int")
    got = [r[0] for r in df.select(X.preview(F.col("c"), F.col("s"), F.col("e"))).collect()]
    assert got == ["…" + "x" * 220 + "…", "y" * 200 + "…", "a b c"]


def test_match_rank(spark):
    df = spark.createDataFrame([("c# guide",), ("language",), ("guide",)], "t string")
    assert [r[0] for r in df.select(X.match_rank(F.col("t"), "gui")).collect()] == [1, -1, 0]


def test_language():
    assert language.detect("") == ("und", False) and language.detect("123 !!") == ("und", False)
    assert language.detect("Many people read the news and search for information every day") == ("en", True)


def test_language_frames(spark):
    texts = [language.SAMPLES["es"][:90], "the people work and learn every day", "123", "", "é", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language.detect_languages(df).collect():
        assert (r.language, r.confident) == language.detect(texts[r.doc_id]), texts[r.doc_id]


def test_html(spark):
    page = "<html><head><title> A &amp; B </title><style>p{}</style></head><body><script>var t='</p>';</script><p>a</p><p>b<!-- c --></p><noscript>x<a href='/no'>n</a></noscript><a href=\"/d?e\">d</a></body></html>"
    assert html.parse(page) == ("A & B", "abd", ["/d?e"])
    r = spark.createDataFrame([(page,)], "h string").select(html.title_expr(F.col("h")), html.text_expr(F.col("h")), html.read_html("h")).first()
    assert r[0] == "A & B" and r[1] == "abd" and r[2].text == "abd"
    assert html.resolve("http://h/a/b", "../c?x=1#f") == "http://h/c"
    assert [html.resolve("http://h/", x) for x in ("#top", "javascript:x", "mailto:a@b", " ", None)] == [None] * 5


def test_evaluation():
    assert evaluate.percentile(list(range(1, 21)), 0.95) == 19
    assert evaluate.jaccard([], []) == 1.0 and evaluate.jaccard(["a"], []) == 0.0
    assert [exact.edit_budget(n, 2) for n in (2, 3, 4, 5)] == [0, 1, 1, 2] and [exact.edit_budget(n, 1) for n in (2, 3, 5)] == [0, 1, 1]
    out = evaluate.compare({"a": lambda q: [q], "b": lambda q: [q, "x"]}, iterations=2, warmup=1)
    assert out["overlap"] == 0.5 and "| label |" in evaluate.report(out)


def test_small_functions(spark):
    df = spark.createDataFrame([("ab cd",)], "s string")
    r = df.select(X.last_word(F.col("s")), X.replace_last_word(F.col("s"), F.lit("x")), X.url_escape(F.lit("a b")), X.common_prefix_length(F.lit("abcx"), F.lit("abdx")), X.split_words(F.lit("é-a_b"))).first()
    assert list(r) == ["cd", "ab x", "a%20b", 2, ["é", "a", "b"]]


def test_registered(spark):
    from textloom.functions.register import register

    register(spark)
    assert spark.sql("SELECT damerau('ca', 'abc'), osa('ca', 'abc'), tokenize('C# x')").first()[:] == (2, 3, ["c#"])
    assert [r.ngram for r in spark.sql("SELECT * FROM word_ngrams('foo bar baz', 2)").collect()] == ["foo_bar", "bar_baz"]
