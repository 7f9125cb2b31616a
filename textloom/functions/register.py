"""The functions under SQL names."""

from __future__ import annotations

import inspect

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from textloom.functions import distance, exact, html, language


@udtf(returnType="ngram string, pos int")
class WordNgrams:
    def eval(self, text: str, size: int):
        for k, g in enumerate(exact.word_ngrams([t for t, _, _ in exact.tokenize(text or "")], size)):
            yield g, k


@udtf(returnType="gram string, rnk int")
class CharNgrams:
    def eval(self, text: str):
        yield from language.profile(text or "").items()


def _batched(f, kind: str):
    """f(value, ...) as an Arrow function; null in, null out."""
    if len(inspect.signature(f).parameters) == 1:
        return pandas_udf(_one(f), kind)
    return pandas_udf(_two(f), kind)


def _one(f):
    def run(a: pd.Series) -> pd.Series:
        return a.map(f, na_action="ignore")

    return run


def _two(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run


def register(spark: SparkSession) -> None:
    spark.udf.register("tokenize", _batched(lambda s: [t for t, _, _ in exact.tokenize(s)], "array<string>"))
    spark.udf.register("fold", _batched(exact.fold, "string"))
    spark.udf.register("damerau", _batched(distance.damerau_distance, "int"))
    spark.udf.register("osa", _batched(distance.osa_distance, "int"))
    spark.udf.register("html_text", html.html_text)
    spark.udf.register("detect_language", _batched(lambda s: language.detect(s)[0], "string"))
    spark.udtf.register("word_ngrams", WordNgrams)
    spark.udtf.register("char_ngrams", CharNgrams)
