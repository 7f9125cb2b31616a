"""Language detection by out-of-place distance between ranked character n-gram profiles."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.scan import lean

UNDETERMINED, PROFILE, ABSENT, MARGIN, LEAST_GRAMS = "und", 320, 320, 0.08, 4

#: The training texts, in the order that breaks ties.
SAMPLES = {
    "pt": (
        "A internet mudou a forma como as pessoas trabalham e aprendem todos os dias. Muitas pessoas usam o computador para escrever mensagens, ler notícias e procurar "
        "informações sobre qualquer assunto. As cidades grandes têm bibliotecas e escolas onde os estudantes podem estudar e fazer perguntas aos professores. Quando alguém "
        "precisa de ajuda, costuma perguntar a um amigo ou pesquisar na rede. O conhecimento está cada vez mais perto de todos, porque basta uma busca para encontrar respostas. "
        "Mesmo assim, é importante pensar com cuidado e comparar fontes diferentes antes de acreditar em tudo o que se lê."
    ),
    "en": (
        "The internet has changed the way people work and learn every single day. Many people use their computers to write messages, read the news and search for information about "
        "almost any subject. Large cities have libraries and schools where students can study and ask their teachers questions. When someone needs help, they usually ask a friend "
        "or look it up on the network. Knowledge is closer to everyone than before, because a simple search is enough to find answers. Even so, it is important to think carefully "
        "and compare different sources before believing everything that you read."
    ),
    "es": (
        "La internet ha cambiado la forma en que las personas trabajan y aprenden todos los días. Muchas personas usan la computadora para escribir mensajes, leer noticias y "
        "buscar información sobre cualquier tema. Las ciudades grandes tienen bibliotecas y escuelas donde los estudiantes pueden estudiar y hacer preguntas a sus profesores. "
        "Cuando alguien necesita ayuda, suele preguntar a un amigo o buscar en la red. El conocimiento está cada vez más cerca de todos, porque basta una búsqueda para "
        "encontrar respuestas. Aun así, es importante pensar con cuidado y comparar fuentes diferentes antes de creer todo lo que se lee."
    ),
}


_LETTERS, _ASCII_LETTERS = regex.compile(r"\p{L}+"), re.compile("[a-z]+")


def ranked(text: str, most: int = PROFILE) -> list[tuple[str, int]]:
    """A text's most frequent grams of one to three characters with their counts: by count, then by code point.

    All words stand in one line, each between underscores; grams with a space in them reach over a word's end and go.
    """
    text = (text or "").lower()
    words = (_ASCII_LETTERS if text.isascii() else _LETTERS).findall(text)
    if not words:
        return []
    # three code points to a number, the first one highest: numbers are in the order of the grams, shorter ones first
    a = np.frombuffer(("_" + "_ _".join(words) + "_").encode("utf-32-le"), "<u4").astype("int64")
    b, c = a[1:], a[2:]
    one, two, three = a << 42, (a[:-1] << 42) | (b << 21), (a[:-2] << 42) | (b[:-1] << 21) | c
    word = a != 32
    pair = word[:-1] & word[1:]
    keys, counts = np.unique(np.concatenate([one[word], two[pair], three[pair[:-1] & word[2:]]]), return_counts=True)
    best = np.argsort(-counts, kind="stable")[:most]
    keys, counts = keys[best], counts[best]
    signs = np.stack([keys >> 42, (keys >> 21) & 0x1FFFFF, keys & 0x1FFFFF], 1).astype("<u4")
    return list(zip(signs.view("<U3").ravel().tolist(), counts.tolist(), strict=True))


def profile(text: str, most: int = PROFILE) -> dict[str, int]:
    """Grams with their ranks: by count, then by code point."""
    return {g: k for k, (g, _) in enumerate(ranked(text, most))}


def detect(text: str, samples=SAMPLES) -> tuple[str, bool]:
    """(language, confident) of one text."""
    own = profile(text or "")
    if len(own) < LEAST_GRAMS or not samples:
        return UNDETERMINED, False
    order = sorted((sum(abs(r - p[g]) if g in p else ABSENT for g, r in own.items()), k, lang) for k, (lang, p) in enumerate((x, _profile_of(t)) for x, t in samples.items()))
    if len(order) == 1:
        return order[0][2], True
    return order[0][2], order[1][0] > 0 and order[1][0] - order[0][0] >= MARGIN * order[1][0]


_profile_of = lru_cache(maxsize=64)(profile)


def gram_lists(texts: DataFrame, most: int = PROFILE) -> DataFrame:
    """doc_id, grams (gram, n) by rank: each text's profile. A text's grams are counted where it stands, so that nothing is shuffled."""
    lean(texts.sparkSession)

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])))
    def grams(text: pa.Array) -> pa.Array:
        at, names, numbers = [0], [], []
        for t in text:
            for g, n in ranked(t.as_py(), most):
                names.append(g)
                numbers.append(n)
            at.append(len(names))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64())], ["gram", "n"]))

    return texts.select("doc_id", grams(F.col("text")).alias("grams"))


def gram_ranks(texts: DataFrame, most: int = PROFILE) -> DataFrame:
    """doc_id, gram, n, rnk: a row for each gram of gram_lists()."""
    own = gram_lists(texts, most).select("doc_id", F.posexplode("grams").alias("rnk", "g"))
    return own.select("doc_id", "g.gram", "g.n", "rnk")


def detect_languages(texts: DataFrame, samples=SAMPLES) -> DataFrame:
    """doc_id, language, confident for every row of texts (doc_id, text), without a shuffle."""

    lean(texts.sparkSession)

    @F.pandas_udf("language string, confident boolean")
    def guess(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([detect(t, samples) for t in text], columns=["language", "confident"])

    return texts.select("doc_id", guess("text").alias("g")).select("doc_id", "g.language", "g.confident")


@F.pandas_udf(T.StringType())
def language_of(text: pd.Series) -> pd.Series:
    """The language of detect_languages() as a column."""
    return text.map(lambda t: detect(t)[0])
