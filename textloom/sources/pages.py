"""Pages and their link graph: from document tables, from raw HTML, from a breadth-first crawl."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import html as H
from textloom.sources.shared import shared_folder

AGENT = "textloom-crawler/1.0"

PAGES = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("url", T.StringType()), ("title", T.StringType()), ("content", T.StringType()), ("crawled_at", T.TimestampType()), ("length_title", T.IntegerType()), ("length_content", T.IntegerType()), ("language", T.StringType()))]
)


@dataclass(frozen=True)
class CrawlOptions:
    max_pages: int = 500
    capacity: int = 10_000
    retries: int = 3
    backoff_ms: int = 200
    jitter_ms: int = 250
    timeout_s: int = 15


class Catalog:
    """Table names and where they lie."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}.parquet")


def from_documents(documents: DataFrame) -> DataFrame:
    """doc_id, url, title (the first line) and content of plain documents."""
    return documents.select("doc_id", F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"))


def from_html(raw: DataFrame, exact: bool = True) -> DataFrame:
    """doc_id, url, title and content of raw pages (page_id, url, html): by a parser, or by patterns alone. In both, references end with a semicolon."""
    if exact:
        read = raw.select(F.col("page_id").alias("doc_id"), "url", H.read_html_closed("html").alias("r"))
        return read.select("doc_id", "url", F.col("r.title").alias("title"), F.col("r.text").alias("content"))
    return raw.select(F.col("page_id").alias("doc_id"), "url", H.title_expr(F.col("html")).alias("title"), H.text_expr(F.col("html")).alias("content"))


def html_only(responses: DataFrame) -> DataFrame:
    """Successful responses with HTML in them."""
    return responses.where(F.col("status").between(200, 299) & (F.lower("media_type") == "text/html"))


def links(raw: DataFrame) -> DataFrame:
    """src_url, dst_url: every link that leads to an absolute http(s) address."""
    found = raw.select(F.col("url").alias("src_url"), F.explode(H.links_expr(F.col("html"))).alias("href"))
    return found.select("src_url", H.canonical_expr(F.col("src_url"), F.col("href")).alias("dst_url")).where("dst_url <> ''")


def get(pages: DataFrame, doc_id: int) -> DataFrame:
    return pages.where(F.col("doc_id") == doc_id).limit(1)


def get_many(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Pages of ids (doc_id); ids that don't exist or are null give nothing."""
    return pages.join(ids.where("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi")


def append(pages: DataFrame, path: str) -> None:
    """Add pages to the table at path; a page that is there already isn't replaced."""
    pages.write.mode("append").parquet(path)


def with_derived(pages: DataFrame, derived: DataFrame) -> DataFrame:
    """Pages with the columns of derived (doc_id, ...) in place of their own, where derived has the page."""
    names = [c for c in derived.columns if c != "doc_id"]
    new = derived.select(F.col("doc_id").alias("__id"), F.struct(*names).alias("__new"))
    both = pages.join(new, F.col("doc_id") == F.col("__id"), "left")
    own = lambda c: F.when(F.col("__id").isNotNull(), F.col("__new").getField(c)).otherwise(F.col(c) if c in pages.columns else F.lit(None))
    return both.select(*[own(c).alias(c) if c in names else F.col(c) for c in pages.columns], *[own(c).alias(c) for c in names if c not in pages.columns])


def table_fetcher(raw: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A fetcher that answers from a table of pages (url, html) by canonical address."""
    known = raw.select(H.canonical_expr(F.col("url"), F.col("url")).alias("url"), F.col("html"))

    def fetch(frontier: DataFrame) -> DataFrame:
        return frontier.join(known, "url").select("url", F.lit(200).alias("status"), F.lit("text/html").alias("media_type"), "html")

    return fetch


def get_over_http(url: str, timeout_s: float) -> tuple[int, str, str]:
    """(status, media type, body) of a GET request. Errors of the network and timeouts are OSError."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers={"User-Agent": AGENT}), timeout=timeout_s) as r:
            return r.status, r.headers.get_content_type(), r.read().decode(r.headers.get_content_charset() or "utf-8", errors="replace")
    except HTTPError as e:
        return e.code, e.headers.get_content_type(), ""


def http_fetcher(get_url: Callable[[str, float], tuple[int, str, str]] = get_over_http, options: CrawlOptions = CrawlOptions()) -> Callable[[DataFrame], DataFrame]:
    """A fetcher over get_url(url, timeout in seconds) -> (status, media type, html), with retries and growing, jittered waits on errors."""

    def fetch_all(frames):
        import random
        import time

        import pandas as pd

        for urls in frames:
            rows = []
            for url in urls["url"]:
                for k in range(options.retries + 1):
                    try:
                        status, media, body = get_url(url, options.timeout_s)
                    except OSError:
                        status, media, body = 599, "", ""
                    if status < 500 and status not in (408, 429) or k == options.retries:
                        break
                    time.sleep((2 ** (k + 1) * options.backoff_ms + random.uniform(0, options.jitter_ms)) / 1000)
                rows.append((url, status, media, body))
            yield pd.DataFrame(rows, columns=["url", "status", "media_type", "html"])

    return lambda frontier: frontier.select("url").mapInPandas(fetch_all, "url string, status int, media_type string, html string")


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], depth: int | None = None, options: CrawlOptions = CrawlOptions()) -> tuple[DataFrame, DataFrame]:
    """(visited: url, url_key, depth; responses with crawled_at) of a breadth-first walk from seeds (url).

    Addresses are visited once, whatever their case. The budget counts attempts. Each level is cut from its lineage by
    checkpoint(), which lies in the shared folder, so that a lost executor costs one level at most.
    """
    shared_folder(seeds.sparkSession)
    frontier = seeds.select("url", F.lower("url").alias("url_key")).groupBy("url_key").agg(F.min("url").alias("url"), F.lit(0).alias("depth")).checkpoint()
    visited, responses, level = frontier.limit(0), None, 0
    attempted = 0
    while True:
        left = options.max_pages - attempted
        now = frontier.orderBy("url_key").limit(max(min(left, options.capacity), 0)).checkpoint()
        n = now.count()
        if n == 0:
            break
        attempted += n
        visited = visited.unionByName(now)
        got = html_only(fetch(now.select("url"))).withColumn("crawled_at", F.current_timestamp()).checkpoint()
        responses = got if responses is None else responses.unionByName(got)
        level += 1
        if depth is not None and level > depth:
            break
        new = links(got).groupBy(F.lower("dst_url").alias("url_key")).agg(F.min("dst_url").alias("url"), F.lit(level).alias("depth"))
        frontier = new.join(visited, "url_key", "left_anti").checkpoint()
    return visited.select("url", "url_key", "depth"), responses if responses is not None else html_only(fetch(frontier.select("url"))).withColumn("crawled_at", F.current_timestamp())


def crawled_pages(responses: DataFrame) -> DataFrame:
    """doc_id (a hash of the address, whatever its case), url, title, content and crawled_at of a crawl's responses, ready to be indexed."""
    read = responses.select(F.xxhash64(F.lower("url")).alias("doc_id"), "url", H.read_html("html").alias("r"), "crawled_at")
    return read.select("doc_id", "url", F.col("r.title").alias("title"), F.col("r.text").alias("content"), "crawled_at")
