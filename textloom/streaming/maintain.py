"""Incremental maintenance: pages arrive as a stream, and the tables of the index follow.

Tables are split by a hash of the page, so that a batch rewrites the parts of its own pages and no others. A batch writes
them as files of a new version, and a manifest, which names for each table the version of each part, is put in place last:
readers see all of a batch or nothing, a failure before that changes nothing, and a part that the batch has emptied isn't
in the manifest any more. Replacing by page makes a batch that runs twice harmless.
"""

from __future__ import annotations

import json
import logging
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import scan
from textloom.functions.language import language_of
from textloom.operators import index as ix
from textloom.sources.pages import PAGES, CrawlOptions, crawl, crawled_pages
from textloom.sources.shared import Store

PARTS = 64
#: Phrases, which are several times as large as the texts, are made of the pages by who asks for them.
TABLES = ("pages", "meta", "postings")


def _part(df: DataFrame, parts: int) -> DataFrame:
    return df.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))


def _with_part(schema):
    from pyspark.sql.types import IntegerType, StructType

    return StructType([f for f in schema.fields if f.name != "part"]).add("part", IntegerType())


def _write(df: DataFrame, folder: str) -> None:
    """df as files of its parts (part). A task has few parts, so that it holds a file open for each instead of sorting its rows."""
    spark = df.sparkSession
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, "8")
    try:
        df.write.mode("overwrite").partitionBy("part").parquet(folder)
    finally:
        spark.conf.set(name, before)


def manifest(spark: SparkSession, base: str, version: int | None = None) -> dict:
    """{version, parts, tables: {name: {part: version}}, schemas: {name: json}}: the last one, or that of a version."""
    store = Store(spark, f"{base}/manifest")
    known = [int(n.removesuffix(".json")) for n in store.names("") if n.endswith(".json") and n[:-5].isdigit()]
    if not known:
        return {"version": 0, "tables": {n: {} for n in TABLES}, "schemas": {}}
    return json.loads(store.read(f"{version or max(known)}.json"))


def _folder(base: str, name: str, version: int) -> str:
    return f"{base}/{name}/v{version}"


def read(spark: SparkSession, base: str, name: str, now: dict | None = None, parts: list[int] | None = None) -> DataFrame:
    """A table as a manifest has it, or some parts of it."""
    from pyspark.sql.types import StructType

    now = now or manifest(spark, base)
    schema = StructType.fromJson(json.loads(now["schemas"][name]))
    paths = [f"{_folder(base, name, v)}/part={p}" for p, v in now["tables"][name].items() if parts is None or int(p) in parts]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(batch: DataFrame, base: str, parts: int = PARTS) -> int:
    """Replace what the tables below base hold of the batch's pages (doc_id, url, title, content, crawled_at); the new version.

    Of several rows for a page the one that was crawled last counts; of those, one that sorts last.
    """
    spark = batch.sparkSession
    at = F.col("crawled_at") if "crawled_at" in batch.columns else F.lit(None).cast("timestamp")
    latest = F.max(F.struct(at.alias("crawled_at"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"))).alias("p")
    pages = batch.where("doc_id IS NOT NULL").groupBy("doc_id").agg(latest).select("doc_id", "p.url", "p.title", "p.content", "p.crawled_at")
    old = manifest(spark, base)
    if old.get("parts", parts) != parts:
        raise ValueError(f"the tables have {old['parts']} parts")
    # the batch is settled first, split into parts already; what is made of it stays in its part and is written without a shuffle
    settled = f"{base}/batches/{uuid.uuid4().hex}"
    try:
        _write(_part(pages, parts).repartition(parts, "part"), settled)
        touched = [int(n.removeprefix("part=")) for n in Store(spark, settled).names("") if n.startswith("part=")]
        pages = spark.read.schema(_with_part(pages.schema)).parquet(settled)
        ids = pages.select("doc_id").hint("shuffle_hash")
        texts = pages.select("*", F.concat_ws(" ", "title", "content").alias("text"))
        new = {
            "pages": pages,
            "meta": texts.select("doc_id", scan.token_count(F.col("title")).alias("length_title"), scan.token_count(F.col("content")).alias("length_content"), language_of(F.col("text")).alias("language"), "part"),
            "postings": ix.page_postings(pages, "part"),
        }
        now = {"version": old["version"] + 1, "parts": parts, "tables": {}, "schemas": {n: json.dumps(new[n].drop("part").schema.jsonValue()) for n in TABLES}}
        kept: dict[str, DataFrame] = {}
        if old["schemas"]:
            kept["pages"] = _part(read(spark, base, "pages", old, touched), parts).join(ids, "doc_id", "left_anti")
            kept["meta"] = _part(read(spark, base, "meta", old, touched), parts).join(ids, "doc_id", "left_anti")
        for name in TABLES:
            folder = _folder(base, name, now["version"])
            if name == "postings" and kept:
                # those of kept pages are made again of the texts as just written: cheaper than to shuffle their postings
                own = spark.read.schema(_with_part(new["pages"].drop("part").schema)).parquet(_folder(base, "pages", now["version"]))
                _write(ix.page_postings(own, "part"), folder)
            elif kept:
                _write(new[name].unionByName(kept[name].select(new[name].columns)).repartition(parts, "part"), folder)
            else:
                _write(new[name], folder)
            written = {int(n.removeprefix("part=")) for n in Store(spark, folder).names("") if n.startswith("part=")}
            now["tables"][name] = {p: v for p, v in old["tables"][name].items() if int(p) not in touched} | {str(p): now["version"] for p in sorted(written)}
        Store(spark, f"{base}/manifest").put(f"{now['version']}.json", json.dumps(now))
        return now["version"]
    finally:
        Store(spark, settled).delete("")


def vacuum(spark: SparkSession, base: str, keep: int = 2) -> None:
    """Delete what none of the last `keep` manifests names; readers of older ones fail from then on."""
    store = Store(spark, f"{base}/manifest")
    numbers = sorted(int(n.removesuffix(".json")) for n in store.names("") if n.endswith(".json"))
    live = [manifest(spark, base, n) for n in numbers[-keep:]]
    for n in numbers[:-keep]:
        store.delete(f"{n}.json")
    for name in TABLES:
        own = Store(spark, f"{base}/{name}")
        used = {(v, int(p)) for m in live for p, v in m["tables"][name].items()}
        for folder in own.names(""):
            if not folder.removeprefix("v").isdigit() or int(folder[1:]) > numbers[-1]:
                continue
            for part in own.names(folder):
                if part.startswith("part=") and (int(folder[1:]), int(part[5:])) not in used:
                    own.delete(f"{folder}/{part}")


def follow(spark: SparkSession, source: str, base: str, checkpoint: str, once: bool = True, every: str = "60 seconds"):
    """A stream from a folder of pages into the tables below base."""
    stream = spark.readStream.schema(PAGES).parquet(source)
    out = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: upsert(df, base))
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()


def snapshot(spark: SparkSession, base: str, version: int | None = None) -> ix.Index:
    """An index object over the tables of one version, whatever batches come after."""
    now = manifest(spark, base, version)
    pages, posts, meta = (read(spark, base, n, now) for n in ("pages", "postings", "meta"))
    vocab, tokens = ix.vocabulary(posts), ix.tokens(pages)
    return ix.Index(pages, tokens, posts, ix.phrase_postings(tokens), meta, ix.stats(meta), vocab, ix.prefix_top(vocab), ix.titles(pages), lazy=True)


def crawl_into(seeds: DataFrame, fetch, base: str, depth: int | None = None, options: CrawlOptions = CrawlOptions()) -> DataFrame:
    """Walk from seeds (url) and put the pages that answer into the tables below base; what was visited."""
    visited, responses = crawl(seeds, fetch, depth, options)
    upsert(crawled_pages(responses), base)
    return visited


class Refresher:
    """Keeps a snapshot of the tables below base, and takes a new one when there is a new version.

    current is None until there is a first version. A refresh that fails leaves the snapshot as it is and is tried again.
    """

    def __init__(self, spark: SparkSession, base: str, every: float = 60.0):
        self.spark, self.base, self.every = spark, base, every
        self.current: ix.Index | None = None
        self.version, self.failures = 0, 0
        self._stop = threading.Event()

    def refresh(self) -> bool:
        """Whether the snapshot is that of the last version now."""
        try:
            last = manifest(self.spark, self.base)["version"]
            if last > self.version:
                self.current = snapshot(self.spark, self.base, last)  # one assignment: readers have the old one or the new one
                self.version = last
            return True
        except Exception:
            self.failures += 1
            logging.getLogger(__name__).warning("refresh of %s failed", self.base, exc_info=True)
            return False

    def start(self) -> Refresher:
        def run():
            while not self._stop.is_set():
                self.refresh()
                self._stop.wait(self.every)

        threading.Thread(target=run, daemon=True).start()
        return self

    def stop(self) -> None:
        self._stop.set()
