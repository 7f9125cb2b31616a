"""URL filters as a temporal list join.

A list is a log of dated entries: (kind, value, category, action, day) adds or removes a host, a domain with all below it,
or a path prefix of a host. Entries become validity intervals, from an addition's day until the day of the next entry for
the same thing; every URL and day of the captures meets the intervals that hold on that day, by equality on the keys the
URL gives (its host, each domain above it, each path prefix at a slash). All in SQL functions, no Python on the way.

Both sides shuffle on the key, and Spark splits the keys of hot hosts or, where it finds the list's side small enough when
it has been written, sends that around instead. What is found is joined back by URL and day, so that it doesn't matter how
captures are numbered. Only keys that the list has at all go into the join (a left semi join would cost the same shuffle,
so the equi-join itself does that).

Nulls: a null URL, and one without a scheme and host, matches nothing; a null fetch day matches nothing; a capture_id is
carried along, null or not; list entries with a null kind, value, action or day are dropped. A null category is the category
''. Ties: of several entries for the same thing on one day, a removal wins. Repeated list rows change nothing; captures that
repeat, or share a capture_id with others, are judged one by one. Very long URLs give one key for each slash. Other columns,
whatever their names, are carried along in the capture. An empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import table

HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """kind, value, category, valid_from, valid_to (exclusive; null: still valid) of a dated list."""
    own = entries.where("kind IS NOT NULL AND value IS NOT NULL AND action IS NOT NULL AND day IS NOT NULL").select("kind", F.lower("value").alias("value"), F.coalesce("category", F.lit("")).alias("category"), "action", "day")
    by_day = own.groupBy("kind", "value", "category", "day").agg(F.max(F.col("action") == "remove").alias("removed"))
    after = F.lead("day").over(Window.partitionBy("kind", "value", "category").orderBy("day"))
    return by_day.withColumn("valid_to", after).where("NOT removed").select("kind", "value", "category", F.col("day").alias("valid_from"), "valid_to")


def keys(url) -> tuple:
    """host and the array of (kind, value) that a list entry could have to match url."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    path = F.regexp_extract(url, PATH, 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("path").alias("kind"), F.lower(F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("value")))
    exact = F.array(F.struct(F.lit("host").alias("kind"), host.alias("value")))
    return host, F.when(host != "", F.concat(exact, domains, F.when(F.size(parts) > 0, prefixes).otherwise(F.slice(exact, 1, 0))))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """capture (the whole row: url, day, ...) with host, active (entries that match on that day), categories (sorted) and blocked."""
    host, all_keys = keys(F.col("url"))
    asked = captures.where("url IS NOT NULL AND day IS NOT NULL").select("url", F.col("day").alias("fetched")).distinct()
    asked = asked.select("url", "fetched", F.explode(all_keys).alias("k")).select("url", "fetched", "k.kind", "k.value").distinct()
    met = asked.join(intervals(entries), ["kind", "value"]).where("fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to)")
    found = met.groupBy(F.col("url").alias("asked"), "fetched").agg(F.count("*").alias("active"), F.array_sort(F.collect_set("category")).alias("categories"))
    rows = captures.select(F.struct("*").alias("capture"), host.alias("host"))
    out = rows.join(found, (F.col("capture.url") == found.asked) & (F.col("capture.day") == found.fetched), "left")
    return out.select(
        "capture",
        "host",
        F.coalesce("active", F.lit(0)).alias("active"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
        F.col("active").isNotNull().alias("blocked"),
    )


def dated_list(pages: DataFrame) -> DataFrame:
    """A list for these pages by rule: of all hosts, of all domains above them and of all first path parts, those that a digest picks, with dates it gives."""
    host, _ = keys(F.col("url"))
    path = F.element_at(F.filter(F.split(F.regexp_extract("url", PATH, 1), "/"), lambda x: x != ""), 1)
    named = pages.select(host.alias("host"), path.alias("path")).where("host <> ''").distinct()
    things = named.select(F.lit("host").alias("kind"), F.col("host").alias("value"))
    things = things.unionByName(named.select(F.lit("domain").alias("kind"), F.regexp_extract("host", r"[^.]+\.[^.]+$", 0).alias("value")))
    things = things.unionByName(named.where("path <> ''").select(F.lit("path").alias("kind"), F.lower(F.concat("host", F.lit("/"), "path")).alias("value")))
    md5 = F.md5(F.concat("kind", F.lit(":"), "value"))
    digit = lambda k: F.instr(F.lit("0123456789abcdef"), F.substring("m", k, 1)) - 1
    own = things.where("value <> ''").distinct().withColumn("m", md5).where(digit(1) < 6)
    start = F.date_add(F.lit("2024-01-01").cast("date"), digit(2) * 16 + digit(3))
    log = F.array(
        F.struct(F.lit("add").alias("action"), start.alias("day")),
        F.struct(F.lit("remove").alias("action"), F.date_add(start, 10 + digit(4)).alias("day")),
        F.struct(F.lit("add").alias("action"), F.date_add(start, 40 + digit(5)).alias("day")),
    )
    several = F.when(digit(6) < 6, F.slice(log, 1, 1)).when(digit(6) < 11, F.slice(log, 1, 2)).otherwise(log)
    category = F.element_at(F.array(*map(F.lit, ("adult", "malware", "spam"))), digit(7) % 3 + 1)
    return own.select("kind", "value", category.alias("category"), F.explode(several).alias("e")).select("kind", "value", "category", "e.action", "e.day")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day that its id gives, against the list that dated_list() makes of all pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("day"))
    return judge(captures, dated_list(pages)).select(F.col("capture.capture_id").alias("page_id"), "capture.url", F.col("capture.day").cast("string").alias("day"), "host", "active", F.array_join("categories", ",").alias("categories"), "blocked")


SQL = r"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INT AS day,
      regexp_replace(lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', '') AS host,
      list_filter(string_split(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
things AS (SELECT DISTINCT * FROM (
      SELECT 'host' AS kind, host AS value FROM p WHERE host <> ''
      UNION ALL SELECT 'domain', regexp_extract(host, '[^.]+\.[^.]+$') FROM p WHERE host <> ''
      UNION ALL SELECT 'path', lower(host || '/' || parts[1]) FROM p WHERE host <> '' AND len(parts) > 0) WHERE value <> ''),
m AS (SELECT *, list_transform(range(1, 8), lambda k: strpos('0123456789abcdef', substr(md5(kind || ':' || value), k, 1)) - 1) AS g FROM things),
own AS (SELECT kind, value, ['adult', 'malware', 'spam'][(g[7] % 3 + 1)::INT] AS category, g, DATE '2024-01-01' + (g[2] * 16 + g[3])::INT AS start FROM m WHERE g[1] < 6),
log AS (SELECT kind, value, category, 'add' AS action, start AS day FROM own
      UNION ALL SELECT kind, value, category, 'remove', start + (10 + g[4])::INT FROM own WHERE g[6] >= 6
      UNION ALL SELECT kind, value, category, 'add', start + (40 + g[5])::INT FROM own WHERE g[6] >= 11),
held AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY kind, value, category ORDER BY day) AS valid_to FROM log) WHERE action = 'add'),
asked AS (SELECT DISTINCT page_id, day, kind, value FROM (
      SELECT page_id, day, 'host' AS kind, host AS value FROM p WHERE host <> ''
      UNION ALL SELECT page_id, day, 'domain', array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')
        FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM p WHERE host <> '')
      UNION ALL SELECT page_id, day, 'path', lower(host || '/' || array_to_string(list_slice(parts, 1, i), '/'))
        FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p WHERE host <> ''))),
met AS (SELECT a.page_id, a.day, count(*) AS active, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM asked a
      JOIN held h ON a.kind = h.kind AND a.value = h.value AND a.day >= h.day AND (h.valid_to IS NULL OR a.day < h.valid_to) GROUP BY a.page_id, a.day)
SELECT p.page_id, p.url, p.day::DATE::VARCHAR AS day, p.host, coalesce(active, 0) AS active, coalesce(categories, '') AS categories, active IS NOT NULL AS blocked
FROM p LEFT JOIN met ON p.page_id = met.page_id AND p.day = met.day
"""
