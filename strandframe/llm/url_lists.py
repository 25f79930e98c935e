"""URL filters whose lists change over time: every capture is judged by the entries in force when it was fetched.

The dated additions and removals of a list become intervals of validity. A capture offers the keys it can be listed under:
its host, every parent domain, every prefix of its path at a slash, and the whole path. Keys are compared in lower case, a
host without closing dots. Only keys that the list has go on to the as-of join, which is on key, month and part, with the exact
date within; it finds the entry of each key in force, and the longest key decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import read, written

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
#: List keys that are sent to every executor to sieve what captures offer; a longer list is joined by its keys.
BROADCAST_KEYS = 500_000
#: Parts that the captures under one key and month are dealt to.
PARTS = 16


def host_of(url: str) -> F.Column:
    """The host of a URL in lower case, without the dots that close a full name; empty if it has none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), "[.]+$", "")


def intervals(events: DataFrame) -> DataFrame:
    """Rows (key, reason, valid_from, valid_to) of events (key, action, at, reason): action add or remove.

    An entry holds from its day up to the day before the key's next event; valid_to is null while there is none. On one
    day an addition beats a removal, and of several additions the one with the least reason counts. Events with a null
    key, day or action are left out; keys are in lower case, without dots that close the host and a closing slash.
    """
    known = events.where("key IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    daily = known.groupBy(F.regexp_replace(F.regexp_replace(F.lower("key"), "/$", ""), "^([^/]*?)[.]+(/|$)", "$1$2").alias("key"), "at").agg(F.min(F.struct("action", "reason")).alias("e"))
    following = F.lead("at").over(Window.partitionBy("key").orderBy("at"))
    return daily.select("key", F.col("e.reason").alias("reason"), F.col("e.action").alias("action"), F.col("at").alias("valid_from"), following.alias("valid_to")).where("action = 'add'").drop("action")


def _month(day: str) -> F.Column:
    return F.expr(f"year({day}) * 12 + month({day})")


def _keys() -> F.Column:
    """Host, parent domains, path prefixes and whole path of a capture."""
    return F.expr(
        """array_distinct(concat(
            transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.')),
            transform(filter(sequence(1, length(path) + 1), i -> i > 1 AND substring(concat(path, '/'), i, 1) = '/' AND NOT (i > length(path) AND endswith(path, '/'))), i -> concat(host, substring(path, 1, i - 1)))
        ))"""
    )


def judged(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched_at", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns keep, url, host, fetched_at, blocked, matched_key, reason, valid_from, valid_to for every row of captures.

    A null url or day, and a url without scheme and host, is not blocked. Repeated captures stay repeated. Empty tables are
    fine on either side. Only the columns named are read, so others may have any name.
    """
    rows = captures.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col(url).alias("url"), F.col(fetched).alias("fetched_at"))
    latest = captures.agg(F.max(fetched)).first()[0]
    listed = intervals(events).where(F.col("valid_from") <= F.lit(latest))
    until = F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(latest)), F.lit(latest))
    months = F.sequence(_month("valid_from"), _month("until"))
    listed = written(listed.withColumn("until", until).withColumn("month", F.explode(months)), "entries")
    keys = listed.select("key").distinct()
    asked = rows.select("url", "fetched_at").where("url IS NOT NULL AND fetched_at IS NOT NULL").distinct()
    asked = asked.withColumn("host", host_of("url")).withColumn("path", F.lower(F.regexp_extract("url", PATH, 1))).where("host <> ''")
    offered = asked.select("url", "fetched_at", F.explode(_keys()).alias("key"))
    # a domain above a third of all captures is rarely listed: what no entry has goes before anything is shuffled by key
    sieved = offered.join(F.broadcast(keys), "key", "left_semi") if keys.count() <= BROADCAST_KEYS else offered
    sieved = sieved.withColumn("month", _month("fetched_at")).withColumn("part", F.pmod(F.xxhash64("url", "fetched_at"), F.lit(PARTS)).cast("int"))
    in_parts = listed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    active = sieved.join(in_parts, ["key", "month", "part"]).where("valid_from <= fetched_at AND fetched_at <= until")
    decided = active.groupBy("url", "fetched_at").agg(F.max(F.struct(F.length("key").alias("n"), "key", "reason", "valid_from", "valid_to")).alias("d"))
    out = rows.join(decided.withColumnRenamed("url", "_url").withColumnRenamed("fetched_at", "_at"), (F.col("url") == F.col("_url")) & (F.col("fetched_at") == F.col("_at")), "left")
    return out.select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "url", host_of("url").alias("host"), "fetched_at", F.col("d").isNotNull().alias("blocked"), F.col("d.key").alias("matched_key"), F.col("d.reason").alias("reason"), F.col("d.valid_from").alias("valid_from"), F.col("d.valid_to").alias("valid_to")
    )


def list_events(pages: DataFrame) -> DataFrame:
    """A dated list for the test tables: three tenths of all hosts, sites by their first folder, and one domain, all by the MD5 of their names."""
    host = pages.select(host_of("url").alias("host"), F.regexp_extract(F.regexp_extract("url", PATH, 1), "^/[^/]*", 0).alias("folder"))
    hosts = host.select(F.col("host").alias("key")).where("host <> ''").distinct()
    folders = host.where("host <> '' AND folder <> ''").select(F.concat("host", "folder").alias("key")).distinct()
    keys = hosts.select("key", F.lit("host").alias("reason")).union(folders.select("key", F.lit("folder")))
    number = lambda at, n: F.conv(F.substring(F.md5("key"), at, n), 16, 10).cast("int")
    dated = keys.select("key", "reason", (number(1, 4) % 10).alias("m"), (number(5, 4) % 300).alias("d"), (number(9, 4) % 90 + 1).alias("span")).where("m < 3 AND (reason = 'host' OR d < 100)")
    start = F.lit("2024-01-01").cast("date")
    added = dated.select("key", F.lit("add").alias("action"), F.date_add(start, F.col("d")).alias("at"), "reason")
    removed = dated.where("m < 2").select("key", F.lit("remove"), F.date_add(start, F.col("d") + F.col("span")), "reason")
    again = dated.where("m = 0").select("key", F.lit("add"), F.date_add(start, F.col("d") + 120), F.concat("reason", F.lit(" again")))
    domain = pages.sparkSession.range(1).select(F.lit("example.org").alias("key"), F.lit("add"), F.date_add(start, 340), F.lit("domain"))
    return added.union(removed).union(again).union(domain)


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id % 366 AS int))").alias("fetched_at"))
    return judged(pages, list_events(pages), keep=("page_id",))


OP4_SQL = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched_at,
         rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '.') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
names AS (
  SELECT DISTINCT host AS key, 'host' AS reason FROM captures WHERE host <> ''
  UNION ALL
  SELECT DISTINCT host || regexp_extract(path, '^/[^/]*') AS key, 'folder' FROM captures WHERE host <> '' AND regexp_extract(path, '^/[^/]*') <> ''),
dated AS (
  SELECT * FROM (
    SELECT key, reason, CAST('0x' || substr(md5(key), 1, 4) AS INTEGER) % 10 AS m, CAST('0x' || substr(md5(key), 5, 4) AS INTEGER) % 300 AS d,
           CAST('0x' || substr(md5(key), 9, 4) AS INTEGER) % 90 + 1 AS span FROM names)
  WHERE m < 3 AND (reason = 'host' OR d < 100)),
events AS (
  SELECT key, 'add' AS action, DATE '2024-01-01' + d AS day, reason FROM dated
  UNION ALL SELECT key, 'remove', DATE '2024-01-01' + d + span, reason FROM dated WHERE m < 2
  UNION ALL SELECT key, 'add', DATE '2024-01-01' + d + 120, reason || ' again' FROM dated WHERE m = 0
  UNION ALL SELECT 'example.org', 'add', DATE '2024-01-01' + 340, 'domain'),
daily AS (
  SELECT rtrim(lower(key), '/') AS key, day, min(action) AS action, min(reason) FILTER (WHERE action = 'add') AS reason FROM events GROUP BY ALL),
valid AS (
  SELECT * FROM (SELECT key, action, reason, day AS valid_from, lead(day) OVER (PARTITION BY key ORDER BY day) AS valid_to FROM daily) WHERE action = 'add'),
hits AS (
  SELECT c.page_id, v.*, row_number() OVER (PARTITION BY c.page_id ORDER BY length(v.key) DESC, v.key DESC) AS r
  FROM captures c JOIN valid v ON (c.host = v.key OR ends_with(c.host, '.' || v.key) OR contains(v.key, '/') AND starts_with(lower(c.host || c.path) || '/', v.key || '/'))
   AND v.valid_from <= c.fetched_at AND (v.valid_to IS NULL OR c.fetched_at < v.valid_to))
SELECT c.page_id, c.url, c.host, c.fetched_at, h.key IS NOT NULL AS blocked, h.key AS matched_key, h.reason, h.valid_from, h.valid_to
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.r = 1
"""
