"""URL filtering against dated lists by a temporal join.

A list is a log of dated entries: an ``add`` opens a validity interval for a
pattern and the next entry for the same pattern closes it.  Every capture is
evaluated against the entries active at its fetch time.  Only DataFrame
functions are used.

Patterns (``kind``): ``domain`` (the host or any parent domain), ``host`` (this
host only), ``path`` (host plus a path prefix made of whole segments).  Of the
active matches the longest pattern decides; at equal length ``block`` wins over
``allow``, then the smallest pattern and kind.

Defined results: a null or unparsable URL has a null host and verdict ``none``;
a null fetch time matches nothing; entries with a null pattern, kind or day are
ignored; two entries for one pattern and list on one day count as the last by
action (``remove`` after ``add``); repeated entries count once; captures of one
key are judged each at its own time and with its own URL, equal ones alike; extra
columns of captures are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Days since the start of the log.
FOREVER = 2_147_483_647


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    host = F.regexp_replace(F.lower(bare), r"\.+$", "")
    return F.when(F.length(host) > 0, host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def match_keys(host: Column, path: Column) -> Column:
    """All keys under which an entry can match: parent domains, the host, path prefixes."""
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("domain|"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    segments = F.filter(F.split(path, "/"), lambda s: F.length(s) > 0)
    paths = F.when(
        F.size(segments) > 0,
        F.transform(
            F.sequence(F.lit(1), F.size(segments)),
            lambda i: F.concat(F.lit("path|"), host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(domains, F.array(F.concat(F.lit("host|"), host)), paths))


def validity(entries: DataFrame) -> DataFrame:
    """entries(kind, pattern, list, action, day) as intervals [valid_from, valid_to)."""
    clean = entries.select("kind", F.lower("pattern").alias("pattern"), "list", "action", F.col("day").cast("int").alias("day"))
    clean = clean.dropna(subset=["kind", "pattern", "day", "action"]).dropDuplicates()
    # one event a day and pattern: "remove" sorts after "add"
    daily = clean.groupBy("kind", "pattern", "list", "day").agg(F.max("action").alias("action"))
    w = Window.partitionBy("kind", "pattern", "list").orderBy("day")
    return (
        daily.withColumn("valid_to", F.coalesce(F.lead("day").over(w), F.lit(FOREVER)))
        .filter("action = 'add'")
        .select(F.concat_ws("|", "kind", "pattern").alias("key"), "list", F.col("day").alias("valid_from"), "valid_to", F.length("pattern").alias("specificity"))
    )


def filter_urls(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", day: str = "fetched_day") -> DataFrame:
    """One row per capture: verdict at its fetch time and the entries behind it.

    The join is an equi-join on the pattern key with the interval as residual
    condition.  Parent domains are hot keys; both sides of the join come from
    plain exchanges, so adaptive execution splits a hot key's captures over
    tasks and repeats only its few intervals.
    """
    base = captures.select(F.col(key).alias("__id"), F.col(url).alias("__url"), F.col(day).cast("int").alias("__day"))
    base = base.withColumn("__host", host_of(F.col("__url")))
    # captures that repeat key, URL and time get the same votes; one of them is enough
    keyed = base.distinct().filter(F.col("__host").isNotNull() & F.col("__day").isNotNull()).select(
        "__id", "__url", "__day", F.explode(match_keys(F.col("__host"), path_of(F.col("__url")))).alias("key")
    )

    spans = validity(entries)
    hits = keyed.join(spans, "key").select(
        "__id", "__url", "__day", "key", "list", "specificity", ((F.col("valid_from") <= F.col("__day")) & (F.col("__day") < F.col("valid_to"))).alias("active")
    )
    best = F.struct(F.col("specificity"), F.when(F.col("list") == "block", 1).otherwise(0).alias("blocks"))
    votes = hits.groupBy("__id", "__url", "__day").agg(
        F.count("*").cast("long").alias("n_listed"),
        F.count_if("active").cast("long").alias("n_active"),
        F.max(F.when(F.col("active"), best)).alias("best"),
        F.min(F.when(F.col("active"), F.struct(-F.col("specificity"), F.when(F.col("list") == "block", 0).otherwise(1), F.col("key").alias("key")))).alias("first"),
    )
    votes = votes.select(F.col("__id").alias("__i"), F.col("__url").alias("__u"), F.col("__day").alias("__d"), "n_listed", "n_active", "best", "first")
    same = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__url") == F.col("__u")) & (F.col("__day") == F.col("__d"))
    return base.join(votes, same, "left").select(
        F.col("__id").alias(key),
        F.col("__host").alias("host"),
        F.col("__day").alias(day),
        F.coalesce("n_listed", F.lit(0)).cast("long").alias("n_listed"),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.when(F.col("best").isNull(), "none").when(F.col("best.blocks") == 1, "block").otherwise("allow").alias("verdict"),
        F.col("first.key").alias("decided_by"),
    )


def _digest(col: Column, start: int) -> Column:
    return F.conv(F.substring(F.md5(col), start, 6), 16, 10).cast("long")


def fetched_day(page_id: Column) -> Column:
    """The synthetic pages carry no fetch time; this rule deals days 0 to 729."""
    return ((page_id * 37) % 730).cast("int")


def dated_list(pages: DataFrame) -> DataFrame:
    """A list log as large as the crawl: every third host is blocked on some day,
    most are delisted later and listed again; every seventh has an allowed section;
    one whole domain is blocked for a year."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host is not null").distinct()
    h = hosts.select("host", _digest(F.col("host"), 1).alias("a"), _digest(F.col("host"), 7).alias("b"))
    third, seventh = h.filter("a % 3 = 0"), h.filter("a % 7 = 0")
    event = lambda df, kind, pattern, name, action, day: df.selectExpr(f"'{kind}' as kind", f"{pattern} as pattern", f"'{name}' as list", f"'{action}' as action", f"cast({day} as int) as day")
    log = event(third, "host", "host", "block", "add", "b % 400")
    log = log.unionByName(event(third.filter("a % 2 = 0"), "host", "host", "block", "remove", "b % 400 + 60"))
    log = log.unionByName(event(third.filter("a % 2 = 0"), "host", "host", "block", "add", "b % 400 + 200"))
    log = log.unionByName(event(seventh, "path", "concat(host, '/en')", "allow", "add", "b % 300"))
    one = pages.sparkSession.createDataFrame([("domain", "example.org", "block", "add", 100), ("domain", "example.org", "block", "remove", 465)], "kind string, pattern string, list string, action string, day int")
    return log.unionByName(one)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", fetched_day(F.col("page_id")).alias("fetched_day"))
    return filter_urls(captures, dated_list(pages))


SQL = r"""
WITH base AS (
  SELECT page_id, url, CAST((page_id * 37) % 730 AS INT) AS fetched_day,
    nullif(regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '\.+$', ''), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
h AS (SELECT host, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS a, CAST('0x' || substr(md5(host), 7, 6) AS BIGINT) AS b
      FROM (SELECT DISTINCT host FROM base WHERE host IS NOT NULL)),
log AS (
  SELECT 'host' AS kind, host AS pattern, 'block' AS list, 'add' AS action, b % 400 AS day FROM h WHERE a % 3 = 0
  UNION ALL SELECT 'host', host, 'block', 'remove', b % 400 + 60 FROM h WHERE a % 6 = 0
  UNION ALL SELECT 'host', host, 'block', 'add', b % 400 + 200 FROM h WHERE a % 6 = 0
  UNION ALL SELECT 'path', host || '/en', 'allow', 'add', b % 300 FROM h WHERE a % 7 = 0
  UNION ALL VALUES ('domain', 'example.org', 'block', 'add', 100), ('domain', 'example.org', 'block', 'remove', 465)),
daily AS (SELECT kind, pattern, list, day, max(action) AS action FROM log GROUP BY ALL),
spans AS (SELECT *, coalesce(lead(day) OVER (PARTITION BY kind, pattern, list ORDER BY day), 2147483647) AS valid_to FROM daily),
act AS (SELECT kind, pattern, list, day AS valid_from, valid_to FROM spans WHERE action = 'add'),
hits AS (
  SELECT p.page_id, a.kind || '|' || a.pattern AS key, a.list, length(a.pattern) AS spec, (a.valid_from <= p.fetched_day AND p.fetched_day < a.valid_to) AS active
  FROM base p JOIN act a ON (a.kind = 'host' AND a.pattern = p.host)
    OR (a.kind = 'domain' AND (p.host = a.pattern OR ends_with(p.host, '.' || a.pattern)))
    OR (a.kind = 'path' AND starts_with(p.host || regexp_replace(p.path, '/+', '/', 'g') || '/', a.pattern || '/'))),
votes AS (
  SELECT page_id, count(*) AS n_listed, count(*) FILTER (WHERE active) AS n_active,
    max(spec * 10 + CASE WHEN list = 'block' THEN 1 ELSE 0 END) FILTER (WHERE active) AS best
  FROM hits GROUP BY page_id),
first AS (SELECT page_id, key FROM (SELECT page_id, key, row_number() OVER (PARTITION BY page_id ORDER BY spec DESC, CASE WHEN list = 'block' THEN 0 ELSE 1 END, key) AS r FROM hits WHERE active) WHERE r = 1)
SELECT b.page_id, b.host, b.fetched_day, coalesce(v.n_listed, 0) AS n_listed, coalesce(v.n_active, 0) AS n_active,
  CASE WHEN v.best IS NULL THEN 'none' WHEN v.best % 10 = 1 THEN 'block' ELSE 'allow' END AS verdict, f.key AS decided_by
FROM base b LEFT JOIN votes v USING (page_id) LEFT JOIN first f USING (page_id)
"""
