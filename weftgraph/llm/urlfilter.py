"""URL filters by a temporal list join (operator 8).

A list is a log of dated entries: on a day, a pattern is added to or removed
from a named list. Each pattern's log becomes validity intervals, from the day
it is added up to the day it is removed. A pattern is a domain, which covers its
subdomains, or a host with leading path segments. The as-of join evaluates every
capture against the entries that were active when it was fetched: a capture's
patterns meet the intervals by pattern and month, and the interval must hold the
fetch time. Only months in which anything was captured count, so a date that lies far
off makes no rows but its own. A month of one pattern is small even if the pattern is in very many
captures, and a skewed join splits those.

Cases: a null or unusable URL has no pattern and is not blocked; a null fetch
time meets no interval; rows equal in id, URL and fetch time give one row;
entries with a null are left out; several entries of one pattern, list and day
count as its removal if one of them is; adding what is listed or removing what
isn't changes nothing; extra columns are not read; empty captures give no rows,
empty lists block nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.sources.tables import table

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case, without port and closing dot; '' if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", "")


def patterns_of(url: Column) -> Column:
    """All patterns that cover a URL: its domains of two labels or more, and its host with each leading path."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    steps = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")
    paths = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), lambda k: F.concat_ws("/", host, F.array_join(F.slice(steps, 1, k), "/")))
    paths = F.when(F.size(steps) > 0, paths).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(host) > 0, F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, active_from, active_to (null: still active) from the log list, pattern, action, day."""
    log = entries.select("list", "pattern", "action", F.col("day").cast("date").alias("day")).dropna()
    # One state per day, then only the days on which the state changes.
    log = log.groupBy("list", "pattern", "day").agg(F.min(F.col("action") == "add").alias("on"))
    order = Window.partitionBy("list", "pattern").orderBy("day")
    log = log.withColumn("before", F.lag("on", 1, False).over(order)).where(F.col("on") != F.col("before"))
    return log.withColumn("active_to", F.lead("day").over(order)).where("on").select("list", "pattern", F.col("day").alias("active_from"), "active_to")


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def evaluate(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url, fetched_at, blocked, lists (sorted), n_entries, newest_entry of each capture."""
    given = captures.select(key, "url", "fetched_at")
    # An interval stands under each month of its days in which anything was captured; there are 12 for each year at most.
    months = F.lit(given.agg(F.sort_array(F.collect_set(_month(F.col("fetched_at"))))).first()[0]).cast("array<int>")
    first, last = _month(F.col("active_from")), _month(F.date_sub("active_to", 1))
    spans = intervals(entries).withColumn("month", F.explode(F.filter(months, lambda m: (m >= first) & (last.isNull() | (m <= last)))))
    asked = given.withColumn("month", _month(F.col("fetched_at"))).withColumn("pattern", F.explode_outer(patterns_of(F.col("url"))))
    holds = (
        (asked["pattern"] == spans["pattern"]) & (asked["month"] == spans["month"])
        & (F.col("fetched_at") >= F.col("active_from").cast("timestamp")) & (F.col("active_to").isNull() | (F.col("fetched_at") < F.col("active_to").cast("timestamp")))
    )
    met = asked.join(spans, holds, "left").withColumn("entry", F.when(F.col("list").isNotNull(), F.struct("list", asked["pattern"])))
    hits = met.groupBy(key, "url", "fetched_at").agg(F.collect_set("entry").alias("hits"), F.max("active_from").alias("newest_entry"))
    names = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["list"])))
    return hits.select(
        key, "url", "fetched_at", (F.size("hits") > 0).alias("blocked"), F.array_join(names, ",").alias("lists"), F.size("hits").cast("bigint").alias("n_entries"), "newest_entry"
    )


# The tables have no lists and no fetch times: both are made from the pages by a fixed rule.

_HEX = lambda a, n: f"cast(conv(substring(digest, {a}, {n}), 16, 10) as int)"
_START = "DATE '2024-01-01'"


def captures_of(pages: DataFrame) -> DataFrame:
    """Every page with a fetch time in 2024 and 2025 that its id gives."""
    fetched = F.expr("timestampadd(SECOND, cast(page_id * 7919 % 86400 as int), timestampadd(DAY, cast(page_id * 37 % 730 as int), TIMESTAMP '2024-01-01 00:00:00'))")
    return pages.select("page_id", "url", fetched.alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A log over a quarter of the patterns of the pages: added, removed and for half of them added again."""
    listed = pages.select(F.explode(patterns_of(F.col("url"))).alias("pattern")).distinct().withColumn("digest", F.md5("pattern")).where("substring(digest, 1, 1) < '4'")
    log = f"""stack(3,
        'add', date_add({_START}, cast({_HEX(3, 2)} as int)),
        'remove', date_add({_START}, cast({_HEX(3, 2)} + {_HEX(5, 2)} + 1 as int)),
        if(substring(digest, 7, 1) < '8', 'add', null), date_add({_START}, cast({_HEX(3, 2)} + {_HEX(5, 2)} + 31 as int))) as (action, day)"""
    return listed.selectExpr("element_at(array('ads', 'adult', 'malware', 'phishing'), cast(pmod(" + _HEX(2, 1) + ", 4) + 1 as int)) as list", "pattern", log)


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of the table against the entries active at its fetch time."""
    pages = table(spark, sf_dir, "pages")
    return evaluate(captures_of(pages), entries_of(pages)).withColumns({c: F.col(c).cast("string") for c in ("fetched_at", "newest_entry")})


_DUCK_HEX = lambda a, n: f"CAST('0x' || substr(digest, {a}, {n}) AS INTEGER)"
ORACLE = f"""
WITH parsed AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(page_id * 37 % 730 AS INTEGER)) + to_seconds(page_id * 7919 % 86400) AS fetched_at,
    regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '\\.$', '') AS host,
    list_filter(string_split(regexp_extract(url, '{_PATH}', 1), '/'), lambda s: s <> '') AS steps
  FROM pages
), patterned AS (
  SELECT page_id, url, fetched_at, unnest(list_distinct(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda k: array_to_string(string_split(host, '.')[k:], '.')),
    list_transform(range(1, len(steps) + 1), lambda k: host || '/' || array_to_string(steps[1:k], '/'))))) AS pattern
  FROM parsed WHERE length(host) > 0
), listed AS (
  SELECT DISTINCT pattern, md5(pattern) AS digest FROM patterned WHERE substr(md5(pattern), 1, 1) < '4'
), spans AS (
  SELECT pattern, ['ads', 'adult', 'malware', 'phishing'][{_DUCK_HEX(2, 1)} % 4 + 1] AS list,
    CAST({_START} + {_DUCK_HEX(3, 2)} AS DATE) AS active_from, CAST({_START} + {_DUCK_HEX(3, 2)} + {_DUCK_HEX(5, 2)} + 1 AS DATE) AS active_to FROM listed
  UNION ALL
  SELECT pattern, ['ads', 'adult', 'malware', 'phishing'][{_DUCK_HEX(2, 1)} % 4 + 1],
    CAST({_START} + {_DUCK_HEX(3, 2)} + {_DUCK_HEX(5, 2)} + 31 AS DATE), NULL FROM listed WHERE substr(digest, 7, 1) < '8'
), met AS (
  SELECT p.page_id, s.list, s.active_from FROM patterned p JOIN spans s
  ON p.pattern = s.pattern AND p.fetched_at >= s.active_from AND (s.active_to IS NULL OR p.fetched_at < s.active_to)
)
SELECT p.page_id, p.url, strftime(p.fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, count(m.list) > 0 AS blocked,
  coalesce(string_agg(DISTINCT m.list, ',' ORDER BY m.list), '') AS lists, count(m.list) AS n_entries, CAST(max(m.active_from) AS VARCHAR) AS newest_entry
FROM parsed p LEFT JOIN met m ON p.page_id = m.page_id GROUP BY ALL
"""
