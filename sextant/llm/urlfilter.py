"""URL filters by a temporal list join, in DataFrame functions only.

A list is a history of dated entries: from a date on, a domain is on the list ("add") or off it ("remove"). A domain's
entries become validity intervals, cut at month borders; a capture is looked up under its host and every parent domain,
in the month of its fetch, and is rejected if one of them has an interval that holds the fetch date.

Captures are reduced to distinct (host, date) first, so a host with a third of all captures is a few hundred rows in the
join; the verdicts are joined back to the captures, which Spark splits where a host is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.llm.spark_names import Renamed

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\\\[\]]+)"
#: Hosts that have no parents: IPv4 and bracketed IPv6 addresses.
_ADDRESS = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*)$"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case without a last dot, an IPv6 address in its brackets; null where there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", ""), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more, from the longest; an address, or a single label, alone."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return F.when(host.rlike(_ADDRESS), F.array(host)).otherwise(parents)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(domain, valid_from, valid_to): while a domain is on the list; valid_to is exclusive, null for "until now".

    entries: domain, listed_on (date), action ("add" or "remove"). Of one domain and date, "remove" wins. Entries with a
    null in any of the three, or another action, say nothing.
    """
    clean = entries.where("domain IS NOT NULL AND listed_on IS NOT NULL AND action IN ('add', 'remove')")
    daily = clean.groupBy(F.lower("domain").alias("domain"), "listed_on").agg(F.max("action").alias("action"))
    by_day = Window.partitionBy("domain").orderBy("listed_on")
    return daily.withColumn("valid_to", F.lead("listed_on").over(by_day)).where("action = 'add'").select("domain", F.col("listed_on").alias("valid_from"), "valid_to")


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """``captures`` with ``blocked`` and ``blocked_by`` (the longest domain listed on the fetch date) after its columns.

    A capture without a host or fetch date is not blocked. Adjacent intervals count once; the day of an "add" is inside,
    the day of the next entry outside. Empty lists block nothing; clashing columns of captures are replaced.
    """
    own = Renamed(captures, ("blocked", "blocked_by"))
    keyed = own.df.select("*", host_of(own[url]).alias("host"), own[fetched].cast("date").alias("day"))
    wanted = keyed.select(F.col("host").alias("_host"), F.col("day").alias("_on")).where("_host IS NOT NULL AND _on IS NOT NULL").distinct()
    spans = validity_intervals(entries)
    # a bare last label ("com") is a key that most captures share: looked up only if the list holds bare labels at all
    bare = spans.where("domain NOT RLIKE '[.]'").select(F.col("domain").alias("_bare")).distinct()
    own_domains = wanted.withColumn("_domain", F.explode(domains_of(F.col("_host"))))
    last_label = wanted.withColumn("_domain", F.substring_index("_host", ".", -1)).where(F.col("_host").contains(".") & ~F.col("_host").rlike(_ADDRESS))
    asked = own_domains.union(last_label.join(bare, F.col("_domain") == F.col("_bare"), "left_semi")).withColumn("_month", F.trunc("_on", "month"))
    # an open interval is looked up by its own rule, so that months need not be made up to an unknown end
    closed = spans.where("valid_to IS NOT NULL").withColumn("_m", F.explode(F.expr("sequence(trunc(valid_from, 'month'), trunc(date_sub(valid_to, 1), 'month'), interval 1 month)")))
    within = asked.join(closed, (F.col("_domain") == F.col("domain")) & (F.col("_month") == F.col("_m")) & (F.col("_on") >= F.col("valid_from")) & (F.col("_on") < F.col("valid_to")))
    standing = spans.where("valid_to IS NULL").select(F.col("domain").alias("_d"), F.col("valid_from").alias("_since"))
    since = asked.join(standing, (F.col("_domain") == F.col("_d")) & (F.col("_on") >= F.col("_since")))
    hits = within.select("_host", "_on", "_domain").union(since.select("_host", "_on", "_domain"))
    verdicts = hits.groupBy("_host", "_on").agg(F.max(F.struct(F.length("_domain").alias("n"), F.col("_domain").alias("d"))).alias("by"))
    met = keyed.join(verdicts, (F.col("host") == F.col("_host")) & (F.col("day") == F.col("_on")), "left")
    return met.select(*own.back(), F.col("by").isNotNull().alias("blocked"), F.col("by.d").alias("blocked_by"))
