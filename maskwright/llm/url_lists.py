"""URL lists over time, in SQL expressions only: dated entries as validity intervals.

An entry (list, kind, value, action, dated) adds a value to a list or removes it from
a date on. ``intervals`` makes them half-open intervals [valid_from, valid_to): within
one list, kind and value a date counts once, a removal before an addition of the same
date, and repeated additions extend one interval. ``evaluated`` joins each capture to
the entries active when it was fetched: on equal keys, as of its date.

Kinds: ``host`` is a whole host, ``domain`` a host or any parent domain of it of two
labels or more, ``prefix`` a host with a path cut at a slash, or its whole path.

An entry or capture with a null in its key or date meets nothing; such a capture has
no active entries. A url without a host has none either. Repeated captures (same id,
url and date) give one row. Empty lists or captures give no entries or no rows. Other
columns are not read. A capture has a bounded number of keys, one for each label of
its host and part of its path; a hot host is split by the adaptive skew join, and
counts are aggregated before the second shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def keys_of(host: Column, path: Column) -> Column:
    """array<struct<kind, value>>: every key under which lists may hold a url."""

    def key(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    labels, parts = F.split(host, r"\."), F.split(path, "/")
    several = F.greatest(F.size(labels) - 1, F.lit(1))
    domains = F.transform(F.sequence(F.lit(1), several), lambda i: key("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    cuts = F.sequence(F.lit(1), F.size(parts))
    # every part but the last ends at a slash
    prefixes = F.transform(cuts, lambda i: key("prefix", F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.when(i < F.size(parts), "/").otherwise(""))))
    return F.concat(F.array(key("host", host)), domains, F.array_distinct(prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, value, valid_from, valid_to); valid_to is null while it holds."""
    known = entries.select("list", "kind", "value", "action", "dated").dropna()
    daily = known.groupBy("list", "kind", "value", "dated").agg(F.max("action").alias("action"))
    own = Window.partitionBy("list", "kind", "value").orderBy("dated")
    changes = daily.withColumn("before", F.lag("action").over(own)).filter("before is null or before <> action")
    ended = changes.withColumn("valid_to", F.lead("dated").over(own))
    return ended.filter("action = 'add'").select("list", "kind", "value", F.col("dated").alias("valid_from"), "valid_to")


def evaluated(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at", allow: str = "allow") -> DataFrame:
    """(id, host, fetched_at, n_active, active, blocked) of each capture.

    A capture is blocked if an entry of any list but ``allow`` is active and none of
    ``allow`` is.
    """
    seen = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(at_col).alias("at")).withColumn("host", host_of(F.col("url")))
    keyed = seen.select("id", "url", "at", "host", F.explode_outer(keys_of(F.col("host"), path_of(F.col("url")))).alias("key"))
    keyed = keyed.select("id", "url", "at", "host", "key.kind", "key.value")
    valid = intervals(entries)
    active = (keyed["at"] >= valid["valid_from"]) & (valid["valid_to"].isNull() | (keyed["at"] < valid["valid_to"]))
    met = keyed.join(valid, (keyed["kind"] == valid["kind"]) & (keyed["value"] == valid["value"]) & active, "left")
    entry = F.when(valid["list"].isNotNull(), F.concat_ws(":", valid["list"], keyed["kind"], keyed["value"]))
    rows = met.select("id", "url", "at", "host", valid["list"].alias("list"), entry.alias("entry"))
    per = rows.groupBy("id", "url", "at", "host").agg(F.array_sort(F.collect_set("entry")).alias("entries"), F.coalesce(F.bool_or(F.col("list") == allow), F.lit(False)).alias("allowed"))
    return per.select(
        F.col("id").alias(id_col),
        "host",
        F.col("at").alias(at_col),
        F.size("entries").cast("long").alias("n_active"),
        F.array_join("entries", ",").alias("active"),
        ((F.size("entries") > 0) & ~F.col("allowed")).alias("blocked"),
    )
