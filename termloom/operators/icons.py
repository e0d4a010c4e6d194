"""Look-ups of URLs in a table whose key is a host, or a protocol where an entry has no host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import url_host


def url_key(url: Column) -> Column:
    """Host of a URL; without one its scheme with the colon, such as mailto:. Null for no URL."""
    scheme = F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    return F.coalesce(url_host(url), F.when(scheme != "", F.lower(scheme)))


def keyed(entries: DataFrame) -> DataFrame:
    """(key, name) of entries(name, url); a URL that is none, or a key that occurs twice, is an error."""
    bad = lambda *names: F.raise_error(F.concat(F.lit("bad or duplicate URL in entries: "), *names)).cast("string")
    k = entries.select("name", F.coalesce(url_key(F.col("url")), bad(F.col("name"))).alias("key"))
    k = k.groupBy("key").agg(F.min("name").alias("name"), F.max("name").alias("last"), F.count("*").alias("n"))
    return k.select("key", F.when(F.col("n") == 1, F.col("name")).otherwise(bad(F.col("name"), F.lit(", "), F.col("last"))).alias("name"))


def matched(rows: DataFrame, url: str, entries: DataFrame) -> DataFrame:
    """rows with the column icon: the entry of the URL's host, else of its scheme, else null."""
    k = keyed(entries)
    scheme = F.lower(F.regexp_extract(F.col(url), "^([A-Za-z][A-Za-z0-9+.-]*:)", 1))
    r = rows.withColumns({"_host": url_host(F.col(url)), "_scheme": scheme})
    r = r.join(k.select(F.col("key").alias("_host"), F.col("name").alias("_by_host")), "_host", "left")
    r = r.join(k.select(F.col("key").alias("_scheme"), F.col("name").alias("_by_scheme")), "_scheme", "left")
    return r.select(*rows.columns, F.coalesce("_by_host", "_by_scheme").alias("icon"))
