"""Sources: landed documents, HTML pages, dictionary lines, node-link graphs, cached fetches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import paragraphs, strip, without_query
from ..model import CHAPTERS, NODE_LINK
from ..storage import table  # noqa: F401  (part of the sources)


def chapters(spark: SparkSession, path: str) -> DataFrame:
    """(ord, title, text) of landed chapter responses {title, fulltext[]}, in the order of ord."""
    raw = spark.read.schema(CHAPTERS).json(path)
    return raw.select("ord", "urn", F.coalesce("title", F.lit("")).alias("title"), paragraphs(F.col("fulltext")).alias("text")).orderBy("ord")


def _tag(html: Column, name: str) -> Column:
    return F.regexp_extract(html, f"(?is)<{name}[^>]*>(.*?)</{name}>", 1)


def html_title(html: Column) -> Column:
    """<title>, else <h1>, else UNTITLED."""
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(_tag(html, "title")), some(_tag(html, "h1")), F.lit("UNTITLED"))


def html_section(html: Column, selector: str) -> Column:
    """Inner HTML of the first element of a tag name, or of an id given as #id; empty if there is none."""
    if selector.startswith("#"):
        return F.coalesce(F.regexp_extract(html, f'(?is)<(\\w+)[^>]*id="{selector[1:]}"[^>]*>(.*?)</\\1>', 2), F.lit(""))
    return F.coalesce(_tag(html, selector), F.lit(""))


def articles(pages: DataFrame, sections: list[str]) -> DataFrame:
    """(url, title, text, description) of pages(url, html); absent sections are empty."""
    h = F.col("html")
    text = F.concat(*(html_section(h, s) for s in sections))
    described = _tag(h, "description")
    first = html_section(h, sections[0])
    return pages.select("url", html_title(h).alias("title"), text.alias("text"), F.when(described != "", described).otherwise(F.substring(first, 1, 160)).alias("description"))


def result_links(html: Column, css_class: str = "result_url") -> Column:
    """Texts of all div elements of a class, stripped, in document order."""
    found = F.regexp_extract_all(html, F.lit(f'(?s)<div[^>]*class="{css_class}"[^>]*>(.*?)</div>'), F.lit(1))
    return F.transform(found, strip)


def anchors(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))


def top_hits(hits: DataFrame, k: int | None) -> DataFrame:
    """The first k of each term by rank; none or 0 means all. The limit comes before any fetch."""
    if not k:
        return hits
    return hits.withColumn("_n", F.row_number().over(W.partitionBy("term").orderBy("rank"))).where(F.col("_n") <= k).drop("_n")


def term_search(docs: DataFrame, terms: DataFrame, k: int | None) -> DataFrame:
    """(term, doc_id, rank, hits): documents by how often their text holds the term as a word."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term")
    n = docs.select("doc_id", word).join(terms.select("term").distinct(), "term").groupBy("term", "doc_id").agg(F.count("*").alias("hits"))
    ranked = n.withColumn("rank", F.row_number().over(W.partitionBy("term").orderBy(F.desc("hits"), "doc_id")))
    return top_hits(ranked, k)


def _newest(cache: DataFrame, name: str) -> DataFrame:
    return cache.groupBy("key").agg(F.max_by("body", F.struct("fetched_at", "body")).alias(name))


def fresh(cache: DataFrame, days: int = 7, now: Column | None = None) -> DataFrame:
    """The newest body of each key fetched within days of now, from cache(key, fetched_at, body);
    of equally new ones the greatest."""
    now = F.current_timestamp() if now is None else now
    return _newest(cache.where(F.col("fetched_at") >= now - F.expr(f"interval {days} days")), "body")


def cached_or_fetched(keys: DataFrame, cache: DataFrame, fetched: DataFrame, days: int = 7, now: Column | None = None) -> DataFrame:
    """Fresh cache, else what was fetched, else the stale cache."""
    out = keys.join(fresh(cache, days, now), "key", "left").join(fetched.withColumnRenamed("body", "new"), "key", "left").join(_newest(cache, "stale"), "key", "left")
    return out.select("key", F.coalesce("body", "new", "stale").alias("body"))


def url_metadata(urls: DataFrame, cache: DataFrame, fetched: DataFrame, days: int = 7, now: Column | None = None) -> DataFrame:
    """(url, body) of urls(url): looked up without their query; what isn't a URL is an error."""
    key = F.when(F.try_parse_url("url", F.lit("PROTOCOL")).isNotNull(), without_query(F.col("url"))).otherwise(F.raise_error(F.concat(F.lit("not a URL: "), "url")).cast("string"))
    keyed = urls.withColumn("key", key)
    return keyed.join(cached_or_fetched(keyed.select("key").distinct(), cache, fetched, days, now), "key").select("url", "body")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, md5) of binary files, such as images."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", F.md5("content").alias("md5"))


def dictionary_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of one dictionary file, which is small; numbers follow the file."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line_no", "value"))


def node_links(spark: SparkSession, path: str, edges_key: str = "edges") -> DataFrame:
    """Validated node-link documents; a missing field, wrong type or null id is an error. edges_key
    may be the older name links. Numeric ids become strings."""
    schema = NODE_LINK.replace("edges array", f"{edges_key} array")
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumnRenamed(edges_key, "edges")
    present = F.lit(True)
    for c in ("directed", "multigraph", "graph", "nodes", "edges"):
        present &= F.col(c).isNotNull()
    whole = F.forall("nodes", lambda n: n["id"].isNotNull()) & F.forall("edges", lambda e: e["source"].isNotNull() & e["target"].isNotNull() & e["weight"].isNotNull())
    bad = F.raise_error(F.lit("not a node-link graph"))
    return raw.withColumn("directed", F.when(present & whole, F.col("directed")).otherwise(bad.cast("boolean"))).withColumn("path", F.input_file_name())
