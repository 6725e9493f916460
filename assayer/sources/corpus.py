"""Documents from corpus files and from the responses of encyclopaedia and preprint services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "trust map<string, double>, docs array<struct<locator: string, added: string, text: string>>"
WIKI = "query struct<pages: array<struct<title: string, extract: string, touched: string>>>"
ENTRY = "id string, title string, summary string, published string"
SLUG, LONGEST_SLUG, MOST_RESULTS = "[^A-Za-z0-9._~%()-]", 120, 20
PREPRINTS = "arxiv.org/abs/"


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(docs, trust) of a corpus file: docs (doc, locator, text, added) with doc counting from 0, trust (host, trust).

    Days are midnight UTC, other ISO times and numbers of seconds are taken as they are; what can't be read is 0.
    """
    whole = spark.read.schema(CORPUS).json(path, multiLine=True)
    docs = whole.select(F.posexplode("docs").alias("doc", "d"))
    day = F.try_to_timestamp("d.added")
    added = F.coalesce((F.unix_micros(day) / 1e6), F.col("d.added").try_cast("double"), F.lit(0.0))
    return docs.select("doc", "d.locator", "d.text", added.alias("added")), whole.select(F.explode("trust").alias("host", "trust"))


def _clamped(limit: Column | int) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(limit) if isinstance(limit, int) else limit, F.lit(MOST_RESULTS))).cast("string")


def search_url(host: str, query: Column, limit: Column | int) -> Column:
    """The address of a preprint search; 1 to 20 results."""
    return F.concat(F.lit(f"https://{host}/api/query?search_query=all:"), F.url_encode(query), F.lit("&start=0&max_results="), _clamped(limit), F.lit("&sortBy=relevance"))


def wiki_search_url(host: str, query: Column, limit: Column | int) -> Column:
    """The address that asks a wiki for the openings of pages about the query; 1 to 20 results."""
    fields = "&prop=extracts%7Cinfo&exintro=1&explaintext=1&exlimit=max&format=json&formatversion=2"
    return F.concat(F.lit(f"https://{host}/w/api.php?action=query&generator=search&gsrsearch="), F.url_encode(query), F.lit("&gsrlimit="), _clamped(limit), F.lit(fields))


def _seconds(iso: Column) -> Column:
    return F.coalesce(F.unix_micros(F.try_to_timestamp(iso)) / 1e6, F.lit(0.0))


def parse_wiki(responses: DataFrame, host: Column | str, body: str = "body") -> DataFrame:
    """(locator, text, added) of the pages in JSON responses; pages without a title or an extract are left out."""
    pages = responses.select((F.lit(host) if isinstance(host, str) else host).alias("h"), F.explode(F.from_json(body, WIKI)["query"]["pages"]).alias("p"))
    slug = F.substring(F.regexp_replace("p.title", SLUG, "_"), 1, LONGEST_SLUG)
    fine = F.coalesce((F.length(slug) > 0) & (F.trim("p.extract") != ""), F.lit(False))
    return pages.filter(fine).select(F.concat("h", F.lit("/wiki/"), slug).alias("locator"), F.col("p.extract").alias("text"), _seconds(F.col("p.touched")).alias("added"))


def parse_preprints(responses: DataFrame, body: str = "body") -> DataFrame:
    """(locator, text, added) of the entries in Atom responses; a response with a document type is not read at all."""
    safe = responses.filter(~F.col(body).contains("<!DOCTYPE"))
    entries = safe.select(F.explode(F.regexp_extract_all(body, F.lit(r"(?s)<entry\b[^>]*>.*?</entry>"), F.lit(0))).alias("e"))
    read = entries.select(F.from_xml("e", ENTRY).alias("e"))
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    slug = F.regexp_replace(F.substring_index(flat(F.col("e.id")), PREPRINTS, -1), SLUG, "_")
    fine = flat(F.col("e.id")).contains(PREPRINTS) & (flat(F.col("e.summary")) != "")
    return read.filter(fine).select(F.concat(F.lit(PREPRINTS), slug).alias("locator"), F.concat(flat(F.col("e.title")), F.lit(". "), flat(F.col("e.summary"))).alias("text"), _seconds(flat(F.col("e.published"))).alias("added"))
