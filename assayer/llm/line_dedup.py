"""Site-relative line dedup: a line that stands on too large a share of a host's pages is boilerplate there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import free_names, stored, table

RATIO, MIN_PAGES = 0.05, 5
#: Pages whose lines are frequent ones to this share are near copies of each other, and not boilerplate.
COPIED = 0.8


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """(host, line keys) of the hosts that have boilerplate lines.

    A line counts once a page; a key is the line's MD5 digest. Of a host with P pages and L distinct lines a page on
    average, at most L / ratio lines can exceed the ratio, which bounds the array. Blank lines are never boilerplate.
    Without `copies`, equal texts of a host are one page, and of pages that consist of frequent lines to the share COPIED,
    those with the same least line of these are one: so groups of copies and of near copies don't make their own lines boilerplate.
    """
    keys = F.transform(F.filter(F.array_distinct(_lines(F.col(text))), lambda x: F.trim(x) != ""), _key)
    pages = docs.select(F.col(host).alias("host"), keys.alias("keys"), _key(F.col(text)).alias("page"))
    if not copies:
        pages = stored(pages.groupBy("host", "page").agg(F.first("keys").alias("keys")))
        often = stored(_frequent(pages, ratio, min_pages).withColumnsRenamed({"host": "by", "keys": "often"}))
        met = F.array_intersect("keys", F.coalesce("often", F.array().cast("array<binary>")))
        told = pages.join(often, pages["host"].eqNullSafe(often["by"]), "left").select("host", "keys", "page", met.alias("met"))
        near = (F.size("met") > 0) & (F.size("met") >= COPIED * F.size("keys"))
        told = stored(told.select("host", "keys", F.when(near, F.array_min("met")).otherwise(F.col("page")).alias("group"), near.alias("near")))
        pages = told.filter("near").groupBy("host", "group").agg(F.first("keys").alias("keys")).select("host", "keys").unionByName(told.filter("NOT coalesce(near, false)").select("host", "keys"))
    return _frequent(pages, ratio, min_pages)


def _frequent(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(host, keys) of the lines that over `ratio` of a host's pages and `min_pages` at least have."""
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = pages.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    over = seen.join(totals, seen["host"].eqNullSafe(totals["host"])).filter(F.col("n") > ratio * F.col("pages"))
    return over.groupBy(seen["host"].alias("host")).agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """docs with boilerplate lines cut from the text, and n_lines and n_dropped (long) behind.

    Lines are split at \\n and compared exactly. A line goes where over `ratio` of its host's rows, and `min_pages` at
    least, hold it; without `copies`, of its host's texts, where copies and near copies are one. Null hosts are one host; a null text stays null with no lines; an empty text has one blank line; rows
    stay one for one, repeated rows and unknown columns too; columns called n_lines or n_dropped are replaced.
    """
    by, keys, kept = free_names(docs, "host_", "keys_", "kept_")
    found = stored(boilerplate(docs, host, text, ratio, min_pages, copies)).select(F.col("host").alias(by), F.col("keys").alias(keys))
    lines = _lines(F.col(text))
    left = F.when(F.col(keys).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(keys), _key(x))))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.join(found, docs[host].eqNullSafe(found[by]), "left").withColumn(kept, left)
    n = F.coalesce(F.size(F.when(F.col(text).isNotNull(), lines)), F.lit(0)).cast("long")
    n_lines = F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(n)
    dropped = F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(n - F.size(kept).cast("long"))
    return joined.select(*[(F.array_join(kept, "\n").alias(text) if c == text else docs[c]) for c in names], n_lines.alias("n_lines"), dropped.alias("n_dropped"))


def op3(spark, sf_dir):
    return drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_lines", "n_dropped", "text")


SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos
  FROM documents),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
seen AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM l WHERE trim(line, ' ') <> '' GROUP BY source, line),
bad AS (
  SELECT s.source, s.line FROM seen s JOIN totals t ON s.source IS NOT DISTINCT FROM t.source
  WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages),
marked AS (SELECT l.*, bad.line IS NOT NULL AS gone FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND l.line = bad.line)
SELECT d.doc_id, any_value(d.source) AS source, count(m.line) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(m.line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') END AS text
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""
