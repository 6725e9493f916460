"""Queries over what the library writes in formats of others and reads back, with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assayer.functions import shared, strict_json
from assayer.plans import sample
from assayer.sources import archives


def _folder(spark, kind: str) -> str:
    return f"{shared.shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def pages_archived(spark, sf_dir):
    """All pages as HTTP responses in WARC files, every tenth as not found, and the good ones of them read back."""
    archives.register(spark)
    pages, folder = sample.table(spark, sf_dir, "pages"), _folder(spark, "archive")
    status = F.when(F.col("page_id") % 10 == 9, 404).otherwise(200)
    fetched = F.lit(1e9) + F.col("page_id").cast("double")
    pages.select("url", fetched.alias("fetched"), status.alias("status"), F.lit("text/html; charset=utf-8").alias("content_type"), F.col("html").cast("binary").alias("body")).filter("url IS NOT NULL").write.format("responses").mode("append").save(folder)
    good = spark.read.format("responses").load(folder).filter("status = 200")
    return good.select("url", "host", "fetched", F.length("body").alias("n_bytes"), F.sha2("body", 256).alias("sha256"))


def strict_records(spark, sf_dir):
    """Of each document as a record in JSON, damaged in ways that its id tells, whether a strict reader takes it."""
    docs = sample.table(spark, sf_dir, "documents")
    kind, record = F.col("doc_id") % 8, F.to_json(F.struct("doc_id", "lang", "text"))
    made = (
        F.when(kind == 1, F.expr("substr(r, 1, length(r) - 1)")).when(kind == 2, F.concat("r", F.lit("}"))).when(kind == 3, F.concat(F.repeat(F.lit("["), F.col("doc_id") % 80), "r", F.repeat(F.lit("]"), F.col("doc_id") % 80)))
        .when(kind == 4, F.concat(F.lit('"'), "text", F.lit('"'))).when(kind == 5, F.concat(F.lit("[0"), F.col("doc_id").cast("string"), F.lit(","), "r", F.lit("]"))).when(kind == 6, F.concat(F.lit('{"a":'), "r", F.lit(',"a":-1.5e3}'))).otherwise(F.col("r"))
    )
    return docs.select("doc_id", "text", record.alias("r")).select("doc_id", strict_json.valid_json(made).alias("valid"))


QUERIES = {"pages_archived": pages_archived, "strict_records": strict_records}
SQL = {
    "pages_archived": """SELECT url, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, (1000000000 + page_id)::DOUBLE AS fetched, strlen(coalesce(html, ''))::INTEGER AS n_bytes, sha256(coalesce(html, '')) AS sha256
        FROM pages WHERE page_id % 10 <> 9 AND url IS NOT NULL""",
    "strict_records": """WITH records AS (SELECT doc_id, text, CAST(to_json({'doc_id': doc_id, 'lang': lang, 'text': text}) AS VARCHAR) AS r FROM documents),
        made AS (SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN substr(r, 1, length(r) - 1) WHEN 2 THEN r || '}' WHEN 3 THEN repeat('[', doc_id % 80) || r || repeat(']', doc_id % 80)
            WHEN 4 THEN '"' || text || '"' WHEN 5 THEN '[0' || doc_id || ',' || r || ']' WHEN 6 THEN '{"a":' || r || ',"a":-1.5e3}' ELSE r END AS t FROM records)
        SELECT doc_id, json_valid(t) AND NOT (doc_id % 8 = 3 AND doc_id % 80 + 1 > 64) AS valid FROM made""",
}
