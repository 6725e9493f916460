"""Triples and claims to weigh, derived from the star schema, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import nlp, ranges, shared
from assayer.operators import score, store

NOW = 1009843200.0
#: Subject, object and polarity of the claims.
CLAIMS = [(["cold", "widget"], ["economy"], 1), (["blue"], ["promo", "small"], -1), (["gizmo"], [], 1), (["ring"], ["nothing"], 1), (["absent"], ["economy"], 1), (["hot"], ["standard"], -1), (["red", "green"], ["large"], 1)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, predicate, object, source, added, trust_q) for each line item, repeats included."""
    item, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = item.join(part, item["l_partkey"] == part["p_partkey"])
    verb = F.when(F.col("l_returnflag") == "A", "improve").when(F.col("l_returnflag") == "R", "reduce").otherwise("contain")
    denied = (F.col("l_linestatus") == "O") & (F.col("l_linenumber") % 3 == 0)
    return joined.select(
        F.col("p_name").alias("subject"), F.when(denied, F.concat(F.lit("not "), verb)).otherwise(verb).alias("predicate"), F.lower("p_type").alias("object"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(".example.org/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))).alias("source"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6).alias("added"), (F.lit(100) + F.col("l_suppkey") * 37 % 156).cast("int").alias("trust_q"),
    )


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts upserted; row is the rank of the key, so that results don't depend on the order of arrival."""
    return numbered(store.upsert(attempts(spark, sf_dir)))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `row`, the place of the key (subject, predicate, object, source) in its order, found by ranges."""
    return ranges.numbered(shared.stored(rows), [F.col(c) for c in store.KEY], "row")


def claims(spark: SparkSession) -> DataFrame:
    rows = [(k + 1, sorted(s), sorted(o), p, s[0], (o or [""])[0]) for k, (s, o, p) in enumerate(CLAIMS)]
    return spark.createDataFrame(rows, "claim_id int, s array<string>, o array<string>, pol int, subject string, object string")


def weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triples with topics, written once, and their corroboration."""
    return score.corroborate(shared.stored(score.with_topics(triples(spark, sf_dir))))


def light_evidence(spark: SparkSession, sf_dir: str, rows: bool = True) -> tuple[DataFrame, DataFrame]:
    """The claims' evidence without its triples, and the topics (t1, t2, ss, os) of all triples; without rows, only weights are right, and no order is sought."""
    facts = triples(spark, sf_dir) if rows else store.upsert(attempts(spark, sf_dir)).withColumn("row", F.lit(0).cast("long"))
    kept = shared.stored(score.with_topics(facts).select("row", "added", "trust", "ss", "os", "pol", "host"))
    return score.light_evidence(F.broadcast(claims(spark)), kept, NOW), score.keyed(kept.select("ss", "os").distinct())


ATTEMPTS_SQL = """attempts AS (
  SELECT p_name AS subject,
    CASE WHEN l_linestatus = 'O' AND l_linenumber % 3 = 0 THEN 'not ' ELSE '' END || CASE l_returnflag WHEN 'A' THEN 'improve' WHEN 'R' THEN 'reduce' ELSE 'contain' END AS predicate,
    lower(p_type) AS object, 's' || l_suppkey || '.example.org/' || lower(replace(p_brand, '#', '-')) AS source,
    epoch(l_shipdate)::DOUBLE AS added, (100 + (l_suppkey * 37) % 156)::INTEGER AS trust_q
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
TRIPLES_SQL = f"""{ATTEMPTS_SQL},
kept AS (SELECT subject, predicate, object, source, max(added) AS added, max(trust_q) AS trust_q FROM attempts GROUP BY ALL),
triples AS (SELECT *, row_number() OVER (ORDER BY subject, predicate, object, source) AS row, split_part(source, '/', 1) AS host, trust_q / 255.0::DOUBLE AS trust FROM kept)"""
_POL = nlp.sql_polarity("predicate", "object")
TOPICS_SQL = f"""{TRIPLES_SQL},
names AS (SELECT DISTINCT subject AS name FROM triples UNION SELECT DISTINCT object FROM triples),
stemmed AS MATERIALIZED (SELECT name, {nlp.sql_stems("name")} AS stems FROM names),
spoken AS MATERIALIZED (SELECT predicate, object, {_POL} AS pol FROM (SELECT DISTINCT predicate, object FROM triples)),
topics AS MATERIALIZED (
  SELECT t.*, a.stems AS ss, b.stems AS os, p.pol FROM triples t JOIN stemmed a ON a.name = t.subject JOIN stemmed b ON b.name = t.object
  JOIN spoken p ON p.predicate = t.predicate AND p.object = t.object)"""
CORR_SQL = f"""{TOPICS_SQL},
voiced AS (SELECT DISTINCT ss, os, host, pol FROM topics),
numbers AS (SELECT ss, os, pol, count(*) AS n FROM voiced GROUP BY ALL),
heard AS (
  SELECT t.*, (a.n - 1)::INTEGER AS syn,
    (CASE WHEN t.pol = 0 THEN 0 ELSE coalesce(b.n, 0) - CASE WHEN v.host IS NULL THEN 0 ELSE 1 END END)::INTEGER AS ant
  FROM topics t JOIN numbers a ON a.ss = t.ss AND a.os = t.os AND a.pol = t.pol
  LEFT JOIN numbers b ON b.ss = t.ss AND b.os = t.os AND b.pol = -t.pol
  LEFT JOIN voiced v ON v.ss = t.ss AND v.os = t.os AND v.host = t.host AND v.pol = -t.pol),
weighed AS MATERIALIZED (SELECT *, (syn + 1)::DOUBLE / (syn + ant + 1) * (1 + 0.25 * least(syn, 3)) AS corr FROM heard)"""


def _array(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]::VARCHAR[]"


CLAIMS_SQL = "claims(claim_id, s, o, pol, subject, object) AS (VALUES " + ", ".join(f"({k + 1}, {_array(s)}, {_array(o)}, {p}, '{s[0]}', '{(o or [''])[0]}')" for k, (s, o, p) in enumerate(CLAIMS)) + ")"
EVIDENCE_SQL = f"""{CORR_SQL}, {CLAIMS_SQL},
met AS (
  SELECT c.claim_id, c.o AS co, c.pol AS cpol, t.*, len(c.o) = 0 OR list_has_any(c.o, list_concat(t.os, t.ss)) AS is_full
  FROM claims c JOIN weighed t ON list_has_any(c.s, t.ss)),
graded AS (
  SELECT *, CASE WHEN NOT is_full OR pol = 0 OR cpol = 0 THEN 'neutral' WHEN pol = cpol THEN 'for' ELSE 'against' END AS stance,
    round(trust * corr * {nlp.sql_recency("added", NOW)} * CASE WHEN is_full THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END, 12) AS weight,
    CASE WHEN is_full AND len(co) > 0 THEN list_sort(list_intersect(os, co)) ELSE os END AS topic FROM met),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY claim_id, host, ss, topic, stance ORDER BY weight DESC, row) AS nth,
    min(row) OVER (PARTITION BY claim_id, host, ss, topic, stance) AS first_row FROM graded),
evidence AS MATERIALIZED (SELECT * FROM ordered WHERE nth = 1)"""
TALLY_SQL = f"""{EVIDENCE_SQL},
buckets AS (
  SELECT c.claim_id, 0.15 + coalesce(sum(weight) FILTER (WHERE stance = 'for'), 0) AS f, 0.15 + coalesce(sum(weight) FILTER (WHERE stance = 'against'), 0) AS a,
    0.15 + coalesce(sum(weight) FILTER (WHERE stance = 'neutral'), 0) AS n, count(*) FILTER (WHERE stance <> 'neutral') AS n_full, count(DISTINCT host) AS hosts, count(host) AS items
  FROM claims c LEFT JOIN evidence e ON c.claim_id = e.claim_id GROUP BY c.claim_id),
tallies AS (SELECT claim_id, f / (f + a + n) AS for_share, a / (f + a + n) AS against_share, n / (f + a + n) AS neutral_share, n_full, hosts, items FROM buckets),
led AS (
  SELECT *, CASE WHEN for_share >= against_share AND for_share >= neutral_share THEN 'for' WHEN against_share >= neutral_share THEN 'against' ELSE 'neutral' END AS leader,
    greatest(for_share, against_share, neutral_share) AS leader_share FROM tallies),
verdicts AS (SELECT *, leader_share >= 0.6 AND hosts >= 2 AND n_full >= 2 AS resolved FROM led)"""
