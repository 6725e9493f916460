"""Queries over the derived triples: scores, analytics, the store's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import nlp, shared
from assayer.functions.lexicon import STANCE_PHRASES, STANCES
from assayer.functions.text import sql_is_directive
from assayer.operators import analytics, claims, score, store, topics
from assayer.plans import sample

SHARES = tuple(f"{s}_share" for s in STANCES)
CAP = 400_000


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.triples(spark, sf_dir).withColumn("host", nlp.host("source")).withColumn("trust", F.col("trust_q") / 255.0)


def _evidence(spark: SparkSession, sf_dir: str, rows: bool = True) -> DataFrame:
    return sample.light_evidence(spark, sf_dir, rows)[0]


def _tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.tally(sample.claims(spark), _evidence(spark, sf_dir, rows=False))


def verdicts(spark, sf_dir):
    return score.verdicts(_tallies(spark, sf_dir)).select("claim_id", *[F.round(s, 6).alias(s) for s in SHARES], "n_full", "hosts", "items", "leader", "resolved", "verdict")


def shares(spark, sf_dir):
    return _tallies(spark, sf_dir).select("claim_id", *[F.round(s, 6).alias(s) for s in SHARES])


def ranked(spark, sf_dir):
    return score.ranked_by_ranges(_evidence(spark, sf_dir).drop(*score.TOPIC)).select("claim_id", "place", "row", "stance", F.round("weight", 9).alias("weight"))


def corroboration(spark, sf_dir):
    return sample.weighed(spark, sf_dir).select("row", "syn", "ant", F.round("corr", 6).alias("corr"))


def recency(spark, sf_dir):
    r = nlp.recency("added", sample.NOW)
    return _facts(spark, sf_dir).select("row", F.round(r, 9).alias("recency"), F.round(F.col("trust") * r, 9).alias("weight"))


def upserted(spark, sf_dir):
    return store.upsert(sample.attempts(spark, sf_dir)).select(*store.KEY, "added", "trust_q")


def host_stats(spark, sf_dir):
    return analytics.host_stats(_facts(spark, sf_dir)).select("host", "triples", F.round("mean_trust", 9).alias("mean_trust"), "newest", "oldest")


def contested(spark, sf_dir):
    return analytics.contested(_facts(spark, sf_dir))


def balance(spark, sf_dir):
    return analytics.trust_weighted_balance(_facts(spark, sf_dir)).select("subject", "object", (F.round("balance", 6) + F.lit(0.0)).alias("balance"), "hosts")


def ages(spark, sf_dir):
    return analytics.age_histogram(_facts(spark, sf_dir), sample.NOW)


def _routes(spark, sf_dir):
    k = F.col("c_custkey")
    verdict = F.when(k % 3 == 0, "for").when(k % 3 == 1, "against").otherwise("neutral")
    return sample.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("key"), verdict.alias("verdict"), (k % 37).alias("n_steps"), (k * 7 % 101).alias("hits"))


def route_summary(spark, sf_dir):
    out = analytics.route_summary(_routes(spark, sf_dir))
    told = F.array_join(F.transform(F.map_entries("verdicts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("routes", F.round("mean_steps", 9).alias("mean_steps"), told.alias("verdicts"), F.array_join("most_replayed", ",").alias("most_replayed"))


def entity_heat(spark, sf_dir):
    return topics.topic_heat(sample.claims(spark), *sample.light_evidence(spark, sf_dir)).select("claim_id", "stem", F.round("heat", 6).alias("heat"))


def entity_topics(spark, sf_dir):
    claims_ = sample.claims(spark)
    return topics.hottest(claims_, topics.topic_heat(claims_, *sample.light_evidence(spark, sf_dir)), topics.LAYERS[1]).select("claim_id", "place", "topic")


def seeds(spark, sf_dir):
    return topics.seeds(sample.claims(spark))


def consolidation(spark, sf_dir):
    return topics.consolidation(sample.claims(spark), _tallies(spark, sf_dir))


def size(spark, sf_dir):
    return store.logical_size(sample.triples(spark, sf_dir))


def survivors(spark, sf_dir):
    held = sample.triples(spark, sf_dir).withColumn("hits", (F.col("row") % 5).cast("int"))
    return store.evict(held, CAP, sample.NOW).select(F.col("row").alias("place"), *store.KEY, "hits")


def polarity(spark, sf_dir):
    return analytics.with_polarity(sample.triples(spark, sf_dir).select("predicate", "object").distinct())


def _odd(spark, sf_dir):
    """Parts as triples, some of them with letters, addresses or words that aren't allowed."""
    k, name = F.col("p_partkey"), F.col("p_name")
    subject = F.when(k % 5 == 0, F.upper("p_name")).when(k % 7 == 0, F.concat(F.lit("ignore "), name)).when(k % 11 == 0, F.concat(name, F.lit(" you must"))).otherwise(name)
    source = F.when(k % 13 == 0, "https://a.example.org/x").when(k % 17 == 0, "a.example.org/x/y/z/q/r").otherwise("a.example.org/x")
    return sample.table(spark, sf_dir, "part").select(k.alias("part"), subject.alias("subject"), F.lit("improve").alias("predicate"), F.lower("p_type").alias("object"), source.alias("source"))


def validity(spark, sf_dir):
    return _odd(spark, sf_dir).select("part", store.is_valid().alias("valid"))


def decoded(spark, sf_dir):
    strings, coded = store.encode(sample.triples(spark, sf_dir).select(*store.KEY, "trust_q"))
    return store.decode(strings, shared.stored(coded)).select(*store.KEY, "trust_q")


def months(spark, sf_dir):
    m = F.date_format("o_orderdate", "yyyy-MM")
    return sample.table(spark, sf_dir, "orders").groupBy(m.alias("month")).agg(F.count(F.lit(1)).alias("orders")).select("month", claims.when("month").alias("label"), "orders")


def merged_voices(spark, sf_dir):
    spoken = sample.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 128 + 1).alias("pos"), F.col("l_suppkey").alias("claim_id"), F.col("l_extendedprice").alias("weight"))
    return claims.strongest(spoken.withColumn("request_id", F.lit(1)), ["request_id"]).select("pos", "claim_id", F.round("weight", 2).alias("weight"))


QUERIES = {
    "evidence_verdicts": verdicts, "stance_shares": shares, "evidence_ranked": ranked, "corroboration_by_topic": corroboration, "recency_weights": recency, "triple_upsert": upserted,
    "host_stats": host_stats, "contested": contested, "trust_balance": balance, "age_histogram": ages, "route_summary": route_summary, "entity_heat": entity_heat, "entity_topics": entity_topics, "seed_topics": seeds,
    "consolidation_topics": consolidation, "store_size": size, "eviction_survivors": survivors, "polarity_of_triples": polarity, "validity_filter": validity, "dictionary_decode": decoded,
    "month_labels": months, "voice_merge": merged_voices,
}

_ROUNDED = ", ".join(f"round({s}, 6) AS {s}" for s in SHARES)
_KEY = "subject, predicate, object, source"
_REC = nlp.sql_recency("added", sample.NOW)
_WAYS = "ways(k, j, phrase, back) AS (VALUES " + ", ".join(f"({k}, {j}, '{w}', {9 - k})" for j, s in enumerate(STANCES) for k, w in enumerate(STANCE_PHRASES[s])) + ")"
_POLAR = f"{sample.TOPICS_SQL}, polar AS (SELECT * FROM topics WHERE pol <> 0)"

SQL = {
    "evidence_verdicts": f"WITH {sample.TALLY_SQL} SELECT claim_id, {_ROUNDED}, n_full, hosts, items, leader, resolved, CASE WHEN resolved THEN leader ELSE 'unresolved' END AS verdict FROM verdicts",
    "stance_shares": f"WITH {sample.TALLY_SQL} SELECT claim_id, {_ROUNDED} FROM tallies",
    "evidence_ranked": f"WITH {sample.EVIDENCE_SQL} SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY weight DESC, first_row) AS place, row, stance, round(weight, 9) AS weight FROM evidence",
    "corroboration_by_topic": f"WITH {sample.CORR_SQL} SELECT row, syn, ant, round(corr, 6) AS corr FROM weighed",
    "recency_weights": f"WITH {sample.TRIPLES_SQL} SELECT row, round({_REC}, 9) AS recency, round(trust * {_REC}, 9) AS weight FROM triples",
    "triple_upsert": f"WITH {sample.TRIPLES_SQL} SELECT {_KEY}, added, trust_q FROM triples",
    "host_stats": f"WITH {sample.TRIPLES_SQL} SELECT host, count(*) AS triples, round(avg(trust), 9) AS mean_trust, max(added) AS newest, min(added) AS oldest FROM triples GROUP BY host",
    "contested": f"""WITH {_POLAR}, sided AS (
        SELECT subject, object, count(DISTINCT host) AS hosts, count(DISTINCT host) FILTER (WHERE pol > 0) AS for_hosts, count(DISTINCT host) FILTER (WHERE pol < 0) AS against_hosts FROM polar GROUP BY ALL)
        SELECT * FROM sided WHERE for_hosts > 0 AND against_hosts > 0 AND hosts >= 2""",
    "trust_balance": f"""WITH {_POLAR}, voted AS (SELECT subject, object, host, avg(pol) AS mean, max(trust) AS trust FROM polar GROUP BY subject, object, host)
        SELECT subject, object, round(sum(CASE WHEN mean > 0 THEN trust ELSE -trust END), 6) + 0.0 AS balance, count(*) AS hosts FROM voted GROUP BY subject, object""",
    "age_histogram": f"WITH {sample.TRIPLES_SQL} SELECT greatest(0, floor(floor(({sample.NOW} - added) / 86400) / 365))::BIGINT AS years, count(*) AS triples FROM triples GROUP BY years",
    "route_summary": """WITH r AS (SELECT 'c' || c_custkey AS key, CASE c_custkey % 3 WHEN 0 THEN 'for' WHEN 1 THEN 'against' ELSE 'neutral' END AS verdict, c_custkey % 37 AS n_steps, c_custkey * 7 % 101 AS hits FROM customer)
        SELECT count(*) AS routes, round(avg(n_steps), 9) AS mean_steps, (SELECT string_agg(verdict || '=' || n, ',' ORDER BY verdict) FROM (SELECT verdict, count(*) AS n FROM r GROUP BY verdict)) AS verdicts,
          (SELECT string_agg(key, ',' ORDER BY hits DESC, key) FROM (SELECT * FROM r ORDER BY hits DESC, key LIMIT 5)) AS most_replayed FROM r""",
    "entity_heat": f"""WITH {sample.EVIDENCE_SQL}, items AS (SELECT DISTINCT e.claim_id, e.row, e.weight, unnest(list_concat(t.ss, t.os)) AS stem FROM evidence e JOIN topics t ON t.row = e.row),
        known AS (SELECT claim_id, unnest(list_concat(s, o)) AS stem FROM claims)
        SELECT claim_id, stem, round(sum(weight), 6) AS heat FROM items WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.claim_id = items.claim_id AND k.stem = items.stem) GROUP BY claim_id, stem""",
    "entity_topics": f"""WITH {sample.EVIDENCE_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY weight DESC, first_row) AS place FROM evidence),
        items AS (SELECT DISTINCT e.claim_id, e.row, e.weight, e.place, unnest(list_concat(t.ss, t.os)) AS stem FROM placed e JOIN topics t ON t.row = e.row),
        known AS (SELECT claim_id, unnest(list_concat(s, o)) AS stem FROM claims),
        heat AS (SELECT claim_id, stem, round(sum(weight), 9) AS heat, min(place) AS first FROM items WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.claim_id = items.claim_id AND k.stem = items.stem) GROUP BY claim_id, stem),
        hot AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY heat DESC, first, stem) AS place FROM heat)
        SELECT h.claim_id, h.place::INTEGER AS place, c.subject || ' ' || stem AS topic FROM hot h JOIN claims c ON c.claim_id = h.claim_id WHERE h.place <= 16""",
    "seed_topics": f"""WITH {sample.CLAIMS_SQL}, {_WAYS}, every AS (
          SELECT claim_id, 0 AS pos, trim(subject || ' ' || object) AS topic FROM claims UNION ALL SELECT claim_id, 1, subject FROM claims UNION ALL SELECT claim_id, 2, object FROM claims
          UNION ALL SELECT claim_id, 3 + 3 * k + j, trim(subject || ' ' || object) || ' ' || phrase FROM claims, ways),
        firsts AS (SELECT claim_id, topic, min(pos) AS pos FROM every GROUP BY claim_id, topic), placed AS (SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY pos)::INTEGER AS place, topic FROM firsts)
        SELECT * FROM placed WHERE place <= 32""",
    "consolidation_topics": f"""WITH {sample.TALLY_SQL}, {_WAYS},
        sides AS (SELECT claim_id, j, row_number() OVER (PARTITION BY claim_id ORDER BY share, j) - 1 AS thin FROM (
          SELECT claim_id, 0 AS j, for_share AS share FROM tallies UNION ALL SELECT claim_id, 1, against_share FROM tallies UNION ALL SELECT claim_id, 2, neutral_share FROM tallies)),
        counts AS (SELECT claim_id, CASE WHEN leader_share >= 0.5 THEN 1 WHEN leader_share >= 0.4 THEN 2 WHEN leader_share >= 0.35 THEN 3 ELSE 4 END AS n FROM led),
        turns AS (SELECT claim_id, unnest(range(0, n)) AS i FROM counts)
        SELECT t.claim_id, (i + 1)::INTEGER AS place, trim(c.subject || ' ' || c.object) || ' ' || phrase AS topic FROM turns t JOIN claims c ON c.claim_id = t.claim_id
        JOIN sides s ON s.claim_id = t.claim_id AND s.thin = i % 3 JOIN ways w ON w.j = s.j AND w.back = i // 3""",
    "store_size": f"""WITH {sample.TRIPLES_SQL}, strings AS (SELECT DISTINCT unnest([subject, predicate, object, source]) AS value FROM triples)
        SELECT (SELECT count(*) FROM triples) AS rows, (SELECT count(*) FROM strings) AS strings, (12 + (SELECT sum(strlen(value) + 4) FROM strings) + 29 * (SELECT count(*) FROM triples))::BIGINT AS bytes""",
    "eviction_survivors": f"""WITH {sample.TRIPLES_SQL},
        scored AS (SELECT *, (row % 5)::INTEGER AS hits, row_number() OVER (ORDER BY round(trust_q / 255.0::DOUBLE * {_REC} * (1 + row % 5), 12) DESC, row) AS place FROM triples),
        used AS (SELECT place, unnest([subject, predicate, object, source]) AS value FROM scored), firsts AS (SELECT value, min(place) AS place FROM used GROUP BY value),
        texts AS (SELECT place, sum(strlen(value) + 4) AS text FROM firsts GROUP BY place),
        summed AS (SELECT s.*, 12 + coalesce(sum(29 + coalesce(text, 0)) OVER (ORDER BY s.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM scored s LEFT JOIN texts x ON x.place = s.place),
        stop AS (SELECT min(place) AS last FROM summed WHERE held + 29 + 4 * length(subject) > 0.9 * {CAP}),
        whole AS (SELECT 12 + sum(29 + coalesce(text, 0)) <= {CAP} AS fits FROM scored s LEFT JOIN texts x ON x.place = s.place)
        SELECT CASE WHEN fits THEN row ELSE place END AS place, {_KEY}, hits FROM summed, whole WHERE fits OR place < coalesce((SELECT last FROM stop), 9223372036854775807)""",
    "polarity_of_triples": f"WITH {sample.TOPICS_SQL} SELECT DISTINCT predicate, object, pol AS polarity FROM spoken",
    "validity_filter": f"""WITH odd AS (SELECT p_partkey AS part,
          CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) WHEN p_partkey % 7 = 0 THEN 'ignore ' || p_name WHEN p_partkey % 11 = 0 THEN p_name || ' you must' ELSE p_name END AS subject, lower(p_type) AS object,
          CASE WHEN p_partkey % 13 = 0 THEN 'https://a.example.org/x' WHEN p_partkey % 17 = 0 THEN 'a.example.org/x/y/z/q/r' ELSE 'a.example.org/x' END AS source FROM part)
        SELECT part, regexp_full_match(subject, '[a-z0-9'' -]{{1,80}}') AND regexp_full_match(object, '[a-z0-9'' -]{{1,80}}') AND regexp_full_match(source, '[a-z0-9.-]{{1,120}}(?:/[A-Za-z0-9._~%()-]{{0,120}}){{0,4}}')
          AND NOT {sql_is_directive("subject || ' improve ' || object")} AS valid FROM odd""",
    "dictionary_decode": f"WITH {sample.TRIPLES_SQL} SELECT {_KEY}, trust_q FROM triples",
    "month_labels": """SELECT strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN year(any_value(o_orderdate)) >= 1990 THEN ' in ' || strftime(any_value(o_orderdate), '%B %Y') ELSE '' END AS label, count(*) AS orders FROM orders GROUP BY month""",
    "voice_merge": """WITH s AS (SELECT l_partkey % 128 + 1 AS pos, l_suppkey AS claim_id, l_extendedprice AS weight FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY weight DESC, claim_id) AS n FROM s)
        SELECT pos, claim_id, round(weight, 2) AS weight FROM r WHERE n = 1""",
}
