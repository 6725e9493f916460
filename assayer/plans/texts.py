"""Queries over documents, pages, conversations and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import nlp, readings, shared, text
from assayer.operators import claims, gate, ingest, resolve, score, search, session, store, topics
from assayer.plans import library, sample
from assayer.sources import outline
from assayer.streaming import ingest as stream

TRUST = [("example.com", 0.8), ("example.org", 0.5), ("blog.tionble.example.com", 0.3), ("net", 0.1)]
HOST = r"^https?://([^/:?#]+)"


def _docs(spark, sf_dir) -> DataFrame:
    """documents as docs of the library: each source is a host, with a trust by its name."""
    docs = sample.table(spark, sf_dir, "documents")
    locator = F.concat(F.coalesce("source", F.lit("none")), F.lit(".example.org/d"), F.col("doc_id").cast("string"))
    return docs.select(F.col("doc_id").alias("doc"), locator.alias("locator"), "text", (F.lit(1.6e9) + F.col("doc_id")).alias("added"))


def _source_trust(spark) -> DataFrame:
    return spark.createDataFrame([(f"src{k}.example.org", 0.4 + k / 40) for k in range(15)], "host string, trust double")


def suffix_gate(spark, sf_dir):
    pages = sample.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", HOST, 1).alias("host"))
    trust = spark.createDataFrame(TRUST, "host string, trust double")
    return gate.with_trust(pages, trust, F.col("host"))


def doc_sizes(spark, sf_dir):
    return sample.table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), gate.fits("text").alias("fits"))


def _sentences(spark, sf_dir, name: str, *keys: str) -> DataFrame:
    return sample.table(spark, sf_dir, name).select(*keys, F.posexplode(text.sentence_parts("text")).alias("at", "sentence"))


def sentence_split(spark, sf_dir):
    return _sentences(spark, sf_dir, "documents", "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("sentence")).alias("chars"))


def injection_filter(spark, sf_dir):
    said = _sentences(spark, sf_dir, "conversations", "conv_id", "turn")
    return said.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("sentences"), F.sum(text.is_directive("sentence").cast("long")).alias("directive"))


def token_stats(spark, sf_dir):
    docs = sample.table(spark, sf_dir, "documents").select("doc_id", nlp.tokens("text").alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"))


def stem_sets(spark, sf_dir):
    return sample.table(spark, sf_dir, "documents").select("doc_id", F.array_join(nlp.stems("text"), " ").alias("stems"))


def _postings(spark, sf_dir):
    docs = sample.table(spark, sf_dir, "documents")
    return search.index(docs, "doc_id"), docs.count()


def idf_table(spark, sf_dir):
    postings, n = _postings(spark, sf_dir)
    return search.idf(postings, n).select("stem", "df", F.round("idf", 9).alias("idf"))


def tfidf_topk(spark, sf_dir):
    postings, n = _postings(spark, sf_dir)
    asked = sample.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.top_documents(asked, postings, n, 5).select("query_id", "doc", F.round("score", 6).alias("score"), "place")


def clean_pages(spark, sf_dir):
    pages = text.sentences(sample.table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")))
    return pages.select("page_id", F.length("cleaned").cast("long").alias("chars"), F.size("sentences").cast("long").alias("sentences"), "dropped", F.sha2("cleaned", 256).alias("sha256"))


def _spoken(spark, sf_dir) -> DataFrame:
    """The sentences of the documents and of the small library, directive ones too."""
    own = sample.table(spark, sf_dir, "documents").select("text").unionByName(library.docs(spark).select("text"))
    return own.select(text.clean("text").alias("cleaned")).select(F.explode(text.sentence_parts("cleaned")).alias("sentence"))


def parse_report(spark, sf_dir):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = _spoken(spark, sf_dir).distinct().repartition(n).filter(~text.is_directive("sentence")).withColumn("report", readings.reading_report("sentence"))
    each = read.select("sentence", F.explode("report").alias("rule", "found")).select("sentence", "rule", F.posexplode("found").alias("at", "r"))
    return each.select("sentence", "rule", "at", "r.subject", "r.predicate", "r.object")


def ensemble(spark, sf_dir):
    read = ingest.parse(_spoken(spark, sf_dir)).select("sentence", F.posexplode("readings").alias("at", "r"))
    return read.select("sentence", "at", "r.subject", "r.predicate", "r.object", F.array_join("r.votes", ",").alias("votes"))


def qa_pairs(spark, sf_dir):
    said = sample.table(spark, sf_dir, "conversations").select("text").unionByName(library.docs(spark).select("text"))
    pairs = said.select(F.explode(readings.answered_questions(text.clean("text"))).alias("p")).distinct()
    return pairs.select("p.question", "p.denied", F.posexplode(readings.question_readings(F.col("p.question"))).alias("at", "r")).select("question", "denied", "at", "r.subject", "r.predicate", "r.object")


def heard(spark, sf_dir):
    """What ingest takes in of each document that the gate admits, before it is read: its trust, its sentences and how many are directive."""
    docs = ingest.listened(_docs(spark, sf_dir), _source_trust(spark))
    return docs.select("doc", "source", "trust_q", F.size("parts").cast("long").alias("sentences"), F.size(F.filter("parts", text.is_directive)).cast("long").alias("directive"))


def ingest_stats(spark, sf_dir):
    docs, trust = _docs(spark, sf_dir), _source_trust(spark)
    heard = ingest.hear(docs, trust)
    tried = shared.stored(ingest.attempts(docs, trust, heard=heard))
    return ingest.stats(docs, trust, tried, heard=heard)


def _asked(spark, sf_dir) -> DataFrame:
    """Every benchmark item as a request, its id in millions, with the small library's requests."""
    items = sample.table(spark, sf_dir, "benchmark").select(((F.col("item_id") + 1) * 1_000_000).cast("long").alias("request_id"), "text")
    return spark.createDataFrame(library.REQUESTS, "request_id long, text string").unionByName(items)


def _shelves(spark, sf_dir) -> resolve.Library:
    """All documents, and the small library's under negative numbers."""
    small = library.docs(spark).withColumn("doc", F.col("doc") - len(library.DOCUMENTS))
    return resolve.Library.of(_docs(spark, sf_dir).unionByName(small), _source_trust(spark).unionByName(library.trust(spark)))


def _parsed(spark, sf_dir) -> DataFrame:
    return shared.stored(claims.with_areas(claims.parse(_asked(spark, sf_dir))).withColumn("claim_id", F.col("request_id") * 100 + F.col("place")))


def _outcome(spark, sf_dir, cycles: int = 0):
    parsed, shelves = shared.together(spark, lambda: _parsed(spark, sf_dir), lambda: _shelves(spark, sf_dir))
    return parsed, resolve.resolve(parsed, shelves, resolve.empty_memory(spark), library.NOW, cycles=cycles)


def resolve_quick(spark, sf_dir):
    return quick_answers(*_outcome(spark, sf_dir))


def quick_answers(asked: DataFrame, out: resolve.Outcome) -> DataFrame:
    """A verdict for each claim."""
    judged = out.verdicts.join(out.rounds, "claim_id").join(asked.select("claim_id", "text"), "claim_id")
    return judged.select("claim_id", "text", "verdict", "resolved", *[F.round(f"{s}_share", 6).alias(f"{s}_share") for s in score.STANCES], "hosts", "items", "rounds")


def deliberated(spark, sf_dir):
    asked, out = _outcome(spark, sf_dir, cycles=12)
    return out.verdicts.select("claim_id", "verdict", "resolved", *[F.round(f"{s}_share", 6).alias(f"{s}_share") for s in score.STANCES], "hosts", "items")


def replayed(spark, sf_dir):
    """All claims asked twice in a session: how each was answered then, and by which route. Resolved ones are replayed without a search."""
    return replays(*shared.together(spark, lambda: _parsed(spark, sf_dir), lambda: _shelves(spark, sf_dir)))


def replays(parsed: DataFrame, shelves: resolve.Library) -> DataFrame:
    held = session.Session.begin(parsed.sparkSession)
    first, again = (held.answer(parsed, shelves, library.NOW) for _ in range(2))
    routes = held.routes.select("key", "hits", F.size("steps").cast("long").alias("n_steps"))
    both = first.rounds.select("claim_id", F.col("rounds").alias("rounds_first")).join(again.rounds, "claim_id").join(again.verdicts, "claim_id").join(parsed.select("claim_id", "key"), "claim_id")
    return both.join(routes, "key").select("claim_id", "key", "verdict", "resolved", "rounds_first", "rounds", "hits", "n_steps")


def _voices(asked: DataFrame, out: resolve.Outcome) -> DataFrame:
    steps = out.steps.join(asked.select("claim_id", "request_id", (F.col("area") * claims.AREA_SIZE).alias("offset")), "claim_id")
    return claims.voices(out.evidence, steps).join(asked.select("claim_id", "request_id"), "claim_id")


def voices(spark, sf_dir):
    return _voices(*_outcome(spark, sf_dir)).select("request_id", "claim_id", "pos", "stance", "text", F.round("weight", 6).alias("weight"), "host", "month")


def resolve_long(spark, sf_dir):
    return long_answers(_asked(spark, sf_dir), *_outcome(spark, sf_dir))


def long_answers(requests: DataFrame, asked: DataFrame, out: resolve.Outcome) -> DataFrame:
    """An answer in prose and as a list for each request."""
    one = shared.stored(claims.strongest(_voices(asked, out), ["request_id"]))
    told = claims.prose(one, ["request_id"]).join(claims.listed(one, ["request_id"]), "request_id")
    return requests.join(told, "request_id", "left").select("request_id", F.coalesce("prose", F.lit(claims.NOTHING_SAID)).alias("prose"), F.coalesce("numbered", F.lit(claims.NOTHING_LISTED)).alias("numbered"))


def _event_attempts(events: DataFrame) -> DataFrame:
    said = F.when(F.col("value") > 50, "improve").otherwise("reduce")
    return events.select(
        F.concat(F.lit("event "), F.regexp_replace(F.lower("event_type"), "[^a-z0-9]+", " ")).alias("subject"), said.alias("predicate"), F.concat(F.lit("user "), (F.col("user_id") % 50).cast("string")).alias("object"),
        F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"), F.lit(".example.org/e")).alias("source"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("added"), (F.col("user_id") % 256).cast("int").alias("trust_q"),
    )


def stream_upsert(spark, sf_dir):
    """The events as a stream of attempts, merged batch by batch."""
    path = f"{sf_dir}/[e]vents.parquet"  # a pattern, which a stream also takes for a single file
    base = f"{shared.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(sample.table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 4).parquet(path)
    stream.start(_event_attempts(events), f"{base}/memory", f"{base}/checkpoint").awaitTermination()
    _, held, _ = stream.memory_at(spark, f"{base}/memory").load()
    return spark.createDataFrame([], stream.SAID) if held is None else held.select(*store.KEY, "added", "trust_q")


_ADDRESS = "concat_ws('.', cast(user_id * 37 % 256 as string), cast(user_id * 101 % 256 as string), cast(event_id % 256 as string), '1')"
HOSTS = ["tionsh.example.net", "therin.example.net", "thther.example.org"]


def ip_policy(spark, sf_dir):
    found = sample.table(spark, sf_dir, "events").select("event_id", F.expr(_ADDRESS).alias("address"))
    return found.select("event_id", "address", gate.is_public_ip("address").alias("public"))


def url_policy(spark, sf_dir):
    return sample.table(spark, sf_dir, "pages").select("page_id", gate.is_fetchable("url", HOSTS).alias("fetchable"))


def topic_counts(spark, sf_dir):
    """Event types as topics, all events counted, those of small values upon the rest, with the number of documents that the next search of each may return."""
    events = sample.table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("large"))
    before = events.filter("large").groupBy("topic").agg(F.count(F.lit(1)).alias("count"))
    counts = topics.count_topics(before, events.filter("NOT large").select("topic"))
    return topics.with_limits(counts.select("topic", "count").withColumnRenamed("count", "searched"), counts).select("topic", "searched", F.col("n_docs").cast("long").alias("n_docs"))


def routes_by_outline(spark, sf_dir):
    """Customers as routes, written as an outline, in pieces, and read again."""
    k = F.col("c_custkey")
    step = F.struct(F.concat(F.lit("topic "), (k % 7).cast("string")).alias("topic"), F.array(F.concat(F.lit("a.example.org/"), k.cast("string"))).alias("links"))
    routes = sample.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), k.cast("string")).alias("key"), F.lit("for").alias("verdict"), F.lit(0.5).alias("for_share"), F.lit(0.25).alias("against_share"), F.lit(0.25).alias("neutral_share"),
        (k * 86400).cast("long").alias("t"), (k % 5).cast("int").alias("hits"), F.array_repeat(step, (k % 3).cast("int")).alias("steps"), k.cast("int").alias("place"),
    )
    counts = routes.groupBy(F.concat(F.lit("topic "), (F.col("place") % 7).cast("string")).alias("topic")).agg(F.count(F.lit(1)).alias("count"))
    read, _ = outline.parse(shared.stored(outline.pieces(routes, counts)))
    return outline.counted(read).select("key", "verdict", "for_share", "t", "hits", "n_steps", "n_links")


QUERIES = {
    "ip_policy": ip_policy, "url_policy": url_policy, "topic_counts": topic_counts, "outline_round_trip": routes_by_outline,
    "suffix_gate": suffix_gate, "doc_size_filter": doc_sizes, "sentence_split": sentence_split, "injection_filter": injection_filter, "token_stats": token_stats, "stem_sets": stem_sets, "idf_table": idf_table,
    "tfidf_topk": tfidf_topk, "clean_pages": clean_pages, "parse_report": parse_report, "ensemble_triples": ensemble, "qa_pairs": qa_pairs, "ingest_stats": ingest_stats, "documents_heard": heard, "resolve_quick": resolve_quick,
    "resolve_deliberated": deliberated, "resolve_replayed": replayed, "voices": voices, "resolve_long": resolve_long, "stream_ingest_upsert": stream_upsert,
}

_STEMS = f"stems AS MATERIALIZED (SELECT doc_id, {nlp.sql_stems('text')} AS stems FROM documents)"
_IDF = f"{_STEMS}, postings AS (SELECT doc_id AS doc, unnest(stems) AS stem FROM stems), idf AS (SELECT stem, count(*) AS df, ln(1 + (SELECT count(*) FROM documents) / count(*)::DOUBLE) AS idf FROM postings GROUP BY stem)"
_TRUST = "trust(suffix, trust) AS (VALUES " + ", ".join(f"('{h}', {t}::DOUBLE)" for h, t in TRUST) + ")"

_N = "list_transform(string_split(address, '.'), lambda x: x::INTEGER)"

SQL = {
    "ip_policy": f"""WITH e AS (SELECT event_id, concat_ws('.', user_id * 37 % 256, user_id * 101 % 256, event_id % 256, 1) AS address FROM events), n AS (SELECT *, {_N} AS n FROM e)
        SELECT event_id, address, NOT (n[1] IN (0, 10, 127) OR n[1] >= 224 OR (n[1] = 100 AND n[2] BETWEEN 64 AND 127) OR (n[1] = 169 AND n[2] = 254) OR (n[1] = 172 AND n[2] BETWEEN 16 AND 31) OR (n[1] = 192 AND n[2] = 168)
          OR (n[1] = 192 AND n[2] = 0 AND n[3] IN (0, 2)) OR (n[1] = 198 AND n[2] IN (18, 19)) OR (n[1] = 198 AND n[2] = 51 AND n[3] = 100) OR (n[1] = 203 AND n[2] = 0 AND n[3] = 113)) AS public FROM n""",
    "url_policy": f"SELECT page_id, regexp_matches(url, '^https://({'|'.join(h.replace('.', '[.]') for h in HOSTS)})(:443)?([/?#]|$)') AS fetchable FROM pages",
    "topic_counts": """WITH c AS (SELECT event_type AS topic, count(*) AS searched FROM events GROUP BY event_type) SELECT topic, searched, 3 + least(searched, 5) AS n_docs FROM c""",
    "outline_round_trip": """SELECT 'c' || c_custkey AS key, 'for' AS verdict, 0.5::DOUBLE AS for_share, (c_custkey * 86400)::BIGINT AS t, (c_custkey % 5)::INTEGER AS hits, (c_custkey % 3)::BIGINT AS n_steps, (c_custkey % 3)::BIGINT AS n_links FROM customer""",
    "suffix_gate": f"""WITH {_TRUST}, p AS (SELECT page_id, regexp_extract(url, '{HOST}', 1) AS host FROM pages)
        SELECT page_id, host, coalesce((SELECT arg_max(t.trust, length(suffix)) FROM trust t WHERE lower(host) = suffix OR ends_with(lower(host), '.' || suffix)), 0.0::DOUBLE) AS trust FROM p""",
    "doc_size_filter": "SELECT doc_id, strlen(text) AS n_bytes, strlen(text) <= 262144 AS fits FROM documents",
    "sentence_split": f"WITH s AS (SELECT doc_id, unnest({text.sql_parts('text')}) AS sentence FROM documents) SELECT doc_id, count(*) AS sentences, sum(length(sentence))::BIGINT AS chars FROM s GROUP BY doc_id",
    "injection_filter": f"WITH s AS (SELECT conv_id, turn, unnest({text.sql_parts('text')}) AS sentence FROM conversations) SELECT conv_id, turn, count(*) AS sentences, count(*) FILTER (WHERE {text.sql_is_directive('sentence')}) AS directive FROM s GROUP BY conv_id, turn",
    "token_stats": f"WITH t AS (SELECT doc_id, {nlp.sql_tokens('text')} AS t FROM documents) SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens FROM t",
    "stem_sets": f"WITH {_STEMS} SELECT doc_id, array_to_string(stems, ' ') AS stems FROM stems",
    "idf_table": f"WITH {_IDF} SELECT stem, df, round(idf, 9) AS idf FROM idf",
    "tfidf_topk": f"""WITH {_IDF}, asked AS (SELECT item_id AS query_id, unnest(list_distinct(list_transform({nlp.sql_stems('text')}, lambda w: {nlp.sql_stem('w')}))) AS stem FROM benchmark),
        scored AS (SELECT query_id, doc, round(sum(idf), 9) AS score FROM asked JOIN postings USING (stem) JOIN idf USING (stem) GROUP BY query_id, doc),
        placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc DESC) AS place FROM scored) SELECT query_id, doc, round(score, 6) AS score, place FROM placed WHERE place <= 5""",
    "documents_heard": f"""WITH trust(host, trust) AS (VALUES {", ".join(f"('src{k}', {0.4 + k / 40}::DOUBLE)" for k in range(15))}),
        admitted AS (SELECT doc_id, d.source, trust, substr(text, 1, {text.LONGEST}) AS text FROM documents d JOIN trust ON host = lower(d.source) WHERE strlen(text) <= 262144),
        {text.sql_clean_steps("admitted", "doc_id", "text")}, parted AS (SELECT doc_id, {text.sql_parts("text")} AS parts FROM cleaned),
        told AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE {text.sql_is_directive("part")}) AS directive FROM (SELECT doc_id, unnest(parts) AS part FROM parted) GROUP BY doc_id)
        SELECT a.doc_id AS doc, a.source || '.example.org/d' || a.doc_id AS source, round_even(trust * 255, 0)::INTEGER AS trust_q, coalesce(n, 0)::BIGINT AS sentences, coalesce(directive, 0)::BIGINT AS directive
        FROM admitted a LEFT JOIN told t ON t.doc_id = a.doc_id""",
    "clean_pages": f"""WITH {text.sql_clean_steps("pages", "page_id", "html")}, parted AS (SELECT page_id, text, {text.sql_parts("text")} AS parts FROM cleaned),
        told AS (SELECT page_id, count(*) FILTER (WHERE {text.sql_is_directive("part")}) AS dropped, count(*) AS n FROM (SELECT page_id, unnest(parts) AS part FROM parted) GROUP BY page_id)
        SELECT p.page_id, length(p.text)::BIGINT AS chars, (coalesce(n, 0) - coalesce(dropped, 0))::BIGINT AS sentences, coalesce(dropped, 0)::BIGINT AS dropped, sha256(p.text) AS sha256
        FROM parted p LEFT JOIN told t ON t.page_id = p.page_id""",
    "stream_ingest_upsert": """SELECT 'event ' || regexp_replace(lower(event_type), '[^a-z0-9]+', ' ', 'g') AS subject, CASE WHEN value > 50 THEN 'improve' ELSE 'reduce' END AS predicate, 'user ' || (user_id % 50) AS object,
        'u' || (user_id % 10) || '.example.org/e' AS source, max(epoch(ts))::DOUBLE AS added, max(user_id % 256)::INTEGER AS trust_q FROM events GROUP BY ALL""",
}
