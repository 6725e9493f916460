import pytest
from pyspark.sql import functions as F

from assayer.operators import claims, gate, ingest, resolve, score, search
from assayer.plans import library, texts
from assayer.sources import corpus, outline

SF = "/root/testdata/sf0.001"

# The prose that the voices below must give.
VOICE = "request_id int, pos int, stance string, subject string, predicate string, object string, host string, month string, trust double"


def voices(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], VOICE)


def test_prose(spark):
    spoken = voices(
        spark,
        (19, "neutral", "poor sleep", "impair", "memory", "journal.example.org", "1970-01", 0.9),
        (31, "for", "coffee", "improve", "memory", "journal.example.org", "2025-06", 0.9),
        (23, "against", "coffee", "not improve", "memory", "news.example.com", "2024-03", 0.5),
        (29, "for", "caffeine", "enhance", "alertness", "health.example.gov", "2025-01", 0.85),
    )
    assert claims.prose(spoken, ["request_id"]).first()["prose"] == (
        "According to journal.example.org in June 2025, coffee improves memory. Likewise, caffeine enhances alertness, health.example.gov confirms in January 2025. "
        "However, a lower-trust source, news.example.com in March 2024, claims that coffee does not improve memory. For context, poor sleep impairs memory, journal.example.org confirms."
    )


def test_prose_parts_areas_and_long_paragraphs(spark):
    two = voices(spark, (40, "for", "tea", "improve", "focus", "a.example.org", "2025-06", 0.9), (31, "against", "sugar", "harm", "teeth", "b.example.org", "2025-05", 0.9))
    _, second = claims.prose(two, ["request_id"]).first()["prose"].split("\n\n")
    assert second.startswith("Sugar harms teeth, b.example.org confirms")
    many = voices(spark, *[(31 - k, "for", f"topic{k}", "improve", "thing", "a.example.org", "2025-06", 0.9) for k in range(7)])
    assert claims.prose(many, ["request_id"]).first()["prose"].count("\n\n") == 1


@pytest.mark.parametrize(
    "predicate, subject, wanted",
    [("improve", "tea", "improves"), ("improve", "studies", "improve"), ("not improve", "tea", "does not improve"), ("not improve", "sales", "do not improve"), ("is", "tea", "is"), ("not is", "nutrients", "are not"), ("has", "sales", "have"), ("not has", "virus", "does not have"), ("worry", "physics", "worries"), ("delay", "analysis", "delays"), ("watch", "class", "watches")],
)
def test_verbs(spark, predicate, subject, wanted):
    df = spark.createDataFrame([(predicate, subject)], "p string, s string")
    assert df.select(claims.agreeing(F.col("p"), claims.is_plural(F.col("s")))).first()[0] == wanted


def test_when(spark):
    df = spark.createDataFrame([("2025-09",), ("1970-01",), ("bad",), ("2025-13",), (None,)], "m string")
    assert [r[0] for r in df.select(claims.when("m")).collect()] == [" in September 2025", "", "", "", ""]


def test_answers_from_the_library(spark):
    asked, out = texts._outcome(spark, SF)
    rows = {r["claim_id"]: r for r in texts.quick_answers(asked, out).collect()}
    assert rows[101]["verdict"] == "for" and rows[101]["for_share"] >= 0.6
    assert rows[203]["verdict"] == "against"
    told = {r["request_id"]: r for r in texts.long_answers(texts._asked(spark, SF), asked, out).collect()}
    assert "rumour" not in told[1]["prose"] and told[1]["numbered"].split(".")[0] == "31"
    assert told[3]["prose"] == claims.NOTHING_SAID
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert len(told) == len(library.REQUESTS) + items.count()
    of_items = [k for k in rows if k > 1_000_000]
    assert of_items and all(rows[k]["rounds"] >= 1 for k in of_items)
    assert {k // 100 for k in rows} <= set(told)


def test_saved_routes_answer_at_once(spark):
    asked = claims.parse(spark.createDataFrame([(1, "Walks improve mood.")], "request_id int, text string")).withColumn("claim_id", F.col("request_id"))
    found = resolve.Library.of(library.docs(spark), library.trust(spark))
    first = resolve.resolve(asked, found, resolve.empty_memory(spark), library.NOW)
    again = resolve.resolve(asked, found, first.memory, library.NOW, first.counts, asked.select("key"))
    assert again.rounds.first()["rounds"] == 0
    assert again.verdicts.first()["verdict"] == first.verdicts.first()["verdict"] == "for"
    assert first.memory.filter("hits > 0").count() == min(12, first.evidence.count())


def test_session_replays_what_it_has_resolved(spark):
    """The second time, resolved claims are answered by their routes, which count it; the others are searched again and their routes replaced."""
    asked = claims.parse(spark.createDataFrame([(1, "Walks improve mood."), (2, "Walks improve mood."), (3, "Stone circles improve weather.")], "request_id int, text string")).withColumn("claim_id", F.col("request_id"))
    found = resolve.Library.of(library.docs(spark), library.trust(spark))
    got = {r["claim_id"]: r for r in texts.replays(asked, found).collect()}
    assert {k: (r["resolved"], r["rounds_first"] > 0, r["rounds"] > 0) for k, r in got.items()} == {1: (True, True, False), 2: (True, True, False), 3: (False, True, True)}
    assert {k: r["hits"] for k, r in got.items()} == {1: 1, 2: 1, 3: 1}
    assert all(0 < r["n_steps"] <= 32 for r in got.values())


def test_reflection_of_a_claim_does_not_depend_on_others(spark):
    """A claim's cycles and shares are the same alone and beside claims about other things that go on longer or end before."""
    found = resolve.Library.of(library.docs(spark), library.trust(spark))
    texts_ = ["Walks improve mood.", "Noise impairs sleep.", "Pebbles improve rivers."]

    def outcome(lines):
        asked = claims.parse(spark.createDataFrame(lines, "request_id int, text string")).withColumn("claim_id", F.col("request_id"))
        out = resolve.resolve(asked, found, resolve.empty_memory(spark), library.NOW, cycles=5)
        return {r["claim_id"]: (r["cycles"], round(r["for_share"], 9)) for r in out.cycles.join(out.verdicts, "claim_id").collect()}

    together = outcome(list(enumerate(texts_)))
    assert max(n for n, _ in together.values()) >= 1
    for k in (0, 2):
        assert outcome([(k, texts_[k])]) == {k: together[k]}


def test_ingest_counts(spark):
    docs, trust = library.docs(spark), library.trust(spark)
    tried = ingest.attempts(docs, trust)
    row = ingest.stats(docs, trust, tried).first()
    assert (row["docs"], row["rejected_docs"], row["dropped"]) == (13, 1, 1)
    said = {tuple(r) for r in tried.filter("valid").select("subject", "predicate", "object", "source").collect()}
    assert ("long naps", "not is", "harmful", "press.example.net/naps") in said
    assert not any(s.startswith("rumour") for *_, s in said)


def test_empty_inputs(spark):
    docs = library.docs(spark).limit(0)
    assert ingest.attempts(docs, library.trust(spark)).count() == 0
    asked = spark.createDataFrame([(1, ["a"], ["b"], 1)], "claim_id int, s array<string>, o array<string>, pol int")
    out = score.evaluate(asked, resolve.empty_memory(spark), 0.0).first()
    assert out["for_share"] == pytest.approx(1 / 3) and out["verdict"] == "unresolved"


def test_gate(spark):
    trust = spark.createDataFrame([("example.org", 0.5), ("a.example.org", 0.9)], "host string, trust double")
    docs = spark.createDataFrame([("A.example.org/x", "t"), ("b.example.org", "t"), ("example.com/x", "t"), ("b.a.example.org/x", "x" * 262145), (None, "t")], "locator string, text string")
    got = sorted((r["trust"], r["admitted"]) for r in gate.admit(docs, trust).collect())
    assert got == [(0.0, False), (0.0, False), (0.5, True), (0.9, False), (0.9, True)]


def test_addresses(spark):
    ips = {"8.8.8.8": True, "10.0.0.1": False, "172.20.1.1": False, "192.168.0.1": False, "127.0.0.1": False, "169.254.1.1": False, "100.64.0.1": False, "224.0.0.1": False, "93.184.216.34": True, "1.2.3": False, "x": False, "256.1.1.1": False}
    ips |= {"2606:4700:4700::1111": True, "2001:DB8::1": True, "::ffff:8.8.8.8": True, "::ffff:808:808": True, "1:2:3:4:5:6:7:8": True, "1:2:3:4:5:6:8.8.4.4": True, "64:ff9b::8.8.8.8": True}
    ips |= dict.fromkeys(["::", "::1", "fe80::1", "fec0::1", "fc00::1", "fd12:3456::1", "ff02::1", "::ffff:127.0.0.1", "::ffff:10.0.0.1", "::ffff:a00:1", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:::2", ":1:2:3:4:5:6:7", "g::1", "12345::1", "::ffff:300.1.1.1", ":"], False)
    df = spark.createDataFrame([(k,) for k in ips], "a string")
    assert {r["a"]: r["p"] for r in df.select("a", gate.is_public_ip("a").alias("p")).collect()} == ips
    urls = {"https://a.org/x": True, "http://a.org/x": False, "https://u@a.org/x": False, "https://a.org:444/": False, "https://b.org/": False, "https://a.org.evil.com/": False, "bad": False}
    df = spark.createDataFrame([(k,) for k in urls], "u string")
    assert {r["u"]: r["p"] for r in df.select("u", gate.is_fetchable("u", ["a.org"]).alias("p")).collect()} == urls


def test_search_prefers_late_documents_on_ties(spark):
    docs = spark.createDataFrame([(0, "tea focus"), (1, "tea"), (2, "tea"), (3, "milk")], "doc long, text string")
    asked = spark.createDataFrame([(1, "tea focus")], "query_id int, query string")
    assert [r["doc"] for r in search.top_documents(asked, search.index(docs), 4, 3).orderBy("place").collect()] == [0, 2, 1]


def test_areas(spark):
    rows = [(1, k, [s], [o]) for k, (s, o) in enumerate([("a", "b"), ("b", "c"), ("d", "e"), ("f", "g"), ("h", "i"), ("j", "k")], 1)]
    df = spark.createDataFrame(rows, "request_id int, place int, s array<string>, o array<string>")
    got = claims.with_areas(df).toPandas()
    assert got["area"].nunique() == 4 and len(got) == 6
    assert got[got.place == 1].area.item() == got[got.place == 2].area.item()


def test_corpus_file(spark, tmp_path):
    path = tmp_path / "corpus.json"
    path.write_text('{"trust": {"a.example.org": 0.9},\n "docs": [{"locator": "a.example.org/x", "added": "2025-09-01", "text": "Tea improves focus."}]}')
    docs, trust = corpus.read_corpus(spark, str(path))
    assert [tuple(r) for r in docs.collect()] == [(0, "a.example.org/x", "Tea improves focus.", 1756684800.0)]
    assert trust.first()["trust"] == 0.9


def test_responses(spark):
    body = '{"query": {"pages": [{"title": "Tea & milk", "extract": "Tea is good.", "touched": "2025-09-01T12:00:00Z"}, {"title": "Blank", "extract": " "}]}}'
    wiki = corpus.parse_wiki(spark.createDataFrame([(body,), ("bad",)], "body string"), "en.example.org").collect()
    assert [tuple(r) for r in wiki] == [("en.example.org/wiki/Tea___milk", "Tea is good.", 1756728000.0)]
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1234.5v1</id><title>A\n title</title><summary> Tea  helps. </summary><published>2025-09-01T12:00:00Z</published></entry><entry><id>http://other/1</id><title>x</title><summary>y</summary></entry></feed>'
    found = corpus.parse_preprints(spark.createDataFrame([(atom,), ("<!DOCTYPE x>" + atom,)], "body string")).collect()
    assert [tuple(r) for r in found] == [("arxiv.org/abs/1234.5v1", "A title. Tea helps.", 1756728000.0)]


def test_outline_round_trip(spark):
    text = "# outline v1\n## topics\n- green tea :: 3\n- tea :: 1\n## routes\n- [1] focu tea :: verdict=for for=0.710 against=0.120 neutral=0.170 t=1727600000 hits=2\n  - 1. green tea\n    - a.example.org/x\n    - b.example.org/y\n  - 2. -\n"
    routes, topics = outline.parse(spark.createDataFrame([(text,)], "text string"))
    assert outline.render(routes, topics).first()["text"] == text
    row = outline.counted(routes).first()
    assert (row["n_steps"], row["n_links"]) == (2, 2)
    assert outline.render(*outline.shrink(routes, topics, 40)).first()["text"] == "# outline v1\n## topics\n## routes\n"
    saved = outline.save_route(routes, routes.withColumn("verdict", F.lit("against")))
    assert [(r["verdict"], r["hits"]) for r in saved.collect()] == [("against", 3)]
    assert outline.mark_hits(routes, routes.select("key")).first()["hits"] == 3
