"""Outlines of any size: pieces, lines dealt by ranges, and what ends up in one task."""

from pyspark.sql import functions as F

from assayer.functions import ranges
from assayer.plans import texts
from assayer.sources import outline


def test_pieces_cut_anywhere_read_as_the_whole(spark):
    lines = ["# outline v1", "## topics", "- tea :: 1", "## routes", "  - 1. lost", "- [1] a :: verdict=for for=0.500 against=0.200 neutral=0.300 t=5 hits=1", "    - loose.example.org/x", "  - 1. tea", "    - a.example.org/x", "other", "    - b.example.org/y",
             "  - 2. milk", "- [2] b :: verdict=against for=0.100 against=0.700 neutral=0.200 t=6 hits=0", "## other", "- [9] c :: verdict=for for=0.500 against=0.200 neutral=0.300 t=5 hits=1", "  - 1. none", "## routes", "    - c.example.org/z",
             "- [3] a :: verdict=neutral for=0.100 against=0.200 neutral=0.700 t=7 hits=3", "  - 1. sugar", "## topics", "- tea :: 4", "- milk :: 2"]
    want = [("b", "against", [], 1), ("a", "neutral", [("sugar", [])], 2)]
    for cut in (len(lines), 1, 3):
        parts = [(k, "\n".join(lines[k : k + cut]) + "\n") for k in range(0, len(lines), cut)]
        routes, topics = outline.parse(spark.createDataFrame(parts[::-1], "part long, text string").repartition(5))
        got = [(r["key"], r["verdict"], [(s["topic"], s["links"]) for s in r["steps"]], r["place"]) for r in routes.orderBy("place").collect()]
        assert got == want
        assert {tuple(r) for r in topics.collect()} == {("tea", 4), ("milk", 2)}
    routes, _ = outline.parse(spark.createDataFrame([("\n".join(lines[:13]),)], "text string"))
    assert [(s["topic"], s["links"]) for s in routes.filter("key = 'a'").first()["steps"]] == [("tea", ["a.example.org/x", "b.example.org/y"]), ("milk", [])]


def test_no_row_or_range_holds_the_outline(spark, monkeypatch):
    kept, stored, sizes = [], ranges.stored, []
    monkeypatch.setattr(texts.shared, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    monkeypatch.setattr(outline, "dealt", lambda *a: sizes.append(ranges.dealt(*a)) or sizes[-1])
    found = texts.routes_by_outline(spark, "/root/testdata/sf0.01")
    assert found.count() == 1500
    assert kept[0].agg(F.max(F.length("text"))).first()[0] < 500
    per = [r["count"] for r in sizes[0].groupBy(F.shiftright("at", ranges.PLACE_BITS)).count().collect()]
    assert len(per) >= 4 and max(per) < sum(per) / 2


def test_shrink_takes_what_the_text_says(spark):
    row = lambda k: (f"r{k}", "for", 0.5, 0.25, 0.25, k, k % 3, [(f"t{k}", [f"a.example.org/{k}"])], k)
    routes = spark.createDataFrame([row(k) for k in range(1, 24)], "key string, verdict string, for_share double, against_share double, neutral_share double, t long, hits int, steps array<struct<topic: string, links: array<string>>>, place int")
    topics = spark.createDataFrame([(f"t{k}", k) for k in range(12)], "topic string, count long")
    whole = len(outline.render(routes, topics).first()["text"])
    assert [df.count() for df in outline.shrink(routes, topics, whole)] == [23, 12]
    assert [df.count() for df in outline.shrink(routes, topics, whole - 1)] == [21, 12]
    fewer, _ = outline.shrink(routes, topics, whole - 1)
    assert {r["key"] for r in routes.join(fewer, "key", "left_anti").collect()} == {"r3", "r6"}
    none, few = outline.shrink(routes, topics, 80)
    assert none.isEmpty() and 0 < few.count() < 12 and len(outline.render(none, few).first()["text"]) <= 80
