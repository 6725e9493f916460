import random
import tracemalloc

import pytest

from assayer.llm import decontaminate
from assayer.llm.decontaminate import Index


def edited(rng, text, edits):
    s = list(text)
    for _ in range(edits):
        k = rng.randrange(len(s))
        s[k : k + rng.choice([0, 1])] = rng.choice([[], ["z"], ["q", "w"]]) if rng.random() < 0.7 else []
    return "".join(s)


def distance(a, text):
    """The least edits between a and a passage of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(rng.randint(4, 25)))) for k in range(8)] + [(50, "abc"), (51, "")]
    index = Index(items)
    for _ in range(25):
        text = " ".join(word() for _ in range(rng.randint(5, 40)))
        for k in rng.sample(range(8), rng.randint(0, 2)):
            text = text + " " + edited(rng, items[k][1], rng.choice([0, 1, 3, 6, 12])) + " " + word()
        found = {x["item_id"]: x for x in index.leaks(text)}
        lower = "".join(chr(c) for c in decontaminate.letters(text))
        for (key, item), t, e in zip(sorted((i, t) for i, t in items if t), index.texts, index.edits, strict=True):
            best = distance("".join(map(chr, t)), lower)
            assert (key in found) == (best <= e if len(t) >= decontaminate.Q else item in lower), (item, text)
            if key in found:
                x = found[key]
                assert x["edits"] >= best and distance("".join(map(chr, t)), lower[x["start"] : x["end"]]) <= e


def test_documents(docs, documents, spark):
    passage = next(r[1].split("\n")[-1] for r in documents if r[1] and r[0] % 6 == 2 and r[0] < 90)
    bench = spark.createDataFrame([(7, passage), (8, None), (9, ""), (10, "nowhere to be found in any of the documents")], "item_id long, text string")
    rows = decontaminate.mark(docs, bench).collect()
    assert len(rows) == len(documents) and all(r["id"] == "extra" for r in rows)
    assert {r["doc_id"] for r in rows if r["leaks"]} == {r[0] for r in documents if r[1] and passage in r[1]}
    blocks = decontaminate.mark(docs, bench, most=1).collect()
    assert sorted((r["doc_id"], str(r["leaks"])) for r in blocks) == sorted((r["doc_id"], str(r["leaks"])) for r in rows)


def test_every_place_of_a_repeated_item():
    item = "one two three four five six seven"
    index = Index([(1, item), (2, "ab" * 2000), (3, "ab" * 30)])
    text = " and ".join([item, item.replace("three", "thre"), "other words", item])
    assert [(x["item_id"], x["edits"]) for x in index.leaks(text)] == [(1, 0), (1, 1), (1, 0)]
    periodic = "ab" * 8000
    tracemalloc.start()
    leaks = index.leaks(periodic)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert [x["item_id"] for x in leaks].count(2) == 4 and {x["edits"] for x in leaks if x["item_id"] == 2} == {0}
    assert [x["item_id"] for x in leaks].count(3) == 16_000 // 60


@pytest.mark.parametrize("seed", range(3))
def test_counts_in_bounded_memory_are_the_same(monkeypatch, seed):
    rng = random.Random(seed)
    items = [(k, " ".join(rng.choice(["ab", "abab", "tea cup", "xyz"]) for _ in range(rng.randint(3, 60)))) for k in range(12)]
    texts = [" ".join(rng.choice(["ab", "abab", "tea cup", "w"]) for _ in range(rng.randint(20, 300))) + items[k][1] for k in range(12)]
    index = Index(items)
    whole = [index.bands(decontaminate.q_grams(decontaminate.letters(t))) for t in texts]
    for pairs in (1, 50, 4000):
        monkeypatch.setattr(decontaminate, "PAIRS", pairs)
        assert [index.bands(decontaminate.q_grams(decontaminate.letters(t))) for t in texts] == whole


def test_short_items_and_long_texts():
    index = Index([(1, "abc"), (2, "bcd"), (3, "abc"), (4, "A B"), (5, "x" * 40)])
    found = index.leaks("zabcd a\nb abc")
    assert [(x["item_id"], x["start"]) for x in found] == [(1, 1), (1, 10), (2, 2), (3, 1), (3, 10), (4, 6)]
    assert [(x["item_id"], x["start"], x["end"]) for x in index.leaks("y" * 200_000 + "x" * 40 + "y" * 10)] == [(5, 200_000, 200_040)]


def test_clashing_columns(spark):
    bench = spark.createDataFrame([(1, "a passage of some words"), (2, "another passage of more words")], "item_id long, text string")
    rows = [(1, "so: a passage of some words and another passage of more words", "x", "y", "z"), (None, None, "x", "y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, before string, __text string, leaks string")
    got = sorted(decontaminate.mark(df, bench, most=1).collect(), key=str)
    assert [(r["before"], r["__text"], len(r["leaks"])) for r in got] == [("x", "y", 2), ("x", "y", 0)]


def test_blocks_leave_no_index_behind(spark, docs, documents, monkeypatch):
    """Many blocks give the rows of one, items in the order of the blocks, and each index is taken back before the next is made."""
    passage = next(r[1].split("\n")[-1] for r in documents if r[1] and r[0] % 6 == 2 and r[0] < 90)
    bench = spark.createDataFrame([(k, passage if k % 3 == 0 else f"item number {k} that stands nowhere in them") for k in range(9)], "item_id long, text string").coalesce(1)
    held, most, made = [0], [0], type(spark.sparkContext.broadcast(0))
    class Counted(made):
        def destroy(self, *args):
            held[0] -= 1
            super().destroy(*args)
    def broadcast(value, of=spark.sparkContext.broadcast):
        out = of(value)
        if isinstance(value, Index):
            held[0] += 1
            most[0] = max(most[0], held[0])
            out.__class__ = Counted
        return out
    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    whole = {(r["doc_id"], str(sorted(r["leaks"]))) for r in decontaminate.mark(docs, bench).collect()}
    held[0] = most[0] = 0
    parts = decontaminate.mark(docs, bench, most=1).collect()
    assert most[0] == 1 and held[0] == 0
    assert {(r["doc_id"], str(sorted(r["leaks"]))) for r in parts} == whole and len(parts) == len(documents)
    assert all([x["item_id"] for x in r["leaks"]] == sorted(x["item_id"] for x in r["leaks"]) for r in parts)


def test_case_and_space():
    index = Index([(1, "The Quick brown fox jumps over the lazy dog")])
    (leak,) = index.leaks("xx THE quick\nbrown fox jumps over the lazy DOG yy")
    assert (leak["start"], leak["end"], leak["edits"]) == (3, 46, 0)


def test_empty_tables(no_docs, docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.mark(docs, none).filter("size(leaks) > 0").count() == 0
    assert decontaminate.mark(no_docs, none).collect() == []
