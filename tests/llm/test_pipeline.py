import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from assayer.llm import decontaminate, language_id, queries, simhash
from assayer.llm.common import stored, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF).toPandas()
    want = con.sql(queries.oracle_sql()[name]).df()[got.columns]
    plain = lambda v: "" if pd.isna(v) else v if isinstance(v, str) else str(round(float(v), 6))
    assert sorted(map(tuple, got.map(plain).values.tolist())) == sorted(map(tuple, want.map(plain).values.tolist()))


def test_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 14))
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())


def test_stages(spark):
    """Each stage against what brute force says of its input."""
    docs = table(spark, SF, "documents")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], SF)))
    for df in kept[1:5]:
        assert df.dtypes == docs.dtypes
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in kept[:2])
    gone = [t for k, t in before.items() if k not in after]
    assert len(gone) <= 2 and all(not language_id.has_letter((t or "").encode()) or len(t) < 30 for t in gone)
    lines = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    assert lines.keys() == after.keys()
    assert all(set(t.split("\n")) <= set(after[k].split("\n")) for k, t in lines.items())
    prints = sorted((k, simhash.fingerprint(t.encode())) for k, t in lines.items())
    root = {k: k for k, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, (a, p) in enumerate(prints):
            for b, q in prints[:i]:
                if (p ^ q).bit_count() <= 2 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    single = {r["doc_id"]: r["text"] for r in kept[3].collect()}
    assert set(single) == {k for k in root if root[k] == k}
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    clean = {r["doc_id"] for r in kept[4].collect()}
    assert all(any(t in text for _, t in items) or decontaminate.Index(items).leaks(text) for k, text in single.items() if k not in clean)
    assert not any(t in single[k] for k in clean for _, t in items)
    assert {r["doc_id"] for r in kept[5].select("doc_id").distinct().collect()} == clean


def test_repeated_rows(spark):
    rows = [(1, "one two three four", "en", "a", 18), (1, "one two three four", "en", "a", 18), (2, "one two three four", "en", "a", 18), (None, "quite other words stand here", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, SF).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [1, None]


def test_ids_of_different_texts(spark):
    """A document goes for its own text's sake, not for that of another with its id; so do those without an id."""
    same, other = "one two three four five six", "a wholly different text of other words"
    rows = [(3, same), (5, same), (5, other), (5, other), (None, same), (None, "words that no other row has"), (None, "words that no other row has"), (7, None), (7, ""), (8, " ")]
    docs = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, SF).collect()
    assert sorted(((r["doc_id"], (r["text"] or "").strip()) for r in kept), key=str) == sorted([(3, same), (5, other), (None, "words that no other row has"), (7, "")], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        assert docs.count() == 0


def test_copies_survive_line_dedup(spark):
    """Of two large groups of copies one whole text each reaches packing, and a line of many distinct texts goes."""
    copied = ["amber rivers carry quiet stones\npast seven sleeping villages", "nobody counted lanterns along\nthat crooked northern harbour"]
    rows = [(k, copied[k % 2], "en", "a", 0) for k in range(12)]
    rows += [(100 + k, f"Menu home about\nstory number {k} tells of w{k}x and v{k}y with u{k}z", "en", "a", 0) for k in range(24)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stored(stage(spark, docs, SF))
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [kept.get(k) for k in range(12)] == copied + [None] * 10
    assert all("Menu" not in t for t in kept.values())
    assert {0, 1} <= {r["doc_id"] for r in corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()}


def test_near_copies_survive_line_dedup(spark):
    """Of six near copies one whole text stays; a menu line of all the others goes; a host of pages that are mostly menu keeps it."""
    lines = [f"line {k} of a long text about w{k}x" for k in range(40)]
    rows = [(k, "\n".join([*lines, f"copy number {k}"]), "en", "a", 0) for k in range(6)]
    rows += [(10 + k, "\n".join([*lines[:k], f"another line {k}", *lines[k + 1 :]]), "en", "a", 0) for k in range(6)]
    rows += [(100 + k, f"Menu home about\nstory number {k} tells of v{k}y\nand of z{k}", "en", "a", 0) for k in range(60)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_boilerplate_lines(spark, docs, SF).collect()}
    assert all(kept[k] == t for k, t, *_ in rows if k < 100)
    assert all(kept[k] == t.split("\n", 1)[1] for k, t, *_ in rows if k >= 100)


CLASHES = ["d", "k", "__key", "score", "lang_pred", "ambiguous", "leaks", "n_lines", "n_dropped", "text_key", "root", "own", "first", "lost", "component_id", "fingerprint", "print", "bytes", "host_"]


def test_columns_of_any_name_pass_through(spark):
    """Columns with the names that operators use inside or add stay as they are, value by value, in every stage but the last."""
    base = table(spark, SF, "documents").limit(60)
    docs = stored(base.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == [*base.columns, *CLASHES], name
        assert docs.count() and all(r[c] == f"{c} of {r['doc_id']}" for r in docs.collect() for c in CLASHES), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()
