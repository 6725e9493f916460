import math
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.llm import license_scan, line_dedup


def test_line_dedup(docs, documents):
    pages, lines = Counter(), Counter()
    for _, text, _, host, _ in documents:
        pages[host] += 1
        for x in set((text or "").split("\n")) if text is not None else ():
            lines[host, x] += 1
    bad = {k for k, n in lines.items() if n >= 3 and n > 0.1 * pages[k[0]] and k[1].strip(" ")}
    assert bad
    want = []
    for key, text, _, host, _ in documents:
        split = text.split("\n") if text is not None else []
        kept = [x for x in split if (host, x) not in bad]
        want.append((key, len(split), len(split) - len(kept), "\n".join(kept) if text is not None else None))
    got = line_dedup.drop_boilerplate(docs, ratio=0.1, min_pages=3)
    assert "id" in got.columns
    order = lambda r: (r[0], str(r))
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=order) == sorted(want, key=order)


def test_line_dedup_twin(spark, documents):
    unique = list({r[0]: r for r in documents}.values())
    rows = [(*r[:3], r[3] if r[0] % 9 else None, r[4]) for r in unique]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = line_dedup.drop_boilerplate(df).select("doc_id", "source", "n_lines", "n_dropped", "text").toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    want = con.sql(line_dedup.SQL).df()[got.columns]
    key = lambda d: sorted(map(tuple, d.astype(object).where(d.notna(), None).values.tolist()))
    assert key(got) == key(want)


def test_line_dedup_clashing_columns_and_long_lines(spark):
    long = "x" * 60_000
    rows = [(k, f"menu\n{long}\nstory {k}", None, "h", "k", "e", 1) for k in range(8)] + [(9, None, None, "h", "k", "e", 1), (9, "", None, "h", "k", "e", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, host_ string, keys_ string, kept_ string, n_lines int")
    got = {r["text"]: r for r in line_dedup.drop_boilerplate(df).collect()}
    assert {t for t in got} == {f"story {k}" for k in range(8)} | {None, ""}
    assert (got["story 3"]["n_lines"], got["story 3"]["n_dropped"], got["story 3"]["host_"], got[""]["n_lines"], got[None]["n_lines"]) == (3, 2, "h", 1, 0)


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower) if w]


def test_licence_base(docs, documents):
    want = []
    for key, text, *_ in documents:
        ws = words_of(text)
        found = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in found]
        want.append((key, len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    got = license_scan.scan(docs).collect()
    order = lambda r: (r[0], str(r))
    assert sorted((tuple(r)[:6] for r in got), key=order) == sorted(want, key=order)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under the Apache License, Version 2.0.", {"apache", "apache-2.0"}),
        ("Released under the MIT License.", {"mit"}),
        ("This work is licensed under the GNU General Public License, version 3", {"gpl", "gpl-3.0"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc-4.0"}),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", {"mit"}),
        ("mit license GNU GENERAL public License", {"mit", "gpl"}),
        ("submit licenses apache-licensed", set()),
        ("", set()),
        (None, set()),
    ],
)
def test_licence_labels(spark, text, labels):
    df = spark.createDataFrame([(1, text)] + [(k, f"plain words {k}") for k in range(2, 8)], "doc_id long, text string")
    row = license_scan.scan(df).filter("doc_id = 1").first()
    assert set(filter(None, row["labels"].split(","))) == labels
    assert (row["score"] > 0) == bool(labels)


@pytest.mark.parametrize("share", [1, 3])
def test_licence_of_many_files(spark, share):
    """A notice that a third of the files or all of them carry keeps its label."""
    notices = {t[0]: t[2] for t in reversed(license_scan.TEMPLATES) if t[0] in ("bsd", "mpl-2.0", "apache-2.0", "cc-by-nc-4.0")}
    for label, notice in notices.items():
        df = spark.createDataFrame([(k, f"plain words {k} " + (notice if k % share == 0 else "")) for k in range(12)], "doc_id long, text string")
        for row in license_scan.scan(df).collect():
            assert (label in row["labels"].split(",")) == (row["doc_id"] % share == 0)
            assert row["score"] == (1.0 if row["doc_id"] % share == 0 else 0.0)


def slow_templates(texts, rare=license_scan.RARE_WORDS):
    """Labels and best score of each text by loops over words."""
    split = [words_of(t) for t in texts]
    vocabulary = {w for _, _, wording in license_scan.TEMPLATES for w in wording.split()}
    idf = {w: math.log(1 + len(split) / n) for w in vocabulary if (n := sum(w in ws for ws in split))}
    out = []
    for ws in split:
        labels, best = set(), 0.0
        for label, phrase, wording in license_scan.TEMPLATES:
            own = wording.split()
            chosen = sorted((w for w in set(own) & set(ws)), key=lambda w: (-idf[w], w))[:rare]
            weight = sum(idf[w] for w in own if w in chosen)
            for begin in range(-len(own), len(ws)):
                votes = sum(idf[w] for k, w in enumerate(own) if w in chosen and 0 <= begin + k < len(ws) and ws[begin + k] == w)
                around = ws[max(0, begin - license_scan.SLACK) : max(0, begin + len(own))]
                share = round(min(1.0, votes / weight), 6) if weight else 0.0
                if share >= license_scan.LEAST and f" {phrase} " in f" {' '.join(around)} ":
                    labels.add(label)
                    best = max(best, share)
        out.append((labels, best))
    return out


def test_licence_templates(spark):
    """Against loops: notices with words put in, left out and swapped, several in a file, phrases out of place, long texts."""
    rng = random.Random(4)
    texts = [None, "", "mozilla public license " * 40, "x" * 30_000, "word " * 20_000 + license_scan.TEMPLATES[8][2]]
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 3)):
            words += [f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 30))]
            notice = rng.choice(license_scan.TEMPLATES)[2].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                k = rng.randrange(len(notice))
                notice[k : k + 1] = rng.choice([[], ["other", notice[k]], ["changed"]])
            words += notice + rng.choice([[], rng.choice(license_scan.TEMPLATES)[1].split()])
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("weight", F.lit("a clashing name")).repartition(3)
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    for k, (labels, best) in enumerate(slow_templates(texts)):
        base = set(filter(None, got[k]["base_labels"].split(",")))
        assert set(filter(None, got[k]["labels"].split(","))) == labels | base
        assert got[k]["score"] == pytest.approx(max(best, 0.5 if base else 0.0), abs=2e-6)
    assert sum(bool(x) for x, _ in slow_templates(texts)) > 40


@pytest.mark.parametrize("share", [1, 3])
def test_licence_twin_keeps_common_notices(spark, share):
    notices = [license_scan.TEMPLATES[k][2] for k in (8, 9, 7)]
    rows = [(k, f"plain words {k} " + (notices[k % 3] if k % share == 0 else "")) for k in range(24)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = con.sql(license_scan.twin()).df().sort_values("doc_id")
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().sort_values("doc_id")
    assert got["labels"].tolist() == want["labels"].tolist() and (got["labels"] != "").sum() == 24 // share


def test_empty_tables(no_docs):
    assert line_dedup.drop_boilerplate(no_docs).collect() == [] and license_scan.scan(no_docs).collect() == []
