"""Licence scan by a positional index of rare licence words.

For each template, a file looks up those of the template's words that it holds and that have the highest inverse document
frequency in the corpus, however common. Postings are intersected by relative position: each hit votes for the place where
the template would begin in the file. A template is found where the votes of one place carry enough of the weight of what
was looked up and its mandatory phrase stands inside the template as placed there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import LOWER, UPPER, ascii_lower, stored, table

#: Phrases of the base labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Fixed values: (label, mandatory phrase, wording) of well-known licence notices.
TEMPLATES = [
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache org licenses license 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3.0", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2", "this program is free software licensed under the gnu general public license version 2"),
    ("gpl-or-later", "either version", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "licensed under cc by nc 4 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
]
#: Rare words that a file looks up for a template, the least score, and how many words before its place the mandatory phrase may begin.
RARE_WORDS, LEAST, SLACK = 8, 0.5, 8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS, -1), "")


def _places(column: str, phrase: str) -> str:
    """SQL for the array of words from 0 at which phrase stands in the array column."""
    tests = " AND ".join(f"get({column}, i + {k}) = '{w}'" for k, w in enumerate(phrase.split()))
    return f"filter(sequence(0, greatest(size({column}) - 1, 0)), i -> coalesce({tests}, false))"


def _postings() -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {}
    for t, (_, _, wording) in enumerate(TEMPLATES):
        for pos, w in enumerate(wording.split()):
            found.setdefault(w, []).append((t, pos))
    return found


def _rare(order: list[str], weight: dict[str, float], most: int) -> tuple[Column, Column]:
    """Of a file's held words, the rank of the last that it looks up for a template, and the weight of those looked up.

    `order` has the template's words from the rarest on, so what is looked up is a prefix of what the file holds of it.
    """
    if not order:
        return F.lit(-1), F.lit(0.0)
    words = F.array(*[F.lit(w) for w in order])
    first = F.slice(F.array_intersect(words, F.col("held")), 1, most)
    weights = F.array(*[F.lit(weight[w]) for w in order])
    rank = lambda w: (F.array_position(words, w) - 1).cast("int")
    return F.coalesce(F.array_max(F.transform(first, rank)), F.lit(-1)), F.aggregate(first, F.lit(0.0), lambda total, w: total + F.get(weights, rank(w)))


def scan(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare_words: int = RARE_WORDS, least: float = LEAST) -> DataFrame:
    """One row per file: id, n_words, n_base, first_word, last_word, base_labels, labels, score, templates.

    For a template, a file looks up the `rare_words` of the words of both that have the highest idf in all files (ties by
    word). The score at a place is the idf of the lookups that stand where the template has them, over the idf of all the
    places that the template has for them; labels need `least` and the mandatory phrase in the template's own words from
    SLACK before the place to its end. score is the best template's, 0.5 where only base phrases stand, else 0. A null
    or empty text has no words and no labels; repeated rows each get their row; other columns are left out.
    """
    postings = _postings()
    vocabulary = F.array(*[F.lit(w) for w in sorted(postings)])
    keyed = files.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"))
    held = F.array_intersect("words", vocabulary)
    marks = F.array(*[F.lit(w) for w in sorted({p.split()[0] for p in BASE} | {m.split()[0] for _, m, _ in TEMPLATES})])
    seen = stored(keyed.select(F.monotonically_increasing_id().alias("row"), "id", F.size("words").cast("long").alias("n_words"), held.alias("held"), F.when(F.arrays_overlap("words", marks), F.col("words")).alias("words")))
    # The vocabulary has a fixed length, so its document frequencies are a bounded result.
    counts = {r["word"]: r["n"] for r in seen.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = max(1, seen.count())
    return _label(seen, {w: math.log(1 + total / n) for w, n in counts.items()}, rare_words, least)


def _found(seen: DataFrame, idf: dict[str, float], rare_words: int, least: float) -> DataFrame:
    """(row, own, best, templates) of the rows in which templates are found."""
    spark = seen.sparkSession
    split, phrases = [wording.split() for _, _, wording in TEMPLATES], [phrase.split() for _, phrase, _ in TEMPLATES]
    order = [sorted((w for w in set(ws) if w in idf), key=lambda w: (-idf[w], w)) for ws in split]
    rank = {(t, w): n for t, ws in enumerate(order) for n, w in enumerate(ws)}
    rare = [_rare(ws, {w: idf[w] * split[t].count(w) for w in ws}, rare_words) for t, ws in enumerate(order)]
    # The lookups are written, so that they are worked out once a file and not once a word.
    some = stored(seen.filter(F.col("words").isNotNull()).select("row", "words", F.array(*[upto for upto, _ in rare]).alias("upto"), F.array(*[w for _, w in rare]).alias("weight")))
    index = [(w, False, t, pos, rank[t, w], idf[w]) for t, ws in enumerate(split) for pos, w in enumerate(ws) if w in idf]
    index += [(w, True, t, pos, -2, 1.0) for t, ws in enumerate(phrases) for pos, w in enumerate(ws)]
    posted = F.broadcast(spark.createDataFrame(index, "word string, phrase boolean, template int, pos int, rank int, idf double"))  # as many rows as the templates have words
    names = F.broadcast(spark.createDataFrame([(t, x[0], len(split[t]), len(phrases[t])) for t, x in enumerate(TEMPLATES)], "template int, label string, size int, words int"))
    hits = some.select("row", "upto", "weight", F.posexplode("words").alias("at", "word")).join(posted, "word").filter(F.col("rank") <= F.get("upto", F.col("template")))
    votes = hits.groupBy("row", "template", "phrase", (F.col("at") - F.col("pos")).alias("begin")).agg(F.sum("idf").alias("votes"), F.first(F.get("weight", F.col("template"))).alias("weight"))
    share = F.round(F.least(F.lit(1.0), F.col("votes") / F.col("weight")), 6)
    met = votes.join(names, "template").withColumn("share", F.when(~F.col("phrase"), share)).filter(F.when(F.col("phrase"), F.col("votes") == F.col("words")).otherwise(F.col("share") >= least))
    met = stored(met.select("row", "template", "label", "size", "words", "phrase", "begin", "share"))
    said = met.filter("phrase").select("row", "template", F.col("begin").alias("from"), (F.col("begin") + F.col("words")).alias("to"))
    inside = (F.col("from") >= F.col("begin") - SLACK) & (F.col("to") <= F.col("begin") + F.col("size"))
    sure = met.filter("NOT phrase").join(said, ["row", "template"]).filter(inside).groupBy("row", "template", "label").agg(F.max("share").alias("share"))
    return stored(sure.groupBy("row").agg(F.array_sort(F.collect_set("label")).alias("own"), F.max("share").alias("best"), F.count(F.lit(1)).alias("templates")))


def _label(seen: DataFrame, idf: dict[str, float], rare_words: int, least: float) -> DataFrame:
    base = [F.expr(_places("words", p)) for p in BASE]
    row = seen.withColumns({f"b{k}": F.when(F.col("words").isNotNull(), b).otherwise(F.array().cast("array<int>")) for k, b in enumerate(base)})
    places = F.concat(*[F.col(f"b{k}") for k in range(len(base))])
    row = row.withColumn("places", places).withColumn("base", F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"b{k}") > 0, F.lit(x)) for k, x in enumerate(BASE.values())]))))
    if idf:
        row = row.join(_found(seen, idf, rare_words, least), "row", "left")
    else:
        row = row.withColumns({"own": F.lit(None).cast("array<string>"), "best": F.lit(None).cast("double"), "templates": F.lit(None).cast("long")})
    own = F.coalesce("own", F.array().cast("array<string>"))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("places") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return row.select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"), score.alias("score"), F.coalesce("templates", F.lit(0)).cast("long").alias("n_templates"),
    )


def op10(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def twin() -> str:
    """The query in DuckDB's SQL."""
    every = [(t, pos, w) for t, (_, _, wording) in enumerate(TEMPLATES) for pos, w in enumerate(wording.split())]
    base = [(p, label, len(p.split())) for p, label in BASE.items()]
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return f"""
WITH templates(t, label, phrase, size) AS (VALUES {_values([(t, x[0], x[1], len(x[2].split())) for t, x in enumerate(TEMPLATES)])}),
postings(t, place, word) AS (VALUES {_values(every)}),
base(phrase, label, size) AS (VALUES {_values(base)}),
files AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex({lower}, '{SEPARATORS}'), lambda x: x <> '') AS words FROM documents),
tokens AS MATERIALIZED (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM files),
places AS (
  SELECT k.doc_id, k.pos, b.label FROM base b JOIN tokens k ON k.word = split_part(b.phrase, ' ', 1) JOIN files f ON f.doc_id = k.doc_id
  WHERE array_to_string(f.words[k.pos + 1 : k.pos + b.size], ' ') = b.phrase),
found AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY doc_id),
counts AS (SELECT word, count(DISTINCT doc_id) AS n FROM tokens WHERE word IN (SELECT word FROM postings) GROUP BY word),
idf AS (SELECT word, ln(1 + (SELECT count(*) FROM files) / n::DOUBLE) AS idf FROM counts),
held AS (SELECT DISTINCT k.doc_id, k.word FROM tokens k JOIN idf USING (word)),
sized AS (SELECT t, word, count(*) AS places FROM postings GROUP BY t, word),
ordered AS (SELECT h.doc_id, s.t, s.word, i.idf, s.places, row_number() OVER (PARTITION BY h.doc_id, s.t ORDER BY i.idf DESC, s.word) AS nth FROM held h JOIN sized s USING (word) JOIN idf i USING (word)),
chosen AS (SELECT * FROM ordered WHERE nth <= {RARE_WORDS}),
weights AS (SELECT doc_id, t, sum(idf * places) AS weight FROM chosen GROUP BY doc_id, t),
votes AS (
  SELECT k.doc_id, c.t, k.pos - p.place AS begin, sum(c.idf) AS votes FROM tokens k JOIN chosen c ON c.doc_id = k.doc_id AND c.word = k.word
  JOIN postings p ON p.t = c.t AND p.word = c.word GROUP BY ALL),
placed AS (SELECT v.doc_id, v.t, v.begin, round(least(1.0, votes / weight), 6) AS share FROM votes v JOIN weights w ON w.doc_id = v.doc_id AND w.t = v.t),
sure AS (
  SELECT b.doc_id, b.t, label, max(share) AS share FROM placed b JOIN templates m ON m.t = b.t JOIN files f ON f.doc_id = b.doc_id
  WHERE share >= {LEAST} AND contains(' ' || array_to_string(f.words[greatest(0, b.begin - {SLACK}) + 1 : b.begin + m.size], ' ') || ' ', ' ' || phrase || ' ') GROUP BY ALL),
own AS (SELECT doc_id, list_sort(list(DISTINCT label)) AS labels, max(share) AS best, count(*) AS n FROM sure GROUP BY doc_id)
SELECT f.doc_id, len(f.words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(d.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(d.labels, []), coalesce(o.labels, [])))), ','), '') AS labels,
  greatest(coalesce(o.best, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score, coalesce(o.n, 0)::BIGINT AS n_templates
FROM files f LEFT JOIN found d ON d.doc_id = f.doc_id LEFT JOIN own o ON o.doc_id = f.doc_id
"""
