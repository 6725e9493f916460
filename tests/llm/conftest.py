import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "the and ing er on th ed re at en".split(), "de": "der sch ung ü ß ein ich lich be ge".split(), "fr": "le de ou eau é que tion ai ment è".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def make_documents(seed=1, n=90):
    """Prose with copies, near copies, shared lines, licences, and null, empty and odd texts."""
    rng = random.Random(seed)
    shared, notices = [prose(rng, "en", 60) for _ in range(3)], ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0."]
    rows = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = "\n".join(prose(rng, lang, rng.randint(3, 40)) for _ in range(rng.randint(1, 5)))
        if k % 6 == 1:
            _, text, lang, *_ = rows[rng.randrange(len(rows))]
        elif k % 6 == 2:
            text, lang = text + "\n" + rng.choice(shared), lang if len(text) > 200 else "en"
        elif k % 6 == 3:
            text += "\n" + rng.choice(notices)
        elif k % 6 == 4:
            text = "Menu home about\n" + text
        rows.append((k, text, lang, f"src{k % 4}", len(text)))
    odd = [None, "", " ", "\n\n", "1 2 3 ...", "a", "A", "a b", "x" * 500, "ab" * 300, "Ünï 日本 😀 words", "\0 null \0 bytes", "the " * 120]
    rows += [(1000 + k, t, None, None, 0) for k, t in enumerate(odd)]
    rows.append(rows[5])  # a repeated row
    return rows


@pytest.fixture(scope="session")
def documents():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, documents):
    """The documents, with a column that the operators don't know."""
    df = spark.createDataFrame([(*r, "extra") for r in documents], COLUMNS + ", id string")
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
