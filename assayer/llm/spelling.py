"""Spelling variants: words one code point apart, found by groups and not by pairs.

Words that differ in one replaced code point share a (position, prefix, suffix); such a group keeps its size and its two
foremost words, from which each member's share follows. A word with a code point less is looked up in the vocabulary.
Words are known by their rank (most frequent first, then code-point order), so the foremost word is the least number.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import LOWER, UPPER, arrow_batches, crc32_sql, keyed_bytes, rows, stored, table
from assayer.functions.ranges import running

LEAST_LENGTH, LEAST_COUNT, FACTOR, MODULUS = 6, 5, 5, 199
#: The code points of words, A-Z lower-cased; they bound a group of replacements by 90 words.
LETTERS = "a-zÀ-ÿ"
#: Words a task holds before it passes its counts on, in words and code points.
HELD_WORDS, HELD_LETTERS = 300_000, 20_000_000
#: Longer words are keyed by a polynomial over a prime field in place of their letters, so that a word's keys grow as its length.
LONG, PRIME, BASE = 64, 2**127 - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835
WILD, SHORTER, ITSELF = 0, 1, 2

_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_KEYS = pa.schema([("kind", pa.int8()), ("key", pa.string()), ("rank", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch], least: int = LEAST_LENGTH, modulus: int = MODULUS) -> Iterator[pa.RecordBatch]:
    """Counts of words in (id, text as bytes), each document's runs counted first; a word can come more than once."""
    run = re.compile(f"[{LETTERS}]{{{least},}}")  # shorter runs give no word

    def counts():
        held: Counter = Counter()
        letters = 0
        for key, raw in rows(batches, "id", "text"):
            start = zlib.crc32(f"{'' if key is None else key}:".encode())
            for word, n in Counter(run.findall(raw.lower().decode("utf-8", "replace"))).items():
                h = zlib.crc32(word.encode(), start)
                if h % modulus == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < least:
                        continue
                if word not in held:
                    letters += len(word)
                held[word] += n
            if len(held) > HELD_WORDS or letters > HELD_LETTERS:
                yield from held.items()
                held, letters = Counter(), 0
        yield from held.items()

    return arrow_batches(counts(), _COUNTS, 20_000)


def _long_keys(word: str, shorter: bool) -> Iterator[tuple[int, str]]:
    """Keys of a long word from its polynomial: each costs a few multiplications, whatever the length."""
    powers, prefixes = [1], [0]
    for c in word:
        prefixes.append((prefixes[-1] + ord(c) * powers[-1]) % PRIME)
        powers.append(powers[-1] * BASE % PRIME)
    whole, back = prefixes[-1], pow(BASE, -1, PRIME)
    yield ITSELF, f"{len(word)}#{whole:x}"
    for at, c in enumerate(word):
        yield WILD, f"{len(word)}*{at}*{(whole - ord(c) * powers[at]) % PRIME:x}"
        if shorter and (at == 0 or c != word[at - 1]):
            left = (prefixes[at] + (whole - prefixes[at + 1]) * back) % PRIME
            yield SHORTER, f"{len(word) - 1}#{left:x}" if len(word) - 1 > LONG else word[:at] + word[at + 1 :]


def _keyed(batches: Iterator[pa.RecordBatch], least: int = LEAST_LENGTH) -> Iterator[pa.RecordBatch]:
    """(kind, key, rank): each word with a wildcard at each place, with each code point left out (once where they are alike), and itself."""

    def keys():
        for word, rank in rows(batches, "word", "rank"):
            shorter = len(word) > least
            if len(word) > LONG:
                yield from ((kind, key, rank) for kind, key in _long_keys(word, shorter))
                continue
            yield ITSELF, word, rank
            for at, c in enumerate(word):
                yield WILD, f"{word[:at]}*{word[at + 1 :]}", rank
                if shorter and (at == 0 or c != word[at - 1]):
                    yield SHORTER, word[:at] + word[at + 1 :], rank

    return arrow_batches(keys(), _KEYS, 20_000)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, modulus: int = MODULUS) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z lower-cased, that are long and frequent enough.

    Where `modulus` divides h, the CRC-32 of "id:run" (a null id is empty there), the run loses its code point h % length.
    A null text has no runs; repeated rows count each; other columns are left out.
    """
    found = keyed_bytes(docs, id_col, text_col).mapInArrow(lambda batches: _counted(batches, least_length, modulus), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def group(vocabulary: DataFrame, least_length: int = LEAST_LENGTH, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for (word, n), words being distinct, of `least_length` code points or more, and without `*` or `#`.

    Near words differ by one inserted, deleted or replaced code point. form is the most frequent near word (ties: first in
    code-point order) if it is `factor` times as frequent, else null; root is the end of the forms from a word on, the word
    itself if it has none. n_near is 0 and form_n null where there are none.
    """
    ranked = stored(running(stored(vocabulary.select("word", "n")), [], [F.desc("n"), F.col("word")], {"rank": F.lit(1).cast("long")}))
    keys = stored(ranked.select("word", "rank").mapInArrow(lambda batches: _keyed(batches, least_length), "kind byte, key string, rank long"))
    # A group of replacements has one member a code point, so 90 at most.
    members = keys.filter(F.col("kind") == WILD).groupBy("key").agg(F.sort_array(F.collect_list("rank")).alias("ranks")).filter(F.size("ranks") > 1)
    replaced = members.select((F.size("ranks") - 1).cast("long").alias("near"), F.slice("ranks", 1, 2).alias("top"), F.explode("ranks").alias("rank"))
    replaced = replaced.select("rank", "near", F.when(F.col("rank") == F.get("top", F.lit(0)), F.get("top", F.lit(1))).otherwise(F.get("top", F.lit(0))).alias("best"))
    longer, itself = (keys.filter(F.col("kind") == kind).select("key", F.col("rank").alias(name)) for kind, name in ((SHORTER, "longer"), (ITSELF, "shorter")))
    indels = stored(longer.join(itself, "key").select("longer", "shorter"))
    one = F.lit(1).cast("long").alias("near")
    ways = replaced.unionByName(indels.select(F.col("longer").alias("rank"), one, F.col("shorter").alias("best"))).unionByName(indels.select(F.col("shorter").alias("rank"), one, F.col("longer").alias("best")))
    near = ways.groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    best = ranked.select(F.col("rank").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    met = ranked.join(near, "rank", "left").join(best, "best", "left")
    formed = F.col("best_n") >= factor * F.col("n")
    held = stored(met.select("word", "n", "rank", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best")).alias("up"), F.when(formed, F.col("best_word")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")))
    roots = _roots(held, factor).join(ranked.select(F.col("rank").alias("top"), F.col("word").alias("root")), "top")
    return held.join(roots.select("rank", "root"), "rank", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(held: DataFrame, factor: int) -> DataFrame:
    """(rank, top) of the words with a form: the end of their chain, by pointer jumping.

    A step multiplies the count by `factor` at least, so the greatest count bounds the length of chains, and its logarithm the rounds.
    """
    ends = held.agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    steps, count = 0, ends["least"] or 1
    while count * factor <= (ends["most"] or 0) and factor > 1:
        steps, count = steps + 1, count * factor
    links = stored(held.filter(F.col("up").isNotNull()).select("rank", F.col("up").alias("top")))
    for _ in range(max(0, steps - 1).bit_length()):
        above = links.select(F.col("rank").alias("top"), F.col("top").alias("over"))
        links = stored(links.join(above, "top", "left").select("rank", F.coalesce("over", "top").alias("top")))
    return links


def op13(spark, sf_dir):
    return group(words(table(spark, sf_dir, "documents")))


def twin() -> str:
    """The query in DuckDB's SQL, which joins the members of each group in pairs."""
    runs = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[{LETTERS}]+')"
    return f"""
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest({runs}) AS run FROM documents),
counted AS MATERIALIZED (SELECT id, run, id || ':' || run AS x, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY id, run),
{crc32_sql("(SELECT DISTINCT x FROM counted)")},
spelt AS (SELECT CASE WHEN crc % {MODULUS} = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM counted JOIN crcs USING (x)),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
places AS MATERIALIZED (SELECT word, n, k, substr(word, 1, k - 1) AS head, substr(word, k + 1) AS tail FROM words, range(1, length(word) + 1) r(k)),
shorter AS (SELECT DISTINCT p.word AS longer, p.n AS longer_n, w.word AS less, w.n AS less_n FROM places p JOIN words w ON w.word = head || tail),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM places a JOIN places b ON a.k = b.k AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION ALL SELECT longer, longer_n, less, less_n FROM shorter UNION ALL SELECT less, less_n, longer, longer_n FROM shorter),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {FACTOR} * w.n THEN other END AS form, CASE WHEN other_n >= {FACTOR} * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
chains(word, top) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.top WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.top AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM forms f JOIN chains c ON c.word = f.word JOIN forms e ON e.word = c.top WHERE e.form IS NULL
"""
