"""The triple store's operators: validity, upsert, decoding, size and eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import nlp
from assayer.functions.ranges import PLACE_BITS, dealt, numbered
from assayer.functions.shared import stored
from assayer.functions.text import is_directive

KEY = ["subject", "predicate", "object", "source"]
CODES = ["s", "p", "o", "src"]
HEADER_BYTES, ROW_BYTES, STRING_BYTES, KEPT_SHARE = 12, 29, 4, 0.9
ROWS_A_RANGE = 500_000
FIELD = r"\A[a-z0-9' -]{1,80}\z"
LOCATOR = r"\A[a-z0-9.-]{1,120}(?:/[A-Za-z0-9._~%()-]{0,120}){0,4}\z"


def is_valid() -> Column:
    """Fields of plain lower-case words, a plain locator as the source, and no directive in what they say together."""
    fields = [F.col(c).rlike(FIELD) for c in KEY[:3]]
    fine = fields[0] & fields[1] & fields[2] & F.col("source").rlike(LOCATOR) & ~is_directive(F.concat_ws(" ", *KEY[:3]))
    return F.coalesce(fine, F.lit(False))


def trust_q(trust: Column | str) -> Column:
    """Trust in 0 to 1 as a number from 0 to 255, halves to the even one."""
    trust = F.col(trust) if isinstance(trust, str) else trust
    return F.least(F.lit(255), F.greatest(F.lit(0), F.rint(trust * 255))).cast("int")


def upsert(rows: DataFrame) -> DataFrame:
    """One row per key, with the latest `added` and the highest `trust_q`; hits add up where there are any, the least `row` stays.

    The result doesn't depend on the order or number of times that rows arrive, hits aside.
    """
    more = [F.sum("hits").alias("hits")] if "hits" in rows.columns else []
    more += [F.min("row").alias("row")] if "row" in rows.columns else []
    return rows.groupBy(*KEY).agg(F.max("added").alias("added"), F.max("trust_q").alias("trust_q"), *more)


def merge(memory: DataFrame, found: DataFrame) -> DataFrame:
    """memory with the rows found: known keys are refreshed and keep their hits, new ones begin without."""
    both = memory.select(*KEY, "added", "trust_q", "hits").unionByName(found.select(*KEY, "added", "trust_q", F.lit(0).alias("hits")))
    return upsert(both)


def decode(strings: DataFrame, coded: DataFrame) -> DataFrame:
    """Coded triples (s, p, o, src as ids) with their strings (id, value); rows with an unknown id are left out.

    coded is read twice, and should be stored if it is costly: each column meets the strings of its own ids alone, which
    are written first, so that rows aren't shuffled for a column of few strings, or to one task by a frequent one. Sources,
    which are the most, come first, while the other columns are still numbers.
    """
    met = coded.select(F.posexplode(F.array(*CODES)).alias("field", "id")).groupBy("id").agg(F.bit_or(F.expr("shiftleft(1, field)")).alias("fields"))
    own, out = stored(strings.join(met, "id")), coded
    for k, (code, name) in reversed(list(enumerate(zip(CODES, KEY, strict=True)))):
        out = out.join(_of_field(own, k).select(F.col("id").alias(code), F.col("value").alias(name)), code)
    return out.select(*KEY, *[c for c in coded.columns if c not in CODES])


def _of_field(strings: DataFrame, k: int) -> DataFrame:
    """The strings of a column, by the bits of fields, written, so that Spark broadcasts few by their known size."""
    return stored(strings.filter(F.col("fields").bitwiseAND(F.lit(1 << k)) != 0))


def encode(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(strings, coded): distinct strings with dense ids from 0 in their order, and triples by ids.

    Ids are ranks found by ranges, so no two strings share one; each column meets its own strings in a join by value.
    """
    used = triples.select(F.posexplode(F.array(*KEY)).alias("field", "value")).groupBy("value").agg(F.bit_or(F.expr("shiftleft(1, field)")).alias("fields"))
    strings = stored(numbered(stored(used), [F.col("value")], "id").withColumn("id", F.col("id") - 1))
    coded = triples
    for k, (code, name) in enumerate(zip(CODES, KEY, strict=True)):
        coded = coded.join(_of_field(strings, k).select(F.col("value").alias(name), F.col("id").alias(code)), name)
    return strings.select("value", "id"), coded.select(*CODES, *[c for c in triples.columns if c not in KEY])


def logical_size(triples: DataFrame) -> DataFrame:
    """One row: rows, strings and bytes, each distinct string counted once."""
    strings = triples.select(F.explode(F.array(*KEY)).alias("value")).distinct().agg(F.count(F.lit(1)).alias("strings"), F.coalesce(F.sum(F.octet_length("value") + STRING_BYTES), F.lit(0)).alias("text"))
    return triples.agg(F.count(F.lit(1)).alias("rows")).crossJoin(strings).select("rows", "strings", (HEADER_BYTES + F.col("text") + ROW_BYTES * F.col("rows")).cast("long").alias("bytes"))


def evict(triples: DataFrame, cap: int, now: float) -> DataFrame:
    """The triples that stay under the cap, renumbered by score, heaviest first; all, where they fit.

    Triples enter by trust, recency and hits (to 12 places; ties: by row), each charged for its row and for the strings it is the first
    to use, up to the first that would pass nine tenths of the cap with four bytes more for each letter of its subject.
    Rows are dealt by ranges of that order and sizes summed over the ranges first, so no task orders the whole table and
    equal scores are split; then only the ranges that begin under the cap are gone through row by row.
    """
    triples = stored(triples)
    whole = logical_size(triples).first()
    score = F.round(F.col("trust_q") / 255.0 * nlp.recency("added", now) * (1 + F.col("hits")), 12)
    if whole["bytes"] <= cap:
        return triples.withColumn("score", score)
    order = [F.desc("score"), F.asc("row")]
    ranges = max(16, whole["rows"] // ROWS_A_RANGE)
    placed = dealt(triples.withColumn("score", score), order, "at_", ranges)
    # A string is charged where it is met first; within a row, fields come in order. Numbers stand for place and field, as hash aggregates can't hold a struct.
    used = placed.select("at_", F.posexplode(F.array(*KEY)).alias("field", "value"))
    first = used.groupBy("value").agg(F.min(F.col("at_") * len(KEY) + F.col("field")).alias("first"))
    new = stored(first.groupBy(F.shiftright("first", 2).alias("at_")).agg(F.sum(F.octet_length("value") + STRING_BYTES).alias("text")))
    range_ = F.shiftright("at_", PLACE_BITS).alias("range_")
    texts = new.groupBy(range_).agg(F.sum("text").alias("text"))
    per = placed.groupBy(range_).agg(F.count(F.lit(1)).alias("n")).join(texts, "range_", "left")
    ahead = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    before = lambda x: F.coalesce(F.sum(x).over(ahead), F.lit(0))
    base = per.select("range_", before(F.lit(ROW_BYTES) * F.col("n") + F.coalesce("text", F.lit(0))).alias("base"), before(F.col("n")).alias("rows_before"))
    # Nothing enters in a range that begins over the cap, so its rows aren't looked at.
    base = stored(base.filter(F.col("base") + HEADER_BYTES <= KEPT_SHARE * cap))
    charged = placed.withColumn("range_", range_).join(F.broadcast(base), "range_").join(new, "at_", "left").withColumn("bytes", F.lit(ROW_BYTES) + F.coalesce("text", F.lit(0)))
    so_far = F.coalesce(F.sum("bytes").over(Window.partitionBy("range_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = stored(charged.withColumn("held", F.lit(HEADER_BYTES) + F.col("base") + so_far).withColumn("rank", F.col("rows_before") + F.col("at_").bitwiseAND(F.lit(2**PLACE_BITS - 1)) + 1))
    over = F.col("held") + ROW_BYTES + STRING_BYTES * F.length("subject") > KEPT_SHARE * cap
    stop = summed.filter(over).agg(F.min("rank").alias("stop")).first()["stop"]
    kept = summed if stop is None else summed.filter(F.col("rank") < stop)
    return kept.withColumn("row", F.col("rank").cast("long")).select(*triples.columns, "score")
