"""Claims in a user's words, their areas, and the answer in prose."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import nlp, text
from assayer.operators import ingest

MOST_AREAS, AREA_SIZE, PARAGRAPH = 4, 32, 5
CONFIRMS, REPORTS = 0.8, 0.55
# The numbers that speak are 1 and the primes up to 128; sentences for no evidence; connectives.
SPEAKING = [1, *(n for n in range(2, 129) if all(n % d for d in range(2, n)))]
NOTHING_SAID = "None of the crawlers that speak for this answer retrieved any evidence."
NOTHING_LISTED = "No prime-numbered crawler retrieved evidence."
AGAIN = ["Likewise", "In addition", "Similarly"]
MONTHS = "January February March April May June July August September October November December".split()
# End of the fixed values.


def parse(requests: DataFrame) -> DataFrame:
    """requests (request_id, text) to claims: request_id, place, text, subject, predicate, object, s, o, pol, key.

    A claim is the best reading of a declarative sentence; requests without any give no row.
    """
    said = text.sentences(requests.select("request_id", "text")).select("request_id", F.posexplode("sentences").alias("place", "sentence"))
    best = said.select("*", *ingest.sentence_ids()).join(ingest.parse(said).drop("sentence"), ["s1", "s2"]).withColumn("r", F.get("readings", F.lit(0))).filter("r IS NOT NULL")
    return best.select(
        "request_id", (F.col("place") + 1).alias("place"), F.col("sentence").alias("text"), F.col("r.subject").alias("subject"), F.col("r.predicate").alias("predicate"), F.col("r.object").alias("object"),
        nlp.stems("r.subject").alias("s"), nlp.stems("r.object").alias("o"), nlp.polarity("r.predicate", "r.object").alias("pol"), nlp.route_key(F.concat_ws(" ", "r.subject", "r.object")).alias("key"),
    )


def quick(requests: DataFrame) -> DataFrame:
    """The first claim of each request, with the whole request as its text."""
    first = parse(requests).withColumn("n", F.row_number().over(Window.partitionBy("request_id").orderBy("place"))).filter("n = 1").drop("n", "text")
    return first.join(requests.select("request_id", F.trim("text").alias("text")), "request_id")


def _areas(claims: pd.DataFrame) -> pd.DataFrame:
    """The claims of one request, with their area and its number of claims before them."""
    groups: list[list[int]] = []
    topic = [(set(s), set(s) | set(o)) for s, o in zip(claims["s"], claims["o"], strict=True)]
    claims = claims.assign(at=range(len(claims)))
    order = claims.sort_values("place")["at"].tolist()
    for k in order:
        near = next((g for g in groups if any(topic[k][0] & topic[j][1] or topic[j][0] & topic[k][1] for j in g)), None)
        near.append(k) if near is not None else groups.append([k])
    while len(groups) > MOST_AREAS:
        groups.sort(key=len)
        least, *groups = groups
        stems = set().union(*(topic[k][1] for k in least))
        max(groups, key=lambda g: len(stems & set().union(*(topic[k][1] for k in g)))).extend(least)
    area = {k: (n, turn) for n, g in enumerate(groups) for turn, k in enumerate(g)}
    return pd.DataFrame({"request_id": claims["request_id"], "place": claims["place"], "area": [area[k][0] for k in claims["at"]], "turn": [area[k][1] for k in claims["at"]]})


def with_areas(claims: DataFrame) -> DataFrame:
    """claims with area (0 to 3) and turn: claims that share stems are an area, in order; of more than four, the smallest joins its nearest."""
    keys = claims.select("request_id", "place", "s", "o")  # a request holds few claims
    return claims.join(keys.groupBy("request_id").applyInPandas(_areas, f"request_id {dict(claims.dtypes)['request_id']}, place int, area int, turn int"), ["request_id", "place"])


def month(added: Column | str) -> Column:
    """yyyy-MM in UTC of epoch seconds."""
    return F.date_format(F.timestamp_seconds(F.floor(F.col(added) if isinstance(added, str) else added)), "yyyy-MM")


def when(month: Column | str) -> Column:
    """' in September 2025', or nothing for what isn't a month from 1990 on."""
    m = F.col(month) if isinstance(month, str) else month
    name = F.get(F.array(*[F.lit(x) for x in MONTHS]), F.substring(m, 6, 2).try_cast("int") - 1)
    year = F.substring(m, 1, 4).try_cast("int")
    return F.when(m.rlike(r"\A\d{4}-\d\d\z") & (year >= 1990) & name.isNotNull(), F.concat(F.lit(" in "), name, F.lit(" "), year.cast("string"))).otherwise("")


def third_person(verb: Column) -> Column:
    return (
        F.when(verb.rlike("(?:s|sh|ch|x)$"), F.concat(verb, F.lit("es"))).when(verb.rlike("(?<=.)(?<![aeiou])y$"), F.concat(F.regexp_replace(verb, "y$", ""), F.lit("ies"))).otherwise(F.concat(verb, F.lit("s")))
    )


def is_plural(subject: Column) -> Column:
    last = F.substring_index(subject, " ", -1)
    return (F.length(last) > 3) & last.endswith("s") & ~last.rlike("(?:ss|us|is|ics)$")


def agreeing(predicate: Column, plural: Column) -> Column:
    """The predicate as a verb that agrees with its subject."""
    base, denied = F.regexp_replace(predicate, "^not ", ""), predicate.startswith("not ")
    no = F.when(base == "is", F.when(plural, "are not").otherwise("is not")).otherwise(F.concat(F.when(plural, "do not ").otherwise("does not "), F.when(base == "has", "have").otherwise(base)))
    yes = F.when(base == "is", F.when(plural, "are").otherwise("is")).when(base == "has", F.when(plural, "have").otherwise("has")).when(plural, base).otherwise(third_person(base))
    return F.when(denied, no).otherwise(yes)


def _speakers(rows: pd.DataFrame) -> pd.DataFrame:
    """The evidence at each speaking number of one claim, from the highest on; what was said isn't said again."""
    said, kept = set(), []
    for _, step in rows.sort_values(["pos", "weight", "link", "place"], ascending=[False, False, True, True]).groupby("pos", sort=False):
        for r in step.itertuples():
            if (r.subject, r.predicate, r.object) not in said:
                said.add((r.subject, r.predicate, r.object))
                kept.append(r.Index)
                break
    return rows.loc[kept]


def voices(found: DataFrame, steps: DataFrame) -> DataFrame:
    """(claim_id, pos, stance, text, weight, subject, predicate, object, host, month, trust) of the numbers that speak.

    found is ranked evidence; steps (claim_id, step, offset, links) are those of the first layer. A number speaks with the
    heaviest evidence that its step's links gave and that no higher number has spoken. At most 32 steps with 8 links each meet.
    """
    numbers = F.array(*[F.lit(n) for n in SPEAKING])
    linked = steps.withColumn("pos", F.col("step") + F.col("offset")).filter(F.array_contains(numbers, F.col("pos"))).select("claim_id", "pos", F.posexplode("links").alias("link", "source"))
    fields = ["claim_id", "pos", "link", "place", "stance", "weight", "subject", "predicate", "object", "host", "added", "trust"]
    met = linked.join(found, ["claim_id", "source"]).select(*fields)
    # Of a link's items, no more than there are numbers can be spoken before one is free.
    near = met.withColumn("n", F.row_number().over(Window.partitionBy("claim_id", "pos").orderBy(F.desc("weight"), "link", "place"))).filter(F.col("n") <= len(SPEAKING)).drop("n")
    spoken = near.groupBy("claim_id").applyInPandas(_speakers, near.schema)
    p = F.col("predicate")
    verb = F.when(p.startswith("not "), F.concat(F.lit("does not "), F.regexp_replace(p, "^not ", ""))).when(p.isin("is", "has"), p).otherwise(F.concat(p, F.lit("s")))
    out = spoken.withColumn("month", month("added"))
    return out.select("claim_id", "pos", "stance", F.concat(F.concat_ws(" ", "subject", verb, "object"), F.lit(" ("), "host", F.lit(", "), "month", F.lit(")")).alias("text"), "weight", "subject", p, "object", "host", "month", "trust")


def strongest(spoken: DataFrame, by: list[str]) -> DataFrame:
    """One voice for each number: the heaviest, then the earliest claim's."""
    return spoken.withColumn("n", F.row_number().over(Window.partitionBy(*by, "pos").orderBy(F.desc("weight"), "claim_id"))).filter("n = 1").drop("n")


def listed(spoken: DataFrame, by: list[str]) -> DataFrame:
    """(by, numbered): a line for each voice, highest number first."""
    line = F.concat(F.col("pos").cast("string"), F.lit(". ["), "stance", F.lit("] "), "text")
    rows = spoken.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("pos")).alias("k"), line.alias("line")))).alias("rows"))
    return rows.select(*by, F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("numbered"))


def prose(spoken: DataFrame, by: list[str]) -> DataFrame:
    """(by, prose): the voices as sentences, highest number first, a paragraph for each area and five sentences.

    A connective says how a stance follows the one before; sentences name their source first and last in turn, and sources
    of little trust as such.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("pos"))
    area = F.floor((F.col("pos") - 1) / AREA_SIZE)
    rows = spoken.withColumns({"area": area, "at": F.row_number().over(w) - 1})
    inside = Window.partitionBy(*by, "area").orderBy(F.desc("pos"))
    rows = rows.withColumns({"k": F.row_number().over(inside) - 1, "before": F.lag("stance").over(inside)})
    rows = rows.withColumn("turn", F.sum((F.coalesce(F.col("stance") != F.col("before"), F.lit(True))).cast("int")).over(inside))
    rows = rows.withColumn("run", F.row_number().over(Window.partitionBy(*by, "area", "turn").orderBy(F.desc("pos"))) - 2)
    s, b = F.col("stance"), F.col("before")
    again = F.get(F.array(*[F.lit(x) for x in AGAIN]), F.col("run") % len(AGAIN))
    link = (
        F.when(b.isNull(), F.lit(None).cast("string")).when(b == s, F.when(s == "neutral", "Also").otherwise(again)).when(s == "against", "However")
        .when(s == "for", F.when(b == "against", "On the other hand").otherwise("More directly")).otherwise("For context")
    )
    clause = F.concat_ws(" ", "subject", agreeing(F.col("predicate"), is_plural(F.col("subject"))), "object")
    told, first = when("month"), F.col("at") % 2 == 0
    verb = F.when(F.col("trust") >= CONFIRMS, "confirms").otherwise("reports")
    sure = F.when(first, F.concat(F.lit("according to "), "host", told, F.lit(", "), clause)).otherwise(F.concat(clause, F.lit(", "), "host", F.lit(" "), verb, told))
    hedged = F.when(first, F.concat(F.lit("a lower-trust source, "), "host", told, F.lit(", claims that "), clause)).otherwise(F.concat(clause, F.lit(", though that claim comes from "), "host", told, F.lit(", a lower-trust source")))
    body = F.when(F.col("trust") >= REPORTS, sure).otherwise(hedged)
    sentence = F.concat(F.when(link.isNull(), F.concat(F.upper(F.substring(body, 1, 1)), F.substring(body, F.lit(2), F.length(body)))).otherwise(F.concat(link, F.lit(", "), body)), F.lit("."))
    gap = F.when(F.col("at") == 0, "").when(F.col("k") % PARAGRAPH == 0, "\n\n").otherwise(" ")
    joined = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", F.concat(gap, sentence).alias("text")))).alias("rows"))
    return joined.select(*by, F.array_join(F.transform("rows", lambda r: r["text"]), "").alias("prose"))
