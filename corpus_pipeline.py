"""A training-corpus pipeline over documents: each stage's result is written and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import decontaminate, language_id, line_dedup, packing, simhash
from assayer.llm.common import free_names, held_out, hot_join, stored, table


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names renamed, as an operator adds its own, and the names by those they had."""
    clashing = [c for c in docs.columns if c.lower() in names]
    new = dict(zip(clashing, free_names(docs, *(f"{c}_aside" for c in clashing)), strict=True))
    return docs.withColumnsRenamed(new), new


def _back(df: DataFrame, docs: DataFrame, new: dict[str, str]) -> DataFrame:
    """The columns of docs under their names."""
    return df.select(*[F.col(f"`{new.get(c, c)}`").alias(c) for c in docs.columns])


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language two codewords fit about as well, go."""
    coder = language_id.train(docs.filter(~F.coalesce(held_out("doc_id", 4, 2), F.lit(False))))
    own, new = _aside(docs, "lang_pred", "score", "ambiguous")
    return _back(language_id.identify(own, coder).filter(~F.col("ambiguous") & (F.col("lang_pred") != language_id.UNDETERMINED)), docs, new)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go out of the texts, where copies and near copies of a text count once; n_chars follows."""
    own, new = _aside(docs, "n_lines", "n_dropped")
    return _back(line_dedup.drop_boilerplate(own, copies=False).withColumn("n_chars", F.length("text").cast("long")), docs, new)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays, without ids the one with the least hash of its text.

    Documents are told apart by id and text: one that shares only its id with another stays or goes by its own group, and
    of rows with the same id and text one stays.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))  # parts only texts of one id, so 64 bits are enough
    d, k, own_key = free_names(docs, "lost_id", "lost_text", "own_text")
    rows = docs.select("doc_id", "text", key.alias("text_key"))
    groups = stored(simhash.near_duplicates(rows, carry=("text_key",)).select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key").alias("own")))
    # A group's first document is found by partial sums; the few groups that are large meet their members by broadcast.
    first = stored(groups.groupBy("root").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("members")))
    fates = stored(hot_join(groups, first, "root", "members").select("own.doc_id", "own.text_key", (F.col("own") != F.col("first")).alias("lost")))
    # Most ids stand for one text, and their losers need no more than the id.
    ids = stored(fates.groupBy(F.col("doc_id").alias(d)).agg(F.bool_and("lost").alias("all_lost"), F.bool_or("lost").alias("any_lost")).filter("any_lost"))
    gone, parted = ids.filter("all_lost").select(d), ids.filter("NOT all_lost").select(d)
    losers = stored(fates.filter("lost").join(parted, F.col("doc_id").eqNullSafe(F.col(d)), "left_semi").select(F.col("doc_id").alias(d), F.col("text_key").alias(k)).distinct())
    twice = stored(fates.groupBy(F.col("doc_id").alias(d), F.col("text_key").alias(k)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(d, k))
    same = docs["doc_id"].eqNullSafe(F.col(d))
    kept = docs.join(gone, same, "left_anti").join(losers, same & (key == F.col(k)), "left_anti")
    repeated = kept.join(twice, same & (key == F.col(k)), "left_semi").withColumn(own_key, key).dropDuplicates(["doc_id", own_key])
    return kept.join(twice, same & (key == F.col(k)), "left_anti").unionByName(repeated.drop(own_key)).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    own, new = _aside(docs, "leaks")
    return _back(decontaminate.mark(own, table(spark, sf_dir, "benchmark")).filter(F.size("leaks") == 0), docs, new)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language identification", identify_languages),
    ("line dedup", drop_boilerplate_lines),
    ("near-duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
#: SQL can't express the stages; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
