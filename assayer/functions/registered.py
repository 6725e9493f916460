"""Text functions by name, for users who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from assayer.functions import readings, strict_json, text


def _cleaned(t: str) -> str:
    out = f"plain_text(translate({t}, '\\t', ' '))"
    for pattern, by in text.CLEANED:
        out = f"regexp_replace({out}, r'{pattern}', r'{by}')"
    return out


def register(spark: SparkSession) -> list[str]:
    """Registers temporary functions in the session and returns their names. Null gives null, or no readings.

    clean_text(text): text.clean of the whole text. parse_sentence(sentence): the readings that hold, with their votes, of any
    sentence, directive or not; reading_report(sentence): each rule's; question_readings(question): those of a question.
    answered_questions(cleaned) and qa_pairs(text): the questions that a text answers itself. valid_json(text, deepest): whether a text is strict JSON in at most so many brackets.
    """
    strict_json.register(spark)
    python = {"plain_text": text.plain_text, "parse_sentence": readings.voted_readings, "reading_report": readings.reading_report, "question_readings": readings.question_readings}
    for name, function in python.items():
        spark.udf.register(name, function)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION clean_text(t STRING) RETURNS STRING RETURN {_cleaned('t')}")
    found = [f"regexp_extract_all(t, r'{readings.QUESTION}', {k})" for k in (1, 2)]
    pair = r"p -> named_struct('question', regexp_replace(trim(p.`0`), r'(?iu)^\s*q:\s*', ''), 'denied', lower(p.`1`) <> 'yes')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION answered_questions(t STRING) RETURNS ARRAY<STRUCT<question: STRING, denied: BOOLEAN>> RETURN transform(arrays_zip({found[0]}, {found[1]}), {pair})")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION qa_pairs(t STRING) RETURNS ARRAY<STRUCT<question: STRING, denied: BOOLEAN>> RETURN answered_questions(clean_text(t))")
    return [*python, "valid_json", "clean_text", "answered_questions", "qa_pairs"]
