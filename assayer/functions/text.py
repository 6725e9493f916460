"""Cleaning untrusted text: markup, links and invisible characters go, then directive sentences."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.lexicon import DIRECTIVE_STARTS, DIRECTIVES, IMPERATIVES

#: Characters that ingest reads of a text at most; letters of a sentence.
LONGEST, SHORT, LONG = 200_000, 8, 400
# Elements that go with their content, top-level domains of bare links, entities that are decoded, patterns of markup and of what is cleaned away.
HIDDEN = "script|style|iframe|object|embed|template|noscript|svg"
DOMAINS = "com|org|net|io|gov|edu|co|uk|ai|dev|info|xyz|ru|cn"
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "copy": "©", "reg": "®", "trade": "™", "deg": "°", "plusmn": "±", "times": "×", "middot": "·"}
ENTITY = r"&(?:#([0-9]+)|#[xX]([0-9a-fA-F]+)|([a-zA-Z][a-zA-Z0-9]*));?"
MARKUP = [r"<!--.*?-->", rf"(?i)<({HIDDEN})\b.*?</\1\s*>", r"<[^>]{0,2000}>"]
LINKS = rf"(?iuU)(?:\b[a-z][a-z0-9+.-]{{1,15}}://|\bwww\.)\S+|\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\b(?:[a-z0-9-]+\.)+(?:{DOMAINS})\b(?:/\S*)?"
CLEANED = [
    (r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}\p{Cn}&&[^\n]]", ""),
    (r"!?\[([^\]]*)\]\([^)]*\)", "$1"),
    (LINKS, " "),
    (r"[*_`#>|~\[\]{}\\^=<]+", " "),
    (r"[ \t\r\f\x0B]+", " "),
    (r"(?mU)^[\s&&[^\n]]+|[\s&&[^\n]]+$", ""),
]
# End of the fixed values.

#: What every link has, as it is found faster.
_LINKED = rf"(?iu)://|www\.|@|\.(?:{DOMAINS})"
_ENTITY, _MARKUP = re.compile(ENTITY), [re.compile(p, re.S) for p in MARKUP]


def _character(m: re.Match) -> str:
    if m[3]:
        return ENTITIES.get(m[3], m[0]) if m[0].endswith(";") else m[0]
    digits, base = (m[1], 10) if m[1] else (m[2], 16)
    code = int(digits, base) if len(digits) < 12 else 0
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "�"


def _plain(text: str | None) -> str | None:
    """What Spark's functions can't do: entities that hide markup, and composed characters."""
    if text is None:
        return None
    for _ in range(3):
        before = text
        text = _ENTITY.sub(_character, text) if "&" in text else text
        if "<" in text:
            for pattern in _MARKUP:
                text = pattern.sub(" ", text)
        if text == before:
            break
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


@F.pandas_udf(T.StringType())
def _plain_text(texts: pd.Series) -> pd.Series:
    return texts.map(_plain, na_action="ignore").astype(object).where(texts.notna(), None)


#: Said to be nondeterministic so that no plan runs it twice or below a filter.
plain_text = _plain_text.asNondeterministic()


def _once(value: Column, then) -> Column:
    """then(value), where value is computed once however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def clean(text: Column | str, longest: int | None = None) -> Column:
    """Text without markup, links, formatting and invisible characters; lines stay. Null stays null.

    longest: only so many characters are read, as ingest does; else the whole text. ASCII texts without markup or
    references never leave the JVM.
    """
    t = F.col(text) if isinstance(text, str) else text
    t = F.translate(t if longest is None else F.substring(t, 1, longest), "\t", " ")
    odd = t.rlike(r"[^\x00-\x7F]|[&<]")
    t = F.when(odd, plain_text(F.when(odd, t))).otherwise(t)
    for pattern, by in CLEANED:
        t = _once(t, lambda x: F.when(x.rlike(_LINKED), F.regexp_replace(x, LINKS, " ")).otherwise(x)) if pattern == LINKS else F.regexp_replace(t, pattern, by)
    return t


def sentence_parts(cleaned: Column | str) -> Column:
    """Stripped parts of 8 to 400 characters, cut behind a stop, at line ends and at ; and :."""
    parts = F.split(F.col(cleaned) if isinstance(cleaned, str) else cleaned, r"(?U)(?<=[.!?])\s+|\n+|[;:]")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: F.length(p).between(SHORT, LONG))


def is_directive(sentence: Column | str) -> Column:
    """Whether a sentence tells its reader what to do, as injected text does."""
    s = F.lower(F.trim(F.col(sentence) if isinstance(sentence, str) else sentence))
    opener = rf"\A[,.]*(?:{'|'.join(IMPERATIVES)})[,.]*(?: |\z)"
    starts = "|".join(re.escape(x) for x in DIRECTIVE_STARTS).replace("\\ ", " ")
    rules = "|".join(f"(?:{p})" for p in DIRECTIVES)
    # Letters of ASCII need no tables of Unicode.
    anywhere = F.when(s.rlike(r"[^\x00-\x7F]"), s.rlike(f"(?iuU){rules}")).otherwise(s.rlike(f"(?i){rules}"))
    return s.rlike(opener) | s.rlike(rf"\A(?:{starts})") | anywhere


def sentences(docs: DataFrame, text_col: str = "text", longest: int | None = None) -> DataFrame:
    """docs with cleaned, sentences (the declarative ones) and dropped (how many were directive) behind; a null text has none."""
    parts = docs.withColumn("cleaned", clean(text_col, longest)).withColumn("__parts", F.coalesce(sentence_parts("cleaned"), F.array().cast("array<string>")))
    kept = F.filter("__parts", lambda p: ~is_directive(p))
    return parts.withColumn("sentences", kept).withColumn("dropped", (F.size("__parts") - F.size("sentences")).cast("long")).drop("__parts")


def sql_parts(x: str) -> str:
    """sentence_parts in DuckDB's SQL, whose patterns look neither ahead nor behind."""
    cut = f"string_split_regex(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+|[;:]')"
    return f"list_filter(list_transform({cut}, lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: length(p) BETWEEN {SHORT} AND {LONG})"


def sql_is_directive(s: str) -> str:
    quoted = "|".join(f"(?:{p})" for p in DIRECTIVES).replace("'", "''")
    opener = rf"^[,.]*(?:{'|'.join(IMPERATIVES)})[,.]*(?: |$)"
    return f"(regexp_matches(lower(trim({s})), '{opener}') OR regexp_matches(lower(trim({s})), '^(?:{'|'.join(DIRECTIVE_STARTS)})') OR regexp_matches(lower(trim({s})), '{quoted}'))"


def sql_clean_steps(table: str, key: str, column: str) -> str:
    """CTEs of DuckDB, the last of which is cleaned(key, text): `clean`, for texts without numeric references and with composed characters.

    Its patterns know no back references, so hidden elements go name by name, and no repetition over 1000.
    """
    quoted = lambda p: p.replace("'", "''")

    def plain(x: str) -> str:
        for name, char in sorted(ENTITIES.items(), key=lambda e: e[0] == "amp"):  # the ampersand last, as one pass decodes once
            x = f"replace({x}, '&{name};', '{quoted(char)}')"
        for pattern in ("(?s)<!--.*?-->", *(rf"(?is)<{h}\b.*?</{h}\s*>" for h in HIDDEN.split("|")), "(?s)<[^>]{0,1000}[^>]{0,1000}>"):
            x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
        return x

    tidied = "x"
    for pattern, by in (
        (r"[\x00-\x09\x0B-\x1F\x7F-\x{9F}\p{Cf}\p{Co}]", ""), (r"!?\[([^\]]*)\]\([^)]*\)", r"\1"), (LINKS.replace("(?iuU)", "(?i)"), " "),
        (r"[*_`#>|~\[\]{}\\^=<]+", " "), (r"[ \t\r\f\x0B]+", " "), (r"(?m)^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", ""),
    ):
        tidied = f"regexp_replace({tidied}, '{quoted(pattern)}', '{by}', 'g')"
    return f"""
round0 AS (SELECT {key}, translate({column}, chr(9), ' ') AS x FROM {table}),
round1 AS MATERIALIZED (SELECT {key}, {plain("x")} AS x FROM round0), round2 AS MATERIALIZED (SELECT {key}, {plain("x")} AS x FROM round1), round3 AS MATERIALIZED (SELECT {key}, {plain("x")} AS x FROM round2),
cleaned AS MATERIALIZED (SELECT {key}, {tidied} AS text FROM round3)"""
