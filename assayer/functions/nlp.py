"""Tokens, topic stems, polarity and time decay as column expressions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions import lexicon as lx

WORD = r"[a-z0-9]+(?:'[a-z]+)?"
HALF_LIFE_DAYS, LEAST_RECENCY = 365.0, 0.05


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _among(x: Column, words) -> Column:
    return x.isin(sorted(words))


def tokens(text: Column | str) -> Column:
    """Lower-case words; contractions of `not` are spelt out. Null text gives null."""
    t = F.lower(_col(text))
    for short, long in (("won't", "will not"), ("can't", "cannot"), ("n't", " not")):
        t = F.replace(t, F.lit(short), F.lit(long))
    return F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1))


def stem(word: Column) -> Column:
    """-ies becomes -y in words of over four letters; a single -s goes in words of over three."""
    n = F.length(word)
    plain_s = word.endswith("s") & ~word.endswith("ss")
    return F.when((n > 4) & word.endswith("ies"), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y"))).when((n > 3) & plain_s, F.substring(word, F.lit(1), n - 1)).otherwise(word)


def stems(text: Column | str) -> Column:
    """The sorted set of the stems of words that bear on the topic. A word that stands often is looked at once."""
    return _named(_stems, text) if isinstance(text, str) else _stems(text)


@cache
def _named(made, *names: str) -> Column:
    """made(*names), once: an expression with lists of words takes some thousand calls to the JVM, and a search names it again and again."""
    return made(*names)


def _stems(text: Column | str) -> Column:
    kept = F.filter(F.array_distinct(tokens(text)), lambda w: (F.length(w) > 1) & ~_among(w, lx.OFF_TOPIC))
    return F.array_sort(F.array_distinct(F.transform(kept, stem)))


def _lookup(table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def worth(obj: Column | str) -> Column:
    """-1, 0 or 1: the polarity of the object's first evaluative word."""
    valued = F.filter(F.split(_col(obj), " ", -1), lambda w: _among(w, lx.EVALUATIVE))
    return F.coalesce(F.try_element_at(_lookup(lx.EVALUATIVE), F.get(valued, F.lit(0))), F.lit(0))


def polarity(predicate: Column | str, obj: Column | str) -> Column:
    """-1, 0 or 1: the verb's polarity times that of the object's first evaluative word where both have one; `not` negates."""
    return _named(_polarity, predicate, obj) if isinstance(predicate, str) and isinstance(obj, str) else _polarity(predicate, obj)


def _polarity(predicate: Column | str, obj: Column | str) -> Column:
    return spoken_polarity(predicate, worth(obj))


def spoken_polarity(predicate: Column | str, word: Column) -> Column:
    """polarity, of an object whose worth is known."""
    p = _col(predicate)
    base = F.when(p.startswith("not "), F.substring(p, 5, 2**31 - 1)).otherwise(p)
    signed = lambda sign: _among(base, [k for k, v in lx.VERB_POLARITY.items() if v == sign])
    verb = F.when(signed(1), 1).when(signed(-1), -1).otherwise(0)
    both = F.when((verb != 0) & (word != 0), verb * word).when(verb != 0, verb).otherwise(word)
    return F.when(p.startswith("not "), -both).otherwise(both).cast("int")


def host(source: Column | str) -> Column:
    return F.substring_index(_col(source), "/", 1)


def recency(added: Column | str, now: float) -> Column:
    """Halves every 365 days of age, down to 0.05; what is dated ahead counts as new."""
    age = F.greatest(F.lit(0.0), (F.lit(float(now)) - _col(added)) / 86400.0)
    return F.greatest(F.lit(LEAST_RECENCY), F.pow(F.lit(0.5), age / HALF_LIFE_DAYS))


def route_key(text: Column | str) -> Column:
    return F.array_join(stems(text), " ")


# The same in DuckDB's SQL, for the twins of queries.


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all(replace(replace(replace(lower({x}), 'won''t', 'will not'), 'can''t', 'cannot'), 'n''t', ' not'), '[a-z0-9]+(?:''[a-z]+)?')"


def sql_stem(w: str) -> str:
    return f"CASE WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN {w}[:length({w}) - 3] || 'y' WHEN length({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN {w}[:length({w}) - 1] ELSE {w} END"


def sql_stems(x: str) -> str:
    return f"list_sort(list_distinct(list_transform(list_filter({sql_tokens(x)}, lambda w: length(w) > 1 AND NOT list_contains({_list(lx.OFF_TOPIC)}, w)), lambda w: {sql_stem('w')})))"


def sql_polarity(p: str, o: str) -> str:
    base = f"regexp_replace({p}, '^not ', '')"
    verb = f"CASE WHEN list_contains({_list(lx.POSITIVE)}, {base}) THEN 1 WHEN list_contains({_list(lx.NEGATIVE)}, {base}) THEN -1 ELSE 0 END"
    first = f"list_filter(string_split({o}, ' '), lambda w: list_contains({_list(lx.EVALUATIVE)}, w))[1]"
    word = f"CASE WHEN list_contains({_list(lx.GOOD)}, {first}) THEN 1 WHEN list_contains({_list(lx.BAD)}, {first}) THEN -1 ELSE 0 END"
    return f"(CASE WHEN {p} LIKE 'not %' THEN -1 ELSE 1 END * CASE WHEN ({verb}) <> 0 AND ({word}) <> 0 THEN ({verb}) * ({word}) WHEN ({verb}) <> 0 THEN ({verb}) ELSE ({word}) END)::INTEGER"


def sql_recency(added: str, now: float) -> str:
    return f"greatest({LEAST_RECENCY}, pow(0.5, greatest(0.0, ({float(now)}::DOUBLE - {added}) / 86400.0) / {HALF_LIFE_DAYS}))"
