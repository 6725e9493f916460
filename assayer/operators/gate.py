"""Which sources are heard: trust by host suffix, document size, and where a fetch may go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.shared import stored

MOST_BYTES = 256 * 1024


def suffixes(host: Column) -> Column:
    """a.b.c, b.c and c for the host a.b.c."""
    parts = F.split(F.lower(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def with_trust(docs: DataFrame, trust: DataFrame, host: Column, default: float = 0.0) -> DataFrame:
    """docs with the trust of their host's longest suffix in trust (host, trust), else the default; rows stay one for one.

    Hosts meet the list once each, whatever their number of documents. A null host has the default.
    """
    keyed = docs.withColumn("__host", F.lower(host))
    listed = trust.select(F.lower("host").alias("suffix"), F.col("trust").alias("given"))
    hosts = keyed.select("__host").filter("__host IS NOT NULL").distinct()
    met = hosts.select("__host", F.posexplode(suffixes(F.col("__host"))).alias("at", "suffix")).join(listed, "suffix")
    found = stored(met.groupBy("__host").agg(F.min_by("given", "at").alias("__trust")))  # of known size, so that a short list is broadcast and no host's texts are one task's
    return keyed.join(found, "__host", "left").withColumn("trust", F.coalesce("__trust", F.lit(float(default)))).drop("__host", "__trust")


def fits(text: Column | str) -> Column:
    """At most 256 KiB of UTF-8."""
    return F.octet_length(F.col(text) if isinstance(text, str) else text) <= MOST_BYTES


def admit(docs: DataFrame, trust: DataFrame, default: float = 0.0) -> DataFrame:
    """docs (locator, text) with trust and admitted: trusted sources with texts of fitting size."""
    return with_trust(docs, trust, F.substring_index("locator", "/", 1), default).withColumn("admitted", (F.col("trust") > 0) & F.coalesce(fits("text"), F.lit(False)))


def _is_public_v4(a: Column) -> Column:
    ok = a.rlike(r"\A(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!\z)|\z)){4}\z")
    n = [F.try_element_at(F.split(a, r"\."), F.lit(k)).try_cast("int") for k in (1, 2, 3)]
    private = (
        n[0].isin(0, 10, 127) | (n[0] >= 224) | ((n[0] == 100) & n[1].between(64, 127)) | ((n[0] == 169) & (n[1] == 254)) | ((n[0] == 172) & n[1].between(16, 31))
        | ((n[0] == 192) & (n[1] == 168)) | ((n[0] == 192) & (n[1] == 0) & n[2].isin(0, 2)) | ((n[0] == 198) & n[1].isin(18, 19)) | ((n[0] == 198) & (n[1] == 51) & (n[2] == 100)) | ((n[0] == 203) & (n[1] == 0) & (n[2] == 113))
    )
    return F.coalesce(ok & ~private, F.lit(False))


def _is_public_v6(a: Column) -> Column:
    """Eight numbers, some zeros of which :: can stand for; the last two can be written as an IPv4 address, which is judged where ::ffff:0:0/96 maps it."""
    dotted = F.regexp_extract(a, r"(?<=:)(\d{1,3}(?:\.\d{1,3}){3})\z", 1)
    sides = F.split(F.when(dotted != "", F.regexp_replace(a, r"(?<=:)[\d.]+\z", "0:0")).otherwise(a), "::", -1)
    parts = [F.when(F.coalesce(F.get(sides, F.lit(k)), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(sides, F.lit(k)), ":", -1)) for k in (0, 1)]
    missing = F.lit(8) - F.size(parts[0]) - F.size(parts[1])
    shaped = ((F.size(sides) == 2) & (missing >= 1)) | ((F.size(sides) == 1) & (missing == 0))
    every = F.concat(parts[0], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), parts[1])
    sound = shaped & F.forall(every, lambda x: x.rlike(r"\A[0-9a-f]{1,4}\z"))
    n = F.transform(every, lambda x: F.conv(x, 16, 10).try_cast("int"))
    first, rest = F.get(n, F.lit(0)), F.slice(n, 2, 7)
    zeros = F.forall(F.slice(n, 1, 7), lambda x: x == 0)
    mapped = F.forall(F.slice(n, 1, 5), lambda x: x == 0) & (F.get(n, F.lit(5)) == 0xFFFF)
    bytes_ = F.concat_ws(".", *[F.floor(F.get(n, F.lit(k)) / d).cast("int").bitwiseAND(F.lit(255)).cast("string") for k in (6, 7) for d in (256, 1)])
    private = (zeros & (F.get(n, F.lit(7)) <= 1)) | (first.bitwiseAND(F.lit(0xFE00)) == 0xFC00) | first.bitwiseAND(F.lit(0xFFC0)).isin(0xFE80, 0xFEC0) | (first >= 0xFF00)
    return F.coalesce(F.when(sound & (F.size(rest) == 7), F.when(mapped, _is_public_v4(F.when(dotted != "", dotted).otherwise(bytes_))).otherwise(~private)), F.lit(False))


def is_public_ip(address: Column | str) -> Column:
    """Whether an IPv4 or IPv6 address is one of the public internet's; what isn't such an address is not."""
    a = F.lower(F.col(address) if isinstance(address, str) else address)
    return F.when(F.contains(a, F.lit(":")), _is_public_v6(a)).otherwise(_is_public_v4(a))


def is_fetchable(url: Column | str, hosts: list[str]) -> Column:
    """https to exactly one of the hosts, on the default port, without credentials."""
    u = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.try_parse_url(u, F.lit("HOST")))
    authority = F.try_parse_url(u, F.lit("AUTHORITY"))
    fine = (F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))) == "https") & host.isin([h.lower() for h in hosts]) & (F.lower(authority).isin([h.lower() for h in hosts] + [f"{h.lower()}:443" for h in hosts]))
    return F.coalesce(fine, F.lit(False))
