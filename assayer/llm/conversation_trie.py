"""Prefix trie of conversations: each owns the nodes of which it is the smallest member.

A conversation that owns a prefix owns all longer ones of its own, so its nodes are a chain from its first owned depth down.
That depth is found by binary search: in each round every open conversation asks for the smallest member of one of its
prefixes, in one join against the minima of prefix digests. Chains form a tree, whose sums go up from chain to chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import arrow_batches, crc32_sql, stored, table
from assayer.functions.ranges import running

#: Lanes of 32 bits of a turn's digest; their sums over a prefix, kept whole, tell prefixes apart.
LANES = 5
#: Ids that are put into one piece of a list of members.
PIECE = 4096
NONE_SHA256 = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos from 1, content, size): a 128-bit digest of role and text in place of them, and the text's code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    content = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), content.alias("content"), F.length(text).cast("long").alias("size"))
    turns = stored(turns.withColumn("row", F.monotonically_increasing_id()))
    placed = running(turns, ["conv"], [F.col("turn").asc_nulls_first(), F.col("content"), F.col("row")], {"pos": F.lit(1)})
    return stored(placed.select("conv", "pos", "content", "size"))


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """turns in which each conversation c begins with the first crc32(c) % most turns of c - c % every in place of as many of its own."""
    ids = stored(turns.groupBy("conv").agg(F.max("pos").alias("n")))
    cut = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    base = turns.filter((F.col("conv") % every == 0) & (F.col("pos") < most)).withColumnRenamed("conv", "base")
    begins = ids.select("conv", (F.col("conv") - F.col("conv") % every).alias("base"), cut.alias("cut")).join(base, "base").filter(F.col("pos") <= F.col("cut"))
    # Where the other conversation is shorter than the cut, what follows moves up.
    short = ids.withColumn("base", F.col("conv") - F.col("conv") % every).join(ids.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left").select("conv", (cut - F.least(cut, F.coalesce("n_base", F.lit(0)))).alias("shift")).filter("shift > 0")
    own = turns.filter(F.col("pos") > cut).join(short, "conv", "left").withColumn("pos", F.col("pos") - F.coalesce("shift", F.lit(0)))
    return begins.select("conv", "pos", "content", "size").unionByName(own.select("conv", "pos", "content", "size"))


def prefixes(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv, depth, key, size): a digest of each prefix, the root's included; size is that of the last turn's text.

    A turn's digest takes in its place, so that the sums of the digests, lane by lane, tell which turn stands where.
    """
    digest = F.sha2(F.concat(F.col("content"), F.col("depth").cast("string").cast("binary")), 256)
    dealt = stored(turns.select("conv", F.col("pos").alias("depth"), "content", "size"))
    lanes = {f"lane{k}": F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(LANES)}
    summed = running(dealt.select("conv", "depth", "size", *[v.alias(f"own_{k}") for k, v in lanes.items()]), ["conv"], [F.col("depth")], {k: F.col(f"own_{k}") for k in lanes})
    keyed = summed.select("conv", "depth", F.unhex(F.md5(F.concat_ws(",", "depth", *lanes).cast("binary"))).alias("key"), "size")
    root = F.unhex(F.md5(F.lit("root").cast("binary")))
    return stored(keyed.unionByName(ids.select("conv", F.lit(0).cast("long").alias("depth"), root.alias("key"), F.lit(0).cast("long").alias("size"))))


def first_owned(ids: DataFrame, paths: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv, n, first, parent): the first depth that conv owns (n + 1: none) and the owner of the node above it (of the smallest conversation: null).

    Prefixes of one member are owned by it, so only the others are asked. A round halves the prefixes that are open; as many
    rounds are run as the longest conversation needs.
    """
    shared = stored(minima.filter("members > 1").select("key", "owner"))
    lengths = stored(paths.groupBy("conv").agg(F.max("depth").alias("n")))
    longest = lengths.agg(F.max("n")).first()[0]
    if longest is None:
        return lengths.select("conv", "n", F.col("n").alias("first"), F.col("conv").alias("parent"))
    fates = stored(lengths.withColumns({"low": F.lit(0).cast("long"), "high": F.col("n") + 1, "parent": F.lit(None).cast("long")}))
    open_ = paths.select("conv", "depth", "key")
    done = []
    for _ in range((longest + 1).bit_length()):
        middle = F.shiftright(F.col("low") + F.col("high"), 1)
        asked = fates.join(open_, "conv").filter(F.col("depth") == middle)
        met = asked.join(shared, "key", "left")
        owned = F.col("owner").isNull() | (F.col("owner") == F.col("conv"))
        fates = stored(met.select("conv", "n", F.when(owned, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(owned, F.col("depth")).otherwise(F.col("high")).alias("high"), F.when(owned, F.col("parent")).otherwise(F.col("owner")).alias("parent")))
        done.append(fates.filter("low = high").select("conv", "n", F.col("low").alias("first"), "parent"))
        fates = fates.filter("low < high")
        open_ = stored(open_.join(fates.select("conv", "low", "high"), "conv").filter("depth >= low AND depth < high").select("conv", "depth", "key"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return stored(out)


def _up(chains: DataFrame, names: list[str]) -> DataFrame:
    """Sums over each chain and all below it, by doubling: after k rounds a chain holds what is under 2^k steps below it.

    chains: conv, up (the chain above) and the named sums of its own; rounds grow as the logarithm of the tree's height.
    """
    held = stored(chains)
    while not held.filter(F.col("up").isNotNull()).isEmpty():
        more = held.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("conv")).agg(*[F.sum(n).alias(f"{n}_more") for n in names])
        above = held.select(F.col("conv").alias("up"), F.col("up").alias("above"))
        summed = held.join(more, "conv", "left").join(above, "up", "left")
        held = stored(summed.select("conv", F.col("above").alias("up"), *[(F.col(n) + F.coalesce(f"{n}_more", F.lit(0))).alias(n) for n in names]))
    return held.drop("up")


_PIECES = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
_HASHES = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (owner, depth, conv) as joined runs of up to PIECE ids of one node."""

    def runs():
        node, held = None, []
        for batch in batches:
            for owner, depth, conv in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (owner, depth) != node or len(held) >= PIECE:
                    if held:
                        yield *node, held[0], ",".join(map(str, held))
                    node, held = (owner, depth), []
                held.append(conv)
        if held:
            yield *node, held[0], ",".join(map(str, held))

    return arrow_batches(runs(), _PIECES, 64)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of each node as the SHA-256 of the whole list, which is never put together."""

    def nodes():
        node, state = None, None
        for batch in batches:
            for owner, depth, _, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (owner, depth) != node:
                    if node:
                        yield *node, state.hexdigest()
                    node, state = (owner, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if node:
            yield *node, state.hexdigest()

    return arrow_batches(nodes(), _HASHES)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) for (owner, depth, conv): the hash of a node's conversations, in order and comma-joined.

    Ranges of (node, id) join up to PIECE ids a row, in parallel; then one task hashes a node's rows as they come. SHA-256
    can only be taken in sequence, so that is the least that one task must read; it holds one row at a time.
    """
    pieces = ends.select("owner", "depth", "conv").repartitionByRange("owner", "depth", "conv").sortWithinPartitions("owner", "depth", "conv").mapInArrow(_pieces, "owner long, depth long, first long, ids string")
    return pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(_hashed, "owner long, depth long, ends_sha256 string")


def trie(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The prefix tree of conversations given as (conv, pos from 1 without gaps, content, size); `ids` also has those without a turn.

    One row per node: conv_id (smallest member), depth, parent_conv_id (the parent's; the root's is null), n_convs,
    n_children, n_leaves (in its subtree, itself included if it has no child), saved_tokens (over its subtree, members less one times
    size of the last turn), ends_sha256 (of the ids of the conversations that end here). No conversations, no nodes.
    """
    ids = stored(turns.select("conv").distinct() if ids is None else ids.select("conv").distinct())
    paths = prefixes(ids, turns)
    minima = stored(paths.groupBy("key").agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("members"), F.first("depth").alias("depth"), F.first("size").alias("size")))
    fates = first_owned(ids, paths, minima)
    ends = fates.select(F.when(F.col("first") > F.col("n"), F.col("parent")).otherwise(F.col("conv")).alias("owner"), F.col("n").alias("depth"), "conv")
    chains = stored(fates.filter("first <= n").select("conv", "n", "first", "parent"))
    hung = chains.filter("first > 0").select(F.col("parent").alias("owner"), (F.col("first") - 1).alias("depth"), "conv")
    # A chain ends in a leaf unless another hangs from its last node.
    below_end = hung.join(chains.select(F.col("conv").alias("owner"), F.col("n").alias("depth")), ["owner", "depth"], "left_semi").select(F.col("owner").alias("conv")).distinct().withColumn("goes_on", F.lit(True))
    saved = minima.filter("members > 1").groupBy(F.col("owner").alias("conv")).agg(F.sum((F.col("members") - 1) * F.col("size")).alias("saved"))
    alone = chains.join(below_end, "conv", "left").join(saved, "conv", "left").select("conv", F.col("parent").alias("up"), F.when(F.col("goes_on"), 0).otherwise(1).cast("long").alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
    sums = _up(alone, ["leaves", "saved"])
    met = hung.join(sums, "conv").groupBy("owner", "depth").agg(F.count(F.lit(1)).alias("hung"), F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    joined = minima.join(chains.withColumnRenamed("conv", "owner"), "owner").join(met, ["owner", "depth"], "left")
    last = F.col("depth") == F.col("n")
    hung_here = F.coalesce("hung", F.lit(0))
    nodes = stored(
        joined.select(
            "owner", "depth", F.when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("owner")).alias("parent_conv_id"), "members", (hung_here + F.when(last, 0).otherwise(1)).alias("n_children"),
            (F.coalesce("hung_leaves", F.lit(0)) + F.when(last & (hung_here == 0), 1).otherwise(0)).alias("leaves"), ((F.col("members") - 1) * F.col("size") + F.coalesce("hung_saved", F.lit(0))).alias("saved"),
        )
    )
    whole = running(nodes, ["owner"], [F.desc("depth")], {"n_leaves": F.col("leaves"), "saved_tokens": F.col("saved")})
    hashed = whole.join(ends_digest(ends), ["owner", "depth"], "left")
    return hashed.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", F.col("members").alias("n_convs"), F.col("n_children").cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
        F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE_SHA256)).alias("ends_sha256"),
    )


def op11(spark, sf_dir):
    """Turns in the order of turn (null first; ties by a digest of role and text); rows without a conv_id belong to no conversation."""
    turns = turns_of(table(spark, sf_dir, "conversations"))
    return trie(stored(rebuilt(turns)), turns)


def twin() -> str:
    """The query in DuckDB's SQL: every prefix as a list of digests, every node with its ancestors."""
    return f"""
WITH {crc32_sql("(SELECT DISTINCT conv_id::VARCHAR AS x FROM conversations WHERE conv_id IS NOT NULL)")},
said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, md5(strlen(role) || ':' || role || text) AS content, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS pos FROM said),
ids AS (SELECT conv_id, max(pos) AS n FROM turns GROUP BY conv_id),
cuts AS (SELECT i.conv_id, i.conv_id - i.conv_id % 100 AS base, crc % 6 AS cut FROM ids i JOIN crcs ON x = i.conv_id::VARCHAR),
kept AS (SELECT c.*, least(cut, coalesce(b.n, 0)) AS got FROM cuts c LEFT JOIN ids b ON b.conv_id = base),
rebuilt AS (
  SELECT k.conv_id, t.pos AS depth, content, size FROM kept k JOIN turns t ON t.conv_id = base AND t.pos <= cut
  UNION ALL
  SELECT k.conv_id, t.pos - cut + got, content, size FROM kept k JOIN turns t ON t.conv_id = k.conv_id AND t.pos > cut),
paths AS MATERIALIZED (
  SELECT conv_id, depth, size, md5(array_to_string(list(content) OVER (PARTITION BY conv_id ORDER BY depth), ',')) AS key FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, 'root' FROM ids),
nodes AS MATERIALIZED (SELECT key, depth, min(conv_id) AS owner, count(*) AS members, any_value(size) AS size FROM paths GROUP BY key, depth),
parents AS (SELECT n.key, p.key AS parent FROM nodes n JOIN paths p ON p.conv_id = n.owner AND p.depth = n.depth - 1),
children AS (SELECT parent AS key, count(*) AS n FROM parents GROUP BY parent),
sums AS (
  SELECT p.key, sum((members - 1) * n.size) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM nodes n LEFT JOIN children c ON c.key = n.key JOIN paths p ON p.conv_id = n.owner AND p.depth <= n.depth GROUP BY p.key),
lengths AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
ends AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS hash FROM paths JOIN lengths USING (conv_id, depth) GROUP BY key)
SELECT n.owner AS conv_id, n.depth::BIGINT AS depth, o.owner AS parent_conv_id, n.members::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(hash, '{NONE_SHA256}') AS ends_sha256
FROM nodes n JOIN sums s ON s.key = n.key LEFT JOIN children c ON c.key = n.key LEFT JOIN parents p ON p.key = n.key LEFT JOIN nodes o ON o.key = p.parent LEFT JOIN ends e ON e.key = n.key
"""
