"""The outline of saved routes and topic counts as text, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.ranges import dealt, last, numbered
from assayer.functions.shared import stored

# The lines of an outline.
ROUTE = r"^- \[\d+\] (.+?) :: verdict=(\S+) for=([\d.]+) against=([\d.]+) neutral=([\d.]+) t=(\d+) hits=(\d+)$"
STEP, LINK, TOPIC, SECTION = r"^  - \d+\. (.+)$", r"^    - (\S+)$", r"^- (.+?) :: (\d+)$", r"^## (.*)$"
TITLE = "# outline v1"
#: The place of the routes' heading among pieces.
ROUTES_AT = 1 << 40


def _lines(text: DataFrame) -> DataFrame:
    """(at, value, section, route_at, step_at, is_step): the lines in order, each with its section, and in routes the places of its route and of the last step or route."""
    pieces = text if "part" in text.columns else text.withColumn("part", F.lit(0))
    n = int(text.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = dealt(pieces.select("part", F.posexplode(F.split("text", "\n", -1)).alias("line", "value")), [F.col("part"), F.col("line")], "at", n).select("at", "value")
    value, at = F.col("value"), F.col("at")
    marked = stored(last(lines, "at", {"section": F.when(value.rlike(SECTION), F.trim(F.regexp_extract(value, SECTION, 1)))}).withColumns({"is_route": (F.col("section") == "routes") & value.rlike(ROUTE), "is_step": (F.col("section") == "routes") & value.rlike(STEP)}))
    route, step = F.col("is_route"), F.col("is_step")
    known = last(marked.withColumnRenamed("is_step", "steps_"), "at", {"route_at": F.when(route, at), "step_at": F.when(route | F.col("steps_"), at), "is_step": F.when(route, False).when(F.col("steps_"), True)})
    return stored(known.filter("section = 'topics' OR route_at IS NOT NULL").drop("is_route", "steps_"))


def parse(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routes, topics) of a table with `text`: one row, or pieces cut at line ends with their order (`part`).

    Later lines of the same route or topic win, other lines are passed over. Lines are dealt by ranges, so an outline of
    pieces is no task's as a whole.
    """
    lines = _lines(text)
    topics = lines.filter((F.col("section") == "topics") & F.col("value").rlike(TOPIC)).select("at", F.regexp_extract("value", TOPIC, 1).alias("topic"), F.regexp_extract("value", TOPIC, 2).cast("long").alias("count"))
    topics = topics.groupBy("topic").agg(F.max_by("count", "at").alias("count"))
    own = lines.filter("section = 'routes' AND route_at IS NOT NULL")
    g = lambda k: F.regexp_extract("value", ROUTE, k)
    heads = own.filter(F.col("at") == F.col("route_at")).select("route_at", g(1).alias("key"), g(2).alias("verdict"), g(3).cast("double").alias("for_share"), g(4).cast("double").alias("against_share"), g(5).cast("double").alias("neutral_share"), g(6).cast("long").alias("t"), g(7).cast("int").alias("hits"))
    heads = heads.join(heads.groupBy("key").agg(F.max("route_at").alias("route_at")).select("route_at"), "route_at", "left_semi")
    said = own.select("route_at", F.col("step_at").alias("s"), F.when(F.col("at") == F.col("step_at"), F.regexp_extract("value", STEP, 1)).alias("topic"), F.when((F.col("at") != F.col("step_at")) & F.col("value").rlike(LINK), F.struct("at", F.regexp_extract("value", LINK, 1).alias("v"))).alias("link"), "is_step")
    steps = said.filter(F.col("is_step") & (F.col("topic").isNotNull() | F.col("link").isNotNull())).groupBy("route_at", "s").agg(F.max("topic").alias("topic"), F.transform(F.array_sort(F.collect_list("link")), lambda x: x["v"]).alias("links"))
    per = steps.groupBy("route_at").agg(F.array_sort(F.collect_list(F.struct("s", "topic", "links"))).alias("steps"))
    routes = heads.join(per, "route_at", "left").withColumn("steps", F.coalesce(F.transform("steps", lambda x: F.struct(x["topic"].alias("topic"), x["links"].alias("links"))), F.array().cast("array<struct<topic: string, links: array<string>>>")))
    return numbered(stored(routes), [F.col("route_at")], "place").withColumn("place", F.col("place").cast("int")).drop("route_at"), topics


def counted(routes: DataFrame) -> DataFrame:
    """routes with n_steps and n_links in the place of their steps."""
    return routes.withColumn("n_steps", F.size("steps").cast("long")).withColumn("n_links", F.aggregate("steps", F.lit(0).cast("long"), lambda n, s: n + F.size(s["links"]))).drop("steps")


def _topic_line() -> Column:
    return F.concat(F.lit("- "), "topic", F.lit(" :: "), F.col("count").cast("string"), F.lit("\n"))


def _block() -> Column:
    """A route's lines behind its number."""
    step = lambda s, j: F.concat(F.format_string("  - %d. %s\n", j + 1, s["topic"]), F.array_join(F.transform(s["links"], lambda x: F.concat(F.lit("    - "), x, F.lit("\n"))), ""))
    line = F.format_string("] %s :: verdict=%s for=%.3f against=%.3f neutral=%.3f t=%d hits=%d\n", "key", "verdict", "for_share", "against_share", "neutral_share", "t", "hits")
    return F.concat(line, F.array_join(F.transform("steps", step), ""))


def pieces(routes: DataFrame, topics: DataFrame) -> DataFrame:
    """(part, text): the outline in pieces, to be put together in the order of part: topics by count (ties by topic), then routes by place with their steps and links.

    A topic or a route is a piece, so an outline of any size is rendered by all tasks.
    """
    heads = routes.sparkSession.createDataFrame([(0, f"{TITLE}\n## topics\n"), (ROUTES_AT, "## routes\n")], "part long, text string")
    named = numbered(topics.select("topic", "count", _topic_line().alias("text")), [F.desc("count"), F.asc("topic")], "n").select(F.col("n").alias("part"), "text")
    told = numbered(routes.select("place", _block().alias("block")), [F.col("place"), F.col("block")], "n")
    blocks = told.select((F.col("n") + ROUTES_AT).alias("part"), F.concat(F.lit("- ["), F.col("n").cast("string"), "block").alias("text"))
    return heads.unionByName(named).unionByName(blocks).filter("text IS NOT NULL")


def render(routes: DataFrame, topics: DataFrame) -> DataFrame:
    """One row with the text, for an outline that fits one (`shrink`)."""
    rows = pieces(routes, topics).agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("rows"))
    return rows.select(F.array_join(F.transform("rows", lambda r: r["text"]), "").alias("text"))


def _digits(n: int) -> int:
    """Of the numbers from 1 to n."""
    return sum(n - 10**k + 1 for k in range(len(str(n)))) if n else 0


def shrink(routes: DataFrame, topics: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """routes and topics whose text fits the cap: tenths of the routes with the fewest hits go, the oldest first, then of the rarest topics."""
    sized = lambda rows, text: stored(rows.withColumn("bytes_", F.coalesce(F.octet_length(text), F.lit(0))))
    kept = [numbered(sized(routes, _block()), [F.col("hits"), F.col("t"), F.col("place")], "n_"), numbered(sized(topics, _topic_line()), [F.col("count"), F.desc("topic")], "n_")]
    left, gone = [rows.count() for rows in kept], [0, 0]
    while True:
        held = [rows.filter(F.col("n_") > k) for rows, k in zip(kept, gone, strict=True)]
        text = sum(rows.agg(F.coalesce(F.sum("bytes_"), F.lit(0))).first()[0] for rows in held)
        if len(f"{TITLE}\n## topics\n## routes\n") + text + len("- [") * left[0] + _digits(left[0]) <= cap or not sum(left):
            return tuple(rows.drop("bytes_", "n_") for rows in held)
        which = 0 if left[0] else 1
        less = max(1, left[which] // 10)
        left[which], gone[which] = left[which] - less, gone[which] + less


def save_route(routes: DataFrame, new: DataFrame) -> DataFrame:
    """routes with the new ones; one that replaces its like takes its place, and its hits and one more."""
    old = routes.select("key", F.col("hits").alias("h"), F.col("place").alias("p"))
    last = routes.agg(F.coalesce(F.max("place"), F.lit(0)).alias("last"))
    taken = new.join(old, "key", "left").crossJoin(last).withColumn("hits", F.coalesce(F.col("h") + 1, F.col("hits")).cast("int")).withColumn("place", F.coalesce("p", F.col("last") + F.row_number().over(Window.partitionBy(F.col("p").isNull()).orderBy("key"))).cast("int"))
    return routes.join(new.select("key"), "key", "left_anti").unionByName(taken.select(*routes.columns))


def mark_hits(routes: DataFrame, keys: DataFrame) -> DataFrame:
    """routes with one more hit where their key was replayed."""
    used = keys.select("key").distinct().withColumn("used", F.lit(1))
    return routes.join(used, "key", "left").withColumn("hits", (F.col("hits") + F.coalesce("used", F.lit(0))).cast("int")).drop("used")
