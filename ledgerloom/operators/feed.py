"""Change feeds: what subscribers see, patterns, replays and resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..session import partitions, stash
from .ledger import ledger_generation
from .state import generation, numbered

RING = 1024
#: Event kinds, their verbs and HTTP names.
VERBS = {"put": ("replace", "PUT"), "append": ("append", "POST"), "format": ("format", "FORMAT"), "delete_intent": ("delete", "DELETE"), "delete_commit": ("delete", "DELETE"), "delete_commit_failed": ("delete", "DELETE")}


def _mapped(kind: Column, at: int) -> Column:
    return F.coalesce(*[F.when(kind == k, v[at]) for k, v in VERBS.items()])


def changes(events: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """op_id, part, world, verb, method, generation, seq, etag, event_type, body_sha256, size, content_type, cursor.

    An op gives its format change first, then its own; a delete the ledger's intent, a ping of the subject without a
    cursor of its own, and the commit. part orders the changes of one op.
    """
    kind = F.col("event_type")
    part = lambda e: F.when(F.col("event_type") == "format", 0).when(F.col("event_type") == "delete_intent", 1).when(F.col("event_type").startswith("delete"), 3).otherwise(1)

    def of(e: DataFrame) -> DataFrame:
        return e.select(
            "op_id",
            part(e).alias("part"),
            "world",
            _mapped(kind, 0).alias("verb"),
            _mapped(kind, 1).alias("method"),
            "generation",
            "seq",
            F.concat(F.lit("hmac-"), F.col("hmac")).alias("etag"),
            "event_type",
            "target",
            "body_sha256",
            "size",
            "content_type",
            paths.cursor(F.col("world"), F.col("generation"), F.col("seq")).alias("cursor"),
        )

    out = of(events)
    if ledger is not None:
        null = lambda kind: F.lit(None).cast(kind)
        ping = ledger.where("event_type = 'delete_intent'").select(
            "op_id", F.lit(2).alias("part"), F.col("target").alias("world"), F.lit("delete").alias("verb"), F.lit("DELETE").alias("method"), null("string").alias("generation"), null("long").alias("seq"),
            F.lit("").alias("etag"), null("string").alias("event_type"), null("string").alias("target"), null("string").alias("body_sha256"), null("long").alias("size"), null("string").alias("content_type"), null("string").alias("cursor"),
        )
        out = out.unionByName(of(ledger)).unionByName(ping)
    return out


def delivered(feed: DataFrame) -> DataFrame:
    """feed with delivery_id, 1 for the first change of all. Rows are dealt out by sampled ranges, sorted and stored; a row's
    place in its range and the counts of the ranges before (one number a range) give its number."""
    order = ["op_id", "part", "seq"]
    f = feed.repartitionByRange(partitions(feed.sparkSession), *order).sortWithinPartitions(*order)
    f = stash(f.withColumns({"range": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "feed")
    sums = f.groupBy("range").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    base = sums.select("range", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("range")) - F.col("n") - F.col("low") + 1).alias("base"))
    return f.join(F.broadcast(base), "range").withColumn("delivery_id", F.col("base") + F.col("at")).drop("range", "at", "base")


def positions(ops: DataFrame) -> DataFrame:
    """delivery_id, op_id, part, world, verb, generation, seq and cursor of delivered(changes(events, ledger)), from the ops
    alone: none of these depends on a body, a digest or an HMAC, so no chain is built for them.

    Ops, not changes, are dealt out: an op's changes follow each other, so their numbers and those of the ledger's rows are
    running sums of how many changes and deletes the ops before it have. op_ids are unique.
    """
    n = partitions(ops.sparkSession)
    rows = numbered(ops.select("op_id", "world", "verb").repartition(n, "world")).where("accepted")
    # the delete is the last op of its life, so it moves no body event's seq
    nth = F.row_number().over(Window.partitionBy("world", "g").orderBy("op_id")) + 1
    rows = stash(rows.select("op_id", "world", "g", "verb", nth.cast("long").alias("seq")), "accepted")
    gone = F.col("verb") == "delete"
    counts = {"n": F.when(gone, 3).when(F.col("seq") == 2, 2).otherwise(1), "d": gone.cast("long")}
    ranged = rows.repartitionByRange(n, "op_id").withColumn("range", F.spark_partition_id())
    before = Window.partitionBy("range").orderBy("op_id").rowsBetween(Window.unboundedPreceding, 0)
    ranged = stash(ranged.withColumns({f"{c}_to": F.sum(v).over(before) for c, v in counts.items()}), "positions")
    sums = ranged.groupBy("range").agg(F.max("n_to").alias("n"), F.max("d_to").alias("d"))  # a row a range
    order = Window.partitionBy(F.lit(0)).orderBy("range")
    base = sums.select("range", *[(F.sum(c).over(order) - F.col(c)).alias(f"{c}_base") for c in counts])
    out = ranged.join(F.broadcast(base), "range")
    deletes = F.col("d_base") + F.col("d_to") - counts["d"]
    # the first delete also brings the ledger's format row
    passed = F.col("n_base") + F.col("n_to") - counts["n"] + F.when(deletes > 0, 1).otherwise(0)
    out = out.withColumns({"deletes": deletes, "passed": passed})
    change = lambda part, world, verb, seq, g: F.struct(F.lit(part).alias("part"), world.alias("world"), verb.alias("verb"), seq.cast("long").alias("seq"), g.cast("long").alias("g"))
    of, form, k = F.col("g"), F.lit("format"), 2 * F.col("deletes")
    book = lambda part, verb, seq: change(part, F.lit(paths.LEDGER), F.lit(verb), seq, F.lit(None))
    three = [book(1, "delete", k + 2), change(2, F.col("world"), F.lit("delete"), F.lit(None), of), book(3, "delete", k + 3)]
    own = change(1, F.col("world"), F.col("verb"), F.col("seq"), of)
    each = (
        F.when(gone & (F.col("deletes") == 0), F.array(book(0, "format", F.lit(1)), *three))
        .when(gone, F.array(*three))
        .when(F.col("seq") == 2, F.array(change(0, F.col("world"), form, F.lit(1), of), own))
        .otherwise(F.array(own))
    )
    out = out.select("op_id", "passed", F.posexplode(each).alias("at", "c"))
    out = out.select((F.col("passed") + F.col("at") + 1).alias("delivery_id"), "op_id", "c.*")
    life = F.when(F.col("seq").isNull(), None).when(F.col("g").isNull(), ledger_generation()).otherwise(generation(F.col("world"), F.col("g")))
    out = out.withColumn("generation", life).drop("g")
    return out.withColumn("cursor", paths.cursor(F.col("world"), F.col("generation"), F.col("seq")))


def normalise(pattern: str) -> str:
    if pattern in ("", "/", "*", "/*"):
        return "*"
    return pattern if pattern.startswith("/") else f"/{pattern}"


def matches(world: Column, pattern: str) -> Column:
    """All, a raw byte prefix, or one world. Only the prefix and equality reach the scan as filters."""
    p = normalise(pattern)
    if p == "*":
        return F.lit(True)
    if p.endswith("*"):
        return world.startswith(p[1:-1])
    return world == p[1:]


def ring(feed: DataFrame, most: int = RING) -> DataFrame:
    """The last `most` deliveries."""
    top = feed.agg(F.max("delivery_id").alias("top"))
    return feed.crossJoin(F.broadcast(top)).where(F.col("delivery_id") > F.col("top") - most).drop("top")


def ring_of(feed: DataFrame, most: int = RING) -> DataFrame:
    """ring(delivered(feed), most) without numbers for all the rest: the bounded top of the order, and one count."""
    last = [F.desc("op_id"), F.desc("part"), F.desc("seq")]
    top = feed.orderBy(*last).limit(most).withColumn("back", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*last)))
    n = feed.agg(F.count("*").alias("n"))
    return top.crossJoin(F.broadcast(n)).withColumn("delivery_id", F.col("n") - F.col("back") + 1).drop("n", "back")


def resume(requests: DataFrame, live: DataFrame, events: DataFrame, most: int = RING) -> DataFrame:
    """requests (exact: a world, cursor) with outcome and replayed (number of changes); for wildcards see resume_ring.

    live: (world, generation). Outcomes: replay, or a reset for ring_miss, incarnation or truncation (no such row).
    """
    world, generation, seq = paths.cursor_parts(F.col("cursor"))
    r = requests.withColumns({"c_world": world, "c_generation": generation, "c_seq": seq.try_cast("long")})
    now = live.select(F.col("world").alias("c_world"), F.col("generation").alias("now"))
    per = events.groupBy("world", "generation").agg(F.max("seq").alias("top"))
    per = per.select(F.col("world").alias("c_world"), F.col("generation").alias("now"), "top")
    marker = events.select(F.col("world").alias("c_world"), F.col("generation").alias("now"), F.col("seq").alias("c_seq"), F.lit(True).alias("there"))
    out = r.join(now, "c_world", "left").join(per, ["c_world", "now"], "left").join(marker, ["c_world", "now", "c_seq"], "left")
    after = F.col("top") - F.col("c_seq")
    outcome = (
        F.when(F.col("exact") != F.col("c_world"), "ring_miss")
        .when(F.col("now").isNull(), "ring_miss")
        .when(F.col("now") != F.col("c_generation"), "incarnation")
        .when(F.col("there").isNull(), "truncation")
        .when(after > most, "ring_miss")
        .otherwise("replay")
    )
    out = out.withColumn("outcome", outcome)
    return out.select(*requests.columns, "outcome", F.when(F.col("outcome") == "replay", after).alias("replayed"))


def replay_after(events: DataFrame, cursors: DataFrame, most: int = RING) -> DataFrame:
    """The events that follow each (world, generation, marker) in its chain, with status replay; where they are more than
    `most`, one row with the status ring_miss and no event instead, the reset that a subscriber gets."""
    out = events.join(cursors, ["world", "generation"]).where("seq > marker")
    n = F.count("*").over(Window.partitionBy("world", "generation", "marker"))
    out = out.withColumn("n", n)
    rows = out.where(F.col("n") <= most).drop("n").withColumn("status", F.lit("replay"))
    gone = out.where(F.col("n") > most).select("world", "generation", "marker").distinct().withColumn("status", F.lit("ring_miss"))
    return rows.unionByName(gone, allowMissingColumns=True)


def resume_ring(requests: DataFrame, ringed: DataFrame) -> DataFrame:
    """requests (cursor) of wildcard subscribers with outcome and replayed: the deliveries of the ring that follow the
    cursor's, or the reset ring_miss where the ring no longer holds it. The ring is bounded, so it is broadcast."""
    at = ringed.where("cursor is not null").select("cursor", F.col("delivery_id").alias("at"))
    top = ringed.agg(F.max("delivery_id").alias("top"))
    out = requests.join(F.broadcast(at), "cursor", "left").crossJoin(F.broadcast(top))
    return out.select(*requests.columns, F.when(F.col("at").isNull(), "ring_miss").otherwise("replay").alias("outcome"), (F.col("top") - F.col("at")).alias("replayed"))


def fenced(live: DataFrame, fence: DataFrame) -> DataFrame:
    """Live changes that a replay up to (world, generation, floor) has not delivered; a newer generation resets."""
    f = fence.select("world", F.col("generation").alias("fence_generation"), "floor")
    out = live.join(f, "world", "left")
    same = F.col("generation") == F.col("fence_generation")
    out = out.where(F.col("floor").isNull() | F.col("generation").isNull() | ~same | (F.col("seq") > F.col("floor")))
    return out.withColumn("reset", F.coalesce(~same, F.lit(False))).drop("fence_generation", "floor")


def sse_frame(feed: DataFrame) -> DataFrame:
    """feed with frame: the text of a server-sent event."""
    has = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"data: {label}: "), c))
    col = lambda n: F.col(n).cast("string")
    body = F.col("event_type").isin("put", "append")
    lines = [
        F.concat(F.lit("event: "), F.lower("method")),
        F.concat(F.lit("data: path: /"), F.col("world")),
        F.concat(F.lit("data: method: "), F.col("method")),
        has("etag", F.col("etag")),
        F.when(body, has("timeline-world", F.col("world"))),
        F.when(body, has("timeline-generation", F.col("generation"))),
        F.when(body, has("timeline-seq", col("seq"))),
        F.when(body, has("timeline-body-sha256", F.col("body_sha256"))),
        has("event-type", F.col("event_type")),
        F.concat(F.lit("data: target: /"), F.col("target")),
        has("body-sha256", F.col("body_sha256")),
        has("size", col("size")),
        has("content-type", F.col("content_type")),
        F.concat(F.lit("id: "), F.col("cursor")),
    ]
    return feed.withColumn("frame", F.concat(F.concat_ws("\n", *lines), F.lit("\n\n")))
