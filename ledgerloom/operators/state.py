"""From ops to state, set-based: incarnations, acceptance, current bodies and stages.

Everything is windows over (world) and (world, generation), so one exchange by world serves all of it. A world is the
unit of order; its ops meet in one task, as the chain demands anyway.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import paths


def generation(world: Column, g: Column) -> Column:
    """128 bits from world and incarnation number: repeatable, where a live store draws them at random."""
    return F.substring(F.sha2(F.concat(world, F.lit(":"), g.cast("string")), 256), 1, 32)


def generation_of(world: str, g: int) -> str:
    return hashlib.sha256(f"{world}:{g}".encode()).hexdigest()[:32]


def _order(upto: int) -> WindowSpec:
    """A world's ops from its first on, up to the current one or, for -1, to the one before."""
    return Window.partitionBy("world").orderBy("op_id").rowsBetween(Window.unboundedPreceding, upto)


def numbered(ops: DataFrame) -> DataFrame:
    """ops with g (accepted deletes before), blk (replaces so far in this incarnation) and accepted.

    An append or delete of a world that is not there is refused (not_found).
    """
    before, so_far = _order(-1), _order(0)
    deletes, replaces = F.col("verb") == "delete", F.col("verb") == "replace"
    # between two deletes, accepted or not, a world is there from the first replace on: replaces are counted over the whole
    # world, less those up to the delete before, so that one sort serves every window
    out = ops.withColumn("puts", F.sum(replaces.cast("long")).over(so_far))
    out = out.withColumn("blk", F.col("puts") - F.coalesce(F.max(F.when(deletes, F.col("puts"))).over(before), F.lit(0)))
    out = out.withColumn("accepted", replaces | (F.col("blk") > 0))
    return out.withColumn("g", F.coalesce(F.sum((deletes & F.col("accepted")).cast("long")).over(before), F.lit(0))).drop("puts")


def create_on_append(ops: DataFrame) -> DataFrame:
    """ops in which an append to a world that is not there is led by a replace with an empty body.

    Every op gets twice its op_id plus one; the added replace has the even number before.
    """
    before = Window.partitionBy("world").orderBy("op_id").rowsBetween(Window.unboundedPreceding, -1)
    # every append creates, so a world is there unless it is new or the op before was a delete
    last = F.last("verb").over(before)
    makes = (F.col("verb") == "append") & (last.isNull() | (last == "delete"))
    rows = ops.withColumn("makes", makes)
    added = F.struct((F.col("op_id") * 2).alias("op_id"), F.lit("replace").alias("verb"), F.lit("").alias("body"))
    own = F.struct((F.col("op_id") * 2 + 1).alias("op_id"), F.col("verb").alias("verb"), F.col("body").alias("body"))
    rows = rows.withColumn("each", F.explode(F.when(F.col("makes"), F.array(added, own)).otherwise(F.array(own))))
    return rows.select(*[F.col(f"each.{c}").alias(c) if c in ("op_id", "verb", "body") else F.col(c) for c in ops.columns])


def outcomes(ops: DataFrame) -> DataFrame:
    """op_id, world, verb, status."""
    return numbered(ops).select("op_id", "world", "verb", F.when(F.col("accepted"), "ok").otherwise("not_found").alias("status"))


def body_events(ops: DataFrame) -> DataFrame:
    """Accepted replaces and appends with generation, seq (2 is the first: 1 is the format row), and the headers and
    content type that the incarnation has after each."""
    # counted over the world, less what lives before had; the replace that began a block is the last one so far
    n = numbered(ops).where("accepted")
    n = n.withColumn("rows", F.sum((F.col("verb") != "delete").cast("long")).over(_order(0)))
    n = n.withColumn("passed", F.coalesce(F.max(F.when(F.col("verb") == "delete", F.col("rows"))).over(_order(-1)), F.lit(0)))
    n = n.withColumn("began", F.last(F.when(F.col("verb") == "replace", F.struct("content_type", "headers")), True).over(_order(0)))
    return n.where("verb <> 'delete'").select(
        "op_id",
        "timestamp",
        "world",
        "g",
        "blk",
        generation(F.col("world"), F.col("g")).alias("generation"),
        (F.col("rows") - F.col("passed") + 1).alias("seq"),
        F.when(F.col("verb") == "replace", "put").otherwise("append").alias("event_type"),
        "body",
        F.col("began.content_type").alias("content_type"),
        F.col("began.headers").alias("headers"),
    )


def with_full_body(events: DataFrame) -> DataFrame:
    """events with `full`: the whole body after each, which an append extends. Quadratic in the appends of one block by
    nature; chain.build hashes the growing body without making it."""
    block = Window.partitionBy("world", "g", "blk").orderBy("op_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("full", F.array_join(F.collect_list("body").over(block), ""))


def last_life(ops: DataFrame) -> DataFrame:
    """(world, live_g): the incarnation that is alive; worlds whose last life ended have none."""
    n = numbered(ops).where("accepted")
    last = n.groupBy("world").agg(F.max_by(F.struct("g", "verb"), "op_id").alias("last"))
    return last.where("last.verb <> 'delete'").select("world", F.col("last.g").alias("live_g"))


def stage(ops: DataFrame) -> DataFrame:
    """world, generation, body, content_type, headers: one row per live world.

    Only the last block is put together: its chunks are collected once, not once an event.
    """
    n = numbered(ops).where("accepted")
    w = Window.partitionBy("world")
    last = n.withColumn("end", F.max(F.struct("op_id", "verb", "g", "blk")).over(w)).where("end.verb <> 'delete'")
    last = last.where("g = end.g and blk = end.blk and verb <> 'delete'")
    got = last.groupBy("world", "g").agg(
        F.array_sort(F.collect_list(F.struct("op_id", "body"))).alias("chunks"),
        F.min_by("content_type", "op_id").alias("content_type"),
        F.min_by("headers", "op_id").alias("headers"),
    )
    return got.select(
        "world",
        generation(F.col("world"), F.col("g")).alias("generation"),
        F.array_join(F.transform("chunks", lambda x: x["body"]), "").alias("body"),
        "content_type",
        "headers",
    )


def byte_range(stages: DataFrame, spec: Column, etag_matches: Column | None = None) -> DataFrame:
    """status (200 whole, 206 part, 416 unsatisfiable), first, last and part of each body for a Range header."""
    raw, n = F.encode("body", "UTF-8"), F.octet_length("body")
    ranged = F.regexp_extract(F.trim(spec), r"^bytes=(\d*)-(\d*)$", 1), F.regexp_extract(F.trim(spec), r"^bytes=(\d*)-(\d*)$", 2)
    left, right = (F.when(x != "", x.try_cast("long")) for x in ranged)
    many = F.trim(spec).rlike(r"^bytes=.*,")
    first = F.when(left.isNotNull(), left).otherwise(F.greatest(n - right, F.lit(0)))
    last = F.when(left.isNull() | right.isNull(), n - 1).otherwise(F.least(right, n - 1))
    wrong = ~F.trim(spec).rlike(r"^bytes=\d*-\d*$") | (left.isNull() & right.isNull()) | (n == 0) | (left.isNull() & (right == 0)) | (left >= n) | (left.isNotNull() & (right < left))
    whole = spec.isNull() | many | (~etag_matches if etag_matches is not None else F.lit(False))
    status = F.when(whole, 200).when(F.coalesce(wrong, F.lit(False)), 416).otherwise(206)
    out = stages.withColumns({"status": status, "first": F.when(status == 206, first), "last": F.when(status == 206, last)})
    return out.withColumn("part", F.when(F.col("status") == 200, raw).when(F.col("status") == 206, F.substring(raw, F.col("first").cast("int") + 1, (F.col("last") - F.col("first") + 1).cast("int"))))


def memory_etag(body: Column) -> Column:
    return F.concat(F.lit("sha256-"), F.sha2(body, 256))


def listing(*frames: DataFrame) -> DataFrame:
    """Sorted distinct worlds of any number of sources."""
    out = frames[0].select("world")
    for f in frames[1:]:
        out = out.union(f.select("world"))
    return out.distinct().orderBy("world")


def bounded(worlds: DataFrame, most: int) -> DataFrame:
    """All of them, or nothing if there are more than `most`: one more than that is counted, no further."""
    some = worlds.limit(most + 1)
    n = some.agg(F.count("*").alias("n"))
    return some.crossJoin(F.broadcast(n)).where(F.col("n") <= most).select("world")


def classified(worlds: DataFrame) -> DataFrame:
    w = F.col("world")
    return worlds.select("world", F.split_part(w, F.lit("/"), F.lit(1)).alias("namespace"), paths.storage_class(w).alias("storage"), paths.needs_approve(w).alias("needs_approve"))
