"""Usage reports and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from . import ledger, retention
from ..session import partitions, stash

#: What an entry in memory is charged besides its parts.
ENTRY_BYTES, HASH_BYTES = 128, 64
#: Bytes that entries in memory may be charged in all, by default.
MEMORY_QUOTA = 256 * 1024 * 1024


def du(stages: DataFrame, events: DataFrame, cas: DataFrame, book: DataFrame | None = None, memory: DataFrame | None = None) -> DataFrame:
    """world, total, current, retained, events of the live worlds, of the ledger (book: its row, see ledger.usage_row) and
    of the worlds in memory (their stages), which count as their bodies."""
    now = stages.select("world", "generation", F.octet_length("body").cast("long").alias("current"))
    held = cas.groupBy("world", "generation").agg(F.sum("body_size").alias("retained"))
    rows = events.groupBy("world", "generation").agg(F.count("*").alias("events"))
    out = now.join(held, ["world", "generation"], "left").join(rows, ["world", "generation"], "left")
    out = out.select("world", "current", F.coalesce("retained", F.lit(0)).alias("retained"), F.coalesce("events", F.lit(0)).alias("events"))
    out = out.select("world", (F.col("current") + F.col("retained")).alias("total"), "current", "retained", "events")
    if book is not None:
        out = out.union(book)
    if memory is not None:
        size, none = F.octet_length("body").cast("long"), F.lit(0).cast("long")
        out = out.union(memory.select("world", size, size, none, none))
    return out.orderBy("world")


def lines(usage: DataFrame) -> DataFrame:
    """usage with line: the fields of du with tabs between them."""
    return usage.withColumn("line", F.concat(F.concat_ws("\t", "world", "total", "current", "retained", "events"), F.lit("\n")))


def df(usage: DataFrame, quota: int | None, memory: DataFrame | None = None, memory_quota: int = MEMORY_QUOTA) -> DataFrame:
    """One row: worlds (without the ledger), bytes used, current and retained, events, quota and free; the same of memory.

    usage: du of the durable worlds; memory: the stages in memory, which are charged for more than their bodies.
    """
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = usage.agg(whole((F.col("world") != paths.LEDGER).cast("long")).alias("durable"), *[whole(F.col(c)).alias(n) for c, n in (("total", "used"), ("current", "current"), ("retained", "retained"), ("events", "events"))])
    if memory is not None:
        charged = memory_charge(F.col("world"), F.col("body"), F.col("content_type"), F.col("headers"))
        held = memory.agg(F.count("*").alias("entries"), whole(charged).alias("memory_used"))
        out = out.crossJoin(held)  # a row each
    else:
        out = out.withColumns({"entries": F.lit(0), "memory_used": F.lit(0).cast("long")})
    limit, most = F.lit(quota).cast("long"), F.lit(memory_quota).cast("long")
    return out.select(
        (F.col("durable") + F.col("entries")).alias("worlds"), "used", "current", "retained", "events", limit.alias("quota"), F.greatest(limit - F.col("used"), F.lit(0)).alias("free"),
        "memory_used", most.alias("memory_quota"), F.greatest(most - F.col("memory_used"), F.lit(0)).alias("memory_free"),
    )


def memory_charge(world: Column, body: Column, content_type: Column, headers: Column) -> Column:
    """Bytes that an entry in memory is charged."""
    n = F.aggregate(headers, F.lit(0), lambda a, h: a + F.octet_length(h["name"]) + F.octet_length(h["value"]))
    return (F.lit(ENTRY_BYTES + HASH_BYTES) + F.octet_length(world) + F.octet_length(body) + F.octet_length(content_type) + n).cast("long")


def growth(events: DataFrame) -> DataFrame:
    """op_id, world, grown: bytes that each body event adds: its stage against the one before, and its body where the
    chain has not stored it yet."""
    chain = Window.partitionBy("world", "generation").orderBy("seq")
    rows = events.where("event_type in ('put', 'append')")
    first = F.row_number().over(Window.partitionBy("world", "generation", "body_sha256").orderBy("seq")) == 1
    rows = rows.withColumn("before", F.coalesce(F.lag("size").over(chain), F.lit(0))).withColumn("new", first)
    return rows.select("op_id", "world", (F.col("size") - F.col("before") + F.when(F.col("new"), F.col("size")).otherwise(0)).alias("grown"))


def running(events: DataFrame) -> DataFrame:
    """op_id, world, grown, used: total use after each op, in the order of all ops, deletes aside.

    A total order over everything is a running sum in two steps: sums of sampled op ranges first, then within each range.
    """
    return summed(growth(events))


def net_growth(ops: DataFrame, events: DataFrame, keep: int = retention.KEEP) -> DataFrame:
    """op_id, world, grown: bytes that each accepted op adds or, if negative, frees: the stage against the one before, its
    body where the chain does not hold it, less the body that retention prunes then; a delete frees all of its world.

    Of the body events of a chain the n-th drops the body of the one `keep` before it, unless an event between has it too.
    """
    chain, same = Window.partitionBy("world", "generation").orderBy("seq"), Window.partitionBy("world", "generation", "body_sha256").orderBy("seq")
    rows = events.where("event_type in ('put', 'append')").withColumn("n", F.row_number().over(chain))
    far = lambda gap: gap.isNull() | (gap > keep)
    rows = rows.withColumns({"new": far(F.col("n") - F.lag("n").over(same)), "goes": far(F.lead("n").over(same) - F.col("n"))})
    freed = F.coalesce(F.lag(F.when(F.col("goes"), F.col("size")), keep).over(chain), F.lit(0))
    grown = F.col("size") - F.coalesce(F.lag("size").over(chain), F.lit(0)) + F.when(F.col("new"), F.col("size")).otherwise(0) - freed
    rows = rows.select("op_id", "world", "generation", grown.alias("grown"))
    held = rows.groupBy("world", "generation").agg(F.sum("grown").alias("held"))
    gone = ledger.accepted_deletes(ops).join(held, ["world", "generation"]).select("op_id", "world", (-F.col("held")).alias("grown"))
    return rows.select("op_id", "world", "grown").union(gone)


def decided(ops: DataFrame, events: DataFrame, quota: int, keep: int = retention.KEEP) -> DataFrame:
    """op_id, world, grown, used, status: the ops up to the first that a quota refuses (quota_exceeded), with what is in use
    after each; pruned bodies are credited, and an op that frees more than it adds is never refused.

    What follows a refusal depends on it, op by op over all worlds: drop the refused op and ask again.
    """
    out = summed(net_growth(ops, events, keep))
    over = (F.col("grown") > 0) & (F.col("used") > quota)
    first = out.where(over).agg(F.min("op_id").alias("first"))  # a row
    out = out.crossJoin(F.broadcast(first)).where("first is null or op_id <= first")
    refused = F.coalesce(F.col("op_id") == F.col("first"), F.lit(False))
    used = F.when(refused, F.col("used") - F.col("grown")).otherwise(F.col("used"))
    return out.select("op_id", "world", "grown", used.alias("used"), F.when(refused, "quota_exceeded").otherwise("ok").alias("status"))


def summed(g: DataFrame) -> DataFrame:
    """op_id, world, grown with used: the sum of grown up to each op."""
    g = stash(g.repartitionByRange(partitions(g.sparkSession), "op_id").withColumn("range", F.spark_partition_id()), "growth")
    sums = g.groupBy("range").agg(F.sum("grown").alias("s"))  # a row a range
    base = sums.select("range", (F.sum("s").over(Window.partitionBy(F.lit(0)).orderBy("range")) - F.col("s")).alias("base"))
    within = F.sum("grown").over(Window.partitionBy("range").orderBy("op_id").rowsBetween(Window.unboundedPreceding, 0))
    return g.withColumn("s", within).join(F.broadcast(base), "range").select("op_id", "world", "grown", (F.col("base") + F.col("s")).alias("used"))
