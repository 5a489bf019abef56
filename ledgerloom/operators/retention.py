"""Content-addressed bodies and their retention.

The floor of a chain is the seq of its n-th newest body event. As it only rises, pruning step by step ends where the
closed form does: a body stays if any event at or above the floor refers to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP = 1024


def _bodies(events: DataFrame) -> DataFrame:
    return events.where("event_type in ('put', 'append')")


def floors(events: DataFrame, keep: int = KEEP) -> DataFrame:
    """world, generation, floor."""
    newest = Window.partitionBy("world", "generation").orderBy(F.col("seq").desc())
    ranked = _bodies(events).select("world", "generation", "seq", F.row_number().over(newest).alias("n"))
    return ranked.where(F.col("n") <= keep).groupBy("world", "generation").agg(F.min("seq").alias("floor"))


def stored(events: DataFrame) -> DataFrame:
    """Every body ever written, once a chain: world, generation, body_sha256, body_size, last (seq that refers to it)."""
    return _bodies(events).groupBy("world", "generation", "body_sha256").agg(F.max("size").alias("body_size"), F.max("seq").alias("last"))


def kept(events: DataFrame, keep: int = KEEP) -> DataFrame:
    """What retention leaves of stored()."""
    return stored(events).join(floors(events, keep), ["world", "generation"]).where("last >= floor").drop("floor")


def pruned(events: DataFrame, keep: int = KEEP) -> DataFrame:
    return stored(events).join(floors(events, keep), ["world", "generation"]).where("last < floor").drop("floor")


def expired(events: DataFrame, keep: int = KEEP) -> DataFrame:
    """Body events whose body is gone: below the floor, and not shared with an event above it."""
    gone = pruned(events, keep).select("world", "generation", "body_sha256")
    return _bodies(events).join(gone, ["world", "generation", "body_sha256"], "left_semi")


def unreferenced(cas: DataFrame, events: DataFrame) -> DataFrame:
    """Bodies that no event refers to, a break of the store."""
    return cas.join(_bodies(events).select("world", "generation", "body_sha256"), ["world", "generation", "body_sha256"], "left_anti")


def new_bodies(batch: DataFrame, cas: DataFrame) -> DataFrame:
    """What of a batch has to be added to the store: each body once, and none that is there."""
    keys = ["world", "generation", "body_sha256"]
    return batch.dropDuplicates(keys).join(cas.select(*keys), keys, "left_anti")
