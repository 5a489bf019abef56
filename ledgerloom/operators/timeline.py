"""Time travel by coordinate (world, generation, seq, body_sha256): a lookup of many untrusted coordinates at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The HTTP status of each outcome.
STATUS = {"body": 200, "generation_mismatch": 409, "body_hash_mismatch": 409, "missing_row": 404, "expired": 410, "non_body_event": 404, "unproven_coordinate": 404, "corrupt": 500}


def dereference(coords: DataFrame, live: DataFrame, events: DataFrame, cas: DataFrame, floors: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """coords with outcome, status and size (of the body found).

    live: (world, generation) of the worlds that exist; cas: (world, generation, body_sha256, body_size); floors: (world,
    generation, floor); broken: (world, generation) of the chains that do not verify. Coordinates are dealt out by world,
    so each table is looked up where it lies.
    """
    c = coords.select("world", "generation", "seq", "body_sha256", *[x for x in coords.columns if x not in ("world", "generation", "seq", "body_sha256")])
    now = live.select("world", F.col("generation").alias("now"))
    row = events.select("world", F.col("generation").alias("now"), "seq", "event_type", "target", F.col("body_sha256").alias("row_sha"), F.col("size").alias("row_size"))
    body = cas.select("world", F.col("generation").alias("now"), F.col("body_sha256").alias("row_sha"), "body_size")
    floor = floors.select("world", F.col("generation").alias("now"), "floor")
    out = c.join(now, "world", "left").join(row, ["world", "now", "seq"], "left").join(body, ["world", "now", "row_sha"], "left").join(floor, ["world", "now"], "left")
    bad = F.lit(False)
    if broken is not None:
        out = out.join(broken.select("world", F.col("generation").alias("now"), F.lit(True).alias("is_broken")), ["world", "now"], "left")
        bad = F.coalesce("is_broken", F.lit(False))
    kind = F.col("event_type")
    known = ["put", "append", "format", "delete_intent", "delete_commit", "delete_commit_failed"]
    outcome = (
        F.when(F.col("now").isNull(), "unproven_coordinate")
        .when(bad, "corrupt")
        .when(F.col("generation") != F.col("now"), "generation_mismatch")
        .when(kind.isNull(), "missing_row")
        .when(~kind.isin(known), "corrupt")
        .when(~kind.isin("put", "append"), "non_body_event")
        .when((F.col("target") != F.col("world")) | ~F.col("row_sha").rlike("^[0-9a-f]{64}$"), "corrupt")
        .when(F.col("row_sha") != F.col("body_sha256"), "body_hash_mismatch")
        .when(F.col("body_size").isNotNull() & (F.col("body_size") != F.col("row_size")), "corrupt")
        .when(F.col("body_size").isNotNull(), "body")
        .when(F.col("seq") < F.col("floor"), "expired")
        .otherwise("corrupt")
    )
    out = out.withColumn("outcome", outcome)
    status = F.coalesce(*[F.when(F.col("outcome") == k, F.lit(v)) for k, v in STATUS.items()])
    return out.select(*coords.columns, "outcome", status.alias("status"), F.when(F.col("outcome") == "body", F.col("body_size")).alias("size"))


def latest_body(events: DataFrame) -> DataFrame:
    """world, generation, seq, body_sha256, hmac of the last body event of each chain."""
    rows = events.where("event_type in ('put', 'append')")
    out = rows.groupBy("world", "generation").agg(F.max_by(F.struct("seq", "body_sha256", "hmac"), "seq").alias("x"))
    return out.select("world", "generation", F.col("x.seq").alias("seq"), F.col("x.body_sha256").alias("body_sha256"), F.concat(F.lit("hmac-"), F.col("x.hmac")).alias("hmac"))
