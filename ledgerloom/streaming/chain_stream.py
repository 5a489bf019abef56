"""The chain as a stream: ops arrive in micro-batches, and each world's chain goes on from where its state stands.

State per world: generation number, seq, last op, HMAC of the last row, body so far. Within a batch ops are taken in the
order of op_id; an op that is not after the last one of its world is an error, as a chain cannot take it in any more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import crypto
from ..operators.chain import _COLUMNS, EVENTS, FORMAT_HEADER, FORMAT_VERSION
from ..session import ship

STATE = "g long, seq long, last_op long, prev string, body string, content_type string, names array<string>, values array<string>"


def events(ops: DataFrame, key: bytes = crypto.FIXTURE_KEY) -> DataFrame:
    """A streaming DataFrame of ops to one of chain events, as chain.build gives them."""
    ship(ops.sparkSession)
    rows = ops.withColumn("headers", crypto.canonical_headers(F.col("headers")))
    rows = rows.withColumn("meta", crypto.meta_sha256(F.col("content_type"), F.col("headers")))
    format_headers, format_meta = [{"name": FORMAT_HEADER, "value": FORMAT_VERSION}], crypto.meta_sha256_of("", [(FORMAT_HEADER, FORMAT_VERSION)])
    taken = ["op_id", "timestamp", "verb", "body", "content_type", "headers", "meta"]

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (world,) = group
        g, seq, last, prev, body, content_type, names, values = state.get if state.exists else (0, 0, -1, "", "", "", [], [])
        headers = [{"name": n, "value": v} for n, v in zip(names, values, strict=True)]
        meta = crypto.meta_sha256_of(content_type, list(zip(names, values, strict=True))) if seq else ""
        raw, more, out = body.encode(), [body], []
        sha, size = hashlib.sha256(raw), len(raw)
        name = hashlib.sha256(f"{world}:{g}".encode()).hexdigest()[:32]
        got = [row for batch in batches for row in zip(*(batch[c].tolist() for c in taken), strict=True)]
        for op_id, ts, verb, text, own_type, own_headers, own_meta in sorted(got, key=itemgetter(0)):
            if op_id <= last:
                raise ValueError(f"op {op_id} of {world} comes after {last}")
            last = op_id
            if verb == "delete":
                if seq:  # a delete of a world that is not there is refused
                    g, seq, more = g + 1, 0, []
                    name = hashlib.sha256(f"{world}:{g}".encode()).hexdigest()[:32]
                continue
            if verb == "append" and not seq:
                continue
            if verb == "replace":
                more, sha, size, content_type, headers, meta = [], hashlib.sha256(), 0, own_type, list(own_headers), own_meta
            if not seq:
                prev = crypto.event_hmac_of(key, "", world, ts, "format", world, name, crypto.EMPTY_SHA, "0", "", format_meta)
                out.append((world, name, 1, ts, "format", world, crypto.EMPTY_SHA, 0, "", format_meta, prev, "", format_headers, op_id))
            raw = text.encode()
            more.append(text)
            sha.update(raw)
            size += len(raw)
            seq = seq + 1 if seq else 2
            kind, digest = "put" if verb == "replace" else "append", sha.hexdigest()
            mac = crypto.event_hmac_of(key, prev, world, ts, kind, world, name, digest, str(size), content_type, meta)
            out.append((world, name, seq, ts, kind, world, digest, size, content_type, meta, mac, prev, headers, op_id))
            prev = mac
        state.update((g, seq, last, prev if seq else "", "".join(more), content_type, [h["name"] for h in headers], [h["value"] for h in headers]))
        yield pd.DataFrame(out, columns=_COLUMNS)

    return rows.groupBy("world").applyInPandasWithState(fold, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_end(ops: DataFrame, path: str, checkpoint: str, key: bytes = crypto.FIXTURE_KEY) -> None:
    """Takes all there is and writes the events as Parquet; a batch that is written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = events(ops, key).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
