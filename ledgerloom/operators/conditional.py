"""Conditional writes: If-Match and If-None-Match decide by the current ETag, which the write itself changes, so the ops
of a world are folded in order, one sorted pass with constant state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import crypto
from ..session import ship
from .chain import FORMAT_HEADER, FORMAT_VERSION, Fold


def parse_matchers(raw: str | None) -> list[tuple[str, str]]:
    """(any | strong | weak | invalid, value) of a comma-separated list."""
    out = []
    for part in filter(None, (p.strip() for p in (raw or "").split(","))):
        weak = part[:2] in ("W/", "w/")
        quoted = (part[2:] if weak else part).strip()
        value = quoted[1:-1] if len(quoted) > 1 and quoted[0] == quoted[-1] == '"' else None
        if part == "*":
            out.append(("any", ""))
        elif value is None or '"' in value:
            out.append(("invalid", ""))
        else:
            out.append(("weak" if weak else "strong", value))
    return out


def holds(if_match: str | None, if_none_match: str | None, etag: str | None) -> bool:
    strong = parse_matchers(if_match)
    if strong and (etag is None or not any(k == "any" or (k == "strong" and v == etag) for k, v in strong)):
        return False
    return etag is None or not any(k == "any" or (k in ("strong", "weak") and v == etag) for k, v in parse_matchers(if_none_match))


SCHEMA = "op_id long, world string, status string, etag string"


#: Bytes that a world's body may have, by default.
WORLD_BYTES = 64 * 1024 * 1024


def outcomes(ops: DataFrame, key: bytes = crypto.FIXTURE_KEY, most: int = WORLD_BYTES) -> DataFrame:
    """op_id, world, status (ok, not_found, precondition_failed, too_large), etag after it; ops with if_match and
    if_none_match; most: bytes of a body.

    A replace is first refused for its size, then by its conditions. Appends and deletes fail their conditions first, then
    as not found, appends last for the size that the body would have. A refused op changes nothing.
    """
    ship(ops.sparkSession)
    cols = ["op_id", "timestamp", "world", "verb", "body", "content_type", "headers", "if_match", "if_none_match"]
    rows = ops.withColumn("headers", crypto.canonical_headers(F.col("headers"))).select(*cols).repartition("world").sortWithinPartitions("world", "op_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        world, g, seq, state, kept = None, 0, 0, Fold(key), None
        for batch in batches:
            out = []
            for op_id, ts, w, verb, body, content_type, headers, if_match, if_none_match in batch.itertuples(index=False, name=None):
                if w != world:
                    world, g, seq = w, 0, 0
                etag = f"hmac-{state.prev}" if seq else None
                size = len((body or "").encode()) + (state.size if verb == "append" and seq else 0)
                if verb == "replace" and size > most:
                    status = "too_large"
                elif not holds(if_match, if_none_match, etag):
                    status = "precondition_failed"
                elif verb != "replace" and etag is None:
                    status = "not_found"
                elif verb == "append" and size > most:
                    status = "too_large"
                else:
                    status = "ok"
                if status == "ok" and verb == "delete":
                    g, seq, etag = g + 1, 0, None
                elif status == "ok":
                    if verb == "replace":
                        kept = (content_type, [(h["name"], h["value"]) for h in headers])
                    name = hashlib.sha256(f"{world}:{g}".encode()).hexdigest()[:32]
                    seq = seq + 1 if seq else 2
                    list(state.feed(world, name, seq, ts, "put" if verb == "replace" else "append", body, *kept, op_id))
                    etag = f"hmac-{state.prev}"
                out.append((op_id, world, status, etag))
            yield pd.DataFrame(out, columns=["op_id", "world", "status", "etag"])

    return rows.mapInPandas(fold, SCHEMA)
