"""Framing, SHA-256 and HMAC as Column functions: all of it stays inside the JVM.

The pads of the HMAC key are literals of the plan, so explain() and event logs show them: fixture keys only. For real
keys, chain.build takes the key as an argument of its Python fold, outside the plan.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the key of the fixtures.
FIXTURE_KEY = b"0123456789abcdef0123456789abcdef0123456789abcdef0123456789abcdef"
#: Labels of the frames of an event, in order.
EVENT_FIELDS = ["prev", "world", "timestamp", "type", "target", "gen", "body-sha256", "size", "content-type", "meta-sha256"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def pads(key: bytes) -> tuple[bytes, bytes]:
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def frame(label: str, value: Column) -> Column:
    """label, the value's length in bytes and the value, each ended by a zero byte."""
    raw = F.encode(value, "UTF-8")
    zero = F.unhex(F.lit("00"))
    return F.concat(F.encode(F.lit(label), "UTF-8"), zero, F.encode(F.octet_length(raw).cast("string"), "UTF-8"), zero, raw, zero)


def header_frames(headers: Column) -> Column:
    each = F.transform(headers, lambda h: F.concat(frame("header-name", h["name"]), frame("header-value", h["value"])))
    return F.aggregate(each, F.unhex(F.lit("")), lambda a, x: F.concat(a, x))


def canonical_headers(headers: Column) -> Column:
    """Names lower-cased (A-Z only), then sorted by name and value; duplicates stay."""
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_sort(F.transform(headers, lambda h: F.struct(lower(h["name"]).alias("name"), h["value"].alias("value"))))


def meta_sha256(content_type: Column, headers: Column) -> Column:
    return F.sha2(F.concat(frame("content-type", content_type), header_frames(headers)), 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    inner, outer = pads(key)
    hexed = lambda x: F.unhex(F.lit(x.hex()))
    return F.sha2(F.concat(hexed(outer), F.unhex(F.sha2(F.concat(hexed(inner), message), 256))), 256)


def event_hmac(key: bytes, *values: Column) -> Column:
    """values: of EVENT_FIELDS, in order."""
    return hmac_sha256(key, F.concat(*[frame(n, v.cast("string")) for n, v in zip(EVENT_FIELDS, values, strict=True)]))


def frame_bytes(label: str, value: str) -> bytes:
    raw = value.encode()
    return b"%b\0%d\0%b\0" % (label.encode(), len(raw), raw)


def meta_sha256_of(content_type: str, headers: list[tuple[str, str]]) -> str:
    parts = [frame_bytes("content-type", content_type)]
    parts += [frame_bytes("header-name", n) + frame_bytes("header-value", v) for n, v in headers]
    return hashlib.sha256(b"".join(parts)).hexdigest()


def event_hmac_of(key: bytes, *values: str) -> str:
    return hmac.digest(key, b"".join(map(frame_bytes, EVENT_FIELDS, values)), "sha256").hex()


def text_frame(label: str, value: str) -> str:
    """frame_bytes as text."""
    return f"{label}\0{len(value) if value.isascii() else len(value.encode())}\0{value}\0"


def sealer(key: bytes) -> Callable[[str], str]:
    """The HMAC of frames given as text. The key's two blocks are hashed once, not once a message."""
    inner, outer = (hashlib.sha256(p) for p in pads(key))

    def seal(message: str) -> str:
        one, two = inner.copy(), outer.copy()
        one.update(message.encode())
        two.update(one.digest())
        return two.hexdigest()

    return seal


def event_sealer(key: bytes) -> Callable[..., str]:
    """event_hmac_of for one key and many events, without the key's part of the work."""
    seal = sealer(key)

    def mac(prev, world, timestamp, kind, target, gen, sha, size, content_type, meta) -> str:  # of EVENT_FIELDS, in order
        message = (
            f"prev\0{len(prev)}\0{prev}\0world\0{len(world)}\0{world}\0timestamp\0{len(timestamp)}\0{timestamp}\0type\0{len(kind)}\0{kind}\0"
            f"target\0{len(target)}\0{target}\0gen\0{len(gen)}\0{gen}\0body-sha256\0{len(sha)}\0{sha}\0size\0{len(size)}\0{size}\0"
            f"content-type\0{len(content_type)}\0{content_type}\0meta-sha256\0{len(meta)}\0{meta}\0"
        )
        if message.isascii():  # so that lengths are lengths in bytes
            return seal(message)
        return seal("".join(map(text_frame, EVENT_FIELDS, (prev, world, timestamp, kind, target, gen, sha, size, content_type, meta))))

    return mac
