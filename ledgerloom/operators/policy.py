"""Rules at the edge, as Column functions: metadata, headers that are stored, paths as given, read access, cached reads and
the HTTP status of an outcome."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import paths

#: Headers that are never stored, by name and by how they begin.
NEVER_STARTS = ["sec-", "access-control-request-", "want-", ":", "x-b3-", "x-amzn-", "cf-", "x-timeline-"]
NEVER = """
authorization proxy-authorization cookie set-cookie
host connection keep-alive proxy-authenticate proxy-connection te trailer transfer-encoding upgrade http2-settings
accept accept-charset accept-encoding accept-language expect from max-forwards origin prefer range referer referrer dnt user-agent
if-match if-none-match if-range if-modified-since if-unmodified-since
device-memory downlink dpr ect rtt save-data width viewport-width
accept-ch alt-used attribution-reporting-eligible available-dictionary dictionary-id early-data idempotency-key
service-worker service-worker-navigation-preload upgrade-insecure-requests
alt-svc server-timing retry-after x-powered-by preference-applied priority critical-ch clear-site-data
content-type content-length etag accept-ranges content-range link location allow date server www-authenticate age vary
x-request-id x-elapsed-us x-elapsed-ms x-content-type-options
forwarded via x-forwarded-for x-forwarded-host x-forwarded-proto x-real-ip true-client-ip client-ip
traceparent tracestate baggage b3 http3-settings pragma
""".split()
#: Headers that are stored unless they are denied.
DEFAULT = """
content-disposition content-encoding content-language content-md5 cache-control expires
access-control-allow-origin access-control-allow-methods access-control-allow-headers access-control-allow-credentials
access-control-expose-headers access-control-max-age
content-security-policy content-security-policy-report-only x-frame-options permissions-policy
cross-origin-resource-policy cross-origin-opener-policy cross-origin-embedder-policy referrer-policy x-robots-tag
""".split()
#: The HTTP status of what a verb reports.
HTTP = {
    "ok": 200, "created": 201, "not_modified": 304, "invalid_world": 400, "invalid_metadata": 400, "auth_read": 401, "auth_write": 401, "auth_write_approve": 401, "auth_delete": 401,
    "append_only": 403, "not_found": 404, "precondition_failed": 412, "too_large": 413, "range": 416, "shutting_down": 503, "transient": 503, "quota_exceeded": 507, "disk_full": 507,
}
#: What reserved header names begin with.
RESERVED = "subject-"


def metadata_status(content_type: Column, headers: Column, deletes: Column | None = None) -> Column:
    """invalid_metadata where a zero byte, CR or LF is in it, or a delete brings a reserved header; else ok."""
    bad = lambda c: F.coalesce(c.rlike(r"[\x00\r\n]"), F.lit(False))
    wrong = bad(content_type) | F.exists(headers, lambda h: bad(h["name"]) | bad(h["value"]))
    if deletes is not None:
        wrong = wrong | (deletes & F.exists(headers, lambda h: F.lower(h["name"]).startswith(RESERVED)))
    return F.when(wrong, "invalid_metadata").otherwise("ok")


def _listed(name: Column, raw: str) -> Column:
    """Whether a comma-separated list has the name; entries that end in * are prefixes."""
    entries = [e.strip().lower() for e in raw.split(",")]
    out = name.isin([e for e in entries if e and not e.endswith("*")])
    for e in entries:
        if e.endswith("*") and len(e) > 1:
            out = out | name.startswith(e[:-1])
    return out


def stored_headers(headers: Column, allow: str = "", deny: str = "") -> Column:
    """What is stored of a request's headers, by name: the hard denials go first, then deny, the defaults, then allow. Of
    headers with one name the last stays."""
    lower = F.transform(headers, lambda h: F.struct(F.translate(h["name"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("name"), h["value"].alias("value")))

    def keeps(name: Column) -> Column:
        never = name.isin(NEVER)
        for start in NEVER_STARTS:
            never = never | name.startswith(start)
        return ~never & ~_listed(name, deny) & (name.isin(DEFAULT) | _listed(name, allow))

    kept = F.filter(lower, lambda h: keeps(h["name"]))
    last = F.filter(kept, lambda h, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda later: later["name"] == h["name"]))
    return F.array_sort(last)


def canonical_path(path: Column) -> Column:
    """/foo is short for home/foo; paths in a namespace stay."""
    bare = F.regexp_replace(path, "^/+", "")
    known = F.split_part(bare, F.lit("/"), F.lit(1)).isin([*paths.NAMESPACES, "proc"])
    return F.when(known, bare).otherwise(F.concat(F.lit("home/"), bare))


def read_status(tier: Column, has_read_token: Column) -> Column:
    """Reads are public where no read token is set."""
    return F.when(~has_read_token | tier.isin("read", "write", "approve"), "ok").otherwise("auth_read")


def not_modified(if_none_match: Column, etag: Column) -> Column:
    """Whether a conditional read is answered with 304: an entry of the list matches, weakly."""
    quoted = r'^(?:[Ww]/)?\s*"([^"]*)"$'
    entry = lambda p: (F.trim(p) == "*") | (F.trim(p).rlike(quoted) & (F.regexp_extract(F.trim(p), quoted, 1) == etag))
    return F.coalesce(F.exists(F.split(if_none_match, ","), entry), F.lit(False))


def http_status(status: Column) -> Column:
    return F.coalesce(*[F.when(status == k, F.lit(v)) for k, v in HTTP.items()], F.lit(500)).cast("long")
