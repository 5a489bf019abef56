import hashlib
import hmac

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import crypto, paths
from ledgerloom.operators import conditional, feed
from ledgerloom.plans import catalog

#: A key in each namespace, and names that only look like what is refused.
GOOD = [f"{n}/x{k}" for k, n in enumerate(paths.NAMESPACES)] + ["var/log/x", "usr/.hidden", "lib/x..y", "etc/%2Ex", "home/" + "y" * (paths.MOST_DISK_BYTES - 7)]
#: For each reason, keys that are refused for it.
REFUSED = {
    "world path is empty": [""],
    "world path is too long": ["home/" + "y" * paths.MOST_DISK_BYTES, "home/" + "é" * 40, "usr" + "/q" * 60],
    "world path is a reserved namespace root": [*paths.RESERVED, "proc/uptime"],
    "world path contains backslash": ["usr\\x", "tmp/x\\"],
    "world path contains control bytes": ["tmp/x\ty", "etc/\x7f", "dev/\x9f"],
    "world path has empty segment": ["//", "usr/x/", "usr//x"],
    "world path contains dot or encoded-dot segment": ["sys/./x", "boot/x/..", "dev/%2e%2E", "./home"],
    "world path is outside the namespaces": ["root/x", "Home/x", "homes"],
}
#: Published vectors of the ten-field frame under the key b"key".
VECTOR_A = "f9fcb41b1447d4338dd73b83ea6c2088fb9112258bfd562898a1218b053fbae9"
VECTOR_B = "13f7ddeb942620b992b40957496b89147617c0db1342c52a500895c10463cdbb"


def test_world_paths(spark):
    want = dict.fromkeys(GOOD) | {w: reason for reason, worlds in REFUSED.items() for w in worlds}
    rows = spark.createDataFrame([(w,) for w in want], "world string").select("world", paths.invalid_reason(F.col("world")).alias("r")).collect()
    assert {r.world: r.r for r in rows} == want


@pytest.mark.parametrize(("kind", "target", "want"), [("replace/home/", "x", VECTOR_A), ("replace", "/home/x", VECTOR_B)])
def test_event_hmac_vectors(spark, kind, target, want):
    meta = crypto.meta_sha256_of("text/plain", [])
    values = ["", "home/a", "2026-01-02T03:04:05.678Z", kind, target, "0123456789abcdef0123456789abcdef", "abc", "3", "text/plain", meta]
    assert crypto.event_hmac_of(b"key", *values) == want
    row = spark.range(1).select(crypto.event_hmac(b"key", *map(F.lit, values)).alias("h")).first()
    assert row.h == want


def test_hmac_rfc_4231(spark):
    got = spark.range(1).select(crypto.hmac_sha256(b"\x0b" * 20, F.encode(F.lit("Hi There"), "UTF-8")).alias("h")).first().h
    assert got == "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"
    long = b"k" * 131
    got = spark.range(1).select(crypto.hmac_sha256(long, F.encode(F.lit("x"), "UTF-8")).alias("h")).first().h
    assert got == hmac.new(long, b"x", hashlib.sha256).hexdigest()


def test_meta_sha256_counts_bytes_and_keeps_duplicates(spark):
    headers = [("X-B", "é"), ("x-a", "2"), ("X-A", "1"), ("x-a", "1")]
    df = spark.createDataFrame([(headers,)], "headers array<struct<name:string,value:string>>")
    got = df.select(crypto.meta_sha256(F.lit("text/plain"), crypto.canonical_headers(F.col("headers"))).alias("m")).first().m
    assert got == crypto.meta_sha256_of("text/plain", [("x-a", "1"), ("x-a", "1"), ("x-a", "2"), ("x-b", "é")])


@given(st.text(max_size=30))
def test_matchers_never_fail(raw):
    assert all(k in ("any", "strong", "weak", "invalid") for k, _ in conditional.parse_matchers(raw))


def test_preconditions():
    assert conditional.holds('"a"', None, "a") and not conditional.holds('"b"', None, "a") and not conditional.holds("*", None, None)
    assert not conditional.holds('W/"a"', None, "a")  # If-Match compares strongly
    assert not conditional.holds(None, 'W/"a"', "a") and conditional.holds(None, "*", None) and not conditional.holds(None, '"x", *', "a")


@pytest.mark.parametrize(("raw", "want"), [("", "*"), ("/", "*"), ("/*", "*"), ("home/a", "/home/a"), ("/home/a*", "/home/a*")])
def test_patterns(raw, want):
    assert feed.normalise(raw) == want


def test_cursor_parts_are_made_once(spark):
    """The staged form says what the expression says, and its plan stays small: repeated parts made it run for minutes."""
    hexes = "a" * 32
    texts = ["", "=", "@", "@=", "a@b=c@d", "a=b@c=1", "home/a@x@" + hexes + "=1", f"home/a@{hexes}=1\n", f"home/a/@{hexes}=1", f"home/./a@{hexes}=1", f"home/%2e%2e@{hexes}=1", f"home/a+b@{hexes}=1", f"home/%zz@{hexes}=1"]
    texts += [f"home/{'y' * n}@{hexes}=1" for n in (61, 62, 195, 196)] + [f"home/%2A~*@{hexes}=1", f"home/%2A~@{hexes}=1", f"home/a@{hexes}=-1", f"home/a@{hexes}=+1", f"tmp/a@{hexes}=1", None]
    rows = spark.createDataFrame([(t,) for t in texts], "c string")
    out = paths.with_cursor_status(rows.withColumn("one", paths.cursor_status(F.col("c"))), "c")
    assert out.columns == ["c", "one", "status"]
    got = {r.c: r.status for r in out.collect() if r.status == r.one}
    assert len(got) == len(texts)
    assert got[f"home/%2A~@{hexes}=1"] == "ok" and got[f"home/%2A~*@{hexes}=1"] == "non-canonical" and got[f"home/{'y' * 196}@{hexes}=1"] == "invalid-world"
    assert got["a@b=c@d"] == "invalid-world" and got[f"home/%zz@{hexes}=1"] == "invalid-world-utf8"
    plan = catalog.QUERIES["cursor_parse"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("decode(") == 1


@given(st.text(alphabet="ab@=\n%/", max_size=12))
def test_cursor_text_is_split_at_its_last_marks(text):
    import re

    m = re.match(r"(?s)\A(.*)@([^@]*)=([^=]*)\Z", text)
    head, _, seq = text.rpartition("=")
    raw, _, generation = head.rpartition("@")
    assert (m is not None) == ("=" in text and "@" in head)
    assert m is None or m.groups() == (raw, generation, seq)
