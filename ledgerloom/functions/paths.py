"""World paths (keys) as Column functions: validity, namespaces, disk names and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Namespaces, those kept in memory, and those whose writes need the approve tier.
NAMESPACES = ["home", "tmp", "dev", "sys", "etc", "lib", "boot", "usr", "var"]
MEMORY = ["tmp", "dev", "sys"]
APPROVE = ["lib", "etc", "boot", "usr", "var/log"]
RESERVED = [*NAMESPACES, "proc", "var/log"]
LEDGER = "var/log/deletes"
MOST_DISK_BYTES = 200
#: Bytes that a disk name keeps as they are, among ASCII, and those that a cursor keeps.
DISK_PLAIN = r"[^\x00-\x1F\x7F%./\\:*?\"<>| ]"
CURSOR_PLAIN = r"[A-Za-z0-9/_.~-]"


def disk_length(world: Column) -> Column:
    """Bytes of the percent-encoded directory name: three for each byte that has to be escaped."""
    plain = F.length(F.regexp_replace(world, r"[^\x21-\x7E]|[%./\\:*?\"<>|]", ""))
    return 3 * F.octet_length(world) - 2 * plain


def percent_encode(text: Column, plain: str) -> Column:
    """Bytes outside a class of ASCII characters as %XX, upper case."""
    piece = lambda c: F.when(c.rlike(f"^{plain}$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), piece), "")


def disk_name(world: Column) -> Column:
    return percent_encode(world, r"[\x21-\x7E&&[^%./\\:*?\"<>|]]")


def invalid_reason(world: Column) -> Column:
    """Why a string is no world path, in the order in which it is reported; null if it is one."""
    segments = r"(^|/)(\.|%2[eE]){1,2}(/|$)"
    namespace = F.substring_index(world, "/", 1)
    return (
        F.when(world == "", "world path is empty")
        # no name is longer than three times its key, so short keys need no count
        .when((3 * F.octet_length(world) > MOST_DISK_BYTES) & (disk_length(world) > MOST_DISK_BYTES), "world path is too long")
        .when(world.isin(RESERVED) | world.startswith("proc/"), "world path is a reserved namespace root")
        .when(world.contains("\\"), "world path contains backslash")
        .when(world.rlike(r"[\x00-\x1F\x7F-\x9F]"), "world path contains control bytes")
        .when(world.startswith("/") | world.contains("//") | world.endswith("/"), "world path has empty segment")
        .when((world.contains(".") | world.contains("%2")) & world.rlike(segments), "world path contains dot or encoded-dot segment")
        .when(~(namespace.isin(NAMESPACES) & world.contains("/")), "world path is outside the namespaces")
    )


def storage_class(world: Column) -> Column:
    return F.when(F.substring_index(world, "/", 1).isin(MEMORY), "memory").otherwise("durable")


def needs_approve(world: Column) -> Column:
    tests = [(world == p) | world.startswith(f"{p}/") for p in APPROVE]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def write_status(world: Column, tier: Column) -> Column:
    """ok, or the refusal: authorisation is reported before the ledger's append-only rule."""
    gated = needs_approve(world)
    allowed = (tier == "approve") | ((tier == "write") & ~gated)
    return F.when(~allowed & gated, "auth_write_approve").when(~allowed, "auth_write").when(world == LEDGER, "append_only").otherwise("ok")


def delete_status(world: Column, tier: Column) -> Column:
    return F.when(tier != "approve", "auth_delete").when(world == LEDGER, "append_only").otherwise("ok")


def cursor(world: Column, generation: Column, seq: Column) -> Column:
    """The resumable position <percent-encoded world>@<generation>=<seq>."""
    # url_encode keeps letters, digits and "*-._", makes a space "+" and encodes the rest as CURSOR_PLAIN asks
    encoded = F.url_encode(world)
    for given, kept in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(given), F.lit(kept))
    return F.concat(encoded, F.lit("@"), generation, F.lit("="), seq.cast("string"))


def _split_last(text: Column, mark: str) -> tuple[Column, Column]:
    """What is before the last mark and what is behind it; without a mark the first is empty."""
    rest = F.substring_index(text, mark, -1)
    return F.substring(text, F.lit(1), F.length(text) - F.length(rest) - 1), rest


def _decoded(raw: Column) -> Column:
    return F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def cursor_parts(text: Column) -> tuple[Column, Column, Column]:
    """World (decoded), generation and seq text of a cursor, each null where there is none."""
    head, seq = _split_last(text, "=")
    raw, generation = _split_last(head, "@")
    whole = text.contains("=") & head.contains("@")
    return _decoded(F.when(whole, raw)), F.when(whole, generation), F.when(whole, seq)


def _number(seq: Column) -> Column:
    return F.when(seq.rlike(r"^-?[0-9]+$"), seq.try_cast("long"))


def _cursor_rules(text: Column, head: Column, world: Column, generation: Column, seq: Column, number: Column) -> Column:
    return (
        F.when(~text.contains("="), "missing-seq-delimiter")
        .when(~head.contains("@"), "missing-generation-delimiter")
        .when(world.isNull(), "invalid-world-utf8")
        .when(invalid_reason(world).isNotNull(), "invalid-world")
        .when(storage_class(world) == "memory", "memory-world")
        .when(F.octet_length(generation) != 32, "generation-wrong-length")
        .when(~generation.rlike("^[0-9a-f]{32}$"), "generation-not-lower-hex")
        .when(~seq.rlike(r"^-?[0-9]+$"), "seq-not-integer")
        .when(number.isNull(), "seq-out-of-range")
        .when(number <= 0, "seq-non-positive")
        .when(text != cursor(world, generation, number), "non-canonical")
        .otherwise("ok")
    )


def cursor_status(text: Column) -> Column:
    """ok, or what is wrong with a cursor. For whole tables with_cursor_status is faster: an expression repeats its parts."""
    world, generation, seq = cursor_parts(text)
    return _cursor_rules(text, _split_last(text, "=")[0], world, generation, seq, _number(seq))


def with_cursor_status(rows: DataFrame, text: str, name: str = "status") -> DataFrame:
    """rows with cursor_status of a column. The parts are columns of their own, each made once a row from the one before."""
    col = lambda n: F.col(f"_cursor_{n}")
    head, seq = _split_last(F.col(text), "=")
    out = rows.withColumns({"_cursor_head": head, "_cursor_seq": seq})
    raw, generation = _split_last(col("head"), "@")
    out = out.withColumns({"_cursor_raw": raw, "_cursor_generation": generation, "_cursor_number": _number(col("seq"))})
    out = out.withColumn("_cursor_world", _decoded(col("raw")))
    out = out.withColumn(name, _cursor_rules(F.col(text), *map(col, ("head", "world", "generation", "seq", "number"))))
    return out.drop(*(f"_cursor_{n}" for n in ("head", "seq", "raw", "generation", "number", "world")))
