"""The hash chain of each (world, generation): building, verifying, heads and stamps.

Building is serial by definition within a chain, so it is one pass over rows dealt out by world and sorted: state is
carried from row to row, appends extend a running SHA-256, and no body is ever put together. Verifying is not serial: the
previous HMAC is stored, so every row is checked by itself and the first break of a chain is a min.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crypto, paths
from ..session import lists, partitions, ship
from .state import body_events, generation, generation_of, numbered

FORMAT_HEADER, FORMAT_VERSION = "format-version", "2"
#: The headers in which a delete row proves what it deleted.
SUBJECT = ["subject-world", "subject-generation", "subject-seq", "subject-body-sha256", "subject-hmac"]
EVENTS = (
    "world string, generation string, seq long, timestamp string, event_type string, target string, body_sha256 string, size long, "
    "content_type string, meta_sha256 string, hmac string, prev_hmac string, headers array<struct<name:string,value:string>>, op_id long"
)
ENDED = "op_id long, timestamp string, world string, generation string, seq long, body_sha256 string, hmac string"
ENDED_NAMES = [c.split(" ")[0] for c in ENDED.split(", ")]
#: Binary digits of the number of rows of a long chain that are checked together.
SPAN_BITS = 14
_COLUMNS = [c.strip().split(" ")[0] for c in EVENTS.split(", ")]


class Fold:
    """Rows of one chain after another."""

    def __init__(self, key: bytes):
        self.key, self.chain, self.prev, self.sha, self.size, self.at, self.done = key, None, "", hashlib.sha256(), 0, 0, set()

    def row(self, seq, timestamp, event_type, target, body_sha, size, content_type, headers, op_id, meta=None) -> tuple:
        world, generation = self.chain
        meta = meta or crypto.meta_sha256_of(content_type, headers)
        mac = crypto.event_hmac_of(self.key, self.prev, world, timestamp, event_type, target, generation, body_sha, str(size), content_type, meta)
        out = (world, generation, seq, timestamp, event_type, target, body_sha, size, content_type, meta, mac, self.prev, [{"name": n, "value": v} for n, v in headers], op_id)
        self.prev = mac
        return out

    def begins(self, world, generation) -> bool:
        """Whether a row is the first of its chain, which then is the current one."""
        if (world, generation) == self.chain:
            return False
        if (world, generation) in self.done:
            raise ValueError(f"rows of {world} do not follow each other")
        if self.chain is not None and self.chain[0] != world:
            self.done.clear()
        self.done.add((world, generation))
        self.chain, self.prev, self.at = (world, generation), "", 0
        return True

    def body(self, seq, event_type, body) -> str:
        """The digest of the whole body after an event; its size is self.size."""
        if seq <= self.at:
            raise ValueError(f"seq {seq} of {self.chain[0]} comes after {self.at}")
        self.at = seq
        if event_type == "put":
            self.sha, self.size = hashlib.sha256(), 0
        raw = body.encode()
        self.sha.update(raw)
        self.size += len(raw)
        return self.sha.hexdigest()

    def feed(self, world, generation, seq, timestamp, event_type, body, content_type, headers, op_id) -> Iterator[tuple]:
        if self.begins(world, generation):
            yield self.row(1, timestamp, "format", world, crypto.EMPTY_SHA, 0, "", [(FORMAT_HEADER, FORMAT_VERSION)], op_id)
        sha = self.body(seq, event_type, body)
        yield self.row(seq, timestamp, event_type, world, sha, self.size, content_type, headers, op_id)


def build(ops: DataFrame, key: bytes = crypto.FIXTURE_KEY) -> DataFrame:
    """The events of every life of every world, format rows included."""
    ship(ops.sparkSession)
    # a fixed number of tasks: left to their size in the shuffle, few tasks would each hold several times that in windows
    n = partitions(ops.sparkSession)
    rows = body_events(ops.repartition(n, "world")).withColumn("headers", crypto.canonical_headers(F.col("headers")))
    # the windows keep rows dealt out by world; sorting within partitions is all that is left
    rows = rows.repartition(n, "world").sortWithinPartitions("world", "op_id")
    # headers and their digest depend on no other row: Python is given the digest, and hands the headers through unread
    rows = rows.withColumn("meta_sha256", crypto.meta_sha256(F.col("content_type"), F.col("headers")))
    rows = rows.select("world", "generation", "seq", "timestamp", "event_type", "body", "content_type", "meta_sha256", "headers", "op_id")
    return rows.mapInArrow(_linker(key), EVENTS)


def _linker(key: bytes):
    """The pass over sorted rows: what it adds to a batch, and the format rows it puts before chains."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, mac = Fold(key), crypto.event_sealer(key)
        format_meta = crypto.meta_sha256_of("", [(FORMAT_HEADER, FORMAT_VERSION)])
        for batch in batches:
            given = ("world", "generation", "seq", "timestamp", "event_type", "body", "content_type", "meta_sha256")
            take, fresh, added = [], [], []
            for i, (world, generation, seq, ts, kind, body, content_type, meta) in enumerate(lists(batch, *given)):
                if state.begins(world, generation):
                    one = mac("", world, ts, "format", world, generation, crypto.EMPTY_SHA, "0", "", format_meta)
                    take.append(i)
                    fresh.append(True)
                    added.append((crypto.EMPTY_SHA, 0, one, ""))
                    state.prev = one
                sha = state.body(seq, kind, body)
                one = mac(state.prev, world, ts, kind, world, generation, sha, str(state.size), content_type, meta)
                take.append(i)
                fresh.append(False)
                added.append((sha, state.size, one, state.prev))
                state.prev = one
            rows = batch.take(pa.array(take, pa.int64()))
            first = pa.array(fresh, pa.bool_())
            either = lambda name, value: pc.if_else(first, pa.scalar(value, rows.column(name).type), rows.column(name))  # noqa: B023, E731
            sha, size, macs, prev = (pa.array([a[k] for a in added], pa.int64() if k == 1 else pa.string()) for k in range(4))
            headers = rows.column("headers")
            if any(fresh):
                plain = pa.array([[{"name": FORMAT_HEADER, "value": FORMAT_VERSION}]], headers.type)
                # the format row's headers stand behind those of the batch, and its rows point there
                where = pc.if_else(first, pa.scalar(len(batch), pa.int64()), pa.array(take, pa.int64()))
                headers = pa.concat_arrays([batch.column("headers"), plain]).take(where)
            columns = [
                rows.column("world"), rows.column("generation"), either("seq", 1), rows.column("timestamp"), either("event_type", "format"), rows.column("world"), sha, size,
                either("content_type", ""), either("meta_sha256", format_meta), macs, prev, headers, rows.column("op_id"),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=_COLUMNS)

    return fold


def ended(ops: DataFrame, key: bytes = crypto.FIXTURE_KEY) -> DataFrame:
    """op_id, timestamp, world, generation, seq, body_sha256, hmac: the accepted deletes with the last row of the life that
    each ends. build()'s pass with the deletes among the rows, so that no event is stored or looked up again."""
    ship(ops.sparkSession)
    rows = numbered(ops.repartition(partitions(ops.sparkSession), "world")).where("accepted")
    meta = crypto.meta_sha256(F.col("content_type"), crypto.canonical_headers(F.col("headers")))
    block = Window.partitionBy("world").orderBy("op_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("began", F.when(F.col("verb") == "replace", F.struct("content_type", meta.alias("meta"))))
    rows = rows.withColumn("began", F.last("began", True).over(block)).sortWithinPartitions("world", "op_id")
    rows = rows.select("world", "g", "timestamp", "verb", "body", "began.content_type", "began.meta", "op_id")
    return rows.mapInArrow(_ender(key), ENDED)


def _ender(key: bytes):
    """The pass over sorted ops, which gives back a row a delete."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mac, format_meta = crypto.event_sealer(key), crypto.meta_sha256_of("", [(FORMAT_HEADER, FORMAT_VERSION)])
        chain, name, prev, sha, body, size, seq = None, "", "", "", None, 0, 0
        for batch in batches:
            take, added = [], []
            for i, (world, g, ts, verb, text, content_type, meta) in enumerate(lists(batch, "world", "g", "timestamp", "verb", "body", "content_type", "meta")):
                if (world, g) != chain:
                    chain, name, seq = (world, g), generation_of(world, g), 1
                    prev = mac("", world, ts, "format", world, name, crypto.EMPTY_SHA, "0", "", format_meta)
                if verb == "delete":
                    take.append(i)
                    added.append((name, seq, sha, prev))
                    continue
                raw, seq = text.encode(), seq + 1
                if verb == "replace":
                    body, size = hashlib.sha256(), 0
                body.update(raw)
                sha, size = body.hexdigest(), size + len(raw)
                prev = mac(prev, world, ts, "put" if verb == "replace" else "append", world, name, sha, str(size), content_type, meta)
            rows = batch.take(pa.array(take, pa.int64()))
            made = (pa.array([a[k] for a in added], pa.int64() if k == 1 else pa.string()) for k in range(4))
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in ("op_id", "timestamp", "world")] + [*made], names=ENDED_NAMES)

    return fold


def bodies(ops: DataFrame) -> DataFrame:
    """world, generation, seq, event_type, body_sha256, size of the body events: build() without the chain.

    A body that no op extends is hashed where it is read, and only its digest is dealt out by world; so only worlds that
    are appended to go through the sorted pass.
    """
    names = ["world", "generation", "seq", "event_type", "body_sha256", "size"]
    grown = ops.where("verb = 'append'").select("world").distinct()
    slim = ops.select("op_id", "world", "verb", F.sha2("body", 256).alias("body_sha256"), F.octet_length("body").cast("long").alias("size"))
    life = Window.partitionBy("world", "g").orderBy("op_id")
    puts = numbered(slim.join(grown, "world", "left_anti")).where("verb = 'replace'")
    puts = puts.withColumns({"generation": generation(F.col("world"), F.col("g")), "seq": (F.row_number().over(life) + 1).cast("long"), "event_type": F.lit("put")})
    rest = build(ops.join(grown, "world", "left_semi")).where("event_type <> 'format'")
    return puts.select(*names).unionByName(rest.select(*names))


def single_hmac(key: bytes, prev: Column) -> Column:
    """The HMAC that a row should have. Inside the JVM for the fixtures' key, which the plan then shows; for any other key in
    Arrow batches, so that neither the plan nor its explanation has it in readable form."""
    fields = [prev, *(F.col(c) for c in ("world", "timestamp", "event_type", "target", "generation", "body_sha256", "size", "content_type", "meta_sha256"))]
    if key == crypto.FIXTURE_KEY:
        return crypto.event_hmac(key, *fields)

    @F.pandas_udf("string")
    def hmacs(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([None if None in row else crypto.event_hmac_of(key, *row) for row in rows.itertuples(index=False, name=None)], dtype=object)

    return hmacs(F.struct(*[f.cast("string").alias(f"f{k}") for k, f in enumerate(fields)]))


def _labelled(raw: Column) -> Column:
    return F.when(raw == "", "hmac-").when(raw.startswith("hmac-"), raw).otherwise(F.concat(F.lit("hmac-"), raw))


def _values(name: str) -> Column:
    return F.transform(F.filter("headers", lambda h: h["name"] == name), lambda h: h["value"])


def _subject_break() -> tuple[Column, Column]:
    """(expected, actual) of the proof that a delete row carries; null where it holds."""
    target = F.col("target")
    expected = F.when(paths.invalid_reason(target).isNotNull(), "delete-target-canonical-world").when(~F.col("body_sha256").rlike("^[0-9a-f]{64}$"), "delete-row-body-sha256")
    actual = F.when(paths.invalid_reason(target).isNotNull(), F.concat(F.lit("target-"), target)).when(~F.col("body_sha256").rlike("^[0-9a-f]{64}$"), "invalid-delete-row-body-sha256")
    one = {n: F.element_at(_values(n), 1) for n in SUBJECT}
    seq = one["subject-seq"]
    valid = {
        "subject-world": paths.invalid_reason(one["subject-world"]).isNull(),
        "subject-generation": one["subject-generation"].rlike("^[0-9a-f]{32}$"),
        "subject-seq": seq.rlike("^[1-9][0-9]{0,18}$") & seq.try_cast("long").isNotNull(),
        "subject-body-sha256": one["subject-body-sha256"].rlike("^[0-9a-f]{64}$"),
        "subject-hmac": one["subject-hmac"].rlike("^hmac-[0-9a-f]{64}$"),
    }
    memory_without = (paths.storage_class(target) == "memory") & (F.size(F.filter("headers", lambda h: h["name"].startswith("subject-"))) == 0)
    expected, actual = expected.when(memory_without, None), actual.when(memory_without, None)
    for n in SUBJECT:
        k = F.size(_values(n))
        for test, e, a in ((k == 0, f"delete-subject-{n}", f"missing-delete-subject-{n}"), (k > 1, f"one-delete-subject-{n}", f"duplicated-delete-subject-{n}"), (~valid[n], f"valid-delete-subject-{n}", f"invalid-delete-subject-{n}")):
            expected, actual = expected.when(test, e), actual.when(test, a)
        if n == "subject-world":
            expected = expected.when(one[n] != target, "delete-subject-world-matches-target")
            actual = actual.when(one[n] != target, "delete-subject-world-mismatch")
    other = one["subject-body-sha256"] != F.col("body_sha256")
    return expected.when(other, "delete-subject-body-sha256-matches-row"), actual.when(other, "delete-subject-body-sha256-mismatch")


def _spread(events: DataFrame) -> DataFrame:
    """events with before_it (the HMAC of the row before in its chain) and nth, by spans of seq instead of whole chains: a
    span's rows meet in one task, and what goes before a span is known from one row a span."""
    chain, span = ["world", "generation"], F.coalesce(F.shiftright("seq", SPAN_BITS), F.lit(-(2**62)))
    rows = events.withColumn("span", span)
    sums = rows.groupBy(*chain, "span").agg(F.count("*").alias("n"), F.max_by("hmac", "seq").alias("last"))
    spans = Window.partitionBy(*chain).orderBy("span")
    sums = sums.select(*chain, "span", F.lag("last").over(spans).alias("carried"), (F.sum("n").over(spans) - F.col("n")).alias("passed"))
    within = Window.partitionBy(*chain, "span").orderBy("seq")
    rows = rows.withColumns({"own": F.lag("hmac").over(within), "at": F.row_number().over(within)}).join(sums, [*chain, "span"])
    return rows.select(*events.columns, F.when(F.col("at") == 1, F.col("carried")).otherwise(F.col("own")).alias("before_it"), (F.col("passed") + F.col("at")).alias("nth"))


def row_breaks(events: DataFrame, key: bytes = crypto.FIXTURE_KEY, cas: DataFrame | None = None, floors: DataFrame | None = None, linked: str | None = None, spread: bool = False) -> DataFrame:
    """events with idx, expected and actual: the first of a row's checks that fails, null if none does.

    spread: deal long chains out over many tasks, see _spread. cas (world, generation, body_sha256, body_size) and floors (world, generation, floor) add the check of kept bodies;
    linked: a column with the HMAC before a row, where it is not among the events.
    """
    chain = Window.partitionBy("world", "generation").orderBy("seq")
    placed = _spread(events) if spread else events.withColumns({"before_it": F.lag("hmac").over(chain), "nth": F.row_number().over(chain)})
    prev = F.coalesce(F.col("before_it"), *([F.col(linked)] if linked else []), F.lit(""))
    out = placed.withColumn("linked", prev).withColumn("idx", (F.col("nth") - 1).cast("long")).drop("before_it", "nth")
    kind = F.col("event_type")
    bears, fmt, deletes = kind.isin("put", "append"), kind == "format", kind.isin("delete_intent", "delete_commit", "delete_commit_failed")
    meta = crypto.meta_sha256(F.col("content_type"), F.col("headers"))
    stamp = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z$"
    out = out.withColumn("real_meta", meta).withColumn("real_hmac", single_hmac(key, F.col("linked")))
    version = F.exists("headers", lambda h: (h["name"] == FORMAT_HEADER) & (h["value"] == FORMAT_VERSION))
    proof_expected, proof_actual = _subject_break()
    text = lambda label, c: F.concat(F.lit(label), c)
    checks = [
        (~(bears | fmt | deletes), F.lit("known-event-type"), text("event-type-", kind)),
        ((bears | fmt) & (F.col("target") != F.col("world")), text("target-", F.col("world")), text("target-", F.col("target"))),
        (F.col("prev_hmac") != F.col("linked"), _labelled(F.col("linked")), _labelled(F.col("prev_hmac"))),
        (fmt & ~version, F.lit(f"{FORMAT_HEADER}-{FORMAT_VERSION}"), F.lit("missing-world-format-version")),
        (deletes & proof_expected.isNotNull(), proof_expected, proof_actual),
        (F.col("meta_sha256") != F.col("real_meta"), text("meta-sha256-", F.col("real_meta")), text("meta-sha256-", F.col("meta_sha256"))),
        (~F.col("timestamp").rlike(stamp), F.lit("timestamp-sqlite-utc-ms"), text("timestamp-", F.col("timestamp"))),
        (F.col("hmac") != F.col("real_hmac"), _labelled(F.col("real_hmac")), _labelled(F.col("hmac"))),
    ]
    if cas is not None:
        out = out.join(floors, ["world", "generation"], "left").join(cas, ["world", "generation", "body_sha256"], "left")
        kept = bears & (F.col("seq") >= F.col("floor"))
        checks.append((kept & F.col("body_size").isNull(), text("cas-body-", F.col("body_sha256")), F.lit("missing-cas-body")))
        checks.append((kept & (F.col("body_size") != F.col("size")), text("cas-size-", F.col("size").cast("string")), text("cas-size-", F.col("body_size").cast("string"))))
    expected = actual = F
    for test, e, a in checks:
        expected, actual = expected.when(test, e), actual.when(test, a)
    return out.withColumns({"expected": expected, "actual": actual})


def verify(events: DataFrame, key: bytes = crypto.FIXTURE_KEY, cas: DataFrame | None = None, floors: DataFrame | None = None, linked: str | None = None) -> DataFrame:
    """world, generation, events, genesis, latest, break_at, expected, actual; the last three null for a valid chain."""
    rows = row_breaks(events, key, cas, floors, linked)
    broken = F.when(F.col("expected").isNotNull(), F.struct("idx", "expected", "actual"))
    out = rows.groupBy("world", "generation").agg(
        F.count("*").alias("events"), F.min_by("hmac", "seq").alias("genesis"), F.max_by("hmac", "seq").alias("latest"), F.min(broken).alias("b")
    )
    return out.select("world", "generation", "events", "genesis", "latest", F.col("b.idx").alias("break_at"), F.col("b.expected").alias("expected"), F.col("b.actual").alias("actual"))


def complete(report: DataFrame, events: DataFrame, cas: DataFrame, floors: DataFrame, live: DataFrame | None = None, stages: DataFrame | None = None) -> DataFrame:
    """verify()'s report with what only a whole chain shows: a floor without its event, kept bodies that no event at or
    above the floor refers to, a live world without events, and a stage that is not the last body. A break that the report
    has stays.

    cas and floors as for row_breaks; live: (world, generation) of the worlds that exist; stages: their bodies.
    """
    chain = ["world", "generation"]
    held = events.where("event_type in ('put', 'append')").join(floors, chain).where("seq >= floor")
    bare = floors.join(held.where("seq = floor").select(*chain), chain, "left_anti").select(*chain, F.col("floor").alias("bare"))
    unknown = cas.join(held.select(*chain, "body_sha256"), [*chain, "body_sha256"], "left_anti").select(*chain).distinct().withColumn("unknown", F.lit(True))
    if live is not None:
        report = report.join(live.select(*chain), chain, "full")
    out = report.join(bare, chain, "left").join(unknown, chain, "left").join(floors, chain, "left")
    n = F.coalesce("events", F.lit(0)).cast("long")
    none = F.col("events").isNull()
    checks = [
        (none, F.lit(0), F.lit("at-least-one-event"), F.lit("no-events")),
        (F.col("bare").isNotNull(), n, F.concat(F.lit("body-bearing event at first_retained_seq "), F.col("bare").cast("string")), F.lit("missing-retention-floor-event")),
        (F.col("unknown") & F.col("floor").isNull(), n, F.lit("retention floor"), F.lit("unset-retention-floor")),
        (F.col("unknown").isNotNull(), n, F.lit("all CAS bodies referenced by retained events"), F.lit("unreferenced-cas-body")),
    ]
    if stages is not None:
        last = events.where("event_type in ('put', 'append')").groupBy(*chain).agg(F.max_by(F.struct("body_sha256", "size"), "seq").alias("last"))
        body = stages.select(*chain, F.sha2("body", 256).alias("sha"), F.octet_length("body").cast("long").alias("n"))
        out = out.join(last, chain, "left").join(body, chain, "left")
        label = lambda what, c: F.concat(F.lit(f"live-body-{what}-"), c.cast("string"))
        sha, want = F.col("sha"), F.col("last.body_sha256")
        checks += [
            (F.col("last").isNull() & (F.col("n") > 0), n - 1, F.lit("latest body-bearing event"), label("sha256", sha)),
            (sha != want, n - 1, label("sha256", want), label("sha256", sha)),
            (F.col("n") != F.col("last.size"), n - 1, label("size", F.col("last.size")), label("size", F.col("n"))),
        ]
    at, expected, actual = (F.when(F.col("break_at").isNotNull(), F.col(c)) for c in ("break_at", "expected", "actual"))
    for test, where, e, a in checks:
        at, expected, actual = at.when(test, where), expected.when(test, e), actual.when(test, a)
    return out.select(*chain, n.alias("events"), "genesis", "latest", at.cast("long").alias("break_at"), expected.alias("expected"), actual.alias("actual"))


def verify_since(events: DataFrame, marks: DataFrame, key: bytes = crypto.FIXTURE_KEY) -> DataFrame:
    """verify()'s report of what follows verified heads, for logs that grow.

    marks: world, generation, seq, hmac (bare) of the last row that was verified of a chain; it must still be there as it
    was. Rows before it are not read again, chains without a mark are verified whole; events and break_at count the rows that
    are new.
    """
    chain = ["world", "generation"]
    known = marks.select(*chain, F.col("seq").alias("mark"), F.col("hmac").alias("seen"))
    rest = events.join(known, chain, "left").where("mark is null or seq >= mark")
    # a chain's mark is looked at even where the row, or all of the chain, has gone
    there = known.join(rest.where("seq = mark").select(*chain, F.col("hmac").alias("found")), chain, "left")
    lost = there.where("found is null or found <> seen").select(*chain, _labelled(F.col("seen")).alias("want"), F.coalesce(_labelled(F.col("found")), F.lit("no-events")).alias("got"))
    first = Window.partitionBy(*chain).orderBy("seq")
    rows = rest.withColumn("before", F.when(F.col("mark").isNotNull(), F.lag("hmac").over(first)))
    report = verify(rows.where("mark is null or seq > mark").drop("mark", "seen"), key, linked="before")
    out = report.join(lost, chain, "full").join(known, chain, "full")
    changed = F.col("want").isNotNull()
    pick = lambda c, other: F.when(changed, other).otherwise(F.col(c)).alias(c)
    return out.select(
        *chain, F.coalesce("events", F.lit(0)).cast("long").alias("events"), F.coalesce("latest", "seen").alias("latest"),
        pick("break_at", F.lit(0).cast("long")), pick("expected", F.col("want")), pick("actual", F.col("got")),
    )


def tail_verify(events: DataFrame, key: bytes = crypto.FIXTURE_KEY) -> DataFrame:
    """world, generation, seq, ok: the check of ordinary reads, which looks at the last row and its link alone."""
    chain = Window.partitionBy("world", "generation").orderBy("seq")
    rows = events.withColumn("linked", F.coalesce(F.lag("hmac").over(chain), F.lit(""))).withColumn("last", F.max("seq").over(Window.partitionBy("world", "generation")))
    tail = rows.where("seq = last")
    ok = (F.col("prev_hmac") == F.col("linked")) & (F.col("hmac") == single_hmac(key, F.col("linked")))
    return tail.select("world", "generation", "seq", ok.alias("ok"))


def sound(events: DataFrame, key: bytes = crypto.FIXTURE_KEY) -> DataFrame:
    """events of the chains that verify."""
    whole = verify(events, key).where("break_at is null").select("world", "generation")
    return events.join(whole, ["world", "generation"], "left_semi")


def head(events: DataFrame, key: bytes = crypto.FIXTURE_KEY) -> DataFrame:
    """world, generation, seq (the ordinal of the last row) and hmac of the chains; a broken chain has no head."""
    out = sound(events, key).groupBy("world", "generation").agg(F.count("*").alias("seq"), F.max_by("hmac", "seq").alias("hmac"))
    return out.select("world", "generation", "seq", _labelled(F.col("hmac")).alias("hmac"))


def stamp(events: DataFrame, ordinal: int, key: bytes = crypto.FIXTURE_KEY) -> DataFrame:
    """world, generation, requested, observed, hmac: the stamp at an ordinal; hmac is null where the chain is shorter. A
    broken chain has none."""
    events = sound(events, key)
    chain = Window.partitionBy("world", "generation").orderBy("seq")
    rows = events.withColumn("nth", F.row_number().over(chain))
    out = rows.groupBy("world", "generation").agg(F.count("*").alias("observed"), F.max(F.when(F.col("nth") == ordinal, F.col("hmac"))).alias("hmac"))
    return out.select("world", "generation", F.lit(ordinal).cast("long").alias("requested"), "observed", F.when(F.col("hmac").isNotNull(), _labelled(F.col("hmac"))).alias("hmac"))


def live_body(events: DataFrame, stages: DataFrame) -> DataFrame:
    """world, generation, ok: the stage's body is that of the last body event."""
    last = events.where("event_type in ('put', 'append')").groupBy("world", "generation").agg(F.max_by(F.struct("body_sha256", "size"), "seq").alias("last"))
    body = stages.select("world", "generation", F.sha2("body", 256).alias("sha"), F.octet_length("body").cast("long").alias("n"))
    joined = body.join(last, ["world", "generation"], "left")
    ok = F.when(F.col("last").isNull(), F.col("n") == 0).otherwise((F.col("sha") == F.col("last.body_sha256")) & (F.col("n") == F.col("last.size")))
    return joined.select("world", "generation", ok.alias("ok"))
