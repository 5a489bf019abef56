import pytest
from pyspark.sql import functions as F

from ledgerloom.api import Store, tier_of
from ledgerloom.functions import crypto, paths
from ledgerloom.operators import chain, conditional, feed, ledger, policy, retention, state
from ledgerloom.sources import oplog
from ledgerloom.streaming import chain_stream

ROWS = [(1, "home/a", "replace", "v1"), (2, "home/a", "append", "+é"), (3, "home/b", "append", "x"), (4, "home/a", "replace", "v1"), (5, "home/b", "replace", ""), (6, "home/a", "delete", ""), (7, "home/a", "delete", ""), (8, "home/a", "replace", "again"), (9, "home/b", "append", "end")]


@pytest.fixture(scope="module")
def ops(spark):
    rows = [(i, f"2024-01-01T00:00:0{i}.000Z", w, v, b, "text/plain", [("X-N", str(i))]) for i, w, v, b in ROWS]
    return spark.createDataFrame(rows, oplog.OPS)


@pytest.fixture(scope="module")
def events(ops):
    return chain.build(ops).cache()


def test_verbs(ops):
    status = {r.op_id: r.status for r in state.outcomes(ops).collect()}
    assert sorted(i for i, s in status.items() if s == "not_found") == [3, 7]
    stages = {r.world: r.body for r in state.stage(ops).collect()}
    assert stages == {"home/a": "again", "home/b": "end"}


def test_format_row_comes_first(events):
    rows = events.where("world = 'home/a'").orderBy("op_id", "seq").collect()
    assert [(r.seq, r.event_type) for r in rows] == [(1, "format"), (2, "put"), (3, "append"), (4, "put"), (1, "format"), (2, "put")]
    assert rows[0].prev_hmac == "" and rows[1].prev_hmac == rows[0].hmac and rows[2].size == 5


def test_valid_chains_and_ledger(ops, events):
    assert chain.verify(events).where("break_at is not null").count() == 0
    book = ledger.build(ops, events)
    assert [r.event_type for r in book.orderBy("seq").collect()] == ["format", "delete_intent", "delete_commit"]
    assert chain.verify(book).where("break_at is not null").count() == 0
    failed = ledger.build(ops, events, failed=(6,))
    assert failed.where("event_type = 'delete_commit_failed'").count() == 1


X = F.col
#: Of each field: a changed value as SQL, and how the report starts.
MUTATIONS = {
    "hmac": ("repeat('0', 64)", "hmac-", "hmac-000"),
    "prev_hmac": ("repeat('f', 64)", "hmac-", "hmac-fff"),
    "target": ("'home/x'", "target-home/a", "target-home/x"),
    "event_type": ("'rename'", "known-event-type", "event-type-rename"),
    "timestamp": ("'yesterday'", "timestamp-sqlite-utc-ms", "timestamp-yesterday"),
    "size": ("size + 1", "hmac-", "hmac-"),
    "body_sha256": ("repeat('1', 64)", "hmac-", "hmac-"),
    "meta_sha256": ("repeat('2', 64)", "meta-sha256-", "meta-sha256-222"),
    "content_type": ("'a/b'", "meta-sha256-", "meta-sha256-"),
    "headers": ("array(named_struct('name', 'x-n', 'value', '9'))", "meta-sha256-", "meta-sha256-"),
}


@pytest.mark.parametrize("field", MUTATIONS)
def test_one_changed_field_breaks_where_it_is(events, field):
    value, expected, actual = MUTATIONS[field]
    here = (X("op_id") == 2) & (X("event_type") != "format")
    spoilt = events.withColumn(field, F.when(here, F.expr(value)).otherwise(X(field)))
    (row,) = chain.verify(spoilt).where("break_at is not null").collect()
    assert row.world == "home/a" and row.break_at == 2 and row.expected.startswith(expected) and row.actual.startswith(actual)


def test_format_version_is_needed(events):
    spoilt = events.withColumn("headers", F.when(X("event_type") == "format", F.array().cast("array<struct<name:string,value:string>>")).otherwise(X("headers")))
    rows = chain.verify(spoilt).collect()
    assert all(r.break_at == 0 and r.actual == "missing-world-format-version" for r in rows)


@pytest.mark.parametrize(
    ("change", "actual"),
    [
        (lambda h: F.filter(h, lambda x: x["name"] != "subject-seq"), "missing-delete-subject-subject-seq"),
        (lambda h: F.concat(h, F.filter(h, lambda x: x["name"] == "subject-hmac")), "duplicated-delete-subject-subject-hmac"),
        (lambda h: F.transform(h, lambda x: F.struct(x["name"].alias("name"), F.when(x["name"] == "subject-seq", "007").otherwise(x["value"]).alias("value"))), "invalid-delete-subject-subject-seq"),
        (lambda h: F.transform(h, lambda x: F.struct(x["name"].alias("name"), F.when(x["name"] == "subject-world", "home/q").otherwise(x["value"]).alias("value"))), "delete-subject-world-mismatch"),
        (lambda h: F.transform(h, lambda x: F.struct(x["name"].alias("name"), F.when(x["name"] == "subject-body-sha256", "0" * 64).otherwise(x["value"]).alias("value"))), "delete-subject-body-sha256-mismatch"),
    ],
)
def test_delete_proofs(ops, events, change, actual):
    book = ledger.build(ops, events)
    spoilt = book.withColumn("headers", F.when(X("event_type") == "delete_intent", change(X("headers"))).otherwise(X("headers")))
    row = chain.verify(spoilt).first()
    assert (row.break_at, row.actual) == (1, actual)


def test_kept_bodies_are_checked(events):
    live = events.where("op_id > 7 or world = 'home/b'")
    cas, floors = retention.kept(live, 2).select("world", "generation", "body_sha256", "body_size"), retention.floors(live, 2)
    assert chain.verify(live, cas=cas, floors=floors).where("break_at is not null").count() == 0
    missing = chain.verify(live, cas=cas.where("world <> 'home/b' or body_size = 0"), floors=floors).where("break_at is not null").first()
    assert missing.actual == "missing-cas-body"
    wrong = chain.verify(live, cas=cas.withColumn("body_size", X("body_size") + 1), floors=floors).where("break_at is not null").first()
    assert wrong.actual.startswith("cas-size-")


def test_retention_equals_pruning_step_by_step(spark):
    import random

    rng = random.Random(3)
    for keep in (1, 2, 3):
        seqs = [(s, rng.choice("abcd")) for s in range(2, 14)]
        held, log = set(), []
        for s, sha in seqs:
            log.append((s, sha))
            held.add(sha)
            floor = sorted(x for x, _ in log)[-keep:][0]
            held = {h for h in held if any(x >= floor and y == h for x, y in log)}
        df = spark.createDataFrame([("w", "g", s, "put", sha, 1) for s, sha in seqs], "world string, generation string, seq long, event_type string, body_sha256 string, size long")
        assert {r.body_sha256 for r in retention.kept(df, keep).collect()} == held


def test_store(ops):
    store = Store(ops, retained=2, quota=1000)
    assert {r.world for r in store.worlds().collect()} == {"home/a", "home/b"}
    assert store.worlds(most=1).count() == 0 and store.worlds("home/b").count() == 1
    assert store.verify().where("break_at is not null").count() == 0
    assert store.df().first().worlds == 2
    verbs = [r.verb for r in store.changes("*").orderBy("delivery_id").collect()]
    assert verbs[:2] == ["format", "replace"] and verbs.count("delete") == 3
    assert {r.etag for r in store.read("home/a").collect()} == {r.hmac for r in store.chain_head().where("world = 'home/a'").collect()}
    with pytest.raises(ValueError, match="32 bytes"):
        Store(ops, key=b"short")


def test_tiers():
    assert tier_of("a", "a", "a", None) == "approve" and tier_of("w", "a", "w", "r") == "write" and tier_of("?", "a", "w", "r") == "anon" and tier_of(None, "a", "w", None) == "anon"


def test_fence(spark):
    live = spark.createDataFrame([("w", "g", 3), ("w", "g", 5), ("w", "h", 1), ("v", "g", 1)], "world string, generation string, seq long")
    fence = spark.createDataFrame([("w", "g", 4)], "world string, generation string, floor long")
    got = {(r.world, r.generation, r.seq, r.reset) for r in feed.fenced(live, fence).collect()}
    assert got == {("w", "g", 5, False), ("w", "h", 1, True), ("v", "g", 1, False)}


def test_new_bodies(spark):
    batch = spark.createDataFrame([("w", "g", "a"), ("w", "g", "a"), ("w", "g", "b")], "world string, generation string, body_sha256 string")
    assert [r.body_sha256 for r in retention.new_bodies(batch, batch.where("body_sha256 = 'b'")).collect()] == ["a"]


def test_fold_refuses_disorder():
    fold = chain.Fold(crypto.FIXTURE_KEY)
    list(fold.feed("w", "g", 2, "t", "put", "", "", [], 1))
    with pytest.raises(ValueError, match="comes after"):
        list(fold.feed("w", "g", 2, "t", "put", "", "", [], 2))


def test_schema_is_checked(spark):
    with pytest.raises(ValueError, match="op_id"):
        oplog.assert_schema(spark.range(1), oplog.OPS)


def test_cursor_round_trip(spark):
    df = spark.createDataFrame([("home/a b é+%", "a" * 32, 5)], "world string, generation string, seq long")
    text = df.select("world", paths.cursor(X("world"), X("generation"), X("seq")).alias("c"))
    row = text.select("world", "c", paths.cursor_status(X("c")).alias("s"), paths.cursor_parts(X("c"))[0].alias("w")).first()
    assert row.c == "home/a%20b%20%C3%A9%2B%25@" + "a" * 32 + "=5" and row.s == "ok" and row.w == row.world


def test_conditional_writes_without_conditions_give_the_chain(spark, ops, events):
    """Refused deletes change no generation, so both mint the same tags."""
    free = ops.withColumns({"if_match": F.lit(None).cast("string"), "if_none_match": F.lit(None).cast("string")})
    got = {r.op_id: r.etag for r in conditional.outcomes(free).where("status = 'ok' and etag is not null").collect()}
    assert got == {r.op_id: f"hmac-{r.hmac}" for r in events.where("event_type <> 'format'").collect()}


def test_conditional_writes_against_a_plain_loop(spark, small):
    from ledgerloom.plans import queries

    stale, fold, state_of, want = ["hmac-stale"], {}, {}, {}
    rows = sorted(oplog.events_ops(spark, small).withColumn("headers", crypto.canonical_headers(X("headers"))).collect(), key=lambda r: r.op_id)
    for r in rows:
        tag, lives = state_of.get(r.world, (None, 0))
        match, none = (["*"] if r.op_id % 3 == 0 else stale if r.op_id % 7 == 0 else None), r.op_id % 5 == 0
        if match and (tag is None or match != ["*"]) or none and tag is not None:
            want[r.op_id] = "precondition_failed"
        elif r.verb != "replace" and tag is None:
            want[r.op_id] = "not_found"
        else:
            want[r.op_id] = "ok"
            state_of[r.world] = (None, lives + 1) if r.verb == "delete" else ("some", lives)
    assert {r.op_id: r.status for r in queries.if_match_outcomes(spark, small).collect()} == want and len(set(want.values())) == 3


def test_own_keys_stay_out_of_the_plan(spark, ops):
    key = b"a key of one's own, long enough for this"
    store = Store(ops, key=key)
    checked = store.verify()
    assert checked.where("break_at is not null").count() == 0 and checked.count() == 3
    inner, outer = crypto.pads(key)
    plan = checked._jdf.queryExecution().toString().lower()
    assert all(x not in plan for x in (key.decode(), key.hex(), inner.hex(), outer.hex()))
    wrong = chain.verify(store.events.where("seq > 0"), crypto.FIXTURE_KEY)
    assert wrong.where("break_at = 0").count() == wrong.count() == 2


def test_reads_touch_their_worlds_only(spark, ops, tmp_path):
    ops.write.parquet(str(tmp_path / "ops"))
    read = Store(oplog.read_log(spark, str(tmp_path / "ops"))).read("home/a")
    plan = read._jdf.queryExecution().toString()
    assert read.count() == 1 and plan.count("FileScan") == plan.count("EqualTo(world,home/a)") > 0


def test_stored_headers(spark):
    given = [("X-My-B", "1"), ("cache-control", "old"), ("Cookie", "c"), ("Cache-Control", "new"), ("Expires", "e"), ("x-other", "o"), ("cf-ray", "r")]
    df = spark.createDataFrame([(given,)], "headers array<struct<name:string,value:string>>")
    row = df.select(policy.stored_headers(X("headers"), "x-my-*, cf-*", "expires").alias("h")).first()
    assert [tuple(h) for h in row.h] == [("cache-control", "new"), ("x-my-b", "1")]


def test_quota_against_a_plain_loop(spark, small):
    from ledgerloom.operators import usage

    ops = oplog.events_ops(spark, small)
    for keep, quota in ((1, 3000), (2, 10**9), (3, 5000)):
        worlds, used, want = {}, 0, {}
        for r in sorted(ops.collect(), key=lambda r: r.op_id):
            old, kept = worlds.get(r.world, (None, []))
            if r.verb != "replace" and old is None:
                continue
            new = None if r.verb == "delete" else r.body if r.verb == "replace" else old + r.body
            then = [] if new is None else [*kept, new][-keep:]
            grown = sum(map(len, {*then})) + len(new or "") - sum(map(len, {*kept})) - len(old or "")
            if grown > 0 and used + grown > quota:
                want[r.op_id] = (grown, used, "quota_exceeded")
                break
            used += grown
            want[r.op_id], worlds[r.world] = (grown, used, "ok"), (new, then)
        got = {r.op_id: (r.grown, r.used, r.status) for r in usage.decided(ops, chain.build(ops), quota, keep).collect()}
        assert got == want


def test_new_rows_are_verified_from_the_mark_on(events):
    marks = events.where("seq = 2").select("world", "generation", "seq", "hmac")
    assert chain.verify_since(events, marks).where("break_at is not null").count() == 0
    spoilt = events.withColumn("size", F.when(X("seq") == 3, X("size") + 1).otherwise(X("size")))
    found = chain.verify_since(spoilt, marks).where("break_at is not null").collect()
    chains = spoilt.where("seq = 3").count()
    assert len(found) == chains > 0 and all(r.break_at == 0 and r.expected.startswith("hmac-") for r in found)
    # a break before the mark was somebody else's to find
    before = events.withColumn("size", F.when(X("seq") == 1, X("size") + 1).otherwise(X("size")))
    assert chain.verify_since(before, marks).where("break_at is not null").count() == 0
    assert chain.verify_since(events.where("false"), marks).where("actual = 'no-events'").count() == marks.count()


def test_ledger_by_ranges_and_spans(spark, ops, small, monkeypatch):
    """The serial pass goes on from range to range, and a long chain is checked in spans: nothing takes it whole."""
    log = oplog.events_ops(spark, small)
    made = chain.build(log).cache()
    whole = ledger.build(log, made).orderBy("seq").collect()
    monkeypatch.setattr(ledger, "RANGE", 37)
    monkeypatch.setattr(chain, "SPAN_BITS", 4)
    book = ledger.build(log, made).cache()
    assert book.orderBy("seq").collect() == whole and len(whole) > 3 * 37
    assert [r.seq for r in whole] == list(range(1, len(whole) + 1)) and chain.verify(book).first().break_at is None
    # rows lost, changed and out of step, at the edges of spans and elsewhere
    odd = book.where("seq not in (16, 17, 40) and not seq between 64 and 100").withColumn("hmac", F.when(X("seq").isin(31, 48), "0").otherwise(X("hmac")))
    mixed = odd.unionByName(made)
    names = ["world", "generation", "seq", "idx", "linked", "expected", "actual"]
    order = lambda rows: rows.select(*names).orderBy("world", "generation", "seq").collect()
    plain, spans = chain.row_breaks(mixed), chain.row_breaks(mixed, spread=True)
    assert order(plain) == order(spans) and spans.where("expected is not null").count() > 4
    none = ops.where("verb <> 'delete'")
    assert ledger.build(none, chain.build(none)).count() == 0


def test_stream_goes_on_over_batches(spark, ops, events, tmp_path):
    """Chains, running digests, headers and lives go on from the state of the batch before."""
    for k in range(5):
        ops.where(f"op_id between {2 * k} and {2 * k + 1}").coalesce(1).write.parquet(str(tmp_path / "in" / f"f={k}"))
    raw = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    chain_stream.run_to_end(raw, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() > 2
    key = ["world", "generation", "seq"]
    assert got.select(*events.columns).orderBy(*key).collect() == events.orderBy(*key).collect()


def test_bodies_without_the_chain(spark, ops, events, small):
    """The same bodies as the chain's, and texts that nothing appends to are hashed before rows are dealt out."""
    names = ["world", "generation", "seq", "event_type", "body_sha256", "size"]
    more = ops.unionByName(ops.where("world = 'home/a' and verb <> 'append'").withColumn("world", F.lit("home/c")))
    for log in (ops, more):
        want = chain.build(log).where("event_type <> 'format'").select(*names).orderBy("world", "generation", "seq").collect()
        assert chain.bodies(log).orderBy("world", "generation", "seq").collect() == want
    plan = retention.stored(chain.bodies(oplog.documents_ops(spark, small)))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    above = plan[: plan.rindex(windows[-1])]
    assert windows and "text#" not in above


def test_chain_does_not_depend_on_batches(spark, ops, events):
    """Format rows and headers stand where they belong, wherever a batch of the pass ends."""
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 2, 3):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            got = chain.build(ops).orderBy("world", "generation", "seq").collect()
            assert got == events.orderBy("world", "generation", "seq").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    first, second = got[0], got[1]
    assert [tuple(h) for h in first.headers] == [("format-version", "2")] and first.content_type == "" and first.target == first.world
    assert [tuple(h) for h in second.headers] == [("x-n", "1")] and second.prev_hmac == first.hmac
    assert "MapInArrow" in chain.build(ops)._jdf.queryExecution().toString()


def test_ring_without_numbering_all(ops, events):
    changes = feed.changes(events, ledger.build(ops, events)).cache()
    numbered = feed.delivered(changes)
    for most in (1, 4, 1000):
        want = feed.ring(numbered, most).orderBy("delivery_id").collect()
        got = feed.ring_of(changes, most)
        assert got.select(*numbered.columns).orderBy("delivery_id").collect() == want and len(want) == min(most, changes.count())
    assert feed.ring_of(changes.limit(0), 5).count() == 0


def test_tasks_of_chains_are_not_merged(spark, ops):
    """The number of tasks is fixed, and one exchange serves windows and pass: merged by their size in the shuffle, tasks
    held more the larger the input was."""
    log = ops.where("op_id > 0")  # not the plan of a fixture that is cached
    for rows in (chain.build(log), ledger.accepted_deletes(log)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 1


def test_positions_without_the_chain(spark, ops, events, small):
    """The feed's numbers and cursors follow from the ops: the same as with chain and ledger, without Python or a body."""
    names = ["delivery_id", "op_id", "part", "world", "verb", "generation", "seq", "cursor"]
    log = oplog.events_ops(spark, small)
    none = ops.where("verb <> 'delete'")
    for each, made in ((ops, events), (none, chain.build(none)), (log, chain.build(log).cache())):
        want = feed.delivered(feed.changes(made, ledger.build(each, made))).select(*names).orderBy("delivery_id").collect()
        assert feed.positions(each).select(*names).orderBy("delivery_id").collect() == want and len(want) > 5
    assert feed.positions(ops.where("false")).count() == 0


def test_ledger_in_one_pass_over_the_ops(spark, ops, events, small):
    """Deletes get the heads of what they delete where chains are made: the same ledger, with nothing joined."""
    log = oplog.events_ops(spark, small)
    odd = ops.withColumns({"world": F.concat("world", F.lit("é")), "content_type": F.lit("text/ü")}).unionByName(ops.withColumn("op_id", X("op_id") + 100))
    for each in (ops, odd, log, ops.where("verb <> 'delete'")):
        made = chain.build(each)
        for key in (crypto.FIXTURE_KEY, b"k" * 80):
            made = chain.build(each, key)
            want = ledger.subjects(each, made).select("op_id", "timestamp", "world", "generation", "seq", "body_sha256", "hmac").orderBy("op_id").collect()
            assert ledger.subjects(each, key=key).orderBy("op_id").collect() == want
        assert ledger.build(each, failed=(6,)).orderBy("seq").collect() == ledger.build(each, chain.build(each), failed=(6,)).orderBy("seq").collect()
    plan = ledger.subjects(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and len(want) == 0 == ledger.build(ops.where("false")).count()


def test_state_takes_one_sort(ops):
    """Every window of a world's ops has the same order, so rows are sorted once for all of them and for the pass."""
    plan = chain.build(ops.where("op_id > 0"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Window [") > 3


def test_sealer(spark):
    rows = [("", "home/a", "2024"), ("a" * 64, "home/é", "ü"), ("b" * 64, "home/\U0001f600\0", "")]
    for key in (crypto.FIXTURE_KEY, b"k", b"long" * 40):
        mac = crypto.event_sealer(key)
        for prev, world, ts in rows:
            values = (prev, world, ts, "put", world, "g", "s", "0", "a/é" if ts else "", "m")
            assert mac(*values) == crypto.event_hmac_of(key, *values)


def test_wildcards_resume_without_the_chain(spark, small, monkeypatch):
    from ledgerloom.plans import queries

    def never(*_, **__):
        raise AssertionError("a chain was built")

    monkeypatch.setattr(chain, "build", never)
    assert queries.resume_wildcard(spark, small).count() > 0 and queries.ring_window(spark, small).count() == queries.RING
