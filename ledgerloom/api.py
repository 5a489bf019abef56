"""A store over an op log: the verbs by name, each a DataFrame."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import crypto, paths
from .operators import chain, feed, ledger, retention, state, timeline, usage


class Store:
    """Everything that an op log implies. Nothing is computed before a result is asked for; persist() keeps the events.

    Options: key (of at least 32 bytes), retained (bodies kept a world), quota (bytes, none for unlimited), replay_max.
    """

    def __init__(self, ops: DataFrame, key: bytes = crypto.FIXTURE_KEY, retained: int = retention.KEEP, quota: int | None = None, replay_max: int = feed.RING):
        if len(key) < 32:
            raise ValueError("the key must have at least 32 bytes")
        if not 1 <= retained <= 65_536:
            raise ValueError("retained must be between 1 and 65536")
        self.ops, self.key, self.retained, self.quota, self.replay_max = ops, key, retained, quota, replay_max or feed.RING

    @cached_property
    def all_events(self) -> DataFrame:
        return chain.build(self.ops, self.key)

    def persist(self) -> Store:
        self.all_events.persist()
        return self

    @cached_property
    def live(self) -> DataFrame:
        """(world, generation) of the worlds that exist."""
        return state.last_life(self.ops).select("world", state.generation(F.col("world"), F.col("live_g")).alias("generation"))

    @cached_property
    def events(self) -> DataFrame:
        return self.all_events.join(self.live, ["world", "generation"], "left_semi")

    @cached_property
    def bodies(self) -> DataFrame:
        return retention.kept(self.events, self.retained)

    @cached_property
    def floors(self) -> DataFrame:
        return retention.floors(self.events, self.retained)

    @cached_property
    def ledger(self) -> DataFrame:
        return ledger.build(self.ops, self.all_events, self.key)

    def of(self, *worlds: str) -> Store:
        """A store of these worlds only: their ops are all that is read."""
        return Store(self.ops.where(F.col("world").isin(*worlds)), self.key, self.retained, self.quota, self.replay_max)

    def read(self, *worlds: str) -> DataFrame:
        """world, generation, body, content_type, headers, etag; all worlds where none is named."""
        own = self.of(*worlds) if worlds else self
        last = own.events.groupBy("world", "generation").agg(F.max_by("hmac", "seq").alias("hmac"))
        sound = chain.tail_verify(own.events, own.key).where("ok").select("world", "generation")
        heads = last.join(sound, ["world", "generation"], "left_semi").select("world", "generation", F.concat(F.lit("hmac-"), F.col("hmac")).alias("etag"))
        return state.stage(own.ops).join(heads, ["world", "generation"])

    def head(self, *worlds: str) -> DataFrame:
        return self.read(*worlds).withColumn("length", F.octet_length("body")).drop("body")

    def worlds(self, prefix: str = "", most: int | None = None) -> DataFrame:
        """Sorted; nothing at all if there are more than `most`."""
        found = state.listing(self.live.where(F.col("world").startswith(prefix)))
        return found if most is None else state.bounded(found, most)

    def du(self) -> DataFrame:
        return usage.du(state.stage(self.ops), self.events, self.bodies, ledger.usage_row(self.ops))

    def df(self) -> DataFrame:
        return usage.df(self.du(), self.quota)

    def verify(self) -> DataFrame:
        """Every live chain and the ledger, kept and current bodies included."""
        cas = self.bodies.select("world", "generation", "body_sha256", "body_size")
        worlds = chain.complete(chain.verify(self.events, self.key, cas, self.floors), self.events, cas, self.floors, self.live, state.stage(self.ops))
        return worlds.union(chain.verify(self.ledger, self.key))

    def verify_since(self, marks: DataFrame) -> DataFrame:
        """What follows the verified heads in marks (world, generation, seq, hmac) of the live chains."""
        return chain.verify_since(self.events, marks, self.key)

    def chain_head(self) -> DataFrame:
        return chain.head(self.events, self.key)

    def chain_stamp(self, ordinal: int) -> DataFrame:
        return chain.stamp(self.events, ordinal, self.key)

    def get_at(self, coords: DataFrame) -> DataFrame:
        return timeline.dereference(coords, self.live, self.events, self.bodies, self.floors)

    def changes(self, pattern: str = "*") -> DataFrame:
        """The feed in order of delivery."""
        out = feed.delivered(feed.changes(self.all_events, self.ledger))
        return out.where(feed.matches(F.col("world"), pattern))

    def resume(self, requests: DataFrame) -> DataFrame:
        return feed.resume(requests, self.live, self.events, self.replay_max)


def tier_of(token: str | None, approve: str | None, write: str | None, read: str | None) -> str:
    """The highest tier whose token matches; reads are public where no read token is set."""
    import hmac

    for name, own in (("approve", approve), ("write", write), ("read", read)):
        if own and token and hmac.compare_digest(own.encode(), token.encode()):
            return name
    return "anon"


__all__ = ["Store", "tier_of", "paths"]
