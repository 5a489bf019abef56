"""Helpers shared by the operators: input tables, shared-folder tables, word hashing, links to components."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import partitions, ship, stash

__all__ = ["connected_components", "gram_hashes", "hubs", "partitions", "spread_join", "stash", "table"]

#: Words end at these ASCII characters in every operator on words.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    most = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_R32, _R29 = np.uint64(32), np.uint64(29)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words; none when there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = hashes[:n] * _M1
    for j in range(1, k):
        acc = (acc ^ (acc >> _R29)) * _M2 + hashes[j : n + j]
    acc ^= acc >> _R32
    acc *= _M1
    return acc ^ (acc >> _R29)


#: Rows of a key from which on it may count as a hub.
HUB = 1000


def hub_rows(spark: SparkSession, rows: int) -> int:
    """Rows that a key must exceed to be a hub: of `rows` rows, at most four hubs for each partition do."""
    return max(HUB, rows // (4 * partitions(spark)))


def hubs(df: DataFrame, key: str) -> DataFrame | None:
    """(key, ways): the keys that hold many rows of df (a stored table), and into how many parts theirs are to be cut."""
    rows = df.count()
    if rows <= HUB:
        return None
    most = hub_rows(df.sparkSession, rows)
    held = df.groupBy(key).agg(F.count("*").alias("ways")).where(F.col("ways") > most)
    return held.withColumn("ways", F.ceil(F.col("ways") / F.lit(most)))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], many: DataFrame | None) -> DataFrame:
    """left join right on keys. The rows of hubs (the table of hubs(left, one of keys)) are cut into parts on the left, and
    come once a part on the right, so that no key's rows have to meet in one task."""
    if many is None:
        return left.join(right, keys)
    (key,) = (c for c in many.columns if c != "ways")
    ways = F.coalesce("ways", F.lit(1))
    cut = left.join(F.broadcast(many), key, "left").withColumn("part", F.pmod(F.xxhash64(*left.columns), ways)).drop("ways")
    each = right.join(F.broadcast(many), key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), ways - 1).cast("array<long>"))).drop("ways")
    return cut.join(each, [*keys, "part"]).drop("part")


def with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v), a stored table, with m: the smallest v of each u. A hub's m is broadcast, so its edges stay spread."""
    rows = edges.count()
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    if rows <= HUB:
        return edges.join(low.drop("c"), "u")
    hot = F.broadcast(low.where(F.col("c") > hub_rows(edges.sparkSession, rows)).drop("c"))
    return edges.join(hot, "u").union(edges.join(hot.select("u"), "u", "left_anti").join(low.drop("c"), "u"))


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges, for each node that has an edge.

    Alternating large-star and small-star steps over written tables; the edge set never grows, and a hub's neighbours
    are only aggregated (min) and joined, never gathered. Null ends and loops are ignored.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = stash(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    size, before = None, None
    while True:
        both = with_least(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))).withColumn("m", F.least("u", "m"))
        large = stash(both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = with_least(large).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            large.groupBy("u").agg(F.min("v").alias("v"))
        )
        e = stash(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small")
        row = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0))).first()
        before, size = size, tuple(row)
        if size == before or size[0] == 0:
            break
    nodes = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = e.select(F.col("v").alias("node")).distinct().join(nodes.select("node"), "node", "left_anti")
    return nodes.union(roots.select("node", F.col("node").alias("component")))
