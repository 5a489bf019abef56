"""Substring dedup (operator 8).

A window of `window` words is repeated when its word sequence starts anywhere else. Documents are streamed through
compressed FM-indexes, one a shard; what a shard indexes is chosen so that no window has to meet more than one shard:

1. Anchors. The hash-smallest gram of `gram` words in a window is its anchor, so equal windows have equal anchors. The
   windows of a document that share an anchor form one segment. Anchors that occur once in the corpus end here.
2. Segments of equal content are counted and then kept once, with their number: copies of any number cost one entry. An
   anchor with very many different segments (a passage quoted in different surroundings) is dealt anew window by window,
   under the anchor, the window's first and last words and the anchor's place, so that it fills many shards.
3. A shard (by hash of the key) sorts the suffixes of its segments, stores the Burrows-Wheeler transform as a wavelet
   tree of packed bits with rank counts, and streams its documents' segments through it by backward search. Statistics of
   the whole segment are tried first; where it has no partner it is halved down to single windows. The weight of the
   suffix interval, the sum of the numbers of its segments, is the number of occurrences; two or more report the interval.
4. Reported windows go back to every document that holds the segment, and their words are removed.

Defined cases: a null text has no words; a text shorter than the window keeps all; an overlap with itself in the same
document counts; repeated rows repeat each other's windows; a null identifier is kept; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, gram_hashes, partitions, stash, table

WINDOW, GRAM = 35, 8
#: Words that a shard indexes at a time, and different segments beyond which an anchor is dealt window by window.
SHARD_WORDS, HOT_SEGMENTS = 600_000, 2_000


#: A document's different segments: the first start of each, the others (null where there are none), windows, number.
PARTS = {"doc": "long", "mark": "long", "anchor": "long", "content": "long", "start": "int", "rest": "array<int>", "count": "int", "times": "int"}


def segments(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window start, number of windows) of each segment of a document's word hashes."""
    g = gram_hashes(h, gram)
    span = window - gram + 1
    views = np.lib.stride_tricks.sliding_window_view(g, span)
    place = np.empty(len(views), np.int64)
    for at in range(0, len(views), 1 << 16):
        place[at : at + (1 << 16)] = views[at : at + (1 << 16)].argmin(1) + np.arange(at, min(at + (1 << 16), len(views)))
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    counts = np.diff(np.r_[starts, len(place)])
    return g[place[starts]], starts, counts


class WaveletTree:
    """Rank over a sequence of small numbers: one packed bit vector a level, with counts of ones before each 64 bits."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels, self.n = max(1, int(sigma - 1).bit_length()), len(seq)
        self.bits, self.before, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (seq >> level & 1).astype(bool)
            packed = np.zeros(-(-(self.n + 1) // 64) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            self.bits.append(words)
            self.before.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)].astype(np.uint32))
            self.zeros.append(int(self.n - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before place `at`; start: where the symbol's run begins on the lowest level."""
        for k, level in enumerate(reversed(range(self.levels))):
            word = at >> 6
            ones = self.before[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            ones = ones.astype(np.int64)
            at = np.where(symbol >> level & 1, self.zeros[k] + ones, at - ones)
        return at - start


class FMIndex:
    """Of segments (arrays of word numbers from 1 on), each followed by the end mark 0, with a weight each."""

    def __init__(self, parts: list[np.ndarray], weights: np.ndarray, depth: int):
        sizes = np.array([len(p) for p in parts])
        text = np.concatenate([np.r_[p, 0] for p in parts]).astype(np.int64)
        sigma, n = int(text.max()) + 1, len(text)
        # suffixes sorted by their first `depth` words and no further than the end mark: all that searches can see
        left = np.repeat(np.cumsum(sizes + 1), sizes + 1) - np.arange(n)  # words up to and with the end mark
        rank, reach = text.copy(), 1
        while reach < depth:
            ahead = np.where(left > reach, np.r_[rank[reach:], np.zeros(min(reach, n), np.int64)][:n] + 1, 0)
            rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)[1].astype(np.int64)
            reach *= 2
        order = np.argsort(rank, kind="stable")
        heavy = np.repeat(weights, sizes + 1)[order]
        self.cumulative = np.r_[0, np.cumsum(heavy)]
        bwt = text[order - 1]  # of the first suffix the last end mark
        # Within suffixes that start alike the order may end at `depth`; ranks of rows stay consistent for searches up to it
        self.tree = WaveletTree(bwt, sigma)
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]
        symbols = np.arange(sigma)
        self.start = self.tree.rank(symbols, np.zeros(sigma, np.int64), np.zeros(sigma, np.int64))

    def occurrences(self, words: np.ndarray, end: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Weight of each query words[end - length : end], by backward search; it stops where the weight falls below 2."""
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), self.tree.n, np.int64)
        weight = np.zeros(len(end), np.int64)
        live = np.arange(len(end))
        for step in range(int(length.max(initial=0))):
            c = words[end[live] - 1 - step]
            base, start = self.first[c], self.start[c]
            lo[live], hi[live] = base + self.tree.rank(c, lo[live], start), base + self.tree.rank(c, hi[live], start)
            w = self.cumulative[hi[live]] - self.cumulative[lo[live]]
            over = step + 1 == length[live]
            weight[live[over]] = w[over]
            live = live[(w >= 2) & ~over]
            if not len(live):
                break
        return weight


def matched(parts: list[np.ndarray], weights: np.ndarray, window: int) -> list[int]:
    """For each segment the windows that occur twice or more, as bits."""
    names = np.unique(np.concatenate(parts), return_inverse=True)[1] + 1
    sizes = np.array([len(p) for p in parts])
    begins = np.cumsum(sizes) - sizes
    index = FMIndex(np.split(names, np.cumsum(sizes)[:-1]), weights, int(sizes.max()))
    masks = [0] * len(parts)
    part, lo, n = np.arange(len(parts)), np.zeros(len(parts), np.int64), sizes - window + 1
    while len(part):
        found = index.occurrences(names, begins[part] + lo + n + window - 1, n + window - 1) >= 2
        for p, a, k in zip(part[found].tolist(), lo[found].tolist(), n[found].tolist(), strict=True):
            masks[p] |= ((1 << k) - 1) << a
        more = ~found & (n > 1)
        part, lo, n = part[more], lo[more], n[more]
        half = n // 2
        part, lo, n = np.r_[part, part], np.r_[lo, lo + half], np.r_[half, n - half]
    return masks


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """id_col, n_words, n_removed, kept (the words that stay, joined by one space)."""
    return repeats(docs, id_col, text_col, window, gram).select(F.col("id").alias(id_col), "out.*")


def repeats(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, gram: int = GRAM, extra: tuple = ()) -> DataFrame:
    """(id, text, extra, out): extra holds the named columns of docs, out is (n_words, n_removed, kept)."""
    spark = docs.sparkSession
    # a text's own hash tells rows with one identifier apart; rows with both alike have the same windows
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.coalesce("id", F.lit(0)).alias("doc"), F.xxhash64("text").alias("mark"), "text")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part, out = batch.iloc[at : at + 500], []
                for doc, mark, text in zip(part["doc"], part["mark"], part["text"], strict=True):
                    h = hashes.of(text.encode().split())
                    if len(h) < window:
                        continue
                    anchor, start, count = segments(h, window, gram)
                    data = memoryview(h).cast("B")
                    ends = 8 * (start + count + window - 1)
                    content = [xxhash.xxh3_64_intdigest(data[x:y]) for x, y in zip((8 * start).tolist(), ends.tolist(), strict=True)]
                    # a text that repeats itself brings each segment once, with all its places
                    own, first, which, times = np.unique(np.array(content, np.uint64), return_index=True, return_inverse=True, return_counts=True)
                    rest = np.full(len(own), None, object)
                    if len(own) < len(start):
                        places = np.split(np.argsort(which, kind="stable"), np.cumsum(times)[:-1])
                        for k in np.flatnonzero(times > 1).tolist():
                            rest[k] = start[places[k][1:]].astype(np.int32)
                    ids = np.empty((2, len(own)), np.int64)
                    ids[0], ids[1] = doc, mark
                    out.append((ids[0], ids[1], anchor[first].view(np.int64), own.view(np.int64), start[first].astype(np.int32), rest, count[first].astype(np.int32), times.astype(np.int32)))
                if out:
                    yield pd.DataFrame(dict(zip(PARTS, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    parts = stash(rows.mapInPandas(find, ", ".join(f"{k} {v}" for k, v in PARTS.items())), "segments")
    twice = parts.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor")
    # one row for each different segment, with its number and one place where its words stand
    kinds = parts.join(twice, "anchor", "left_semi").groupBy("anchor", "content").agg(
        F.sum("times").alias("weight"), F.min(F.struct("doc", "mark", "start", "count")).alias("at")
    )
    kinds = stash(kinds.select("anchor", "content", "weight", "at.*"), "kinds")
    hot = stash(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where(f"kinds > {HOT_SEGMENTS}").select("anchor"), "hot")
    any_hot = bool(hot.take(1))
    cold = kinds.join(hot, "anchor", "left_anti") if any_hot else kinds

    def fetched(places: DataFrame, fetch, schema: str) -> DataFrame:
        """fetch sees each text once, with the segments to cut from it."""
        of = places.groupBy("doc", "mark").agg(F.collect_list(F.struct("anchor", "content", "weight", "start", "count")).alias("x"))
        of = of.select("doc", "mark", *[F.col(f"x.{c}").alias(c) for c in ("anchor", "content", "weight", "start", "count")])
        return rows.join(of, ["doc", "mark"]).drop("id", "doc", "mark").mapInPandas(fetch, schema)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 200):
                out = []
                for text, *lists in batch.iloc[at : at + 200].itertuples(index=False, name=None):
                    h = hashes.of(text.encode().split())
                    out += [(a, c, w, h[s : s + k + window - 1].tobytes()) for a, c, w, s, k in zip(*(x.tolist() for x in lists), strict=True)]
                yield pd.DataFrame(out, columns=["key", "content", "weight", "words"])

    def by_window(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 50):
                out = []
                for text, *lists in batch.iloc[at : at + 50].itertuples(index=False, name=None):
                    h = hashes.of(text.encode().split())
                    for a, c, w, s, k in zip(*(x.tolist() for x in lists), strict=True):
                        for o in range(k):
                            words = h[s + o : s + o + window].tobytes()
                            edges = xxhash.xxh3_64_intdigest(words[:24] + words[-24:], seed=a & 0xFFFFFFFF) >> 1
                            out.append((edges, xxhash.xxh3_64_intdigest(words) >> 1, a, c, o, w, words))
                yield pd.DataFrame(out, columns=["key", "kind", "anchor", "content", "offset", "weight", "words"])

    dealt = fetched(cold, whole, "key long, content long, weight long, words binary")
    if any_hot:
        # a hot anchor's windows go each under a key that only its like share, the equal ones counted before they are dealt
        singles = fetched(kinds.join(hot, "anchor", "left_semi"), by_window, "key long, kind long, anchor long, content long, offset int, weight long, words binary")
        singles = stash(singles.dropDuplicates(["anchor", "content", "offset"]), "singles")
        # F.min only picks: rows of one kind hold the same words
        summed = singles.groupBy("key", "kind").agg(F.sum("weight").alias("weight"), F.min("words").alias("words"))
        dealt = dealt.union(summed.select("key", F.col("kind").alias("content"), "weight", "words"))
    dealt = dealt.repartition(partitions(spark), "key").sortWithinPartitions("key")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(shard: dict) -> pd.DataFrame:
            words = [np.frombuffer(x, np.uint64) for x, _ in shard.values()]
            masks = matched(words, np.array([w for _, w in shard.values()], np.int64), window)
            out = [(*x, m) for x, m in zip(shard, masks, strict=True) if m]
            return pd.DataFrame(out, columns=["key", "content", "mask"])

        shard, size, last = {}, 0, None
        for batch in batches:
            for key, content, weight, words in batch.itertuples(index=False, name=None):
                if size >= SHARD_WORDS and key != last:
                    yield done(shard)
                    shard, size = {}, 0
                shard[key, content] = (words, weight)  # a repeated row brings its segments twice: once counts
                size += len(words) // 8
                last = key
        if shard:
            yield done(shard)

    found = dealt.mapInPandas(search, "key long, content long, mask long")
    if any_hot:
        found = stash(found, "found")
        of_hot = singles.select("key", F.col("kind").alias("content"), "anchor", F.col("content").alias("segment"), "offset")
        of_hot = of_hot.join(found, ["key", "content"]).groupBy("anchor", "segment").agg(F.bit_or(F.expr("shiftleft(mask, offset)")).alias("mask"))
        cold_found = found.withColumnRenamed("key", "anchor").join(hot, "anchor", "left_anti")
        found = cold_found.union(of_hot.select("anchor", "segment", "mask"))
    else:
        found = found.withColumnRenamed("key", "anchor")
    hits = parts.join(found, ["anchor", "content"]).groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "rest", "mask")).alias("x"))
    all_starts = F.transform("x", lambda h: F.concat(F.array(h["start"]), F.coalesce(h["rest"], F.array().cast("array<int>"))))
    hits = hits.select("doc", "mark", all_starts.alias("starts"), F.col("x.mask").alias("masks"))

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(texts: pd.Series, starts: pd.Series, masks: pd.Series) -> pd.DataFrame:
        out = []
        for text, start_, mask_ in zip(texts, starts, masks, strict=True):
            words = text.encode().split()
            kept, gone = words, 0
            if start_ is not None:
                edge = np.zeros(len(words) + 1, np.int64)
                for at, mask in zip(start_, mask_.tolist(), strict=True):
                    while mask:  # a run of windows at a time
                        low = (mask & -mask).bit_length() - 1
                        rest = (mask >> low) + 1
                        run = (rest & -rest).bit_length() - 1
                        np.add.at(edge, at + low, 1)
                        np.add.at(edge, at + low + run - 1 + window, -1)
                        mask &= ~(((1 << run) - 1) << low)
                covered = np.cumsum(edge[:-1]) > 0
                gone = int(covered.sum())
                kept = [words[k] for k in np.flatnonzero(~covered).tolist()]
            out.append((len(words), gone, b" ".join(kept).decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    whole_rows = rows.select("id", "doc", "mark", "text") if not extra else docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.struct(F.col(text_col).isNull().alias("__null"), *extra).alias("extra"),
    )
    out = whole_rows.join(hits, ["doc", "mark"], "left")
    return out.select("id", "text", *(["extra"] if extra else []), cut("text", "starts", "masks").alias("out"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with repeated passages removed from their texts; every row and column stays.

    A text without repeats is not touched, and one that is all repeats becomes empty; n_chars, where there is such a
    column, follows the text.
    """
    extra = tuple(c for c in docs.columns if c not in (id_col, text_col))
    out = repeats(docs, id_col, text_col, window, extra=extra)
    gone = F.col("out.n_removed") > 0
    text = F.when(gone, F.col("out.kept")).otherwise(F.when(~F.col("extra.__null"), F.col("text")))
    own = {id_col: F.col("id"), text_col: text} | {c: F.col("extra")[c] for c in extra}
    if "n_chars" in own:
        own["n_chars"] = F.when(gone, F.length("out.kept").cast("long")).otherwise(own["n_chars"])
    return out.select(*[own[c].alias(c) for c in docs.columns])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
