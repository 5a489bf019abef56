"""Best-fit packing (operator 7).

Documents are tokenised word by word (a word is encoded once a worker and remembered), cut into pieces, and packed by
size alone: the histogram of piece lengths has at most `capacity` entries whatever the input, so the packing is planned
on it exactly as if every piece were looked at one by one, pattern by pattern, and each piece then finds its sequence
from its rank among the pieces of its length.

The plan is best-two-fit: a bin is filled greedily, the largest length that fits first; then its smallest piece is
replaced by two unpacked pieces where they fit the gap that opens more tightly. A pattern is repeated as often as the
counts allow.

Defined cases: a null text is empty and has one piece, the end mark; repeated rows are packed each; null identifiers are
kept; a very long text is cut into pieces of which only the first can be short; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import stash, table

CAPACITY, END = 1024, 2
PIECES = "id long, piece int, start long, length long, ids_crc32 long"


#: Fixed value: the pre-token pattern of byte-level vocabularies.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beside a space: there, cuts need a closer look.
ADJACENT = re.compile(r" \s|\s ")


class WordEncoder(dict):
    """Bytes of the token ids (little-endian, 32 bits) of text between safe cuts, remembered up to a bound.

    A single space between two characters that are not white space always starts a new pre-token of this vocabulary, so
    what stands between two such spaces is encoded alike wherever it stands.
    """

    most = 250_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.quick = ranked(path)

    def raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        # both libraries agree on Latin text; anything newer in Unicode, and control strings, are left to the first
        if self.quick and max(word, default="") < "\u0250" and "<|" not in word:
            ids = self.quick.encode_ordinary(word)
            value = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        else:
            value = self[word] = self.raw(word)
        return value

    def ids(self, text: str) -> bytes:
        if len(self) > self.most:
            self.clear()
        return b"".join(map(self.__getitem__, self.words(text)))

    def words(self, text: str) -> list[str]:
        """Every word but the first carries its space; words that touch other white space stay with their neighbour."""
        words = text.split(" ")
        if text[:1] == " " or text[-1:] == " " or ADJACENT.search(text):
            return self.glued(words)
        words[1:] = [" " + x for x in words[1:]]
        return words

    @staticmethod
    def glued(words: list[str]) -> list[str]:
        out = [words[0]]
        for word in words[1:]:
            last = out[-1]
            if word and last and not word[0].isspace() and not last[-1].isspace():
                out.append(" " + word)
            else:
                out[-1] = f"{last} {word}"
        return out


def ranked(path: str):
    """The same vocabulary in a library that encodes short words faster, or None where merge order is not id order."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
    if any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    # the letters that byte-level vocabularies write bytes with
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(letters[c] for c in token): k for token, k in vocab.items() if all(c in letters for c in token)}
    return tiktoken.Encoding("ranked", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merges) else None


@lru_cache(1)
def encoder_of(path: str) -> WordEncoder:
    """One for a worker process, which serves task after task."""
    return WordEncoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of each document: id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, mark = encoder_of(tokenizer), np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"].astype("Int64"), batch["text"], strict=True):
                ids = encoder.ids(text) + mark
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((key, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"id": "Int64"})

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-two-fit over a histogram: (lengths in a bin, number of such bins)."""
    left = {k: v for k, v in counts.items() if v > 0}
    sizes = sorted(left)
    out = []

    def largest(room: int, taken: dict[int, int]) -> int | None:
        k = bisect_right(sizes, room)
        while k and left[sizes[k - 1]] <= taken.get(sizes[k - 1], 0):
            k -= 1
        return sizes[k - 1] if k else None

    while sizes:
        bin_, taken, room = [], {}, capacity
        while room and (size := largest(room, taken)) is not None:
            bin_.append(size)
            taken[size] = taken.get(size, 0) + 1
            room -= size
        if room and len(bin_) > 1:
            gap, best, pair = room + bin_[-1], bin_[-1], None
            free = {x: left[x] - taken.get(x, 0) for x in sizes if x < gap and left[x] > taken.get(x, 0)}
            small = sorted(free)
            for a in small:
                k = bisect_right(small, min(gap - a, a)) - 1
                if k >= 0 and small[k] == a and free[a] < 2:
                    k -= 1
                if k >= 0 and a + small[k] > best:
                    best, pair = a + small[k], (a, small[k])
            if pair:
                bin_[-1:] = pair
        need = {x: bin_.count(x) for x in bin_}
        times = min(left[x] // n for x, n in need.items())
        out.append((bin_, times))
        for x, n in need.items():
            left[x] -= n * times
        sizes = [x for x in sizes if left[x]]
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, chunks: int = 64) -> DataFrame:
    """pieces (with a column length, 1 to capacity) plus sequence_id and offset. pieces must be stored, not computed anew."""
    ranked = pieces.withColumn("chunk", F.pmod(F.xxhash64("id", "piece"), F.lit(chunks)))
    sums = ranked.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    # at most capacity x chunks rows from here, whatever the input
    base = sums.select("length", "chunk", (F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("base"))
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int]]] = {}  # of a length: rank from which on, first sequence, offset
    given, first = dict.fromkeys(counts, 0), 0
    for bin_, times in plan(counts, capacity):
        offset = 0
        for size in bin_:
            slots.setdefault(size, []).append((given[size], first, offset))
            given[size] += times
            offset += size
        first += times
    tables = {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in slots.items()}
    within = Window.partitionBy("length", "chunk").orderBy("id", "piece")
    ranked = ranked.join(F.broadcast(base), ["length", "chunk"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1).drop("base", "chunk")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for size in np.unique(n):
            at = n == size
            start, first, offset = tables[int(size)]
            k = np.searchsorted(start, r[at], side="right") - 1
            seq[at], off[at] = first[k] + r[at] - start[k], offset[k]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return ranked.withColumn("at", place("length", "rank")).select(*pieces.columns, "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    pieces = stash(token_pieces(docs, tokenizer, id_col, text_col), "pieces")
    return pack(pieces).withColumnRenamed("id", id_col)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
