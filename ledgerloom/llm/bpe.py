"""BPE encoding and decoding (operator 3).

Distinct-word table: Spark splits the texts at ASCII white space, at which this vocabulary always ends a word, so a word
is encoded alike wherever it stands. A block is a run of documents of one scan task, bounded by bytes; its documents become
arrays of positions in the sorted list of the block's distinct words. The lists are cut by a hash of the word into buckets,
so that equal words of all blocks meet; each distinct word of a bucket is encoded once, and its ids go back to every block
that has it, where the positions pick them. Words, ids and positions are shuffled packed: as one row a word they took over
4.5 times the input. A word comes at most once from a block, so a frequent word is no hot key.

Decoding joins ids with the vocabulary's id-to-piece table, whose size the vocabulary bounds: `decode_ids` as a Spark join
by rows of ids; the digests join the ids of a block's distinct words with the table within the block's task. Without a
decoder in the tokenizer file, pieces are joined by a space, and so are the words' decoded texts.

Both scans must cut the same blocks, so docs must be read from storage; a digest of its words comes with each block from
either scan, and blocks that differ raise.

Defined cases: a null or blank text has no ids, and its digests are of the empty string; repeated rows give repeated
results; null identifiers stay; extra columns are not read; one very long text is a block of its own.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, partitions, table

#: Bytes of the words of a block, distinct words encoded in one call, and documents whose positions are packed together.
BLOCK_BYTES, CALL, PACKED = 16_000_000, 10_000, 200


@lru_cache(2)
def tokenizer_of(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(2)
def piece_table(path: str) -> pd.DataFrame:
    """(token, piece) of the whole vocabulary."""
    vocabulary = tokenizer_of(path).get_vocab(with_added_tokens=True)
    return pd.DataFrame({"token": np.array(list(vocabulary.values()), np.int32), "piece": list(vocabulary)})


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def width(tokenizer: str) -> str:
    return "<u2" if tokenizer_of(tokenizer).get_vocab_size() < 65536 else "<u4"


def squeezed(numbers: np.ndarray, pack) -> bytes:
    """32-bit numbers, byte by byte in planes, of which the high ones are nearly empty."""
    return pack(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unsqueezed(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Block:
    """A run of documents: their words as positions in the list of its distinct words, sorted by bucket and word."""

    def __init__(self, number: int, buckets: int):
        self.id, self.buckets, self.bytes, self.keys, self.lists = (TaskContext.get().partitionId() << 32) + number, buckets, 0, [], []

    def add(self, batch: pa.RecordBatch, size: int) -> None:
        self.keys += batch.column(0).to_pylist()
        self.lists.append(batch.column(1))
        self.bytes += size

    def coded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], int]:
        """Positions of all words, how many each document has, the buckets of the distinct words, these, and their digest."""
        found = pa.concat_arrays([x.flatten() for x in self.lists]).dictionary_encode()
        words = found.dictionary.cast(pa.binary())
        bucket = pa.array([xxhash.xxh3_64_intdigest(w) % self.buckets for w in words.to_pylist()], pa.int32())
        order = pc.sort_indices(pa.table({"bucket": bucket, "word": words}), [("bucket", "ascending"), ("word", "ascending")])
        place = np.empty(len(words), np.uint32)
        place[order.to_numpy()] = np.arange(len(words), dtype=np.uint32)
        sorted_words = words.take(order).to_pylist()
        lengths = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in self.lists])
        return place[found.indices.to_numpy()], lengths, bucket.take(order).to_numpy(), sorted_words, xxhash.xxh3_64_intdigest(b" ".join(sorted_words)) >> 1


def blocks(batches: Iterator[pa.RecordBatch], most: int, buckets: int) -> Iterator[Block]:
    """batches: (id, list of words)."""
    block = Block(0, buckets)
    for batch in batches:
        counts = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        chars = np.r_[0, np.cumsum(pc.binary_length(batch.column(1).flatten()).to_numpy(zero_copy_only=False).astype(np.int64))]
        # bytes of the rows up to each; a word's place has 4 bytes
        upto = np.r_[0, chars[np.cumsum(counts)] + 4 * np.cumsum(counts)] if len(counts) else np.zeros(1, np.int64)
        at = 0
        while at < len(counts):
            # as many rows as there is room for, at least one
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + most - block.bytes, "right")) - 1)
            block.add(batch.slice(at, end - at), int(upto[end] - upto[at]))
            at = end
            if block.bytes >= most or at < len(counts):
                yield block
                block = Block((block.id & 0xFFFFFFFF) + 1, buckets)
    if block.keys:
        yield block


def assembled(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, block_bytes: int, finish, schema: str) -> DataFrame:
    """finish(identifiers, places of each document's words, ids of all words in order of place, how many each has, tokenizer)
    gives the rows of a block's documents."""
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), words_of(F.col(text_col)).alias("list"))
    buckets = 4 * n

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for block in blocks(batches, block_bytes, buckets):
            _, _, bucket, words, check = block.coded()
            held, starts = np.unique(bucket, return_index=True)
            packed = [pack(b" ".join(words[a:b])) for a, b in itertools.pairwise([*starts.tolist(), len(words)])]
            yield pa.record_batch([pa.array([x] * len(held), pa.int64()) for x in (block.id, check)] + [pa.array(held, pa.int32()), pa.array(packed, pa.binary())], ["block", "check", "bucket", "packed"])

    def encode_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, kind = tokenizer_of(tokenizer), width(tokenizer)
        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        stream = (row for batch in batches for row in batch.itertuples(index=False, name=None))
        for bucket, same in itertools.groupby(stream, key=lambda r: r[2]):
            same = list(same)
            known = dict.fromkeys(w for r in same for w in unpack(r[3]).split(b" "))
            words = list(known)
            for at in range(0, len(words), CALL):
                part = words[at : at + CALL]
                for word, got in zip(part, own.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                    known[word] = np.array(got.ids, kind).tobytes()
            for block, check, _, packed in same:
                ids = [known[w] for w in unpack(packed).split(b" ")]
                sizes = np.fromiter(map(len, ids), np.uint32, len(ids)) // np.dtype(kind).itemsize
                yield pd.DataFrame({"block": [block], "check": [check], "bucket": [bucket], "sizes": [squeezed(sizes, pack)], "ids": [pack(b"".join(ids))]})

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for block in blocks(batches, block_bytes, buckets):
            places, lengths, bucket, words, check = block.coded()
            ends, out = np.r_[0, np.cumsum(lengths)], []
            for at in range(0, len(lengths), PACKED):
                part = lengths[at : at + PACKED]
                out.append((block.keys[at : at + PACKED], squeezed(part, pack), squeezed(places[ends[at] : ends[at + len(part)]], pack)))
            fixed = [pa.array([x] * len(out), pa.int64()) for x in (block.id, check, len(np.unique(bucket)))]
            kinds = (pa.list_(pa.int64()), pa.binary(), pa.binary())
            yield pa.record_batch(fixed + [pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["of_block", "check", "buckets", "keys", "lengths", "packed"])

    words = rows.mapInArrow(distinct_words, "block long, check long, bucket int, packed binary")
    words = words.repartition(n, "bucket").sortWithinPartitions("bucket")
    words = words.mapInPandas(encode_bucket, "block long, check long, bucket int, sizes binary, ids binary")
    places = rows.mapInArrow(positions, "of_block long, check long, buckets long, keys array<long>, lengths binary, packed binary")

    def join_back(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor().decompress
        if not len(left) or {*left["check"]} != {*left["check"], *right["check"]} or len(right) != left["buckets"].iloc[0]:
            raise ValueError("the two scans cut different blocks: write docs to storage first")
        right = right.sort_values("bucket")
        sizes = np.concatenate([np.empty(0, np.uint32), *(unsqueezed(unpack(x)) for x in right["sizes"])]).astype(np.int64)
        flat = np.frombuffer(b"".join([unpack(x) for x in right["ids"]]), width(tokenizer))
        keys, found = [], []
        for ids, lengths, packed in left[["keys", "lengths", "packed"]].itertuples(index=False, name=None):
            keys += [None if x is None or x != x else int(x) for x in ids]
            found += np.split(unsqueezed(unpack(packed)), np.cumsum(unsqueezed(unpack(lengths)))[:-1])
        return finish(pd.array(keys, "Int64"), found, flat, sizes, tokenizer)

    return places.groupBy("of_block").cogroup(words.groupBy("block")).applyInPandas(join_back, schema)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id_col and the ids of each document's whole text."""
    return assembled(docs, tokenizer, id_col, text_col, block_bytes, whole_ids, "id long, ids array<int>").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id_col, n_tokens, the digest of the ids, the digest of the text decoded from them."""
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return assembled(docs, tokenizer, id_col, text_col, block_bytes, block_digests, schema).withColumnRenamed("id", id_col)


def whole_ids(keys: pd.Series, found: list[np.ndarray], flat: np.ndarray, sizes: np.ndarray, tokenizer: str) -> pd.DataFrame:
    ids = [x.tobytes() for x in np.split(flat, np.cumsum(sizes)[:-1])] if len(sizes) else []
    return pd.DataFrame({"id": keys, "ids": [np.frombuffer(b"".join([ids[k] for k in x.tolist()]), flat.dtype).astype(np.int32) for x in found]})


def block_digests(keys: pd.Series, found: list[np.ndarray], flat: np.ndarray, sizes: np.ndarray, tokenizer: str) -> pd.DataFrame:
    tokens = pd.DataFrame({"token": flat.astype(np.int32)})
    parts = tokens.merge(piece_table(tokenizer), on="token", how="left")["piece"].tolist()
    names, ends = list(map(str, flat.tolist())), np.cumsum(sizes)
    ids_text, decoded = np.empty(len(sizes), object), np.empty(len(sizes), object)
    for k, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
        ids_text[k], decoded[k] = " ".join(names[a:b]), " ".join(parts[a:b])
    bare = not sizes.all()  # a word without ids leaves no space either
    sha = lambda texts, x: hashlib.sha256(" ".join(texts[x[sizes[x] > 0] if bare else x].tolist()).encode()).hexdigest()
    return pd.DataFrame({"id": keys, "n_tokens": [int(sizes[x].sum()) for x in found], "ids_sha256": [sha(ids_text, x) for x in found], "decoded_sha256": [sha(decoded, x) for x in found]})


def decode_ids(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded) of rows of ids, by a join with the id-to-piece table. The row of ids is the unit and must fit a task."""
    # numbered before rows are spread, so that rows with one identifier stay apart
    rows = encoded.select(F.col(id_col).alias("key"), F.col(ids_col).alias("ids")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "key", F.posexplode_outer("ids").alias("at", "token"))
    joined = rows.join(F.broadcast(encoded.sparkSession.createDataFrame(piece_table(tokenizer))), "token", "left").groupBy("row", "key")
    parts = joined.agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "piece")))).alias("parts"))
    return parts.select(F.col("key").alias(id_col), F.array_join(F.transform("parts", lambda x: x["piece"]), " ").alias("decoded"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
