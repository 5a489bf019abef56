"""N-gram Jaccard join (operator 6).

Shingles are 64-bit hashes of runs of `words` words; their hash order is the global n-gram order, which is cut into
vertical fragments. Documents with equal sets collapse into one class first, so copies cost nothing later.

1. Candidates, without loss. Two sets with Jaccard t or more share one of their first n - ceil(t n) + 1 shingles in any
   common order. The order used here puts the low fragment first (rarest shingle first, by counts over all classes), then
   the others by hash; a class emits its low fragment and, where this is too short, as many more as its prefix needs. Only
   shingles of its prefix that two classes hold give candidates: the pairs where they are few, and otherwise a star around
   the class that has fewest shingles of its own, the likely source of the others, so a shingle of n classes gives n - 1
   rows, not n squared. What sizes and a bitmap rule out goes: each
   class has BITS parities of its shingles, and two sets differ at least in as many shingles as their parities.
2. Partial overlaps. The sets of the classes in pairs are cut into fragments; a pair's fragments meet by (class, fragment),
   each gives a partial overlap (a, b, count), and the counts are summed per pair: the links.
3. What the stars leave open. Classes that share a frequent shingle and are in one component by now need no further
   comparison. The others give the pairs across components that sizes and bitmaps allow, counted as in 2. Groups of equal
   members are joined once, and their rows are dealt to as many tasks as they need; only numbers and bitmaps are repeated.
4. Components of all links.

Keys with many rows (hubs) are cut into parts on joins, see common.spread_join.

Defined cases: a null or blank text has an empty set, links with nothing and is its own component; fewer words than a
shingle make one shingle of all of them; repeated rows are one class; a null identifier takes part in links and is never
the smallest of a component unless all are null; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, connected_components, gram_hashes, hubs, spread_join, stash, table

WORDS, NUM, DEN = 5, 80, 100
#: Share of the global order that the low fragment holds, and fragments into which sets are cut to be compared.
LOW, FRAGMENTS = 0.26, 8
#: Classes that share a shingle, up to which they are compared pair by pair, and rows of such a group in a part.
FEW, PART = 16, 2000
#: Parities of a set's bitmap; beyond twice as many shingles it rules out little.
BITS = 512
#: Bits of the filter that thins out the texts read again for comparison; beyond them it just lets more through.
FILTER_BITS = 1 << 20


def shingles(words: list[bytes], hashes: WordHashes, k: int) -> np.ndarray:
    """The sorted distinct shingles of a document."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(gram_hashes(hashes.of(words), k))


def parities(s: np.ndarray) -> np.ndarray:
    """For each of BITS classes of hashes, whether the set has an odd number of them; packed."""
    odd = np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes.lower changes A-Z only


def may_link(num: int, den: int) -> str:
    """Whether sizes (na, nb) and bitmaps (x, y) allow num/den: the sets differ in at most (den - num) / (den + num) of both."""
    differ = " + ".join(f"bit_count(x[{k}] ^ y[{k}])" for k in range(BITS // 64))
    return f"{den} * na >= {num} * nb and {den} * nb >= {num} * na and {den + num} * ({differ}) <= {den - num} * (na + nb)"


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN
) -> DataFrame:
    """id_col, n_shingles, component_id: components of links num/den or more of the union shared."""
    read, of = components(docs, id_col, text_col, words, num, den)
    out = read.select("id", "n", "sig").join(of.select("sig", F.col("first.id").alias("component_id")), "sig", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def components(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(id, mark, n, sig) of the rows, where mark is a hash of the text, and (sig, first) of the classes: the first
    (none, id, mark) of its component, null identifiers last."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    low_end = np.uint64(int(LOW * 2**64))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                n, sig, count, first, bits = [], [], [], [], []
                for text in part["text"]:
                    s = shingles(_words(text), hashes, words)
                    low = int(np.searchsorted(s, low_end))
                    prefix = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                    emit = s[: max(low, prefix)]
                    n.append(len(s))
                    sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    count.append(low)
                    first.append(emit.view(np.int64))
                    bits.append(parities(s))
                yield pd.DataFrame({"id": part["id"].astype("Int64").to_numpy(), "mark": part["mark"], "n": n, "sig": sig, "low": count, "first": first, "bits": bits})

    read = rows.mapInPandas(sets, "id long, mark long, n int, sig binary, low int, first array<long>, bits array<long>")
    # a stored number tells rows apart, also those that repeat an identifier or have none
    read = stash(read.withColumn("row", F.monotonically_increasing_id()), "sets")
    classes = read.where("sig is not null").groupBy("sig").agg(F.min("row").alias("rep"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first"))
    classes = stash(classes, "classes")
    reps = read.select("row", "n", "low", "first").join(classes.select(F.col("rep").alias("row")).hint("merge"), "row", "left_semi")
    grams = reps.select(F.col("row").alias("id"), "low", F.posexplode("first").alias("pos", "gram"))
    grams = grams.select("id", "gram", (F.col("pos") >= F.col("low")).alias("late"))
    # one exchange by shingle; a class holds each shingle once, so none of them has a great share of the rows
    shared = grams.withColumn("df", F.count("*").over(Window.partitionBy("gram"))).where("df > 1")
    shared = shared.join(read.select(F.col("row").alias("id"), "n", "low").hint("merge"), "id")
    # of a class's prefix, what is not shared cannot match but takes its places: all of it is rarer than what is shared
    of_class = Window.partitionBy("id")
    order = of_class.orderBy("late", F.when(F.col("late"), F.lit(0)).otherwise(F.col("df")), "gram")
    n_prefix = F.expr(f"n - cast(ceil({num} * n / {den}D) as int) + 1")
    alone_low = F.col("low") - F.count(F.when(~F.col("late"), 1)).over(of_class)
    shared = shared.select("id", "n", "gram", "late", "low", n_prefix.alias("p"), F.row_number().over(order).alias("k"), alone_low.alias("alone"))
    # late shingles are only sent as far as the prefix reaches, so each of them is in it
    own = F.when(F.col("low") > 0, F.col("alone") / F.col("low")).otherwise(1.0).cast("float")  # share of shingles that no other class has
    prefix = stash(shared.where("late or k + alone <= p").select("id", "n", "gram", own.alias("own")), "prefix")
    many = prefix.groupBy("gram").agg(F.min(F.struct("own", "id")).alias("best"), F.count("*").alias("n")).where("n > 1")
    many = stash(many.select("gram", F.col("best.id").alias("center"), "n"), "many")
    # a shingle of few classes gives their pairs, one of many a star that connects them
    few, stars = prefix.join(many.where(F.col("n") <= FEW).select("gram"), "gram"), many.where(F.col("n") > FEW)
    x, y = few.alias("x"), few.alias("y")
    fits = f"x.id < y.id and {den} * x.n >= {num} * y.n and {den} * y.n >= {num} * x.n"
    pairs = x.join(y, F.col("x.gram") == F.col("y.gram")).where(fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    members = stash(prefix.select("id", "gram").join(stars.select("gram", "center", F.col("n").alias("held")), "gram"), "members")
    pairs = stash(pairs.union(members.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b"))).distinct(), "pairs")
    facts = read.select("row", "n", "bits")
    links = overlaps(rows, read, possible(pairs, facts, num, den), words, num, den)
    linked = connected_components(links)
    # groups of a frequent shingle that are not in one component yet
    members = members.join(linked.withColumnRenamed("node", "id"), "id", "left").select("gram", "id", "held", F.coalesce("component", "id").alias("component"))
    members = stash(members, "members")
    groups = members.groupBy("gram", "held").agg(F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("h2"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    groups = stash(groups.where("lo < hi").groupBy("held", "h1", "h2").agg(F.min("gram").alias("gram")).select("gram"), "open")
    if not groups.isEmpty():
        left = members.join(groups, "gram").join(facts.select(F.col("row").alias("id"), "n", "bits"), "id")
        parts = F.ceil(F.col("held") / F.lit(PART)).cast("int")
        one = left.select("gram", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("bits").alias("x"))
        two = left.select("gram", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("bits").alias("y"))
        rest = one.join(two, ["gram", "part"]).where("a < b and ca <> cb").where(may_link(num, den)).select("a", "b", "na", "nb").distinct()
        linked = connected_components(links.union(overlaps(rows, read, stash(rest, "rest"), words, num, den)))

    of = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "first", F.coalesce("component", "rep").alias("component"))
    first = of.groupBy("component").agg(F.min("first").alias("first"))
    return read.select("id", "mark", "n", "sig"), of.drop("first").join(first, "component").select("sig", "first")


def possible(pairs: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, na, nb) of the pairs that sizes and bitmaps allow; facts: (row, n, bits)."""
    one, two = (facts.select(F.col("row").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(z)) for k, z in (("a", "x"), ("b", "y")))
    both = spread_join(spread_join(pairs, one, ["a"], hubs(pairs, "a")), two, ["b"], hubs(pairs, "b"))
    return stash(both.where(may_link(num, den)).select("a", "b", "na", "nb"), "possible")


def fragments(rows: DataFrame, read: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(row, fragment, grams) of the classes in needed (row): their texts are read again and cut."""
    wanted = read.select("row", "id", "mark", "sig").join(needed, "row")
    wanted = stash(wanted.select("row", F.col("id").alias("own"), F.col("mark").alias("hash"), "sig"), "wanted")
    bit = lambda *of: F.pmod(F.xxhash64(*of), F.lit(FILTER_BITS))
    mask = wanted.select(bit("own", "hash").alias("bit")).groupBy(F.shiftright("bit", 5).alias("word"))
    mask = mask.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("mask"))  # at most FILTER_BITS / 32 rows
    near = rows.withColumn("bit", bit("id", "mark")).withColumn("word", F.shiftright("bit", 5)).join(F.broadcast(mask), "word")
    near = near.where("(shiftright(mask, cast(bit & 31 as int)) & 1) = 1").select("id", "mark", "text")
    near = near.join(wanted, near["id"].eqNullSafe(wanted["own"]) & (near["mark"] == wanted["hash"])).select("row", "sig", "text")
    edges = np.array([k * 2**64 // FRAGMENTS for k in range(1, FRAGMENTS)], np.uint64)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for row, sig, text in batch.itertuples(index=False, name=None):
                s = shingles(_words(text), hashes, words)
                if xxhash.xxh3_128_digest(s.tobytes()) == sig:
                    out += [(row, k, x.view(np.int64)) for k, x in enumerate(np.split(s, np.searchsorted(s, edges))) if len(x)]
            yield pd.DataFrame(out, columns=["row", "fragment", "grams"])

    # rows that repeat identifier and text all come up
    return stash(near.mapInPandas(cut, "row long, fragment int, grams array<long>").dropDuplicates(["row", "fragment"]), "fragments")


def overlaps(rows: DataFrame, read: DataFrame, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The links (a, b) among pairs (a, b, na, nb), a stored table: partial overlaps by fragment, summed per pair."""
    cut = fragments(rows, read, pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), words)
    one = cut.select(F.col("row").alias("a"), "fragment", F.col("grams").alias("x"))
    two = cut.select(F.col("row").alias("b"), "fragment", F.col("grams").alias("y"))
    both = spread_join(spread_join(pairs, one, ["a"], hubs(pairs, "a")), two, ["b", "fragment"], hubs(pairs, "b"))
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("shared"))
    sums = partial.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    return stash(sums.where(f"{den + num} * shared >= {num} * (na + nb)").select("a", "b"), "links")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest identifier, null last, and of its texts the one of the
    smallest hash. Rows without shingles are their own components and stay."""
    read, of = components(docs, id_col, text_col, WORDS, NUM, DEN)
    read = read.where("sig is not null")
    own = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    gone = read.join(of, "sig").where(own != F.col("first")).select(F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark"))
    key, mark = docs[id_col].cast("long"), F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    left = docs.join(gone, key.eqNullSafe(gone["gone_id"]) & (mark == gone["gone_mark"]), "left_anti")
    # rows equal in identifier and text have one key; only where there are any are the texts dealt out for them
    if not read.groupBy("id", "mark").count().where("count > 1").isEmpty():
        blank = F.coalesce(docs[text_col], F.lit("")).rlike(r"\A[\x20\x09-\x0D]*\z")
        nth = F.row_number().over(Window.partitionBy(key, mark).orderBy(F.lit(1)))
        left = left.select("*", (blank | (nth == 1)).alias("__stays")).where("__stays")
    return left.select(*docs.columns)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
