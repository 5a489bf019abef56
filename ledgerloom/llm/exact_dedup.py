"""Exact dedup (operator 5), native.

Content sort: Spark samples splitters over the normalised bytes (their head, then a hash of all), deals the rows out by
range and sorts each range externally, which places equals next to each other. Every row is compared in full with its
neighbour; the first of a run of equals has the smallest identifier and is handed down the run, with the run's length.

A text that alone holds more than a range's quarter would make one task long. Such hot texts show in a sample of the rows
(at most four for each range, whatever the data), and only they get a salt behind their place in the order, so that
splitters may fall inside them. The runs into which a hot text falls are few; their first rows are sorted by content and
compared with their neighbours again. What the sample does not show stays whole; the result is the same either way.

Defined cases: a null text is the empty text; a null identifier sorts last, so it stays only where all are null; of rows
that repeat an identifier within a group one stays; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, partitions, stash, table

#: Sampled rows from which on a text counts as hot, of PER_RANGE for each range.
HOT, PER_RANGE = 100, 400


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def hot_texts(docs: DataFrame, text_col: str) -> DataFrame | None:
    """(hash, ways) of the texts that hold HOT or more rows of a sample; at most PER_RANGE / HOT for each range."""
    spark, total = docs.sparkSession, docs.count()
    if total < HOT:
        return None
    share = min(1.0, PER_RANGE * partitions(spark) / total)
    some = docs.select(text_col) if share == 1.0 else docs.select(text_col).sample(False, share, 17)
    seen = some.groupBy(F.xxhash64(normalised(F.col(text_col))).alias("hash")).agg(F.count("*").alias("n")).where(F.col("n") >= HOT)
    found = [(r["hash"], -(-r["n"] // HOT)) for r in seen.collect()]
    return spark.createDataFrame(found, "hash long, ways long") if found else None


def content_sort(docs: DataFrame, id_col: str, text_col: str, whole: bool = False) -> tuple[DataFrame, bool]:
    """Rows by content with head (smallest identifier), nth and size of their run; and whether some texts are salted.

    Columns: id, norm, hash, salt (null where the text is not hot), head, nth, size; with `whole` also row, the row itself.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    norm = normalised(text)
    rows = docs.select(
        F.col(id_col).alias("id"),
        # a short head and a hash of the text order as well as all of it, and splitters of them may go through the driver
        F.substring(norm, 1, 32).alias("start"),
        F.xxhash64(norm).alias("hash"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else [norm.alias("norm")]),
    )
    hot = hot_texts(docs, text_col)
    if hot is not None:
        rows = rows.join(F.broadcast(hot), "hash", "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("ways"))).drop("ways")
    else:
        rows = rows.withColumn("salt", F.lit(None).cast("long"))
    # a constant salt would be taken out of the window's keys but not of the ranges, which then would not serve it
    order = ["start", "hash"] if hot is None else ["start", "hash", "salt"]
    ranged = rows.repartitionByRange(max(partitions(spark), 1), *order)
    if whole:
        ranged = ranged.withColumn("norm", normalised(F.col("row")[text_col]))
    # the window needs equal rows together, which the ranges give: it adds the sort and no exchange
    run = Window.partitionBy(*order, "norm").orderBy(F.col("id").asc_nulls_last())
    all_of = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ranged.withColumns({"head": F.first("id").over(run), "nth": F.row_number().over(run), "size": F.count("*").over(all_of)}), hot is not None


def hot_runs(first: DataFrame) -> DataFrame:
    """first rows of salted runs (hash, salt, norm, head, size) with keep_id, group_size and best (this run's head stays)."""
    equal = Window.partitionBy("hash", "norm").orderBy(F.col("head").asc_nulls_last(), "salt")
    all_of = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return first.withColumns({"keep_id": F.first("head").over(equal), "group_size": F.sum("size").over(all_of), "best": F.row_number().over(equal) == 1})


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. The first column has the name id_col."""
    rows, salted = content_sort(docs, id_col, text_col)
    first = F.col("nth") == 1
    out = rows.select("id", "hash", "salt", F.sha2("norm", 256).alias("sha"), "head", "nth", "size", F.when(first & F.col("salt").isNotNull(), F.col("norm")).alias("norm"))
    if salted:
        out = stash(out, "runs")
        # as many rows as there are hot texts and ranges
        runs = hot_runs(out.where("norm is not null")).select("hash", "salt", "sha", "keep_id", "group_size", "best", F.lit(True).alias("hot"))
        out = out.join(F.broadcast(runs), ["hash", "salt", "sha"], "left")
        keep_id, size = F.when(F.col("hot"), F.col("keep_id")).otherwise(F.col("head")), F.coalesce("group_size", "size")
        kept = first & F.coalesce("best", F.lit(True))
    else:
        keep_id, size, kept = F.col("head"), F.col("size"), first
    return out.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates does not keep; all columns stay. Whole rows are dealt out once."""
    rows, salted = content_sort(docs, id_col, text_col, whole=True)
    heads = rows.where("nth = 1")
    if salted:
        heads = stash(heads.select("row", "hash", "salt", "head", "size", F.when(F.col("salt").isNotNull(), F.col("norm")).alias("norm")), "heads")
        best = hot_runs(heads.where("salt is not null")).where("best").select("row")
        heads = heads.where("salt is null").select("row").union(best)
    return heads.select("row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
