"""Document fingerprints (operator 10), native.

A text's paragraphs are its lines, cut further every `SLICE` characters; each has a digest of 40 hash bits and 24 bits
that check them. An invertible Bloom lookup sketch holds the distinct digests in four rows of cells: a digest adds one
to the count of its cell in each row and is xored into the cell's sum. The fingerprint is the text of these cells, so equal texts have equal
fingerprints. The sketches of two versions subtract cell by cell: what they share cancels, and peeling (a cell that holds
exactly one digest gives it away and releases its other cells) recovers the digests that differ. Where peeling gets
stuck, it is tried again on a larger sketch, made of as many sketches of the same size as the digests need, each for one
hash class of them; a class that gets stuck is tried again on four.

Likeness is shared digests over all digests of both, (a + b - d) / (a + b + d) for a and b digests of which d differ.

All of it is expressions on the row, with no Python, and the only shuffles are by document.

Defined cases: a null text is empty; the empty text has no digests and an empty sketch; two empty texts have likeness 1;
repeated paragraphs count once; after the last identifier comes the first; rows that repeat an identifier follow one
another's text as one document (the next is the next other identifier, its smallest text); a null identifier comes
before all others; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stash, table

#: Rows of a sketch and cells in each (a prime), characters in a paragraph's slice, rounds of peeling in one try.
ROWS, CELLS, SLICE, ROUNDS = 4, 7, 160, 12


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    cut = lambda line: F.transform(
        F.sequence(F.lit(0), F.floor((F.length(line) - 1) / SLICE).cast("int")), lambda i: F.substring(line, i * SLICE + 1, F.lit(SLICE))
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    hashed = F.transform(F.flatten(F.transform(lines, cut)), lambda p: F.shiftright(F.xxhash64(p), 24))
    return F.array_distinct(F.transform(hashed, lambda h: F.shiftleft(h, 24).bitwiseOR(F.xxhash64(h).bitwiseAND(0xFFFFFF))))


# What follows writes SQL expressions as text: names are columns or lambda variables.


def let(value: str, name: str, body: str) -> str:
    """body with the value computed once under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def cell_of(key: str, row: int) -> str:
    """The cell of a digest in one of the rows; cells are numbered through all of them."""
    return f"{row * CELLS}L + pmod(shiftrightunsigned({key}, {24 + 10 * row}), {CELLS}L)"


def holds_one(cell: str) -> str:
    """Whether a cell is left with one digest: its check bits are those of its hash bits."""
    return f"(abs({cell}.n) = 1 and (xxhash64(shiftright({cell}.key, 24)) & 16777215L) = ({cell}.key & 16777215L))"


def sketch(keys: str) -> str:
    """Cells (n, key) of a set of digests."""
    cells = []
    for i in range(ROWS * CELLS):
        own = f"filter({keys}, k -> {cell_of('k', i // CELLS)} = {i}L)"
        cells.append(let(own, "o", "named_struct('n', size(o), 'key', aggregate(o, 0L, (x, k) -> x ^ k))"))
    return "array(" + ", ".join(cells) + ")"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'key', x.key ^ y.key))"


def difference(cells: str) -> str:
    """Number of digests that differ, by peeling a difference of sketches; null where it got stuck."""
    given = f"array_distinct(transform(filter(s.cells, c -> {holds_one('c')}), c -> named_struct('n', c.n, 'key', c.key)))"
    places = "array(" + ", ".join(cell_of("p.key", r) for r in range(ROWS)) + ")"
    less = f"transform(cs, (c, i) -> if({' or '.join(f'i = w[{r}]' for r in range(ROWS))}, named_struct('n', c.n - p.n, 'key', c.key ^ p.key), c))"
    taken = f"aggregate(g, s.cells, (cs, p) -> {let(places, 'w', less)})"
    one_round = let(given, "g", f"named_struct('cells', if(size(g) = 0, s.cells, {taken}), 'found', s.found + size(g), 'more', size(g) > 0)")
    rounds = "array(" + ", ".join(map(str, range(ROUNDS))) + ")"
    peeled = f"aggregate({rounds}, named_struct('cells', {cells}, 'found', 0, 'more', true), (s, r) -> if(s.more, {one_round}, s))"
    return let(peeled, "e", "if(exists(e.cells, c -> c.n <> 0 or c.key <> 0), null, cast(e.found as bigint))")


def exactly(a: str, b: str) -> str:
    """The last resort after all tries, which chance makes rare: the digests themselves."""
    return f"cast(size(array_except({a}, {b})) + size(array_except({b}, {a})) as bigint)"


def larger(a: str, b: str) -> str:
    """difference() over the pairs of sketches of as many hash classes as the digests need. A class that gets stuck is
    tried again on four.

    Digests are split in two steps, so that the work grows as n times the root of the number of classes.
    """
    part = lambda s, seed, steps, c: f"named_struct('a', filter({s}.a, k -> pmod(xxhash64(k, {seed}), {steps}) = {c}), 'b', filter({s}.b, k -> pmod(xxhash64(k, {seed}), {steps}) = {c}))"
    one = lambda s: difference(subtract(sketch(f"{s}.a"), sketch(f"{s}.b")))
    quarter = let(part("v", 4, "4L", "h"), "z", f"coalesce({one('z')}, {exactly('z.a', 'z.b')})")
    again = f"aggregate(sequence(0L, 3L), 0L, (l, h) -> l + {quarter})"
    # a try is evaluated only where the one before it got stuck
    of_class = let(part("u", 3, "q.steps", "j"), "v", f"coalesce({one('v')}, {again})")
    fine = let(part("q", 2, "q.steps", "i"), "u", f"aggregate(sequence(0L, q.steps - 1L), 0L, (m, j) -> m + {of_class})")
    whole = f"aggregate(sequence(0L, q.steps - 1L), 0L, (n, i) -> n + {fine})"
    steps = f"cast(ceil(sqrt(greatest(2, ceil((size({a}) + size({b})) / {2 * CELLS})))) as bigint)"
    return let(f"named_struct('a', {a}, 'b', {b}, 'steps', {steps})", "q", whole)


def written(cells: str) -> str:
    """A sketch as text: base64 of two bytes for the count and eight for the sum of each cell."""
    cell = "concat(lpad(hex(c.n), 4, '0'), lpad(hex(c.key), 16, '0'))"
    return f"base64(unhex(array_join(transform({cells}, c -> {cell}), '')))"


def likeness(a: str, b: str) -> Column:
    """Of the digests in columns a and b, whose sketches are in a_cells and b_cells."""
    d = f"coalesce({difference(subtract(f'{a}_cells', f'{b}_cells'))}, {larger(a, b)})"
    n = f"(size({a}) + size({b}))"
    return F.expr(f"if({n} = 0, 1D, {let(d, 'd', f'cast({n} - d as double) / ({n} + d)')})")


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc, known, to, to_known): each distinct identifier and the next one; the last points to the first."""
    spark = docs.sparkSession
    ids = docs.select("doc", "known").distinct()
    ids = ids.repartitionByRange(partitions(spark), "known", "doc").select("doc", "known", F.spark_partition_id().alias("range"))
    ids = stash(ids, "ids")
    order = Window.partitionBy("range").orderBy("known", "doc")
    inner = ids.withColumn("to", F.lead(F.struct("known", "doc")).over(order))
    # one row a range goes into the window without a key: a few, whatever the number of documents
    heads = ids.groupBy("range").agg(F.min(F.struct("known", "doc")).alias("head"))
    all_ = Window.partitionBy(F.lit(0)).orderBy("range")
    whole = all_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("range", F.coalesce(F.lead("head").over(all_), F.first("head").over(whole)).alias("after"))
    out = inner.join(F.broadcast(heads), "range").select("doc", "known", F.coalesce("to", "after").alias("to"))
    return out.select("doc", "known", F.col("to.doc").alias("to_doc"), F.col("to.known").alias("to_known"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, of the text and its edited
    version: the last quarter of its characters replaced by the first as many of the next document."""
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(0)).alias("doc"), F.col(id_col).isNotNull().alias("known"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    nexts = stash(next_ids(rows), "nexts")
    keyed = rows.repartition(partitions(docs.sparkSession), "doc", "known")
    # how much of a text its predecessors need, and that much of it, sent to each of them
    most = rows.groupBy("doc", "known").agg(F.max(F.length("text")).alias("n"))
    wanted = nexts.join(most, ["doc", "known"]).select(F.col("to_doc").alias("doc"), F.col("to_known").alias("known"), F.floor(F.col("n") / 4).cast("int").alias("take"), F.col("doc").alias("from_doc"), F.col("known").alias("from_known"))
    smallest = Window.partitionBy("doc", "known").orderBy("text")
    firsts = keyed.withColumn("nth", F.row_number().over(smallest)).where("nth = 1").drop("nth")
    sent = firsts.join(wanted, ["doc", "known"]).select(
        F.col("from_doc").alias("doc"), F.col("from_known").alias("known"), F.expr("left(text, take)").alias("head"), digests(F.col("text")).alias("after")
    )
    out = keyed.join(sent, ["doc", "known"])
    quarter = "cast(floor(length(text) / 4) as int)"
    edited = F.expr(f"concat(left(text, length(text) - {quarter}), left(head, {quarter}))")
    out = out.select(F.when(F.col("known"), F.col("doc")).alias(id_col), "text", edited.alias("edited"), "after")
    # stored without the texts: from here on digests stand for them
    out = out.select(
        id_col,
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"),
        digests(F.col("edited")).alias("new"),
        "after",
    )
    out = stash(out, "digests")
    out = out.withColumns({f"{c}_cells": F.expr(sketch(c)) for c in ("own", "new", "after")})
    return out.select(
        id_col,
        "n_chars",
        "edited_sha256",
        F.expr(written("own_cells")).alias("fingerprint"),
        F.expr(written("new_cells")).alias("edited_fingerprint"),
        likeness("own", "new").alias("near_edited"),
        likeness("own", "after").alias("near_next"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
