"""Chat formatting (operator 2).

Budgeted windows: turns are rendered by a template and counted in tokens; prefix sums of these along a conversation cut
it into turn-aligned spans. Every window opens with the system turn and repeats as many of the turns before its span as
fit `history` tokens; the loss mask covers the assistant turns of the span only, so each is a target exactly once.

A span may hold what `budget` leaves beside the system turn and the history. Spans come from prefix sums alone: turns
that lie within the same stretch of that length share a window, and a turn across the end of one joins it if it fits and
else opens a window of its own. So no conversation has to be walked through in one task: rows are dealt out by range,
sums over (conversation, range) are added up, and history is an equi-join on stretches.

Control strings inside texts get a backslash after their first character, and backslashes are doubled; `unescape` undoes
both.

Defined cases: a null text or role is empty; turns follow (turn, role, text) with null turns first; repeated rows are
turns of their own; rows with a null conv_id make one conversation; a turn longer than the budget keeps its text whole
and exceeds it; only a leading turn of the role `system` counts as one, and not where it is all there is; a system turn
that would take more than half of the place of new turns cannot be retained within the budget: it is a turn like others,
in the first window only; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stash, table

#: The control strings of this template and of others in use.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
START, END = "<|im_start|>", "<|im_end|>\n"
BUDGET, HISTORY = 1024, 256


def escape(text: Column) -> Column:
    rest = "|".join(re.escape(c[1:]) for c in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[])(?={rest})", r"$1\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


@lru_cache(1)
def counter_of(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_counts(tokenizer: str):
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(x) for x in counter_of(tokenizer).encode_batch_fast(texts.tolist(), add_special_tokens=False)], dtype="int64")

    return count


def format_windows(turns: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window (ascending), text, n_repeated (leading turns that an earlier window had), n_turns, loss: spans
    (start, length) in characters of text."""
    spark = turns.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.repartitionByRange(partitions(spark), "conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.select("conv_id", "role", F.length(head).alias("head"), F.concat(head, escape(F.col("text")), F.lit(END)).alias("shown"))
    # stored, so that places do not change when a task runs again
    rows = rows.select("conv_id", "role", "head", "shown", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("seq"))
    rows = stash(rows.withColumn("tokens", token_counts(tokenizer)("shown")), "turns")

    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv")  # joins need no null
    rows = rows.select("*", key)
    sums = rows.groupBy("conv", "range").agg(F.sum("tokens").alias("sum"), F.count("*").alias("n"), F.min(F.struct("seq", "role", "tokens", "shown", "head")).alias("first"))
    convs = sums.groupBy("conv").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    is_system = (F.col("first.role") == "system") & (F.col("n") > 1) & (2 * F.col("first.tokens") <= budget - history)
    convs = convs.select("conv", F.when(is_system, F.col("first.seq")).alias("system_seq"), F.when(is_system, F.col("first.tokens")).otherwise(0).alias("system_tokens"))
    before = Window.partitionBy("conv").orderBy("range")  # as many rows as ranges hold the conversation
    base = sums.select("conv", "range", (F.sum("sum").over(before) - F.col("sum")).alias("base"))
    rows = rows.join(base, ["conv", "range"]).join(convs, "conv")
    within = Window.partitionBy("conv", "range").orderBy("seq")
    rows = rows.withColumn("end", F.col("base") + F.sum("tokens").over(within) - F.col("system_tokens"))
    rows = rows.withColumn("start", F.col("end") - F.col("tokens"))
    room = F.greatest(F.lit(budget - history) - F.col("system_tokens"), F.lit(1))
    rows = rows.withColumn("is_system", F.coalesce(F.col("seq") == F.col("system_seq"), F.lit(False)))
    rows = rows.withColumn("room", room).withColumn("stretch", F.floor(F.col("start") / F.col("room")))
    across = F.floor((F.col("end") - 1) / F.col("room")) > F.col("stretch")
    opens = F.min("start").over(Window.partitionBy("conv", "is_system", "stretch"))
    own = across & (F.col("end") - opens > F.col("room"))
    rows = rows.withColumn("window", 2 * F.col("stretch") + own.cast("long"))
    keep = ["conv", "conv_id", "window", "seq", "role", "head", "shown", "start", "end", "is_system"]
    rows = stash(rows.select(*keep), "spans")

    new = rows.where("not is_system")
    windows = new.groupBy("conv", "window").agg(F.min("start").alias("from"))
    first = windows.groupBy("conv").agg(F.min("window").alias("first_window"))
    # history: turns that start within `history` tokens before the window; two stretches of that length cover them
    hist = windows.withColumn("near", F.explode(F.array_distinct(F.array(F.floor((F.col("from") - 1) / history), F.floor((F.col("from") - history) / history)))))
    old = new.withColumn("near", F.floor(F.col("start") / history)).withColumnRenamed("window", "old_window")
    hist = old.join(hist, ["conv", "near"]).where("start < from and start >= from - {}".format(history)) if history else old.withColumn("from", F.lit(0)).withColumn("window", F.lit(0)).where("false")
    system = windows.join(first, "conv").join(rows.where("is_system").drop("window"), "conv")
    part = lambda df, again: df.select("conv", "conv_id", "window", F.struct("seq", again.alias("again"), "role", "head", "shown").alias("t"))
    parts = part(new, F.lit(False)).union(part(hist, F.lit(True))).union(part(system, F.col("window") != F.col("first_window")))
    out = parts.groupBy("conv", "conv_id", "window").agg(F.array_sort(F.collect_list("t")).alias("t"))  # bounded by the budget
    sizes = F.transform("t", lambda x: F.length(x["shown"]))
    target = lambda x: (x["role"] == "assistant") & ~x["again"]
    begin = lambda i: F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, x: a + x)
    out = out.withColumn("sizes", sizes)
    spans = F.transform("t", lambda x, i: F.when(target(x), F.struct((begin(i) + x["head"]).alias("start"), (F.length(x["shown"]) - x["head"] - len(END)).alias("length"))))
    return out.select(
        "conv_id",
        "window",
        F.array_join(F.transform("t", lambda x: x["shown"]), "").alias("text"),
        F.size(F.filter("t", lambda x: x["again"])).alias("n_repeated"),
        F.size("t").alias("n_turns"),
        F.filter(spans, lambda x: x.isNotNull()).alias("loss"),
    )


TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.S)


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: what the windows hold, each turn once.

    Digests are fed window by window in order, so no conversation is held whole.
    """
    spark = windows.sparkSession

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = object()
        at, n, turns, loss_chars, loss, chars = none, 0, None, 0, None, 0
        row = lambda: (None if at is pd.NA else at, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
        for batch in batches:
            out = []
            for key, text, again, spans in zip(batch["conv_id"].astype("Int64"), batch["text"], batch["n_repeated"], batch["loss"], strict=True):
                if at is none or key is not at and (key is pd.NA or at is pd.NA or key != at):
                    if at is not none:
                        out.append(row())
                    at, n, turns, loss_chars, loss, chars = key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                for role, body in TURN.findall(text)[again:]:
                    n += 1
                    turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                for x in spans:
                    target = unescape(text[x["start"] : x["start"] + x["length"]])
                    loss_chars += len(target)
                    loss.update(target.encode())
                chars += len(text)
            yield frame(out)
        if at is not none:
            yield frame([row()])

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
    dealt = windows.select("conv_id", "window", "text", "n_repeated", "loss").repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_back(format_windows(turns.unionByName(more), public_tokenizers.path("byte_bpe_50k.json")))
