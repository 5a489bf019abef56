"""Language ID (operator 4): a byte convolutional network.

Bytes are embedded; filters of several widths slide over fixed-length windows, the maximum of each filter over the window
is kept, and a softmax over these gives the window's language. The network is trained in numpy on the driver, on a bounded
sample of labelled documents; Spark then applies it to every window of every whole text in batches. A document's
probabilities are the mean over its windows, weighted by their bytes.

Bound of the sample: at most `per_language` documents of each of the `most_languages` commonest labels, chosen by a hash of
identifier and text, and of each of these `pieces` passages of `piece_chars` characters, spread evenly over the text. Rarer
labels than those are not learned.

Defined cases: a null text, or one without letters, is `und` with score 0; without any labelled text all are; repeated
rows are judged alike; a null identifier is not held out and stays; ties go to the first language in byte order; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import table

WINDOW, EMBED, WIDTHS, FILTERS = 192, 6, (2, 3, 4), 10
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def windows_of(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """The fixed-length windows of a text's bytes; the last is padded with zeros."""
    n = max(1, -(-len(raw) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, size)


class ByteCNN:
    def __init__(self, classes: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"E": rng.normal(0, 0.5, (256, EMBED))}
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["V"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes)))
        self.p["c"] = np.zeros(len(classes))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["E"][0] = 0

    def features(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """x: windows (n, WINDOW). What pooling keeps, and what training needs."""
        e, kept, memory = self.p["E"][x], [], {}
        for w in WIDTHS:
            span = x.shape[1] - w + 1
            cols = np.concatenate([e[:, i : i + span] for i in range(w)], axis=2)
            z = cols.reshape(-1, w * EMBED) @ self.p[f"W{w}"]
            z = z.reshape(len(x), span, FILTERS)
            memory[w] = (cols, z)
            kept.append(z.max(1) + self.p[f"b{w}"])
        return np.maximum(np.concatenate(kept, 1), 0), memory

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """The features alone: one product for all widths, and filters in rows, which makes pooling contiguous."""
        widest = max(WIDTHS)
        e = np.pad(self.p["E"][x], ((0, 0), (0, widest - 1), (0, 0))).reshape(len(x), -1)
        cols = np.lib.stride_tricks.sliding_window_view(e, widest * EMBED, axis=1)[:, ::EMBED]
        all_w = np.concatenate([np.pad(self.p[f"W{w}"], ((0, (widest - w) * EMBED), (0, 0))) for w in WIDTHS], axis=1)
        z = (all_w.T @ np.ascontiguousarray(cols).reshape(-1, widest * EMBED).T).reshape(-1, len(x), x.shape[1])
        kept = [z[k * FILTERS : (k + 1) * FILTERS, :, : x.shape[1] - w + 1].max(2).T + self.p[f"b{w}"] for k, w in enumerate(WIDTHS)]
        return np.maximum(np.concatenate(kept, 1), 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        logits = self.pooled(x) @ self.p["V"] + self.p["c"]
        logits = np.exp(logits - logits.max(1, keepdims=True))
        return logits / logits.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, least_steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        epochs = max(epochs, -(-least_steps * batch // len(x)))  # few windows are shown more often
        steps = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                xb, yb = x[order[at : at + batch]], y[order[at : at + batch]]
                grad = self.gradient(xb, yb)
                t += 1
                step = rate * (1 - t / (steps + 1))
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
                self.p["E"][0] = 0

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        f, memory = self.features(x)
        logits = f @ self.p["V"] + self.p["c"]
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(len(y)), y] -= 1
        d = prob / len(y)
        grad = {"V": f.T @ d, "c": d.sum(0), "E": np.zeros_like(self.p["E"])}
        df = (d @ self.p["V"].T) * (f > 0)
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            cols, z = memory[w]
            g, best = df[:, k * FILTERS : (k + 1) * FILTERS], z.argmax(1)
            chosen = cols[rows, best]  # (n, filters, w * EMBED)
            grad[f"W{w}"], grad[f"b{w}"] = np.einsum("ncd,nc->dc", chosen, g), g.sum(0)
            back = (g[:, :, None] * self.p[f"W{w}"].T[None]).reshape(len(x), FILTERS, w, EMBED)
            for i in range(w):
                np.add.at(grad["E"], x[rows, best + i], back[:, :, i])
        return grad


def sample(rows: DataFrame, id_col: str, text_col: str, lang_col: str, cuts: Column, per_language: int, most_languages: int) -> DataFrame:
    """lang, k (a hash of identifier and text) and cuts of at most per_language different rows of each of the
    most_languages commonest labels: neither a hot identifier nor copies take the others' places."""
    rows = rows.where(F.length(text_col) > 0).select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("k"), cuts.alias("cuts"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("k").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    # half more than is wanted, as the counts are estimates
    shares = [F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 1.5 * per_language / max(1, r["n"])))) for r in counts]
    chosen = rows.where(F.pmod("k", F.lit(1_000_003)) < F.coalesce(*shares, F.lit(0.0)) * 1_000_003)
    once = chosen.groupBy("lang", "k").agg(F.min("cuts").alias("cuts"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("k"))
    return once.withColumn("nth", nth).where(F.col("nth") <= per_language).drop("nth")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600, pieces: int = 4, piece_chars: int = 160, most_languages: int = 200) -> ByteCNN | None:
    """From the text and label of rows that are not held out: at most `pieces` passages of each of at most per_language
    documents of each of the most_languages commonest labels."""
    room = F.greatest(F.length(text_col) - piece_chars, F.lit(0))
    cuts = [F.substring(F.col(text_col), (F.lit(1) + F.floor(room * (k / max(1, pieces - 1)))).cast("int"), F.lit(piece_chars)) for k in range(pieces)]
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    got = sample(rows, id_col, text_col, lang_col, F.array_distinct(F.array(*cuts)), per_language, most_languages).collect()
    got = sorted(got, key=lambda r: (r["lang"], r["k"]))
    classes = sorted({r["lang"] for r in got})
    x, y = [], []
    for r in got:
        for piece in r["cuts"]:
            if LETTER.search(piece):
                x.append(windows_of(piece.encode()[:WINDOW])[0])
                y.append(classes.index(r["lang"]))
    if not x:
        return None
    model = ByteCNN(classes)
    model.fit(np.stack(x), np.array(y))
    return model


def judging(model: ByteCNN, batch: int = 256):
    @F.pandas_udf("lang string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            total = np.zeros((len(texts), len(model.classes)))
            raws = [(k, x.encode()) for k, x in enumerate(texts) if x is not None and LETTER.search(x)]
            held, owner, weight = [], [], []

            def flush() -> None:
                x, w, o = np.concatenate(held), np.concatenate(weight), np.concatenate(owner)
                for at in range(0, len(x), batch):
                    np.add.at(total, o[at : at + batch], model.probabilities(x[at : at + batch]) * w[at : at + batch, None])
                held.clear(), owner.clear(), weight.clear()

            waiting = 0
            for k, raw in raws:
                windows = windows_of(raw)
                w = np.full(len(windows), WINDOW, np.float64)
                w[-1] = len(raw) - WINDOW * (len(windows) - 1)
                held.append(windows), weight.append(w / len(raw)), owner.append(np.full(len(windows), k))
                waiting += len(windows)
                if waiting >= 16 * batch:
                    flush()
                    waiting = 0
            if held:
                flush()
            best = total.argmax(1) if len(total) else np.empty(0, int)
            known = total.sum(1) > 0
            lang = np.where(known, np.array(model.classes, object)[best], "und")
            score = np.clip(total[np.arange(len(total)), best], 0, 1)
            yield pd.DataFrame({"lang": lang, "score": np.where(known, score, 0.0)})

    return judge


def judge_beside(docs: DataFrame, model: ByteCNN | None, text_col: str = "text", name: str = "judged") -> DataFrame:
    """docs with a column `name` of (lang, score); without a model all are `und`."""
    ship(docs.sparkSession)
    none = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    return docs.withColumn(name, none if model is None else judging(model)(text_col))


def predict(docs: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred, score."""
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    out = judge_beside(rows, model, name="out")
    return out.select(F.col("id").alias(id_col), "held_out", F.col("out.lang").alias("lang_pred"), F.col("out.score").alias("score"))


def op4_lang_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
