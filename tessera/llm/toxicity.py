"""Toxicity by a convolutional text classifier in numpy.

Words (runs of letters and digits, lowered) are embedded by hash: the sum of a vector for the whole
word and one for its first bytes, which words of one family share. Filters of several widths run over
the words, pass a rectifier and are pooled by their maximum over the whole text; a logistic layer on
top gives the probability. Training is by Adam on a bounded sample; only the words at a filter's
maximum get gradients.

Thresholds are calibrated by language: on a part of the sample that is kept out of training, each
language gets the threshold with the best F1, and scores are bent so that it falls on 0.7. The
language of a text to be scored is guessed from its words alone (hashed naive Bayes, learned from the
same sample), so nothing but the text goes into a score.

The sample: of each label the `most_rows` rows whose ids hash smallest, texts of up to `most_bytes`
bytes. Texts to be scored are read whole.

Defined results: null and empty texts, and texts without words, score what the bias alone gives; rows
without a label, a text or an id teach nothing; with one label only (or none) every text scores that
label's share; null ids and repeated rows each give a row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, byte_buffers, give_back, held_out, lower_ascii, segment_hashes, ship_code, text_or_empty, words_of

Batches = Iterator[pa.RecordBatch]
BUCKETS = 1 << 15
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
PREFIX = 5
MOST_ROWS = 3000
MOST_BYTES = 1 << 16
EPOCHS = 8
THRESHOLD = 0.7

#: Bytes of words: ASCII letters and digits, and all of other characters.
_SPACE = np.ones(256, bool)
_SPACE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words and of their first bytes, and the first word of each text and the end."""
    low = lower_ascii(raw)
    if len(low):
        latin = np.append(False, low[:-1] == 0xC3) & (low >= 0x80) & (low <= 0x9E) & (low != 0x97)
        low = low + (latin.astype(np.uint8) << 5)
    starts, ends, first = words_of(low, offsets, _SPACE[low])
    whole = segment_hashes(low, starts, ends)
    head = segment_hashes(low, starts, np.minimum(ends, starts + PREFIX))
    return (whole % np.uint64(BUCKETS)).astype(np.int32), (head % np.uint64(BUCKETS)).astype(np.int32), first


@dataclass
class Model:
    whole: np.ndarray
    head: np.ndarray
    filters: list[np.ndarray]
    top: np.ndarray
    bias: float
    languages: np.ndarray | None = None
    names: list[str] = field(default_factory=list)
    thresholds: np.ndarray | None = None
    tables: tuple[np.ndarray, np.ndarray] | None = None

    def project(self):
        """Filters applied to every bucket's vector beforehand: convolution becomes a sum of rows."""
        weights = np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)
        self.tables = (self.whole @ weights).astype(np.float32), (self.head @ weights).astype(np.float32)

    def probabilities(self, whole: np.ndarray, head: np.ndarray, first: np.ndarray) -> np.ndarray:
        rows = len(first) - 1
        counts = np.diff(first)
        full = counts > 0
        pooled = np.zeros((rows, len(WIDTHS) * FILTERS), np.float32)
        if full.any():
            x = self.tables[0][whole]
            x += self.tables[1][head]
            left = np.repeat(first[1:], counts) - np.arange(len(whole))
            at = 0
            for k, width in enumerate(WIDTHS):
                y = x[:, at : at + FILTERS].copy()
                for j in range(1, width):
                    y[:-j] += x[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
                y[left < width] = 0
                pooled[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(y, first[:-1][full], axis=0)
                at += width * FILTERS
        np.maximum(pooled, 0, out=pooled)
        return 1 / (1 + np.exp(-np.clip(pooled @ self.top + self.bias, -30, 30)))

    def guess(self, whole: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The likeliest language of each text, as an index."""
        rows = len(first) - 1
        total = np.zeros((rows, len(self.names)), np.float64)
        full = np.diff(first) > 0
        if full.any():
            total[full] = np.add.reduceat(self.languages[whole], first[:-1][full], axis=0)
        return total.argmax(axis=1)

    def score(self, whole: np.ndarray, head: np.ndarray, first: np.ndarray) -> np.ndarray:
        p = self.probabilities(whole, head, first)
        t = self.thresholds[self.guess(whole, first)]
        return np.where(p < t, THRESHOLD * p / t, THRESHOLD + (1 - THRESHOLD) * (p - t) / (1 - t))


def fit(whole: list[np.ndarray], head: list[np.ndarray], labels: np.ndarray, epochs: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32),
        rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32),
        [rng.normal(0, (2 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
        0.0,
    )
    parameters = [model.whole, model.head, *model.filters, model.top]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    bias = np.zeros(1, np.float32)
    bias_moments = (np.zeros(1, np.float32), np.zeros(1, np.float32))
    step = 0

    def adam(p, g, m, at=slice(None), rate=0.01):
        m[0][at] = 0.9 * m[0][at] + 0.1 * g
        m[1][at] = 0.99 * m[1][at] + 0.01 * g * g
        p[at] -= rate * (m[0][at] / (1 - 0.9**step)) / (np.sqrt(m[1][at] / (1 - 0.99**step)) + 1e-7)

    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(labels))
        for k in range(0, len(order), 32):
            step += 1
            grads = [np.zeros_like(p) for p in parameters[2:]]
            touched: list[tuple[int, np.ndarray, np.ndarray]] = []
            bias_grad = 0.0
            some = order[k : k + 32]
            for i in some:
                e = model.whole[whole[i]] + model.head[head[i]]
                pooled, where = np.zeros(len(model.top), np.float32), np.full(len(model.top), -1)
                for f, width in enumerate(WIDTHS):
                    if len(e) < width:
                        continue
                    y = sum(e[j : len(e) - width + 1 + j] @ model.filters[f][j] for j in range(width))
                    best = y.argmax(axis=0)
                    value = y[best, np.arange(FILTERS)]
                    sl = slice(f * FILTERS, (f + 1) * FILTERS)
                    pooled[sl], where[sl] = np.maximum(value, 0), np.where(value > 0, best, -1)
                keep = (rng.random(len(pooled)) < 0.8) / np.float32(0.8)
                p = 1 / (1 + np.exp(-np.clip(float((pooled * keep) @ model.top) + float(bias[0]), -30, 30)))
                d = np.float32((p - labels[i]) * weight[i] / len(some))
                bias_grad += d
                grads[-1] += d * pooled * keep
                back = d * model.top * keep
                for c in np.flatnonzero(where >= 0):
                    f, j = divmod(c, FILTERS)
                    a = where[c]
                    grads[f][:, :, j] += back[c] * e[a : a + WIDTHS[f]]
                    touched.append((i, np.arange(a, a + WIDTHS[f]), back[c] * model.filters[f][:, :, j]))
            for table, source, m in ((model.whole, whole, moments[0]), (model.head, head, moments[1])):
                if touched:
                    at = np.concatenate([source[i][w] for i, w, _ in touched])
                    rows, inverse = np.unique(at, return_inverse=True)
                    g = np.zeros((len(rows), DIM), np.float32)
                    np.add.at(g, inverse, np.concatenate([x for *_, x in touched]))
                    adam(table, g, m, rows, rate)
            for p_, g, m in zip(parameters[2:], grads, moments[2:]):
                adam(p_, g + 1e-5 * p_, m, rate=rate)
            adam(bias, np.float32([bias_grad]), bias_moments, rate=rate)
    model.bias = float(bias[0])
    model.project()
    return model


def naive_bayes(whole: list[np.ndarray], langs: np.ndarray) -> tuple[list[str], np.ndarray]:
    names = sorted({x for x in langs if x is not None}) or [""]
    counts = np.full((BUCKETS, len(names)), 0.1)
    for w, lang in zip(whole, langs):
        if lang is not None:
            np.add.at(counts[:, names.index(lang)], w, 1)
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1, between the probabilities it parts."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    return float(np.clip((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2, 0.02, 0.98))


def train(rows: pd.DataFrame, epochs: int = EPOCHS, seed: int = 5, least: int = 8) -> Model:
    """A calibrated model from rows (text, toxic, lang); every fourth is kept for calibration."""
    if rows.empty:
        rows = pd.DataFrame({"text": [""], "toxic": [0], "lang": [None]})
    # in slices: hashing takes some ten bytes of memory a byte of text
    texts = pa.RecordBatch.from_arrays([pa.array(rows["text"], pa.string())], ["text"])
    parts = [features(*byte_buffers(part.column("text"))) for part in by_bytes([texts], "text", 1 << 17)]
    whole, head = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    first = np.append(0, np.cumsum(np.concatenate([np.diff(p[2]) for p in parts])))
    cut = list(zip(first[:-1], first[1:]))
    whole_, head_ = [whole[a:b] for a, b in cut], [head[a:b] for a, b in cut]
    y = rows["toxic"].to_numpy().astype(np.float32)
    langs = rows["lang"].where(rows["lang"].notna(), None).to_numpy()
    fold = np.arange(len(y)) % 4 == 3
    learn = np.flatnonzero(~fold)
    if len(set(y[learn])) > 1:
        model = fit([whole_[i] for i in learn], [head_[i] for i in learn], y[learn], epochs, seed)
    else:
        model = Model(np.zeros((BUCKETS, DIM)), np.zeros((BUCKETS, DIM)), [np.zeros((w, DIM, FILTERS)) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), 0.0)
        model.project()
        model.bias = float(np.log((y.mean() + 0.01) / (1.01 - y.mean())))
    model.names, model.languages = naive_bayes(whole_, langs)
    p = np.concatenate([model.probabilities(*part) for part in parts])
    guess = np.concatenate([model.guess(part[0], part[2]) for part in parts])
    common = best_threshold(p[fold], y[fold]) if y[fold].sum() >= 1 else 0.5
    model.thresholds = np.full(len(model.names), common)
    for k in range(len(model.names)):
        own = fold & (guess == k)
        if least <= y[own].sum() < own.sum():
            model.thresholds[k] = best_threshold(p[own], y[own])
    return model


def sample(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> pd.DataFrame:
    """The rows to learn from: of each label the `most_rows` whose ids hash smallest."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    short = docs.where((F.octet_length("text") > 0) & (F.octet_length("text") <= most_bytes)).select("doc_id")
    known = known.join(short.distinct(), "doc_id").withColumn("h", F.xxhash64("doc_id"))
    # the rows of each label by an ordered limit: no task holds more than the limit
    parts = [known.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(most_rows).select("doc_id", "toxic") for label in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    texts = docs.select("doc_id", "text", "lang").where(F.octet_length("text") <= most_bytes)
    # at most two labels' worth of ids: small enough to broadcast
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "toxic")).alias("r")).select("doc_id", "r.*")
    return found.toPandas().sort_values("doc_id").sample(frac=1, random_state=1).reset_index(drop=True)


def score_batches(batches: Batches, model: Model) -> Batches:
    for part in by_bytes(batches, "text", 1 << 20):
        s = model.score(*features(*byte_buffers(part.column("text"))))
        yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(s, pa.float64())], ["key", "score"])


def slim(model: Model) -> Model:
    """What scoring needs."""
    return Model(np.zeros(0), np.zeros(0), [], model.top, model.bias, model.languages, model.names, model.thresholds, model.tables)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for every row of `docs`."""
    spark = docs.sparkSession
    ship_code(spark)
    sent = spark.sparkContext.broadcast(slim(model))
    give_back()  # what training took
    rows = docs.select(F.col(id_col).cast("long").alias("key"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(lambda b: score_batches(b, sent.value), "key long, score double").withColumnRenamed("key", "doc_id")


def judge(docs: DataFrame, model: Model, keep_under: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that score under `keep_under`."""
    spark = docs.sparkSession
    ship_code(spark)
    sent = spark.sparkContext.broadcast(slim(model))
    give_back()  # what training took

    def run(batches: Batches) -> Batches:
        for part in by_bytes(batches, text_col, 1 << 20):
            yield part.filter(pa.array(model_score(sent.value, part.column(text_col).fill_null("")) < keep_under))

    return docs.mapInArrow(run, docs.schema)


def model_score(model: Model, text: pa.Array) -> np.ndarray:
    return model.score(*features(*byte_buffers(text)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
