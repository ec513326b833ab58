"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Words are runs of letters and digits, with their case, and runs of other signs. A document's features are its words and
pairs of neighbours, hashed into 2^18 buckets: 1 + ln(count), scaled to unit length. Training goes over a bounded
sample of labelled rows on the driver, which gets their sparse features, never texts; the weights, 1 MB, are broadcast;
all rows are scored whole, as sparse dot products. The bound is `train_rows`, the only one here: of the labels, those of
the smallest hashes of the key, and of the rows that these meet, again the first so many in this order.

The rates and the number of epochs were chosen by log loss on a part of the training fold (remainder 1, 795 rows of the
given tables, fitted on remainders 2 to 4): 0.056 with alpha 4 and three epochs, as with eight, 0.066 with alpha 2, 0.084
with alpha 1. Held-out labels took no part.

Defined results: null and empty texts have no features and get the score that the bias gives; texts of any length are
read whole; repeated rows each get the same score; without labelled rows of both classes the score is the share of
positive labels, one half without any; rows with a null label, or several labels for one key, train as often as they
occur, nulls not at all. Other columns are kept; columns of the output's names are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Remembered, held_out, mix64, table, text_runs

BITS, TRAIN_ROWS, EPOCHS = 18, 6000, 3
THRESHOLD = 0.3
TOKEN = re.compile(r"\w+|[^\w\s]+")
_HASHES = Remembered(xxhash.xxh3_64_intdigest)


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row bounds, buckets, values): sparse unit-length features of every text, rows one after the other."""
    hashes, sizes = [], np.zeros(len(texts), "i8")
    for i, text in enumerate(texts):
        tokens = TOKEN.findall(text)
        sizes[i] = len(tokens)
        hashes.append(np.fromiter(map(_HASHES.__getitem__, tokens), "u8", len(tokens)))
    words = np.concatenate(hashes) if hashes else np.empty(0, "u8")
    row = np.repeat(np.arange(len(texts), dtype="u8"), sizes)
    pairs = np.flatnonzero(row[1:] == row[:-1])
    both = mix64(words[pairs] * np.uint64(3) + words[pairs + 1])
    keys = np.concatenate([row << np.uint64(bits) | words >> np.uint64(64 - bits), row[pairs] << np.uint64(bits) | both >> np.uint64(64 - bits)])
    keys, counts = np.unique(keys, return_counts=True)
    owner, values = (keys >> np.uint64(bits)).astype("i8"), 1 + np.log(counts)
    norms = np.sqrt(np.bincount(owner, values * values, minlength=len(texts)))
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    return bounds, (keys & np.uint64((1 << bits) - 1)).astype("i4"), (values / norms[owner]).astype("f4")


@dataclass
class FtrlModel:
    """weights by bucket and a bias."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        bounds, buckets, values = features(texts, int(len(self.weights)).bit_length() - 1)
        dots = np.concatenate([[0.0], np.cumsum(self.weights[buckets].astype("f8") * values)])
        return 1 / (1 + np.exp(-(dots[bounds[1:]] - dots[bounds[:-1]] + self.bias)))


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, alpha: float = 4.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, epochs: int = EPOCHS) -> FtrlModel:
    """Per-coordinate FTRL-proximal over (buckets, values, label), in the order given, `epochs` times. The bias is not
    regularised: it starts at the log-odds of the labels and learns at the same rate."""
    y = np.array([r[2] for r in rows], "f8")
    share = y.mean() if len(y) else 0.5
    bias = float(np.log((share * len(y) + 0.5) / ((1 - share) * len(y) + 0.5)))
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    if len(y) and 0 < share < 1:
        bias_n = 0.0
        for _ in range(epochs):
            for idx, x, label in rows:
                zi, ni = z[idx], n[idx]
                w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
                g = 1 / (1 + np.exp(-(w @ x + bias))) - label
                step = g * x
                z[idx] = zi + step - (np.sqrt(ni + step * step) - np.sqrt(ni)) / alpha * w
                n[idx] = ni + step * step
                bias_n += g * g
                bias -= 0.1 * alpha / (beta + np.sqrt(bias_n)) * g
    weights = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    return FtrlModel(weights.astype("f4"), bias)


def train_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", *, train_rows: int = TRAIN_ROWS, bits: int = BITS) -> FtrlModel:
    """Fits on documents with a label whose key is not held out: at most `train_rows` of the smallest key hashes."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(key)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    picked = known.orderBy(F.xxhash64("_key"), "_key", "_label").limit(train_rows)

    @F.arrow_udf("struct<buckets:array<int>,values:array<float>>")
    def featurise(texts: pa.Array) -> pa.Array:
        parts = [features(plain, bits) for plain in text_runs(texts)]
        sizes = np.concatenate([np.zeros(1, "i8"), *(np.diff(bounds) for bounds, _, _ in parts)])
        at = pa.array(np.cumsum(sizes), pa.int32())
        buckets, values = (np.concatenate([np.empty(0, kind), *(p[k] for p in parts)]) for k, kind in ((1, "i4"), (2, "f4")))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(buckets)), pa.ListArray.from_arrays(at, pa.array(values))], ["buckets", "values"])

    sample = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(picked), "_key")  # at most train_rows rows
    got = sample.select("_key", "_label", featurise("_text").alias("f")).orderBy(F.xxhash64("_key"), "_key", "_label").limit(train_rows).toArrow()
    f = got["f"].combine_chunks()
    buckets, values = f.field("buckets"), f.field("values")
    rows = [(buckets[i].values.to_numpy(), values[i].values.to_numpy(), got["_label"][i].as_py()) for i in range(got.num_rows)]
    return fit_ftrl(rows, bits)


def score_quality(docs: DataFrame, model: FtrlModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the model's score, between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([shared.value.scores(plain) for plain in text_runs(texts)] or [np.empty(0)]))

    return docs.withColumn(out, score(F.col(text)))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
