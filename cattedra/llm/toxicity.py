"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the set of its hashed words, word pairs and pairs with one word skipped (``BITS`` bits). FTRL
keeps, for each coordinate, a sum of adjusted gradients and a sum of squared gradients: the second sets that
coordinate's own learning rate, and the L1 term leaves at exactly zero every weight whose evidence stays small. What
is left is a short list of (feature, weight), broadcast for scoring.

The model is fitted on a bounded sample of the labelled rows, ``max_rows`` in expectation, chosen by a hash of id and
text, so the sequential part has the same size for any input. Scoring covers every row and whole texts, in Arrow
batches without a shuffle.

Null and empty texts have no features and get the score of the bias alone. Rows with a null label, or an id that has no
text, take no part in fitting; with no labelled row at all every score is 0.5. Labels that appear twice count twice.
Existing columns named score or predicted are replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cattedra.llm.common import no_clash, ship, slices, write_shared

BITS = 22
MAX_ROWS = 10_000
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")
#: Odd multipliers that tell pairs, and pairs over a skipped word, from single words.
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each word, pair and skip pair of the texts, repeats included."""
    hashes, rows = [], []
    for i, text in enumerate(texts):
        words = _WORD.findall((text or "").lower())
        if words:
            hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
            rows.append(np.full(len(words), i, np.int32))
    if not hashes:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    out, at = [h], [r]
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        same = r[:-gap] == r[gap:]
        mixed = (h[:-gap][same] * salt) ^ (h[gap:][same] + salt)
        out.append(mixed * _PAIR)
        at.append(r[:-gap][same])
    return np.concatenate(at), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Ftrl:
    """State by coordinate; the bias is a coordinate of its own without L1."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.1
    z: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    n: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    bias_z: float = 0.0
    bias_n: float = 0.0

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + math.sqrt(self.bias_n)) / self.alpha)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / rate)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One example; ``at``: its distinct features."""
        w, b = self.weights(at), self.bias()
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()) + b)))) - label
        grown = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (grown - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g
        step = (math.sqrt(self.bias_n + g * g) - math.sqrt(self.bias_n)) / self.alpha
        self.bias_z += g - step * b
        self.bias_n += g * g


@dataclass
class ToxicityModel:
    bias: float
    at: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.at] = self.weight
        return out

    def score(self, texts: list[str | None], dense: np.ndarray) -> np.ndarray:
        row, at = features(texts)
        hit = dense[at] != 0
        seen = np.unique(row[hit].astype(np.int64) << BITS | at[hit])  # few are left: weights are sparse
        total = np.bincount(seen >> BITS, dense[seen & ((1 << BITS) - 1)], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
        max_rows: int = MAX_ROWS, epochs: int = 3) -> ToxicityModel:
    """Learn from labelled rows (0 or 1). ``labels`` holds doc_id and label; ``max_rows`` bounds the sample."""
    ship(documents.sparkSession)
    known = labels.where(F.col(label).isin(0, 1)).select(
        F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("label"))
    rows = known.count()
    share = min(1.0, max_rows / max(1, rows))
    mixed = F.xxhash64(F.lit("fit"), "__id")
    sample = known.where(F.shiftrightunsigned(mixed, 11) < int(share * (1 << 53)))
    texts = documents.select(F.col(doc_id).alias("__id"), F.col(text).alias("text"))
    joined = texts.join(sample, "__id").select("text", "label", mixed.alias("key"))

    def distinct(batches):
        for part in slices(batches, "text"):
            row, at = features(part.column(0).to_pylist())
            pairs = np.unique(row.astype(np.int64) << BITS | at)
            ends = np.searchsorted(pairs >> BITS, np.arange(part.num_rows + 1))
            packed = (pairs & ((1 << BITS) - 1)).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [part.column(1), part.column(2),
                 pa.array([packed[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())],
                names=["label", "key", "at"])

    examples = write_shared(joined.mapInArrow(distinct, "label int, key long, at binary"), "toxicity-sample", few=True)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "at"], kind="stable")  # a hash order: the same on every run
        model, seen = Ftrl(), [np.frombuffer(x, "<u4").astype(np.int64) for x in pdf["at"]]
        for _ in range(epochs):
            for at, y in zip(seen, pdf["label"]):
                model.learn(at, int(y))
        at = np.flatnonzero(np.abs(model.z) > model.l1)
        return pd.DataFrame({"bias": [model.bias()], "at": [at.astype("<i8").tobytes()],
                             "weight": [model.weights(at).astype("<f4").tobytes()]})

    # the sample is bounded by max_rows, so it may meet in one task
    made = examples.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(train, "bias double, at binary, weight binary").collect()
    if not made:
        return ToxicityModel(0.0, np.zeros(0, np.int64), np.zeros(0, np.float32))
    return ToxicityModel(made[0].bias, np.frombuffer(made[0].at, "<i8"), np.frombuffer(made[0].weight, "<f4"))


_DENSE: dict[str, np.ndarray] = {}


def score(df: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Append score (0 to 1) and predicted (1 from the threshold on) to every row."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # non-zero weights only, at most 2^BITS
    key = f"{id(model)}-{len(model.at)}-{model.bias!r}"
    base = no_clash(df, "score", "predicted")
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])

    def run(batches):
        fitted = shared.value
        if key not in _DENSE:
            _DENSE.clear()
            _DENSE[key] = fitted.dense()
        for part in slices(batches, text):
            s = fitted.score(part.column(part.schema.get_field_index(text)).to_pylist(), _DENSE[key])
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.fieldNames())

    return base.mapInArrow(run, schema)
