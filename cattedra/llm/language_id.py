"""Language identification by hierarchical discrimination: the family first, then one-versus-one linear support vector
machines between the languages of that family.

Texts become counts of hashed character 1- to 4-grams of their lower-cased words (``BITS`` bits), divided by their number;
words next to digits or underscores count only where a piece of text has no others.
The family is the one with the highest mean log probability of these grams (multinomial, one half added to each count).
Inside a family each pair of languages has a linear machine (squared hinge, dual coordinate descent to a small projected
gradient); each machine votes, ties go to the higher sum of probabilities and then to the smaller language name. Each
machine has its own sigmoid for probabilities, fitted as Platt does. The score is the family's probability times the mean
probability of the winner over its pairs.

The model is fitted on a bounded sample of the labelled rows: ``max_rows`` in expectation over all languages, the same
rows of each, chosen by a hash of id and text. Families and pairs are fitted side by side in Spark tasks. Weights
are dense in 2^BITS buckets, so what is broadcast is bounded by (families + pairs) * 2^BITS floats: with the languages,
not with the rows. Every row is scored on its whole text in Arrow batches, without a shuffle.

Null texts and texts without a letter are ``und`` with score 0, as is every row where no row could be learnt from. Rows
with a null language or without a letter are not learnt from; repeated rows count as often as they stand there. A
language that ``families`` doesn't name belongs to the family ``other``. Existing columns named lang_pred or score are
replaced. Texts are read in pieces of ``PIECE`` characters, over which no gram reaches, so memory doesn't grow with a
text's length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cattedra.llm.common import no_clash, ship, slices, write_shared

BITS, ORDERS, PIECE = 18, 4, 1 << 20
MAX_ROWS = 4_000
COST, ROUNDS, TOLERANCE = 1.0, 40, 1e-3
#: Grams that count at most as independent evidence of a family.
EVIDENCE = 60
UNDETERMINED = "und"

#: ISO 639-1 codes of some language families.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
}

_WORDS = re.compile(r"[^\W\d_]+")
#: Words without digits: keys and hashes say little about a language.
_CLEAN = re.compile(r"\b[^\W\d_]+\b")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each character gram of the texts, repeats included. Rows without a letter have none."""
    codes, rows, offset, starts = [], [], 0, []
    for i, text in enumerate(texts):
        for start in range(0, len(text or ""), PIECE):
            piece = text[start:start + PIECE].lower()
            piece = " ".join(_CLEAN.findall(piece) or _WORDS.findall(piece))
            if any(map(str.isalpha, piece)):
                code = np.frombuffer(f" {piece} ".encode("utf-32-le", "surrogatepass"), "<u4")
                codes.append(code)
                rows.append(np.full(len(code), i, np.int32))
                offset += len(code)
                starts.append(offset)
    if not codes:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    code, row = np.concatenate(codes).astype(np.uint64), np.concatenate(rows)
    left = np.repeat(np.array(starts), [len(c) for c in codes]) - np.arange(offset)  # characters up to the piece's end
    hashed, out, at = np.zeros(offset, np.uint64), [], []
    for order in range(1, ORDERS + 1):
        n = offset - order + 1
        hashed = (hashed[:n] + code[order - 1:] + np.uint64(order)) * _MIX
        hashed ^= hashed >> np.uint64(29)
        whole = left[:n] >= order
        if order == 1:
            whole &= code != 32
        out.append(((hashed * _MIX) >> np.uint64(64 - BITS))[whole].astype(np.int64))
        at.append(row[:n][whole])
    return np.concatenate(at), np.concatenate(out)


def frequencies(row: np.ndarray, bucket: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of ``n`` rows its distinct buckets and their counts."""
    keys, counts = np.unique(row.astype(np.int64) << BITS | bucket, return_counts=True)
    ends = np.searchsorted(keys >> BITS, np.arange(n + 1))
    keys &= (1 << BITS) - 1
    return [(keys[a:b], counts[a:b]) for a, b in zip(ends, ends[1:])]


def separate(examples: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: float = COST) -> np.ndarray:
    """Weights of the linear machine with squared hinge loss, by dual coordinate descent."""
    w, alpha, soft = np.zeros(1 << BITS), np.zeros(len(examples)), 1 / (2 * cost)
    norms = np.array([v @ v for _, v in examples]) + soft
    rng = np.random.default_rng(0)
    for _ in range(ROUNDS):
        worst = 0.0
        for i in rng.permutation(len(examples)):
            at, v = examples[i]
            slope = signs[i] * (w[at] @ v) - 1 + soft * alpha[i]
            if alpha[i] == 0 and slope >= 0:
                continue
            worst = max(worst, abs(slope))
            moved = max(alpha[i] - slope / norms[i], 0.0)
            w[at] += (moved - alpha[i]) * signs[i] * v
            alpha[i] = moved
        if worst < TOLERANCE:
            break
    return w


def sigmoid(margins: np.ndarray, signs: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the probability 1 / (1 + exp(-(slope * margin + offset))), with Platt's softened targets."""
    up, down = (signs > 0).sum(), (signs < 0).sum()
    target = np.where(signs > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margins / (np.abs(margins).mean() or 1.0), np.ones(len(margins))])
    at = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (target - p))
        at += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0] / (np.abs(margins).mean() or 1.0)), float(at[1])


@dataclass
class LanguageModel:
    """family -> its languages; weights by family; by pair of languages (weights, slope, offset)."""

    languages: dict[str, list[str]]
    families: dict[str, np.ndarray]
    pairs: dict[tuple[str, str], tuple[np.ndarray, float, float]]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        row, bucket = grams(texts)
        total = np.bincount(row, minlength=n)
        names = sorted(self.families)
        if not names:
            return [UNDETERMINED] * n, np.zeros(n)

        def mean(weights: np.ndarray, row: np.ndarray = row, bucket: np.ndarray = bucket) -> np.ndarray:
            return np.bincount(row, weights[bucket], minlength=n) / np.maximum(total, 1)

        levels = np.stack([mean(self.families[f]) for f in names])
        levels = (levels - levels.max(axis=0)) * np.minimum(total, EVIDENCE)
        sure = 1 / np.exp(levels).sum(axis=0)
        chosen = levels.argmax(axis=0)
        labels, scores = np.full(n, UNDETERMINED, object), np.zeros(n)
        for k, family in enumerate(names):
            mine = (chosen == k) & (total > 0)
            own, at = self.languages[family], mine[row]
            at = (row[at], bucket[at])
            votes, sums = np.zeros((len(own), n)), np.zeros((len(own), n))
            for a, b in combinations(range(len(own)), 2) if mine.any() else ():
                w, slope, offset = self.pairs[own[a], own[b]]
                p = 1 / (1 + np.exp(-np.clip(slope * mean(w, *at) + offset, -35, 35)))
                votes[a] += p >= 0.5
                votes[b] += p < 0.5
                sums[a] += p
                sums[b] += 1 - p
            best = (votes + sums / (len(own) + 1)).argmax(axis=0)  # sums decide between equal votes only
            inside = sums[best, np.arange(n)] / (len(own) - 1) if len(own) > 1 else np.ones(n)
            labels[mine] = np.array(own, object)[best[mine]]
            scores[mine] = (sure * inside)[mine]
        return labels.tolist(), np.clip(scores, 0.0, 1.0)


def _family_of(lang: Column, families: dict[str, list[str]]) -> Column:
    known = F.create_map(*[F.lit(x) for f, langs in sorted(families.items()) for code in langs for x in (code, f)])
    return F.coalesce(F.try_element_at(known, lang), F.lit("other"))


def fit(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS,
        families: dict[str, list[str]] | None = None) -> LanguageModel:
    """Learn from all rows of ``documents`` with a language; ``max_rows`` bounds the sample (in expectation)."""
    spark = documents.sparkSession
    ship(spark)
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    # one row a language: as many as the model has classes
    share = sizes.select("lang", (F.lit(float(max_rows)) / F.lit(max(1, sizes.count())) / F.col("rows")).alias("share"))
    key = F.xxhash64(F.lit("lang"), "id", "text")
    sample = rows.join(F.broadcast(share), "lang").where(  # far smaller than the model, whose weights are broadcast too
        (F.shiftrightunsigned(key, 11).cast("double") / float(1 << 53)) < F.col("share"))
    sample = sample.select("text", "lang", _family_of(F.col("lang"), families or FAMILIES).alias("family"), key.alias("key"))

    def count(batches):
        for part in slices(batches, "text"):
            found = frequencies(*grams(part.column(0).to_pylist()), part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array([a.astype("<u4").tobytes() for a, _ in found], pa.binary()),
                 pa.array([c.astype("<u4").tobytes() for _, c in found], pa.binary())],
                names=["lang", "family", "key", "at", "n"])

    counted = sample.mapInArrow(count, "lang string, family string, key long, at binary, n binary").where("length(at) > 0")
    counted = write_shared(counted, "languages-sample")
    known = counted.select("family", "lang").distinct().collect()  # one row a language
    languages: dict[str, list[str]] = {}
    for r in sorted(known):
        languages.setdefault(r.family, []).append(r.lang)

    def unpack(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(n, "<u4").astype(float))
                for a, n in zip(table.column("at").to_pylist(), table.column("n").to_pylist())]

    def family(table: pa.Table) -> pa.Table:
        total = np.full(1 << BITS, 0.5)
        for at, n in unpack(table):
            total[at] += n
        weights = np.log(total / total.sum())
        return pa.table({"family": table.column("family")[:1], "weights": pa.array([weights.astype("<f4").tobytes()], pa.binary())})

    def pair(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("lang", "ascending"), ("at", "ascending"), ("n", "ascending")])  # a hash order
        signs = np.where(np.array(table.column("lang").to_pylist()) == table.column("a")[0].as_py(), 1, -1)
        examples = [(at, n / n.sum()) for at, n in unpack(table)]
        common = np.full(1 << BITS, 1.0 / len(examples))
        for at, x in examples:
            common[at] += x
        scale = np.sqrt(len(examples) / common)  # rare grams count for more
        scaled = [(at, x * scale[at]) for at, x in examples]
        w = separate([(at, x / np.linalg.norm(x)) for at, x in scaled], signs) * scale
        slope, offset = sigmoid(np.array([w[at] @ x for at, x in examples]), signs)
        return pa.table({"a": table.column("a")[:1], "b": table.column("b")[:1],
                         "weights": pa.array([w.astype("<f4").tobytes()], pa.binary()),
                         "slope": [slope], "offset": [offset]})

    # the sample is bounded by max_rows, so a family's part of it may meet in one task
    made = counted.groupBy("family").applyInArrow(family, "family string, weights binary").collect()
    inside = [(f, a, b) for f, own in languages.items() for a, b in combinations(own, 2)]
    machines = []
    if inside:
        pairs = F.broadcast(spark.createDataFrame(inside, "family string, a string, b string"))
        asked = counted.join(pairs, "family").where("lang = a or lang = b")
        machines = asked.groupBy("a", "b").applyInArrow(pair, "a string, b string, weights binary, slope double, offset double").collect()
    return LanguageModel(languages, {r.family: np.frombuffer(r.weights, "<f4") for r in made},
                         {(r.a, r.b): (np.frombuffer(r.weights, "<f4"), r.slope, r.offset) for r in machines})


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Append lang_pred and score (0 to 1) to every row."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # (families + pairs) * 2^BITS floats
    base = no_clash(df, "lang_pred", "score")
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for part in slices(batches, text):
            labels, scores = shared.value.predict(part.column(part.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(labels, pa.string()), pa.array(scores)],
                                             names=schema.fieldNames())

    return base.mapInArrow(run, schema)
