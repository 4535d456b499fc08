"""Mixing sources to target weights by the cube method.

Targets: the sources share ``share`` times all sizes by weight; no source goes above ``most`` times its own size, and
the excess is shared again by weight until none is above. A source's ratio target / size gives each of its documents
whole copies plus a fractional inclusion probability.

Selection: the flight phase moves the probabilities of the undecided documents along the null space of the two
balancing constraints (document total, token total), the largest document leading, until one of them reaches 0 or 1, and
so on. A chunk cannot make up for a document that is long against it, so in a source of more than one chunk the *long*
documents, those above 1 / ``LONG`` of the source's words (fewer than ``LONG``), are decided first, in a flight against the
rest of the source, which enters as one bulk for each power of two of size. One that is too long even for that is decided
by its probability, and all others get what is left. Then the probabilities of the documents that are not long shift along
a line over size that makes up for what the long ones are off by. Where the line would leave [0, 1] it is flattened until it
does not: the tokens still come out, the document total gives way. Only where all others together have too few words does a
difference stay.

Then each (source, chunk) of at most about ``CHUNK`` documents flies by itself and leaves two undecided at most; these meet in
ever fewer chunks until one is left for each source. There the landing drops the token constraint, then decides the
last one by its probability. So the tokens are off by two documents that are not long, and a source with a third of all
rows is just many chunks.

All randomness comes from hashes of id and text, so reruns agree. Null texts have size 0; null sources are one source, in
the last place. A source without words has target 0, and its documents are not taken. Repeated rows are units of their
own. An empty table gives an empty result. Extra columns are ignored by ``mix``.
Ids (doc_id) are whole numbers within a long, or texts of such; any other id stops the query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cattedra.llm.common import WORD_PATTERN, ship, write_shared
from cattedra.operators.numbering import with_global_index

CHUNK = 512
#: Documents above their source's words / ``LONG`` are decided before the chunks.
LONG = 4 * CHUNK
#: Sources up to this number are broadcast (about 100 bytes each).
MOST_BROADCAST = 10_000
_UNIT = "doc_id string, source string, size long, text_key long, unit_key long, pi double, pick int, chunk long"


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """One row per source: source, source_size, n_docs, target. ``sizes``: source, size.

    Weights repeat over the sources in code-point order, null last. Only sums come to the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = with_global_index(per, [F.col("source").asc_nulls_last()], "place")
    table = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(table, (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    per = write_shared(per.select("source", "source_size", "n_docs", weight.alias("weight")), "sources", few=True)
    cap, level = F.col("source_size") * F.lit(float(most)), 0.0
    total = float(share) * float(per.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        # sources whose cap lies under the level keep their cap; the rest share what remains by weight
        full = cap < F.col("weight") * F.lit(level)
        taken, rest = per.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        raised = (total - (taken or 0.0)) / rest if rest else level
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return per.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def fly(sizes: np.ndarray, pi: np.ndarray, seed: int, land: bool, counts: np.ndarray | None = None,
        bulk: np.ndarray | None = None) -> np.ndarray:
    """Cube method for documents with inclusion probabilities ``pi``: probabilities after the flight, all but two of
    them 0 or 1; with ``land`` all of them.

    Each move takes the largest undecided document and the smallest change of all the others that keeps both totals, and
    goes along it, one way or the other, until some probability reaches 0 or 1. So large documents are decided while many
    small ones can still make up for them, and what is left for the landing is small.

    Units marked in ``bulk`` stand for ``counts`` documents of their mean size, smaller than all the others; they only make
    up for these and are not decided. Then the landing drops the document constraint.
    """
    x, rng = pi.astype(float).copy(), np.random.default_rng(seed)
    s = sizes / max(1.0, float(np.mean(sizes))) if len(sizes) else sizes.astype(float)
    bulk = np.zeros(len(s), bool) if bulk is None else bulk
    w = np.ones(len(s)) if counts is None else counts.astype(float)
    open_ = np.lexsort((-s, bulk))
    open_ = open_[(x[open_] > 0) & (x[open_] < 1)]

    def move(u: np.ndarray) -> None:
        nonlocal open_
        p = x[open_]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)).min()
            down = np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)).min()
        p = p + (up if rng.random() * (up + down) < down else -down) * u
        x[open_] = np.where(p < 1e-9, 0.0, np.where(p > 1 - 1e-9, 1.0, p))
        open_ = open_[(x[open_] > 0) & (x[open_] < 1)]

    while len(open_) > 2 and not bulk[open_[0]]:
        first, rest, held = s[open_[0]], s[open_[1:]], w[open_[1:]]
        n, total, square = held.sum(), (held * rest).sum(), (held * rest * rest).sum()
        det = n * square - total * total
        u = np.zeros(len(open_))
        if det > 1e-9 * max(1.0, n * square):
            a, b = (square - total * first) / det, (n * first - total) / det
            u[0], u[1:] = 1.0, -(a + b * rest)
        elif abs(first - rest[0]) < 1e-9:
            u[0], u[1:] = 1.0, -1.0 / n  # all alike: the document total is enough
        else:
            u[1], u[2] = 1.0 / held[0], -1.0 / held[1]  # the others are alike
        move(u)
    if land:
        while len(open_) == 2 and not bulk[open_[0]]:
            other = w[open_[1]] * s[open_[1]]
            move(np.array([1.0, -1.0 if not bulk.any() else -s[open_[0]] / other if other else 0.0]))
        for k in open_[~bulk[open_]]:
            x[k] = float(rng.random() < x[k])
    return x


def decide_long(sizes: np.ndarray, pi: float, seed: int, counts: np.ndarray, bulk: np.ndarray) -> np.ndarray:
    """0 or 1 for each long document, against the ``bulk`` of the others; all start from the probability ``pi``."""
    x, rng = np.full(len(sizes), float(pi)), np.random.default_rng(~seed & (1 << 64) - 1)
    words = sizes * counts
    left, wanted, level = words.sum(), pi * words.sum(), float(pi)
    order = np.lexsort((-sizes, bulk))
    start = 0
    for start, k in enumerate(order):
        room = left - words[k]  # the words that can make up for this one
        if bulk[k] or not 0 < level < 1 or words[k] * (1 - level) <= level * room and words[k] * level <= (1 - level) * room:
            break
        x[k] = float(rng.random() < level)
        left, wanted = room, wanted - x[k] * words[k]
        level = min(1.0, max(0.0, wanted / left)) if left else level
    rest = order[start:][(x[order[start:]] == pi)] if pi not in (0.0, 1.0) else order[:0]
    x[rest] = fly(sizes[rest], np.full(len(rest), level), seed, True, counts[rest], bulk[rest])
    return x


def _flown(units: DataFrame, land: bool) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["unit_key", "text_key", "size"], kind="stable")
        # the keys of the chunk seed it: neither row order nor the run matters
        seed = int(np.bitwise_xor.reduce(pdf["unit_key"].to_numpy().view(np.uint64)))
        p = fly(pdf["size"].to_numpy(), pdf["pi"].to_numpy(), seed, land)
        done = (p == 0) | (p == 1)
        return pdf.assign(pi=p, pick=np.where(done, p, -1).astype(np.int32))

    return units.groupBy("source", "chunk").applyInPandas(run, _UNIT)


def shifted(bins: DataFrame, long: DataFrame, per: DataFrame) -> DataFrame:
    """``per`` with flat and slope: documents that are not long get the probability flat + slope * size.

    ``bins``: s, n, words, squares, low, high of those documents; ``long``: s, size, pick of the decided ones. Only sums per
    source are used.
    """
    size, pi = F.col("size").cast("double"), F.col("pi0")
    off = long.join(per.select("pi0", F.col("s").alias("sl")), F.col("s").eqNullSafe(F.col("sl")))
    off = off.groupBy(F.col("s").alias("so")).agg(F.sum(F.col("pick") - pi).alias("off_n"), F.sum((F.col("pick") - pi) * size).alias("off_w"))
    sums = bins.groupBy(F.col("s").alias("su")).agg(
        F.sum("n").cast("double").alias("n"), F.sum("words").cast("double").alias("w"), F.min("low").alias("low"),
        F.max("high").alias("high"), (F.sum("squares") / F.sum("n") - F.pow(F.sum("words") / F.sum("n"), F.lit(2))).alias("var"))
    out = per.join(off, F.col("s").eqNullSafe(F.col("so"))).join(sums, F.col("s").eqNullSafe(F.col("su")))
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    # level: the same probability for all, which meets the tokens; line: meets the documents too
    out = out.withColumn("level", F.when(F.col("w") > 0, unit((pi * F.col("w") - F.col("off_w")) / F.col("w"))).otherwise(pi))
    mean = F.col("w") / F.col("n")
    out = out.withColumn("mid", unit(pi - F.col("off_n") / F.col("n")))
    out = out.withColumn("tilt", F.when(F.col("var") > 1e-9 * mean * mean, (F.col("level") - F.col("mid")) * mean / F.col("var")).otherwise(0.0))
    level, mid = F.col("level"), F.when(F.col("tilt") == 0, F.col("level")).otherwise(F.col("mid"))

    def part(at: str) -> Column:
        """The largest part of the line that stays in [0, 1] at an end of the sizes."""
        line = mid + F.col("tilt") * (F.col(at) - mean)
        return F.when(line > 1, (1 - level) / (line - level)).when(line < 0, level / (level - line)).otherwise(1.0)

    t = F.least(part("low"), part("high"))
    out = out.select(F.col("s").alias("ss"), (t * F.col("tilt")).alias("slope"),
                     (t * (mid - F.col("tilt") * mean) + (1 - t) * level).alias("flat"))
    out = per.join(out, F.col("s").eqNullSafe(F.col("ss")), "left").drop("ss")
    return out.withColumns({"slope": F.coalesce("slope", F.lit(0.0)), "flat": F.coalesce("flat", "pi0")})


def _long_decided(long: DataFrame, bins: DataFrame) -> DataFrame:
    def run(pdf: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pdf
        pdf = pdf.sort_values(["unit_key", "text_key", "size"], kind="stable")
        rest = rest.sort_values("bin")
        seed = int(np.bitwise_xor.reduce(pdf["unit_key"].to_numpy().view(np.uint64)))
        sizes = np.concatenate([pdf["size"].to_numpy(float), rest["words"].to_numpy(float) / rest["n"].to_numpy(float)])
        counts = np.concatenate([np.ones(len(pdf)), rest["n"].to_numpy(float)])
        x = decide_long(sizes, float(pdf["pi"].iloc[0]), seed, counts, np.arange(len(sizes)) >= len(pdf))[:len(pdf)]
        return pdf.assign(pi=x, pick=x.astype(np.int32))

    # the null source has a key of its own
    keys = lambda name: (F.col(name).isNull().alias("no_source"), F.coalesce(name, F.lit("")).alias("key"))
    left = long.select("*", *keys("source")).groupBy("no_source", "key")
    right = bins.select("*", *keys("s")).groupBy("no_source", "key")
    return left.cogroup(right).applyInPandas(lambda a, b: run(a.drop(columns=["no_source", "key"]), b), _UNIT)


def mix(df: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, doc_id: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken (copies times size), text_key
    (hash of the text)."""
    spark = df.sparkSession
    ship(spark)
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
                     F.regexp_count(content, F.lit(WORD_PATTERN)).cast("long").alias("size"),
                     F.xxhash64(content).alias("text_key"))
    # rows alike in everything get numbers, so that each is a unit of its own
    rows = write_shared(rows, "sizes")
    alike = rows.groupBy("doc_id", "source", "size", "text_key").agg(F.count(F.lit(1)).alias("n"))
    units = alike.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth"))
    units = units.withColumn("unit_key", F.xxhash64("doc_id", "text_key", "nth"))
    targets = write_shared(source_targets(rows.select("source", "size"), list(weights), share, most), "targets", few=True)

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ratio = F.when(F.abs(ratio - F.round(ratio)) < 1e-9, F.round(ratio)).otherwise(ratio)
    per = targets.select(F.col("source").alias("s"), "source_size", "target", "n_docs", (ratio - F.floor(ratio)).alias("pi0"))
    few = per.count() <= MOST_BROADCAST
    small = lambda x: F.broadcast(x) if few else x
    same = F.col("source").eqNullSafe(F.col("s"))
    is_long = (F.col("n_docs") > CHUNK) & (F.col("size") > F.col("source_size") / LONG)

    def undecided(joined: DataFrame, pi: Column, chunk: Column) -> DataFrame:
        return joined.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "size", "text_key", "unit_key",
                             pi.alias("pi"), F.lit(-1).alias("pick"), chunk.cast("long").alias("chunk"))

    rest = rows.join(small(per), same).where(~is_long & (F.col("n_docs") > CHUNK))
    n_words = F.col("size").cast("double")
    bins = rest.groupBy("s", F.floor(F.log2(F.col("size") + 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.sum(n_words * n_words).alias("squares"),
        F.min("size").alias("low"), F.max("size").alias("high"))
    bins = write_shared(bins, "bins", few=True)
    long = undecided(units.join(small(per), same).where(is_long), F.col("pi0"), F.lit(0))
    long = write_shared(_long_decided(long, bins), "long", few=True)
    shifts = write_shared(shifted(bins, long.select(F.col("source").alias("s"), "size", "pick"), per), "shifts", few=True)
    pi = F.least(F.greatest(F.col("flat") + F.col("slope") * F.col("size"), F.lit(0.0)), F.lit(1.0))
    left = undecided(units.join(small(shifts), same).where(~is_long), pi,
                     F.pmod(F.xxhash64(F.lit("chunk"), "unit_key"), F.ceil(F.col("n_docs") / CHUNK).cast("long")))
    chunks = targets.agg(F.max(F.ceil(F.col("n_docs") / CHUNK))).first()[0] or 0
    done = [long]
    while chunks > 1:
        flown = write_shared(_flown(left, land=False), "flight", few=True)
        done.append(flown.where("pick >= 0"))
        chunks = -(-chunks * 2 // CHUNK)  # each chunk has left two units at most
        left = flown.where("pick < 0").withColumn("chunk", F.pmod(F.xxhash64(F.lit(chunks), "unit_key"), F.lit(chunks)))
    done.append(write_shared(_flown(left.withColumn("chunk", F.lit(0).cast("long")), land=True), "landing", few=True))
    flown = done[0]
    for more in done[1:]:
        flown = flown.unionByName(more)
    out = flown.join(small(per), same)
    copies = (F.floor(ratio) + F.col("pick")).cast("int")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"),
                      (copies * F.col("size")).alias("taken"), "text_key")


def take(df: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text",
         source: str = "source") -> DataFrame:
    """The rows of the mix, in the columns of ``df``: each row as often as it was taken. Rows alike in id, source and
    text share their copies; the smallest of them by its other columns stands for all."""
    names = df.columns
    rows = df.withColumn("__key", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    wanted = mixed.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"),
                           F.col("text_key").alias("__text")).agg(F.sum("copies").alias("__copies"),
                                                                  F.count(F.lit(1)).alias("__rows"))
    wanted = write_shared(wanted.where("__copies > 0"), "wanted", few=True)
    on = (F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text"))
          & F.col(source).eqNullSafe(F.col("__source")))
    taken = rows.join(wanted.where("__rows = 1"), on).select(*names, "__copies")
    if not wanted.where("__rows > 1").isEmpty():
        alike = rows.join(wanted.where("__rows > 1"), on)
        one = alike.groupBy("__id", "__source", "__text", "__copies").agg(F.min(F.struct(*names)).alias("__row"))
        taken = taken.unionByName(one.select("__row.*", "__copies"))
    return taken.select(*names, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__nth")).select(*names)
