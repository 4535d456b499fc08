"""SimHash near-dedup through a segment-popcount embedding.

A fingerprint has 64 bits; a bit is set if it is set in over half of the XXH64 hashes (seed 42) of the text's
``shingle``-word shingles, repeats included. Two fingerprints link at ``max_bits`` differing bits or fewer.

Embedding: the fingerprint is cut into 16 segments of 4 bits, and the number of set bits of each segment is one of 16
coordinates, packed into one long. Flipping one bit moves one coordinate by one, so the Manhattan distance of two
embeddings is a lower bound of the bit distance. Range join on the unit grid: every fingerprint is entered at its own
grid point and at all points within half of ``max_bits``; two fingerprints within ``max_bits`` share such a point. The
join on grid points then checks the bit distance exactly. A pair that meets at several points is taken at one of them,
two at most.

Equal fingerprints are one class, so a group of copies is one row before the join. Links between classes go through
min-label rounds with pointer jumping; each round is a written table. Nothing is collected on the driver but a count.

Texts without words have fingerprint zero and link like any other. Null ids have their class but never name a component
(a component of null ids only has a null id). Repeated rows stay. An empty table gives an empty result. Extra columns
stay; those named fingerprint or component_id are replaced.
Ids (doc_id) are whole numbers within a long, or texts of such; any other id stops the query.
"""

from __future__ import annotations

import re
from itertools import combinations_with_replacement, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cattedra.llm.common import WORD_PATTERN, lower_text, no_clash, ship, slices, write_shared

SEED = 42
_WORD = re.compile(WORD_PATTERN.encode())
_LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are counted at once; bounds the memory for any length of text.
_BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    # in UTF-8 the bytes of A-Z and of white space occur in no other character
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOW)
    words = words.translate(_SPACES).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    a, b = starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a))
    set_in = np.zeros(64, np.int64)
    for k in range(0, len(h), _BLOCK):
        bits = np.unpackbits(h[k:k + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        set_in += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_in * 2 > len(h)).tobytes(), "big")


#: Bytes that separate words become blanks; bytes.split() by itself would take the same six.
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def with_fingerprint(df: DataFrame, text: str = "text", shingle: int = 3, name: str = "fp") -> DataFrame:
    """Append the fingerprint as a signed long."""
    ship(df.sparkSession)
    base = no_clash(df, name)
    schema = T.StructType([*base.schema.fields, T.StructField(name, T.LongType())])

    def run(batches):
        for part in slices(batches, text):
            texts = part.column(part.schema.get_field_index(text)).to_pylist()
            fps = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps.view(np.int64))], names=schema.fieldNames())

    return base.mapInArrow(run, schema)


def embed(fp: Column) -> Column:
    """Set bits of each 4-bit segment, in the same 4 bits (0 to 4)."""
    odd = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    two = F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseXOR(b))  # sums of two bits, without carry into the sign
    mask = F.lit(0x3333333333333333)
    return two.bitwiseAND(mask) + F.shiftrightunsigned(two, 2).bitwiseAND(mask)


def grid_steps(radius: int) -> list[tuple[tuple[int, int], ...]]:
    """Moves within Manhattan distance ``radius`` of the origin, as ((coordinate, step), ...)."""
    moves = {()}
    for r in range(1, radius + 1):
        for axes in combinations_with_replacement(range(16), r):
            for signs in product((1, -1), repeat=r):
                step: dict[int, int] = {}
                for axis, sign in zip(axes, signs):
                    step[axis] = step.get(axis, 0) + sign
                moves.add(tuple(sorted((k, v) for k, v in step.items() if v)))
    return sorted(moves)


def grid_points(cell: Column, radius: int) -> Column:
    """Array of the grid points within ``radius``; points outside 0..4 are left out, as no embedding lies there
    (a shortest way between two embeddings never leaves the range)."""
    points = []
    for move in grid_steps(radius):
        inside, point = F.lit(True), cell
        for axis, step in move:
            at = F.shiftrightunsigned(cell, 4 * axis).bitwiseAND(F.lit(15)) + F.lit(step)
            inside = inside & at.between(0, 4)
            point = point + F.lit(_signed(step << (4 * axis)))
        points.append(F.when(inside, point) if move else point)
    return F.array_compact(F.array(*points))


def _signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def links(classes: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints ``fp`` within ``max_bits`` bits, each once."""
    cell = embed(F.col("fp"))
    entries = classes.select("fp", cell.alias("cell")).select(
        "fp", "cell", F.explode(grid_points(F.col("cell"), -(-max_bits // 2))).alias("point"))
    a = entries.select(F.col("fp").alias("a"), F.col("cell").alias("ca"), F.col("point").alias("pa"))
    b = entries.select(F.col("fp").alias("b"), F.col("cell").alias("cb"), F.col("point").alias("pb"))
    met = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    if max_bits <= 2:
        # same embedding: at that point; one apart: at a's point; two apart: at a point between
        met = met & ((F.col("pa") == F.col("ca"))
                     | ((F.col("ca") != F.col("cb")) & (F.col("pa") != F.col("cb"))))
    # Spark sizes the points by their classes, as before the explode, and would broadcast them
    return a.join(b.hint("merge"), (F.col("pa") == F.col("pb")) & met).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for every end of the edges (a, b): root is the smallest fp of its component, as a signed long."""
    edges = write_shared(edges, "links", few=True)
    both = write_shared(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links-both", few=True)
    labels = write_shared(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
                          .select(F.col("a").alias("fp"), "root"), "labels", few=True)
    while True:
        # smallest label among neighbours
        near = (both.join(labels, both["b"] == labels["fp"]).groupBy("a").agg(F.min("root").alias("near")))
        lower = labels.join(near, labels["fp"] == near["a"]).select("fp", F.col("root").alias("was"),
                                                                    F.least("root", "near").alias("root"))
        lower = write_shared(lower, "labels", few=True)
        # pointer jumping: the label of the label
        up = lower.select(F.col("fp").alias("p"), F.col("root").alias("up"))
        jumped = write_shared(lower.join(up, lower["root"] == up["p"]).select("fp", "was", F.least("root", "up").alias("root")),
                              "labels", few=True)
        moved = not jumped.where("root < was").isEmpty()
        labels = jumped.select("fp", "root")
        if not moved:
            return labels


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                    max_bits: int = 2) -> DataFrame:
    """One row per input row: doc_id, text_key (hash of the text), fp, component_id (the smallest doc_id reachable over
    links) and stays_key (the text_key of the row that stands for the component)."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(content).alias("text_key"),
                     F.col(text).alias("text"))
    prints = write_shared(with_fingerprint(rows, "text", shingle).select("doc_id", "text_key", "fp"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    classes = write_shared(prints.groupBy("fp").agg(first), "classes", few=True)
    roots = components(links(classes, max_bits)).withColumnRenamed("fp", "f")
    named = write_shared(classes.join(roots, F.col("fp") == F.col("f"), "left")
                         .select("fp", "first", F.coalesce("root", "fp").alias("root")), "class-roots", few=True)
    least = named.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("least"))
    per_class = write_shared(named.join(least, F.col("root") == F.col("r")).select(
        F.col("fp").alias("f"), F.col("least.doc_id").alias("component_id"), F.col("least.text_key").alias("stays_key")),
        "class-components", few=True)
    return prints.join(per_class, F.col("fp") == F.col("f")).drop("f")


def keep_one(df: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stand for their component; of rows alike in id and text one stays (the smallest by the
    other columns)."""
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("stays_key")))
    stays = write_shared(stays.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text"))
                         .agg(F.count(F.lit(1)).alias("__rows")), "stays", few=True)
    rows = df.withColumn("__key", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    on = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text"))
    out = rows.join(stays.where("__rows = 1"), on, "left_semi").select(*df.columns)
    if not stays.where("__rows > 1").isEmpty():
        alike = rows.join(stays.where("__rows > 1"), on)
        one = alike.groupBy("__id", "__text").agg(F.min(F.struct(*df.columns)).alias("__row"))
        out = out.unionByName(one.select("__row.*"))
    return out
