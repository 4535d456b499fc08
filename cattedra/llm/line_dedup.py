"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

A line's key is the line stripped of ASCII white space and with A-Z lower-cased, hashed to 128 bits. A *run* is a
stored table of (h1, h2, n_docs) sorted by hash: how many documents of one or more batches hold the line. Each new batch

1. counts its keys once per document (a partial aggregate comes before the shuffle, so one very common line is one row
   for each task),
2. merge-anti-joins the keys that the stored runs have already settled, that is, found in ``min_docs`` documents,
3. adds what is left as a run of level 0.

When a level holds ``fanout`` runs they are merged into one run of the next level and the old ones are deleted, so any
key is rewritten once per level. ``common`` merges all runs into the keys of ``min_docs`` documents or more.

Texts: null or empty is one empty line. Lines whose key is shorter than ``min_key`` code points are never dropped.
Every row counts as a document, repeated rows too; rows alike in id and text get the same result. Empty tables give
empty results. Extra columns stay; those named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cattedra.llm.common import BLANKS, ascii_lower, fewer_files, no_clash, remove_shared, shared_folder, write_shared

_RUN = "h1 long, h2 long, n_docs long"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(text: Column, min_key: int) -> Column:
    """Array of (h1, h2) per line, null where the line's key is too short to be dropped."""
    def one(line: Column) -> Column:
        key = F.btrim(line, F.lit(BLANKS))
        return F.when(F.char_length(key) >= min_key,
                      F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")))

    return F.transform(_lines(ascii_lower(text)), one)


class LineRuns:
    """The levelled runs, in a shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_key: int = 1, fanout: int = 2):
        self.spark, self.min_docs, self.min_key, self.fanout = spark, min_docs, min_key, fanout
        self.folder = shared_folder(spark, "line-runs")
        self.levels: list[list[str]] = []
        self.made = 0

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(_RUN).parquet(*paths)

    def _store(self, run: DataFrame, level: int) -> None:
        path = f"{self.folder}/level-{level}/run-{self.made}"
        self.made += 1
        fewer_files(run).sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        full = self.levels[level]
        if len(full) >= self.fanout:
            merged = self._read(full).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))
            self.levels[level] = []
            self._store(merged, level + 1)
            for old in full:
                remove_shared(self.spark, old)

    def add(self, batch: DataFrame, text: str = "text") -> None:
        """Count a batch of documents and add its run."""
        keys = batch.select(F.explode(F.array_distinct(_hashes(F.col(text), self.min_key))).alias("k")).where("k is not null")
        run = keys.groupBy("k.h1", "k.h2").agg(F.count(F.lit(1)).alias("n_docs"))
        stored = [p for level in self.levels for p in level]
        if stored:
            settled = self._read(stored).where(F.col("n_docs") >= self.min_docs).select("h1", "h2").distinct()
            run = run.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        self._store(run, 0)

    def common(self) -> DataFrame:
        """Keys (h1, h2) found in ``min_docs`` documents or more, over all runs."""
        stored = [p for level in self.levels for p in level]
        if not stored:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        many = self._read(stored).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n")).where(F.col("n") >= self.min_docs)
        return write_shared(many.select("h1", "h2"), "common-lines", few=True)


def batches_of(df: DataFrame, n: int, doc_id: str = "doc_id", text: str = "text") -> list[DataFrame]:
    """``n`` disjoint batches that make up ``df``, by a hash of the id."""
    part = F.pmod(F.xxhash64(F.lit("batch"), F.col(doc_id)), F.lit(n))
    return [df.where(part == i) for i in range(n)]


def drop_common_lines(df: DataFrame, common: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      min_key: int = 1) -> DataFrame:
    """Append n_lines, n_dropped and kept_text (the lines that stay, joined by a line feed; null if no line stays).

    Only (document, position) of common lines are gathered per document; kept lines never leave their row.
    """
    base = no_clash(df, "n_lines", "n_dropped", "kept_text")
    content = F.coalesce(F.col(text), F.lit(""))
    rows = base.select("*", F.col(doc_id).alias("__id"), F.xxhash64(content).alias("__text"))
    spots = rows.select("__id", "__text", F.posexplode(_hashes(F.col(text), min_key)).alias("at", "k"))
    spots = spots.where("k is not null").select("__id", "__text", "at", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
    dropped = (spots.join(common, ["h1", "h2"], "left_semi").groupBy("__id", "__text")
               .agg(F.collect_set("at").alias("__drop"))  # positions in one document: repeated rows add nothing
               .withColumnsRenamed({"__id": "__i", "__text": "__t"}))
    rows = rows.withColumn("__lines", _lines(F.col(text)))
    joined = rows.join(dropped, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__text") == F.col("__t")), "left")
    # array_except hashes, so this is linear in the number of lines
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n")
    none = F.col("__drop").isNull()
    return joined.select(
        *base.columns, F.size("__lines").cast("long").alias("n_lines"),
        F.when(none, F.lit(0)).otherwise(F.size("__drop")).cast("long").alias("n_dropped"),
        F.when(none, F.coalesce(F.col(text), F.lit("")))
        .when(F.size("__drop") < F.size("__lines"), kept).alias("kept_text"))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_key: int = 1,
                batches: int = 3, fanout: int = 2) -> DataFrame:
    """Drop the lines found in ``min_docs`` documents or more, from every document."""
    runs = LineRuns(df.sparkSession, min_docs, min_key, fanout)
    for batch in batches_of(df, batches, doc_id):
        runs.add(batch, text)
    return drop_common_lines(df, runs.common(), doc_id, text, min_key)
