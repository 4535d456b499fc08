"""A stored table that is edited by row id (M1-M4, D2): only the touched blocks of ids are written anew.

Rows lie in blocks of ``block`` consecutive ids, a folder each, in a ``TableStore``. An edit finds the blocks of the ids that it
changes, reads these alone, writes them as new folders and switches the pointer; the folders of all other blocks stay as they
are, and older versions stay readable. The cost of an edit goes with the blocks it touches, not with the table.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cattedra.operators import changes as chg
from cattedra.sources.versions import TableStore

BLOCK = 1_000_000
_BLOCK = "id_block"


class IdTable:
    def __init__(self, spark: SparkSession, root: str, name: str, key: str = "record_id", block: int = BLOCK):
        self.spark, self.store, self.name, self.key, self.block = spark, TableStore(spark, root), name, key, block

    def read(self, version: int | None = None) -> DataFrame:
        return self.store.read(self.name, version)

    def _block(self):
        return F.floor(F.col(self.key) / F.lit(self.block)).cast("long")

    def _stage(self, df: DataFrame) -> list[str]:
        """Write rows by block; the folders. Rows are dealt by ranges of ids, so a task writes few blocks, each sorted by id."""
        folder = f"{self.name}/{os.urandom(8).hex()}"
        ranged = df.withColumn(_BLOCK, self._block()).repartitionByRange(self.key).sortWithinPartitions(_BLOCK, self.key)
        ranged.write.mode("errorifexists").partitionBy(_BLOCK).parquet(f"{self.store.root}/{folder}")
        top = self.store._path(f"{self.store.root}/{folder}")
        names = [s.getPath().getName() for s in self.store._files(top).listStatus(top)]
        return sorted(f"{folder}/{n}" for n in names if n.startswith(f"{_BLOCK}="))

    def write(self, df: DataFrame) -> int:
        """Store all rows. Each has an id (``changes.with_ids`` gives them)."""
        folders = self._stage(df)

        def apply(state: dict) -> None:
            state["tables"][self.name] = folders
            state["schemas"][self.name] = df.schema.json()

        return self.store.change(apply)

    def _switch(self, remove: DataFrame, add: DataFrame) -> int:
        """Take the rows of the ids ``remove`` out and put the rows ``add`` in."""
        now = self.store.state()
        held, schema = now["tables"].get(self.name, []), self.store.schema(self.name, now)
        of = lambda folder: int(folder.rpartition("=")[2])
        blocks = remove.select(self.key).unionByName(add.select(self.key)).select(self._block().alias("b")).distinct()
        touched = {r.b for r in blocks.collect()}  # blocks, of which the pointer has one line each
        old = [f for f in held if of(f) in touched]
        rows = (self.spark.read.schema(schema).parquet(*[f"{self.store.root}/{f}" for f in old]) if old
                else self.spark.createDataFrame([], schema))
        fresh = self._stage(chg.delete_by_id(rows, remove, self.key).unionByName(add.select(*schema.fieldNames())))

        def apply(state: dict) -> None:
            if not set(old) <= set(state["tables"].get(self.name, [])):
                raise RuntimeError(f"{self.name} was edited at the same time in the same blocks")
            state["tables"][self.name] = [*[f for f in state["tables"][self.name] if f not in old], *fresh]

        return self.store.change(apply)

    def _of_ids(self, ids: DataFrame) -> DataFrame:
        """The stored rows of some ids, from the blocks that hold them."""
        blocks = {r.b for r in ids.select(self._block().alias("b")).distinct().collect()}
        found = [f for f in self.store.state()["tables"].get(self.name, []) if int(f.rpartition("=")[2]) in blocks]
        if not found:
            return self.read().limit(0)
        rows = self.spark.read.schema(self.store.schema(self.name)).parquet(*[f"{self.store.root}/{f}" for f in found])
        return rows.join(ids.select(self.key).distinct(), self.key, "left_semi")

    def update(self, changes: DataFrame, set_columns: Sequence[str] = ()) -> int:
        """M2/M6: see ``changes.update_by_id``. Ids that the table has not are passed over."""
        rows = self._of_ids(changes)
        return self._switch(rows, chg.update_by_id(rows, changes, self.key, set_columns))

    def delete(self, ids: DataFrame) -> int:
        """M3."""
        return self._switch(self._of_ids(ids), self.read().limit(0))

    def insert(self, rows: DataFrame, required: str = "insegnamento_prof") -> int:
        """M4: new ids follow the largest; only the last blocks are touched. Rows without the mandatory name are left out."""
        ok = rows.where(F.col(required).isNotNull() & (F.trim(required) != ""))
        held = self.store.state()["tables"].get(self.name, [])
        last = sorted(held, key=lambda f: int(f.rpartition("=")[2]))[-1:]
        # the largest id is in the last block
        top = (self.spark.read.schema(self.store.schema(self.name)).parquet(*[f"{self.store.root}/{f}" for f in last])
               if last else self.read())
        numbered = chg.assign_ids(top, ok if self.key in ok.columns else ok.withColumn(self.key, F.lit(None).cast("bigint")), self.key)
        return self._switch(self.read().limit(0), numbered)

    def upsert(self, rows: DataFrame, key: Sequence[str] = chg.UPSERT_KEY, mode: str = "as_is") -> int:
        """M1, stored (D2): see ``changes.upsert``. Of each ``key`` among the new rows one row stays; a new row that wins takes
        the smallest id that its key had, or a new one. Other keys, and their blocks, are left alone."""
        keys = rows.select(*key).distinct()
        same = [F.col(f"_k.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in key]
        on = same[0]
        for c in same[1:]:
            on = on & c
        old = self.read().alias("_r").join(keys.alias("_k"), on, "left_semi")
        had = old.groupBy(*key).agg(F.min(self.key).alias("_had"))
        won = chg.upsert(rows.drop(self.key), old, key, mode, self.key)
        merged = won.alias("_r").join(had.alias("_k"), on, "left").select(
            *[F.coalesce(F.col(f"_r.{self.key}"), F.col("_had")).alias(self.key) if c == self.key else F.col(f"_r.{c}") for c in self.read().columns])
        return self._switch(old, chg.assign_ids(self.read(), merged, self.key))
