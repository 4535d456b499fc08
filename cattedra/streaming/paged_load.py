"""Loading what is new in the paged service (S5, S6 by increments).

Each university has a position: the last page with records that was read, and how many of its records. A run reads every
chain from there, in one task for each university: records added to that page, then the pages after it. Rows and new
positions become visible by one pointer of the table store, so each record is loaded once, whatever run, task or executor
is lost in between. A run that finds the positions moved by another one starts again from the new ones.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cattedra.session import remove_path
from cattedra.sources.files import load_api_pages
from cattedra.sources.paged import TAGS, register_paged_source
from cattedra.sources.versions import TableStore

TABLE, POSITIONS = "adozioni", "page_positions"
POSITION_SCHEMA = "uni_cod string, page_url string, seen long"


class _Moved(Exception):
    pass


def positions(store: TableStore, version: int | None = None) -> DataFrame:
    """uni_cod, page_url, seen: one row for each university that had records."""
    known = store.version() if version is None else version
    if POSITIONS not in store.state(known)["tables"]:
        return store.spark.createDataFrame([], POSITION_SCHEMA)
    return store.read(POSITIONS, version=known)


def load_new_pages(store: TableStore, url: str, universities: Sequence[str], params: dict[str, Any] | None = None) -> int:
    """Append the new records, cleaned and without repeats inside the run (A6), to the adoptions of ``store``; the version
    that holds them, or the present one if nothing is new.

    A chain without an end mark, or a page with fewer records than were read from it, stops the run and loads nothing."""
    while True:
        try:
            return _run(store, url, universities, params or {})
        except _Moved:
            continue


def _run(store: TableStore, url: str, universities: Sequence[str], params: dict[str, Any]) -> int:
    spark, version = store.spark, store.version()
    known, held = positions(store, version), store.state(version)["tables"].get(POSITIONS, [])
    register_paged_source(spark)
    start = {r.uni_cod: [r.page_url, r.seen] for r in known.collect()}  # one row a university, like the option's list
    found = (spark.read.format("paged_adoptions").option("url", url).option("tagged", "true")
             .option("universities", json.dumps(list(universities))).option("params", json.dumps(params))
             .option("positions", json.dumps(start)).load())
    batch, _ = store.stage(found, "page_batch")  # fetched once: rows and positions come from the same pages
    try:
        new = spark.read.schema(found.schema).parquet(f"{store.root}/{batch}")
        if new.isEmpty():
            return version
        last = new.groupBy(F.col("page_uni").alias("uni_cod")).agg(
            F.max_by(F.struct("page_url", F.col("page_seen").alias("seen")), "page_at").alias("x")).select("uni_cod", "x.*")
        moved = last.unionByName(known.join(last, "uni_cod", "left_anti"))
        staged = {TABLE: store.stage(store.shaped(load_api_pages(new.drop(*TAGS.names)), TABLE), TABLE),
                  POSITIONS: store.stage(moved, POSITIONS)}
    finally:
        remove_path(spark, f"{store.root}/{batch}")

    def apply(state: dict) -> None:
        if state["tables"].get(POSITIONS, []) != held:
            raise _Moved
        state["tables"][TABLE] = [*state["tables"].get(TABLE, []), staged[TABLE][0]]
        state["tables"][POSITIONS] = [staged[POSITIONS][0]]
        for name, (_, schema) in staged.items():
            state["schemas"].setdefault(name, schema)

    return store.change(apply)
