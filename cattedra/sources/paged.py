"""Paged JSON source.

The remote service answers ``{"data": [...], "next_page_url": "..."}`` pages,
1,000 records each, ``''`` on the last page. The rebuild reads *landed* pages
(files written by any fetcher): ``spark.read.json`` with an explicit schema and
``explode('data')``, one task per file, no driver-side concatenation. Page
chains are checked with joins, in both directions: every page that another
points to is there, every page but a first one is pointed to, and every page
says what follows (``''`` on the last).

For a live service, ``PagedAdoptionsSource`` is a Python Data Source whose
input partitions are the universities; each partition walks its own page
chain, so fetching is spread over executors (the reference uses 5 threads in
one process). It can start where an earlier walk stopped and say where each
record was found; ``streaming.paged_load`` loads what is new with that.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cattedra.schemas import ADOPTION_COLUMNS, WIDE_EXTRA_COLUMNS, all_string, conform, struct_for
from cattedra.session import stored

# --- Fixed values: page layout of the adoption service. ---
API_PAGE_SIZE = 1000
PAGE_DATA_FIELD = "data"
PAGE_NEXT_FIELD = "next_page_url"
LAST_PAGE_MARK = ""
FIRST_PAGE_MARK = "/0"     # how the url of a chain's first landed page ends
# --- end of fixed values ---

WIDE_RECORD = all_string(struct_for(ADOPTION_COLUMNS + WIDE_EXTRA_COLUMNS))
PAGE_SCHEMA = T.StructType([
    T.StructField("page_url", T.StringType()),
    T.StructField(PAGE_DATA_FIELD, T.ArrayType(WIDE_RECORD)),
    T.StructField(PAGE_NEXT_FIELD, T.StringType()),
])
#: Where a record was found: its university, the page's place in this walk and url, records of the page up to this batch.
TAGS = T.StructType([T.StructField("page_uni", T.StringType()), T.StructField("page_at", T.LongType()),
                     T.StructField("page_url", T.StringType()), T.StructField("page_seen", T.LongType())])
UNIVERSITY_SCHEMA = T.StructType([
    T.StructField("uni_cod", T.StringType()), T.StructField("uni_nome", T.StringType()),
    T.StructField("max", T.IntegerType()),
])


class BadPages(ValueError):
    """Landed pages that cannot be read, or whose chains are not whole."""


def read_pages(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Landed pages, one JSON document per file, pretty-printed or not; ``one_per_line`` for files of many pages. A page
    that is no JSON stops the read."""
    return (spark.read.schema(PAGE_SCHEMA).option("mode", "FAILFAST").option("multiLine", not one_per_line).json(path))


def records(pages: DataFrame) -> DataFrame:
    """The records of all pages (a bag, no order promise: S6)."""
    return pages.select(F.explode(PAGE_DATA_FIELD).alias("r")).select("r.*")


def broken_chains(pages: DataFrame, first_pages: DataFrame | None = None) -> DataFrame:
    """(page_url, problem) of what is wrong with the page chains; no row when all are whole.

    ``no url``: a page without its own url; ``no end mark``: ``next_page_url`` is NULL (the last page has ``''``);
    ``missing``: a page that another one points to, or a first page, is not there; ``unreached``: a page that no
    other points to and that is no first page (``first_pages``: page_url; by default urls that end in ``/0``)."""
    here = pages.select("page_url", F.col(PAGE_NEXT_FIELD).alias("next"))
    targets = here.where(F.col("next") != LAST_PAGE_MARK).select(F.col("next").alias("page_url")).distinct()
    firsts = (first_pages.select("page_url").distinct() if first_pages is not None
              else here.where(F.col("page_url").endswith(FIRST_PAGE_MARK)).select("page_url").distinct())
    urls = here.select("page_url").distinct()
    found = [here.where(F.col("page_url").isNull()).select("page_url", F.lit("no url").alias("problem")),
             here.where(F.col("next").isNull()).select("page_url", F.lit("no end mark").alias("problem")),
             targets.union(firsts).distinct().join(urls, "page_url", "left_anti").withColumn("problem", F.lit("missing")),
             urls.where(F.col("page_url").isNotNull()).join(targets, "page_url", "left_anti")
             .join(firsts, "page_url", "left_anti").withColumn("problem", F.lit("unreached"))]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def checked_pages(pages: DataFrame, first_pages: DataFrame | None = None) -> DataFrame:
    """``pages``, after a check that their chains are whole. The pages are parsed once for their links, which the check reads
    several times."""
    links = stored(pages.select("page_url", PAGE_NEXT_FIELD), "page-links")
    wrong = broken_chains(links, first_pages).limit(5).collect()
    if wrong:
        raise BadPages("; ".join(f"{r.page_url}: {r.problem}" for r in wrong))
    return pages


def load_adoptions(pages: DataFrame) -> DataFrame:
    """S5 + P1: records conformed to the 27 adoption columns (the wide 39-column
    layout narrows), typed leniently."""
    return conform(records(pages), "adozioni")


def read_universities(spark: SparkSession, path: str) -> DataFrame:
    """The landed university list ``{"data": [{uni_cod, uni_nome, max}]}``."""
    wrapped = T.StructType([T.StructField(PAGE_DATA_FIELD, T.ArrayType(UNIVERSITY_SCHEMA))])
    return spark.read.schema(wrapped).json(path).select(F.explode(PAGE_DATA_FIELD).alias("u")).select("u.*")


def universities_with_year(universities: DataFrame, year: int) -> DataFrame:
    """Universities whose latest year is at least ``year``."""
    return universities.filter(F.col("max") >= F.lit(int(year)))


# ---------------------------------------------------------------- live source
try:  # Python Data Source API (Spark 4)
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class _UniPartition(InputPartition):
        def __init__(self, uni: str):
            super().__init__(uni)
            self.uni = uni

    class _PagedReader(DataSourceReader):
        def __init__(self, options: dict[str, str], schema: T.StructType):
            self.options = options
            self.schema = schema

        def partitions(self) -> Sequence[InputPartition]:
            unis = json.loads(self.options.get("universities", "[]"))
            return [_UniPartition(u) for u in dict.fromkeys(unis)]

        def read(self, partition) -> Iterator[pa.RecordBatch]:
            """One Arrow batch per page of the university's chain, from its position on."""
            import urllib.parse
            import urllib.request

            base = self.options["url"]
            params = json.loads(self.options.get("params", "{}"))
            params["uni_cod"] = partition.uni
            first = base + urllib.parse.urlencode(params)
            url, skip = json.loads(self.options.get("positions", "{}")).get(partition.uni) or (first, 0)
            names, at = [f.name for f in self.schema.fields if f.name not in TAGS.names], 0
            tagged = len(names) < len(self.schema.fields)
            while url:
                with urllib.request.urlopen(url, timeout=float(self.options.get("timeout", "60"))) as r:
                    page = json.loads(r.read().decode("utf-8"))
                rows = page.get(PAGE_DATA_FIELD) or []
                if len(rows) < skip:
                    raise BadPages(f"{url}: {len(rows)} records, {skip} were read before")
                new = rows[skip:]
                if new:
                    columns = [pa.array([None if r.get(n) is None else str(r[n]) for r in new], pa.string()) for n in names]
                    if tagged:
                        columns += [pa.array([x] * len(new), t) for x, t in ((partition.uni, pa.string()), (at, pa.int64()),
                                                                             (url, pa.string()), (len(rows), pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=names + TAGS.names * tagged)
                if page.get(PAGE_NEXT_FIELD) is None:
                    raise BadPages(f"{url}: no end mark")
                url, skip, at = page[PAGE_NEXT_FIELD], 0, at + 1

    class PagedAdoptionsSource(DataSource):
        """``spark.read.format('paged_adoptions').option('url', ...)
        .option('universities', json list).option('params', json object)``.

        ``positions`` (json object): university -> [url, records of that page to skip], where its walk starts; others start
        at their first page. ``tagged`` (true): the columns of ``TAGS`` follow."""

        @classmethod
        def name(cls) -> str:
            return "paged_adoptions"

        def schema(self) -> T.StructType:
            return T.StructType(WIDE_RECORD.fields + TAGS.fields * (self.options.get("tagged") == "true"))

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _PagedReader(self.options, schema)

    def register_paged_source(spark: SparkSession) -> None:
        spark.dataSource.register(PagedAdoptionsSource)

except ImportError:  # pragma: no cover - older Spark
    PagedAdoptionsSource = None

    def register_paged_source(spark: SparkSession) -> None:
        raise RuntimeError("the Python Data Source API needs Spark 4")
