"""Composite reports (Q1-Q7, Q10, Q11) built from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cattedra.functions import academic_year, isbn13, isbn13_valid, name_key
from cattedra.operators import aggregates as agg
from cattedra.operators import listings as lst
from cattedra.operators import select as sel
from cattedra.operators import setops
from cattedra.schemas import LOG
from cattedra.session import scratch_path, stored
from cattedra.sources.versions import TableStore


# ----------------------------------------------------------------- Q1
class SelectionSession:
    """Q1 progressive selection with a log (W2), kept in a store that survives the driver.

    The selection (``adozioni_res``) and the log (``msg``) are tables of a ``TableStore`` under ``root``. A step filters the
    active set (S9) and switches to the new selection and the longer log at once; older selections stay readable by
    their version. An empty step empties the selection, so the next step restarts from all adoptions. A session
    opened on the same root goes on where the last one stopped.
    """

    #: Log folders (one a step) from which on they are written as one.
    LOG_FOLDERS = 64

    def __init__(self, spark: SparkSession, base: DataFrame, root: str | None = None):
        self.spark, self.base = spark, base
        self.store = TableStore(spark, root or scratch_path(spark, "selection"))
        if not self.store.version():
            self.store.create(("adozioni_res", "msg"))

    @property
    def root(self) -> str:
        return self.store.root

    def log(self) -> DataFrame:
        """The log as a table: date, message, q."""
        return self.store.read("msg")

    def feed(self) -> DataFrame:
        """The log, newest first."""
        return self.log().orderBy(F.col("date").desc(), F.col("q").desc())

    def last(self):
        """The newest row of the log (None before the first step)."""
        return self.log().agg(F.max(F.struct("q", "date", "message")).alias("last")).first().last

    def _entry(self, message: str, when: datetime | None) -> DataFrame:
        last = self.last()
        q = last.q + 1 if last else 0
        # steps without a time follow the last one by a second, so newest-first is the step order
        return self.spark.createDataFrame([(when or (last.date + timedelta(seconds=1) if last else datetime(2000, 1, 1)), message, q)], LOG)

    def step(self, column: str, keys: Sequence[Any] | DataFrame, message: str | None = None,
             when: datetime | None = None) -> DataFrame:
        text = message or f"{column}: {list(keys) if not isinstance(keys, DataFrame) else 'keys'}"
        chosen = sel.select_by(self.active(), column, keys)
        version = self.store.commit({"adozioni_res": ("replace", chosen), "msg": ("append", self._entry(text, when))})
        if len(self.store.state()["tables"]["msg"]) > self.LOG_FOLDERS:
            self.store.compact("msg")
        return self.store.read("adozioni_res", version)

    def reset(self, when: datetime | None = None) -> None:
        """K6 (a): clear selection and log; the log restarts with q = 0."""
        self.store.reset("selection", when)

    def active(self) -> DataFrame:
        return sel.active_set(self.base, self.store.read("adozioni_res"))


# ----------------------------------------------------------------- Q2
@dataclass
class Dashboard:
    adoptions: DataFrame
    lecturers: DataFrame
    students: DataFrame
    summary: DataFrame
    values: DataFrame


#: What the parts of the dashboard read of the active set.
_DASHBOARD_COLUMNS = list(dict.fromkeys([*lst.LISTINGS["dashboard_adoptions"], *lst.LISTINGS["dashboard_lecturers"], *agg.DEGREE_BOOK_KEY,
                                         "autori", "curatori", "titolo", "editore", *agg.SUMMARY_COLUMNS]))


def dashboard(active: DataFrame) -> Dashboard:
    """Q2: L5, L6, students per book (A1 + J3) and the summary (A3).

    The five parts read one stored copy of the active set, which is evaluated once, with the columns they need."""
    rows = stored(active.select(*_DASHBOARD_COLUMNS), "dashboard")
    return Dashboard(
        adoptions=lst.listing(rows, "dashboard_adoptions"),
        lecturers=lst.listing(rows, "dashboard_lecturers"),
        students=agg.students_per_book(rows),
        summary=agg.summary_counts(rows),
        values=agg.distinct_values(rows),
    )


# ----------------------------------------------------------------- Q3
def new_adoption_report(active: DataFrame, year: int, params: Sequence[tuple[str, Any]] = (),
                        key: Sequence[str] = setops.NEW_ADOPTION_KEY) -> DataFrame:
    """Q3: L7 base of years y and y-1 under the optional filters (substring for
    degree, lecturer and title; equality for the rest), then U1."""
    base = lst.listing(active, "new_adoption_base").filter(sel.year_window(year))
    base = sel.where_params(base, [p for p in params if p[0] != "a_a"], contains=sel.NEW_ADOPTION_CONTAINS)
    return setops.new_adoptions(base, year, key)


# ----------------------------------------------------------------- Q5
@dataclass
class SampleCopyDashboard:
    rows: DataFrame
    summary: DataFrame
    page: lst.Page


def sample_copy_dashboard(contacts: DataFrame, selected: DataFrame, page: Any = 1,
                          order_col: str = "record_id") -> SampleCopyDashboard:
    """Q5: contacts (or the selected lecturers when there are none), one per
    (lecturer, isbn), ordered by lecturer, summary, 20 per page. The rows are
    worked out once and stored in order; listing, summary and page read them."""
    src = sel.active_set(selected, contacts)
    if order_col not in src.columns:
        src = src.withColumn(order_col, F.xxhash64(*src.columns))
    rows = agg.first_contact_per_pair(src, order_col).drop(order_col)
    stored = lst.store_ranked(rows, first=["insegnamento_prof"])
    return SampleCopyDashboard(lst.by_lecturer(stored.frame()), agg.summary_counts(stored.frame()),
                               stored.page(page, lst.CONTACT_PAGE_SIZE))


def select_contacts(contacts: DataFrame, selected: DataFrame, names: Sequence[str]) -> DataFrame:
    """rows of the contacts (or of the selected lecturers when there are no
    contacts yet) whose lecturer is one of ``names``; the caller appends them
    to the contacts (K2 append) and exports them (K1)."""
    src = sel.active_set(selected, contacts)
    return sel.select_by(src, "insegnamento_prof", list(names))


# ----------------------------------------------------------------- Q6
def drilldown(adoptions: DataFrame, column: str, value: str, on: str) -> DataFrame:
    """Q6: adoptions of one lecturer or one book in the academic year of the
    date ``on`` (a parameter, never the clock); all universities (D9)."""
    year = academic_year(F.to_date(F.lit(on)))
    return adoptions.filter((F.col(column) == F.lit(value)) & (F.col("a_a") == year)) \
        .select(*lst.LISTINGS["dashboard_adoptions"])


# ----------------------------------------------------------------- Q10
def courses_of_lecturer(adoptions: DataFrame, directory: DataFrame, name: str) -> DataFrame:
    """Q10 + U3: (uni_cod, materia_nome) of a lecturer in adoptions UNION the
    directory, matching the order-free name key."""
    k = name_key(F.lit(name))
    a = adoptions.filter(name_key("insegnamento_prof") == k).select("uni_cod", "materia_nome")
    d = directory.filter(name_key("insegnamento_prof") == k).select("uni_cod", "materia_nome")
    return setops.union_distinct(a, d)


# ----------------------------------------------------------------- Q11
def isbn_quality(df: DataFrame, isbn_col: str, group_col: str) -> DataFrame:
    """Q11 + C15: canonical 13 digits, then converted / valid / invalid counts."""
    # project the normalised value and the flags once, then aggregate them
    norm = df.select(group_col, F.col(isbn_col).alias("_raw"), isbn13(isbn_col).alias("_norm"))
    flags = norm.select(group_col, F.coalesce(F.col("_norm") != F.col("_raw"), F.lit(False)).alias("_conv"),
                        isbn13_valid("_norm").alias("_valid"))
    one = F.lit(1)
    return flags.groupBy(group_col).agg(
        F.count(one).alias("n_books"),
        F.sum(F.when(F.col("_conv"), one).otherwise(0)).alias("n_converted"),
        F.sum(F.when(F.col("_valid"), one).otherwise(0)).alias("n_valid"),
        F.sum(F.when(F.col("_valid"), 0).otherwise(one)).alias("n_invalid"),
    )


# ----------------------------------------------------------------- W2/T3
def latest_log_entry(log: DataFrame, tenant_col: str = "tenant_id") -> DataFrame:
    """T3 per tenant: newest row (date, then id) and the next step number.

    One aggregation (partial on the map side): no sort of a whole tenant."""
    latest = F.max(F.struct("date", "event_id", "message")).alias("_last")
    out = log.groupBy(tenant_col).agg(latest, F.count(F.lit(1)).alias("next_q"))
    return out.select(tenant_col, F.col("_last.event_id").alias("last_event_id"),
                      F.col("_last.message").alias("last_message"), "next_q")


def log_feed(log: DataFrame) -> DataFrame:
    """The log, newest first."""
    return lst.newest_first(log, "date")


__all__ = ["SelectionSession", "Dashboard", "dashboard", "new_adoption_report", "sample_copy_dashboard",
           "select_contacts", "drilldown", "courses_of_lecturer", "isbn_quality", "latest_log_entry", "log_feed"]
