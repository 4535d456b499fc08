"""Operators on tiny frames: nulls, duplicates, hot keys, and properties."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cattedra.operators import aggregates as agg
from cattedra.operators import changes as chg
from cattedra.operators import directory as dirs
from cattedra.operators import listings as lst
from cattedra.operators import select as sel
from cattedra.operators import setops
from cattedra.operators.dedup import asc, desc, keep_first
from cattedra.operators.numbering import with_global_index, with_group_index
from cattedra.operators.resolve import resolve_adoptions, resolve_contacts
from cattedra.schemas import ADOPTION_COLUMNS, CONTACT_COLUMNS, DIRECTORY, conform, struct_for
from tests.conftest import rows

ADO_SMALL = "uni_cod string, a_a int, laurea_nome string, isbn string, laurea_matricole bigint, " \
            "titolo string, autori string, curatori string, editore string, insegnamento_prof string, " \
            "materia_ssd_cod string, prof_id bigint, insegnamento_id bigint"


def ado(spark, data):
    return conform(spark.createDataFrame(data, ADO_SMALL), "adozioni")


def test_students_per_book_counts_degree_once_and_spellings(spark):
    df = ado(spark, [
        # same degree and book under two courses: counted once
        ("U1", 2024, "Fisica", "111", 50, "Analisi", "A", "C", "E", "x", "MAT/05", 1, 10),
        ("U1", 2024, "Fisica", "111", 50, "Analisi", "A", "C", "E", "y", "MAT/05", 2, 11),
        # same degree, next year, same enrolment: still once; different enrolment: twice
        ("U1", 2025, "Fisica", "111", 50, "Analisi", "A", "C", "E", "x", "MAT/05", 1, 12),
        ("U2", 2025, "Chimica", "111", 30, "Analisi I", "A", "C", "E", "z", "MAT/05", 3, 13),
        # null curatori -> autore NULL; null isbn never joins
        ("U1", 2024, "Fisica", "222", None, "Algebra", "B", None, "E", "x", "MAT/02", 1, 10),
        ("U1", 2024, "Fisica", None, 20, "Nulla", "B", "C", "E", "x", "MAT/02", 1, 10),
    ])
    out = rows(agg.students_per_book(df))
    assert out == [("111", "Analisi", "A C", "E", 80), ("111", "Analisi I", "A C", "E", 80),
                   ("222", "Algebra", None, "E", None)]


def test_summary_ignores_nulls(spark):
    df = ado(spark, [("U1", 2024, "F", "1", 1, "t", "a", "c", "e", "x", "S1", 1, 1),
                     ("U1", 2024, "F", None, 1, "t", "a", "c", "e", None, "S1", 1, 1),
                     ("U2", 2024, "F", "1", 1, "t", "a", "c", "e", "x", "S2", 1, 1)])
    r = agg.summary_counts(df).collect()[0].asDict()
    assert r["isbn_count"] == 2 and r["isbn_unique"] == 1 and r["uni_cod_unique"] == 2
    assert r["insegnamento_prof_count"] == 2
    assert rows(agg.distinct_values(df)) == [("materia_ssd_cod", "S1"), ("materia_ssd_cod", "S2"), ("uni_cod", "U1"),
                                             ("uni_cod", "U2")]
    assert agg.summary_counts(df.limit(0)).collect()[0]["isbn_count"] == 0


def test_keep_first_hot_key_nulls_and_ties(spark):
    data = [(1 if i % 3 else None, i, f"n{i % 7}") for i in range(3000)] + [(2, 5, "b"), (2, 5, "a")]
    df = spark.createDataFrame(data, "k int, o int, p string")
    out = rows(keep_first(df, ["k"], [asc("o")]))
    assert out == [(None, 0, "n0"), (1, 1, "n1"), (2, 5, "a")]
    out = rows(keep_first(df, ["k"], [desc("o")]))
    assert out == [(None, 2997, "n1"), (1, 2999, "n3"), (2, 5, "a")]


def test_global_and_group_index_match_row_number(spark):
    data = [(("hot" if i % 2 else f"g{i % 11}") if i % 13 else None, i * 7 % 1000, i) for i in range(4000)]
    df = spark.createDataFrame(data, "g string, v int, id int")
    w = Window.partitionBy("g").orderBy("v", "id")
    expect = df.withColumn("q", F.row_number().over(w) - 1)
    got = with_group_index(df, ["g"], ["v", "id"], "q", num_partitions=7)
    assert rows(got, "id", "q") == rows(expect, "id", "q")
    expect2 = df.withColumn("q", F.row_number().over(Window.orderBy("v", "id")) - 1)
    got2 = with_global_index(df, ["v", "id"], "q", num_partitions=5)
    assert rows(got2, "id", "q") == rows(expect2, "id", "q")


def test_pages_partition_the_listing(spark):
    df = spark.range(0, 1234).select((F.col("id") % 500).alias("a"), F.col("id").alias("b"))
    stored, seen = lst.store_ranked(df), []
    for n in range(1, 14):
        seen += [tuple(r) for r in stored.page(n).rows.collect()]
    assert seen == sorted(tuple(r) for r in df.collect())
    p = lst.page(df, "x")
    assert (p.number, p.num_pages, p.count, p.has_next, p.has_previous) == (1, 13, 1234, True, False)
    assert stored.page(99).number == 13 and stored.page(0).number == 13
    none = lst.page(df.limit(0), 5)
    assert (none.number, none.count) == (1, 0) and none.rows.count() == 0


def test_pages_over_many_files(spark, scratch):
    """NULLs, ties and repeated rows, a value that a third of all rows share, files of a few rows; each page reads only the
    files that hold it; a listing is found again from its folder."""
    df = spark.range(0, 3000).select(F.when(F.col("id") % 5 != 0, F.col("id") % 50).alias("a"), F.when(F.col("id") % 3 != 0, (
        F.col("id") % 700).cast("string")).alias("b")).repartition(7)
    want = [tuple(r) for r in df.orderBy(F.col("b").asc_nulls_first(), F.col("a").asc_nulls_first()).collect()]
    stored = lst.store_ranked(df, f"{scratch}/l", ["b"], file_rows=60)
    again = lst.open_ranked(spark, f"{scratch}/l", ["b"])
    for n in (1, 2, 9, 17, 30):
        for ranked in (stored, again):
            page = ranked.page(n)
            assert [tuple(r) for r in page.rows.collect()] == want[100 * (n - 1):100 * n]
            assert len(page.rows.inputFiles()) <= 9  # files of 60 rows, the last of each task shorter
    assert stored.count == 3000 and len(stored.frame().inputFiles()) > 40
    assert [tuple(r) for r in stored.slice(2990, 500).collect()] == want[2990:]


def test_paging_evaluates_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(2000).withColumn("x", F.col("id") % 7).mapInArrow(counted, "id long, x long")
    stored = lst.store_ranked(df, first=["x"])
    for n in (1, 7, 20):
        stored.page(n).rows.collect()
    assert seen.value == 2000


def test_new_adoptions_null_safe_and_disjoint(spark):
    df = ado(spark, [
        ("U", 2024, "F", "1", 10, "t", "a", "c", "e", "x", "S", 1, 1),   # kept
        ("U", 2023, "F", "1", 10, "t", "a", "c", "e", "x", "S", 1, 1),
        ("U", 2024, "F", "2", None, "t", "a", "c", "e", "x", "S", 1, 1),  # kept, NULL enrolment
        ("U", 2023, "F", "2", None, "t", "a", "c", "e", "x", "S", 1, 1),
        ("U", 2024, "F", "3", 12, "t", "a", "c", "e", "x", "S", 1, 1),   # enrolment changed
        ("U", 2023, "F", "3", 11, "t", "a", "c", "e", "x", "S", 1, 1),
        ("U", 2024, "F", "4", 5, "t", "a", "c", "e", "x", "S", 1, 1),    # new
        ("U", 2023, "F", "5", 5, "t", "a", "c", "e", "x", "S", 1, 1),    # dropped
    ])
    new = setops.new_adoptions(df, 2024)
    assert rows(new, "isbn") == [("3",), ("4",)]
    by_key = setops.new_adoptions_by_key(df, 2024, ["laurea_nome", "isbn"])
    assert rows(by_key, "isbn") == [("4",)]
    prev = df.filter("a_a = 2023").select(*setops.NEW_ADOPTION_KEY)
    assert new.intersect(prev).count() == 0


def test_select_by_list_frame_and_json(spark):
    df = ado(spark, [("U1", 2024, "F", "1", 1, "t", "a", "c", "e", "x", "S", 1, 1),
                     ("U2", 2024, "F", "2", 1, "t", "a", "c", "e", "x", "S", 2, 1),
                     ("U3", 2024, "F", "3", 1, "t", "a", "c", "e", "x", "S", None, 1)])
    assert rows(sel.select_by(df, "uni_cod", ["U1", "U3"]), "uni_cod") == [("U1",), ("U3",)]
    keys = sel.keys_from_json(spark, '{"U2": "on"}')
    assert rows(sel.select_by(df, "uni_cod", keys), "uni_cod") == [("U2",)]
    ids = sel.keys_from_json(spark, '["1", "2"]', "values")
    assert rows(sel.select_by(df, "prof_id", ids), "prof_id") == [(1,), (2,)]
    assert sel.active_set(df, df.limit(0)) is df


def test_selection_chain_order_independent(spark):
    df = ado(spark, [(u, 2024, "F", str(i), 1, "t", "a", "c", "e", "x", s, i, i)
                     for i, (u, s) in enumerate([("U1", "S1"), ("U1", "S2"), ("U2", "S1"), ("U2", "S2")])])

    def chain(steps):
        cur = None
        for col, keys in steps:
            cur = sel.select_by(sel.active_set(df, cur), col, keys)
        return rows(cur)

    a = chain([("uni_cod", ["U1"]), ("materia_ssd_cod", ["S2"])])
    b = chain([("materia_ssd_cod", ["S2"]), ("uni_cod", ["U1"])])
    assert a == b and len(a) == 1


def test_where_params_blanks_lists_contains(spark):
    df = ado(spark, [("U1", 2024, "Fisica", "1", 1, "t", "a", "c", "e", "Rossi Mario", "A", 1, 1),
                     ("U1", 2024, "Fisica", "2", 1, "t", "a", "c", "e", "Bianchi 50%", "B", 1, 1),
                     ("U2", 2024, "Fisica", "3", 1, "t", "a", "c", "e", None, "C", 1, 1)])
    assert sel.where_params(df, [("isbn", ""), ("uni_cod", None), ("x", [""])]).count() == 3
    assert rows(sel.where_params(df, [("materia_ssd_cod", ["A", " B"])]), "isbn") == [("1",), ("2",)]
    assert rows(sel.where_params(df, [("isbn", "1, 3")]), "isbn") == [("1",), ("3",)]
    assert rows(sel.where_params(df, [("insegnamento_prof", "ROSSI")]), "isbn") == [("1",)]
    assert rows(sel.where_params(df, [("insegnamento_prof", "50%")]), "isbn") == [("2",)]
    assert rows(sel.where_params(df, [("a_a", "2024"), ("uni_cod", "U2")]), "isbn") == [("3",)]
    # free text: NULL never matches, numbers are searchable as text
    assert rows(sel.free_text_search(df, "none"), "isbn") == []
    assert sel.free_text_search(df, "2024").count() == 3
    with pytest.raises(ValueError):
        sel.request_filter(df, {"uni_cod": "U1"})


def test_first_contact_per_pair(spark):
    c = spark.createDataFrame([(3, "Rossi", "1", "a"), (1, "Rossi", "1", "b"), (2, "Rossi", None, "c"),
                               (5, None, None, "d"), (4, None, None, "e")],
                              "record_id long, insegnamento_prof string, isbn string, email string")
    out = rows(agg.first_contact_per_pair(c))
    assert out == [(1, "Rossi", "1", "b"), (2, "Rossi", "Nessun saggio", "c"), (4, None, "Nessun saggio", "e")]


def directory_frame(spark, data):
    return conform(spark.createDataFrame(data, "prof_id long, uni_cod string, insegnamento_prof string, "
                                               "insegnamento_id long"), DIRECTORY)


def test_resolve_fan_out_blank_and_unmatched(spark):
    d = directory_frame(spark, [(1, "U1", "Rossi Mario", 10), (2, "U2", "Mario Rossi", 20),
                                (3, "U1", "", 30), (4, "U1", "Anna Bianchi", 40)])
    a = ado(spark, [("U1", 2024, "F", "1", 1, "t", "a", "c", "e", "Rossi Mario", "S", 99, 9),
                    ("U1", 2024, "F", "2", 1, "t", "a", "c", "e", "", "S", 98, 8),
                    ("U1", 2024, "F", "3", 1, "t", "a", "c", "e", "Verdi Luca", "S", None, None),
                    ("U1", 2024, "F", "4", 1, "t", "a", "c", "e", "Bianchi  Anna", "S", None, None)])
    out = rows(resolve_adoptions(a, d, overwrite_ids=True), "isbn", "prof_id", "insegnamento_id")
    assert out == [("1", 1, 10), ("1", 2, 20), ("2", 0, 0), ("3", 0, 0), ("4", 4, 40)]
    keep = rows(resolve_adoptions(a, d), "isbn", "prof_id")
    assert keep == [("1", 99), ("1", 99), ("2", 98), ("3", 0), ("4", 4)]
    salted = rows(resolve_adoptions(a, d, overwrite_ids=True, spread_hot=True), "isbn", "prof_id", "insegnamento_id")
    assert salted == out
    c = conform(a.select("uni_cod", "insegnamento_prof", F.lit(None).cast("string").alias("isbn")),
                "docenti_router").withColumn("record_id", F.monotonically_increasing_id())
    picked = resolve_contacts(c, d, pick_first_by="record_id")
    assert sorted(r.prof_id or 0 for r in picked.collect()) == [0, 0, 1, 4]


def test_directory_latest_course_tie_break(spark):
    chain = spark.createDataFrame(
        [(1, "U", "A B", 10, "w", "S2", "m2", 2), (1, "U", "A B", 10, "w", "S1", "m9", 9),
         (1, "U", "A B", 5, "w", "S0", "m0", 0), (2, "V", "C D", None, "w", "S0", "m0", 0)],
        "prof_id long, uni_cod string, insegnamento_prof string, insegnamento_id long, "
        "insegnamento_prof_www string, materia_ssd_cod string, materia_nome string, materia_id long")
    out = rows(dirs.latest_course(chain), "prof_id", "insegnamento_id", "materia_ssd_cod")
    assert out == [(1, 10, "S1"), (2, None, "S0")]


def contacts(spark, data):
    df = spark.createDataFrame(data, "record_id long, uni_cod string, prof_id long, insegnamento_prof string, "
                                     "email string")
    return conform(df, struct_for(["record_id", *CONTACT_COLUMNS]))


def test_upsert_as_is_and_new_wins(spark):
    old = contacts(spark, [(1, "U", 1, "Rossi", "old1"), (2, "U", 1, "Rossi", "old2"), (3, "U", 2, "Zeta", "o3"),
                           (4, None, None, "N", "o4"), (5, "U", 3, None, "o5")])
    new = contacts(spark, [(None, "U", 1, "Rossi", "new1"), (None, "U", 2, "Alfa", "new2"),
                           (None, None, None, "M", "new4"), (None, "U", 3, None, "new5"),
                           (None, "U", 4, "Nuovo", "new6")])
    out = {(r.uni_cod, r.prof_id): r.email for r in chg.upsert(new, old).collect()}
    assert out == {("U", 1): "old2", ("U", 2): "new2", (None, None): "new4", ("U", 3): "o5", ("U", 4): "new6"}
    wins = {(r.uni_cod, r.prof_id): r.email for r in chg.upsert(new, old, mode="new_wins").collect()}
    assert wins[("U", 1)] == "new1" and wins[("U", 2)] == "new2"
    # idempotent: upserting the same rows again changes nothing
    once = chg.upsert(new, old).drop("record_id")
    twice = chg.upsert(new, once).drop("record_id")
    assert rows(once) == rows(twice)


def test_update_delete_insert_append(spark):
    c = contacts(spark, [(1, "U", 1, "Rossi", "a@x"), (2, "U", 2, "Bianchi", "b@x")])
    ch = spark.createDataFrame([(2, "B@Y", None)], "record_id long, email string, note string")
    up = {r.record_id: (r.email, r.note) for r in chg.update_by_id(c, ch).collect()}
    assert up == {1: ("a@x", None), 2: ("B@Y", None)}
    assert [r.record_id for r in chg.delete_by_id(c, ch.select("record_id")).collect()] == [1]
    extra = contacts(spark, [(None, "U", 3, None, "n@x"), (None, "U", 4, " ", "m@x"), (None, "U", 5, "Verdi", "v")])
    assert chg.insert_rows(c, extra).count() == 3
    rows_in = contacts(spark, [(None, "U", 1, "Rossi", "dup"), (None, "U", 9, "Nuovo", "n")])
    once = chg.append_new(c, rows_in)
    assert once.count() == 3 and chg.append_new(once, rows_in).count() == 3


def test_lecturer_selection_modes(spark):
    d = directory_frame(spark, [(1, "U1", "Rossi Mario", 10), (2, "U2", "Anna Bianchi", 20)])
    a = ado(spark, [("U1", 2024, "F", "1", 1, "t", "a", "c", "e", "Rossi Mario", "S", 1, 10),
                    ("U1", 2024, "F", "1", 1, "t", "a", "c", "e", "Rossi Mario", "S", 1, 11),
                    ("U1", 2024, "F", "1", 1, "t", "a", "c", "e", "Rossi Mario", "S", 1, 11)])
    assert dirs.select_lecturers(d, a, None) is None
    m2 = dirs.select_lecturers(d, a, 2, [("uni_cod", "U1")])
    assert rows(m2, "prof_id", "insegnamento_id") == [(1, 10)]
    m1 = dirs.select_lecturers(d, a, 1)
    got = {(r.prof_id, r.insegnamento_id): r.materia_ssd_cod for r in m1.collect()}
    assert set(got) == {(1, 10), (2, 20), (1, 11)} and got[(1, 11)] == "S"
    m0 = dirs.select_lecturers(d, a, 0)
    assert rows(m0, "prof_id", "insegnamento_id") == [(1, 10), (1, 11)]
    assert set(m1.columns) == set(CONTACT_COLUMNS)


def test_audience_columns(spark):
    c = contacts(spark, [(1, "U", 1, "Rossi", "a@x")])
    out = chg.audience(c, "Autunno", dt.date(2025, 1, 2)).collect()[0].asDict()
    assert out == {"uni_cod": "U", "materia_ssd_cod": None, "insegnamento_prof": "Rossi", "prof_id": 1,
                   "insegnamento_id": None, "email": "a@x", "nome": "Autunno", "note": None,
                   "data": dt.date(2025, 1, 2)}


def test_conform_missing_extra_and_unknown(spark):
    df = spark.createDataFrame([("U", "2024", "12.0", "x")], "uni_cod string, a_a string, prof_id string, zz string")
    c = conform(df, "adozioni")
    assert c.columns == ADOPTION_COLUMNS
    r = c.collect()[0]
    assert (r.a_a, r.prof_id, r.isbn) == (2024, 12, None)
    with pytest.raises(ValueError):
        conform(df, "nope")


def test_distinct_values_of_any_number(spark):
    df = spark.range(20_000).select(F.lit("U1").alias("uni_cod"), F.concat(F.lit("S"), "id").alias("materia_ssd_cod"))
    assert agg.distinct_values(df).groupBy("column").count().collect() is not None
    assert agg.distinct_values(df).count() == 20_001


def test_new_rows_get_ids_and_changes_are_exact(spark):
    c = contacts(spark, [(7, "U", 1, "Rossi", "a@x"), (3, "U", 2, "Bianchi", "b@x")])
    extra = contacts(spark, [(None, "U", 4, "Verdi", "v"), (None, "U", 3, "Alfa", "n")])
    now = chg.insert_rows(c, extra)
    assert rows(now, "record_id", "insegnamento_prof") == [(3, "Bianchi"), (7, "Rossi"), (8, "Alfa"), (9, "Verdi")]
    assert chg.delete_by_id(now, now.where("record_id = 9")).count() == 3
    cleared = chg.update_by_id(now, spark.createDataFrame([(8, None)], "record_id long, email string"), set_columns=["email"])
    assert {r.record_id: r.email for r in cleared.collect()} == {3: "b@x", 7: "a@x", 8: None, 9: "v"}
    with pytest.raises(chg.DuplicateChange):
        chg.update_by_id(now, spark.createDataFrame([(8, "x"), (8, "y")], "record_id long, email string"))
    assert rows(chg.with_ids(c.drop("record_id")), "record_id") == [(1,), (2,)]
    mixed = contacts(spark, [(None, "U", 1, "Rossi", "late"), (5, "U", 1, "Rossi", "first")])
    assert [r.email for r in agg.first_contact_per_pair(mixed).collect()] == ["first"]


def test_a_key_that_is_no_number_matches_nothing(spark):
    df = spark.createDataFrame([(1,), (2,)], "prof_id long")
    assert rows(sel.select_by(df, "prof_id", sel.keys_from_json(spark, '["1", "x"]', "values"))) == [(1,)]


def test_hot_keys_are_spread(spark):
    """A name with a third of the rows is dealt over many salts; rare names keep one, and only hot ones are replicated."""
    from cattedra.operators.resolve import hot_keys, spread
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id"))).alias("k"), "id")
    assert rows(hot_keys(df, "k", 100)) == [("hot", 34)]
    left, right = spread(df, df.select("k").distinct().withColumn("x", F.length("k")), "k", 100)
    assert left.where("k = 'hot'").select("_salt").distinct().count() == 34
    assert left.where("k <> 'hot'").agg(F.max("_salt")).first()[0] == 0
    assert right.where("k = 'hot'").count() == 34 and right.where("k <> 'hot'").count() == 6000
    joined = left.join(right, ["k", "_salt"], "left")
    assert joined.count() == 9000 and joined.where("x is null").count() == 0
    largest = joined.groupBy("k", "_salt").count().agg(F.max("count")).first()[0]
    assert largest < 3000 / 34 * 2
    assert hot_keys(df.limit(0), "k").count() == 0
