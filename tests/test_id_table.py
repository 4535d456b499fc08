"""Stored edits by id (M1-M4, D2): only the touched blocks are written anew."""

import pytest
from pyspark.sql import functions as F

from cattedra.operators import changes as chg
from cattedra.sources.id_table import IdTable
from tests.conftest import rows

SCHEMA = "record_id long, uni_cod string, prof_id long, insegnamento_prof string, email string"


@pytest.fixture()
def table(spark, scratch):
    t = IdTable(spark, f"{scratch}/t", "contatti", block=10)
    t.write(spark.createDataFrame([(i, f"U{i % 3}", i, f"N{i:02d}", None) for i in range(40)], SCHEMA))
    return t


def files(t):
    return set(t.read().inputFiles())


def test_an_edit_leaves_other_blocks_in_place(spark, table):
    before, first = table.read(), table.store.version()
    old = files(table)
    want = chg.update_by_id(before, spark.createDataFrame([(13, "x"), (99, "y")], "record_id long, email string"))
    table.update(spark.createDataFrame([(13, "x"), (99, "y")], "record_id long, email string"))
    assert rows(table.read()) == rows(want)
    kept = old & files(table)
    assert len(kept) == len(old) - 1 and not any("id_block=1/" in f for f in kept)
    assert rows(table.read(first)) == rows(before)


def test_delete_insert_and_empty_blocks(spark, table):
    table.delete(spark.range(20, 31).select(F.col("id").alias("record_id")))
    assert [r.record_id for r in table.read().orderBy("record_id").collect()] == [*range(20), *range(31, 40)]
    assert not any("id_block=2/" in f for f in files(table))
    new = spark.createDataFrame([("U9", 1, "Nuovo", None), ("U9", 2, " ", None)], "uni_cod string, prof_id long, insegnamento_prof string, email string")
    old = files(table)
    table.insert(new)
    assert rows(table.read().where("record_id > 39"), "record_id", "insegnamento_prof") == [(40, "Nuovo")]
    assert old <= files(table)  # block 4 is new, no other one was touched
    table.delete(table.read())
    assert table.read().isEmpty()
    table.insert(new)
    assert rows(table.read(), "record_id") == [(1,)]


def test_upsert_touches_the_keys_it_names(spark, table):
    new = spark.createDataFrame([("U1", 1, "A", "a@x"), ("U9", 7, "B", None)], "uni_cod string, prof_id long, insegnamento_prof string, email string")
    old = files(table)
    table.upsert(new)  # the smaller name wins, as it is in the reference
    assert rows(table.read().where("email = 'a@x'"), "record_id", "insegnamento_prof") == [(1, "A")]
    assert rows(table.read().where("uni_cod = 'U9'"), "record_id") == [(40,)]
    assert len(old - files(table)) == 1 and table.read().count() == 41
    table.upsert(spark.createDataFrame([("U1", 1, "Z", "z@x")], "uni_cod string, prof_id long, insegnamento_prof string, email string"))
    assert table.read().where("email = 'z@x'").isEmpty()
    table.upsert(spark.createDataFrame([("U1", 1, "Z", "z@x")], "uni_cod string, prof_id long, insegnamento_prof string, email string"),
                 mode="new_wins")
    assert rows(table.read().where("email = 'z@x'"), "record_id") == [(1,)]


def test_two_edits_of_one_block_at_once_are_refused(spark, table, monkeypatch):
    other = IdTable(spark, table.store.root, "contatti", block=10)
    change, raced = table.store.change, []

    def late(apply):
        if not raced:
            raced.append(other.delete(spark.createDataFrame([(14,)], "record_id long")))
        return change(apply)

    monkeypatch.setattr(table.store, "change", late)
    with pytest.raises(RuntimeError):
        table.delete(spark.createDataFrame([(13,)], "record_id long"))
    assert table.read().count() == 39
    table.delete(spark.createDataFrame([(13,)], "record_id long"))
    assert table.read().count() == 38
