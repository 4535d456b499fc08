"""Property tests: C2 is invariant under token permutation; the
ISBN-13 conversion always yields a valid code; keep-first equals the
row_number reference on random data with a hot key."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from cattedra.functions import isbn13, isbn13_valid, name_key
from cattedra.operators.dedup import asc, desc, keep_first

TOKENS = st.lists(st.text(alphabet="abcXYZàé'-0", min_size=1, max_size=6), min_size=1, max_size=5)


@settings(max_examples=25, deadline=None)
@given(TOKENS, st.randoms())
def test_name_key_permutation_invariant(spark, tokens, rnd):
    shuffled = list(tokens)
    rnd.shuffle(shuffled)
    seps = [" ", "  ", "\t"]
    a = " ".join(tokens)
    b = rnd.choice(seps).join(shuffled)
    df = spark.createDataFrame([(a, b)], "a string, b string")
    r = df.select(name_key("a").alias("ka"), name_key("b").alias("kb")).collect()[0]
    assert r.ka == r.kb == " ".join(sorted(tokens))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="0123456789", min_size=9, max_size=9), min_size=1, max_size=20),
       st.sampled_from(["0", "5", "X", "9"]))
def test_isbn10_to_13_is_valid(spark, bodies, last):
    df = spark.createDataFrame([(b + last,) for b in bodies], "v string")
    hyph = F.concat_ws("-", F.col("v").substr(1, 1), F.col("v").substr(2, 3), F.col("v").substr(5, 5),
                       F.col("v").substr(10, 1))
    out = df.select(isbn13_valid(isbn13("v")).alias("a"), isbn13_valid(isbn13(hyph)).alias("b")).collect()
    assert all(r.a and r.b for r in out)


def test_keep_first_matches_row_number_random(spark):
    rnd = random.Random(7)
    data = [(rnd.choice(["hot"] * 5 + ["a", "b", None]), rnd.randint(0, 50), rnd.choice(["x", "y", None]), i)
            for i in range(5000)]
    df = spark.createDataFrame(data, "k string, o int, p string, id int")
    got = keep_first(df, ["k"], [desc("o"), asc("p"), asc("id")])
    w = Window.partitionBy("k").orderBy(F.col("o").desc_nulls_last(), F.col("p").asc_nulls_first(), "id")
    want = df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    key = lambda r: (r.k or "",)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
