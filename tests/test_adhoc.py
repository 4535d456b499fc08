"""Q8: the guard of ad-hoc SQL walks what the parser made of the text, in a session that holds the views alone."""

import pytest
from pyspark.sql import functions as F

from cattedra.plans import adhoc

QUERIES = [
    "SELECT 'UnresolvedRelation [altri]' x, 'drop' y FROM adozioni",
    'WITH a AS (SELECT * FROM adozioni), b AS (SELECT * FROM a) SELECT * FROM b JOIN a USING (isbn)',
    'SELECT uni_cod, count(*) n, sum(a_a) FILTER (WHERE a_a>1) s FROM adozioni WHERE a_a>=:y GROUP BY ROLLUP(uni_cod) HAVING count(*)>0 ORDER BY 1 LIMIT 5 OFFSET 0',
    'SELECT *, row_number() OVER w rn FROM adozioni WINDOW w AS (PARTITION BY uni_cod ORDER BY a_a)',
    'SELECT * FROM adozioni WHERE EXISTS (SELECT 1 FROM contatti c WHERE c.isbn=adozioni.isbn) UNION SELECT * FROM contatti EXCEPT SELECT * FROM adozioni',
    'SELECT * FROM adozioni PIVOT (count(isbn) FOR a_a IN (2023,2024))',
    'SELECT * FROM VALUES (1,2) t(a,b)',
    "SELECT transform(array(1,2), x -> x+1) t, cast('1' AS int) c, CASE WHEN true THEN 1 END z",
    'SELECT e FROM adozioni LATERAL VIEW explode(array(1,2)) q AS e',
    'SELECT * FROM range(3)',
    'SELECT (SELECT max(a_a) FROM adozioni) m, uni_cod IN (SELECT uni_cod FROM contatti) k FROM adozioni',
    'WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n+1 FROM t WHERE n<3) SELECT * FROM t',
    'SELECT * FROM adozioni a, LATERAL (SELECT a.a_a+1 AS z)',
    'FROM adozioni |> WHERE a_a > 1 |> SELECT uni_cod',
    "SELECT DISTINCT uni_cod FROM adozioni WHERE uni_cod LIKE 'U%' AND a_a BETWEEN 1 AND 3000 AND isbn IS NOT NULL",
    'SELECT * FROM adozioni TABLESAMPLE (50 PERCENT)',
    'SELECT isbn AS altri FROM adozioni',
    'SELECT * EXCEPT (isbn) FROM adozioni',
    'TABLE adozioni',
    "SELECT year(current_date()) y, upper(uni_cod), date '2024-01-01' d, interval 1 day i FROM adozioni",
    'SELECT * FROM adozioni UNPIVOT (v FOR k IN (a_a))',
    'SELECT /*+ BROADCAST(a) */ * FROM adozioni a',
]

REFUSED = [
    "select 'CTE [altri]' as x, * from altri",
    "select * from identifier('altri')",
    "execute immediate 'select * from altri'",
    'with altri as (select * from altri) select * from altri',
    'select (with altri as (select 1 z) select z from altri), x.* from altri x',
    'select * from global_temp.glob',
    'select * from parquet.`/root/testdata/sf0.001/nation.parquet`',
    'begin select 1; end',
    "select identifier('reflect')('java.lang.System','getProperty','user.home')",
    'select spark_catalog.default.f(1)',
    'select * from adozioni; select 1',
    'set x=1',
    'show tables',
    'describe adozioni',
    'explain select 1',
    'cache table adozioni',
    'insert into adozioni select * from adozioni',
    'create temp view v as select 1',
    'drop view adozioni',
    'call x()',
    "select builtin.reflect('a','b')",
    "select system.builtin.reflect('java.lang.System','getProperty','user.home')",
    'declare x int = 1',
    'select * from adozioni where a_a in (select id from altri)',
    'select transform(array(1), x -> (select max(id) from altri))',
    'from altri |> select id',
    'select * from json.`/tmp/x`',
    "select transform(uni_cod) using 'cat' as (z) from adozioni",
    "from adozioni select transform(*) using 'cat'",
    'table altri',
    'select * from adozioni join lateral (select * from altri)',
    "select java_method('java.lang.System','getProperty','user.home')",
    'with a as (select * from adozioni), b as (with a as (select 1) select * from a) select * from b, altri',
    'select * from python_udtf(1)',
    'select * from adozioni pivot (max(a_a) for uni_cod in (select 1))',
    '',
    'select * from adozioni order by (select max(id) from altri)',
    'select count(*) filter (where a_a in (select id from altri)) from adozioni',
    'select sum(a_a) over (order by (select 1 from altri)) from adozioni',
    'select * from values ((select max(id) from altri)) t(x)',
    'select * from adozioni limit (select 1 from altri)',
    'select * from `altri`',
    'select * from ALTRI',
    'with t as (select * from u), u as (select 1) select * from t',
]

# anything after the 25 columns that a printed plan shows
REFUSED.append("select " + ", ".join(f"1 as c{i}" for i in range(30)) + ", reflect('java.lang.System', 'getProperty', 'user.home')")


@pytest.fixture()
def views(spark):
    rows = spark.createDataFrame([("U1", 2024, "1"), ("U2", 2023, "2")], "uni_cod string, a_a int, isbn string")
    spark.range(3).createOrReplaceTempView("altri")  # another tenant's
    spark.range(3).createOrReplaceGlobalTempView("glob")
    yield {"adozioni": rows, "contatti": rows}
    spark.catalog.dropTempView("altri")
    spark.catalog.dropGlobalTempView("glob")


@pytest.mark.parametrize("text", QUERIES)
def test_queries_run(spark, views, text):
    res = adhoc.run_sql(spark, text, views, {"y": 1} if ":y" in text else None)
    assert res.frame is not None
    res.frame.collect()


@pytest.mark.parametrize("text", REFUSED)
def test_all_else_is_refused(spark, views, text):
    res = adhoc.run_sql(spark, text, views)
    assert res.frame is None and res.message == adhoc.QUERY_ERROR


def test_session_views_stay(spark, views):
    views["adozioni"].limit(0).createOrReplaceTempView("adozioni")  # the caller's own view of that name
    res = adhoc.run_sql(spark, "SELECT * FROM adozioni", views)
    assert res.frame.count() == 2 and spark.table("adozioni").count() == 0 and spark.table("altri").count() == 3
    assert res.frame.join(res.frame.select(F.col("isbn").alias("i")), F.col("isbn") == F.col("i")).count() == 2
    spark.catalog.dropTempView("adozioni")


def test_values_are_no_text(spark, views):
    res = adhoc.run_sql(spark, "SELECT * FROM adozioni WHERE uni_cod = :u", views, {"u": "x' OR '1' = '1"})
    assert res.frame.count() == 0
