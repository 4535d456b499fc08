"""DuckDB SQL oracle for the registered queries.

Each entry is plain SQL over the driver's views (``lineitem``, ``orders``, ...),
independent of the Spark code: the test-data mapping is restated as CTEs.
"""

from __future__ import annotations

ADOPTIONS_CTE = """adozioni AS (
  SELECT n.n_name AS uni_cod, CAST(year(o.o_orderdate) AS INTEGER) AS a_a,
         c.c_mktsegment AS laurea_nome, o.o_orderstatus AS laurea_tipo,
         l.l_returnflag AS laurea_classe_cod, n.n_name AS sede, o.o_orderpriority AS facolta,
         c.c_mktsegment AS curr_nome, p.p_type AS materia_ssd_cod,
         CAST(p.p_size AS VARCHAR) AS materia_cfu, CAST(l.l_linenumber AS VARCHAR) AS curr_materia_anno,
         l.l_linestatus AS curr_materia_periodo, p.p_name AS materia_nome,
         translate(s.s_name, '#', ' ') AS insegnamento_prof,
         'prof/' || CAST(l.l_suppkey AS VARCHAR) AS insegnamento_prof_www,
         CAST(l.l_partkey AS VARCHAR) AS isbn, p.p_brand AS autori,
         NULLIF(p.p_type, 'PROMO') AS curatori, p.p_name AS titolo, p.p_brand AS editore,
         CASE WHEN l.l_discount >= 0.05 THEN 'SI' ELSE 'NO' END AS testo_obb,
         CAST(NULL AS VARCHAR) AS testo_uso, CAST(NULL AS VARCHAR) AS testo_freq,
         CAST(l.l_quantity AS BIGINT) * 3 AS laurea_iscritti,
         CAST(l.l_quantity AS BIGINT) AS laurea_matricole,
         l.l_suppkey AS prof_id, l.l_orderkey * 8 + l.l_linenumber AS insegnamento_id
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""

CONTACTS_CTE = """docenti_router AS (
  SELECT l.l_orderkey * 8 + l.l_linenumber AS record_id,
         n.n_name AS uni_cod, l.l_returnflag AS facolta, p.p_type AS materia_ssd_cod,
         p.p_name AS materia_nome, translate(s.s_name, '#', ' ') AS insegnamento_prof,
         'prof/' || CAST(l.l_suppkey AS VARCHAR) AS insegnamento_prof_www,
         l.l_suppkey AS prof_id, l.l_orderkey * 8 + l.l_linenumber AS insegnamento_id,
         lower(translate(s.s_name, '#', '.')) || '@uni.example' AS email,
         CAST(NULL AS VARCHAR) AS indirizzo, n.n_name AS citta, CAST(NULL AS VARCHAR) AS telefono,
         l.l_linestatus AS note,
         CASE WHEN l.l_returnflag = 'R' THEN NULL ELSE CAST(l.l_partkey AS VARCHAR) END AS isbn,
         p.p_name AS titolo, CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR) AS data
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey)"""

DIRECTORY_CTE = """dir_chain AS (
  SELECT w.prof_id, w.uni_cod, w.prof_nome AS insegnamento_prof, i.insegnamento_id,
         i.insegnamento_prof_www, ms.materia_ssd_cod, m.materia_nome, i.materia_id
  FROM (SELECT s.s_suppkey AS prof_id, n.n_name AS uni_cod,
               string_split(s.s_name, '#')[2] || ' ' || string_split(s.s_name, '#')[1] AS prof_nome
        FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey) w
  JOIN (SELECT l_suppkey AS prof_id, l_orderkey * 8 + l_linenumber AS insegnamento_id FROM lineitem) ip
    ON w.prof_id = ip.prof_id
  JOIN (SELECT l_orderkey * 8 + l_linenumber AS insegnamento_id, l_partkey AS materia_id,
               'corso/' || CAST(l_orderkey AS VARCHAR) AS insegnamento_prof_www FROM lineitem) i
    ON ip.insegnamento_id = i.insegnamento_id
  JOIN (SELECT p_partkey AS materia_id, p_type AS materia_ssd_cod FROM part) ms ON i.materia_id = ms.materia_id
  JOIN (SELECT p_partkey AS materia_id, p_name AS materia_nome FROM part) m ON ms.materia_id = m.materia_id),
tuttidocenti AS (
  SELECT prof_id, uni_cod, insegnamento_prof, insegnamento_id, insegnamento_prof_www,
         materia_ssd_cod, materia_nome
  FROM (SELECT *, row_number() OVER (PARTITION BY prof_id ORDER BY insegnamento_id DESC NULLS LAST,
                 materia_ssd_cod NULLS FIRST, materia_nome NULLS FIRST, materia_id NULLS FIRST,
                 uni_cod NULLS FIRST, insegnamento_prof NULLS FIRST, insegnamento_prof_www NULLS FIRST) AS rn
        FROM dir_chain) t
  WHERE rn = 1)"""

LOG_CTE = """msg AS (
  SELECT event_id, user_id AS tenant_id, ts AS date, concat_ws(' ', event_type, props) AS message,
         event_type, props
  FROM events)"""


def with_ctes(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def with_adoptions(body: str) -> str:
    return with_ctes(body, ADOPTIONS_CTE)


def name_key_sql(expr: str) -> str:
    """C2 in DuckDB: sorted whitespace tokens; '' -> NULL."""
    return (f"NULLIF(array_to_string(list_sort(list_filter(regexp_split_to_array(trim({expr}), '\\s+'), "
            f"lambda x: x <> '')), ' '), '')")


def title_sql(expr: str) -> str:
    """C9 in DuckDB: upper after a non-letter, lower after a letter."""
    return (f"array_to_string(list_transform(range(1, length({expr}) + 1), lambda i: CASE WHEN i = 1 OR NOT "
            f"regexp_matches(substr({expr}, i - 1, 1), '\\pL') THEN upper(substr({expr}, i, 1)) "
            f"ELSE lower(substr({expr}, i, 1)) END), '')")


def check_digit_sql(body: str, n: int) -> str:
    """EAN check digit of the first ``n`` characters of ``body``."""
    terms = " + ".join(f"TRY_CAST(substr({body}, {i}, 1) AS INTEGER) * {3 if i % 2 == 0 else 1}"
                       for i in range(1, n + 1))
    return f"CAST((10 - ({terms}) % 10) % 10 AS VARCHAR)"


def clean_name_sql(expr: str) -> str:
    """C1 in DuckDB (spaces only; the test names hold no other whitespace)."""
    step1 = f"regexp_replace(regexp_replace({expr}, '\\(.+\\)\\z', ''), '^[ \\-]+|[ \\-]+$', '', 'g')"
    low = f"lower({step1})"
    placeholder = " OR ".join(f"starts_with({low}, '{p}')" for p in
                              ("docente", "docenti", "assegnazione", "000000 00000", "not assigned"))
    blank = (f"({placeholder}) OR regexp_matches({step1}, '(?i)\\bnon\\s(.)*(assegnato|definito|assegnati|"
             f"definiti|Not Assigned)') OR regexp_matches({step1}, '(?i)^da definire|^da nominare|"
             f"Assegnazione|^[0\\s]+')")
    body = f"trim(replace(replace({step1}, ', ', ' '), ',', ' '))"
    return f"CASE WHEN {expr} IS NULL THEN NULL WHEN {blank} THEN '' ELSE {title_sql(body)} END"


#: ``testdata.dirty_adoptions`` and what the loaders make of it (``pulite``); needs ADOPTIONS_CTE before it.
DIRTY_CTE = """sporche AS (
  SELECT * REPLACE (
    CASE insegnamento_id % 10 WHEN 0 THEN 'Docente da definire' WHEN 1 THEN NULL
         WHEN 2 THEN insegnamento_prof || ' (supplente)' ELSE insegnamento_prof END AS insegnamento_prof,
    CASE WHEN insegnamento_id % 7 = 0 THEN materia_ssd_cod || ';MAT/05' ELSE materia_ssd_cod END AS materia_ssd_cod,
    CASE WHEN insegnamento_id % 3 <> 0 THEN prof_id END AS prof_id,
    CASE insegnamento_id % 5 WHEN 0 THEN 'Il "nuovo" ' || titolo || ', vol. 1' || chr(10) || 'bis'
         WHEN 1 THEN '  ' || titolo || ' ' WHEN 2 THEN '' ELSE titolo END AS titolo)
  FROM adozioni),
pulite AS (
  SELECT * REPLACE (
    CASE WHEN insegnamento_prof IS NULL OR insegnamento_prof LIKE '%definire%' THEN ''
         ELSE trim(split_part(insegnamento_prof, '(', 1)) END AS insegnamento_prof,
    replace(materia_ssd_cod, ';', ' ') AS materia_ssd_cod, coalesce(prof_id, 0) AS prof_id)
  FROM sporche)"""

#: ``testdata.dirty_directory`` without its nameless row, which matches nothing; needs DIRECTORY_CTE before it.
DIRTY_DIRECTORY_CTE = """elenco AS (
  SELECT prof_id, insegnamento_prof, insegnamento_id FROM tuttidocenti
  UNION ALL
  SELECT prof_id + 1000000, insegnamento_prof, insegnamento_id FROM tuttidocenti WHERE prof_id % 10 = 0)"""

#: ``testdata.dirty_contacts`` as S3 cleans and resolves them (``caricati``; an id 0 is none); needs CONTACTS_CTE and DIRECTORY_CTE before it.
DIRTY_CONTACTS_CTE = f"""puliti AS (
  SELECT * REPLACE (
    CASE WHEN isbn IS NULL AND record_id % 5 <> 1 THEN '0' WHEN record_id % 5 = 0 THEN '97' || isbn
         WHEN record_id % 5 = 1 THEN '0' ELSE isbn END AS isbn,
    CASE WHEN record_id % 9 < 2 THEN '' ELSE insegnamento_prof END AS insegnamento_prof,
    CASE WHEN record_id % 3 <> 0 THEN prof_id END AS prof_id,
    CASE WHEN record_id % 3 <> 0 THEN insegnamento_id END AS insegnamento_id,
    CASE record_id % 4 WHEN 0 THEN ' "a", ' || note WHEN 1 THEN NULL ELSE note END AS note)
  FROM docenti_router),
caricati AS (
  SELECT c.* REPLACE (coalesce(nullif(c.prof_id, 0), d.prof_id) AS prof_id,
                      coalesce(nullif(c.insegnamento_id, 0), d.insegnamento_id) AS insegnamento_id)
  FROM puliti c LEFT JOIN (SELECT {name_key_sql("insegnamento_prof")} AS k, prof_id, insegnamento_id FROM tuttidocenti) d
    ON {name_key_sql("c.insegnamento_prof")} = d.k)"""
