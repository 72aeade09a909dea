"""Queries written as SQL text of the engine's dialect, beside DuckDB's SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.recursion import folder
from .database import Database
from .engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def tables(engine: Engine, path: str, text: str) -> None:
    for name in TABLES:
        if name in text:
            engine.register(name, engine.spark.read.parquet(f"{path}/{name}.parquet"))


def dialect(name: str, text: str, oracle: str | None = None, params: list | None = None, strict: bool = False) -> None:
    def run(spark: SparkSession, path: str) -> DataFrame:
        engine = Engine(spark, strict)
        tables(engine, path, text)
        return engine.query(text, params)

    QUERIES[name], ORACLE_SQL[name] = run, oracle or text


def database(oracle: str, name: str | None = None):
    """A query over a database of its own, made by statements."""

    def add(fn):
        def run(spark: SparkSession, path: str) -> DataFrame:
            db = Database(spark, folder(spark, "db"))
            source = lambda t: spark.read.parquet(f"{path}/{t}.parquet").createOrReplaceTempView(f"src_{t}")
            return fn(db, source)

        QUERIES[name or fn.__name__], ORACLE_SQL[name or fn.__name__] = run, oracle
        return fn

    return add


# -- operators and predicates ----------------------------------------------------------------

dialect("sql_division", "SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey % 7 AS r, o_orderkey / (o_custkey % 5) AS z, o_orderkey % (o_custkey % 5) AS zr, o_totalprice / 2 AS h, o_totalprice / 0 AS n, -o_orderkey / 4 AS neg, +o_orderkey AS pos, 7 / 2.0 AS real FROM orders",
    "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, CASE WHEN o_custkey % 5 <> 0 THEN o_orderkey // (o_custkey % 5) END AS z, CASE WHEN o_custkey % 5 <> 0 THEN o_orderkey % (o_custkey % 5) END AS zr, o_totalprice / 2 AS h, CAST(NULL AS DOUBLE) AS n, -(o_orderkey // 4) AS neg, o_orderkey AS pos, 3.5::DOUBLE AS real FROM orders")
dialect("sql_strict_division", "SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey % 7 AS r, o_totalprice / 4 AS h FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, o_totalprice / 4 AS h FROM orders", strict=True)
dialect("sql_bits", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, o_orderkey << 3 AS l, o_orderkey >> 2 AS r, o_orderkey << 70 AS far, o_orderkey << -1 AS back, ~o_orderkey AS inv FROM orders",
    "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, o_orderkey * 8 AS l, o_orderkey >> 2 AS r, 0::BIGINT AS far, o_orderkey >> 1 AS back, -o_orderkey - 1 AS inv FROM orders")
dialect("sql_truthiness", "SELECT p_partkey FROM part WHERE p_size % 3 AND NOT p_size % 2", "SELECT p_partkey FROM part WHERE p_size % 3 <> 0 AND p_size % 2 = 0")
dialect("sql_concat", "SELECT p_partkey, p_name || '-' || p_size || NULL AS n, p_name || '-' || p_size AS t FROM part", "SELECT p_partkey, CAST(NULL AS VARCHAR) AS n, p_name || '-' || p_size AS t FROM part")
dialect("sql_null_tests", "SELECT o_orderkey, nullif(o_orderkey % 3, 0) ISNULL AS a, nullif(o_orderkey % 3, 0) NOTNULL AS b, nullif(o_orderkey % 3, 0) IS 1 AS c, nullif(o_orderkey % 3, 0) IS NOT 1 AS d, nullif(o_orderkey % 3, 0) IS NOT DISTINCT FROM NULL AS e FROM orders",
    "SELECT o_orderkey, o_orderkey % 3 = 0 AS a, o_orderkey % 3 <> 0 AS b, o_orderkey % 3 = 1 AS c, o_orderkey % 3 <> 1 AS d, o_orderkey % 3 = 0 AS e FROM orders")
dialect("sql_in_empty", "SELECT n_nationkey, n_regionkey IN () AS i, n_regionkey NOT IN () AS o, NULL IN () AS n FROM nation", "SELECT n_nationkey, false AS i, true AS o, false AS n FROM nation")
dialect("sql_in_list", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey % 4 NOT IN (1, 2)")
dialect("sql_in_table", "WITH keys AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) SELECT s_suppkey FROM supplier WHERE s_nationkey IN keys", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
dialect("sql_any_array", "SELECT n_nationkey, n_regionkey = ANY (ARRAY[1, 3]) AS a, n_regionkey <> ALL (ARRAY[1, 3]) AS b, n_regionkey > ANY (ARRAY[2, 3]) AS c FROM nation", "SELECT n_nationkey, n_regionkey IN (1, 3) AS a, n_regionkey NOT IN (1, 3) AS b, n_regionkey > 2 AS c FROM nation")
dialect("sql_row_values", "SELECT o_orderkey, (o_orderstatus, o_custkey) < ('O', 40) AS lt, (o_orderstatus, o_custkey) = ('F', NULL) AS eq, (o_orderstatus, o_custkey) >= ('F', 70) AS ge FROM orders",
    "SELECT o_orderkey, o_orderstatus < 'O' OR (o_orderstatus = 'O' AND o_custkey < 40) AS lt, o_orderstatus = 'F' AND NULL AS eq, o_orderstatus > 'F' OR (o_orderstatus = 'F' AND o_custkey >= 70) AS ge FROM orders")
dialect("sql_row_value_in", "SELECT o_orderkey FROM orders WHERE (o_orderkey, o_custkey) IN (SELECT l_orderkey, l_suppkey FROM lineitem)")
dialect("sql_like", "SELECT p_partkey, p_name LIKE '%A_E%' AS a, p_name NOT LIKE 'b%' AS b, p_type LIKE '%!%%' ESCAPE '!' AS c FROM part", "SELECT p_partkey, lower(p_name) LIKE '%a_e%' AS a, lower(p_name) NOT LIKE 'b%' AS b, contains(p_type, '%') AS c FROM part")
dialect("sql_strict_like", "SELECT p_partkey, p_name LIKE '%a%' AS a FROM part", strict=True)
dialect("sql_glob", "SELECT p_partkey FROM part WHERE p_type GLOB '*[A-M]*[^0-9]'", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '[A-M].*[^0-9]$')")
dialect("sql_regexp", "SELECT c_custkey FROM customer WHERE c_name REGEXP '[0-4]{2}$' AND c_name ~ '^C' AND c_name !~ '9$' AND c_mktsegment ~* 'build|mach'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[0-4]{2}$') AND regexp_matches(c_name, '^C') AND NOT regexp_matches(c_name, '9$') AND regexp_matches(lower(c_mktsegment), 'build|mach')")
dialect("sql_match", "SELECT doc_id FROM documents WHERE text MATCH 'the AND (idiot OR worth*)'",
    "SELECT doc_id FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents) WHERE list_contains(w, 'the') AND (list_contains(w, 'idiot') OR len(list_filter(w, lambda x: starts_with(x, 'worth'))) > 0)")
dialect("sql_casts", "SELECT event_id, CAST(substr(props, 6) AS REAL) AS r, CAST(value AS INTEGER) AS i, CAST(event_id AS TEXT) || '' AS t, event_id::text AS u, CAST('12abc' AS INTEGER) AS p FROM events",
    "SELECT event_id, coalesce(TRY_CAST(regexp_extract(substr(props, 6), '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+))', 1) AS DOUBLE), 0.0) AS r, CAST(trunc(value) AS BIGINT) AS i, CAST(event_id AS VARCHAR) AS t, CAST(event_id AS VARCHAR) AS u, 12::BIGINT AS p FROM events")
dialect("sql_strict_cast", "SELECT o_orderkey, CAST(CAST(o_custkey AS TEXT) AS INTEGER) AS k, CAST('2024-03-01' AS DATE) AS d FROM orders", "SELECT o_orderkey, o_custkey AS k, DATE '2024-03-01' AS d FROM orders", strict=True)
dialect("sql_collate", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'building' COLLATE NOCASE ORDER BY c_name COLLATE NOCASE DESC LIMIT 7", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY lower(c_name) DESC LIMIT 7")
dialect("sql_collate_group", "SELECT min(c_mktsegment) AS s, count(*) AS n FROM customer GROUP BY c_mktsegment COLLATE NOCASE", "SELECT min(c_mktsegment) AS s, count(*) AS n FROM customer GROUP BY lower(c_mktsegment)")
dialect("sql_alias_in_where", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE net > 50000", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000")
dialect("sql_case_iif", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS c, iif(o_orderkey % 2, 'odd', 'even') AS i, ifnull(nullif(o_orderstatus, 'F'), '-') AS n FROM orders",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS c, CASE WHEN o_orderkey % 2 <> 0 THEN 'odd' ELSE 'even' END AS i, coalesce(nullif(o_orderstatus, 'F'), '-') AS n FROM orders")
dialect("sql_values", "SELECT column1 AS a, column2 AS b FROM (VALUES (1, 'x'), (2, NULL), (3, 'z')) WHERE column1 <> 2 OR column2 IS NULL", "SELECT * FROM (VALUES (1, 'x'), (2, NULL), (3, 'z')) v(a, b)")
dialect("sql_values_alone", "VALUES (1, 'a'), (2, 'b')", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) v(column1, column2)")
dialect("sql_params", "SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND o_orderstatus = ?2 AND o_custkey <> $3", "SELECT o_orderkey FROM orders WHERE o_totalprice > 90000.5 AND o_orderstatus = 'O' AND o_custkey <> 7", [90000.5, "O", 7])
dialect("sql_current_time", "SELECT n_nationkey, date('now') = CURRENT_DATE AS d, length(CURRENT_TIMESTAMP) AS n, datetime('now') >= '2024-01-01' AS later FROM nation", "SELECT n_nationkey, true AS d, 19 AS n, true AS later FROM nation")

# -- sources, joins, subqueries --------------------------------------------------------------

dialect("sql_series", "SELECT value FROM generate_series(10, 1, -3)", "SELECT value FROM (SELECT unnest(generate_series(10, 1, -3)) AS value)")
dialect("sql_series_lateral", "SELECT n_nationkey, value FROM nation, generate_series(1, n_nationkey % 4) AS s", "SELECT n_nationkey, CAST(value AS BIGINT) AS value FROM nation, LATERAL (SELECT unnest(generate_series(1, n_nationkey % 4)) AS value)")
dialect("sql_unnest", "SELECT vec_id, x FROM embeddings, unnest(slice(embedding, 1, 3)) AS u(x)", "SELECT vec_id, unnest(embedding[1:3]) AS x FROM embeddings")
dialect("sql_generate_subscripts", "SELECT vec_id, generate_subscripts(slice(embedding, 1, 4), 1) AS i FROM embeddings WHERE vec_id < 50", "SELECT vec_id, unnest(range(1, 5)) AS i FROM embeddings WHERE vec_id < 50")
dialect("sql_dual", "SELECT 1 + 1 AS two, 'x' AS x WHERE two = 2", "SELECT 2 AS two, 'x' AS x")
dialect("sql_anti_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderkey % 40 < 5)")
dialect("sql_anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 40 < 5)")
dialect("sql_not_in_null", "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 3) FROM orders WHERE o_totalprice > 100000) OR c_custkey < 4", "SELECT count(*) AS n FROM customer WHERE c_custkey < 4")
dialect("sql_join_kinds", "SELECT r.r_name, n.n_name, s.s_suppkey FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 0")
dialect("sql_join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name LIKE 'a%'", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND lower(r_name) LIKE 'a%'")
dialect("sql_mid_scope", "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > (SELECT avg(o_totalprice) FROM orders)) AS n FROM customer c")
dialect("sql_scalar_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) / 2 AS half FROM customer", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) / 2 AS half FROM customer")
dialect("sql_compound", "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region INTERSECT SELECT n_regionkey FROM nation ORDER BY k DESC LIMIT 4", "SELECT k FROM ((SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region) INTERSECT SELECT n_regionkey FROM nation) ORDER BY k DESC LIMIT 4")
dialect("sql_compound_all", "SELECT o_orderstatus AS s FROM orders EXCEPT ALL SELECT l_linestatus FROM lineitem WHERE l_quantity > 48")
dialect("sql_recursive_union", "WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT (n * 7 + 3) % 101 FROM r) SELECT n FROM r", "WITH RECURSIVE r(n) AS (SELECT 1::BIGINT UNION SELECT (n * 7 + 3) % 101 FROM r) SELECT n FROM r")
dialect("sql_recursive_graph", "WITH RECURSIVE e AS (SELECT n_regionkey AS src, n_nationkey AS dst FROM nation), reach(k) AS (SELECT 0 UNION SELECT dst FROM reach JOIN e ON src = k) SELECT k FROM reach",
    "WITH RECURSIVE e AS (SELECT n_regionkey AS src, n_nationkey AS dst FROM nation), reach(k) AS (SELECT 0 UNION SELECT dst FROM reach JOIN e ON src = k) SELECT k FROM reach")
dialect("sql_recursive_all", "WITH RECURSIVE f(i, a, b) AS (SELECT 1, 0, 1 UNION ALL SELECT i + 1, b, a + b FROM f WHERE i < 40) SELECT i, a FROM f", "WITH RECURSIVE f(i, a, b) AS (SELECT 1, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT i + 1, b, a + b FROM f WHERE i < 40) SELECT i, a FROM f")
dialect("sql_limit_negative", "SELECT n_name FROM nation ORDER BY n_name LIMIT -1 OFFSET -2", "SELECT n_name FROM nation")
dialect("sql_limit_comma", "SELECT n_name FROM nation ORDER BY n_name LIMIT 3, 5", "SELECT n_name FROM nation ORDER BY n_name LIMIT 5 OFFSET 3")
dialect("sql_order_nulls", "SELECT n_nationkey FROM nation ORDER BY nullif(n_regionkey, 1) DESC, n_nationkey LIMIT 20", "SELECT n_nationkey FROM nation ORDER BY nullif(n_regionkey, 1) DESC NULLS LAST, n_nationkey LIMIT 20")
dialect("sql_order_nulls_first", "SELECT n_nationkey FROM nation ORDER BY nullif(n_regionkey, 1), n_nationkey LIMIT 7", "SELECT n_nationkey FROM nation ORDER BY nullif(n_regionkey, 1) NULLS FIRST, n_nationkey LIMIT 7")
dialect("sql_order_expression", "SELECT p_partkey FROM part ORDER BY substr(p_name, 2), p_partkey LIMIT 9", "SELECT p_partkey FROM part ORDER BY substring(p_name, 2), p_partkey LIMIT 9")

# -- aggregates and windows --------------------------------------------------------------------

dialect("sql_total_concat", "SELECT n_regionkey, total(nullif(n_nationkey, 3)) AS t, group_concat(n_name ORDER BY n_name) AS g, group_concat(n_nationkey, '-' ORDER BY n_nationkey DESC) AS h FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, coalesce(sum(nullif(n_nationkey, 3))::DOUBLE, 0.0) AS t, string_agg(n_name, ',' ORDER BY n_name) AS g, string_agg(n_nationkey::VARCHAR, '-' ORDER BY n_nationkey DESC) AS h FROM nation GROUP BY n_regionkey")
dialect("sql_array_agg", "SELECT n_regionkey, array_join(transform(array_agg(nullif(n_nationkey % 2, 1) ORDER BY n_nationkey), x -> ifnull(x, 9)), '') AS a FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(CASE WHEN n_nationkey % 2 = 1 THEN '9' ELSE '0' END, '' ORDER BY n_nationkey) AS a FROM nation GROUP BY n_regionkey")
dialect("sql_scalar_min_max", "SELECT p_partkey, max(p_size, 20, 7) AS hi, min(p_size, 20, NULL) AS none, min(p_size, 20) AS lo FROM part", "SELECT p_partkey, greatest(p_size, 20, 7) AS hi, CAST(NULL AS INTEGER) AS none, least(p_size, 20) AS lo FROM part")
dialect("sql_bare_max", "SELECT o_custkey, max(o_orderkey) AS m, o_totalprice FROM orders GROUP BY o_custkey", "SELECT o_custkey, max(o_orderkey) AS m, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
dialect("sql_bare_min", "SELECT o_custkey, min(o_orderkey) AS m, o_orderstatus FROM orders GROUP BY o_custkey", "SELECT o_custkey, min(o_orderkey) AS m, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
dialect("sql_filter_having", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, sum(DISTINCT o_custkey % 10) AS s FROM orders GROUP BY 1 HAVING count(*) > 3 AND big >= 0")
dialect("sql_statistics", "SELECT o_orderstatus, round(stddev(o_totalprice), 0) AS s, round(var_pop(o_custkey), 0) AS v FROM orders GROUP BY o_orderstatus")
dialect("sql_window_filter", "SELECT o_orderkey, count(*) FILTER (WHERE o_totalprice > 50000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, sum(o_orderkey) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS s FROM orders",
    "SELECT o_orderkey, count(*) FILTER (WHERE o_totalprice > 50000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, (sum(o_orderkey) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey))::BIGINT AS s FROM orders")
dialect("sql_window_distinct", "SELECT o_orderkey, count(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) AS n, sum(DISTINCT o_orderkey % 5) OVER (PARTITION BY o_custkey) AS s FROM orders",
    "SELECT o_orderkey, count(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) AS n, (sum(DISTINCT o_orderkey % 5) OVER (PARTITION BY o_custkey))::BIGINT AS s FROM orders")
dialect("sql_window_group", "SELECT o_custkey / 50 AS k, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, o_custkey / 50) AS r FROM orders GROUP BY o_custkey / 50", "SELECT o_custkey // 50 AS k, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, o_custkey // 50) AS r FROM orders GROUP BY o_custkey // 50")

# -- functions -----------------------------------------------------------------------------------

dialect("sql_substr", "SELECT p_partkey, substr(p_name, 2, 4) AS a, substr(p_name, -3) AS b, substr(p_name, 0, 2) AS z, substring(p_name, 5, -2) AS back FROM part", "SELECT p_partkey, substring(p_name, 2, 4) AS a, right(p_name, 3) AS b, substring(p_name, 1, 1) AS z, substring(p_name, 3, 2) AS back FROM part")
dialect("sql_trims", "SELECT c_custkey, ltrim(c_name, 'Cu') AS l, rtrim(c_name, '0123') AS r, trim(c_name, 'C0') AS t, ltrim('  a ') || '|' AS ls, rtrim(' a  ') || '|' AS rs FROM customer", "SELECT c_custkey, ltrim(c_name, 'Cu') AS l, rtrim(c_name, '0123') AS r, trim(c_name, 'C0') AS t, 'a |' AS ls, ' a|' AS rs FROM customer")
dialect("sql_text", "SELECT c_custkey, lower(c_name) AS lo, upper(c_name) AS up, length(c_name) AS n, replace(c_name, '0', 'o') AS rep, instr(c_name, '#') AS i, strpos(c_name, '#') AS j, position('0' IN c_name) AS k, unicode(c_name) AS u, hex(c_name) AS h, char(67, 98) AS ch, char_length(c_name) AS cl FROM customer",
    "SELECT c_custkey, lower(c_name) AS lo, upper(c_name) AS up, length(c_name) AS n, replace(c_name, '0', 'o') AS rep, instr(c_name, '#') AS i, instr(c_name, '#') AS j, instr(c_name, '0') AS k, unicode(c_name) AS u, hex(c_name) AS h, 'Cb' AS ch, length(c_name) AS cl FROM customer")
dialect("sql_splice", "SELECT c_custkey, splice(c_name, 0, 8, 'X') AS s FROM customer", "SELECT c_custkey, 'X' || substr(c_name, 9) AS s FROM customer")
dialect("sql_printf", "SELECT p_partkey, printf('%05d|%-8s|%.2f', p_size, p_brand, p_retailprice) AS p, quote(p_name) AS q, typeof(p_size) AS t, quote(NULL) AS n FROM part", "SELECT p_partkey, printf('%05d|%-8s|%.2f', p_size, p_brand, p_retailprice) AS p, '''' || replace(p_name, '''', '''''') || '''' AS q, 'integer' AS t, 'NULL' AS n FROM part")
dialect("sql_round", "SELECT c_custkey, round(c_acctbal) AS r, round(2.675, 2) AS down, round(c_acctbal, 1) AS one, ceil(c_acctbal) AS ce, ceiling(c_acctbal) AS c2, floor(c_acctbal) AS f, trunc(c_acctbal) AS t, sign(c_acctbal) AS s, abs(c_acctbal) AS a FROM customer WHERE abs(round(c_acctbal * 100)) % 10 <> 5",
    "SELECT c_custkey, round(c_acctbal) AS r, 2.67::DOUBLE AS down, round(c_acctbal, 1) AS one, ceil(c_acctbal) AS ce, ceil(c_acctbal) AS c2, floor(c_acctbal) AS f, trunc(c_acctbal) AS t, sign(c_acctbal)::BIGINT AS s, abs(c_acctbal) AS a FROM customer WHERE abs(round(c_acctbal * 100)) % 10 <> 5")
dialect("sql_logs", "SELECT c_custkey, ln(c_custkey) AS l, log(c_custkey) AS lg, log10(c_custkey) AS l10, log2(c_custkey) AS l2, log(3, c_custkey) AS l3, ln(-c_custkey) AS none, exp(c_custkey / 1000.0) AS e, sqrt(c_custkey) AS s, sqrt(-1.0) AS ns, pow(c_custkey, 0.5) AS p, power(c_custkey, 2) AS p2, mod(c_custkey, 7) AS m FROM customer WHERE c_custkey > 0",
    "SELECT c_custkey, ln(c_custkey) AS l, log10(c_custkey) AS lg, log10(c_custkey) AS l10, log2(c_custkey) AS l2, ln(c_custkey) / ln(3) AS l3, CAST(NULL AS DOUBLE) AS none, exp(c_custkey / 1000.0) AS e, sqrt(c_custkey) AS s, CAST(NULL AS DOUBLE) AS ns, pow(c_custkey, 0.5) AS p, pow(c_custkey, 2) AS p2, (c_custkey % 7)::DOUBLE AS m FROM customer WHERE c_custkey > 0")
_ANGLES = "SELECT c_custkey, {r}sin(c_custkey){e} AS a, {r}cos(c_custkey){e} AS b, {r}tan(c_custkey / 10000.0){e} AS c, {r}asin(c_custkey / 1000000.0){e} AS d, {r}acos(c_custkey / 1000000.0){e} AS f, {r}atan(c_custkey){e} AS g, {r}atan2(c_custkey, 2){e} AS h, {r}sinh(c_custkey / 10000.0){e} AS i, {r}cosh(c_custkey / 10000.0){e} AS j, {r}tanh(c_custkey / 1000.0){e} AS k, {r}radians(c_custkey){e} AS l, {r}degrees(c_custkey){e} AS m, {r}pi(){e} AS n FROM customer"
dialect("sql_angles", _ANGLES.format(r="CAST(", e=" * 1000000 AS INTEGER)"), _ANGLES.format(r="CAST(trunc(", e=" * 1000000) AS BIGINT)"))
dialect("sql_dates", "SELECT o_orderkey, date(o_orderdate) AS d, time(o_orderdate) AS t, datetime(o_orderdate) AS dt, strftime('%Y/%m %j %w', o_orderdate) AS f, julianday(date(o_orderdate)) AS j FROM orders",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS dt, strftime(o_orderdate, '%Y/%m %j %w') AS f, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 2440587.5::DOUBLE AS j FROM orders")
dialect("sql_json_read", "SELECT n_nationkey, json_extract(j, '$.a[1]') AS x, j -> '$.b' AS ar, j ->> 'b' AS at, json_type(j, '$.a') AS ty, json_array_length(j, '$.a') AS n, json_valid(j) AS v, json(j) AS m FROM (SELECT n_nationkey, '{\"a\": [1, ' || n_nationkey || '], \"b\": \"' || n_name || '\"}' AS j FROM nation)",
    "SELECT n_nationkey, n_nationkey::VARCHAR AS x, '\"' || n_name || '\"' AS ar, n_name AS at, 'array' AS ty, 2 AS n, 1 AS v, '{\"a\":[1,' || n_nationkey || '],\"b\":\"' || n_name || '\"}' AS m FROM nation")
dialect("sql_json_write", "SELECT n_nationkey, json_set('{\"a\":1}', '$.b', n_nationkey) AS s, json_insert('{\"a\":1}', '$.a', 5) AS i, json_replace('{\"a\":1}', '$.a', n_name) AS r, json_remove('[1,2,3]', '$[1]') AS m, json_patch('{\"a\":1}', '{\"c\":' || n_nationkey || '}') AS p FROM nation",
    "SELECT n_nationkey, '{\"a\":1,\"b\":' || n_nationkey || '}' AS s, '{\"a\":1}' AS i, '{\"a\":\"' || n_name || '\"}' AS r, '[1,3]' AS m, '{\"a\":1,\"c\":' || n_nationkey || '}' AS p FROM nation")
dialect("sql_json_build", "SELECT n_nationkey, json_array(n_nationkey, n_name, NULL, 1.5) AS a, json_object('k', n_nationkey, 'v', json_array(1)) AS o, json_build_array(n_name) AS ba, json_build_object('x', n_name) AS bo, json_quote(n_name) AS q, json_quote(json_extract('{\"a\":[1,2]}', '$.a')) AS x FROM nation",
    "SELECT n_nationkey, '[' || n_nationkey || ',\"' || n_name || '\",null,1.5]' AS a, '{\"k\":' || n_nationkey || ',\"v\":[1]}' AS o, '[\"' || n_name || '\"]' AS ba, '{\"x\":\"' || n_name || '\"}' AS bo, '\"' || n_name || '\"' AS q, '[1,2]' AS x FROM nation")
dialect("sql_vectors", "SELECT vec_id, round(vec_l2(embedding, reverse(embedding)), 4) AS l, round(vec_cosine(embedding, reverse(embedding)), 4) AS c FROM embeddings",
    "SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ^ 2))), 4) AS l, round(1 - list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 4) AS c FROM embeddings")
dialect("sql_catalog_functions", "SELECT n_nationkey, pg_typeof(n_name) AS t, format_type(n_regionkey) AS f, has_table_privilege('nation', 'select') AS p, version() IS NOT NULL AS v FROM nation", "SELECT n_nationkey, 'text' AS t, 'bigint' AS f, true AS p, true AS v FROM nation")
dialect("sql_maps", "SELECT n_nationkey, element_at(map('a', n_name, 'b', 'x'), 'a') AS m, cardinality(map('a', 1, 'b', 2)) AS n FROM nation", "SELECT n_nationkey, n_name AS m, 2 AS n FROM nation")


def _knn(spark: SparkSession, path: str) -> DataFrame:
    engine = Engine(spark)
    engine.register("embeddings", spark.read.parquet(f"{path}/embeddings.parquet"))
    engine.install_model_operators({"tables": {"embeddings": {"role": "embedding", "knn": True}}})
    unit = "array(" + ", ".join("1D" if i == 0 else "0D" for i in range(64)) + ")"
    return engine.query(f"SELECT vec_id FROM embeddings ORDER BY embedding :~: {unit}, vec_id LIMIT 10")


QUERIES["sql_knn_operator"] = _knn
ORACLE_SQL["sql_knn_operator"] = "SELECT vec_id FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], list_transform(range(64), lambda i: CASE WHEN i = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE[]), vec_id LIMIT 10"


def _edge(spark: SparkSession, path: str) -> DataFrame:
    engine = Engine(spark)
    engine.register("nation", spark.read.parquet(f"{path}/nation.parquet"))
    engine.register("edge", spark.sql("SELECT n_regionkey AS src, n_nationkey AS dst FROM nation"))
    engine.install_model_operators({"tables": {"edge": {"role": "edge", "traverse": ["src", "dst"]}}})
    return engine.query("SELECT n_nationkey FROM nation WHERE 2 :->: n_nationkey")


QUERIES["sql_edge_operator"], ORACLE_SQL["sql_edge_operator"] = _edge, "SELECT n_nationkey FROM nation WHERE n_regionkey = 2"


def _macro(spark: SparkSession, path: str) -> DataFrame:
    engine = Engine(spark)
    engine.register("orders", spark.read.parquet(f"{path}/orders.parquet"))
    engine.macros.define(":near:", "abs({left} - {right}) < 5000")
    return engine.query("SELECT o_orderkey, 'a :near: b' AS t FROM orders WHERE o_totalprice :near: 50000")


QUERIES["sql_macro_quoted"], ORACLE_SQL["sql_macro_quoted"] = _macro, "SELECT o_orderkey, 'a :near: b' AS t FROM orders WHERE abs(o_totalprice - 50000) < 5000"


def _host_functions(spark: SparkSession, path: str) -> DataFrame:
    import statistics

    engine = Engine(spark)
    engine.register("part", spark.read.parquet(f"{path}/part.parquet"))
    engine.create_function("twice", lambda x: None if x is None else 2 * x, "bigint")
    engine.create_aggregate("middle", lambda xs: statistics.median_low(x for x in xs if x is not None), "bigint")
    return engine.query("SELECT p_brand, middle(x) AS m FROM (SELECT p_brand, twice(p_size) AS x FROM part) AS t GROUP BY p_brand")


QUERIES["sql_host_functions"], ORACLE_SQL["sql_host_functions"] = _host_functions, "SELECT p_brand, (2 * quantile_disc(p_size, 0.5))::BIGINT AS m FROM part GROUP BY p_brand"


def _plpgsql(spark: SparkSession, path: str) -> DataFrame:
    engine = Engine(spark)
    engine.register("part", spark.read.parquet(f"{path}/part.parquet"))
    engine.create_plpgsql("CREATE FUNCTION tri(n integer) RETURNS integer AS $$ DECLARE s integer := 0; BEGIN FOR i IN 1..n LOOP s := s + i; END LOOP; RETURN s; END; $$ LANGUAGE plpgsql", "bigint")
    return engine.query("SELECT p_partkey, tri(p_size) AS t FROM part")


QUERIES["sql_plpgsql"], ORACLE_SQL["sql_plpgsql"] = _plpgsql, "SELECT p_partkey, (p_size * (p_size + 1) // 2)::BIGINT AS t FROM part"


def _collation(spark: SparkSession, path: str) -> DataFrame:
    from ..functions import collation

    collation.register("BACKWARDS", lambda v: v[::-1])
    engine = Engine(spark)
    engine.register("nation", spark.read.parquet(f"{path}/nation.parquet"))
    return engine.query("SELECT n_name FROM nation ORDER BY n_name COLLATE BACKWARDS LIMIT 5")


QUERIES["sql_host_collation"], ORACLE_SQL["sql_host_collation"] = _collation, "SELECT n_name FROM nation ORDER BY reverse(n_name) LIMIT 5"

# -- statements that change tables -----------------------------------------------------------------


@database("SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'none' END AS kind FROM nation UNION ALL SELECT 100, 'x', 'none' UNION ALL SELECT 101, 'y', 'none'")
def ddl_create_insert(db, source):
    source("nation")
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, kind TEXT DEFAULT 'none' CHECK (length(kind) < 9))")
    db.execute("CREATE TABLE IF NOT EXISTS t (other INTEGER)")
    db.execute("INSERT INTO t SELECT n_nationkey, n_name, iif(n_nationkey % 2 = 0, 'even', 'none') FROM src_nation")
    db.execute("INSERT INTO t (id, name) VALUES (?, 'x'), (101, ?)", [100, "y"])
    return db.query("SELECT * FROM t")


@database("SELECT 1::BIGINT AS id, 7::BIGINT AS v UNION ALL SELECT 2, 7")
def dml_default_values(db, source):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v INTEGER DEFAULT (3 + 4))")
    db.execute("INSERT INTO t DEFAULT VALUES")
    db.execute("INSERT INTO t DEFAULT VALUES")
    return db.query("SELECT * FROM t")


@database("SELECT * FROM (VALUES (1, 'last', 'a'), (3, 'c', 'c'), (4, 'new', 'b')) v(id, t, u)")
def dml_or_replace(db, source):
    """The last proposal stays; a clash on another unique key takes the old row away."""
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, t TEXT, u TEXT UNIQUE)")
    db.execute("INSERT INTO t VALUES (1, 'a', 'a'), (2, 'b', 'b'), (3, 'c', 'c')")
    db.execute("INSERT OR REPLACE INTO t VALUES (1, 'first', 'z'), (1, 'last', 'a'), (4, 'new', 'b')")
    return db.query("SELECT * FROM t")


@database("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) v(id, u)")
def dml_or_ignore(db, source):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, u TEXT UNIQUE)")
    db.execute("INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    db.execute("INSERT OR IGNORE INTO t VALUES (1, 'x'), (9, 'a'), (3, 'c'), (3, 'd'), (8, 'c')")
    return db.query("SELECT * FROM t")


@database("SELECT * FROM (VALUES (1, 16), (2, 5)) v(id, n)")
def dml_upsert_repeated(db, source):
    """Proposals of one key take effect one after another."""
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER)")
    db.execute("INSERT INTO t VALUES (1, 10)")
    db.execute("INSERT INTO t VALUES (1, 1), (1, 2), (2, 5), (1, 3) ON CONFLICT (id) DO UPDATE SET n = n + excluded.n")
    return db.query("SELECT * FROM t")


@database("SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS name FROM nation WHERE n_regionkey <> 3")
def dml_update_delete_sql(db, source):
    source("nation")
    db.execute("CREATE TABLE t AS SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM src_nation")
    db.execute("UPDATE t SET name = upper(name) || '!' WHERE r = ?", [1])
    db.execute("DELETE FROM t WHERE r / 1 = 3")
    return db.query("SELECT k, name FROM t")


@database("SELECT n_nationkey AS k, n_regionkey * 2 AS twice FROM nation WHERE n_regionkey > 2")
def dml_returning_sql(db, source):
    source("nation")
    db.execute("CREATE TABLE t AS SELECT n_nationkey AS k, n_regionkey AS r FROM src_nation")
    return db.execute("UPDATE t SET r = r * 2 WHERE r > 2 RETURNING k, r AS twice")


@database("SELECT * FROM (VALUES (1, 'a', true), (2, 'a', false), (3, 'b', false), (4, 'a', false)) v(id, u, live)")
def ddl_partial_index(db, source):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, u TEXT, live BOOLEAN)")
    db.execute("INSERT INTO t VALUES (1, 'a', true), (2, 'a', false), (3, 'b', false)")
    db.execute("CREATE UNIQUE INDEX i ON t (u) WHERE live")
    db.execute("INSERT INTO t VALUES (4, 'a', false)")
    try:
        db.execute("INSERT INTO t VALUES (5, 'a', true)")
        raise AssertionError("the clash was not seen")
    except ValueError:
        return db.query("SELECT * FROM t")


@database("SELECT * FROM (VALUES ('t', 'two words', 2), ('u', NULL, 3)) v(a, c, n)")
def ddl_alter(db, source):
    db.execute("CREATE TABLE t (a TEXT, b TEXT, n INTEGER)")
    db.execute("INSERT INTO t VALUES ('t', 'x', 1), ('u', 'y', 2)")
    db.execute("ALTER TABLE t ADD COLUMN c TEXT DEFAULT 'two words'")
    db.execute("ALTER TABLE t DROP COLUMN b")
    db.execute("ALTER TABLE t RENAME COLUMN n TO m")
    db.execute("ALTER TABLE t RENAME TO s")
    db.execute("UPDATE s SET c = NULL, m = m WHERE a = 'u'")
    db.execute("CREATE TABLE gone (x INTEGER)")
    db.execute("DROP TABLE gone")
    return db.query("SELECT a, c, m + 1 AS n FROM s")


@database("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 1")
def ddl_view(db, source):
    """A view is there when the database is opened again."""
    source("nation")
    db.execute("CREATE TABLE t AS SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM src_nation")
    db.execute("CREATE VIEW one AS SELECT k, name FROM t WHERE r = 3 / 2")
    return Database(db.spark, db.catalog.root).query("SELECT * FROM one")


@database("SELECT * FROM (VALUES ('t', 'about'), ('t.k', 'key')) v(what, comment)")
def ddl_comment(db, source):
    db.execute("CREATE TABLE t (k INTEGER)")
    db.execute("COMMENT ON TABLE t IS 'about'")
    db.execute("COMMENT ON COLUMN t.k IS 'key'")
    rows = [(f"t.{c}" if c else "t", text) for c, text in db.catalog.info("t")["comments"].items()]
    return db.spark.createDataFrame(rows, "what string, comment string")


@database("SELECT 'insert' AS what, n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey > 4 UNION ALL SELECT 'update', n_nationkey, n_name || ' > x' FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'delete', n_nationkey, n_name FROM nation WHERE n_nationkey = 9")
def ddl_trigger(db, source):
    source("nation")
    db.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, name TEXT)")
    db.execute("CREATE TABLE log (what TEXT, k INTEGER, name TEXT)")
    db.execute("CREATE TRIGGER a AFTER INSERT ON t FOR EACH ROW WHEN NEW.k > 4 BEGIN INSERT INTO log VALUES ('insert', NEW.k, NEW.name); END")
    db.execute("CREATE TRIGGER b AFTER UPDATE OF name ON t BEGIN INSERT INTO log SELECT 'update', NEW.k, OLD.name || ' > ' || NEW.name; END")
    db.execute("CREATE TRIGGER c AFTER DELETE ON t BEGIN INSERT INTO log VALUES ('delete', OLD.k, OLD.name); END")
    db.execute("INSERT INTO t SELECT n_nationkey, n_name FROM src_nation")
    db.execute("UPDATE t SET name = 'x' WHERE k = 7")
    db.execute("UPDATE t SET k = k WHERE k = 8")
    db.execute("DELETE FROM t WHERE k = 9")
    return db.query("SELECT * FROM log")


@database("SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY n_regionkey")
def ddl_trigger_update(db, source):
    """Many rows set a trigger off for one target row: it takes all their changes."""
    source("nation")
    db.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, r INTEGER)")
    db.execute("CREATE TABLE counts (r INTEGER PRIMARY KEY, n INTEGER)")
    db.execute("INSERT INTO counts SELECT DISTINCT n_regionkey, 0 FROM src_nation")
    db.execute("CREATE TRIGGER up AFTER INSERT ON t BEGIN UPDATE counts SET n = n + 1 WHERE r = NEW.r; END")
    db.execute("INSERT INTO t SELECT n_nationkey, n_regionkey FROM src_nation")
    return db.query("SELECT * FROM counts")


@database("SELECT c_custkey AS k FROM customer WHERE c_nationkey = 4")
def ddl_policy(db, source):
    source("customer")
    db.execute("CREATE TABLE t AS SELECT c_custkey AS k, c_nationkey AS n FROM src_customer")
    db.execute("CREATE POLICY mine ON t USING (n = current_setting('nation'))")
    db.execute("ALTER TABLE t ENABLE ROW LEVEL SECURITY")
    db.setting("nation", 4)
    return db.query("SELECT k FROM t")


@database("SELECT doc_id AS rowid FROM documents WHERE regexp_matches(lower(coalesce(text, '')), '(^|[^\\p{L}\\p{N}])license([^\\p{L}\\p{N}]|$)')")
def ddl_virtual_fts(db, source):
    source("documents")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(body, tokenize = 'unicode61')")
    db.execute("INSERT INTO f (rowid, body) SELECT doc_id, text FROM src_documents")
    return db.query("SELECT rowid FROM f WHERE f MATCH 'license'")


@database("SELECT * FROM (VALUES (1, 2), (2, 4), (3, 6)) v(k, d)")
def ddl_function(db, source):
    db.execute("CREATE FUNCTION dbl(n integer) RETURNS integer AS $$ BEGIN RETURN n + n; END; $$ LANGUAGE plpgsql")
    db.execute("CREATE TABLE t (k INTEGER)")
    db.execute("INSERT INTO t VALUES (1), (2), (3)")
    return db.query("SELECT k, dbl(k) AS d FROM t")


@database("SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_regionkey <> 2")
def ddl_foreign_keys(db, source):
    """Deleting cascades; moving a key that has children is refused."""
    source("nation")
    db.execute("CREATE TABLE region (r INTEGER PRIMARY KEY)")
    db.execute("CREATE TABLE nation (k INTEGER PRIMARY KEY, r INTEGER REFERENCES region (r) ON DELETE CASCADE)")
    db.execute("INSERT INTO region SELECT DISTINCT n_regionkey FROM src_nation")
    db.execute("INSERT INTO nation SELECT n_nationkey, n_regionkey FROM src_nation")
    db.execute("DELETE FROM region WHERE r = 2")
    try:
        db.execute("UPDATE region SET r = 77 WHERE r = 3")
        raise AssertionError("orphans were made")
    except ValueError:
        return db.query("SELECT k, r FROM nation")


@database("SELECT n_nationkey AS k FROM nation WHERE n_regionkey IN (1, 3)")
def ddl_transactions(db, source):
    source("nation")
    db.execute("CREATE TABLE t (k INTEGER)")
    db.execute("BEGIN")
    db.execute("INSERT INTO t SELECT n_nationkey FROM src_nation WHERE n_regionkey = 1")
    db.execute("SAVEPOINT a")
    db.execute("INSERT INTO t SELECT n_nationkey FROM src_nation WHERE n_regionkey = 2")
    db.execute("ROLLBACK TO a")
    db.execute("INSERT INTO t SELECT n_nationkey FROM src_nation WHERE n_regionkey = 3")
    db.execute("COMMIT")
    db.execute("BEGIN")
    db.execute("DELETE FROM t")
    db.execute("ROLLBACK")
    return db.query("SELECT k FROM t")


@database("SELECT n_nationkey AS k, n_name || ' it''s' AS name FROM nation")
def database_dump(db, source):
    """A dump, run as a script, makes the same tables."""
    source("nation")
    db.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, name TEXT)")
    db.execute("INSERT INTO t SELECT n_nationkey, n_name || ' it''s' FROM src_nation")
    text = db.dump()
    rows = [x for x in text if x.startswith("INSERT")]
    head = rows[0].split(" VALUES ")[0]
    other = Database(db.spark, folder(db.spark, "db"))
    other.script(";\n".join([*(x for x in text if not x.startswith("INSERT")), head + " VALUES " + ", ".join(r.split(" VALUES ", 1)[1] for r in rows)]))
    return other.query("SELECT * FROM t")


@database("SELECT n_nationkey AS k FROM nation")
def database_backup(db, source):
    source("nation")
    db.execute("CREATE TABLE t AS SELECT n_nationkey AS k FROM src_nation")
    copy = db.backup(folder(db.spark, "backup"))
    db.execute("DELETE FROM t")
    return copy.query("SELECT k FROM t")


@database("SELECT n_nationkey AS k, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def database_attach(db, source):
    source("nation")
    source("region")
    other = Database(db.spark, folder(db.spark, "other"))
    other.execute("CREATE TABLE region AS SELECT r_regionkey AS r, r_name AS name FROM src_region")
    db.execute("CREATE TABLE nation AS SELECT n_nationkey AS k, n_regionkey AS r FROM src_nation")
    db.catalog.attach("far", other.catalog.root)
    return db.query("SELECT n.k, f.name FROM nation n JOIN far_region f ON n.r = f.r")


@database("SELECT n_nationkey AS k, n_name || '/' || 7 AS name FROM nation WHERE n_nationkey >= 20")
def ddl_procedure(db, source):
    source("nation")
    db.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, name TEXT)")
    db.execute("CREATE PROCEDURE fill (low integer, mark text) AS $$ INSERT INTO t SELECT n_nationkey, n_name FROM src_nation WHERE n_nationkey >= :low; UPDATE t SET name = name || :mark; SELECT * FROM t $$")
    return db.execute("CALL fill(4 * ?, '/' || 7)", [5])
