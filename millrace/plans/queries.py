"""Every operator as a query over the driver's tables, beside its SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import casts, dates, jsons, maths, predicates, strings, vectors
from ..operators import aggregates, constraints, dml, graph, joins, knn, recursion, routing, search, series, sets, sorting, windows
from ..streaming import cdc, events, ingest, lens, sync
from .engine import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """Lazy readers of one folder's Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLE_SQL[key] = sql
        return fn

    return add


def spark_sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query that is the same SQL in both engines, or has its own oracle text."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        t = Tables(spark, folder)
        engine = Engine(spark)
        for x in TABLES:
            if x in text:
                engine.register(x, getattr(t, x))
        return engine.native(text)

    QUERIES[name], ORACLE_SQL[name] = run, oracle or text


c = F.col

# -- scans and sources ------------------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 77")
def scan_pk_point(t):
    return t.customer.where("c_custkey = 77").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 180")
def scan_pk_range(t):
    return t.orders.where((c("o_orderkey") >= 100) & (c("o_orderkey") < 180)).select("o_orderkey", "o_totalprice")


@query("SELECT * FROM nation")
def scan_full(t):
    return t.nation


@query("SELECT value FROM (SELECT unnest(generate_series(10, 1, -3)) AS value)")
def series_scan(t):
    return series.generate_series(t.spark, 10, 1, -3)


@query("SELECT n_nationkey, CAST(value AS BIGINT) AS value FROM nation, LATERAL (SELECT unnest(generate_series(1, n_nationkey % 4)) AS value)")
def series_lateral(t):
    return series.series_of(t.nation.select("n_nationkey"), F.lit(1), c("n_nationkey") % 4)


@query("SELECT 1 + 1 AS two, 'x' AS x")
def from_less(t):
    return series.dual(t.spark).select(F.lit(2).alias("two"), F.lit("x").alias("x"))


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, 'b'), (NULL, 'c')) v(column1, column2)")
def values_scan(t):
    return series.values(t.spark, [(1, "a"), (2, "b"), (None, "c")], ["long", "string"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'patched' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 10 <> 5")
def overlay_scan(t):
    from ..sources.catalog import overlay

    base = t.customer.select("c_custkey", "c_name")
    return overlay(base, base.where("c_custkey % 10 = 0").withColumn("c_name", F.lit("patched")), base.where("c_custkey % 10 = 5").select("c_custkey"), ["c_custkey"])


# -- projection, predicates, operators --------------------------------------------------


@query("""SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderkey // (o_custkey % 5) END AS z,
          o_orderkey & 12 AS band, o_orderkey | 3 AS bor, o_orderkey << 3 AS shl, o_orderkey >> 2 AS shr FROM orders""")
def arithmetic(t):
    k, d = c("o_orderkey"), c("o_custkey") % 5
    return t.orders.select("o_orderkey", maths.int_div(k, F.lit(7)).alias("q"), maths.mod(k, F.lit(7)).alias("r"), maths.int_div(k, d).alias("z"), k.bitwiseAND(12).alias("band"), k.bitwiseOR(3).alias("bor"), maths.shift_left(k, F.lit(3)).alias("shl"), maths.shift_right(k, F.lit(2)).alias("shr"))


@query("SELECT p_partkey FROM part WHERE translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%a_e%'")
def like_nocase(t):
    return t.part.where(predicates.like(c("p_name"), "%A_E%")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_type, '[A-M].*[^0-9]$')")
def glob_match(t):
    return t.part.where(predicates.glob(c("p_type"), "*[A-M]*[^0-9]")).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[0-4]{2}$')")
def regexp_match(t):
    return t.customer.where(predicates.regexp(c("c_name"), "[0-4]{2}$")).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_custkey) < ('O', 40)")
def row_value_compare(t):
    return t.orders.where(predicates.row_lt([c("o_orderstatus"), c("o_custkey")], [F.lit("O"), F.lit(40)])).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 3 END IS DISTINCT FROM 1 AS d, (CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 3 END) NOT IN (2, NULL) AS n FROM orders")
def null_logic(t):
    x = F.when(c("o_orderkey") % 3 != 0, c("o_orderkey") % 3)
    return t.orders.select("o_orderkey", predicates.distinct_from(x, F.lit(1)).alias("d"), predicates.not_in_list(x, [2, None]).alias("n"))


@query("SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS n, coalesce(TRY_CAST(regexp_extract(substr(props, 6), '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+))', 1) AS DOUBLE), 0.0) AS r FROM events")
def affinity_cast(t):
    found = F.regexp_extract("props", "[0-9]+", 0)
    return t.events.select("event_id", F.when(found != "", casts.to_integer(found)).alias("n"), casts.to_real(F.substring("props", F.lit(6), F.char_length("props"))).alias("r"))


spark_sql("case_coalesce", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS s, coalesce(nullif(o_orderstatus, 'F'), 'none') AS k FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000")


@query("SELECT o_orderkey FROM orders WHERE abs(o_totalprice - 50000) < 5000", name="macro_operator")
def _macro(t):
    engine = Engine(t.spark)
    engine.register("orders", t.orders)
    engine.macros.define(":near:", "abs({left} - {right}) < 5000")
    return engine.query("SELECT o_orderkey FROM orders WHERE o_totalprice :near: 50000")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 100")
def session_settings(t):
    engine = Engine(t.spark)
    engine.register("customer", t.customer)
    engine.setting("segments", ["BUILDING", "MACHINERY"])
    return engine.query("SELECT c_custkey FROM customer WHERE c_mktsegment IN (current_setting('segments')) AND c_acctbal > ?", [100])


# -- joins --------------------------------------------------------------------------------

spark_sql("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
spark_sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
spark_sql("join_right", "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
spark_sql("join_full", "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey AND c.c_acctbal > 0")
spark_sql("join_cross", "SELECT r_name, n_name FROM region, nation")
spark_sql("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
spark_sql("join_theta", "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON n_nationkey > r_regionkey * 5 AND n_nationkey <= r_regionkey * 5 + 2")
spark_sql("join_derived", "SELECT c_name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) x ON c_custkey = o_custkey")
spark_sql("join_star", "SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY n_name")
spark_sql("semi_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
spark_sql("anti_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderkey % 40 < 5)")


@query("SELECT * FROM (SELECT n_regionkey AS r_regionkey, n_name FROM nation) JOIN region USING (r_regionkey)")
def join_using(t):
    return joins.using(t.nation.select(c("n_regionkey").alias("r_regionkey"), "n_name"), t.region, "r_regionkey")


@query("SELECT * FROM (SELECT n_regionkey AS r_regionkey, n_name FROM nation) NATURAL JOIN region")
def join_natural(t):
    return joins.natural(t.nation.select(c("n_regionkey").alias("r_regionkey"), "n_name"), t.region)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 40 < 5)")
def anti_not_in(t):
    return joins.not_in(t.customer, "c_custkey", t.orders.where("o_orderkey % 40 < 5"), "o_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_custkey > 10 THEN o_custkey END FROM orders)")
def anti_not_in_null(t):
    return joins.not_in(t.customer, "c_custkey", t.orders.select(F.when(c("o_custkey") > 10, c("o_custkey")).alias("k")), "k").select("c_custkey")


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size BETWEEN s_suppkey AND s_suppkey + 3")
def join_range(t):
    return joins.range_join(t.part, t.supplier.withColumn("hi", c("s_suppkey") + 3), "p_size", "s_suppkey", "hi", 4).select("p_partkey", "s_suppkey")


@query("""SELECT e.event_id, p.event_id AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def join_asof(t):
    bought = t.events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_purchase"))
    return joins.asof_join(t.events.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", ["last_purchase"]).select("event_id", "last_purchase")


@query(ORACLE_SQL["join_asof"].replace("e.user_id = p.user_id AND ", "").replace("user_id, ts, max(event_id)", "ts, max(event_id)"))
def join_asof_hot(t):
    """All rows under one key, cut by hours."""
    bought = t.events.where("event_type = 'purchase'").groupBy("ts").agg(F.max("event_id").alias("last_purchase")).withColumn("k", F.lit(1))
    rows = t.events.select("event_id", "ts", F.lit(1).alias("k"))
    return joins.asof_join(rows, bought, ["k"], "ts", ["last_purchase"], lambda x: F.date_trunc("hour", x)).select("event_id", "last_purchase")


# -- aggregates ---------------------------------------------------------------------------

spark_sql("tpch_q1", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
    round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")
spark_sql("agg_small_groups", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS s, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag")
spark_sql("agg_large_groups", "SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_orderkey")
spark_sql("agg_having_ordinal", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 10")
spark_sql("agg_filter_distinct", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, count(DISTINCT o_custkey) AS custs, bool_and(o_totalprice > 0) AS pos, bool_or(o_totalprice > 300000) AS huge FROM orders GROUP BY o_orderstatus")
spark_sql("agg_count_only", "SELECT count(*) AS n FROM lineitem")
spark_sql("agg_min_max", "SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
spark_sql("agg_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
spark_sql("agg_distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
spark_sql("agg_scan_multi", "SELECT round(sum(l_extendedprice), 2) AS a, round(avg(l_discount), 8) AS b, min(l_quantity) AS d, max(l_quantity) AS e, count(l_tax) AS f FROM lineitem WHERE l_quantity < 24 AND l_discount BETWEEN 0.02 AND 0.06")
spark_sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, coalesce(sum(CASE WHEN n_nationkey > 10 THEN n_nationkey END)::DOUBLE, 0.0) AS total FROM nation GROUP BY n_regionkey")
def agg_group_concat_total(t):
    return t.nation.groupBy("n_regionkey").agg(aggregates.group_concat(c("n_name"), c("n_name")).alias("names"), aggregates.total(F.when(c("n_nationkey") > 10, c("n_nationkey"))).alias("total"))


@query("SELECT n_regionkey, array_to_string(list(CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE 'NULL' END ORDER BY n_nationkey), ';') AS keys FROM nation GROUP BY n_regionkey")
def agg_array_agg_nulls(t):
    keys = aggregates.array_agg(F.when(c("n_nationkey") % 2 == 0, c("n_nationkey")), c("n_nationkey"))
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.transform(keys, lambda x: F.coalesce(x.cast("string"), F.lit("NULL"))), ";").alias("keys"))


@query("""SELECT o_custkey, m, o_orderkey FROM (SELECT o_custkey, o_totalprice AS m, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def agg_bare_max(t):
    return t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("m"), aggregates.bare_with_max("o_orderkey", "o_totalprice", "o_orderkey").alias("o_orderkey"))


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS p, count(*) AS n FROM orders GROUP BY o_custkey")
def agg_bare_first(t):
    return t.orders.groupBy("o_custkey").agg(aggregates.bare_first("o_orderpriority", "o_orderkey").alias("p"), F.count("*").alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def agg_salted_distinct(t):
    return aggregates.salted_count(t.events, ["event_type"], "user_id")


# -- windows ------------------------------------------------------------------------------

_RANKS = "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)"
spark_sql("win_ranks", _RANKS)
spark_sql("win_ntile_lag", "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nt, lag(o_orderkey, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS lg, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ld FROM orders")
spark_sql("win_values", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
spark_sql("win_rows_frame", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS s FROM lineitem")
spark_sql("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM part")
spark_sql("win_default_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS running, count(*) OVER (PARTITION BY p_brand) AS whole FROM part")
@query("SELECT o_custkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, o_custkey) AS r FROM orders GROUP BY o_custkey HAVING count(*) > 2")
def win_over_group(t):
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 2")
    return windows.global_rank(n, [("n", True), ("o_custkey", False)]).select("o_custkey", "n", c("rank").alias("r"))



@query("SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS s FROM part")
def win_groups_frame(t):
    return windows.groups_frame(t.part, ["p_brand"], [c("p_size")], -1, 1, {"s": F.sum("p_size")}).select("p_partkey", "s")


def _exclude(kind: str):
    @query(f"SELECT p_partkey, (sum(p_size) OVER w)::BIGINT AS sum, count(p_size) OVER w AS count FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_type, p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE {kind.upper()})", name=f"win_exclude_{kind.replace(' ', '_')}")
    def run(t):
        return windows.exclude_sum_count(t.part, ["p_brand"], "p_type", (-2, 2), "p_size", kind, ["p_partkey"]).select("p_partkey", "sum", "count")

    if kind in ("group", "ties"):
        peers = "x.p_type = p.p_type" + (" AND x.p_partkey <> p.p_partkey" if kind == "ties" else "")
        ORACLE_SQL[f"win_exclude_{kind}"] = f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_partkey) AS r FROM part)
            SELECT p.p_partkey, sum(x.p_size)::BIGINT AS sum, count(x.p_size) AS count FROM n p LEFT JOIN n x ON x.p_brand = p.p_brand AND x.r BETWEEN p.r - 2 AND p.r + 2 AND NOT ({peers}) GROUP BY p.p_partkey"""


for _kind in ("no others", "current row", "group", "ties"):
    _exclude(_kind)

# -- order, limits, sets, subqueries, recursion ------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(t):
    return sorting.top_k(t.orders.select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), c("o_orderkey"))


@query("SELECT n_name FROM nation ORDER BY n_name LIMIT 100 OFFSET 5")
def limit_negative_offset(t):
    return sorting.limit_offset(t.nation.select("n_name").orderBy("n_name"), -1, 5)


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def top_k_each(t):
    return sorting.top_k_each(t.orders, ["o_custkey"], 2, F.desc("o_totalprice"), c("o_orderkey")).select("o_custkey", "o_orderkey", "rank")


@query("SELECT s_suppkey, rank() OVER (ORDER BY CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey END DESC NULLS LAST, s_suppkey) AS r FROM supplier")
def order_nulls(t):
    k = t.supplier.select("s_suppkey", F.when(c("s_suppkey") % 3 != 0, c("s_nationkey")).alias("k"))
    return windows.global_rank(k, [("k", True), ("s_suppkey", False)]).select("s_suppkey", c("rank").alias("r"))


@query("SELECT o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank FROM orders WINDOW w AS (ORDER BY CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END NULLS FIRST, o_orderstatus DESC)")
def win_global_ties(t):
    k = t.orders.select("o_orderkey", F.when(c("o_custkey") % 5 != 0, c("o_custkey")).alias("k"), "o_orderstatus")
    return windows.global_rank(k, [("k", False), ("o_orderstatus", True)]).select("o_orderkey", "rank", "dense_rank")



@query("(SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region) INTERSECT SELECT n_regionkey FROM nation")
def set_flat_precedence(t):
    return sets.compound(t.nation.select(c("n_nationkey").alias("k")), ("union", t.region.select("r_regionkey")), ("intersect", t.nation.select("n_regionkey")))


spark_sql("set_union_all", "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region")
spark_sql("set_except", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000")
spark_sql("set_except_all", "SELECT o_orderstatus AS s FROM orders EXCEPT ALL SELECT l_linestatus FROM lineitem WHERE l_quantity > 48")
spark_sql("sub_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
spark_sql("sub_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
spark_sql("sub_cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000), n AS (SELECT o_custkey, count(*) AS k FROM big GROUP BY o_custkey) SELECT c_name, k FROM n JOIN customer ON c_custkey = o_custkey")
spark_sql("sub_row_value_in", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = o_custkey)", "SELECT o_orderkey FROM orders WHERE (o_orderkey, o_custkey) IN (SELECT l_orderkey, l_suppkey FROM lineitem)")


@query("WITH RECURSIVE r(n) AS (SELECT 1::BIGINT UNION SELECT (n * 7 + 3) % 101 FROM r) SELECT n FROM r")
def recursive_union_cycle(t):
    start = t.spark.range(1).select(F.lit(1).cast("long").alias("n"))
    return recursion.fixpoint(start, lambda new: new.select(((c("n") * 7 + 3) % 101).alias("n")))


spark_sql("recursive_union_all", "WITH RECURSIVE f(i, a, b) AS (SELECT 1, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT i + 1, b, a + b FROM f WHERE i < 40) SELECT i, a FROM f")

# -- functions ----------------------------------------------------------------------------


@query("""SELECT c_custkey, lower(c_name) AS lo, upper(c_name) AS up, length(c_name) AS len, trim(c_name, 'C0') AS tr, replace(c_name, '0', 'o') AS rep, instr(c_name, '#') AS pos,
       hex(c_name) AS hx, unicode(c_name) AS uni, CASE WHEN c_acctbal > 0 THEN 'in' ELSE 'out' END AS io, c_name || '/' || c_mktsegment AS cat FROM customer""")
def fn_text(t):
    n = c("c_name")
    return t.customer.select("c_custkey", F.lower(n).alias("lo"), F.upper(n).alias("up"), strings.length(n).alias("len"), strings.trim(n, F.lit("C0")).alias("tr"), strings.replace(n, F.lit("0"), F.lit("o")).alias("rep"), strings.instr(n, F.lit("#")).alias("pos"), strings.hex_(n).alias("hx"), strings.unicode(n).alias("uni"), strings.iif(c("c_acctbal") > 0, F.lit("in"), F.lit("out")).alias("io"), F.concat(n, F.lit("/"), c("c_mktsegment")).alias("cat"))


@query("SELECT p_partkey, substring(p_name, 2, 4) AS a, right(p_name, 3) AS b, substring(p_name, 1, 1) AS z, substring(p_name, 3, 2) AS back FROM part")
def fn_substr(t):
    n = c("p_name")
    return t.part.select("p_partkey", strings.substr(n, F.lit(2), F.lit(4)).alias("a"), strings.substr(n, F.lit(-3)).alias("b"), strings.substr(n, F.lit(0), F.lit(2)).alias("z"), strings.substr(n, F.lit(5), F.lit(-2)).alias("back"))


@query("SELECT p_partkey, printf('%05d|%-8s|%.2f', p_size, p_brand, p_retailprice) AS p, '''' || replace(p_name, '''', '''''') || '''' AS q, 'text' AS ty, greatest(p_size, 20) AS mx, least(p_size, 20) AS mn FROM part")
def fn_printf_quote(t):
    return t.part.select("p_partkey", strings.printf("%05d|%-8s|%.2f", c("p_size"), c("p_brand"), c("p_retailprice")).alias("p"), strings.quote(c("p_name"), "string").alias("q"), strings.typeof(c("p_name"), "string").alias("ty"), strings.scalar_max(c("p_size"), F.lit(20)).alias("mx"), strings.scalar_min(c("p_size"), F.lit(20)).alias("mn"))


@query("""SELECT c_custkey, abs(c_acctbal) AS ab, round(c_acctbal) AS r0, ceil(c_acctbal) AS ce, floor(c_acctbal) AS fl, trunc(c_acctbal) AS tc, sign(c_acctbal)::BIGINT AS sg,
    CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS sq, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS l, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 6) END AS lg,
    round(sin(c_custkey), 6) AS si, round(atan2(c_acctbal, 3), 6) AS a2, round(degrees(c_custkey), 6) AS dg, round(tanh(c_custkey / 1000.0), 6) AS th, round(power(c_custkey, 0.5), 6) AS pw FROM customer""")
def fn_math(t):
    b, k = c("c_acctbal"), c("c_custkey").cast("double")
    r = lambda x: F.round(x, 6)
    return t.customer.select("c_custkey", F.abs(b).alias("ab"), maths.round_(b).alias("r0"), maths.ceil(b).alias("ce"), maths.floor(b).alias("fl"), maths.trunc(b).alias("tc"), maths.sign(b).alias("sg"), r(maths.sqrt(b)).alias("sq"), r(maths.ln(b)).alias("l"), r(maths.log(b)).alias("lg"), r(F.sin(k)).alias("si"), r(F.atan2(b, F.lit(3))).alias("a2"), r(F.degrees(k)).alias("dg"), r(F.tanh(k / 1000)).alias("th"), r(maths.power(k, F.lit(0.5))).alias("pw"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t, strftime(o_orderdate, '%Y/%m %j %w') AS f, round(julian(o_orderdate), 6) + 0.0 AS jd, epoch(o_orderdate)::BIGINT::VARCHAR AS s FROM orders""")
def fn_dates(t):
    x = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSS")
    return t.orders.select("o_orderkey", dates.date(x).alias("d"), dates.time(x).alias("t"), dates.strftime("%Y/%m %j %w", x).alias("f"), F.round(dates.julianday(x) + 0.5 - 0.5, 6).alias("jd"), dates.strftime("%s", x).alias("s"))


ORACLE_SQL["fn_dates"] = ORACLE_SQL["fn_dates"].replace("round(julian(o_orderdate), 6) + 0.0", "round(epoch(o_orderdate) / 86400.0 + 2440587.5, 6)")


@query("""SELECT event_id, CAST(json_valid(props) AS INTEGER) AS ok, lower(json_type(props)) AS ty, json(props)::VARCHAR AS mini, json_extract_string(props, (SELECT min(k) FROM (SELECT unnest(json_keys(props)) AS k))) IS NOT NULL AS has FROM events""")
def fn_json(t):
    p = c("props")
    keys = F.array_sort(F.json_object_keys(p))
    return t.events.select("event_id", jsons.describe(p).alias("j"), F.coalesce(F.size(keys) > 0, F.lit(False)).alias("has")).select("event_id", c("j.valid").alias("ok"), c("j.kind").alias("ty"), c("j.text").alias("mini"), "has")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ^ 2))), 6) AS d FROM embeddings")
def fn_vec_l2(t):
    return t.embeddings.select("vec_id", F.round(vectors.l2(c("embedding"), F.reverse("embedding")), 6).alias("d"))


@query("SELECT vec_id, unnest(embedding[1:3])::DOUBLE AS x FROM embeddings")
def fn_unnest(t):
    return t.embeddings.select("vec_id", F.explode(F.slice(c("embedding").cast("array<double>"), 1, 3)).alias("x"))


# -- changes, constraints -----------------------------------------------------------------


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 25, n_name FROM nation WHERE n_nationkey >= 20")
def dml_insert_ignore(t):
    base = t.nation.select("n_nationkey", "n_name")
    new = base.where("n_nationkey >= 20").unionAll(base.where("n_nationkey >= 20").withColumn("n_nationkey", c("n_nationkey") + 25))
    return dml.insert(base, new, ["n_nationkey"], "ignore").table


@query("SELECT n_nationkey, CASE WHEN n_nationkey >= 20 THEN 'new' ELSE n_name END AS n_name FROM nation")
def dml_insert_replace(t):
    base = t.nation.select("n_nationkey", "n_name")
    return dml.insert(base, base.where("n_nationkey >= 20").withColumn("n_name", F.lit("new")), ["n_nationkey"], "replace").table


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 AND c_acctbal > 0 THEN round(c_acctbal + c_custkey, 2) ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT 1000000 + c_custkey, c_custkey::DOUBLE FROM customer WHERE c_custkey % 50 = 0")
def dml_upsert(t):
    base = t.customer.select("c_custkey", "c_acctbal")
    new = base.where("c_custkey % 7 = 0").select("c_custkey", c("c_custkey").cast("double").alias("c_acctbal")).unionAll(base.where("c_custkey % 50 = 0").select(c("c_custkey") + 1000000, c("c_custkey").cast("double")))
    return dml.upsert(base, new, ["c_custkey"], {"c_acctbal": F.round(c("t.c_acctbal") + c("excluded.c_acctbal"), 2)}, c("t.c_acctbal") > 0).table


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_nationkey <> 3")
def dml_update_delete(t):
    base = t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal")
    up = dml.update(base, [("s_acctbal", F.lit(1.0)), ("s_acctbal", F.lit(0.0))], c("s_acctbal") < 0).table
    return dml.delete(up, c("s_nationkey") == 3).table.drop("s_nationkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def constraint_foreign_key(t):
    return constraints.foreign_key(t.orders, ["o_custkey"], t.customer.where("c_custkey % 2 = 0"), ["c_custkey"]).select("o_orderkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def constraint_unique(t):
    return constraints.unique(t.orders, ["o_custkey"])


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 250000")
def constraint_check(t):
    return constraints.check(t.orders, c("o_totalprice") <= 250000).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)")
def constraint_cascade(t):
    keys = [constraints.ForeignKey("orders", "o_custkey", "customer", "c_custkey", "cascade"), constraints.ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey", "cascade")]
    out = constraints.delete_cascade({"customer": t.customer, "orders": t.orders, "lineitem": t.lineitem}, keys, "customer", t.customer.where("c_custkey = 7"))
    return out.tables["lineitem"].select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 4 OR c_acctbal > 9000")
def row_level_security(t):
    engine = Engine(t.spark)
    engine.register("customer", t.customer)
    engine.setting("nation", 4)
    engine.secure("customer", "c_nationkey = current_setting('nation')")
    engine.secure("customer", "c_acctbal > 9000")
    return engine.query("SELECT c_custkey FROM customer")


# -- change-driven processing -------------------------------------------------------------


def _receipt(t, dump: bool):
    base = t.customer.select("c_custkey", "c_acctbal")
    rows = base.where("c_custkey % 10 <> 3").select("c_custkey", F.when(c("c_custkey") % 10 == 1, c("c_acctbal") + 1).otherwise(c("c_acctbal")).alias("c_acctbal")).unionAll(base.where("c_custkey <= 5").select(c("c_custkey") + 5000000, "c_acctbal"))
    return ingest.receive(base, rows, ["c_custkey"], dump)


_OPS = "CASE WHEN c_custkey % 10 = 1 THEN 'update' WHEN c_custkey % 10 = 3 THEN 'delete' ELSE 'unchanged' END"


@query(f"SELECT {_OPS} AS op, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'insert', count(*) FROM customer WHERE c_custkey <= 5")
def ingest_dump(t):
    return _receipt(t, True).counts()


@query(f"SELECT {_OPS} AS op, count(*) AS n FROM customer WHERE c_custkey % 10 <> 3 GROUP BY 1 UNION ALL SELECT 'insert', count(*) FROM customer WHERE c_custkey <= 5")
def ingest_delta(t):
    return _receipt(t, False).counts()


@query("SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3")
def ingest_sweep(t):
    return ingest.sweep(t.customer, t.customer.where("c_custkey % 10 <> 3"), ["c_custkey"])


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def cdc_dirty_set(t):
    return cdc.dirty_set(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("SELECT CASE WHEN c_custkey % 4 = 0 THEN 'source' WHEN c_custkey % 4 = 1 THEN 'target' ELSE 'clean' END AS state, count(*) AS n FROM customer GROUP BY 1")
def sync_check(t):
    base = t.customer.select("c_custkey", "c_acctbal")
    moved = lambda k: base.withColumn("c_acctbal", F.when(c("c_custkey") % 4 == k, c("c_acctbal") + 1).otherwise(c("c_acctbal")))
    last = sync.fingerprint(base, ["c_custkey"], "hs").join(sync.fingerprint(base, ["c_custkey"], "ht"), "c_custkey")
    return sync.check(moved(0), moved(1), last, ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN round(c_acctbal + 1, 2) ELSE c_acctbal END AS c_acctbal FROM customer")
def sync_two_way(t):
    base = t.customer.select("c_custkey", "c_acctbal")
    moved = lambda k: base.withColumn("c_acctbal", F.when(c("c_custkey") % 4 == k, F.round(c("c_acctbal") + 1, 2)).otherwise(c("c_acctbal")))
    last = sync.fingerprint(base, ["c_custkey"], "hs").join(sync.fingerprint(base, ["c_custkey"], "ht"), "c_custkey")
    return sync.synchronise(moved(0), moved(1), last, ["c_custkey"]).target


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'up' WHEN c_custkey % 3 = 1 THEN 'mine' ELSE c_name END AS c_name FROM customer")
def replica_merge(t):
    base = t.customer.select("c_custkey", "c_name")
    mark = lambda keys, text: base.withColumn("c_name", F.when((c("c_custkey") % 3).isin(*keys), text).otherwise(c("c_name")))
    return sync.replicate(mark([0], "up"), mark([0, 1], "mine"), base, ["c_custkey"], "upstream")


@query("SELECT c_custkey, c_acctbal FROM customer")
def lens_round_trip(t):
    base = t.customer.select("c_custkey", "c_acctbal")
    return lens.revert(lens.CENTS, lens.apply(lens.CENTS, base, "c_acctbal", ["c_custkey"]), "c_acctbal", ["c_custkey"])


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(t):
    return events.tumbling(t.events, "ts", "1 hour", ["event_type"], "value").withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' > ts THEN 0 ELSE 1 END AS b FROM events),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(t):
    return events.sessions(t.events, "ts", "30 minutes", ["user_id"])


# -- search, vectors, graphs, routing, user code -------------------------------------------


@query("SELECT doc_id AS docid FROM documents WHERE list_contains(w, 'the') AND (list_contains(w, 'idiot') OR len(list_filter(w, lambda x: starts_with(x, 'worth'))) > 0)".replace("FROM documents", "FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents)"))
def fts_match(t):
    return search.scan(t.documents, ["text"], "the AND (idiot OR worth*)").select(c("doc_id").alias("docid"))


@query("SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE - (CASE WHEN i = 1 THEN 1.0 ELSE 0.0 END)) ^ 2))) AS d FROM embeddings WHERE label % 2 = 0) ORDER BY d, vec_id LIMIT 10")
def knn_exact(t):
    q = [1.0] + [0.0] * 63
    return knn.nearest(t.embeddings, "embedding", q, 10, "vec_id", where=c("label") % 2 == 0).select("vec_id", F.round("distance", 6).alias("distance"))


def _edges(t):
    """From each order's customer to the customer of the order with the next key."""
    a, b = t.orders.select((c("o_orderkey") + 1).alias("k"), c("o_custkey").alias("src")), t.orders.select(c("o_orderkey").alias("k"), c("o_custkey").alias("dst"))
    return a.join(b, "k").select("src", "dst").distinct()


_E = "e AS (SELECT DISTINCT a.o_custkey AS src, b.o_custkey AS dst FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1)"


@query(f"WITH {_E} SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY id")
def graph_degrees(t):
    return graph.degrees(_edges(t))


@query(f"WITH RECURSIVE {_E}, r(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.id WHERE depth < 6) SELECT id, min(depth) AS depth FROM r GROUP BY id")
def graph_reach(t):
    return graph.reach(_edges(t), t.spark.range(1, 2), 6)


@query(f"WITH {_E}, u AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM e WHERE src <> dst) SELECT p.x AS a, p.y AS b, q.y AS c FROM u p JOIN u q ON p.y = q.x JOIN u r ON r.x = p.x AND r.y = q.y")
def graph_triangles(t):
    return graph.triangles(_edges(t))


@query(f"WITH {_E} SELECT DISTINCT q.dst AS id FROM e p JOIN e q ON p.dst = q.src WHERE p.src = 1")
def graph_two_hops(t):
    return graph.hops(_edges(t), t.spark.range(1, 2), 2)


@query(f"WITH {_E} SELECT dst AS src, src AS dst FROM e")
def graph_reverse(t):
    return graph.reverse_edges(_edges(t))


@query()
def routing_sequence(t):
    """Suppliers by eights, each leg the difference of balances."""
    stops = t.supplier.select(F.floor(c("s_suppkey") / 8).alias("route"), "s_suppkey", "s_acctbal")
    a, b = stops.select("route", c("s_suppkey").alias("src"), c("s_acctbal").alias("x")), stops.select("route", c("s_suppkey").alias("dst"), c("s_acctbal").alias("y"))
    matrix = a.join(b, "route").select("route", "src", "dst", F.abs(c("x") - c("y")).alias("cost"))
    return routing.sequence(matrix, "route").withColumn("stops", F.array_join("stops", ">"))


@query("SELECT p_partkey, p_size * p_size + 1 AS y FROM part")
def udf_python(t):
    engine = Engine(t.spark)
    engine.register("part", t.part)
    engine.create_python("def sq(x):\n    total = 1\n    for i in range(x):\n        total += x\n    return total\n", "bigint")
    return engine.query("SELECT p_partkey, sq(p_size) AS y FROM part")


ORACLE_SQL["udf_python"] = "SELECT p_partkey, CAST(p_size * p_size + 1 AS BIGINT) AS y FROM part"


# -- more of sources, changes, windows and the facade ---------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal FROM customer")
def csv_round_trip(t):
    from ..sources.csvs import read_csv

    path = recursion.folder(t.spark, "csv")
    t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal").write.option("header", True).csv(path)
    return read_csv(t.spark, path, ",", True)


@query("SELECT n_nationkey, n_name, n_nationkey * 2 AS twice FROM nation")
def catalog_snapshot(t):
    from ..sources.catalog import Catalog

    cat = Catalog(t.spark, recursion.folder(t.spark, "db"))
    cat.create("nation", "n_nationkey int, n_name string, twice int", pk=["n_nationkey"], checks=["n_nationkey >= 0"], generated={"twice": "n_nationkey * 2"})
    cat.replace("nation", t.nation.select("n_nationkey", "n_name"))
    return cat.table("nation")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 11")
def sharded_point(t):
    from ..sources.catalog import hash_sharded, read_shard

    path = recursion.folder(t.spark, "shards")
    hash_sharded(t.orders, ["o_custkey"], 8, path)
    return read_shard(t.spark, path, 8, o_custkey=11).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, row_number() OVER (ORDER BY translate(c_mktsegment, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), c_custkey) AS r FROM customer QUALIFY r <= 20")
def collation_top(t):
    from ..functions.collation import collate

    top = sorting.top_k(t.customer.select("c_custkey", collate(c("c_mktsegment"), "NOCASE").alias("k")), 20, c("k"), c("c_custkey"))
    return top.select("c_custkey", F.row_number().over(Window.orderBy("k", "c_custkey")).alias("r"))


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE o_totalprice > 100000) AS fires FROM orders")
def trigger_backtest(t):
    from ..operators.triggers import Trigger, Triggers

    known = Triggers()
    known.create(Trigger("big", "orders", "insert", "after", c("new.o_totalprice") > 100000, into="log", derive=lambda d: d))
    return known.backtest("big", t.orders)


@query("SELECT c_custkey, 'new' AS c_name, 4::INTEGER AS c_nationkey FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer WHERE NOT (c_acctbal > 5000)")
def dml_update_returning(t):
    base = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    change = dml.update(base, [("c_name", F.lit("new")), ("c_nationkey", F.lit(4))], c("c_acctbal") > 5000)
    return change.affected.drop("c_acctbal").unionByName(base.where(~(c("c_acctbal") > 5000)).drop("c_acctbal"))


@query("SELECT event_id, CASE WHEN json_valid(props) THEN json_merge_patch(props, '{\"seen\":true}')::VARCHAR END AS p FROM events")
def fn_json_patch(t):
    return t.events.select("event_id", jsons.json_patch(c("props"), F.lit('{"seen":true}')).alias("p"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > c.c_nationkey)) AS n FROM customer c")
def sub_mid_scope(t):
    """A reference that skips a level, as joins: the inner EXISTS becomes a maximum."""
    most = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias("q"))
    hit = t.orders.join(most, "o_orderkey").join(t.customer.select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey")).where(c("q") > c("c_nationkey"))
    n = hit.groupBy("c_custkey").agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT time_bucket(INTERVAL '15 minutes', ts + INTERVAL '15 minutes' * k) AS window_start, event_type, count(*) AS n FROM events, (VALUES (0), (-1)) v(k) GROUP BY ALL")
def stream_sliding(t):
    return events.sliding(t.events, "ts", "30 minutes", "15 minutes", ["event_type"])


@query("SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey")
def derived_counter(t):
    return cdc.counter(t.orders.select(c("o_custkey").alias("k"), F.lit("insert").alias("op")), ["k"])


# -- queries written as SQL text, and those over sources and changes -----------------------------


def _more() -> None:
    from . import flowqueries, sqlqueries

    for module in (sqlqueries, flowqueries):
        QUERIES.update(module.QUERIES)
        ORACLE_SQL.update(module.ORACLE_SQL)


_more()
