"""Queries over sources, change-driven processing, windows and host code, with oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import routing, windows
from ..operators.recursion import folder
from ..streaming import cdc, ingest, lens, maps, objects, receipts, sync, tasks, tiering
from .engine import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


class Source:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __call__(self, name: str, *columns: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return df.select(*columns) if columns else df


def query(oracle: str):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, path: fn(Source(spark, path))
        ORACLE_SQL[fn.__name__] = oracle
        return fn

    return add


# -- sources ---------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sqlite_round_trip(t):
    """Written as one file by the driver, read by rowid ranges. The file lies in the shared
    checkpoint folder, which has to be a path that all machines mount."""
    import os
    from urllib.parse import urlparse

    from ..sources.sqlite import read_sqlite, write_sqlite

    shared = urlparse(folder(t.spark, "sqlite"))
    if shared.scheme not in ("", "file"):
        raise ValueError("a SQLite file needs a mounted folder")
    os.makedirs(shared.path)
    path = f"{shared.path}/out.db"
    write_sqlite(t("nation"), path, "nation")
    return t.spark.createDataFrame(read_sqlite(t.spark, path, "nation").collect(), "n_nationkey long, n_name string, n_regionkey long")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def jdbc_round_trip(t):
    """To a database and back in ranges of the key. The database is the embedded one that comes
    with Spark, which lives in one process: the driver writes it and packs it into a file of
    the shared checkpoint folder, from which every executor reads its ranges."""
    import os
    from urllib.parse import urlparse

    from ..sources.jdbc import DERBY, read_jdbc, write_derby

    shared = urlparse(folder(t.spark, "jdbc"))
    if shared.scheme not in ("", "file"):
        raise ValueError("a Derby database needs a mounted folder")
    os.makedirs(shared.path)
    orders = t("orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    url = write_derby(orders, f"{shared.path}/orders.jar", "orders")
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return read_jdbc(t.spark, url, "orders", "o_orderkey", low, high, 4, driver=DERBY)


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN 'bad' END AS bad FROM nation")
def sqlite_validated(t):
    from ..sources.sqlite import validated

    text = t("nation").select(F.when(c("n_nationkey") % 5 == 0, F.concat(c("n_nationkey").cast("string"), F.lit("x"))).otherwise(c("n_nationkey").cast("string")).alias("k"), c("n_nationkey").alias("id"))
    good, rejected = validated(text, {"k": "bigint"})
    return good.select(c("id").alias("k"), F.lit(None).cast("string").alias("bad")).unionAll(rejected.select("id", F.lit("bad")))


@query("SELECT n_nationkey AS k, 'left' AS side FROM nation WHERE n_regionkey = 2 UNION ALL SELECT n_nationkey + 100, 'right' FROM nation WHERE n_regionkey = 3")
def data_diff(t):
    from ..sources.sqlite import data_diff as diff

    base = t("nation").select(c("n_nationkey").alias("k"), c("n_regionkey").alias("r"))
    return diff(base, base.where("r <> 2").unionAll(base.where("r = 3").withColumn("k", c("k") + 100))).select("k", "side")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_load_table(t):
    """A CSV folder into a table of the catalog."""
    from ..sources.csvs import read_csv
    from .database import Database

    path = folder(t.spark, "csv")
    t("customer", "c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(path)
    db = Database(t.spark, folder(t.spark, "db"))
    read_csv(t.spark, path, ",", True).createOrReplaceTempView("src_csv")
    db.execute("CREATE TABLE customer (c_custkey INTEGER PRIMARY KEY, c_name TEXT, c_acctbal REAL)")
    db.execute("INSERT INTO customer SELECT * FROM src_csv")
    return db.query("SELECT * FROM customer")


@query("SELECT doc_id, length(CAST(coalesce(text, '') AS VARCHAR)) > 0 AS has, strlen(coalesce(text, '')) AS bytes FROM documents")
def blob_chunks(t):
    """Texts as parts of 1,000 bytes, put together again."""
    parts = objects.chunks(t("documents").select(c("doc_id").alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("data")), 1000)
    return parts.groupBy(c("name").alias("doc_id")).agg((F.sum(F.octet_length("data")) > 0).alias("has"), F.sum(F.octet_length("data")).alias("bytes"))


@query("SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1")
def streaming_select(t):
    engine = Engine(t.spark)
    engine.register("nation", t("nation"))
    return t.spark.createDataFrame([(r["k"],) for r in engine.stream("SELECT n_nationkey AS k FROM nation WHERE n_regionkey = ?", [1])], "k long")


# -- receipts ----------------------------------------------------------------------------------

_OPS = "CASE WHEN c_custkey % 10 = 1 THEN 'update' WHEN c_custkey % 10 = 3 THEN 'delete' ELSE 'unchanged' END"


@query(f"SELECT {_OPS} AS op, count(*) AS n FROM customer GROUP BY 1")
def receipt_chunks(t):
    """A dump in three chunks, one of them sent twice."""
    base = t("customer", "c_custkey", "c_acctbal")
    rows = base.where("c_custkey % 10 <> 3").withColumn("c_acctbal", F.when(c("c_custkey") % 10 == 1, c("c_acctbal") + 1).otherwise(c("c_acctbal")))
    store = receipts.Receipts(t.spark, folder(t.spark, "receipts"))
    name = store.begin("page_cursor", 3)
    store.rows(name, 0, rows.limit(0))
    for k in range(3):
        store.rows(name, k, rows.where(c("c_custkey") % 3 == k))
    assert store.staged(name) == [0, 1, 2]
    return store.finish(name, base, ["c_custkey"]).counts()


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN c_acctbal + 1 WHEN c_custkey % 4 = 2 THEN -1.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def receipt_conflicts(t):
    """Rows edited here and changed there: conflicts, one half of which the source wins."""
    base = t("customer", "c_custkey", "c_acctbal")
    mine = base.withColumn("c_acctbal", F.when(c("c_custkey") % 4 == 2, F.lit(-1.0)).otherwise(c("c_acctbal")))
    rows = base.where("c_custkey % 4 in (1, 2)").withColumn("c_acctbal", c("c_acctbal") + 1)
    got = ingest.receive(mine, rows, ["c_custkey"], False, "local", base.where("c_custkey % 4 in (1, 2)"))
    decisions = got.conflicts.select("c_custkey", F.when(c("c_custkey") % 4 == 1, "source").otherwise("local").alias("take"))
    return receipts.resolve(got.table, got.conflicts, decisions, ["c_custkey"])[0]


@query("SELECT c_custkey % 100 AS k FROM customer GROUP BY 1 HAVING c_custkey % 100 < 50")
def ingest_derived_calls(t):
    changes = t("customer").select((c("c_custkey") % 100).alias("k"), F.lit("update").alias("op"))
    return ingest.derived_calls(changes, ["k"], changes.where("k >= 50"))


@query("SELECT count(*) FILTER (WHERE c_custkey > 50) AS caught, count(*) FILTER (WHERE c_custkey <= 50) AS missed FROM customer WHERE c_custkey % 10 = 1")
def ingest_judge_cursor(t):
    base = t("customer", "c_custkey", "c_acctbal")
    rows = base.withColumn("c_acctbal", F.when(c("c_custkey") % 10 == 1, c("c_acctbal") + 1).otherwise(c("c_acctbal")))
    got = ingest.receive(base, rows, ["c_custkey"], True)
    return ingest.judge_cursor(got.changes, rows, ["c_custkey"], "c_custkey", 50)


@query("SELECT * FROM (VALUES ('a', 1), ('c', 2)) v(name, place)")
def ingest_budget(t):
    edge = lambda name, value, seconds: {"name": name, "calls": 1, "bytes": 10, "seconds": seconds, "value": value}
    plan = ingest.plan_budget([edge("b", 1, 9), edge("a", 9, 1), edge("c", 5, 1)], 2, 100, 60)
    return t.spark.createDataFrame([(e["name"], i + 1) for i, e in enumerate(plan)], "name string, place int")


# -- change capture, maps, replicas ---------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'delete' WHEN c_custkey % 3 = 1 THEN 'update' ELSE 'insert' END AS op FROM customer")
def cdc_changes(t):
    base = t("customer", "c_custkey", "c_name")
    return cdc.changes_between(base.where("c_custkey % 3 <> 2"), base.where("c_custkey % 3 <> 0").withColumn("c_name", F.lit("x")), ["c_custkey"])


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'key exists' ELSE 'no such key' END AS reason FROM customer WHERE c_custkey % 3 <> 1")
def cdc_parked(t):
    """Inserts of keys that are there and updates of keys that are not stand aside."""
    there = t("customer").where("c_custkey % 3 <> 2").select(c("c_custkey").alias("k"), c("c_name").alias("v"))
    op = F.when(c("c_custkey") % 3 == 0, "insert").otherwise("update")
    feed = t("customer").select(c("c_custkey").alias("k"), F.lit("new").alias("v"), F.lit(1).alias("version"), op.alias("op"))
    return cdc.apply_parking(there, feed, ["k"], "version")[1].select("k", "reason")


@query("SELECT max(event_id) AS place, count(*) FILTER (WHERE event_id > 100) AS later FROM events")
def cdc_cursor(t):
    feed = t("events", "event_id")
    first = cdc.Cursor("event_id").moved(feed.where("event_id <= 100"))
    rest = first.after(feed)
    return rest.agg(F.count("*").alias("later")).withColumn("place", F.lit(first.moved(rest).value))


@query("SELECT c_custkey AS k, upper(c_name) AS name FROM customer WHERE c_custkey % 5 <> 0")
def map_run_bounded(t):
    """A map fed by a journal, forty keys at a time, until nothing is dirty."""
    source = t("customer").select(c("c_custkey").alias("k"), c("c_name").alias("name")).where("k <= 100 or k % 5 <> 0")
    live = source.where("k % 5 <> 0")
    journal = maps.record(t.spark.createDataFrame([], maps.JOURNAL + ", k long"), t("customer").select(c("c_custkey").alias("k"), F.lit("update").alias("op")), ["k"])
    from ..operators.recursion import written

    journal = written(journal, "journal")
    size = max(40, journal.count() // 3)
    target, cursor, done = source.withColumn("name", F.lit("old")), 0, False
    while not done:
        step = maps.run(live, target, journal, ["k"], lambda rows: rows.withColumn("name", F.upper("name")), cursor, size)
        target, cursor, done = written(step.target, "target"), step.cursor, step.done
    return target


@query("SELECT n_nationkey AS k, 'update' AS op FROM nation")
def map_stream_journal(t):
    """A feed written as a journal by Structured Streaming."""
    feed, path = folder(t.spark, "feed"), folder(t.spark, "journal")
    rows = t("nation").select(c("n_nationkey").cast("long").alias("k"), F.lit("update").alias("op"))
    rows.write.parquet(feed)
    stream = t.spark.readStream.schema(rows.schema).parquet(feed)
    maps.stream_journal(stream, ["k"], path, folder(t.spark, "cursor")).awaitTermination()
    return t.spark.read.parquet(path).select("k", "op")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 12.34 ELSE c_acctbal END AS c_acctbal FROM customer")
def lens_putback(t):
    """Edited values go back through the lens, the others to what they were."""
    applied = lens.apply(lens.CENTS, t("customer", "c_custkey", "c_acctbal"), "c_acctbal", ["c_custkey"])
    edited = applied.table.where("c_custkey % 7 = 0").select("c_custkey", F.lit(1234).cast("long").alias("c_acctbal"))
    return lens.revert(lens.CENTS, lens.putback(lens.CENTS, applied, edited, "c_acctbal", ["c_custkey"]), "c_acctbal", ["c_custkey"])


@query("SELECT 1::BIGINT AS seq, 'cents' AS lens, 'residual' AS kind, 'apply' AS action, count(*) AS rows, true AS same FROM customer")
def lens_log(t):
    applied = lens.apply(lens.CENTS, t("customer", "c_custkey", "c_acctbal"), "c_acctbal", ["c_custkey"])
    ledger = lens.log(t.spark.createDataFrame([], lens.LEDGER), lens.CENTS, applied, "c_acctbal")
    return ledger.select("seq", "lens", "kind", "action", "rows", F.lit(lens.untouched(ledger, applied)).alias("same"))


@query("SELECT n_nationkey AS k, reverse(n_name) AS name FROM nation")
def lens_forward(t):
    applied = lens.apply(lens.REVERSE, t("nation").select(c("n_nationkey").alias("k"), c("n_name").alias("name")), "name", ["k"])
    assert lens.REVERSE.kind == "bijective" and lens.verify(lens.REVERSE, t("nation"), "n_name").isEmpty()
    return applied.table


@query("SELECT n_nationkey AS k, 'no residue' AS fault FROM nation WHERE n_regionkey = 1")
def lens_fsck(t):
    applied = lens.apply(lens.LOWER, t("nation").select(c("n_nationkey").alias("k"), c("n_name").alias("name"), c("n_regionkey").alias("r")), "name", ["k"])
    broken = lens.Applied(applied.table, applied.residuals.join(applied.table.where("r = 1").select("k"), "k", "left_anti"))
    return lens.fsck(broken, ["k"])


@query("SELECT n_nationkey AS k, n_regionkey = 2 AS mine FROM nation")
def tiering_drain(t):
    base, path = t("nation").select(c("n_nationkey").alias("k"), c("n_regionkey").alias("r")), folder(t.spark, "cold")
    hot = tiering.drain(base, c("r") == 2, path, {"part": c("r")})
    cold = t.spark.read.parquet(path).select("k", "r")
    return hot.withColumn("mine", F.lit(False)).unionAll(cold.withColumn("mine", F.lit(True))).select("k", "mine")


_TASKS = "SELECT n_nationkey AS id, CASE WHEN n < 3 THEN 'done' WHEN n < 5 THEN 'ready' ELSE 'ready' END AS state, CASE WHEN n < 5 THEN 1 ELSE 0 END AS attempts FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_regionkey DESC, n_nationkey) - 1 AS n FROM nation)"


@query(_TASKS)
def task_queue(t):
    """Five tasks are claimed; three are done, two time out."""
    new = t("nation").select(c("n_nationkey").cast("long").alias("id"), F.lit("k").alias("kind"), c("n_name").alias("payload"), c("n_regionkey").alias("priority"))
    queue = tasks.enqueue(t.spark.createDataFrame([], tasks.SCHEMA), new)
    queue, mine = tasks.claim(queue, "w", 5, 100, 10)
    first = mine.orderBy(F.desc("priority"), "id").limit(3)
    return tasks.reap(tasks.finish(queue, first), 1000).select("id", "state", "attempts")


@query("SELECT n_nationkey AS name, CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END AS version FROM nation")
def object_versions(t):
    base = t("nation").select(c("n_nationkey").cast("string").alias("name"), c("n_name").cast("binary").alias("data"), "n_regionkey")
    store = objects.put(t.spark.createDataFrame([], "name string, version long, data binary"), base.drop("n_regionkey"), 1)
    changed = base.select("name", F.when(c("n_regionkey") == 1, F.lit(b"new")).otherwise(c("data")).alias("data"))
    store = objects.prune(objects.put(store, changed, 2), 1)
    return objects.get(store).select(c("name").cast("long").alias("name"), "version")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey <> 4 UNION ALL SELECT n_nationkey, 'local' FROM nation WHERE n_regionkey = 4")
def replica_policy(t):
    base = t("nation").select(c("n_nationkey").alias("k"), c("n_name").alias("name"), c("n_regionkey").alias("r"))
    mine = base.withColumn("name", F.when(c("r") == 4, "local").otherwise(c("name"))).drop("r")
    theirs = base.withColumn("name", F.when(c("r") == 4, "far").otherwise(c("name"))).drop("r")
    return sync.replicate(theirs, mine, base.drop("r"), ["k"], "local")


# -- windows, host code, routing -------------------------------------------------------------------


def _excluded(kind: str) -> None:
    name = f"win_exclude_any_{kind.replace(' ', '_')}"
    peers = {"no others": "true", "current row": "x.r <> p.r", "group": "x.p_size <> p.p_size", "ties": "(x.p_size <> p.p_size OR x.r = p.r)"}[kind]
    frames = {"rows": "x.r BETWEEN p.r - 3 AND p.r + 1", "groups": "x.g BETWEEN p.g - 1 AND p.g + 1", "range": "x.p_size BETWEEN p.p_size - 4 AND p.p_size + 2"}
    parts = " UNION ALL ".join(
        f"SELECT '{f}' AS frame, p.p_partkey, count(x.p_partkey) AS n, sum(x.p_partkey)::BIGINT AS s, min(x.p_partkey) AS lo, max(x.p_partkey) AS hi, round(avg(x.p_partkey), 6) AS av FROM n p LEFT JOIN n x ON x.p_brand = p.p_brand AND {on} AND {peers} GROUP BY p.p_partkey" for f, on in frames.items()
    )
    ORACLE_SQL[name] = f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS g FROM part) {parts}"

    def run(spark: SparkSession, path: str) -> DataFrame:
        part, out = Source(spark, path)("part"), None
        for frame in (("rows", -3, 1), ("groups", -1, 1), ("range", -4, 2)):
            aggs = {"n": ("count", "p_partkey"), "s": ("sum", "p_partkey"), "lo": ("min", "p_partkey"), "hi": ("max", "p_partkey"), "av": ("avg", "p_partkey")}
            got = windows.exclude(part, ["p_brand"], "p_size", frame, kind, aggs, ["p_partkey"])
            av = F.round(c("av") * 1e6) / 1e6  # as the SQL's round does; F.round(x, 6) rounds the decimal digits
            got = got.select(F.lit(frame[0]).alias("frame"), "p_partkey", "n", "s", "lo", "hi", av.alias("av"))
            out = got if out is None else out.unionAll(got)
        return out

    QUERIES[name] = run


for _kind in ("no others", "current row", "group", "ties"):
    _excluded(_kind)


@query("SELECT p_partkey, (sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT AS s FROM part")
def host_window(t):
    class Sum:
        def __init__(self):
            self.total = 0

        def step(self, x):
            self.total += x or 0

        def inverse(self, x):
            self.total -= x or 0

        def value(self):
            return self.total

    engine = Engine(t.spark)
    engine.register("part", t("part"))
    engine.create_window("slide", Sum, "bigint")
    return engine.query("SELECT p_partkey, slide(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM part")


@query("SELECT * FROM (VALUES ('customer', 'c_custkey'), ('customer', 'c_name'), ('orders', 'o_custkey'), ('orders', 'o_totalprice')) v(name, col)")
def access_report(t):
    engine = Engine(t.spark)
    for name in ("customer", "orders", "nation"):
        engine.register(name, t(name))
    got = engine.access("SELECT c.c_name, 'nation' AS x FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 5) -- nation")
    return t.spark.createDataFrame([(n, x) for n, cols in got.items() for x in cols], "name string, col string")


@query("SELECT n_nationkey AS k, n_name || '?' AS name FROM nation WHERE n_regionkey < 3")
def dbapi_session(t):
    from . import dbapi

    t("nation").createOrReplaceTempView("src_nation")
    with dbapi.connect(t.spark, folder(t.spark, "db")) as con:
        con.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, name TEXT, r INTEGER)")
        con.execute("INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM src_nation")
        con.executemany("UPDATE t SET name = name || ? WHERE r < ?", [("?", 3)])
        cur = con.execute("SELECT k, name FROM t WHERE r < ?", (3,))
        assert [d[0] for d in cur.description] == ["k", "name"]
        rows = [cur.fetchone(), *cur.fetchmany(2), *cur.fetchall()]
    return t.spark.createDataFrame(rows, "k long, name string")


@query(
    """WITH s AS (SELECT s_suppkey // 5 AS route, s_suppkey, s_acctbal FROM supplier),
    p AS (SELECT a.route, a.s_suppkey AS a, b.s_suppkey AS b, c.s_suppkey AS c, d.s_suppkey AS d, e.s_suppkey AS e,
            abs(a.s_acctbal - b.s_acctbal) + abs(b.s_acctbal - c.s_acctbal) + abs(c.s_acctbal - d.s_acctbal) + abs(d.s_acctbal - e.s_acctbal) AS cost
          FROM s a JOIN s b USING (route) JOIN s c USING (route) JOIN s d USING (route) JOIN s e USING (route)
          WHERE a.s_suppkey NOT IN (b.s_suppkey, c.s_suppkey, d.s_suppkey, e.s_suppkey) AND b.s_suppkey NOT IN (c.s_suppkey, d.s_suppkey, e.s_suppkey) AND c.s_suppkey NOT IN (d.s_suppkey, e.s_suppkey) AND d.s_suppkey <> e.s_suppkey AND a.s_suppkey < least(b.s_suppkey, c.s_suppkey, d.s_suppkey, e.s_suppkey))
    SELECT route, round(min(cost), 4) AS cost FROM p GROUP BY route"""
)
def routing_cost(t):
    """The cheapest sequences of five suppliers, against all of them."""
    stops = t("supplier").select(F.floor(c("s_suppkey") / 5).alias("route"), "s_suppkey", "s_acctbal")
    full = stops.groupBy("route").count().where("count = 5").select("route")
    stops = stops.join(full, "route", "left_semi")
    a, b = stops.select("route", c("s_suppkey").alias("src"), c("s_acctbal").alias("x")), stops.select("route", c("s_suppkey").alias("dst"), c("s_acctbal").alias("y"))
    got = routing.sequence(a.join(b, "route").select("route", "src", "dst", F.abs(c("x") - c("y")).alias("cost")), "route")
    return got.select("route", F.round("total", 4).alias("cost"))


_WORDS = "(SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w, lower(coalesce(lang, '')) AS l FROM documents)"


@query(f"SELECT doc_id FROM {_WORDS} WHERE list_contains(w, 'the') AND NOT list_contains(w, 'and') AND l = 'en' UNION ALL SELECT doc_id + 1000000 FROM {_WORDS} WHERE w[1] LIKE 'b%'")
def fts_grammar(t):
    """NOT, a column's term and the first word of a column, by postings and by a scan."""
    from ..operators import search

    docs = t("documents", "doc_id", "text", "lang")
    one = search.match(search.postings(docs, "doc_id", ["text", "lang"]), "(text:the NOT text:and) AND lang:en").select(c("docid").alias("doc_id"))
    two = search.scan(docs, ["text", "lang"], "text:^b*").select((c("doc_id") + 1000000).alias("doc_id"))
    return one.unionAll(two)


@query("SELECT n_nationkey AS k, i FROM nation, LATERAL (SELECT unnest(range(n_nationkey % 3)) AS i)")
def host_table_function(t):
    engine = Engine(t.spark)
    engine.register("nation", t("nation"))
    engine.create_table_function("upto", lambda n: ((i,) for i in range(n)), "i int")
    return engine.query("SELECT n.n_nationkey AS k, u.i FROM nation AS n, LATERAL (SELECT * FROM upto(n.n_nationkey % 3)) AS u")


@query("SELECT n_nationkey AS name, v AS version, n_name || repeat('x', v::INTEGER) AS data FROM nation, (VALUES (1), (2), (3)) t(v)")
def object_deltas(t):
    versions = t.spark.range(1, 4).withColumnRenamed("id", "version")
    store = t("nation").join(versions).select(c("n_nationkey").cast("string").alias("name"), "version", F.concat("n_name", F.repeat(F.lit("x"), c("version").cast("int"))).cast("binary").alias("data"))
    back = objects.from_deltas(objects.to_deltas(store))
    return back.select(c("name").cast("long").alias("name"), "version", c("data").cast("string").alias("data"))


@query("SELECT n_regionkey::VARCHAR AS archive, n_nationkey AS name, n_name AS data FROM nation")
def object_archives(t):
    rows = t("nation").select(c("n_regionkey").cast("string").alias("archive"), c("n_nationkey").cast("string").alias("name"), c("n_name").cast("binary").alias("data"))
    back = objects.unpack(objects.pack_archives(rows))
    return back.select("archive", c("name").cast("long").alias("name"), c("data").cast("string").alias("data"))


@query("SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN 'up' WHEN n_regionkey = 2 THEN 'mine' ELSE n_name END AS name FROM nation")
def replica_pull_push(t):
    """Changes past the cursor come down, local ones go up."""
    base = t("nation").select(c("n_nationkey").alias("k"), c("n_name").alias("name"), c("n_regionkey").alias("r"))
    journal = maps.record(t.spark.createDataFrame([], maps.JOURNAL + ", k int"), base.where("r = 1").select("k", F.lit("update").alias("op")), ["k"])
    replica = sync.seed(base.drop("r"), journal.limit(0))
    replica.local = base.withColumn("name", F.when(c("r") == 2, "mine").otherwise(c("name"))).drop("r")
    upstream = base.withColumn("name", F.when(c("r") == 1, "up").otherwise(c("name"))).drop("r")
    replica = sync.pull(replica, upstream, journal, ["k"])
    return sync.push(replica, upstream, ["k"])[0]
