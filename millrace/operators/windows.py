"""Window functions beyond Spark's frames: GROUPS, EXCLUDE, rankings without an order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

START, END = Window.unboundedPreceding, Window.unboundedFollowing


def rank_without_order(partition: list[str] | None = None) -> Column:
    """rank() and dense_rank() with no ORDER BY: all rows are peers."""
    return F.lit(1)


def row_number(partition: list[str], order: list[Column], pk: list[str]) -> Column:
    """Ties go by the primary key, which is also the order where none is given."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order, *pk))


def global_rank(df: DataFrame, order: list[tuple[str, bool]], parts: int | None = None) -> DataFrame:
    """``df`` with ``rank`` and ``dense_rank`` over all rows, which a window without partitions
    would gather in one task. ``order`` has columns and whether each is descending; NULLs are
    smallest. Rows are counted by key first, so ties cost nothing; the keys are dealt by
    ranges, ranked in each range, and moved by what the ranges before hold."""
    from .recursion import written

    spark = df.sparkSession
    keys = [c for c, _ in order]
    by = [F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in order]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    dealt = written(counts.repartitionByRange(parts, *by).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_p").agg(F.sum("_n").alias("_rows"), F.count("*").alias("_keys"))
    before = Window.orderBy("_p").rowsBetween(START, -1)  # one row for each range
    moved = sizes.select("_p", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_keys").over(before), F.lit(0)).alias("_keys"))
    w = Window.partitionBy("_p").orderBy(*by)
    rank = F.coalesce(F.sum("_n").over(w.rowsBetween(START, -1)), F.lit(0)) + F.col("_rows") + 1
    ranked = dealt.join(F.broadcast(moved), "_p").select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], rank.alias("rank"), (F.row_number().over(w) + F.col("_keys")).alias("dense_rank"))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return df.join(ranked, same).select(*df.columns, "rank", "dense_rank")


def groups_frame(df: DataFrame, partition: list[str], order: list[Column], low: int, high: int, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over a GROUPS frame: offsets count peer groups, numbered by dense_rank, over
    which a RANGE frame is the same thing."""
    w = Window.partitionBy(*partition)
    ranked = df.withColumn("_g", F.dense_rank().over(w.orderBy(*order)))
    frame = w.orderBy("_g").rangeBetween(low, high)
    return ranked.select(*df.columns, *[a.over(frame).alias(n) for n, a in aggs.items()])


def exclude_sum_count(df: DataFrame, partition: list[str], order: str, rows: tuple[int, int], x: str, exclude: str, pk: list[str], descending: bool = False) -> DataFrame:
    """sum(x), count(x) over a ROWS frame with EXCLUDE no others, current row, group or ties.

    Peers lie next to each other, so those that the frame holds are what the same ROWS frame
    holds over the peer group alone; their sums are subtracted. Nothing is collected.
    """
    if exclude not in ("no others", "current row", "group", "ties"):
        raise ValueError(f"EXCLUDE {exclude}?")
    w = Window.partitionBy(*partition).orderBy(F.desc(order) if descending else F.asc(order), *pk)
    peers = Window.partitionBy(*partition, order)
    d = df
    frame = w.rowsBetween(*rows)
    d = d.withColumn("_rn", F.row_number().over(w)).withColumn("_s", F.sum(x).over(frame)).withColumn("_c", F.count(x).over(frame))
    v, one = F.coalesce(F.col(x), F.lit(0)), F.when(F.col(x).isNotNull(), 1).otherwise(0)
    inside = rows[0] <= 0 <= rows[1]
    if exclude == "no others":
        return d.select(*df.columns, F.col("_s").alias("sum"), F.col("_c").alias("count"))
    if exclude == "current row":
        gone_s, gone_c = (v, one) if inside else (F.lit(0), F.lit(0))
    else:
        # rows of the peer group inside the frame: a ROWS frame over the group alone, same offsets
        cut = peers.orderBy("_rn").rowsBetween(*rows)
        gone_s, gone_c = F.coalesce(F.sum(v).over(cut), F.lit(0)), F.coalesce(F.sum(one).over(cut), F.lit(0))
        if exclude == "ties" and inside:
            gone_s, gone_c = gone_s - v, gone_c - one
    d = d.withColumn("_left", F.col("_c") - gone_c)
    return d.select(*df.columns, F.when(F.col("_left") > 0, F.col("_s") - gone_s).alias("sum"), F.col("_left").cast("long").alias("count"))


_FOLDS = {
    "count": lambda xs: F.size(F.array_compact(xs)).cast("long"),
    "sum": None,
    "min": F.array_min,
    "max": F.array_max,
    "array_agg": lambda xs: xs,
    "group_concat": lambda xs: F.when(F.size(F.array_compact(xs)) > 0, F.array_join(F.transform(F.array_compact(xs), lambda x: x.cast("string")), ",")),
    "first_value": lambda xs: F.get(xs, F.lit(0)),
    "last_value": lambda xs: F.get(xs, F.size(xs) - 1),
}


#: Parts of an aggregate: made from rows, merged over parts, joined from two that may be NULL, folded from an array.
_MERGED = {
    "count": (F.count, F.sum, lambda a, b: F.coalesce(a + b, a, b), lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)),
    "sum": (F.sum, F.sum, lambda a, b: F.coalesce(a + b, a, b), lambda xs: F.aggregate(F.slice(xs, 2, F.size(xs)), F.get(xs, F.lit(0)), lambda s, x: s + x)),
    "min": (F.min, F.min, F.least, F.array_min),
    "max": (F.max, F.max, F.greatest, F.array_max),
    "first_value": (F.min, F.min, F.least, F.array_min),
    "last_value": (F.max, F.max, F.greatest, F.array_max),
}


#: Rows of a ROWS frame up to which EXCLUDE GROUP and TIES hold them as columns.
NEAR = 16


def exclude(df: DataFrame, partition: list[str], order: str, frame: tuple[str, int, int], exclude_: str, aggs: dict[str, tuple[str, str]], pk: list[str], descending: bool = False) -> DataFrame:
    """Any aggregates (name: (function, column)) over a ``rows``, ``range`` or ``groups`` frame
    with EXCLUDE no others, current row, group or ties. Functions: count, sum, min, max, avg,
    array_agg, group_concat, first_value, last_value. An empty frame gives NULL, and 0 for count.

    RANGE and GROUPS frames hold whole peer groups, however large: these are aggregated first,
    frames run over one row for each group, and what is left of a row's own group is added.
    ROWS frames that exclude nothing or their row are one or two of Spark's; those of up to
    ``NEAR`` rows with EXCLUDE GROUP or TIES hold their rows as columns. The frame's rows are
    gathered for each row only over wider ones, where offsets bound them, and for array_agg
    and group_concat, which return them; so a frame has to be bounded there. For sum and count
    over ROWS ``exclude_sum_count`` gathers nothing."""
    kind, low, high = frame
    if exclude_ not in ("no others", "current row", "group", "ties") or kind not in ("rows", "range", "groups") or low > high:
        raise ValueError(f"{kind} {low} to {high} ... EXCLUDE {exclude_}?")
    unknown = [f for f, _ in aggs.values() if f not in _FOLDS and f != "avg"]
    if unknown:
        raise ValueError(f"unknown functions {unknown}")
    merged = all(f in _MERGED or f == "avg" for f, _ in aggs.values())
    beside = exclude_ in ("no others", "current row")
    if merged and kind == "rows" and (beside or high - low < NEAR):
        return (_exclude_beside if beside else _exclude_near)(df, partition, order, frame, exclude_, aggs, pk, descending)
    return (_exclude_merged if merged and kind != "rows" else _exclude_gathered)(df, partition, order, frame, exclude_, aggs, pk, descending)


def _exclude_beside(df: DataFrame, partition: list[str], order: str, frame: tuple[str, int, int], exclude_: str, aggs: dict[str, tuple[str, str]], pk: list[str], descending: bool) -> DataFrame:
    """ROWS frames that are whole, or all but the row: one or two of Spark's frames."""
    _, low, high = frame
    w = Window.partitionBy(*partition).orderBy(F.desc(order) if descending else F.asc(order), *pk)
    sides = [(low, high)] if exclude_ == "no others" else [x for x in ((low, min(high, -1)), (max(low, 1), high)) if x[0] <= x[1]]

    def total(s: str, x: str) -> Column:
        if not sides:
            return F.lit(0).cast("long") if s == "count" else F.lit(None).cast(_kind(df, s, x))
        if s in ("first_value", "last_value"):  # a row may hold NULL: structs tell it from no row
            make = F.first if s == "first_value" else F.last
            got = [make(F.struct(F.col(x).alias("x"))).over(w.rowsBetween(*side)) for side in sides]
            return F.coalesce(*(got if s == "first_value" else got[::-1]))["x"]
        make, _, both, _ = _MERGED[s]
        got = [make(x).over(w.rowsBetween(*side)) for side in sides]
        return got[0] if len(got) == 1 else both(*got)

    return df.select(*df.columns, *_results(total, aggs))


def _exclude_near(df: DataFrame, partition: list[str], order: str, frame: tuple[str, int, int], exclude_: str, aggs: dict[str, tuple[str, str]], pk: list[str], descending: bool) -> DataFrame:
    """Narrow ROWS frames without peers: a column for each place in the frame, NULL where its row is a peer."""
    _, low, high = frame
    w = Window.partitionBy(*partition).orderBy(F.desc(order) if descending else F.asc(order), *pk)
    places = [k for k in range(low, high + 1) if k or exclude_ == "ties"]
    inputs = list(dict.fromkeys(x for _, x in aggs.values()))

    def near(k: int, x: Column) -> Column:
        return F.lag(x, -k).over(w) if k < 0 else F.lead(x, k).over(w) if k else x

    rows = df.select("*", *[near(k, x).alias(f"_{n}{k}") for k in places for n, x in (("r", F.lit(True)), ("o", F.col(order)), *((f"x{i}_", F.col(x)) for i, x in enumerate(inputs)))])
    # _l: whether there is such a row and it is left
    left = {k: F.col(f"_r{k}").isNotNull() & ~F.col(f"_o{k}").eqNullSafe(F.col(order)) if k else F.lit(True) for k in places}
    rows = rows.select(*df.columns, *[x.alias(f"_l{k}") for k, x in left.items()], *[F.when(x, F.col(f"_x{i}_{k}")).alias(f"_v{i}_{k}") for k, x in left.items() for i in range(len(inputs))])

    def total(s: str, x: str) -> Column:
        xs = {k: F.col(f"_v{inputs.index(x)}_{k}") for k in places}
        if s == "count":
            return sum((F.when(v.isNotNull(), 1).otherwise(0) for v in xs.values()), F.lit(0)).cast("long")
        kind = _kind(df, s, x)
        if not xs:
            return F.lit(None).cast(kind)
        if s in ("first_value", "last_value"):
            at = [F.when(F.col(f"_l{k}"), F.struct(v.alias("x"))) for k, v in xs.items()]
            return F.coalesce(*(at if s == "first_value" else at[::-1]))["x"]
        if s == "sum":
            zero = F.lit(0).cast(kind)
            return F.when(F.coalesce(*xs.values()).isNotNull(), sum((F.coalesce(v.cast(kind), zero) for v in xs.values()), zero).cast(kind))
        return next(iter(xs.values())) if len(xs) == 1 else _MERGED[s][2](*xs.values())

    return rows.select(*df.columns, *_results(total, aggs))


def _kind(df: DataFrame, s: str, x: str) -> DataType:
    return df.select(F.sum(x)).schema[0].dataType if s == "sum" else df.schema[x].dataType


def _results(total: Callable[[str, str], Column], aggs: dict[str, tuple[str, str]]) -> list[Column]:
    return [(F.try_divide(total("sum", x).cast("double"), total("count", x)) if f == "avg" else total(f, x)).alias(n) for n, (f, x) in aggs.items()]


def _exclude_merged(df: DataFrame, partition: list[str], order: str, frame: tuple[str, int, int], exclude_: str, aggs: dict[str, tuple[str, str]], pk: list[str], descending: bool) -> DataFrame:
    kind, low, high = frame
    parts = {p: f"_s{i}" for i, p in enumerate(dict.fromkeys((s, x) for f, x in aggs.values() for s in (("sum", "count") if f == "avg" else (f,))))}
    placed = any(s in ("first_value", "last_value") for s, _ in parts)
    peers = Window.partitionBy(*partition, order)
    rows = df.withColumn("_i", F.row_number().over(peers.orderBy(*pk))) if placed or exclude_ == "current row" else df

    def value(s: str, x: str) -> Column:
        return F.struct("_i", F.col(x).alias("x")) if s in ("first_value", "last_value") else F.col(x)

    def at(s: str, part: Column) -> Column:
        """A first or last row with its group's number, by which they compare."""
        return F.when(part.isNotNull(), F.struct("_g", part.alias("r"))) if s in ("first_value", "last_value") else part

    # one row for each peer group, and what its frame holds besides the group
    keys = [f"_k{i}" for i in range(len(partition))]
    made = [_MERGED[s][0](value(s, x)).alias(n) for (s, x), n in parts.items()]
    groups = rows.groupBy(*[F.col(c).alias(k) for c, k in zip(partition, keys, strict=True)], F.col(order).alias("_o")).agg(*made)
    by = F.desc("_o") if descending else F.asc("_o")
    along = Window.partitionBy(*keys).orderBy(by)
    groups = groups.withColumn("_g", F.row_number().over(along)).withColumns({n: at(s, F.col(n)) for (s, _), n in parts.items()})

    def span(lo: int, hi: int) -> Window:
        return along.rowsBetween(lo, hi) if kind == "groups" else along.rangeBetween(lo, hi)

    sides = [(low, high)] if exclude_ == "no others" else [x for x in ((low, min(high, -1)), (max(low, 1), high)) if x[0] <= x[1]]
    whole = kind == "groups" or dict(df.dtypes)[order] in ("tinyint", "smallint", "int", "bigint", "date")
    rest = {}
    for (s, _), n in parts.items():
        _, merge, both, fold = _MERGED[s]
        if exclude_ == "no others" or whole:
            got = [merge(n).over(span(*x)) for x in sides]
            got = got[0] if len(got) == 1 else both(*got) if got else F.lit(None).cast(groups.schema[n].dataType)
            # NULL keys are peers, and their RANGE frame is their group, whatever the offsets
            rest[n] = got if exclude_ == "no others" or kind == "groups" else F.when(F.col("_o").isNotNull(), got)
        else:  # no step before or after a key that is no whole number: the groups of a frame, without its own
            near = F.filter(F.collect_list(F.struct("_g", F.col(n).alias("s"))).over(span(low, high)), lambda r: r["_g"] != F.col("_g"))
            known = F.array_compact(F.transform(near, lambda r: r["s"]))
            rest[n] = F.when(F.size(known) > 0, fold(known))
    groups = groups.select(*keys, "_o", "_g", *[v.alias(n) for n, v in rest.items()])

    # what is left of the group itself
    left = {}
    if exclude_ == "current row":
        for (s, x), n in parts.items():
            make, _, both, _ = _MERGED[s]
            left[f"_l{n}"] = both(make(value(s, x)).over(peers.orderBy("_i").rowsBetween(START, -1)), make(value(s, x)).over(peers.orderBy(F.desc("_i")).rowsBetween(START, -1)))
    elif exclude_ == "ties":
        for (s, x), n in parts.items():
            left[f"_l{n}"] = F.when(F.col(x).isNotNull(), 1).otherwise(0).cast("long") if s == "count" else value(s, x).cast(groups.schema[n].dataType) if s == "sum" else value(s, x)
    rows = rows.withColumns(left) if left else rows
    same = F.col(order).eqNullSafe(F.col("_o"))
    for c, k in zip(partition, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    inside = F.lit(low <= 0 <= high) | (F.lit(kind == "range") & F.col("_o").isNull())

    def total(s: str, x: str) -> Column:
        n = parts[s, x]
        out = _MERGED[s][2](F.col(n), F.when(inside, at(s, F.col(f"_l{n}")))) if left else F.col(n)
        return F.coalesce(out, F.lit(0)).cast("long") if s == "count" else out["r"]["x"] if s in ("first_value", "last_value") else out

    return rows.join(groups, same).select(*df.columns, *_results(total, aggs))


def _exclude_gathered(df: DataFrame, partition: list[str], order: str, frame: tuple[str, int, int], exclude_: str, aggs: dict[str, tuple[str, str]], pk: list[str], descending: bool) -> DataFrame:
    kind, low, high = frame
    by = F.desc(order) if descending else F.asc(order)
    w = Window.partitionBy(*partition).orderBy(by, *pk)
    d = df.withColumn("_rn", F.row_number().over(w)).withColumn("_g", F.dense_rank().over(Window.partitionBy(*partition).orderBy(by)))
    over = {"rows": Window.partitionBy(*partition).orderBy("_rn").rowsBetween(low, high), "groups": Window.partitionBy(*partition).orderBy("_g").rangeBetween(low, high), "range": Window.partitionBy(*partition).orderBy(by).rangeBetween(low, high)}[kind]
    inputs = sorted({c for _, c in aggs.values()})
    d = d.withColumn("_f", F.array_sort(F.collect_list(F.struct("_rn", "_g", *[F.col(c).alias(f"x{i}") for i, c in enumerate(inputs)])).over(over)))
    own, peers = (lambda r: r["_rn"] == F.col("_rn")), (lambda r: r["_g"] == F.col("_g"))
    left = {"no others": lambda r: F.lit(True), "current row": lambda r: ~own(r), "group": lambda r: ~peers(r), "ties": lambda r: ~peers(r) | own(r)}[exclude_]
    d = d.withColumn("_f", F.filter("_f", left))

    def fold(function: str, column: str) -> Column:
        xs = F.transform("_f", lambda r: r[f"x{inputs.index(column)}"])
        if function == "avg":
            return F.try_divide(fold("sum", column).cast("double"), fold("count", column))
        if function == "sum":
            zero = F.lit(0.0) if df.schema[column].dataType.simpleString() in ("float", "double") else F.lit(0).cast("long")
            known = F.array_compact(xs)
            return F.when(F.size(known) > 0, F.aggregate(known, zero, lambda s, x: s + x))
        return F.when(F.size(xs) > 0, xs) if function == "array_agg" else _FOLDS[function](xs)

    return d.select(*df.columns, *[fold(f, c).alias(n) for n, (f, c) in aggs.items()])
