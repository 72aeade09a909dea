"""Two-way synchronisation: three-way merges of source, target and what was last in step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SyncConflict(Exception):
    """Both sides moved; nothing was changed."""


@dataclass
class Synced:
    source: DataFrame
    target: DataFrame
    hashes: DataFrame


def fingerprint(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """(key, hash of the other columns); 128 bits, NULL-safe."""
    rest = [c for c in df.columns if c not in key]
    text = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    return df.select(*key, F.md5(text).alias(name))


def status(source: DataFrame, target: DataFrame, last: DataFrame, key: list[str]) -> DataFrame:
    """(key, state) of every key: clean, source, target (the side that moved), or conflict. A
    side that moved back to the other's content is clean: hashes of both sides are kept, so
    an echoed change is not taken for news."""
    s, t = fingerprint(source, key, "s"), fingerprint(target, key, "t")
    both = s.join(t, key, "full").join(last.select(*key, F.col("hs"), F.col("ht")), key, "full")
    moved_s, moved_t = ~F.col("s").eqNullSafe(F.col("hs")), ~F.col("t").eqNullSafe(F.col("ht"))
    state = F.when(F.col("s").eqNullSafe(F.col("t")), "clean").when(moved_s & moved_t, "conflict").when(moved_s, "source").when(moved_t, "target").otherwise("clean")
    return both.select(*key, state.alias("state"), "s", "t")


def check(source: DataFrame, target: DataFrame, last: DataFrame, key: list[str]) -> DataFrame:
    """Pending changes and breaches by state."""
    return status(source, target, last, key).groupBy("state").agg(F.count("*").alias("n"))


def synchronise(source: DataFrame, target: DataFrame, last: DataFrame, key: list[str]) -> Synced:
    """Carry each side's changes to the other; any conflict aborts the whole run."""
    if source.columns != target.columns:
        raise ValueError("both sides need the same columns")
    st = status(source, target, last, key)
    if not st.where("state = 'conflict'").isEmpty():
        raise SyncConflict("both sides changed a row")
    from_source, from_target = st.where("state = 'source'").select(*key), st.where("state = 'target'").select(*key)
    new_source = source.join(from_target, key, "left_anti").select(*source.columns).unionByName(target.join(from_target, key, "left_semi").select(*source.columns))
    new_target = target.join(from_source, key, "left_anti").select(*source.columns).unionByName(source.join(from_source, key, "left_semi").select(*source.columns))
    hashes = fingerprint(new_source, key, "hs").join(fingerprint(new_target, key, "ht"), key, "full")
    return Synced(new_source, new_target, hashes)


def replicate(upstream: DataFrame, local: DataFrame, base: DataFrame, key: list[str], policy: str = "upstream") -> DataFrame:
    """A replica's next content from the upstream, itself and the last common content: changes
    of one side only are taken, and of rows that both changed the policy's side wins."""
    if policy not in ("upstream", "local"):
        raise ValueError(f"policy {policy}?")
    pack = lambda d, n: d.select(*key, F.struct(*d.columns).alias(n))
    both = pack(upstream, "u").join(pack(local, "l"), key, "full").join(pack(base, "b"), key, "full")
    up, mine = ~F.col("u").eqNullSafe(F.col("b")), ~F.col("l").eqNullSafe(F.col("b"))
    first = up if policy == "upstream" else up & ~mine
    row = F.when(first, F.col("u")).when(mine, F.col("l")).otherwise(F.col("u"))
    return both.withColumn("_r", row).where(F.col("_r").isNotNull()).select(*[F.col(f"_r.{c}").alias(c) for c in upstream.columns])


@dataclass
class Replica:
    """A replica's content, what it last had in common with the upstream, and how far it has
    read the upstream's journal."""

    local: DataFrame
    base: DataFrame
    cursor: int = 0


def seed(upstream: DataFrame, journal: DataFrame) -> Replica:
    """A new replica: all rows, and a cursor behind all that the journal tells of them."""
    return Replica(upstream, upstream, journal.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0])


def pull(replica: Replica, upstream: DataFrame, journal: DataFrame, key: list[str], policy: str = "upstream") -> Replica:
    """Take over the keys that the journal names past the cursor, merged by the policy; other
    rows are neither read from the upstream nor compared."""
    news = journal.where(F.col("seq") > replica.cursor)
    keys = news.select(*key).distinct()
    part = lambda d: d.join(keys, key, "left_semi").select(*d.columns)
    rest = lambda d: d.join(keys, key, "left_anti").select(*d.columns)
    merged = replicate(part(upstream), part(replica.local), part(replica.base), key, policy)
    cursor = news.agg(F.max("seq")).first()[0]
    return Replica(rest(replica.local).unionByName(merged), rest(replica.base).unionByName(part(upstream)), replica.cursor if cursor is None else cursor)


def push(replica: Replica, upstream: DataFrame, key: list[str]) -> tuple[DataFrame, Replica]:
    """(upstream, replica): local changes go up, unless the upstream's row has moved from the
    common one too, which raises: pull first."""
    pack = lambda d, n: d.select(*key, F.struct(*d.columns).alias(n))
    both = pack(replica.local, "l").join(pack(replica.base, "b"), key, "full").where(~F.col("l").eqNullSafe(F.col("b")))
    moved = both.join(pack(upstream, "u"), key, "left").where(~F.col("u").eqNullSafe(F.col("b")) & ~F.col("u").eqNullSafe(F.col("l")))
    if not moved.isEmpty():
        raise SyncConflict("the upstream has moved")
    out = upstream.join(both.select(*key), key, "left_anti").select(*upstream.columns)
    out = out.unionByName(both.where(F.col("l").isNotNull()).select(*[F.col(f"l.{c}").alias(c) for c in upstream.columns]))
    return out, Replica(replica.local, replica.local, replica.cursor)
