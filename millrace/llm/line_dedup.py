"""Removal of line runs that an earlier document, or an earlier place, already has.

Winnowing over line hashes. Of every window of ``run`` consecutive non-blank lines the line
of least hash (the last one, on ties) is selected, so two equal windows select equal lines at
equal places: the selected hashes are fingerprints that no repeated run can be without, and
neighbouring windows mostly share one. Each selected position is one row. Positions are
joined by fingerprint, and those whose fingerprint stands nowhere else go at once. The rest
are extended both ways, to every window whose minimum they are: a window's own hash tells
whether the match goes on over all of its lines. Windows overlap, so extended matches chain
and a later run is removed at its full length, however long it is.

DataFrame functions only. The texts are cut into lines once; positions are written to the
shared folder and read from there. Positions are never paired: aggregates with map-side
combination find repeated fingerprints and the earliest place of each extension, and
equi-joins on tables just written, which AQE can split, bring them back. All of these
tables grow with the input, so none is broadcast, however small it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import cut, table


def _long(line: F.Column, words: int) -> F.Column:
    """Whether a line has so many words; no more of it is read than that takes."""
    space = r" \t\r\x0B\f"
    return line.rlike(rf"^[{space}]*+(?:[^{space}]++[{space}]++){{{words - 1}}}[^{space}]")


def positions(docs: DataFrame, run: int, alone: int | None) -> DataFrame:
    """(id, rk, fp, windows): one row for each selected position of each document, with the
    windows (i, lines, key) of which it is the minimum; made without a shuffle."""
    # a line of n words has 2n - 1 bytes at least
    long = (lambda x: F.when(F.octet_length(x) >= 2 * alone - 1, _long(x, alone)).otherwise(False)) if alone else lambda x: F.lit(False)
    lines = F.transform(
        F.split(F.coalesce("t", F.lit("")), "\n", -1),
        lambda x, i: F.struct(i.alias("at"), long(x).alias("long"), F.xxhash64(x).alias("f"), F.when(F.trim(F.regexp_replace(x, r"[\t\r\x0B\f]", " ")) != "", F.unhex(F.md5(x))).alias("h")),
    )
    rows = docs.where(F.col("id").isNotNull()).select("id", "rk", F.filter(lines, lambda x: x["h"].isNotNull()).alias("hs"))
    rows = rows.where(F.size("hs") > 0)

    def window(i: F.Column, n: F.Column) -> F.Column:
        """One window; its position is negated, so that the last of equal minima is least."""
        part = F.slice("hs", i + 1, n)
        least = F.array_min(F.transform(part, lambda x, j: F.struct(x["f"].alias("f"), (-(i + j)).alias("p"))))
        key = F.unhex(F.md5(F.aggregate(part, F.lit(b""), lambda a, x: F.concat(a, x["h"]))))
        return F.struct(i.alias("i"), least.alias("least"), F.transform(part, lambda x: x["at"]).alias("lines"), key.alias("key"))

    starts = F.sequence(F.lit(0), F.greatest(F.size("hs") - run, F.lit(0)))
    rows = rows.withColumn("windows", F.transform(starts, lambda i: window(i, F.lit(run))))
    # minima move only forwards, so the windows of one stand together: at most ``run`` of them
    fresh = F.filter("windows", lambda x, k: (k == 0) | (F.get("windows", k - 1)["least"]["p"] != x["least"]["p"]))
    # shorter windows (short documents, long lines) have fingerprints of their own, so that a
    # line which is also a minimum of longer ones does not look repeated
    fp = lambda x: F.when(F.size(x["lines"]) < run, F.xxhash64(x["least"]["f"], F.size(x["lines"]))).otherwise(x["least"]["f"])
    found = F.transform(fresh, lambda x: F.struct(fp(x).alias("fp"), F.filter(F.slice("windows", x["i"] + 1, run), lambda y: y["least"]["p"] == x["least"]["p"]).alias("windows")))
    if alone and run > 1:
        # a long line is a window of its own, with the key of a document that has no other line
        at = F.transform("hs", lambda x, i: F.struct(x["long"].alias("long"), F.xxhash64(x["f"], F.lit(1)).alias("fp"), i.alias("i"), x["at"].alias("at"), x["h"].alias("h")))
        one = lambda x: F.struct(x["i"].alias("i"), F.struct(x["fp"].alias("f"), (-x["i"]).alias("p")).alias("least"), F.array(x["at"]).alias("lines"), F.unhex(F.md5(x["h"])).alias("key"))
        found = F.concat(found, F.transform(F.filter(at, lambda x: x["long"]), lambda x: F.struct(x["fp"], F.array(one(x)).alias("windows"))))
    out = rows.select("id", "rk", F.explode(found).alias("x"))
    return out.select("id", "rk", "x.fp", F.transform("x.windows", lambda y: F.struct(y["i"], y["lines"], y["key"])).alias("windows"))


def remove_repeated_runs(docs: DataFrame, run: int = 2, id_col: str = "doc_id", text_col: str = "text", alone: int | None = None) -> DataFrame:
    """``docs`` with the kept text in ``text_col``, and with ``n_lines`` and ``n_removed``.

    Lines are split at ``\\n``; blank lines (white space only) are never matched or removed.
    A window is ``run`` consecutive non-blank lines of one document, or all of them where
    there are fewer. A window goes if an equal one starts earlier, in (id, line) order;
    lines covered by no such window stay, in order. With ``alone``, every line of at least
    so many words is a window too, whatever stands around it. Rows with a null id are kept whole and
    are no one's earlier place. Rows of equal id and text get equal results. Null texts
    stay null, with one empty line. Other columns, whatever their names, pass unchanged;
    ``n_lines`` and ``n_removed`` are replaced.
    """
    if run < 1:
        raise ValueError("run must be positive")
    if alone is not None and alone < 1:
        raise ValueError("alone must be positive")
    cols = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    if id_col not in cols or text_col not in cols:
        raise ValueError("id and text columns are needed")
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    k, t = f"c{cols.index(id_col)}", f"c{cols.index(text_col)}"
    base = base.withColumn("rk", F.xxhash64(t))
    places = cut(positions(base.select(F.col(k).alias("id"), "rk", F.col(t).alias("t")), run, alone), "positions")
    often = cut(places.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "fingerprints")
    near = cut(places.join(often.hint("merge"), "fp", "left_semi").select("id", "rk", F.explode("windows").alias("x")).select("id", "rk", "x.*"), "extensions")
    first = near.groupBy("key").agg(F.min(F.struct("id", "i")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = near.join(cut(first, "earliest").hint("merge"), "key").where(F.struct("id", "i") > F.col("first"))
    gone = later.groupBy("id", "rk").agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("gone"))
    gone = cut(gone.select(F.col("id").alias("g_id"), F.col("rk").alias("g_rk"), "gone"), "gone")
    out = base.join(gone.hint("merge"), (F.col(k) == F.col("g_id")) & (F.col("rk") == F.col("g_rk")), "left")
    split = F.split(F.coalesce(F.col(t), F.lit("")), "\n", -1)
    out = out.withColumn("ls", split).withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), "gone"))
    text = F.when(F.col("gone").isNull(), F.col(t)).otherwise(F.array_join(F.transform("stay", lambda i: F.get("ls", i)), "\n"))
    final = [text.alias(c) if f"c{i}" == t else F.col(f"c{i}").alias(c) for i, c in enumerate(cols)]
    return out.select(*final, F.size("ls").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))


#: Words of a line that the query takes as a repeat wherever it stands.
LONG_LINE = 50


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest over all documents: doc_id, n_lines, n_removed, kept_sha256. Runs of two lines
    go, and single lines of ``LONG_LINE`` words or more."""
    out = remove_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), alone=LONG_LINE)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY doc_id) AS m
      FROM l WHERE regexp_matches(line, '[^ \\t\\r\\x0B\\f]')),
w AS (SELECT doc_id, i, CASE WHEN m = 1 THEN [pos] ELSE [pos, lead(pos) OVER d] END AS places,
             CASE WHEN m = 1 THEN line ELSE line || chr(10) || lead(line) OVER d END AS key
      FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY i)
      UNION ALL
      SELECT doc_id, i, [pos], line FROM n WHERE m > 1 AND len(regexp_extract_all(line, '[^ \\t\\r\\x0B\\f]+')) >= 50),
v AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS k FROM w WHERE key IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(places) AS pos FROM v WHERE k > 1)
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(g.pos) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
"""
