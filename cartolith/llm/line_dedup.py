"""Line dedup over overlapping windows of three lines.

Every three consecutive lines of a text are hashed; windows whose hash occurs before, in
any document or earlier in the same one, are later occurrences, and all lines they cover
go.  The first occurrence is the one with the smallest (doc_id, text hash, position).

Only hashes travel.  Each line is hashed once, windows combine the hashes of their lines,
and the narrow table of windows is written before it is grouped and joined.  Windows are
counted with a partial aggregate, so a window that a third of all texts share is one row for
each task; the join back is by hash and can be split by Spark where one hash is frequent.

Texts meet the positions to remove once.  A bitmap of fixed size over hashed keys says which
texts may lose lines: the others, most of a corpus, stay where they are, and only texts of
marked keys are shuffled.  Positions are sorted, so lines are kept by ranges in one pass.

Lines are the parts between line feeds; a window needs one line with a word at least (runs
of blank lines are layout).  Edge cases: a null text stays null and has no lines; texts of
fewer than three lines have no window; where windows overlap within one text the covered
lines of all later occurrences go; rows equal in ``doc_id`` and ``text`` are one document
listed repeatedly and are all treated alike; null ids come first; further columns are kept;
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import let, materialize, table, with_mark

WINDOW = 3
NO_ID = -(1 << 63)


def _windows(lines: Column) -> Column:
    """Structs of position and hash of each window."""
    hashed = F.transform(lines, lambda v: F.struct(F.xxhash64(v).alias("h"), F.hash(v).alias("g"), v.rlike(r"[^\x20\x09-\x0D]").alias("w")))

    def of(x: Column) -> Column:
        at = lambda i, c: [F.get(x, i + k)[c] for k in range(WINDOW)]
        windows = F.transform(
            F.sequence(F.lit(0), F.size(x) - WINDOW),
            lambda i: F.when(F.greatest(*at(i, "w")), F.struct(i.alias("pos"), F.xxhash64(*at(i, "h")).alias("h"), F.hash(*at(i, "g")).alias("g"))),
        )
        return F.when(F.size(x) >= WINDOW, F.filter(windows, lambda w: w.isNotNull())).otherwise(F.array().cast("array<struct<pos:int,h:long,g:int>>"))

    return let(hashed, of)


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("th")]


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``d, th, pos`` for texts that lose lines: sorted positions (from 0) of the windows to remove."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    at = docs.select(*_key(), F.explode(_windows(lines)).alias("w")).select("d", "th", "w.pos", "w.h", "w.g")
    at = materialize(docs.sparkSession, at, "line-windows")
    place = F.struct("d", "th", "pos")
    twice = at.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").select("h", "g", "first")
    later = at.join(twice, ["h", "g"]).filter(place > F.col("first"))
    return later.groupBy("d", "th").agg(F.sort_array(F.collect_set("pos")).alias("pos"))


def _without(text: Column, pos: Column) -> Column:
    """``text`` and ``n``, what is left of a text and how many lines go, for sorted window positions."""

    def kept(x: Column) -> Column:
        n = F.size(pos)

        def piece(k: Column) -> Column:
            start = F.when(k == 0, 0).otherwise(F.get(pos, k - 1) + WINDOW)
            end = F.when(k == n, F.size(x)).otherwise(F.get(pos, k))
            return F.slice(x, start + 1, F.greatest(end - start, F.lit(0)))

        rest = F.flatten(F.transform(F.sequence(F.lit(0), n), piece))
        return let(rest, lambda r: F.struct(F.array_join(r, "\n").alias("text"), (F.size(x) - F.size(r)).cast("long").alias("n")))

    return let(F.split(text, "\n"), kept)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, and ``n_lines`` and ``n_removed``."""
    names = docs.columns
    gone = materialize(docs.sparkSession, repeated_lines(docs.select("doc_id", "text")), "line-removals")
    rows = with_mark(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *_key()), gone, ["d", "th"])
    text = F.col("_row.text")
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long").alias("n_lines")

    def out(df: DataFrame, new: Column, n: Column) -> DataFrame:
        columns = [new.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in names if c not in ("n_lines", "n_removed")]
        return df.select(*columns, n_lines, n.alias("n_removed"))

    changing = rows.filter("_mark").select("_row", "d", "th").join(gone, ["d", "th"], "left").withColumn("_new", F.when(F.col("pos").isNotNull(), _without(text, F.col("pos"))))
    still = out(rows.filter("not _mark"), text, F.lit(0).cast("long"))
    return still.unionByName(out(changing, F.when(F.col("pos").isNull(), text).otherwise(F.col("_new.text")), F.coalesce("_new.n", F.lit(0).cast("long"))))


def op8_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = """
WITH
l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
w AS (SELECT doc_id, i, x[i] || chr(10) || x[i+1] || chr(10) || x[i+2] AS win
         FROM (SELECT doc_id, x, unnest(generate_series(1, len(x) - 2)) AS i FROM l WHERE len(x) >= 3)),
g AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS j
         FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w WHERE regexp_matches(win, '[^\\x20\\x09-\\x0D]')) WHERE k > 1)),
r AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id),
deduped AS (SELECT l.doc_id, CASE WHEN gone IS NULL THEN text ELSE
          coalesce(array_to_string(list_filter(x, lambda v, i: NOT list_contains(gone, i)), chr(10)), '') END AS text,
          CASE WHEN text IS NULL THEN 0 ELSE len(x) END::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed
          FROM l LEFT JOIN r USING (doc_id))
SELECT doc_id, text, n_lines, n_removed FROM deduped
"""
