"""Similarity join on five-word shingles with Bayesian candidate pruning.

1. Each text becomes its set of shingle hashes; texts with equal sets collapse to one node
   that counts them.
2. MinHash bands deal nodes to buckets, in blocks.  In a block, MinHash values are compared
   ``STEP`` at a time; with a uniform prior the matches so far give the posterior
   probability that the similarity reaches the threshold, and a pair is dropped as soon as
   it falls below ``TOLERANCE``.  Of the bands that a pair shares only the lowest decides it,
   so each pair is pruned, verified and counted once.
3. A block returns its nodes that keep a partner, each with a bitmap of its partners in the
   block: at most 128 bytes a row, whatever the number of pairs.  These nodes are sent there
   again with their shingle sets, where the pairs of the bitmaps, and no others, are verified
   exactly; links are counted in the block and only a spanning forest leaves the task.
4. The components of verified links are the classes.

So the work grows with the buckets, not with what weak candidates join to chains.

Result: one row per document with ``class_id``, the smallest ``doc_id`` of its class, and
``n_links``, the number of other documents at a similarity of 0.8 or more (copies included).

Edge cases: a text of fewer than five words, but not none, has its word sequence as only
shingle; null and wordless texts have no links and are classes of their own, each row for
itself; repeated rows are copies like any other; null ids sort first and a class whose
smallest id is null has a null ``class_id``; further columns are dropped.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _similar as S
from ._common import materialize, small_batches, table, with_mark, words_of

BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
THRESHOLD = S.NUM / S.DEN
STEP, TOLERANCE = 24, 1e-5
#: Stands for a null id inside.
NO_ID = -(1 << 63)


def least_matches(hashes: int = HASHES, step: int = STEP, t: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """After n values compared, the fewest matches k for which P(similarity >= t | k of n) >= tolerance.

    With a uniform prior the posterior is Beta(k + 1, n - k + 1), whose upper tail at t is
    the chance of at most k successes in n + 1 trials of probability t.
    """
    out = []
    for n in range(step, hashes + 1, step):
        tail = k = 0.0
        k = -1
        while tail < tolerance:
            k += 1
            tail += comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k)
        out.append((n, k))
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """``id, th, h1, h2, size, keys, sig`` of each row: set digest, band keys and MinHash bytes."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("th"), F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))

    def run(batches):
        for batch in batches:
            w = batch.column("w")
            flat, ends = S.shingles(w.values.to_numpy().view(np.uint64), w.offsets.to_numpy())
            minima = S.minhash(flat, ends, HASHES)
            size = np.diff(ends)
            h1, h2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
            full = np.flatnonzero(size)
            if len(full):
                with np.errstate(over="ignore"):
                    h1[full] = np.bitwise_xor.reduceat(S.mix(flat + np.uint64(1)), ends[:-1][full])
                    h2[full] = np.add.reduceat(S.mix(flat ^ S._MULTIPLY), ends[:-1][full])
            keys = S.band_keys(minima, BANDS, ROWS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("th"), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(size.astype(np.int64)),
                 S.list_of(keys.reshape(-1), np.arange(len(size) + 1) * BANDS), S.binary_rows((minima & np.uint32(255)).astype(np.uint8))],
                ["id", "th", "h1", "h2", "size", "keys", "sig"],
            )

    return rows.mapInArrow(run, "id long, th long, h1 long, h2 long, size long, keys array<long>, sig binary")


BOUNDS = least_matches()


def surviving_pairs(number: np.ndarray, inner: np.ndarray, side: np.ndarray, sig: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that Bayesian pruning leaves, of all groups of rows sorted by group."""
    sig = np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(len(number), HASHES)
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y in S.pairs_at(number, inner, side):
        matches, start = np.zeros(len(x), np.int64), 0
        for n, least in BOUNDS:
            matches += (sig[x, start:n] == sig[y, start:n]).sum(1)
            go = matches >= least
            x, y, matches, start = x[go], y[go], matches[go], n
            if not len(x):
                break
        xs.append(x)
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


def lowest_common_band(key: np.ndarray, keys: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of rows share no band before that of ``key``; ``keys`` are the band keys of each row."""
    first = (keys[x] == keys[y]).argmax(1)
    return keys[x, first] == key[x]


def partner_bitmaps(number: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Rows of pairs (x < y, of equal ``number``), their place in their group, and the places of their later partners as bits."""
    at = np.unique(np.concatenate([x, y]))
    start = np.searchsorted(number[at], number[at])
    place = np.arange(len(at)) - start
    width = (np.searchsorted(number[at], number[at], "right") - start + 7) // 8
    ends = np.concatenate([[0], np.cumsum(width)])
    bits = np.zeros(ends[-1], np.uint8)
    later = place[np.searchsorted(at, y)]
    np.bitwise_or.at(bits, ends[np.searchsorted(at, x)] + later // 8, (1 << (later % 8)).astype(np.uint8))
    return at, place, pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(bits)])


def pairs_of_bitmaps(number: np.ndarray, bitmaps: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, sorted, from the bitmaps of rows that are sorted by group and place."""
    raw = bitmaps.to_pylist()
    ends = np.cumsum([0, *map(len, raw)])
    found = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(raw), np.uint8), bitorder="little"))
    x = np.searchsorted(ends, found // 8, "right") - 1
    return x, np.searchsorted(number, number[x]) + found - 8 * ends[x]


def candidates(nodes: DataFrame) -> DataFrame:
    """``key, bi, bj, place, node, m, partners``: rows of each block of a bucket that Bayesian pruning leaves with a partner there."""
    dealt = S.in_blocks(nodes.select("node", F.explode("keys").alias("key")), "key", F.col("node")).join(nodes.select("node", "m", "sig", "keys"), "node")
    by, names = ["key", "bi", "bj"], ["key", "bi", "bj", "node", "m"]

    def run(batches):
        for whole, number in S.groups(batches, by):
            inner = whole.column("bi").to_numpy() == whole.column("bj").to_numpy()
            x, y = surviving_pairs(number, inner, whole.column("side").to_numpy(), whole.column("sig"))
            keys = np.concatenate([c.flatten().to_numpy() for c in whole.column("keys").chunks]).reshape(-1, BANDS)
            own = lowest_common_band(whole.column("key").to_numpy(), keys, x, y)
            if own.any():
                at, place, bits = partner_bitmaps(number, x[own], y[own])
                rows = whole.select(names).take(pa.array(at)).append_column("place", pa.array(place.astype(np.int32))).append_column("partners", bits)
                yield from rows.combine_chunks().to_batches()

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *by).sortWithinPartitions(*by).mapInArrow(run, "key long, bi int, bj int, node long, m long, place int, partners binary")


def verified_links(dealt: DataFrame) -> DataFrame:
    """``node, root, links`` from ``candidates`` with shingle sets ``sh``: exactly verified pairs by summed weights and a forest of each block."""
    by = ["key", "bi", "bj"]

    def run(batches):
        for whole, number in S.groups(batches, by):
            node, m = whole.column("node").to_numpy(), whole.column("m").to_numpy()
            x, y = pairs_of_bitmaps(number, whole.column("partners"))
            x, y = S.similar_pairs(number, whole.column("sh"), x, y)
            links = np.zeros(len(node), np.int64)
            np.add.at(links, x, m[y])
            np.add.at(links, y, m[x])
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[S.forest(len(node), x, y)][at]), pa.array(links[at])], ["node", "root", "links"])

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *by).sortWithinPartitions(*by, "place").mapInArrow(run, "node long, root long, links long")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` replaced by ``sh``, its sorted distinct shingle hashes."""
    names = [c for c in rows.columns if c != "text"]
    hashed = rows.select(*names, F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))

    def run(batches):
        for batch in batches:
            w = batch.column("w")
            flat, ends = S.shingles(w.values.to_numpy().view(np.uint64), w.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, S.list_of(flat, ends)], [*names, "sh"])

    return hashed.mapInArrow(run, rows.select(*names, F.array().cast("array<long>").alias("sh")).schema)


def similar_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``id, th, class_id, n_links, root`` for each row of ``docs`` (``doc_id``, ``text``); ``root`` is unique to a class, null without words."""
    sketch = materialize(spark, sketches(docs), "ngram-sketch")
    worded = sketch.filter("size > 0")
    nodes = worded.groupBy("h1", "h2").agg(F.min(F.struct("id", "th")).alias("rep"), F.count("*").alias("m"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    nodes = materialize(spark, nodes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "rep.id", "rep.th", "m", "keys", "sig"), "ngram-nodes")
    pairs = materialize(spark, candidates(nodes), "ngram-pairs")
    found = materialize(spark, nodes.select("node", "id", "th").join(pairs.select("node").distinct(), "node"), "ngram-found")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text").withColumn("th", F.xxhash64("text"))
    texts = with_mark(texts, found, ["id", "th"]).filter("_mark").drop("_mark").join(found, ["id", "th"])
    sets = materialize(spark, shingle_sets(texts.dropDuplicates(["node"]).select("node", "text")), "ngram-sets")
    verified = materialize(spark, verified_links(pairs.join(sets, "node")), "ngram-verified")
    classes = S.components(spark, verified, "ngram-classes")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    labelled = nodes.select("node", "h1", "h2", "id", "m").join(links, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labelled.groupBy("root").agg(F.min("id").alias("class_id"))
    labelled = labelled.join(least, "root").select("h1", "h2", "class_id", "root", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = worded.select("id", "th", "h1", "h2").join(labelled, ["h1", "h2"]).select("id", "th", "class_id", "n_links", "root")
    alone = sketch.filter("size = 0").select("id", "th", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("root"))
    return out.unionByName(alone)


def _id(c: str):
    return F.when(F.col(c) != NO_ID, F.col(c)).alias("doc_id" if c == "id" else c)


def op9_bayes_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark, table(spark, sf_dir, "documents")).select(_id("id"), _id("class_id"), "n_links")


def keep_one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, that of the smallest id (among equal ids, of the smallest text hash); rows without words all stay.

    Documents that are alone in their class stay where they are; only the others are shuffled.
    """
    found = materialize(spark, similar_documents(spark, docs), "ngram-result").filter(F.col("root").isNotNull())
    classes = found.groupBy("root").agg(F.min(F.struct("id", "th")).alias("k"), F.count("*").alias("c")).filter("c > 1")
    members = materialize(spark, found.join(classes, "root").select("id", "th", (F.struct("id", "th") == F.col("k")).alias("first")).distinct(), "ngram-members")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("th"))
    rows = with_mark(rows, members, ["id", "th"])
    some = rows.filter("_mark").drop("_mark").join(members, ["id", "th"], "left")
    kept = some.filter("first").dropDuplicates(["id", "th"]).unionByName(some.filter("first IS NULL"))
    return rows.filter("not _mark").select("_row.*").unionByName(kept.select("_row.*"))


OP9_SQL = """
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') || CASE WHEN len(w) < 5 THEN chr(10) ELSE '' END AS x
         FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e e ON r.b = e.a),
classes AS (SELECT r.a AS doc_id, min(r.b) AS class_id, any_value(coalesce(k.n, 0))::BIGINT AS n_links
          FROM reach r LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) k ON k.a = r.a GROUP BY r.a)
SELECT doc_id, class_id, n_links FROM classes
"""
