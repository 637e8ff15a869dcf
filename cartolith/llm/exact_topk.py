"""Exact top-k by inner product, selected with distributed histograms.

Components become integers (``floor(1024 * x)``), so scores are exact.  Queries are the rows
whose id is divisible by ``EVERY``; every row but the query's own is scored against each.

1. Queries travel in passes of ``PASS_BYTES``; the candidates stay where they are.
2. A round scores all candidates and counts, for each query, how many scores fall into each
   of ``BINS`` bins of an interval that surely holds the kth score.  Counts of all tasks are
   added up, the bin of the kth score is the next interval, and a bin of width 1 (or one
   that is needed whole) ends the search.  A task counts from its highest bins down to the
   one where it has k scores by itself: no kth score lies lower, so what it leaves out
   cannot change the bin that is found.
3. Rows at or above the kth score are kept.  Of those a task returns at most k a query, its
   best by score and id, so equal scores of any number are no flood; the last cut is a
   window with the order (score descending, ``vec_id`` ascending).

What shuffles: counts of at most k scores a task and query in each round, and at most k rows
a task and query in the end.  The driver holds a pass's queries and their intervals.

Edge cases: a null vector, or one with a null or non-finite component, takes no part; of two
vectors of different lengths the longer one's further components count as 0, so an empty
vector scores 0; a null ``vec_id`` is a candidate before all others among ties, but no query;
rows with equal ids are rows of their own (a query's repeat is a candidate, and each such row
is a query); fewer than k candidates are all returned; an empty table gives no rows; further
columns are dropped.  Components saturate at 64 bits and scores at 61.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, small_batches, table

K, EVERY, SCALE = 10, 100, 1024
BINS = 256
#: Bytes of query vectors that are broadcast together, and scores held at a time in a task.
PASS_BYTES, SCORES = 8 << 20, 2 << 20
LIMIT = (1 << 61) - 1


def quantised(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``row, vec_id, v`` of the rows that take part; ``row`` is unique once it is written."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE))
    return vectors.filter(x.isNotNull() & finite).select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("vec_id"), v.alias("v"))


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists as rows of integers; shorter ones are filled with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ends, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
    size = np.diff(ends)
    width = int(size.max()) if len(size) else 0
    if (size == width).all():
        return values[ends[0] : ends[-1]].reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    at = np.repeat(np.arange(len(size)), size)
    out[at, np.arange(len(at)) - np.repeat(ends[:-1] - ends[0], size)] = values[ends[0] : ends[-1]]
    return out


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact in the narrowest type that holds every partial sum."""
    width = min(q.shape[1], c.shape[1])
    q, c = q[:, :width], c[:, :width]
    norm = lambda m: float(np.sqrt((m.astype(np.float64) ** 2).sum(1).max(initial=0)))
    most = norm(q) * norm(c) * 1.001 + 1  # by Cauchy and Schwarz, also for sums over some of the components
    if most < 1 << 53:
        kind = np.float32 if most < 1 << 24 and max(abs(q).max(initial=0), abs(c).max(initial=0)) < 1 << 24 else np.float64
        return q.astype(kind) @ c.T.astype(kind)
    return np.clip(q.astype(object) @ c.T.astype(object), -LIMIT, LIMIT).astype(np.int64) if width else np.zeros((len(q), len(c)))


class Pass:
    """A pass's queries, in order of row, and the interval of each that holds its kth score."""

    def __init__(self, rows: list, largest: float, k: int):
        rows = sorted(rows, key=lambda r: r.row)
        self.bins, self.scores = BINS, SCORES
        self.row = np.array([r.row for r in rows], np.int64)
        self.id = np.array([r.vec_id for r in rows], np.int64)
        self.v = matrix(pa.array([r.v for r in rows], pa.list_(pa.int64())))
        norms = np.sqrt((self.v.astype(np.float64) ** 2).sum(1))
        bound = [min(LIMIT, int(n * largest * (1 + 1e-9)) + 2) for n in norms.tolist()]
        self.low = np.array([-b for b in bound], np.int64)
        self.shift = np.array([max(0, (2 * b).bit_length() - self.bins.bit_length() + 1) for b in bound], np.int64)
        self.top = np.array([b + 1 for b in bound], np.int64)
        self.need = np.full(len(rows), k, np.int64)
        self.open = np.ones(len(rows), bool)

    def blocks(self, which: np.ndarray, rows: np.ndarray, c: np.ndarray):
        """Indices of some of the queries ``which`` at a time, and their scores; a row's score with itself is below all."""
        step = max(1, self.scores // max(1, len(c)))
        for a in range(0, len(which), step):
            q = which[a : a + step]
            s = scores(self.v[q], c)
            at = np.searchsorted(self.row[q], rows)
            own = np.flatnonzero((at < len(q)) & (self.row[q][np.minimum(at, len(q) - 1)] == rows))
            s[at[own], own] = -LIMIT - 1 if s.dtype == np.int64 else -np.inf
            yield q, s

    def narrow(self, found: list) -> None:
        """The next interval of each query, from the bin of its kth score."""
        known = np.zeros(len(self.row), bool)
        for q, bin_, upto, n in found:
            known[q] = True
            self.need[q] -= upto - n
            self.low[q] += bin_ << int(self.shift[q])
            self.top[q] = self.low[q] + (1 << int(self.shift[q]))
            if self.shift[q] == 0 or n == self.need[q]:
                self.open[q] = False
            self.shift[q] = max(0, int(self.shift[q]) - self.bins.bit_length() + 1)
        self.open &= known  # the others have fewer than k candidates: all that lie in the interval


def _counts(batches, state: Pass):
    which = np.flatnonzero(state.open)
    low, top, shift, need = state.low, state.top, state.shift, state.need
    bins = state.bins
    counts, floor = np.zeros((len(state.row), bins), np.int64), low.copy()
    for batch in batches:
        c, rows = matrix(batch.column("v")), batch.column("row").to_numpy()
        for q, s in state.blocks(which, rows, c):
            x, y = np.nonzero(s >= floor[q].astype(s.dtype)[:, None])
            value, at = s[x, y].astype(np.int64), q[x]
            inside = value < top[at]
            value, at = value[inside], at[inside]
            np.add.at(counts, (at, (value - low[at]) >> shift[at]), 1)
            upto = counts[q, ::-1].cumsum(1)
            enough = upto[:, -1] >= need[q]
            full = q[enough]
            first = bins - 1 - (upto[enough] >= need[full, None]).argmax(1)
            floor[full] = low[full] + (first << shift[full])
    counts[np.arange(bins) < ((floor - low) >> shift)[:, None]] = 0
    x, y = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(need[x]), pa.array(counts[x, y])], ["q", "bin", "need", "n"])


def _best(held: list, k: int) -> list:
    """Of ``q, score, null, id`` arrays, the k best of each query."""
    q, score, none, id_ = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((id_, ~none, -score, q))
    start = np.searchsorted(q[order], q[order])
    order = order[np.arange(len(order)) - start < k]
    return [(q[order], score[order], none[order], id_[order])]


def _above(batches, state: Pass, k: int):
    which, held, size = np.arange(len(state.row)), [], 0
    for batch in batches:
        c, rows, ids = matrix(batch.column("v")), batch.column("row").to_numpy(), batch.column("vec_id")
        none, id_ = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        for q, s in state.blocks(which, rows, c):
            x, y = np.nonzero(s >= state.low[q].astype(s.dtype)[:, None])
            held.append((q[x], s[x, y].astype(np.int64), none[y], id_[y]))
            size += len(x)
            if size > state.scores:
                held = _best(held, k)
                size = len(held[0][0])
    if size:
        q, score, none, id_ = _best(held, k)[0]
        yield pa.RecordBatch.from_arrays([pa.array(state.row[q]), pa.array(state.id[q]), pa.array(id_, mask=none), pa.array(score)], ["row", "query_id", "vec_id", "score"])


def _passes(queries: DataFrame, width: int):
    """Queries in passes of bounded size; the driver holds one at a time."""
    most, held = max(1, PASS_BYTES // (8 * max(1, width))), []
    for r in queries.toLocalIterator():
        held.append(r)
        if len(held) >= most:
            yield held
            held = []
    if held:
        yield held


def top_k(spark: SparkSession, vectors: DataFrame, *, k: int = K, every: int = EVERY, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of each query."""
    small_batches(spark)
    rows = materialize(spark, quantised(vectors, id=id, vector=vector), "topk-vectors")
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = rows.agg(F.max(F.sqrt(length)), F.max(F.size("v"))).first()
    largest, width = facts[0] or 0.0, facts[1] or 0
    best, out = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_first("vec_id")), None
    kth = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    for queries in _passes(rows.filter(F.pmod("vec_id", F.lit(every)) == 0), width):
        state = Pass(queries, largest, k)
        while state.open.any():
            shared = spark.sparkContext.broadcast(state)
            counts = rows.select("row", "v").mapInArrow(lambda b, s=shared: _counts(b, s.value), "q int, bin int, need long, n long")
            upto = counts.groupBy("q", "bin", "need").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(kth))
            found = upto.filter("upto >= need AND upto - n < need").select("q", "bin", "upto", "n").collect()
            shared.destroy()
            state.narrow(found)
        shared = spark.sparkContext.broadcast(state)
        above = rows.mapInArrow(lambda b, s=shared: _above(b, s.value, k), "row long, query_id long, vec_id long, score long")
        ranked = above.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        part = materialize(spark, ranked.select("query_id", "rank", "vec_id", "score"), "topk-pass")
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op13_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, table(spark, sf_dir, "embeddings"))


OP13_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
      FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % {EVERY} = 0),
t AS (SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS FIRST))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= {K}
"""
