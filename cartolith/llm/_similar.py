"""What the near-duplicate operators share: shingles, MinHash bands, blocks of a bucket, components.

Items that meet in a bucket are compared inside a task that holds two blocks of at most
``BLOCK`` of them.  A task never returns the pairs: for each item it returns the smallest
item that it is joined to, directly or through others, and the summed weight of the items
it is similar to.  So the rows out are as many as the rows in, whatever a bucket's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize

SHINGLE = 5
#: Similar: 5 * |A and B| >= 4 * |A or B|.
NUM, DEN = 4, 5
BLOCK = 512
#: Bytes that ``similar_pairs`` has in hand at a time.
STRIP = 4 << 20
HUBS = 500
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers with well spread bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each item, flat, with offsets.

    ``words`` are word hashes of all items, flat.  An item of fewer words than a shingle,
    but not none, has its whole word sequence as its only shingle.
    """
    words = words.astype(np.uint64)
    rolled = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            rolled = mix(rolled * _MULTIPLY + words[k : k + len(rolled)] + np.uint64(k + 1))
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if b - a >= SHINGLE:
                out.append(np.unique(rolled[a : b - SHINGLE + 1]))
            elif b > a:
                h = np.full(1, b - a, np.uint64)
                for w in words[a:b]:
                    h = mix(h * _MULTIPLY + w)
                out.append(h)
            else:
                out.append(rolled[:0])
    ends = np.cumsum([0, *map(len, out)])
    return np.concatenate(out) if out else rolled[:0], ends


def minhash(flat: np.ndarray, offsets: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k minima (uint32) of each item; items without shingles get all ones."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, k, dtype=np.uint64)
    size = np.diff(offsets)
    full = np.flatnonzero(size)
    out = np.full((len(size), k), 0xFFFFFFFF, np.uint32)
    if len(full):
        starts = offsets[:-1][full]
        with np.errstate(over="ignore"):
            for i in range(k):
                v = ((flat * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32)
                out[full, i] = np.minimum.reduceat(v, starts)
    return out


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each item, as int64."""
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(minima), bands)).copy()
        for r in range(rows):
            h = mix(h * _MULTIPLY + minima[:, r : bands * rows : rows].astype(np.uint64))
    return h.view(np.int64)


def binary_rows(m: np.ndarray) -> pa.Array:
    raw, step = np.ascontiguousarray(m).tobytes(), m.shape[1] * m.itemsize
    return pa.array([raw[i * step : (i + 1) * step] for i in range(len(m))], pa.binary())


def list_of(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))


def in_blocks(members: DataFrame, bucket: str, item: Column, block: int = BLOCK) -> DataFrame:
    """Members of buckets of two or more, dealt to block pairs.

    Adds ``bi``, ``bj`` and ``side``: rows with equal (bucket, bi, bj) meet in one task,
    where two rows of different sides, or any two if ``bi = bj``, are a pair to compare.
    Every pair of a bucket is in exactly one block pair.
    """
    sizes = members.groupBy(bucket).agg(F.count("*").alias("_n")).filter("_n > 1")
    n = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(item), F.col("_nb")).cast("int")
    dealt = members.join(sizes, bucket).withColumn("_nb", n).withColumn("_own", own)
    other = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return other.withColumns({"bi": F.least("_own", "_other"), "bj": F.greatest("_own", "_other"), "side": (F.col("_own") > F.col("_other")).cast("int")}).drop("_n", "_nb", "_own", "_other")


def groups(batches, keys: list[str], most: int = 8000, most_bytes: int = 64 << 20):
    """Arrow batches of rows sorted by ``keys`` as tables of whole groups, with each row's group number."""
    held, rows, size = [], 0, 0

    def cut(table, last):
        n = table.num_rows
        new = np.zeros(n, bool)
        new[:1] = True
        for k in keys:
            x = table.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        number = np.cumsum(new) - 1
        end = n if last else int(np.flatnonzero(new)[-1]) if n else 0
        return table.slice(0, end), number[:end], table.slice(end)

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= most or size >= most_bytes:
            whole, number, rest = cut(pa.concat_tables(held).combine_chunks(), False)
            held, rows, size = [rest], rest.num_rows, rest.nbytes
            if whole.num_rows:
                yield whole, number
    if rows:
        whole, number, _ = cut(pa.concat_tables(held).combine_chunks(), True)
        yield whole, number


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows is joined to by pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def pairs_at(number: np.ndarray, inner: np.ndarray, side: np.ndarray):
    """Pairs to compare inside groups of sorted rows, all of one distance at a time."""
    n, distance, at = len(number), 1, np.arange(len(number))
    while True:
        at = at[at + distance < n]
        at = at[number[at] == number[at + distance]]
        if not len(at):
            return
        keep = inner[at] | (side[at] != side[at + distance])
        if keep.any():
            yield at[keep], at[keep] + distance
        distance += 1


def similar_in_group(lists: list[np.ndarray], inner: bool, side: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Which rows have exact Jaccard similarity of num / den or more, as a boolean matrix (upper part)."""
    n = len(lists)
    size = np.fromiter(map(len, lists), np.int64, n)
    flat = np.concatenate(lists)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1 if len(flat) else np.zeros(0, bool)
    keep = shared[column] if len(flat) else np.zeros(0, bool)
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]] if keep.any() else column[:0]
    common = np.zeros((n, n), np.float32)
    width = max(1, min(4096, (8 << 20) // max(1, n)))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (start, start + width))
        m = np.zeros((n, width), np.float32)
        m[row[a:b], column[a:b] - start] = 1
        common += m @ m.T
    # |A and B| / |A or B| >= num / den  <=>  (num + den) * |A and B| >= num * (|A| + |B|)
    out = (num + den) * common.astype(np.int64) >= num * (size[:, None] + size[None, :])
    out &= (size[:, None] > 0) & np.triu(np.ones((n, n), bool), 1)
    return out if inner else out & (side[:, None] != side[None, :])


def similar_pairs(number: np.ndarray, sets: pa.ChunkedArray, x: np.ndarray, y: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (x, y) of rows, sorted by x, whose sets of distinct hashes have exact Jaccard similarity of num / den or more.

    Hashes that rows of a group share are numbered there, and the bits that two rows of a
    listed pair have in common are counted, ``STRIP`` bytes of rows or pairs at a time.
    """
    values = np.concatenate([c.flatten().to_numpy() for c in sets.chunks])
    ends = np.cumsum(np.concatenate([[0], *(np.diff(c.offsets.to_numpy()) for c in sets.chunks)]))
    size = np.diff(ends)
    low, high = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
    able = (low > 0) & (den * low >= num * high)
    x, y = x[able], y[able]
    near = np.zeros(len(x), bool)
    cut = np.flatnonzero(np.diff(number[x], prepend=-1)).tolist() + [len(x)]
    for i, j in zip(cut[:-1], cut[1:]):
        rows, at = np.unique(np.concatenate([x[i:j], y[i:j]]), return_inverse=True)
        a, b = at[: j - i], at[j - i :]
        row = np.repeat(np.arange(len(rows), dtype=np.int32), size[rows])
        _, column = np.unique(np.concatenate([values[ends[r] : ends[r + 1]] for r in rows.tolist()]), return_inverse=True)
        shared = np.bincount(column) > 1
        keep = shared[column]
        row, column = row[keep], (np.cumsum(shared, dtype=np.int32) - 1)[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column, common = row[order], column[order], np.zeros(j - i, np.int64)
        width = min(-(-int(shared.sum()) // 64) * 64, max(64, STRIP // len(rows) // 64 * 64))
        for start in range(0, int(shared.sum()), max(width, 1)):
            p, q = np.searchsorted(column, (start, start + width))
            bits = np.zeros((len(rows), width), np.uint8)
            bits[row[p:q], column[p:q] - start] = 1
            bits = np.packbits(bits, axis=1).view(np.uint64)
            most = max(1, STRIP // (width // 8))
            for k in range(0, j - i, most):
                common[k : k + most] += np.bitwise_count(bits[a[k : k + most]] & bits[b[k : k + most]]).sum(1, dtype=np.int64)
        near[i:j] = (num + den) * common >= num * (size[x[i:j]] + size[y[i:j]])
    return x[near], y[near]


def verify_blocks(dealt: DataFrame, keys: list[str], *, weight: str = "m") -> DataFrame:
    """``node, root, links`` from rows with ``keys``, ``bi, bj, side, node, sh`` (sorted distinct shingles) and a weight.

    ``links`` is the weight of the rows of the other block (or the own one) that are
    similar; ``root`` the smallest node joined within the task.
    """
    by = [*keys, "bi", "bj"]

    def run(batches):
        for whole, number in groups(batches, by):
            node, m, side = (whole.column(c).to_numpy() for c in ("node", weight, "side"))
            inner = whole.column("bi").to_numpy() == whole.column("bj").to_numpy()
            sh = whole.column("sh").combine_chunks()
            sh = sh.chunk(0) if isinstance(sh, pa.ChunkedArray) else sh
            ends, values = sh.offsets.to_numpy(), sh.values.to_numpy()
            root, links = node.copy(), np.zeros(len(node), np.int64)
            bounds = np.flatnonzero(np.diff(number, prepend=-1, append=number[-1] + 1 if len(number) else 0))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if b - a < 2:
                    continue
                near = similar_in_group([values[ends[i] : ends[i + 1]] for i in range(a, b)], bool(inner[a]), side[a:b])
                x, y = np.nonzero(near)
                if len(x):
                    np.add.at(links, a + x, m[a + y])
                    np.add.at(links, a + y, m[a + x])
                    order = np.argsort(node[a:b], kind="stable")
                    rank = np.empty(b - a, np.int64)
                    rank[order] = np.arange(b - a)
                    root[a:b] = node[a:b][order][forest(b - a, rank[x], rank[y])[rank]]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(links)], ["node", "root", "links"])

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = dealt.select(*by, "side", "node", weight, "sh").repartition(n, *by).sortWithinPartitions(*by)
    return ready.mapInArrow(run, "node long, root long, links long")


def components(spark: SparkSession, edges: DataFrame, label: str) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``node``, ``root``: any two joined nodes).

    Alternating stars: every node's neighbours are joined to the smallest of them, first
    the larger, then the smaller neighbours, until nothing changes; then each component is
    a star around its smallest node.  Nodes meet their minimum by a join on an aggregate,
    never as a gathered group.  Nodes with more than a ``HUBS``-th of all edges, so fewer
    than twice ``HUBS``, are broadcast with their minimum, so a star's edges stay where they
    are.  Every round is written to the shared folder.
    """
    e = edges.filter("node != root").select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v")).distinct()
    e, before = materialize(spark, e, label), None
    while True:
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(spark, both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c"), label)
        hubs, larger = F.broadcast(least.filter(F.col("c") * HUBS > state[0]).select("u", "m")), both.filter("v > u")
        met = larger.join(hubs, "u").unionByName(larger.join(hubs, "u", "left_anti").join(least.drop("c"), "u"))
        large = met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(small, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(spark, e, label)
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
