"""Benchmark decontamination by Wu-Manber search for many strings of words.

A window is 13 consecutive words of a benchmark item (all of a shorter item).  Windows of
one length share a shift table over blocks of ``BLOCK`` words: the block that ends at the
current position says how many words can be skipped without missing a window; at shift 0
the bucket of the block (the windows' suffix) is compared directly.  Documents are scanned
where they lie: no shuffle, and only the windows travel, broadcast in blocks of bounded
size.  Items beyond one block are searched by further passes over the rows that the pass
before has written; their hits add up exactly.  A pass takes some 100 bytes a word of its items.

Words: A-Z are lower-cased, then runs of characters above U+007F, digits and letters
(``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``).  Edge cases: a null or wordless document has no
hits; null or wordless items have no window; words inside windows of an item without id are
hit, but the item is not listed; equal items (or ids) each count by id once;
repeated rows each give a row; an empty benchmark finds nothing; a very long text is searched
whole, with some 40 bytes a word held meanwhile; ``drop_contaminated`` returns its input's columns,
in which ones called ``n_words``, ``hit_words`` or ``hit_items`` keep their values.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, small_batches, table
from ._similar import mix

WINDOW = 13
BLOCK = 3
#: Bytes of item text whose windows are broadcast together.
PASS_BYTES = 8 << 20

#: Words whose hashes a task keeps between texts.
KNOWN = 500_000
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of_text(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEEP).split()


def _mixed(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` consecutive word hashes."""
    n = len(words) - length + 1
    out = np.zeros(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length if n > 0 else 0):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return out


def word_hashes(words: list[bytes], known: dict) -> np.ndarray:
    for w in set(words).difference(known):
        known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class WuManber:
    """Windows of one length over the words of a pass: packed arrays, some 100 bytes a word.

    ``blocks`` and ``shift`` are the shift table, sorted by the hash of a block; ``suffix`` and
    ``first`` the windows, sorted by the hash of their last block and of the whole window.
    """

    def __init__(self, words: list[bytes], hashes: np.ndarray, starts: np.ndarray, owner: np.ndarray, first: np.ndarray, length: int):
        """``starts`` of the windows, with the number of the item of each (``owner``) and that item's ``first`` word."""
        self.length, self.block, self.words = length, min(BLOCK, length), words
        block = _mixed(hashes, self.block)
        # Windows start at every word, so a block ends some window unless it is among the first of its item.
        late = length - self.block
        begins = starts[starts == first]
        ends = np.concatenate([starts + late, *(begins + k for k in range(late))])
        shift = np.concatenate([np.zeros(len(starts), np.uint8), *(np.full(len(begins), late - k, np.uint8) for k in range(late))])
        found = block[ends]
        order = np.lexsort((shift, found))
        found, shift = found[order], shift[order]
        least = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        self.blocks, self.shift = found[least], shift[least]
        suffix, whole = block[starts + length - self.block], _mixed(hashes, length)[starts]
        order = np.lexsort((owner, whole, suffix))
        self.suffix, self.whole, self.first, self.owner = suffix[order], whole[order], starts[order], owner[order]

    def scan(self, words: list[bytes], hashes: np.ndarray, hit: np.ndarray, items: set) -> None:
        """Mark words inside occurrences in ``hit`` and add the owners of the windows that occur."""
        m, b, n = self.length, self.block, len(words)
        if n < m:
            return
        block = _mixed(hashes, b)
        at = np.minimum(np.searchsorted(self.blocks, block), len(self.blocks) - 1)
        shift = np.where(self.blocks[at] == block, self.shift[at], m - b + 1).tolist()
        end = m
        while end <= n:
            if skip := shift[end - b]:
                end += skip
                continue
            low, high = np.searchsorted(self.suffix, block[end - b], "left"), np.searchsorted(self.suffix, block[end - b], "right")
            window, confirmed = words[end - m : end], None
            for k in range(low, high):
                if confirmed is not None and self.whole[k] == confirmed[0] and self.owner[k] in confirmed[1]:
                    continue
                start = self.first[k]
                if self.words[start : start + m] == window:
                    hit[end - m : end] = True
                    items.add(int(self.owner[k]))
                    confirmed = (self.whole[k], {*(confirmed[1] if confirmed else ()), self.owner[k]})
            end += 1


def search_tables(items: list[tuple], length: int = WINDOW) -> tuple[list[WuManber], list]:
    """A table for each window length that occurs (``length``, and less for shorter items), and the items by number."""
    words, owner, starts, first, names = [], {}, {}, {}, []
    pool: dict[bytes, bytes] = {}
    for item, text in items:
        own = [pool.setdefault(w, w) for w in words_of_text(text)]
        m = min(length, len(own))
        if m:
            starts.setdefault(m, []).append(np.arange(len(words), len(words) + len(own) - m + 1))
            owner.setdefault(m, []).append(np.full(len(own) - m + 1, len(names)))
            first.setdefault(m, []).append(np.full(len(own) - m + 1, len(words)))
            names.append(item)
            words += own
    hashes = word_hashes(words, {})
    return [WuManber(words, hashes, *(np.concatenate(x[m]) for x in (starts, owner, first)), m) for m in sorted(starts)], names


def _passes(benchmark: DataFrame, item: str, text: str):
    """Items in blocks of bounded size, at least one; the driver holds one block at a time."""
    block, held, any_ = [], 0, False
    for row in benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).filter("t <> ''").toLocalIterator():
        block.append((None if row.i is None else int(row.i), row.t))
        held += len(row.t)
        if held >= PASS_BYTES:
            yield block
            block, held, any_ = [], 0, True
    if block or not any_:
        yield block


_TABLES: dict = {}


def mark_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", length: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_words`` (positions, ascending) and ``hit_items`` (ids, sorted as strings).

    Columns of ``docs`` with these names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    new = ["n_words", "hit_words", "hit_items"]
    kept = docs.drop(*new)
    schema = kept.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hit_words"), F.array().cast("array<long>").alias("hit_items")).schema
    names, out, sent = kept.columns, None, None
    for block in _passes(benchmark, item, item_text):
        key, shared, first = hashlib.md5(repr((block, length)).encode()).hexdigest(), spark.sparkContext.broadcast(block), out is None

        def run(batches, key=key, shared=shared, first=first):
            if key not in _TABLES:
                _TABLES.clear()
                _TABLES[key] = search_tables(shared.value, length)
            (tables, owners), known = _TABLES[key], {}
            for batch in batches:
                counts, hits, found = [], [], []
                before = [([], [])] * batch.num_rows if first else list(zip(batch.column("hit_words").to_pylist(), batch.column("hit_items").to_pylist()))
                for t, (old_hits, old_items) in zip(batch.column(text).to_pylist(), before):
                    words = words_of_text(t)
                    hit, numbers = np.zeros(len(words), bool), set()
                    hit[old_hits] = True
                    if len(known) > KNOWN:
                        known.clear()
                    hashes = word_hashes(words, known)
                    for table_ in tables:
                        table_.scan(words, hashes, hit, numbers)
                    items = {*old_items, *(owners[i] for i in numbers)}
                    counts.append(len(words))
                    hits.append(np.flatnonzero(hit).tolist())
                    found.append(sorted(items - {None}, key=str))
                columns = batch.columns if first else batch.select(names).columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))], [*names, *new])

        # A pass reads what the one before has written, so that one worker and one set of tables live at a time.
        before = kept if out is None else materialize(spark, out, "contamination")
        if sent is not None:
            sent.destroy()
        out, sent = before.mapInArrow(run, schema), shared
    return out


def contamination(marked: DataFrame) -> DataFrame:
    """Per row of ``mark_contamination``: the digest columns and the verdict."""
    n_hit = F.size("hit_words").cast("long")
    return marked.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.transform("hit_items", lambda x: x.cast("string")), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without rows of which a twentieth of the words or more are benchmark windows."""
    n_hit = F.size("hit_words")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return mark_contamination(rows, benchmark).filter(~((n_hit > 0) & (20 * n_hit >= F.col("n_words")))).select("_row.*")


def op10_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(mark_contamination(docs, table(spark, sf_dir, "benchmark")))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS x
            FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM windows),
found AS (SELECT p.doc_id, p.i, p.m, v.item_id FROM
            (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS x
             FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, lengths WHERE len(w) >= m)) p
          JOIN windows v ON p.m = v.m AND p.x = v.x),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS j FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
