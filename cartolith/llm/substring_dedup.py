"""Substring dedup: MinHash banding of small paragraphs, exact Jaccard, components.

A passage that recurs inside other text has no line of its own, so texts are cut into
*paragraphs* at places that depend on nearby text only: after a phrase (up to a comma,
full stop or line feed) of ``LEAST`` words or more.  Shorter phrases go with the next one;
stretches beyond ``LONG`` words are also cut at ends of short phrases and at words, chosen
by their hash.

Where these cuts are too far apart or out of step, *seeds* find exact repeats: the ``SEED``
words from each place that has the least hash, over five words, of some ``WINDOW`` places in
a row.  Whatever stands around it, a repeat of ``WINDOW + SEED - 1`` words holds a whole
seed, the same one in both places, within ``WINDOW`` words of either end.  Seeds are compared
by digest only.

MinHash bands (``BANDS`` of ``ROWS``: a pair of similarity 0.8 is missed in 0.6 % of cases,
equal paragraphs never) deal distinct paragraphs to buckets; only keys that two different
paragraphs share are looked at again.  Paragraphs that collide are verified by the exact
Jaccard similarity of their five-word shingles, in blocks of bounded size, and joined to
components.  Every occurrence of a component but the first (by id, text hash, position) is
a removal.  A few bits of the words beside a paragraph tell whether the repeat it belongs to
can have ``PASSAGE`` words at all; most equal short phrases end there.  Occurrences in line
with the same kept text form runs, and a run is extended left and right over the words that
equal those around the first; repeats that overlap or touch merge into passages, of
``PASSAGE`` words at least.

Equal paragraphs are one row for each task before any shuffle.  What a join would drop is
mostly left out before it by bitmaps of fixed size (``with_mark``), so texts and paragraphs
that do not repeat stay where they are.

Edge cases: null and wordless texts have no paragraphs, and a paragraph of fewer than
``LEAST`` words (a short text, a short last phrase) counts as part of a repeat only by
extension; a null id sorts first and comes back as null; rows equal in id and text are one
document; further columns are kept by ``drop_passages``, whatever their names, and not used
otherwise; an empty table has no passages.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _similar as S
from ._common import broadcast_if_small, materialize, small_batches, table, unused, with_mark
from ._spans import PAD, equal_spans, joined
from ._spans import words as words_at
from .ngram_join import NO_ID

LEAST, LONG = 6, 60
WINDOW, SEED = 36, 15
PASSAGE = 15
#: Words on either side of a paragraph of which four bits are kept.
BESIDE = 8
#: Words on either side that a run is extended over; farther ones lie within or beside another seed.
REACH = WINDOW
BANDS, ROWS = 5, 2
#: Rows of 8 to 40 bytes that may be broadcast after a count.
KEYS = 400_000
#: Spans whose surroundings are looked up together.
SPANS = 16_384
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?")] = True


class Paragraphs:
    """Cuts texts into paragraphs, all texts of a batch at once; distinct words are hashed once a batch."""

    @staticmethod
    def marked(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, flat, whose lowest bit marks the end of a phrase, and the words of each text.

        A phrase ends with a word before a line feed, or whose last byte says so.
        """
        raw, bounds = joined(texts)
        raw = raw[:-PAD].replace(b"\0", b"\1") + raw[-PAD:]
        start, stop = words_at(raw, bounds)
        one, number = equal_spans(raw, start, stop - start)
        distinct = [raw[a:b] for a, b in zip(start[one].tolist(), stop[one].tolist())]
        known = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(one))
        data = np.frombuffer(raw, np.uint8)
        ends = _ENDS[data[stop - 1]]
        feed = np.flatnonzero(data == 10)
        before = np.searchsorted(stop, feed, "right") - 1
        feed, before = feed[before >= 0], before[before >= 0]
        ends[before[start[before] >= bounds[np.searchsorted(bounds, feed, "right") - 1]]] = True
        return known[number] & ~np.uint64(3) | ends, np.diff(np.searchsorted(start, bounds))

    def cut(self, texts: list[str | None]):
        """Word hashes, flat, and for each paragraph its text's number, first word in the text, place in the flat array and length; words of each text."""
        h, words = self.marked(texts)
        phrase = (h & np.uint64(1)) != 0
        h &= ~np.uint64(3)
        base, text_of = np.cumsum(words) - words, np.repeat(np.arange(len(words)), words)
        last = np.zeros(len(h), bool)
        last[(base + words)[words > 0] - 1] = True
        phrase |= last
        every = np.flatnonzero(phrase)
        own = last.copy()
        own[every[np.diff(every, prepend=-1) >= LEAST]] = True
        sizes = np.diff(np.flatnonzero(own), prepend=-1)
        if (sizes > LONG).any():  # cut at ends of short phrases, else at words
            far = np.repeat(sizes > LONG, sizes)
            inside = np.isin(text_of, text_of[far])
            at = np.flatnonzero(inside & (far | own))
            at = at[own[at] | phrase[at] | (mix_low(h[at]) == 0)]
            rank = S.mix(h[at]) >> np.uint64(1) | np.where(phrase[at], np.uint64(1), np.uint64(1 << 63))
            rank[own[at]] = 0
            own[inside] = False
            own[at[_apart(at + LEAST * text_of[at], rank)]] = True
        stop = np.flatnonzero(own) + 1
        start = np.concatenate([[0], stop[:-1]])[: len(stop)]
        keep = stop - start >= LEAST
        start, stop = start[keep], stop[keep]
        text = text_of[start]
        return h, text, start - base[text], start, stop - start, words


def _apart(ends: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which ends have the least rank among those closer than ``LEAST`` words (of equal ranks the last)."""
    keep = np.ones(len(ends), bool)
    for k in range(1, min(LEAST, len(ends))):
        near = ends[k:] - ends[:-k] < LEAST
        if not near.any():
            break
        before = rank[:-k] < rank[k:]
        keep[k:] &= ~(near & before)
        keep[:-k] &= ~near | before
    return keep


def seeds(rolled: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and place in the flat array of each seed, from hashes of five words at each place and the words of each text."""
    none = np.zeros(0, np.int64)
    if len(rolled) < WINDOW:
        return none, none
    least = S.mix(rolled) & ~np.uint64(0xFFFFFFFF) | np.arange(len(rolled), dtype=np.uint64)
    width = 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    text_of = np.repeat(np.arange(len(words)), words)[: len(rolled)]
    whole = text_of[: len(least)] == text_of[WINDOW - 1 :]
    place = np.unique((least[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64))
    text = text_of[place]
    keep = place + SEED <= np.cumsum(words)[text]
    return text[keep], place[keep]


def beside(flat: np.ndarray, words: np.ndarray, text: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Four bits of each of the ``BESIDE`` words before a paragraph, the nearest first, and of those after it; 0 where the text ends."""
    ends = np.cumsum(words)
    low, high = (ends - words)[text], ends[text]
    out = np.zeros(len(place), np.uint64)
    for k in range(2 * BESIDE):
        at = place - 1 - k if k < BESIDE else place + length + k - BESIDE
        there = (at >= low) & (at < high)
        bits = S.mix(flat[np.where(there, at, 0)]) >> np.uint64(60)
        out = out << np.uint64(4) | np.where(there, bits, np.uint64(0))
    return out.view(np.int64)


def mix_low(h: np.ndarray) -> np.ndarray:
    return S.mix(h) & np.uint64(15)


def _spread(place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices place[i] ... place[i] + length[i] - 1 of all i in turn."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(place - ends + length, length)


def digests(flat: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each paragraph's words in order."""
    if not len(place):
        return np.zeros(0, np.int64)
    at = _spread(place, length)
    within = (at - np.repeat(place, length)).astype(np.uint64)
    with np.errstate(over="ignore"):
        v = S.mix(flat[at] + S.mix(within + np.uint64(1)))
        return S.mix(np.add.reduceat(v, np.cumsum(length) - length) + length.astype(np.uint64)).view(np.int64)


def _batches(batches, width: int = 2 << 20):
    """Slices of Arrow batches with about ``width`` characters of text (the last column)."""
    from ._chunks import slices

    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        for a, b in slices(texts, width):
            yield batch.slice(a, b - a), texts[a:b]


def _paragraphs(docs: DataFrame) -> DataFrame:
    """``h, id, th, start, n, ctx, keys`` of every paragraph and seed: digest, document, first word, length, words beside it and band keys (seeds have none)."""
    names = ["h", "id", "th", "start", "n", "ctx", "keys"]

    def run(batches):
        cutter = Paragraphs()
        for batch, texts in _batches(batches):
            flat, text, first, place, length, words = cutter.cut(texts)
            with np.errstate(over="ignore"):
                rolled = np.zeros(max(0, len(flat) - S.SHINGLE + 1), np.uint64)
                for k in range(S.SHINGLE):
                    rolled = S.mix(rolled * S._MULTIPLY + flat[k : k + len(rolled)] + np.uint64(k + 1))
            sets = length - S.SHINGLE + 1
            ends = np.concatenate([[0], np.cumsum(sets)])
            keys = S.band_keys(S.minhash(rolled[_spread(place, sets)], ends, BANDS * ROWS), BANDS, ROWS)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests(flat, place, length)), batch.column("id").take(at), batch.column("th").take(at), pa.array(first.astype(np.int32)), pa.array(length.astype(np.int32)),
                 pa.array(beside(flat, words, text, place, length)), S.list_of(keys.reshape(-1), np.arange(len(length) + 1) * BANDS)],
                names,
            )
            text, place = seeds(rolled, words)
            at, length = pa.array(text), np.full(len(text), SEED)
            first = place - (np.cumsum(words) - words)[text]
            # Another digest than a paragraph of the same words has.
            yield pa.RecordBatch.from_arrays(
                [pa.array(~digests(flat, place, length)), batch.column("id").take(at), batch.column("th").take(at), pa.array(first.astype(np.int32)), pa.array(length.astype(np.int32)),
                 pa.array(np.zeros(len(text), np.int64)), S.list_of(np.zeros(0, np.int64), np.zeros(len(text) + 1, np.int64))],
                names,
            )

    return docs.select("id", "th", "text").mapInArrow(run, "h long, id long, th long, start int, n int, ctx long, keys array<long>")


def _shingles_of(rows: DataFrame) -> DataFrame:
    """``h, sh`` from rows ``wanted`` (digests) and ``text``: the shingle sets of the wanted paragraphs."""

    def run(batches):
        cutter = Paragraphs()
        for batch, texts in _batches(batches):
            flat, text, _, place, length, _ = cutter.cut(texts)
            h = digests(flat, place, length)
            wanted = [set(w) for w in batch.column("wanted").to_pylist()]
            keep = np.array([x in wanted[i] for x, i in zip(h.tolist(), text.tolist())], bool)
            place, length, h = place[keep], length[keep], h[keep]
            words = flat[_spread(place, length)]
            sh, ends = S.shingles(words, np.concatenate([[0], np.cumsum(length)]))
            yield pa.RecordBatch.from_arrays([pa.array(h), S.list_of(sh, ends)], ["h", "sh"])

    return rows.select("wanted", "text").mapInArrow(run, "h long, sh array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("th"), "text")


def repeated_paragraphs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``h, id, th, start, n, ctx, root, first`` of every paragraph and seed in a component of two occurrences or more; ``first`` is the kept one."""
    small_batches(spark)
    docs = _keyed(docs)
    places = materialize(spark, _paragraphs(docs), "passage-places")
    # Keys that two different paragraphs share, and the paragraphs that have one.
    rows = places.select(F.explode("keys").alias("key"), "h")
    shared = rows.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a < b").select("key")
    shared = materialize(spark, shared, "passage-keys")
    rows = with_mark(rows, shared, ["key"]).filter("_mark").select("key", "h").distinct()
    members = materialize(spark, rows.join(broadcast_if_small(shared, KEYS), "key"), "passage-members")
    # Occurrences of paragraphs that are equal or may be similar to another one.
    twice = places.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h", F.lit(False).alias("near"))
    wanted = materialize(spark, twice.unionByName(members.select("h", F.lit(True).alias("near"))).groupBy("h").agg(F.max("near").alias("near")), "passage-wanted")
    places = with_mark(places.drop("keys"), wanted, ["h"]).filter("_mark").drop("_mark")
    places = materialize(spark, places.join(broadcast_if_small(wanted, KEYS), "h"), "passage-some")
    counted = places.groupBy("h", "near").agg(F.count("*").alias("c"), F.min(F.struct("id", "th", "start", "n", "h", "ctx")).alias("at"))
    counted = materialize(spark, counted, "passage-counted")
    # Shingle sets of those that may be similar, from one text of each.
    texts = materialize(spark, counted.filter("near").groupBy("at.id", "at.th").agg(F.collect_list("h").alias("wanted")), "passage-texts")
    texts = with_mark(docs, texts, ["id", "th"]).filter("_mark").drop("_mark").join(texts, ["id", "th"]).dropDuplicates(["id", "th"])
    sets = materialize(spark, _shingles_of(texts).dropDuplicates(["h"]), "passage-sets")
    dealt = S.in_blocks(members, "key", F.col("h")).join(sets.withColumn("m", F.lit(1).cast("long")), "h").withColumnRenamed("h", "node")
    edges = materialize(spark, S.verify_blocks(dealt, ["key"]).select("node", "root").filter("node != root").distinct(), "passage-edges")
    roots = S.components(spark, edges, "passage-classes")
    classes = counted.join(roots.withColumnRenamed("node", "h"), "h", "left").select("h", "c", "at", F.coalesce("root", "h").alias("root"))
    classes = materialize(spark, classes, "passage-roots")
    whole = classes.groupBy("root").agg(F.sum("c").alias("c"), F.min("at").alias("first")).filter("c > 1").drop("c")
    classes = materialize(spark, classes.join(whole, "root").select("h", "root", "first"), "passage-first")
    return places.join(broadcast_if_small(classes, KEYS // 4), "h").select("h", "id", "th", "start", "n", "ctx", "root", "first")


def _long_enough() -> Column:
    """Whether an occurrence may belong to a repeat of ``PASSAGE`` words, by the words beside it and its source."""
    differ = F.lpad(F.hex(F.col("ctx").bitwiseXOR(F.col("src.ctx"))), 4 * BESIDE // 2, "0")
    equal = [F.lit(BESIDE) - F.length(F.ltrim(F.substring(differ, i, BESIDE), F.lit("0"))) for i in (1, BESIDE + 1)]
    return (F.col("n") >= PASSAGE) | (F.col("h") != F.col("src.h")) | (F.greatest(*equal) == BESIDE) | (F.col("n") + equal[0] + equal[1] >= PASSAGE)


def _surroundings(spans: DataFrame, reach: int) -> DataFrame:
    """``id, th, a, b, left, right`` from rows ``id, th, spans, text``: hashes of ``reach`` words on both sides of the words a ... b - 1.

    Four bytes a word, the nearest first; zero where the text ends.
    """

    def run(batches):
        names = ["id", "th", "a", "b", "left", "right"]
        for batch, texts in _batches(batches):
            h, words = Paragraphs.marked(texts)
            # Each text has ``reach`` zeros on both sides, shared with its neighbours.
            first = np.cumsum(words) - words + reach * np.arange(1, len(words) + 1)
            near = np.zeros(len(h) + reach * (len(words) + 1), np.uint32)
            near[_spread(first, words)] = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            spans = batch.column("spans")
            rows, ends = np.repeat(np.arange(len(texts)), spans.value_lengths().to_numpy()), spans.flatten()
            for i in range(0, len(rows), SPANS):
                row, some = rows[i : i + SPANS], ends.slice(i, SPANS)
                a, b = (x.cast(pa.int64()) for x in some.flatten())
                left = near[(first[row] + a.to_numpy())[:, None] - 1 - np.arange(reach)]
                right = near[(first[row] + b.to_numpy())[:, None] + np.arange(reach)]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("th").take(at), a, b, S.binary_rows(left), S.binary_rows(right)], names)

    return spans.select("id", "th", "spans", "text").mapInArrow(run, "id long, th long, a long, b long, left binary, right binary")


def _extended(runs: DataFrame, reach: int) -> DataFrame:
    """``runs`` with ``l`` and ``r``, the equal words before and after both places, for ``left, right, fleft, fright``."""
    names = [c for c in runs.columns if c not in ("left", "right", "fleft", "fright")]

    def run(batches):
        for batch in batches:
            equal = []
            for x, y in (("left", "fleft"), ("right", "fright")):
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, reach) for c in (x, y))
                equal.append(np.logical_and.accumulate((x == y) & (x != 0), axis=1).sum(1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, *map(pa.array, equal)], [*names, "l", "r"])

    return runs.mapInArrow(run, runs.select(*names, F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("r")).schema)


def _measured(spark: SparkSession, docs: DataFrame, runs: DataFrame, reach: int) -> DataFrame:
    """``runs`` with ``l`` and ``r``, up to ``reach``."""
    spans = runs.select("id", "th", "a", "b").unionByName(runs.select(F.col("fid").alias("id"), F.col("fth").alias("th"), F.col("fa").alias("a"), F.col("fb").alias("b"))).distinct()
    spans = materialize(spark, spans.groupBy("id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "passage-spans")
    texts = with_mark(_keyed(docs), spans, ["id", "th"]).filter("_mark").drop("_mark").join(spans, ["id", "th"]).dropDuplicates(["id", "th"])
    around = materialize(spark, _surroundings(texts, reach), "passage-around")
    first = around.withColumnsRenamed({"id": "fid", "th": "fth", "a": "fa", "b": "fb", "left": "fleft", "right": "fright"})
    return _extended(runs.join(around, ["id", "th", "a", "b"]).join(first, ["fid", "fth", "fa", "fb"]), reach)


def repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``id, th, a, b, root, keep, fid, fth, fa, fb``: words a ... b - 1 repeat words fa ... fb - 1 of text fid.

    An occurrence is held against the one before it in its own text, else against the kept
    one (of document ``keep``), so a text that says the same thing over and over is one run.
    Paragraphs and seeds in line with the same text are one run, which is extended over
    equal words.  Beyond ``REACH`` of them another seed begins, which is a run itself or
    belongs to one.  Within one text the first paragraph or seed of the earlier place stays.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = repeated_paragraphs(spark, docs).repartition(n, "id", "th")  # serves both windows and the grouping
    earlier = Window.partitionBy("id", "th", "root").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("before", F.max(F.struct("start", "n", "h", "ctx")).over(earlier))
    found = found.filter(F.col("before").isNotNull() | (F.struct("id", "th", "start") != F.struct("first.id", "first.th", "first.start")))
    own = F.struct("id", "th", "before.start", "before.n", "before.h", "before.ctx")
    found = found.withColumn("src", F.when(F.col("before").isNotNull(), own).otherwise(F.col("first"))).filter(_long_enough())
    at = lambda x: F.expr(x).cast("long").alias
    found = found.select("id", "th", at("start")("a"), at("start + n")("b"), "root", F.col("first.id").alias("keep"), F.col("src.id").alias("fid"), F.col("src.th").alias("fth"), at("src.start")("fa"), at("src.start + src.n")("fb"))
    line = ["id", "th", "fid", "fth", F.col("a") - F.col("fa"), F.when(F.col("b") - F.col("a") != F.col("fb") - F.col("fa"), F.col("a"))]
    over = Window.partitionBy(*line).orderBy("a", "b")
    end = F.max("b").over(over.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumns({"line": F.struct(line[4].alias("x"), line[5].alias("y")), "new": F.coalesce(F.col("a") > end, F.lit(True)).cast("int")})
    of_first = lambda c: F.min_by(c, F.struct("a", "b", "root")).alias
    runs = marked.withColumn("k", F.sum("new").over(over)).groupBy("id", "th", "fid", "fth", "line", "k").agg(
        F.min("a").alias("a"), F.max("b").alias("b"), F.min("fa").alias("fa"), F.max("fb").alias("fb"), of_first("root")("root"), of_first("keep")("keep"), of_first(F.col("fb") - F.col("fa"))("stays")
    )
    runs = materialize(spark, runs.drop("line", "k"), "passage-runs")
    out = _measured(spark, docs, runs, REACH).withColumns({"b": F.col("b") + F.col("r"), "fb": F.col("fb") + F.col("r"), "fa": F.col("fa") - F.col("l")})
    inside = (F.col("id") == F.col("fid")) & (F.col("th") == F.col("fth"))
    out = out.withColumn("a", F.greatest(F.col("a") - F.col("l"), F.when(inside, F.col("fa") + F.col("l") + F.col("stays"))))
    out = out.withColumn("fb", F.when(inside, F.least("fb", "a")).otherwise(F.col("fb")))
    return out.filter("a < b").select("id", "th", "a", "b", "root", "keep", "fid", "fth", "fa", "fb")


def _united(rows: list[tuple]) -> list[list]:
    """Overlapping or adjacent ``(a, b, root, keep)`` of sorted rows as one, named after the first."""
    out = []
    for a, b, root, keep in rows:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, root, keep])
    return out


def _pieces(rows: list[tuple]) -> list[tuple]:
    """``(a, b, removed, root, keep)`` of one text from ``(a, b, removed, root, keep)``: removed words, and kept ones that are not removed."""
    first = lambda row: (row[0], row[3], row[2], row[1])
    gone = _united(sorted(((a, b, r, k) for a, b, x, r, k in rows if x), key=first))
    out, i = [(a, b, True, r, k) for a, b, r, k in gone], 0
    for a, b, root, keep in _united(sorted(((a, b, r, k) for a, b, x, r, k in rows if not x), key=first)):
        while i < len(gone) and gone[i][1] <= a:
            i += 1
        j = i
        while a < b:
            end = min(b, gone[j][0]) if j < len(gone) else b
            if a < end:
                out.append((a, end, False, root, keep))
            if j == len(gone):
                break
            a, j = max(a, gone[j][1]), j + 1
    out.sort()
    keep, start = [], 0
    for i in range(1, len(out) + 1):  # pieces that touch count as one passage
        if i == len(out) or out[i][0] != out[i - 1][1]:
            if out[i - 1][1] - out[start][0] >= PASSAGE:
                keep += out[start:i]
            start = i
    return keep


def passages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Repeated passages: ``id, th, start, n_words, removed, class_id, keep_id`` (words counted from 0).

    Repeats of a document that overlap or touch merge while both are kept or both removed;
    words that are both are removed.  Class and kept document are those of the passage's
    first repeat; of several that start there, the smallest id is named.
    """
    found = repeats(spark, docs)
    gone = found.select("id", "th", "a", "b", F.lit(True).alias("removed"), "root", "keep")
    kept = found.select(F.col("fid").alias("id"), F.col("fth").alias("th"), F.col("fa").alias("a"), F.col("fb").alias("b"), F.lit(False).alias("removed"), "root", "keep")
    spans = gone.unionByName(kept).groupBy("id", "th", "a", "b", "removed").agg(F.min(F.struct("keep", "root")).alias("of")).select("id", "th", "a", "b", "removed", "of.root", "of.keep")

    def run(batches):
        for whole, number in S.groups(batches, ["id", "th"]):
            rows = list(zip(*(whole.column(c).to_pylist() for c in ("a", "b", "removed", "root", "keep"))))
            starts = np.flatnonzero(np.diff(number, prepend=-1, append=number[-1] + 1)).tolist() if len(rows) else [0]
            at, out = [], []
            for i, j in zip(starts[:-1], starts[1:]):
                pieces = _pieces(rows[i:j])
                at += [i] * len(pieces)
                out += [(a, b - a, x, r, k) for a, b, x, r, k in pieces]
            at = pa.array(at, pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))]
            table = pa.Table.from_arrays([whole.column("id").take(at), whole.column("th").take(at), *columns], ["id", "th", "start", "n_words", "removed", "class_id", "keep_id"])
            yield from table.combine_chunks().to_batches()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ready = spans.repartition(n, "id", "th").sortWithinPartitions("id", "th")
    return ready.mapInArrow(run, "id long, th long, start long, n_words long, removed boolean, class_id long, keep_id long")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def drop_passages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with the words of removed passages cut from ``text``, and ``n_removed_words``."""
    gone = passages(spark, docs).filter("removed").groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "n_words"))).alias("gone"))
    gone = materialize(spark, gone, "passage-gone")
    out = [c for c in docs.columns if c != "n_removed_words"]
    id_, th, spans_, mark = (unused(c, docs.columns) for c in ("id", "th", "gone", "mark"))
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), th: F.xxhash64("text")})
    keyed = with_mark(keyed, gone.withColumnsRenamed({"id": id_, "th": th}), [id_, th], mark)
    joined = keyed.filter(F.col(mark)).join(gone.withColumnsRenamed({"id": id_, "th": th, "gone": spans_}), [id_, th], "left")

    def run(batches):
        for batch in batches:
            texts, counts = [], []
            for t, spans in zip(batch.column("text").to_pylist(), batch.column(spans_).to_pylist()):
                if spans:
                    at, parts, last = [m.span() for m in _WORD.finditer(t)], [], 0
                    for s in spans:
                        parts.append(t[last : at[s["start"]][0]])
                        last = at[s["start"] + s["n_words"] - 1][1]
                    t = "".join([*parts, t[last:]])
                texts.append(t)
                counts.append(sum(s["n_words"] for s in spans or []))
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in out]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*out, "n_removed_words"])

    names = [F.col(f"`{c}`") for c in out]
    still = keyed.filter(~F.col(mark)).select(*names, F.lit(0).cast("long").alias("n_removed_words"))
    return still.unionByName(joined.select(*names, spans_).mapInArrow(run, still.schema))


def op7_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages(spark, table(spark, sf_dir, "documents"))
    own = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(own("id").alias("doc_id"), F.col("start").alias("start_word"), "n_words", "removed", "class_id", own("keep_id").alias("keep_doc_id"))
