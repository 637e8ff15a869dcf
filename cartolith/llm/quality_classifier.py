"""Quality scores: random-indexing word vectors, a two-layer network, calibrated probabilities.

1. Every word falls into one of ``BUCKETS`` buckets and has a sparse random index vector.
   Over the whole corpus, a bucket's context vector sums the index vectors of the words up
   to two places before and after it.  A task adds up its own rows; the partial vectors are
   summed by bucket.  The result has a fixed size, so it may be broadcast.
2. A document's vector pools the normed context vectors of its words, of word shapes and of
   a few markers of its form (lengths, repetition), which are words of their own.
3. A two-layer numpy network is fitted on a bounded sample of labelled ids (at most about
   ``SAMPLE``, chosen by a hash of the id; of repeated rows of an id one counts); a
   temperature fitted on rows set aside, against smoothed targets, calibrates its
   probabilities: on separable rows it stops at what their number supports.
4. All documents are scored from their vectors.  Sums run in a fixed order of inputs, so the
   bits of a score depend on its text and the model alone, not on rows beside it.

Context vectors are of fixed memory, so words share buckets: of V words each meets about
V / ``BUCKETS`` others, a hundred at a million words; a bucket's vector then is mostly that of
its frequent words.  Quality labels follow from form and frequent words, which this keeps.

Labels only come from rows whose crc32(doc_id) mod 5 is not 0.  Scores depend on the text
alone.  Edge cases: null and empty texts have only form markers and get a score as well; a
null ``doc_id`` is never learnt from and counts as held out; conflicting labels of one id
are ignored; without labels of both classes every score is the share of good labels, or
0.5; repeated rows each give a row, with equal scores for equal texts; an empty table gives no
rows; a very long text is pooled like any other, its words one batch at a time; further
columns are dropped.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, small_batches, table

BUCKETS, DIMENSIONS, NONZERO, REACH = 1 << 13, 48, 4, 2
#: Labelled rows that the network is fitted on, at most about.
SAMPLE = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 3e-3, 1e-4
CUT = 0.3
#: Words kept between texts, none of them over ``LONG`` bytes.
_CACHE, LONG = 400_000, 256


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of each bucket's nonzero entries."""
    rng = np.random.default_rng(seed)
    place = np.stack([rng.permutation(DIMENSIONS)[:NONZERO] for _ in range(BUCKETS)]).astype(np.int64)
    return place, rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def _shape(word: bytes) -> bytes:
    """Kinds of characters in a word, runs shortened: capitals, other letters, digits, the rest as they are."""
    out = []
    for b in word:
        c = 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b
        if not out or out[-1] != c:
            out.append(c)
    return b"\0" + bytes(out)


def _bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


class Words:
    """Buckets of words and of their shapes, kept for words seen before."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int]] = {}

    def buckets(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").encode().split()
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = _bucket(w) << 16 | _bucket(_shape(w))
        both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        for w in {w for w in words if len(w) > LONG}:
            del known[w]
        return both >> 16, both & 0xFFFF


def form_markers(text: str | None, words: np.ndarray) -> list[int]:
    """Buckets of markers for the length of a text and how far it repeats itself."""
    text = text or ""
    lines = [x for x in text.split("\n") if x.strip()]
    n = len(words)
    level = lambda x: min(9, int(10 * x))
    triples = words[:-2] * BUCKETS * BUCKETS + words[1:-1] * BUCKETS + words[2:] if n > 2 else words[:0]
    facts = {
        "words": n.bit_length(),
        "distinct": level(len(np.unique(words)) / n) if n else -1,
        "triples": level(len(np.unique(triples)) / len(triples)) if len(triples) else -1,
        "lines": level(len(set(lines)) / len(lines)) if lines else -1,
        "length": min(20, int(len(text) / n)) if n else -1,
        "in line": (n // max(1, len(lines))).bit_length(),
    }
    return [_bucket(f"\1{k}={v}".encode()) for k, v in facts.items()]


def context_vectors(docs: DataFrame, text: str = "text") -> DataFrame:
    """``bucket, vector`` (sums over all rows of ``docs``); a task's rows are added up before the shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        place, sign = index_vectors()
        total, words, held = np.zeros(BUCKETS * DIMENSIONS), Words(), []

        def add(lists):
            # Two gaps between documents keep their words apart.
            flat = np.concatenate([x for w in lists for x in (w, gap)])
            for d in range(1, REACH + 1):
                a, b = flat[:-d], flat[d:]
                both = (a >= 0) & (b >= 0)
                a, b = a[both], b[both]
                for x, y in ((a, b), (b, a)):
                    at, by = x * DIMENSIONS, place[y]
                    for k in range(NONZERO):
                        total[:] += np.bincount(at + by[:, k], sign[y, k], BUCKETS * DIMENSIONS)

        gap, size = np.full(REACH, -1, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                word, shape = words.buckets(t)
                marks = np.array(form_markers(t, word), np.int64)
                held += [word, shape, marks]
                size += len(word)
                if size > 1 << 20:
                    add(held)
                    held, size = [], 0
        if held:
            add(held)
        total_ = total.reshape(BUCKETS, DIMENSIONS)
        near = np.flatnonzero(total_.any(1))
        ends = np.arange(len(near) + 1, dtype=np.int32) * DIMENSIONS
        yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(total_[near].reshape(-1)))], ["bucket", "vector"])

    partial = docs.select(text).mapInArrow(run, "bucket int, vector array<double>")
    sums = [F.sum(F.col("vector")[i]).alias(f"v{i}") for i in range(DIMENSIONS)]
    return partial.groupBy("bucket").agg(*sums).select("bucket", F.array(*[f"v{i}" for i in range(DIMENSIONS)]).alias("vector"))


def _normed(rows) -> np.ndarray:
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    for r in rows:
        v = np.array(r["vector"])
        out[r["bucket"]] = v / max(1e-9, np.linalg.norm(v))
    return out


def document_vectors(docs: DataFrame, contexts: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with ``vector``: pooled words, shapes and form markers."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(contexts)
    names = [c for c in docs.columns if c not in (text, "vector")]
    schema = docs.select(*names, F.array().cast("array<float>").alias("vector")).schema

    def run(batches):
        c, words = shared.value, Words()
        place, sign = index_vectors()
        index = np.zeros((BUCKETS, DIMENSIONS), np.float32)
        np.put_along_axis(index, place, sign.astype(np.float32), 1)

        def pool(x, m):
            if not len(x):
                return np.zeros(DIMENSIONS, np.float32)
            at, n = np.unique(x, return_counts=True)
            return (n.astype(np.float32) / len(x)) @ m[at]

        for batch in batches:
            rows = []
            for t in batch.column(text).to_pylist():
                word, shape = words.buckets(t)
                marks = np.array(form_markers(t, word), np.int64)
                rows.append(np.concatenate([pool(word, c), pool(shape, c), pool(shape, index), pool(marks, c), pool(marks, index)]))
            width = 5 * DIMENSIONS
            flat = np.concatenate(rows).astype(np.float32) if rows else np.zeros(0, np.float32)
            vector = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, vector], [*names, "vector"])

    return docs.select(*names, text).mapInArrow(run, schema)


class Network:
    """input -> tanh layer -> probability, with inputs standardised and logits divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = x.mean(0), x.std(0) + 1e-3, 1.0
        x = self._in(x)
        held = rng.random(len(x)) < 0.2
        w = {"a": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1)}
        first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
        xs, ys = x[~held], y[~held]
        for _ in range(EPOCHS):
            order = rng.permutation(len(xs))
            for s in range(0, len(xs), 256):
                a, t = xs[order[s : s + 256]], ys[order[s : s + 256]]
                h = np.tanh(a @ w["a"] + w["b"])
                e = (1 / (1 + np.exp(-np.clip(h @ w["c"] + w["d"], -30, 30))) - t) / len(t)
                back = np.outer(e, w["c"]) * (1 - h * h)
                g = {"a": a.T @ back + DECAY * w["a"], "b": back.sum(0), "c": h.T @ e + DECAY * w["c"], "d": np.array([e.sum()])}
                step += 1
                for k in w:  # Adam
                    first[k] = 0.9 * first[k] + 0.1 * g[k]
                    second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                    w[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.w = w
        if held.any():
            logits, t = self._logits(x[held]), y[held]
            target = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
            loss = lambda k: np.mean(np.logaddexp(0, logits / k) - target * logits / k)
            self.temperature = float(min(np.geomspace(0.5, 32, 73), key=loss))

    def _in(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logits(self, x):
        """Of each row by itself: products are added input by input, as matrix products differ in their last bits with the rows beside."""
        hidden = np.repeat(self.w["b"][None], len(x), 0)
        for i, a in enumerate(self.w["a"]):
            hidden += x[:, i : i + 1] * a
        hidden, out = np.tanh(hidden), np.full(len(x), self.w["d"][0])
        for i, c in enumerate(self.w["c"]):
            out += hidden[:, i] * c
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits(self._in(x)) / self.temperature, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs`` (``doc_id``, ``text``)."""
    contexts = _normed(materialize(spark, context_vectors(docs), "word-vectors").toLocalIterator())
    vectors = materialize(spark, document_vectors(docs.select("doc_id", "text"), contexts), "doc-vectors")
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("q")).filter("q = quality")
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("doc_id", "quality")
    rows = vectors.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("vector").alias("vector"), F.min("quality").alias("quality")).toPandas().sort_values("doc_id")
    y = rows["quality"].to_numpy(np.float64)
    model = Network(np.stack(rows["vector"].to_numpy()).astype(np.float64), y) if len(y) and 0 < y.sum() < len(y) else None
    fixed = float(y.mean()) if len(y) else 0.5
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            v = batch.column("vector")
            x = v.values.to_numpy()[v.offsets[0].as_py() :].reshape(batch.num_rows, -1).astype(np.float64) if batch.num_rows else np.zeros((0, 1))
            p = np.full(batch.num_rows, fixed) if shared.value is None or not batch.num_rows else shared.value.predict(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    scored = vectors.mapInArrow(run, vectors.select("doc_id", F.lit(0.0).alias("score")).schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op5_random_indexing_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
