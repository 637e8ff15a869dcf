"""Phrase collocations by level-wise (Apriori) passes.

1. A pass over the texts counts single words; those found ``LEAST`` times or more are level 1.
2. A further pass for each length k counts a phrase of k words only where both phrases of
   k - 1 words that overlap in it belong to the level below.  That level travels as a bitmap
   of fixed size over hashed phrases (``BITS``): beyond some millions of phrases it lets more
   phrases be counted, never fewer, and the counts themselves decide, so results are exact.
3. Every cut of a phrase is scored from the level tables by joins; phrases that mostly occur
   inside a longer one are dropped, and each language's best are ranked.

A task numbers the words of a language, packs a phrase into one integer and counts integers;
it hands on partial counts whenever it holds ``HELD`` phrases or ``WORDS`` words, so a phrase of
a third of all texts is a few rows a task.  Nothing but partial counts is shuffled.

Counts are by language (null: ``UNKNOWN``).  A-Z are lower-cased; pieces end at
``. , ; : ! ?`` and at line breaks; words are what lies between spaces and tabs.

Edge cases: null, empty and wordless texts have no words; a phrase may overlap itself;
repeated rows count each time; a very long text is cut into words in one go and counted like
others; an empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._chunks import slices
from ._common import materialize, small_batches, table

#: Fewest occurrences of a phrase, most words in it, percentage of a phrase inside a longer one that drops it, rows a language.
LEAST, LONGEST, INSIDE, TOP = 10, 3, 50, 2000
SCALE, UNKNOWN = 1_000_000, "und"
#: Bits of the bitmap of a level, and bits in each of the rows that it is put together from.
BITS, ROW_BITS = 1 << 25, 1 << 15
#: Languages that a task counts side by side.
LANGS = 8
#: Distinct phrases that a task holds before it hands counts on, words (and their bytes) that it numbers, tokens counted at a time, bytes of a batch of counts.
HELD, WORDS, WORD_BYTES, STEP, OUT_BYTES = 1 << 20, 1 << 20, 32 << 20, 1 << 18, 8 << 20
#: A-Z are lower-cased, tabs become spaces, what ends a piece a line feed.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?\x0a\x0b\x0c\r" else b for b in range(256))
BREAK = b"\n"


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, and ``BREAK`` where a piece ends."""
    return list(filter(None, text.translate(_FOLD).replace(BREAK, b" \n ").split(b" ")))


class Counts:
    """Counts of the phrases of k words of one language: words are numbered, phrases are packed numbers."""

    def __init__(self, lang: str, k: int, below: np.ndarray):
        self.lang, self.k, self.below = lang, k, below
        self.bits = 63 // k
        self.most = min(WORDS, (1 << self.bits) - 2)
        self.seed = zlib.crc32(lang.encode() + b"\0")
        self.all_words, self.raw, self.size = 0, [], 0
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._renumber()

    def _renumber(self) -> None:
        self.known, self.hash, self.bytes = {BREAK: 0}, np.zeros(1, np.int64), 0

    def add(self, words: list[bytes]):
        """Count a token list; yields batches of counts when there is no more room."""
        step = max(1, min(STEP, self.most // 2))
        for a in range(0, len(words), step):
            part = words[a : a + step + self.k - 1]
            new = set(part).difference(self.known)
            if len(self.known) + len(new) > self.most or self.bytes > WORD_BYTES:
                yield from self.rows()
                new = set(part).difference(self.known)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.bytes += sum(map(len, new))
            self.hash = np.concatenate([self.hash, np.fromiter((zlib.crc32(w, self.seed) for w in new), np.int64, len(new))])
            self._count(np.fromiter(map(self.known.__getitem__, part), np.int64, len(part)))
            if self.size > HELD:
                self._merge()
                if len(self.keys) > HELD:
                    yield from self.rows()

    def _count(self, ids: np.ndarray) -> None:
        k, n = self.k, len(ids) - self.k + 1
        if n < 1:
            return
        fits = ids[:n] > 0
        if k > 1:
            word, hashes = ids > 0, self.hash[ids]
            part = sum((2 * j + 3) * hashes[j : j + n + 1] for j in range(k - 1)) % BITS
            known = (self.below[part >> 3] >> (part & 7).astype(np.uint8) & 1).astype(bool)
            for j in range(k - 1):
                known &= word[j : j + n + 1]
            fits = known[:-1] & known[1:]
        at = np.flatnonzero(fits)
        key = np.zeros(len(at), np.int64)
        for j in range(k):
            key = key << self.bits | ids[at + j]
        self.raw.append(key)
        self.size += len(key)
        self.all_words += len(key) if k == 1 else 0

    def _merge(self) -> None:
        if self.raw:
            keys, n = np.unique(np.concatenate(self.raw), return_counts=True)
            keys, n = np.concatenate([self.keys, keys]), np.concatenate([self.n, n])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            self.keys, self.n = keys[first], np.add.reduceat(n, first) if len(first) else n
            self.raw, self.size = [], 0

    def rows(self):
        """Counts so far, as batches; words are numbered anew."""
        self._merge()
        words, mask = pa.array(list(self.known), pa.binary()), (1 << self.bits) - 1
        ids = [self.keys >> self.bits * (self.k - 1 - j) & mask for j in range(self.k)]
        length = pc.binary_length(words).to_numpy().astype(np.int64)
        size = np.cumsum(sum(length[i] for i in ids))
        cuts = [0, *(np.flatnonzero(np.diff(size // OUT_BYTES)) + 1).tolist(), len(self.keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                phrase = pc.binary_join_element_wise(*[words.take(pa.array(i[a:b])) for i in ids], b" ").cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([self.lang] * (b - a), pa.string()), phrase, pa.array(self.n[a:b])], ["lang", "phrase", "n"])
        if self.all_words:
            yield pa.RecordBatch.from_arrays([pa.array([self.lang]), pa.array([None], pa.string()), pa.array([self.all_words], pa.int64())], ["lang", "phrase", "n"])
        self.keys, self.n, self.all_words = self.keys[:0], self.n[:0], 0
        self._renumber()


def slot(lang: str, phrase: str) -> Column:
    """Place of a phrase in the bitmap of its level, from the hashes of its words."""
    hash_ = lambda w: F.crc32(F.concat(F.col(lang), F.decode(F.lit(b"\0"), "UTF-8"), w))
    words = F.transform(F.split(phrase, " "), lambda w, j: (2 * j + 3) * hash_(w))
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + x) % BITS


def bitmap(level: DataFrame) -> bytes:
    """The bits of a level's phrases, ``BITS // 8`` bytes whatever its size."""
    rows = level.select(slot("lang", "phrase").alias("at")).groupBy(F.floor(F.col("at") / ROW_BITS).alias("row")).agg(F.bitmap_construct_agg(F.col("at") % ROW_BITS).alias("bits"))
    out = np.zeros((BITS // ROW_BITS, ROW_BITS // 8), np.uint8)
    for r in rows.toLocalIterator():
        out[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def counted(docs: DataFrame, k: int, below: bytes | None) -> DataFrame:
    """``lang, phrase, n``: occurrences of phrases of k words; at k = 1 also a null phrase that counts all words."""
    shared = docs.sparkSession.sparkContext.broadcast(below)

    def run(batches):
        bits = np.frombuffer(shared.value or b"", np.uint8)
        held: dict[str, Counts] = {}
        for batch in batches:
            texts = defaultdict(list)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                texts[lang].append(text)
            for lang, some in texts.items():
                if lang not in held and len(held) >= LANGS:
                    for c in held.values():
                        yield from c.rows()
                    held.clear()
                if lang not in held:
                    held[lang] = Counts(lang, k, bits)
                for a, b in slices(some):
                    yield from held[lang].add(tokens("\n".join(some[a:b]).encode()))
        for c in held.values():
            yield from c.rows()

    ready = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").filter("text IS NOT NULL")
    return ready.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def levels(spark: SparkSession, docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """``lang, phrase, n`` of the frequent phrases of 1, 2, .. words, and ``lang, n`` with all words of a language."""
    small_batches(spark)
    words = materialize(spark, counted(docs, 1, None).filter(F.col("phrase").isNull() | (F.col("n") >= least)), "phrases-1")
    out = [words.filter("phrase IS NOT NULL")]
    for k in range(2, longest + 1):
        out.append(materialize(spark, counted(docs, k, bitmap(out[-1])).filter(F.col("n") >= least), f"phrases-{k}"))
    return out, words.filter("phrase IS NULL").select("lang", "n")


def scored(found: list[DataFrame], k: int) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the phrases of k words, by their lowest-scoring cut (the first of equal ones)."""
    words = F.split("phrase", " ")
    out, cuts = found[k - 1].select("lang", "phrase", F.col("n").alias("a")), []
    for i in range(1, k):
        left = found[i - 1].select("lang", F.col("phrase").alias("_left"), F.col("n").alias(f"l{i}"))
        right = found[k - i - 1].select("lang", F.col("phrase").alias("_right"), F.col("n").alias(f"r{i}"))
        out = out.withColumns({"_left": F.array_join(F.slice(words, 1, i), " "), "_right": F.array_join(F.slice(words, i + 1, k - i), " ")})
        out = out.join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).drop("_left", "_right")
        score = F.expr(f"(CAST({SCALE} AS DECIMAL(38,0)) * a * a) div (CAST(l{i} AS DECIMAL(18,0)) * CAST(r{i} AS DECIMAL(18,0)))")
        cuts.append(F.struct(score.alias("score"), F.lit(i).alias("k"), F.col(f"l{i}").alias("l"), F.col(f"r{i}").alias("r")))
    best = F.array_min(F.array(*cuts))
    return out.select("lang", "phrase", "a", best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def enclosed(found: list[DataFrame], k: int, inside: int = INSIDE) -> DataFrame:
    """``lang, phrase`` of k words that lie too often inside a longer frequent phrase."""
    out = None
    for longer in range(k + 1, len(found) + 1):
        words = F.split("phrase", " ")
        parts = F.array(*[F.array_join(F.slice(words, i, k), " ") for i in range(1, longer - k + 2)])
        part = found[longer - 1].select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), F.col("n").alias("m")).groupBy("lang", "phrase").agg(F.max("m").alias("m"))
        out = part if out is None else out.unionByName(part)
    return None if out is None else out.groupBy("lang", "phrase").agg(F.max("m").alias("m")).join(found[k - 1], ["lang", "phrase"]).filter(F.lit(100) * F.col("m") >= F.lit(inside) * F.col("n")).select("lang", "phrase")


def collocations(spark: SparkSession, docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE, top: int | None = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's phrases by score; ``top`` None gives all."""
    found, words = levels(spark, docs, least=least, longest=longest)
    out = None
    for k in range(2, longest + 1):
        part, drop = scored(found, k), enclosed(found, k, inside)
        if drop is not None:
            part = part.join(drop, ["lang", "phrase"], "left_anti")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(order).cast("long"))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH p AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM (SELECT coalesce(lang, '{UNKNOWN}') AS lang,
  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= {LEAST}),
cuts AS (SELECT c.lang, c.k, c.phrase, a, i, l.f AS l, r.f AS r, ({SCALE}::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score FROM (SELECT *, unnest(generate_series(1, k - 1)) AS i FROM c) c
  JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(w[1 : i], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(w[i + 1 : c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
held AS (SELECT lang, part AS phrase, max(a) AS m FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM c WHERE k = 3) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
FROM best JOIN n USING (lang) LEFT JOIN held USING (lang, phrase) WHERE coalesce(100 * m < {INSIDE} * a, TRUE)
QUALIFY rank <= {TOP}
"""
