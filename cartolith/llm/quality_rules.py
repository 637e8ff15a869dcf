"""Quality rules whose cutoffs come with a guarantee on false rejections.

Every rule rejects a text whose statistic lies above a cutoff; a document goes if any rule
rejects it.  A *policy* is one cutoff for each rule.  In each stratum (a language) labelled
texts are split by their digest:

1. On the smaller part, a chain of policies is drawn up, the most careful first (``CHAIN``):
   each step says how many bad texts caught are worth a good one lost and which share of all
   bad texts a rule must catch to be used; every rule takes the cutoff with the best yield.
2. On the other, *test* part, the policies are tested in this order by the exact binomial
   bound: with confidence ``1 - DELTA`` over all strata together (Bonferroni, weighted) the share of
   good texts that *all rules together* reject is at most ``ALPHA``.  Testing stops at the
   first policy that fails, so the chain needs no further correction; the last that passed
   holds.  If none passes, nothing is rejected beyond the base rules.

A language's part of ``DELTA`` is its part of all good test texts, so that many small ones do
not weaken a large one's bound; the parts depend on counts only, never on statistics.  A
language with too few good test texts for any bound rejects nothing beyond the base rules.

A trial is a distinct text: copies count once, with the first of their languages, and not
at all if their labels disagree.  Near copies are trials of their own unless the caller
gives them a common ``unit``.

Everything is DataFrame expressions: statistics are computed inside a row, label counts
are grouped counts over (stratum, rule, bin), and policies and cutoffs are tables of one row
for each stratum, broadcast only after a count.

Edge cases: a null or blank text has no words and fails the base rules; a null language is
the stratum ''; a language without labels rejects nothing; labels with null ids, null or
other values than 0 and 1 are ignored, repeated labels of an id count once if they agree and
not at all if they don't; repeated documents each give a row; further columns of the input
are kept by ``keep_good``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACES, broadcast_if_small, let, materialize, table, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Largest share of a stratum's good texts that may be rejected, and the chance that any bound fails.
ALPHA, DELTA = 0.03, 0.05
#: Policies, the most careful first: bad texts caught that outweigh a good one lost, least share of bad texts that a rule catches.
CHAIN = ((1000.0, 0.5), (1000.0, 0.25), (64.0, 0.25), (16.0, 0.1), (8.0, 0.1), (4.0, 0.05))
#: First hexadecimal digits of a text's digest that put it into the test part: ten of sixteen.
TEST_BELOW = "a"
#: Rules: name and the numerator and denominator of the statistic.
RULES = (
    ("symbols", "n_symbols", "word_chars"),
    ("dup_lines", "n_dup_lines", "n_lines"),
    ("repeats", "n_repeat_words", "n_words"),
    ("long_words", "word_chars", "n_words"),
    ("capitals", "n_capitals", "word_chars"),
    ("exclaims", "n_exclaims", "n_words"),
)
#: Cutoffs of each rule: geometric, 24 steps down from its largest.
STEPS, FACTOR = 24, 0.8
LARGEST = {"symbols": 1.0, "dup_lines": 1.0, "repeats": 1.0, "long_words": 60.0, "capitals": 1.0, "exclaims": 4.0}


def cutoffs(rule: str) -> list[float]:
    """Candidate cutoffs, the safest (largest) first."""
    out = [LARGEST[rule]]
    while len(out) < STEPS:
        out.append(out[-1] * FACTOR)
    return out


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the text."""

    def of(w: Column) -> Column:
        n = F.size(w)
        windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(n < 4, F.lit(0)).otherwise(let(windows, covered))

    def covered(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            at = F.filter(
                F.transform(s, lambda e, k: F.when(F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)), e["i"])),
                lambda i: i.isNotNull(),
            )
            return let(F.sort_array(at), lambda p: F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(order, twice))

    return let(words, of)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules use; columns with these names are replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    long = lambda c: c.cast("long")
    measured = let(
        words_of(F.col(text)),
        lambda w: F.struct(long(F.size(w)).alias("n_words"), long(_repeat_words(w)).alias("n_repeat_words")),
    )
    in_lines = let(lines, lambda x: F.struct(long(F.size(x)).alias("n_lines"), long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    new = {
        "word_chars": long(_without(t, SPACES)),
        "n_symbols": long(F.length(t) - _without(t, SYMBOLS)),
        "n_capitals": long(F.length(t) - _without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        "n_exclaims": long(F.length(t) - _without(t, "!?")),
        "_words": measured,
        "_lines": in_lines,
    }
    wide = docs.withColumns(new)
    names = [c for c in wide.columns if c not in ("_words", "_lines", "n_words", "n_repeat_words", "n_lines", "n_dup_lines")]
    return wide.select(*[F.col(f"`{c}`") for c in names], "_words.n_words", "_words.n_repeat_words", "_lines.n_lines", "_lines.n_dup_lines")


def _bin(name: str, top: str, bottom: str) -> Column:
    return F.size(F.filter(F.array(*[F.lit(c) for c in cutoffs(name)]), lambda c: _statistic(top, bottom) <= c))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _statistic(top: str, bottom: str) -> Column:
    return F.when(F.col(bottom) > 0, F.col(top).cast("double") / F.col(bottom)).otherwise(F.lit(0.0))


def _allowed(n: Column, tests: Column | int, alpha: float, delta: float) -> Column:
    """Largest k with P(Bin(n, alpha) <= k) <= delta / tests, or -1: exact, summed in logarithms."""
    start = F.struct((n * F.log1p(F.lit(-alpha))).alias("lp"), F.lit(0.0).alias("cdf"), F.lit(-1).cast("long").alias("k"))

    def step(a: Column, i: Column) -> Column:
        cdf = a["cdf"] + F.exp(a["lp"])
        return F.struct(
            (a["lp"] + F.log((n - i).cast("double") / (i + 1)) + F.log(F.lit(alpha / (1 - alpha)))).alias("lp"),
            cdf.alias("cdf"),
            F.when(cdf <= F.lit(delta) / tests, i).otherwise(a["k"]).alias("k"),
        )

    most = F.least(F.ceil(n * F.lit(alpha)).cast("long"), n - 1)
    return F.when(n < 1, F.lit(-1).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(0).cast("long"), F.greatest(most, F.lit(0).cast("long"))), start, step)["k"])


def _units(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """``unit, stratum, quality, test`` and a bin for each rule, of each distinct labelled text that passes the base rules."""
    good = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_q")).filter("quality = _q").drop("_q")
    # A statistic's bin: how many candidate cutoffs lie at or above it, so that cutoff k (from 0) rejects bins <= k.
    bins = [_bin(name, top, bottom).alias(f"bin_{name}") for name, top, bottom in RULES]
    rows = stats.filter(~base_failed()).select("doc_id", "stratum", "unit", *bins).join(good, "doc_id")
    once = rows.groupBy("unit").agg(F.min("stratum").alias("stratum"), F.min("quality").alias("quality"), F.max("quality").alias("_q"), *[F.min(f"bin_{name}").alias(f"bin_{name}") for name, _, _ in RULES])
    return once.filter("quality = _q").drop("_q").withColumn("test", F.substring("unit", 1, 1) < TEST_BELOW)


def _policies(units: DataFrame) -> DataFrame:
    """``stratum`` and for each rule the cutoffs (from 0; -1: none) of the chain, from texts outside the test part."""
    bins = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"bin_{name}").alias("bin")) for name, _, _ in RULES])
    counts = units.filter(~F.col("test")).select("stratum", "quality", F.explode(bins).alias("b")).groupBy("stratum", "b.rule", "b.bin").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    ladder = counts.groupBy("stratum", "rule").agg(F.collect_list(F.struct("bin", "good", "bad")).alias("bins"), F.sum("bad").alias("all_bad"))

    def upto(k: Column, name: str) -> Column:
        return F.aggregate(F.filter("bins", lambda b: b["bin"] <= k), F.lit(0).cast("long"), lambda a, b: a + b[name]).alias(name)

    at = F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda k: F.struct(k.alias("k"), upto(k, "good"), upto(k, "bad")))

    def best(cost: float, share: float) -> Column:
        gain = lambda x: F.when(x["bad"] >= F.lit(share) * F.col("all_bad"), x["bad"] - F.lit(cost) * x["good"]).otherwise(0.0)
        return F.reduce("at", F.struct(F.lit(0.0).alias("gain"), F.lit(-1).alias("k")), lambda a, x: F.when(gain(x) > a["gain"], F.struct(gain(x).alias("gain"), x["k"].alias("k"))).otherwise(a))["k"]

    chain = ladder.withColumn("at", at).select("stratum", "rule", F.array(*[best(*c) for c in CHAIN]).alias("ks"))
    return chain.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == name, F.col("ks"))).alias(f"k_{name}") for name, _, _ in RULES])


def fit_cutoffs(stats: DataFrame, labels: DataFrame, *, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``stratum`` and one cutoff for each rule (null: the rule rejects nothing there).

    ``stats`` has ``doc_id``, ``stratum``, ``unit`` (the digest of the text, in hexadecimal
    digits) and the counts; ``labels`` has ``doc_id`` and ``quality``.
    """
    spark = stats.sparkSession
    units = materialize(spark, _units(stats, labels), "rule-units")
    policies = materialize(spark, _policies(units), "rule-policies")
    rejected = [reduce(or_, [F.col(f"bin_{name}") <= F.get(f"k_{name}", F.lit(i)) for name, _, _ in RULES]) for i in range(len(CHAIN))]
    lost = units.filter(F.col("test") & (F.col("quality") == 1)).join(broadcast_if_small(policies), "stratum").groupBy("stratum").agg(F.count("*").alias("n"), F.array(*[F.count_if(r) for r in rejected]).alias("lost"))
    good_tests = units.filter(F.col("test") & (F.col("quality") == 1)).count()
    allowed = _allowed(F.col("n"), F.lit(float(good_tests)) / F.col("n"), alpha, delta)
    failed = F.array_position(F.transform("lost", lambda x: x > F.col("allowed")), True)
    last = F.when(failed == 0, F.lit(len(CHAIN))).otherwise(failed - 1).cast("int") - 1
    cut = lambda name: F.get(F.array(*[F.lit(c) for c in cutoffs(name)]), F.get(f"k_{name}", F.col("last"))).alias(f"cut_{name}")
    return policies.join(lost.withColumn("allowed", allowed).select("stratum", last.alias("last")).filter("last >= 0"), "stratum").select("stratum", *[cut(name) for name, _, _ in RULES])


def with_verdict(stats: DataFrame, cuts: DataFrame) -> DataFrame:
    """``stats`` with ``base_failed`` and ``kept``; ``cuts`` is a written table of ``fit_cutoffs``."""
    above = [F.coalesce(_statistic(top, bottom) > F.col(f"cut_{name}"), F.lit(False)) for name, top, bottom in RULES]
    out = stats.join(broadcast_if_small(cuts), "stratum", "left")
    return out.withColumns({"base_failed": base_failed(), "kept": ~(base_failed() | reduce(or_, above))})


def _keys() -> list[Column]:
    return [F.coalesce(F.col("lang"), F.lit("")).alias("stratum"), F.md5(F.coalesce("text", F.lit(""))).alias("unit")]


def rule_report(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base verdict and verdict of each document; statistics are computed once."""
    narrow = statistics(docs.select("doc_id", "text", *_keys())).drop("text")
    stats = materialize(spark, narrow, "rule-stats")
    cuts = materialize(spark, fit_cutoffs(stats, labels), "rule-cuts")
    return with_verdict(stats, cuts)


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns unchanged."""
    names = docs.columns
    wide = materialize(spark, statistics(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id"), F.col("text"), *_keys())).drop("text"), "rule-stats")
    cuts = materialize(spark, fit_cutoffs(wide.drop("_row"), labels), "rule-cuts")
    return with_verdict(wide, cuts).filter("kept").select("_row.*")


def op4_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = rule_report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    stat = lambda t, b: f"CASE WHEN {b} > 0 THEN {t}::DOUBLE / {b} ELSE 0.0 END"
    steps = " UNION ALL ".join(f"SELECT '{n}' AS rule, {k} AS k, {c!r}::DOUBLE AS c" for n, _, _ in RULES for k, c in enumerate(cutoffs(n)))
    costs = " UNION ALL ".join(f"SELECT {i} AS i, {c!r}::DOUBLE AS cost, {m!r}::DOUBLE AS share" for i, (c, m) in enumerate(CHAIN))
    facts = ", ".join(f"min({c}) AS {c}" for c in sorted({c for _, t, b in RULES for c in (t, b)}))
    values = " UNION ALL ".join(f"SELECT stratum, unit, quality, test, '{n}' AS rule, {stat(t, b)} AS v FROM labelled" for n, t, b in RULES)
    above = " OR ".join(f"coalesce({stat(t, b)} > cut_{n}, FALSE)" for n, t, b in RULES)
    cuts = ", ".join(f"max(c) FILTER (rule = '{n}') AS cut_{n}" for n, _, _ in RULES)
    strip = "regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')"
    failed = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, stratum, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
p AS (SELECT doc_id, t, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS x FROM (SELECT doc_id, t, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT doc_id, t, count(DISTINCT j) AS n FROM (SELECT doc_id, t, unnest([i, i+1, i+2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t, x) AS c FROM p) WHERE c > 1) GROUP BY doc_id, t),
s AS (SELECT w.doc_id, stratum, md5(t) AS unit, len(w)::BIGINT AS n_words, length({strip})::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
        (length(t) - length(regexp_replace(t, '[!?]', '', 'g')))::BIGINT AS n_exclaims,
        len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id, t)),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
labelled AS (SELECT unit, min(stratum) AS stratum, min(quality) AS quality, unit[1] < '{TEST_BELOW}' AS test, {facts} FROM s JOIN q USING (doc_id)
             WHERE NOT {failed} GROUP BY unit HAVING min(quality) = max(quality)),
vals AS ({values}),
steps AS ({steps}),
costs AS ({costs}),
policies AS (SELECT stratum, rule, i, c FROM (SELECT stratum, v.rule, i, k, c, count(*) FILTER (quality = 0 AND v > c) - cost * count(*) FILTER (quality = 1 AND v > c) AS gain,
             count(*) FILTER (quality = 0 AND v > c) >= share * count(*) FILTER (quality = 0) AS enough
             FROM vals v JOIN steps USING (rule), costs WHERE NOT test GROUP BY stratum, v.rule, i, cost, share, k, c) WHERE enough AND gain > 0
             QUALIFY row_number() OVER (PARTITION BY stratum, rule, i ORDER BY gain DESC, k) = 1),
lost AS (SELECT v.stratum, i, count(DISTINCT unit) AS lost FROM vals v JOIN policies p ON p.stratum = v.stratum AND p.rule = v.rule WHERE test AND quality = 1 AND v > c GROUP BY v.stratum, i),
sizes AS (SELECT stratum, count(DISTINCT unit) FILTER (test AND quality = 1) AS n FROM vals GROUP BY stratum),
tests AS (SELECT sum(n)::DOUBLE AS m FROM sizes),
pmf AS (SELECT n, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})) AS p
        FROM (SELECT n, unnest(generate_series(0, least(ceil(n * {ALPHA})::BIGINT, n - 1))) AS i FROM (SELECT DISTINCT n FROM sizes WHERE n > 0))),
allowed AS (SELECT n, max(i) AS a FROM (SELECT n, i, sum(p) OVER (PARTITION BY n ORDER BY i) AS cdf FROM pmf), tests WHERE cdf <= {DELTA} / (m / n) GROUP BY n),
chosen AS (SELECT z.stratum, coalesce(min(o.i) FILTER (coalesce(l.lost, 0) > coalesce(a, -1)), {len(CHAIN)}) - 1 AS i
           FROM sizes z CROSS JOIN costs o LEFT JOIN lost l ON l.stratum = z.stratum AND l.i = o.i LEFT JOIN allowed ON allowed.n = z.n GROUP BY z.stratum),
cuts AS (SELECT p.stratum, {cuts} FROM chosen h JOIN policies p ON p.stratum = h.stratum AND p.i = h.i GROUP BY p.stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT ({failed} OR {above}) AS kept
FROM s LEFT JOIN cuts USING (stratum)
"""


OP4_SQL = _sql()
