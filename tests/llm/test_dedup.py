"""Near duplicates, passages, lines and contamination against brute force in plain Python."""

import re
import sys
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from llm.conftest import corpus, prose

from cartolith.llm import _similar as S
from cartolith.llm import _spans, decontaminate, line_dedup, ngram_join, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {("short", *w)} if w else set()


def classes(rows):
    """(links, class) of each row number, by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    return links, [find(i) for i in range(len(rows))]


def test_join_counts_every_link(spark, docs):
    rows = [(d, t) for d, t, *_ in corpus()]
    links, root = classes(rows)
    least = defaultdict(lambda: 1 << 60)
    for (d, _), r in zip(rows, root):
        least[r] = min(least[r], ngram_join.NO_ID if d is None else d)
    want = Counter((d, None if least[r] == ngram_join.NO_ID else least[r], n) for (d, _), r, n in zip(rows, root, links))
    got = ngram_join.similar_documents(spark, docs).select(ngram_join._id("id"), ngram_join._id("class_id"), "n_links").collect()
    assert Counter(map(tuple, got)) == want
    assert max(links) >= 8


def test_join_of_nothing(spark, no_docs):
    assert ngram_join.similar_documents(spark, no_docs).count() == 0
    assert ngram_join.keep_one_of_each(spark, no_docs).count() == 0


def test_keep_one_of_each(spark, docs):
    kept = ngram_join.keep_one_of_each(spark, docs.withColumnRenamed("source", "id").withColumnRenamed("lang", "th"))
    assert kept.columns == ["doc_id", "text", "th", "id", "n_chars"]
    rows = [(d, t) for d, t, *_ in corpus()]
    links, root = classes(rows)
    alone = {(d, t) for (d, t), n in zip(rows, links) if not n}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got)) and alone <= set(got)
    assert len(got) == len(alone) + len({r for r, n in zip(root, links) if n})


def test_posterior_bound_and_similarity():
    for n, k in ngram_join.least_matches():
        # A pair at the threshold is lost at a step with the tolerated probability at most.
        from math import comb

        assert sum(comb(n, i) * 0.8**i * 0.2 ** (n - i) for i in range(k)) < 2 * ngram_join.TOLERANCE
    r = np.random.default_rng(0)
    lists = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    near = S.similar_in_group(lists, True, np.zeros(30))
    for i, j in combinations(range(30), 2):
        a, b = set(lists[i].tolist()), set(lists[j].tolist())
        assert near[i, j] == (len(a & b) / len(a | b) >= 0.8)


def test_listed_pairs_against_sets(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "STRIP", 600)
    r = np.random.default_rng(1)
    base = [np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 40, 300, 700)]
    sets, number = [], []
    for g in range(6):
        for _ in range(int(r.integers(2, 30))):
            x = base[r.integers(4)]
            sets.append(np.unique(np.concatenate([x[r.random(len(x)) < r.choice([0.5, 0.9, 1])], r.integers(0, 1 << 63, r.integers(3)).astype(np.uint64)])))
            number.append(g)
    number = np.array(number)
    rows = pa.chunked_array([S.list_of(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))])
    pairs = [(i, j) for i, j in combinations(range(len(sets)), 2) if number[i] == number[j] and r.random() < 0.6]
    x, y = np.array(pairs).T
    at, place, bits = ngram_join.partner_bitmaps(number, x, y)
    again = ngram_join.pairs_of_bitmaps(number[at], pa.chunked_array([bits]))
    assert sorted(zip(at[again[0]].tolist(), at[again[1]].tolist())) == pairs
    assert all(place[i] == i - np.flatnonzero(number[at] == number[at][i])[0] for i in range(len(at)))
    near = S.similar_pairs(number, rows, x, y)
    want = [(i, j) for i, j in pairs if len(a := set(sets[i].tolist())) and 9 * len(a & (b := set(sets[j].tolist()))) >= 4 * (len(a) + len(b))]
    assert list(zip(near[0].tolist(), near[1].tolist())) == want and len(want) > 50


def test_a_chain_of_weak_candidates_and_a_large_class(spark):
    """Texts that each share half of their words with the next, and more near copies than a block holds: links and classes are exact."""
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40_000)]
    chain = [" ".join(words[20 * i : 20 * i + 60]) for i in range(300)]
    near = []
    for _ in range(S.BLOCK + 150):
        x = words[30_000:30_200]
        for at in r.choice(200, int(r.integers(1, 4)), replace=False):
            x[at] = f"x{r.integers(1 << 40)}"
        near.append(" ".join(x))
    texts = chain + near
    sets = [grams(t) for t in texts]
    links = [0] * len(texts)
    for i, j in combinations(range(300, len(texts)), 2):
        both = len(sets[i] & sets[j])
        if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
            links[i] += 1
            links[j] += 1
    assert 0 < min(links[300:]) < len(near) - 1
    got = {x.id: (x.class_id, x.n_links) for x in ngram_join.similar_documents(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(300)] == [(i, 0) for i in range(300)]
    assert {got[i][0] for i in range(300, len(texts))} == {300}
    lost = sum(links) - sum(got[i][1] for i in range(300, len(texts)))
    assert 0 <= lost <= sum(links) * 2e-4  # pairs near 0.8 that meet in no band or are pruned


def test_blocks_cover_every_pair_once(spark):
    from pyspark.sql import functions as F

    rows = spark.range(41).select((F.col("id") % 2).alias("key"), F.col("id").alias("node"), F.lit(1).cast("long").alias("m"), F.array(F.lit(7).cast("long")).alias("sh"))
    out = S.verify_blocks(S.in_blocks(rows, "key", F.col("node"), block=4), ["key"])
    links = {r.node: r.n for r in out.groupBy("node").agg(F.sum("links").alias("n")).collect()}
    assert links == {i: 20 if i % 2 == 0 else 19 for i in range(41)}
    roots = {r.node: r.root for r in S.components(spark, out, "t").collect()}
    assert roots == {i: i % 2 for i in range(41)}


def test_components_of_a_path_and_of_nothing(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "node long, root long")
    got = {r.node: r.root for r in S.components(spark, edges, "t").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert S.components(spark, edges.limit(0), "t").count() == 0


def test_passages(spark, docs, no_docs):
    found = substring_dedup.passages(spark, docs).collect()
    inside = {r.id for r in found}
    assert {50, 51, 52, 53} <= inside and {20, 21, 22, 30, 31} <= inside
    assert not inside & {0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 40, 41, 42, 43, 44, 45, 46, 47, 48}
    shared = [r for r in found if 50 <= r.id <= 53]
    assert {r.id for r in shared if not r.removed} == {50} and {r.keep_id for r in shared} == {50}
    assert all(r.n_words >= 15 for r in shared)
    assert substring_dedup.passages(spark, no_docs).count() == 0


def test_drop_passages(spark, docs):
    out = {(r.doc_id, r.text): r.n_removed_words for r in substring_dedup.drop_passages(spark, docs.withColumnRenamed("lang", "n_removed_words")).collect()}
    texts = {d: t for (d, t) in out}
    own = prose(51, 60).split()
    assert texts[50] == dict((d, t) for d, t, *_ in corpus())[50]
    assert len(texts[51].split()) < 175 and texts[51].split()[:50] == own[:50]
    assert None in [t for d, t in out if d == 40]


@pytest.mark.parametrize("rows", [corpus(), []])
def test_lines(spark, rows):
    df = spark.createDataFrame([(d, t, s, 7) for d, t, _, s, _ in rows], "doc_id long, text string, n_lines string, th int")
    seen, gone = {}, defaultdict(set)
    keyed = {(d, t): i for i, (d, t, *_) in enumerate(rows)}
    hashes = {(r.doc_id, r.text): r.h for r in df.selectExpr("doc_id", "text", "xxhash64(text) h").collect()}
    for d, t in sorted(keyed, key=lambda k: (k[0] is not None, k[0] or 0, hashes[k])):
        x = (t or "").split("\n")
        for i in range(len(x) - 2):
            w = tuple(x[i : i + 3])
            if WORD.search("".join(w)):
                if w in seen:
                    gone[d, t] |= {i, i + 1, i + 2}
                seen.setdefault(w, (d, i))
    want = Counter((d, None if t is None else "\n".join(v for i, v in enumerate(t.split("\n")) if i not in gone[d, t]), len(gone[d, t])) for d, t, *_ in rows)
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "th", "n_lines", "n_removed"]
    assert Counter((r.doc_id, r.text, r.n_removed) for r in out.collect()) == want
    if rows:
        assert sum(map(len, gone.values())) >= 6


def test_windows_in_one_text(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\na\nb\nc\nd"), (2, "\n\n\n\n")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: ("a\nb\nc\nd", 7, 3), 2: ("\n\n\n\n", 5, 0)}


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def contaminated(t, items):
    w, hit, found = ascii_words(t), set(), set()
    for i, x in items:
        b = ascii_words(x)
        m = min(13, len(b))
        for k in range(len(b) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == b[k : k + m]:
                    hit |= set(range(j, j + m))
                    found.add(i)
    return len(w), sorted(hit), sorted(found, key=str)


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_contamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", limit)
    items = [(2, prose(900, 30)), (10, prose(901, 13).upper()), (11, "Two words"), (12, "one"), (3, None), (4, "... --"), (5, prose(900, 30)), (None, "null id"), (6, "aa bb aa bb aa bb aa bb aa bb aa bb aa bb")]
    docs = [(1, prose(1, 40) + " " + prose(900, 30) + " " + prose(2, 40)), (2, prose(901, 13)), (3, "x two, WORDS y ONE one-two words"), (4, None), (5, ""), (6, "aa bb " * 20), (7, prose(900, 30)[10:]), (7, prose(3, 200)), (None, "one"), (8, "é one É")]
    bench = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    df = spark.createDataFrame([(*x, "e", 1) for x in docs], "doc_id long, text string, n_words string, hit_items int")
    got = Counter((r.doc_id, r.text, r.n_words, tuple(r.hit_words), tuple(r.hit_items)) for r in decontaminate.mark_contamination(df, bench).collect())
    # An item without an id is searched like any other, but is not listed.
    listed = lambda f: tuple(i for i in f if i is not None)
    assert got == Counter((d, t, n, tuple(h), listed(f)) for d, t in docs for n, h, f in [contaminated(t, items)])
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((d, t) for d, t in docs for n, h, _ in [contaminated(t, items)] if not (h and 20 * len(h) >= n))


def test_contamination_of_nothing(spark, no_docs, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(decontaminate.mark_contamination(no_docs, bench)).count() == 0
    assert not decontaminate.contamination(decontaminate.mark_contamination(docs, bench)).filter("n_hit > 0 or contaminated").count()


def _bare(seed, n, phrase=0):
    """Words without punctuation, or with a comma after every ``phrase`` words."""
    w = re.sub(r"[.,\n]", " ", prose(seed, 2 * n)).split()[:n]
    return [x + "," if phrase and i % phrase == phrase - 1 else x for i, x in enumerate(w)]


def _covered(spark, texts):
    """Removed words of each text."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = defaultdict(set)
    for r in substring_dedup.passages(spark, df).collect():
        if r.removed:
            out[r.id] |= set(range(r.start, r.start + r.n_words))
    return out


def test_passages_without_long_phrases(spark):
    texts, want = [], {}
    for k in range(40):
        phrase, passage = (0, 3)[k % 2], _bare(1000 + k, 51, (0, 3)[k % 2])
        for side in range(2):
            head, tail = _bare(2000 + 2 * k + side, 30 + k + 7 * side, phrase), _bare(3000 + 2 * k + side, 90, phrase)
            texts.append(" ".join([*head, *passage, *tail]))
        want[2 * k + 1] = set(range(len(head), len(head) + 51))
    got = _covered(spark, texts)
    assert set(got) == set(want)
    # By brute force over all pairs of 12 words in a row: only the passages recur.
    seen = defaultdict(set)
    for i, t in enumerate(texts):
        w = t.split()
        for j in range(len(w) - 11):
            seen[tuple(w[j : j + 12])].add(i)
    assert {max(x) for x in seen.values() if len(x) > 1} == set(want)
    for i, words in want.items():
        assert words <= got[i]


def test_paragraphs_of_short_phrases_are_bounded():
    _, _, _, _, length, _ = substring_dedup.Paragraphs().cut([" ".join(_bare(7, 3000, 3)), " ".join(_bare(8, 3000))])
    assert length.min() >= substring_dedup.LEAST and length.max() < 150


def _odd(seed, n):
    """Texts of words, marks, line feeds and white space of all kinds in any order."""
    r = np.random.default_rng(seed)
    parts = ["a", "bc.", "d,", "\n", " ", "\r\n", "\0", "é", "x\0", "\t", "\x0b", "\x1c", "q!", "日本", "w" * 8, "w" * 9, "w" * 40, "\n\n", "\0\n"]
    return [None, "", " ", "\na", "a\n", *("".join(r.choice(parts) + r.choice(["", " "]) for _ in range(k)) for k in r.integers(0, 300, n))]


def test_words_and_ends_of_phrases_against_plain_python():
    texts = _odd(1, 200)
    h, words = substring_dedup.Paragraphs.marked(texts)
    want = []
    for t, n in zip(texts, words.tolist()):
        found = []
        for w in (t or "").encode().replace(b"\0", b"\1").replace(b"\n", b"\0 ").split():  # NUL: the mark of a line feed
            bare = w.rstrip(b"\0")
            if bare:
                found.append([xxhash.xxh3_64_intdigest(bare) & ~3, bare[-1:] in (b".", b",", b";", b":", b"!", b"?")])
            if bare != w and found:
                found[-1][1] = True
        assert n == len(found)
        want += [x | end for x, end in found]
    assert h.tolist() == want


def test_equal_spans_are_told_apart_by_their_bytes(monkeypatch):
    texts = [t for t in _odd(2, 100) if t]
    raw, bounds = _spans.joined(texts)
    start, stop = _spans.words(raw, bounds)
    for _ in range(2):
        one, number = _spans.equal_spans(raw, start, stop - start)
        kinds = [raw[start[i] : stop[i]] for i in one.tolist()]
        assert len(set(kinds)) == len(kinds)
        assert [kinds[k] for k in number.tolist()] == [raw[a:b] for a, b in zip(start.tolist(), stop.tolist())]
        monkeypatch.setattr(_spans, "mix", lambda x: x & np.uint64(3))  # nearly all hashes collide


def test_cutting_takes_few_steps_of_python_for_each_word():
    texts, steps = [" ".join(f"w{i}x{j}" for j in range(500)) for i in range(100)], [0]

    def count(frame, event, arg):
        steps[0] += event in ("call", "c_call")

    cutter = substring_dedup.Paragraphs()
    sys.setprofile(count)
    try:
        cutter.cut(texts)
    finally:
        sys.setprofile(None)
    assert steps[0] < 1.5 * 100 * 500


def test_passages_extend_to_their_ends(spark):
    # One inner paragraph of 8 words between phrases of 21 and 22 that stand apart from it.
    own = [_bare(4000 + i, 40, 10) for i in range(6)]
    words = _bare(4100, 51)
    for i in (20, 28):
        words[i] += "."
    texts = [" ".join([*own[0][:33], *words, *own[1]]), " ".join([*own[2][:37], *words, *own[3]])]
    # A repeat of 20 words with a paragraph of 8 and parts of phrases beside it.
    short = _bare(4200, 20)
    for i in (5, 13):
        short[i] += "."
    texts += [" ".join([*own[4][:35], *short, *own[5]]), " ".join([*own[1][3:30], *short, *own[0][35:]])]
    got = _covered(spark, texts)
    assert got[1] == set(range(37, 88))
    assert set(range(27, 47)) <= got[3]


def test_repeats_within_one_text(spark):
    passage = _bare(4300, 60)
    got = _covered(spark, [" ".join([*passage, *_bare(4301, 9), *passage]), "aa bb " * 60])
    assert got[0] == set(range(69, 129))
    assert not got[1] & set(range(15))


def test_keep_one_of_each_class_with_null_and_repeated_ids(spark):
    a, b, c, d = (prose(5000 + i, 60) for i in range(4))
    rows = [(None, a), (1, a), (None, b), (2, b), (7, c), (8, c), (7, d), (9, d), (3, ""), (3, ""), (None, None), (None, None), (4, " \n")]
    kept = ngram_join.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(None, a), (None, b), (7, c), (7, d), (3, ""), (3, ""), (None, None), (None, None), (4, " \n")])


def sets_of_paragraphs(rows):
    """(id, first word, words) and the set of five words in a row of each paragraph; the cut is the operator's, the rest plain Python."""
    cutter, out = substring_dedup.Paragraphs(), []
    for d, t in rows:
        _, _, first, _, length, _ = cutter.cut([t])
        w = (t or "").replace("\n", " \n ").encode().split()
        w = [x.decode() for x in w]
        out += [((d, a, n), frozenset(tuple(w[i : i + 5]) for i in range(a, a + n - 4))) for a, n in zip(first.tolist(), length.tolist())]
    return out


def test_paragraphs_against_all_pairs(spark):
    """Over all documents of the driver's smallest table: similar pairs by exact counts of shared five words."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    found = {(r.id, r.start, r.n): r.root for r in substring_dedup.repeated_paragraphs(spark, df).collect()}
    holding, parts = defaultdict(list), sets_of_paragraphs(rows)
    distinct = {}
    for k, s in parts:
        distinct.setdefault(s, []).append(k)
    names = list(distinct)
    for i, s in enumerate(names):
        for x in s:
            holding[x].append(i)
    shared = Counter(pair for ids in holding.values() for pair in combinations(ids, 2))
    similar = [(i, j) for (i, j), c in shared.items() if 9 * c >= 4 * (len(names[i]) + len(names[j]))]
    pairs = [(distinct[names[i]][0], distinct[names[j]][0]) for i, j in similar] + [(k[0], x) for k in distinct.values() for x in k[1:]]
    caught = sum(a in found and b in found and found[a] == found[b] for a, b in pairs)
    assert len(similar) >= 5 and caught >= 0.99 * len(pairs) and all(found[k[0]] == found[x] for k in distinct.values() for x in k[1:])
    # Nothing else is joined: the operator's classes never cut across those of the exact pairs.
    root = list(range(len(names)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in similar:
        root[find(i)] = find(j)
    number = {k: i for i, s in enumerate(names) for k in distinct[s]}
    exact = defaultdict(set)
    for k, r in found.items():
        if k in number:
            exact[r].add(find(number[k]))
    assert all(len(x) == 1 for x in exact.values())


@pytest.mark.parametrize("keys", [substring_dedup.KEYS, 0])
def test_every_long_repeat_is_covered(spark, monkeypatch, keys):
    """Every 50 words in a row that occur twice in the driver's smallest table, by brute force; also where nothing may be broadcast."""
    monkeypatch.setattr(substring_dedup, "KEYS", keys)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: WORD.findall(r.text or "") for r in df.collect()}
    seen = defaultdict(list)
    for d in sorted(texts):
        for i in range(len(texts[d]) - 49):
            seen[tuple(texts[d][i : i + 50])].append((d, i))
    listed, gone = defaultdict(set), defaultdict(set)
    for r in substring_dedup.passages(spark, df).collect():
        listed[r.id] |= set(range(r.start, r.start + r.n_words))
        if r.removed:
            gone[r.id] |= set(range(r.start, r.start + r.n_words))
    later = total = 0
    for at in seen.values():
        for k, (d, i) in enumerate(at if len(at) > 1 else []):
            assert listed[d] >= set(range(i, i + 50)), (d, i)
            if k and d != at[0][0]:
                total += 1
                later += gone[d] >= set(range(i, i + 50))
    assert total > 100 and later >= 0.99 * total
    # A text that shares no 15 words with any other, nor with itself, is left alone.
    short = defaultdict(set)
    for d, w in texts.items():
        for i in range(len(w) - 14):
            short[tuple(w[i : i + 15])].add((d, i))
    single = set(texts) - {d for x in short.values() if len(x) > 1 for d, _ in x}
    assert len(single) > 10 and len(single & set(listed)) <= 0.1 * len(single)


def test_passages_with_nul_and_clashing_names(spark):
    passage = _bare(6000, 60)
    head = ["a\0", "\0", "b\0c", *_bare(6001, 20)]
    texts = [" ".join([*_bare(6002, 30), *passage]), " ".join([*head, *passage, *_bare(6003, 30)]), None, ""]
    names = ["id", "th", "gone", "mark", "bucket", "bit", "bits", "_id", "_th", "start", "ID_"]
    df = spark.createDataFrame([(i, t, *names) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    out = substring_dedup.drop_passages(spark, df)
    assert out.columns == [*df.columns, "n_removed_words"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].n_removed_words for i in range(4)] == [0, 60, 0, 0] and got[0].text == texts[0] and got[2].text is None
    assert got[1].text.split() == [*head, *_bare(6003, 30)] and all(got[1][c] == c for c in names)


def test_marks_miss_no_key(spark):
    from pyspark.sql import functions as F

    from cartolith.llm._common import with_mark

    rows = spark.range(20000).select("id", (F.col("id") % 7).alias("th"), F.lit("x").alias("bits"))
    keys = rows.filter("id % 10 = 3").select("id", "th")
    out = with_mark(rows, keys, ["id", "th"])
    assert out.columns == ["id", "th", "bits", "_mark"]
    assert out.filter("id % 10 = 3 AND _mark").count() == 2000 and out.filter("id % 10 != 3 AND _mark").count() < 40
    assert with_mark(rows, keys.limit(0), ["id", "th"]).filter("_mark").count() == 0


def test_runs_in_threads_keep_their_tables(spark):
    """The run of one thread, which ends first, takes no tables of the other's."""
    from threading import Barrier, Thread

    from cartolith.llm._common import materialize, scratch_of_run

    both, seen = Barrier(2, timeout=120), {}

    def work(n):
        with scratch_of_run(spark):
            both.wait()
            df = materialize(spark, spark.range(n), "t")
            both.wait()
            if n == 5:
                both.wait()
                seen[n] = df.count()
            path = df.inputFiles()[0]
        if n == 7:
            seen[n] = path
            both.wait()

    threads = [Thread(target=work, args=(n,)) for n in (5, 7)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert seen[5] == 5 and seen[7].startswith("file:")
    with pytest.raises(Exception):
        spark.read.parquet(seen[7]).count()
