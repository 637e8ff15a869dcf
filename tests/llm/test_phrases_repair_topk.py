"""Collocations, conversation repair and exact top-k against plain Python."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.conftest import corpus, prose

from cartolith.llm import collocations, conversation_repair, exact_topk

# ---- collocations


def plain_phrases(rows, least, top):
    count, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in count.items():
        frequent, rows = {p: a for p, a in c.items() if len(p) > 1 and a >= least}, []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), " ".join(p), a, c[p[:k]], c[p[k:]], n[lang], score))
        out += [(lang, i, *r[3:]) for i, r in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def phrase_rows():
    r = random.Random(4)
    rows = [(lang, t) for _, t, lang, *_ in corpus()]
    words = ["New", "york", "City", "of", "the", "é", "#", "a b", "日本"]
    rows += [(r.choice(("en", "de", None, "und")), "".join(r.choice(words) + r.choice((" ", " ", "\t", "  ", ". ", ",\n")) for _ in range(60))) for _ in range(80)]
    rows += [("en", "a a a a a a a a a a a a"), ("en", None), (None, ""), ("xx", " . \n"), ("en", "\r\x0b\x0c new york new york")]
    return rows


@pytest.mark.parametrize("small, top", [({}, 2000), ({"HELD": 50, "WORDS": 9, "STEP": 5, "OUT_BYTES": 40, "LANGS": 1, "WORD_BYTES": 60}, 20)])
def test_phrases_against_plain_counts(spark, monkeypatch, small, top):
    for name, value in small.items():
        monkeypatch.setattr(collocations, name, value)
    docs = spark.createDataFrame(phrase_rows(), "lang string, text string").selectExpr("*", "1 AS n", "'x' AS phrase", "0 AS rank")
    got = collocations.collocations(spark, docs.repartition(3), top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    want = plain_phrases(phrase_rows(), 10, top)
    assert sorted(map(tuple, got)) == want and len(want) > 30


def test_bits_of_a_level_are_found_again(spark):
    level = spark.createDataFrame([("en", "the"), ("en", "é"), ("de", "x" * 500)], "lang string, phrase string")
    bits = np.frombuffer(collocations.bitmap(level), np.uint8)
    en, de = collocations.Counts("en", 2, bits), collocations.Counts("de", 2, bits)
    list(en.add(collocations.tokens(f"The é the de {'x' * 500} é  the.\tthe".encode())))
    list(de.add(collocations.tokens(f"the the {'x' * 500} {'x' * 500} the".encode())))
    got = [r for c in (en, de) for b in c.rows() for r in zip(*[x.to_pylist() for x in b.columns])]
    assert sorted(got) == [("de", f"{'x' * 500} {'x' * 500}", 1), ("en", "the é", 1), ("en", "é the", 2)] and int(np.unpackbits(bits).sum()) == 3


@pytest.mark.parametrize("small", [{}, {"HELD": 50, "WORDS": 40, "STEP": 5, "OUT_BYTES": 40}, {"WORD_BYTES": 60}])
@pytest.mark.parametrize("k", [1, 2, 3])
def test_counts_handed_on_in_parts_add_up(monkeypatch, small, k):
    for name, value in small.items():
        monkeypatch.setattr(collocations, name, value)
    texts = [t for _, t in phrase_rows() if t and len(t) < 5000]
    all_bits, got = np.full(collocations.BITS // 8, 255, np.uint8), Counter()
    c = collocations.Counts("en", k, all_bits)
    batches = [b for t in texts for b in c.add(collocations.tokens(t.encode()))] + list(c.rows())
    for b in batches:
        for _, phrase, n in zip(*[x.to_pylist() for x in b.columns]):
            got[phrase] += n
    want = Counter()
    for t in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
            want[None] += len(w) if k == 1 else 0
    assert +got == +want and (not small or len(batches) > 10)


def test_products_beyond_64_bits(spark):
    t = lambda rows: spark.createDataFrame(rows, "lang string, phrase string, n long")
    a, l, r = 3_000_000_019, 3_000_000_021, 7_000_000_001
    got = collocations.scored([t([("en", "x", l), ("en", "y", r)]), t([("en", "x y", a)])], 2).first()
    assert (got.l, got.r, got.score) == (l, r, 1_000_000 * a * a // (l * r))


def test_phrases_of_nothing(spark, no_docs):
    assert collocations.collocations(spark, no_docs).collect() == []


# ---- conversations


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv] += []
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            out[conv] += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    for turns in out.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2].encode()))
    return out


def cheapest(turns):
    """Least (cost, audit) and its text, by a search over (turns read, roles written) in order of cost and audit."""
    seen, faults = set(), []
    for _, role, text in turns:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None)
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        state = (i, "" if not roles else ("s" if roles == "s" else roles[-1]))
        if state in done:
            continue
        done.add(state)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return faults, cost, audit, "\n".join(lines)
        if len(audit) > 3 * len(turns) + 3:
            continue
        go = lambda c, x, j, role, line: heapq.heappush(heap, (cost + c, audit + x, j, roles + role, lines + line)) if re.fullmatch("s?(ua)*u?", roles + role) else None
        for role in ("user", "assistant"):
            go(2, "I", i, role[0], (role + ":",))
        if i < len(turns):
            _, role, text = turns[i]
            go(3, "D", i + 1, "", ())
            if faults[i] in (None, "truncated"):
                more = faults[i] == "truncated"
                if role[:1] in ("s", "u", "a") and role:
                    go(more, "K", i + 1, role[0], (f"{role}:{text}",))
                for new in ("user", "assistant"):
                    go(2 + more, "R", i + 1, new[0], (f"{new}:{text}",))


def plain_repairs(rows):
    out = []
    for conv, turns in plain_damage(rows).items():
        faults, cost, audit, text = cheapest(turns)
        given = [t[0] for t in turns if t[0] is not None]
        gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def chat_rows():
    r = random.Random(7)
    text = lambda: r.choice(("Yes.", "No!", "cut off", "Why?\n ", " \t", "", None, "ok.", prose(r.randrange(9), 12) + "."))
    rows = []
    for conv in [*range(260), None]:
        for turn in range(r.randrange(1, 9)):
            rows.append((conv, r.choice((turn, turn, turn, turn + 5, None)), r.choice(("user", "assistant", "user", "assistant", "system", "tool", None, "sage", "u", "")), text()))
    rows += [(500, i, ("user", "assistant")[i % 2] if r.random() < 0.8 else r.choice(("system", "x", "user")), text()) for i in range(300)]
    rows += [(600, 3, "user", "Same."), (600, 3, "user", "Same."), (600, 3, "user", "Same."), (601, None, None, None)]
    rows += [(700, i, "user", "x" * 200_000 + ".") for i in range(2)]
    return rows


@pytest.mark.parametrize("chunk", [1, 3, 32])
def test_repairs_against_a_search(spark, monkeypatch, tmp_path, chunk):
    monkeypatch.setattr(conversation_repair, "CHUNK", chunk)
    df = spark.createDataFrame(chat_rows(), "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS code", "'x' AS part", "0 AS c")
    df.repartition(5).write.parquet(f"{tmp_path}/c.parquet")
    got = conversation_repair.repair_report(spark, spark.read.parquet(f"{tmp_path}/c.parquet"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_repairs(chat_rows())


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repair_report(spark, none).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "Yes.")], none.schema)
    assert conversation_repair.repair_report(spark, one).collect() == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_chunk_costs_agree_with_the_trace():
    r = random.Random(1)
    for _ in range(200):
        codes = bytes(r.randrange(16) for _ in range(r.randrange(1, 9)))
        costs, found = conversation_repair.chunk_costs(codes), conversation_repair.trace(codes, conversation_repair.AT_END, True)
        for e in range(4):
            assert found[e][0] == min(costs[4 * e + s] + conversation_repair.AT_END[s] for s in range(4) if costs[4 * e + s] >= 0)


# ---- top k


def plain_top(rows, k=10, every=100):
    ok = [(i, id_, [int(np.floor(1024 * x)) for x in map(float, v)]) for i, (id_, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q, a in ok:
        if q is not None and q % every == 0:
            all_ = sorted((-sum(x * y for x, y in zip(a, b)), c is not None, c or 0) for j, c, b in ok if j != i)
            out += [(q, n, c if known else None, -s) for n, (s, known, c) in enumerate(all_[:k], 1)]
    return sorted(out, key=repr)


def vector_rows(kind):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(8)]) for i in range(420)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]  # ties in numbers
    rows += [(200, rows[200][1]), (200, rows[201][1]), (-300, rows[5][1]), (None, rows[7][1]), (None, [0.5] * 8)]
    rows += [(2000, None), (2100, [1.0, None]), (2200, [float("nan")]), (2300, [float("inf"), 1.0]), (2400, []), (2500, [0.25]), (2501, [9.0] * 12)]
    if kind == "large":
        rows += [(3000, [1e5, -1e5] * 4), (3001, [1e5] * 8), (3100, [3e5] * 8), (3101, [2.5e5, 1e-3] * 4)]
    return rows


@pytest.mark.parametrize("kind, pass_bytes, bins, block", [("plain", 8 << 20, 256, 2 << 20), ("plain", 200, 4, 50), ("large", 8 << 20, 16, 1000)])
def test_top_k_against_all_scores(spark, monkeypatch, tmp_path, kind, pass_bytes, bins, block):
    for name, value in (("PASS_BYTES", pass_bytes), ("BINS", bins), ("SCORES", block)):
        monkeypatch.setattr(exact_topk, name, value)
    rows = vector_rows(kind)
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS row", "'x' AS v", "2 AS rank").repartition(3).write.parquet(f"{tmp_path}/e.parquet")
    got = exact_topk.top_k(spark, spark.read.parquet(f"{tmp_path}/e.parquet"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_top(rows)


def test_top_k_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert exact_topk.top_k(spark, spark.createDataFrame([], schema)).collect() == []
    assert exact_topk.top_k(spark, spark.createDataFrame([(100, [1.0]), (1, None)], schema)).collect() == []
    assert exact_topk.top_k(spark, spark.createDataFrame([(100, [1.0]), (1, [2.0]), (2, [-3.0])], schema)).collect() == [(100, 1, 1, 2 << 20), (100, 2, 2, -3 << 20)]
    huge = exact_topk.top_k(spark, spark.createDataFrame([(100, [1e300]), (1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")).collect()
    assert [r.vec_id for r in huge] == [1, 2] and huge[0].score == -huge[1].score == exact_topk.LIMIT
