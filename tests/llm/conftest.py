import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "so", "ti", "va") for b in ("dan", "fel", "gor", "hin", "jul", "kem", "lop")]


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    out = []
    while len(out) < n:
        k = r.randrange(4, 14)
        out += [r.choice(WORDS) + r.choice(WORDS)[:4] for _ in range(k)]
        out[-1] += r.choice((".", ",", ".\n"))
    return " ".join(out[:n]).replace("\n ", "\n")


def corpus() -> list[tuple]:
    """Plain, equal, near, short, blank and null texts; repeated rows and ids; null ids; a very long text."""
    rows = [(i, prose(i, 120 + 7 * i), ("en", "de", None)[i % 3], f"s{i % 4}") for i in range(12)]
    base = prose(3, 141)
    for i in range(20, 26):  # near copies: one word differs in each
        w = base.split(" ")
        w[i] = "changed" + str(i)
        rows.append((i, " ".join(w), "en", "near"))
    rows += [(30, base, "en", "copy"), (31, base, "en", "copy"), (31, base, "en", "copy")]
    rows += [(40, None, "en", None), (41, "", None, "x"), (42, " \n\t\n ", "en", "x"), (43, "four words are here", "de", "x"), (44, "four words are here", "de", "x"), (45, "word", "en", "x")]
    rows += [(None, prose(99, 90), "en", "x"), (None, prose(99, 90), "en", "x"), (None, None, None, None)]
    rows += [(46, prose(46, 60000), "en", "long"), (47, "x" * 3000, "en", "x"), (48, "é😀 ñ　日本 <|endoftext|>  two  spaces\r\n", "en", "x")]
    passage = prose(500, 70)
    for i in range(50, 54):
        rows.append((i, prose(i, 60) + " " + passage + " " + prose(i + 100, 60), "en", "passage"))
    three = "\n".join(prose(700 + i, 9).replace("\n", " ") for i in range(3))
    for i in range(60, 63):
        rows.append((i, f"{prose(i, 10)}\n{three}\n{prose(i + 9, 12)}", "fr", "lines"))
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """The edge cases as a written table of several files."""
    path = str(tmp_path_factory.mktemp("llm") / "documents.parquet")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3, "source").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def made(n, seed):
    """Good prose and two kinds of junk, labelled."""
    import random

    r, rows, labels = random.Random(seed), [], []
    for i in range(n):
        t, good = prose(seed * 100000 + i, 60 + i % 40), i % 4 != 0
        if not good:
            t = " ".join(w + r.choice(("###", "$$$")) for w in t.split()) if i % 8 else " ".join(w.upper() + "!!" for w in t.split())
        rows.append((i, t, "en" if i % 3 else "de", "s", len(t)))
        labels.append((i, int(good), 0))
    return rows, labels


@pytest.fixture(scope="session")
def labelled(spark, tmp_path_factory):
    rows, labels = made(3000, 1)
    for i in range(0, 300, 3):  # copies, some of them with the other label
        rows.append((5000 + i, rows[i][1], "fr", "s", rows[i][4]))
        labels.append((5000 + i, labels[i][1] if i % 2 else 1 - labels[i][1], 0))
    d = str(tmp_path_factory.mktemp("labelled"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    labels += [(5, 1, 0), (6, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, 0), (9, 3, 0), (999999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d
