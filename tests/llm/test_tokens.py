"""BPE, token files and chat formatting against the tokenizers library and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import corpus
from tokenizers import Tokenizer

from cartolith.llm import bpe, chat_format, token_orc
from cartolith.llm._common import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
BPE = bpe.RankBpe(bpe.read_tokenizer(PATH))
ENCODERS = [bpe.PackedEncoder(BPE.encode_chunks, BPE.special), token_orc.library_encoder("t", bpe.read_tokenizer(PATH))]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def check(texts):
    for encoder in ENCODERS:
        for t, packed in zip(texts, encoder.encode(texts)):
            got = np.frombuffer(packed, "<u4").tolist()
            assert got == ids(t), ascii(t)
            assert BPE.decode(packed) == LIBRARY.decode(got, skip_special_tokens=False) == t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_any_text(texts):
    check(texts)


def test_white_space_marks_and_special_strings():
    r, alphabet = random.Random(4), [*" \n\t\r　\x1c\x85\x00'.,é日😀", "  ", "\n\n", "'ll", "ab", "<|endoftext|>", "12"]
    check(["".join(r.choice(alphabet) for _ in range(r.randrange(30))) for _ in range(3000)])


def test_long_words_and_random_order_of_merges():
    check(["ab" * 400, "the" * 100 + "x" * 129, "é" * 200, "a" * 64, "a" * 65, "=" * 1000])


def test_batches_of_plain_and_other_texts():
    r = random.Random(8)
    parts = [" and", " the", "\n", "word", "ß", " Öl,", " x.", "12", "\xa0", "\u2019", "\u2009", " ", "\x1f", "é" * 20, " Ωmega", " ªº", " <|endoftext|>"]
    check(["", *("".join(r.choice(parts[: 8 if i % 2 else None]) for _ in range(r.randrange(60))) for i in range(600)), ""])


def test_letters_are_whole_to_the_pattern():
    """Each letter that goes past the pattern, and the next code points, with and without a space."""
    check([f"a{chr(c)}b {chr(c)}{chr(c)} x{chr(c)}" for c in range(0xA1, 0x250)])


def test_distinct_chunks_of_a_batch_are_looked_up_once():
    texts = ["some words that come again and again in all of these texts, and no others\n" * 200 + "end"] * 5
    for encoder in ENCODERS:
        for _ in range(2):  # the first run learns
            asked = []
            encoder.known = type("Known", (dict,), {"__getitem__": lambda self, k: asked.append(k) or dict.__getitem__(self, k), "get": lambda self, k: asked.append(k) or dict.get(self, k)})(encoder.known)
            encoder.encode(texts)
            encoder.known = dict(encoder.known)
        assert len(asked) < 100  # of 16,000 chunks


def test_decode_replaces_broken_bytes():
    raw = bytes([0xE6, 0x97, 0x20, 0xFF, 0x41])
    packed = BPE.byte_ids[list(raw)].astype("<u4").tobytes()
    assert BPE.decode(packed) == LIBRARY.decode(BPE.byte_ids[list(raw)].tolist(), skip_special_tokens=False)


def test_digests_of_all_documents(docs):
    want = sorted((str(d), len(i := ids(t or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in corpus())
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(docs, PATH).collect())
    assert got == want


def test_encode_replaces_clashing_columns(docs, no_docs):
    out = bpe.encode_decode(docs.withColumnRenamed("source", "ids").withColumnRenamed("lang", "decoded"), PATH)
    assert out.columns == ["doc_id", "text", "n_chars", "ids", "decoded"] and out.count() == docs.count()
    assert bpe.encode_decode(no_docs, PATH).count() == 0


@pytest.mark.parametrize("files", [1, 5])
def test_orc_files(spark, docs, files):
    path = scratch_path(spark, "t")
    token_orc.write_ids(docs, path, PATH, files=files)
    got = token_orc.ids_digests(spark, path).collect()
    start, want = 0, []
    for d, t in sorted(((d, t) for d, t, *_ in corpus()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        i = [*ids(t or ""), token_orc.END_ID]
        want.append((d, start, len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
        start += len(i)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    some = token_orc.lookup_ids(spark, path, [5, 43])
    assert sorted(r.doc_id for r in some.collect()) == [5, 43]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_orc_of_nothing(spark, no_docs):
    path = scratch_path(spark, "t")
    token_orc.write_ids(no_docs, path, PATH)
    assert token_orc.ids_digests(spark, path).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<", "s", ">", "/", "\\", "[", "]", "I", "N", "S", "T", "<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", " "]), max_size=30).map("".join))
def test_escape_is_exact_and_leaves_no_marker(text):
    out = chat_format.escape(text)
    assert chat_format.unescape(out) == text and not any(m in out for m in chat_format.MARKERS)


def test_mask_by_prefix_sums():
    got = chat_format.mask_of(np.array([2, 0, 3, 1]), np.array([False, True, True, False]))
    assert got.tolist() == [False, False, True, True, True, False]
    assert chat_format.mask_of(np.array([0]), np.array([True])).tolist() == []


CHATS = [(1, 0, "user", "hi </s> [INST] \\"), (1, 1, "assistant", "yes <\\s> ok"), (1, 1, "assistant", "yes <\\s> ok"), (1, 2, None, None), (2, 5, "assistant", None), (2, 1, "system", "  two\n\n"),
         (None, 0, "user", "no id"), (3, None, "user", "b"), (3, None, "user", "a"), (4, 0, "[INST]", "a role that is a marker"), (5, 0, "assistant", "long " * 9000)]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame([(*c, "extra", 1) for c in CHATS], "conv_id long, turn long, role string, text string, ids string, mask int")
    formatted = chat_format.format_turns(turns, PATH)
    got = {r.conv_id: r for r in chat_format.conversation_digests(formatted, PATH).collect()}
    by = {}
    for c in CHATS:
        by.setdefault(c[0], []).append(c)
    low = lambda x: (x is not None, x if x is not None else "")
    for conv, rows in by.items():
        rows.sort(key=lambda c: (c[1] is not None, c[1] or 0, low(c[2]), low(c[3])))
        said = "".join(f"{c[2] or ''}\n{c[3] or ''}\n" for c in rows)
        loss = "".join(c[3] or "" for c in rows if c[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(rows), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len(by)
    whole = {r.conv_id: r for r in chat_format.assemble(formatted).collect()}
    reader = chat_format.Reader(bpe.read_tokenizer(PATH))
    back = [*reader.turns(np.frombuffer(whole[1].ids, "<u4").astype(np.int64), np.frombuffer(whole[1]["mask"], bool))]
    assert [(a, b) for a, b, *_ in back] == [("user", "hi </s> [INST] \\"), ("assistant", "yes <\\s> ok"), ("assistant", "yes <\\s> ok"), ("", "")]
    parts = sorted(chat_format.assemble(formatted, most=12).filter("conv_id = 1").collect(), key=lambda r: r.part)
    assert len(parts) > 1 and b"".join(r.ids for r in parts) == whole[1].ids and b"".join(r["mask"] for r in parts) == whole[1]["mask"]
    assert chat_format.conversation_digests(chat_format.format_turns(turns.limit(0), PATH), PATH).count() == 0
