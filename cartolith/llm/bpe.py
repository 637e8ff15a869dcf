"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word is an array of parts (first one per byte) beside an array with the merge
rank of each pair of neighbours.  The smallest rank is looked for, the boundary
between its two parts is deleted and the ranks next to the new part are refreshed,
until no neighbouring parts merge.  Words of equal length are stacked, so each step
is a few numpy calls over many words.  Words beyond ``SHORT`` bytes, where scanning
would be quadratic, merge through a heap with the same order.

Edge cases: a null text counts as empty and has no ids; ``<|endoftext|>`` and other
added tokens are one id wherever they stand, as the library takes them; repeated rows
each give a row; bytes that are not UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._chunks import PackedEncoder, slices
from ._common import small_batches, table

SHORT = 64
#: The public byte-level pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.iinfo(np.int32).max


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class RankBpe:
    """Vocabulary and merges of a byte-level BPE tokenizer file, as numpy arrays."""

    def __init__(self, tokenizer_json: str):
        data = json.loads(tokenizer_json)
        model, pre = data["model"], data.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or data.get("normalizer"):
            raise ValueError("a byte-level BPE without normalizer and prefix space is needed")
        vocab, alphabet = model["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token if c in alphabet) if token not in self.special else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.split = regex.compile(PATTERN)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def _stack(self, raw: list[bytes], at: np.ndarray, width: int, out: list) -> None:
        ids = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)].reshape(-1, width)
        ranks = self.ranks(ids[:, :-1], ids[:, 1:])
        while len(at):
            if ids.shape[1] == 1:
                done = np.ones(len(at), bool)
            else:
                j = ranks.argmin(1)
                rows = np.arange(len(at))
                best = ranks[rows, j]
                done = best == NONE
            if done.any():
                packed, step = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, i in enumerate(at[done].tolist()):
                    out[i] = packed[k * step : (k + 1) * step]
                if done.all():
                    return
                go = ~done
                at, ids, ranks, j, best = at[go], ids[go], ranks[go], j[go], best[go]
                rows = np.arange(len(at))
            n, width = ids.shape
            ids[rows, j] = self.merged[best]
            ids = ids[np.arange(width) != (j + 1)[:, None]].reshape(n, width - 1)
            ranks = ranks[np.arange(width - 1) != j[:, None]].reshape(n, width - 2)
            some = rows[j > 0]
            ranks[some, j[some] - 1] = self.ranks(ids[some, j[some] - 1], ids[some, j[some]])
            some = rows[j < width - 2]
            ranks[some, j[some]] = self.ranks(ids[some, j[some]], ids[some, j[some] + 1])

    def _long(self, raw: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(raw, np.uint8)]
        first = self.ranks(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(raw)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        one = lambda a, b: int(self.ranks(np.array([a]), np.array([b]))[0])
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.merged[r]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := one(ids[i], ids[after[i]])) != NONE:
                    heapq.heappush(heap, (x, i, ids[i], ids[after[i]]))
            if (p := before[i]) >= 0 and (x := one(ids[p], ids[i])) != NONE:
                heapq.heappush(heap, (x, p, ids[p], ids[i]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word, merges within it only."""
        out: list = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for width in np.unique(size).tolist():
            at = np.flatnonzero(size == width)
            if width > SHORT:
                for i in at.tolist():
                    out[i] = self._long(words[i])
            elif width:
                self._stack([words[i] for i in at.tolist()], at, width, out)
        return out

    def encode_chunks(self, parts: list[str]) -> list[bytes]:
        """Packed ids of each chunk: its pieces by the pattern, each distinct piece merged once."""
        pieces = [self.split.findall(p) for p in parts]
        distinct = list(set().union(*pieces))
        known = dict(zip(distinct, self.encode_words([p.encode() for p in distinct])))
        return [known[p[0]] if len(p) == 1 else b"".join(map(known.__getitem__, p)) for p in pieces]

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; ids outside the vocabulary stand for nothing."""
        ids = np.frombuffer(packed, "<u4")
        ids = ids[ids < len(self.token_bytes)].tolist()
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


#: Chunks that a worker keeps, and characters that it encodes at once: together some 150 MB at most.
KNOWN, SLICE = 300_000, 1 << 20
_LOADED: dict = {}


def _loaded(key: str, source: str) -> tuple[RankBpe, PackedEncoder]:
    """One tokenizer and chunk table for each worker process; tasks that follow reuse them."""
    if key not in _LOADED:
        _LOADED.clear()
        bpe = RankBpe(source)
        _LOADED[key] = bpe, PackedEncoder(bpe.encode_chunks, bpe.special, KNOWN)
    return _LOADED[key]


def read_tokenizer(path: str) -> str:
    """A tokenizer file, read once on the driver; it is broadcast, so workers need no path."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, tokenizer_path: str, *, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) and the text decoded from them.

    Columns of ``docs`` that already have these names are replaced.  Needs no shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = read_tokenizer(tokenizer_path)
    key, shared = hashlib.md5(source.encode()).hexdigest(), spark.sparkContext.broadcast(source)
    kept = docs.drop(ids, decoded)
    schema = kept.select("*", F.lit(b"").alias(ids), F.lit("").alias(decoded)).schema

    def run(batches):
        for batch in batches:
            bpe, encoder = _loaded(key, shared.value)
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for a, b in slices(texts, SLICE):
                packed = encoder.encode(texts[a:b])
                back = [bpe.decode(p) for p in packed]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(packed, pa.binary()), pa.array(back, pa.string())], [*part.schema.names, ids, decoded])

    return kept.mapInArrow(run, schema)


def token_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document: number of ids and digests of the ids and of the decoded text."""
    done = encode_decode(docs.select("doc_id", "text"), tokenizer_path)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op3_bpe_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
