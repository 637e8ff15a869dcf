"""Token ids as ORC: integer run-length encoding, row indexes and Bloom filters.

Documents are range-partitioned by id before anything is encoded, so each output file
holds one contiguous range in ascending order, and Spark's ORC writer gives stripes with
run-length encoded integers, row-group indexes and a Bloom filter on ``doc_id``.  A
lookup of ids prunes files, stripes and row groups by these; scans read stripes in
parallel.  Each row also holds its file's number and the ids before it in that file, so
the position among all ids needs only the totals of the files, one small row each.

Edge cases: a null text counts as empty (only the end id); null ids come first; rows
with an equal ``doc_id`` are ordered by text and each keeps its row; an empty table gives
an empty dataset; further columns of the input are not written.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._chunks import PackedEncoder, slices
from ._common import broadcast_if_small, materialize, scratch_path, small_batches, table
from .bpe import read_tokenizer

END_ID = 2
SCHEMA = "doc_id long, part int, before long, n_tokens long, ids array<int>"

#: Chunks that are encoded together, those that white space keeps from it, and those that any pattern leaves whole:
#: Latin letters (of the first Unicode version, so all tables of letters agree), with a space before them or none.
LINES = 64
_NO_LINE = re.compile(r".\s|^[^\S ]|^ ?$", re.S)
_LETTERS = re.compile("(?: ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+)").fullmatch

_LOADED: dict = {}


def library_encoder(key: str, source: str) -> PackedEncoder:
    """The tokenizers library behind a table of chunks; one for each worker process.

    Chunks are encoded by themselves only if the file's pre-tokenizer allows it (byte
    level, no prefix space, no normalizer, no template); else whole texts are encoded.
    """
    if key not in _LOADED:
        # A task has one core; the library's threads only wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        data = json.loads(source)
        tokenizer = Tokenizer.from_str(source)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        pre = data.get("pre_tokenizer") or {}
        apart = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not data.get("normalizer") and not data.get("post_processor")

        def each(parts: list[str]) -> list[bytes]:
            return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

        def by_lines(library, lines: list[str], most: int) -> dict[str, bytes]:
            """Chunks go to the library some at a time, one a line; the line feeds' ids tell them apart."""
            out, some = {}, [lines[i : i + most] for i in range(0, len(lines), most)]
            for chunk, e in zip(some, library.encode_batch_fast(["\n".join(x) for x in some], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                raw, ends = ids.tobytes(), (4 * np.flatnonzero(ids == feed[0])).tolist()
                out.update(zip(chunk, [raw[a:b] for a, b in zip([0, *(x + 4 for x in ends)], [*ends, len(raw)], strict=True)], strict=True))
            return out

        feed = tokenizer.encode("\n", add_special_tokens=False).ids
        # The same model behind a pre-tokenizer that cuts at line feeds only.
        lines_only = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"String": "\n"}, "behavior": "Isolated", "invert": False}, {**pre, "use_regex": False}]}
        letters = Tokenizer.from_str(json.dumps(data | {"pre_tokenizer": lines_only, "truncation": None, "padding": None})) if apart else tokenizer

        def encode(parts: list[str]) -> list[bytes]:
            whole, lines, rest = [], [], []
            for p in parts:
                (rest if len(feed) != 1 else whole if _LETTERS(p) else rest if _NO_LINE.search(p) else lines).append(p)
            out = by_lines(letters, whole, 8 * LINES) | by_lines(tokenizer, lines, LINES)
            out.update(zip(rest, each(rest)))
            return [*map(out.__getitem__, parts)]

        encoder = PackedEncoder(encode, {t["content"]: t["id"] for t in data.get("added_tokens", [])} if apart else {})
        if not apart:
            encoder.encode = each
        _LOADED.clear()
        _LOADED[key] = encoder
    return _LOADED[key]


def shared_tokenizer(spark: SparkSession, tokenizer_path: str):
    """A function for tasks that returns the encoder; the file is broadcast (bounded by the vocabulary)."""
    source = read_tokenizer(tokenizer_path)
    key, shared = hashlib.md5(source.encode()).hexdigest(), spark.sparkContext.broadcast(source)
    return lambda: library_encoder(key, shared.value)


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = END_ID, files: int | None = None) -> None:
    """Write ``SCHEMA`` in ascending ``doc_id`` order as ORC below ``path``, one file for each range."""
    spark = docs.sparkSession
    small_batches(spark)
    encoder = shared_tokenizer(spark, tokenizer_path)
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encode, part, before = encoder(), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices(texts):
                packed = [p + end for p in encode.encode(texts[a:b])]
                sizes = np.array([len(p) // 4 for p in packed], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(before + offsets[:-1]), pa.array(sizes), ids],
                    ["doc_id", "part", "before", "n_tokens", "ids"],
                )
                before += int(offsets[-1])

    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(run, SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(16 << 20))
        .option("orc.compress", "zstd")
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def lookup_ids(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents: the filter reaches the ORC reader, which prunes by index and Bloom filter."""
    return read_ids(spark, path).filter(F.col("doc_id").isin(list(doc_ids)))


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part, base``: ids in all files before; from the count columns alone, a row for each file."""
    totals = read_ids(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    return totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))


def ids_digests(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: where each document's ids start, their number and their CRC-32."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<i4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("before"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "part", "before", "n_tokens", "ids_crc32"],
            )

    small_batches(spark)
    rows = read_ids(spark, path).mapInArrow(run, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")
    starts = broadcast_if_small(materialize(spark, file_starts(spark, path), "orc-starts"))
    return rows.join(starts, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op6_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "orc-ids")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return ids_digests(spark, path)
