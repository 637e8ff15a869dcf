"""Chat formatting at token level.

A turn is encoded in separate segments: the role, and the text with control strings
escaped.  Reserved ids, which no encoded text can contain, are spliced between segments;
the loss mask of a turn follows from the segments' lengths by prefix sums.  Turns are
encoded where they lie; only ids travel, to be put in order of turn by conversation.

Template (reserved ids lie above the vocabulary; shown as text when a conversation is
rendered): ``<s>[INST]`` role ``[/INST]`` text ``</s>`` for each turn.  Inside texts and
roles a control string gets a backslash after its first character (one more if it has some
already), so rendered text splits at control strings only where the template put them, and
unescaping is exact.  The loss covers the texts of ``assistant`` turns and nothing else.

Edge cases: a null text or role counts as empty; turns of a conversation are ordered by
turn, then role and text, nulls first; repeated rows are turns of their own; rows with a
null ``conv_id`` form one conversation; an empty table gives no rows; further columns are
dropped.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._chunks import slices
from ._common import small_batches, table
from .bpe import RankBpe, read_tokenizer
from .token_orc import shared_tokenizer

#: Control strings in the order of their reserved ids, which follow the vocabulary.
CONTROLS = ("<s>[INST]", "[/INST]", "</s>")
#: Strings to escape inside texts: every marker of the template, and the vocabulary's own.
MARKERS = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
_ESCAPE = re.compile("|".join(re.escape(m[0]) + r"(?=\\*" + re.escape(m[1:]) + ")" for m in MARKERS))
_UNESCAPE = re.compile("|".join("(?<=" + re.escape(m[0]) + r")\\(?=\\*" + re.escape(m[1:]) + ")" for m in MARKERS))
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text)


def mask_of(lengths: np.ndarray, under_loss: np.ndarray) -> np.ndarray:
    """The loss mask of spliced segments, from their lengths, by prefix sums of its edges."""
    ends = np.cumsum(lengths)
    edges = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    np.add.at(edges, ends[under_loss] - lengths[under_loss], 1)
    np.add.at(edges, ends[under_loss], -1)
    return np.cumsum(edges[:-1]).astype(bool)


def format_turns(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """``conv_id, turn, role, text, ids, mask``: each turn's ids (packed) and loss mask (a byte an id)."""
    spark = turns.sparkSession
    small_batches(spark)
    encoder = shared_tokenizer(spark, tokenizer_path)
    first = vocabulary_size(tokenizer_path)
    marks = [(first + i).to_bytes(4, "little") for i in range(len(CONTROLS))]

    def run(batches):
        encode = encoder()
        for batch in batches:
            roles = [r or "" for r in batch.column("role").to_pylist()]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices(texts):
                head = encode.encode([escape(r) for r in roles[a:b]])
                body = encode.encode([escape(t) for t in texts[a:b]])
                ids, masks = [], []
                for role, h, x in zip(roles[a:b], head, body):
                    segments = (marks[0], h, marks[1], x, marks[2])
                    ids.append(b"".join(segments))
                    lengths = np.array([len(s) // 4 for s in segments])
                    masks.append(mask_of(lengths, np.array([False, False, False, role == LOSS_ROLE, False])).tobytes())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), pa.array(masks, pa.binary())], [*part.schema.names, "ids", "mask"])

    rows = turns.select("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, rows.select("*", F.lit(b"").alias("ids"), F.lit(b"").alias("mask")).schema)


def vocabulary_size(tokenizer_path: str) -> int:
    data = json.loads(read_tokenizer(tokenizer_path))
    return max([*data["model"]["vocab"].values(), *(t["id"] for t in data.get("added_tokens", []))]) + 1


class Reader:
    """Reads a conversation's turns back from its ids and mask, a turn at a time."""

    def __init__(self, tokenizer_json: str):
        self.bpe = RankBpe(tokenizer_json)
        self.first = len(self.bpe.token_bytes)

    def turns(self, ids: np.ndarray, mask: np.ndarray):
        """(role, text, text under the mask, characters as rendered) for each turn."""
        at = np.flatnonzero(ids >= self.first)
        kinds = ids[at] - self.first
        if len(at) % 3 or (kinds.reshape(-1, 3) != np.arange(3)).any():
            raise ValueError("reserved ids are not in the template's order")
        text = lambda a, b: self.bpe.decode(ids[a:b].astype("<u4").tobytes())
        for a, b, c in at.reshape(-1, 3).tolist():
            role, body = text(a + 1, b), text(b + 1, c)
            under = mask[a : c + 1]
            loss = self.bpe.decode(ids[a : c + 1][under].astype("<u4").tobytes())
            yield unescape(role), unescape(body), unescape(loss), len(role) + len(body) + sum(map(len, CONTROLS))


_READERS: dict = {}


def conversation_digests(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Read formatted conversations back, per conversation: counts and digests.

    Rows of a conversation come together and in order by a sorted shuffle; a task streams
    over them and holds one turn at a time, so a conversation of any length fits.
    """
    spark = formatted.sparkSession
    source = read_tokenizer(tokenizer_path)
    key, shared = hashlib.md5(source.encode()).hexdigest(), spark.sparkContext.broadcast(source)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        if key not in _READERS:
            _READERS.clear()
            _READERS[key] = Reader(shared.value)
        reader, none = _READERS[key], object()
        current, state = none, None

        def new():
            return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

        def row():
            return [current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for batch in batches:
            done = []
            for conv, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("ids").to_pylist(), batch.column("mask").to_pylist()):
                if current is none or conv != current:
                    if current is not none:
                        done.append(row())
                    current, state = conv, new()
                for role, text, loss, n in reader.turns(np.frombuffer(ids, "<u4").astype(np.int64), np.frombuffer(mask, bool)):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                    state[4] += n
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], schema=arrow)
        if current is not none:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(), arrow.types)], schema=arrow)

    arrow = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = formatted.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", "ids", "mask").repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "mask")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").select(*names)


def assemble(formatted: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``conv_id, part, ids, mask``: turns spliced in order, whole turns of at most ``most`` ids a part.

    Parts follow from running sums of the turns' lengths over a sorted shuffle, so what one
    row holds is bounded (a longer turn is a part of its own) however long a conversation is.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = formatted.withColumn("end", F.sum(F.octet_length("mask")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("part", F.floor((F.col("end") - 1) / most))
    parts = placed.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "ids", "mask"))).alias("t"))
    join = lambda c: F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x[c])), ""))
    return parts.select("conv_id", "part", join("ids").alias("ids"), join("mask").alias("mask"))


def op2_chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT CAST(-1 AS BIGINT) AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return conversation_digests(format_turns(turns.unionByName(extra), path), path)


_MARKED = r"(<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*\|endoftext\|>)"
OP2_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + len(regexp_extract_all(role, '{_MARKED}')) + length(text) + len(regexp_extract_all(text, '{_MARKED}')) + {sum(map(len, CONTROLS))})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
