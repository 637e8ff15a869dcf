"""Repair of the structure of conversations at least cost, by cost layers of state bitsets.

A sound conversation's role initials are ``(s?(ua)+)?``.  The grammar has four states (nothing
yet, after s, after u, after a); every edit leads from a state to one state only:

* keep a turn (0), give it the role that the grammar wants, user or assistant (2), delete it
  (3, required where it is blank or a duplicate), insert an empty turn of the wanted role (2);
  a truncated turn that stays costs 1 more.

For each cost 0, 1, 2, .. a layer holds a bitset of states for each turn; a layer follows from
the layers 1, 2, 3 below it by shifts and masks, and the first layer with the wanted state
gives the cost.  A trace over the layers takes the least initial (D, I, K, R) that still fits.

Conversations of any length are spread out: turns are sorted by range and cut into chunks of
``CHUNK``; 16-bit layers (4 entry states x 4 states) give each chunk's cost from state to
state; a stream over the small chunk rows of a conversation, last chunk first, gives the cost
to go at the chunk ends; chunks are traced from all four entry states, each by itself; a
stream in order picks the entry state.  Only the digest of the repaired text needs a
conversation's turns in order in one task, which streams over them.

Faults, the first counts: blank (no character but white space), duplicate (role and text of an
earlier turn), truncated (last such character not ``.``, ``!`` or ``?``).

Edge cases: a null counts as one space (in ``role``, ``text`` and in the damage key); turns
are in order of turn, then role and text, nulls first; repeated rows are turns of their own
(all but the first are duplicates); roles go by their first character, and an empty role is
illegal like any other initial; rows with null ``conv_id`` form one conversation; a
conversation without turns has zeros, an empty audit and the digest of an empty text; an
empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACES, materialize, small_batches, table

CHUNK = 32
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Codes of turns are initial (s, u, a, other) + 4 * fault (none, blank, duplicate, truncated).
#: Costs to go at the end of a conversation, by state.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: What a turn's script may hold: inserted user or assistant, kept, made user or assistant, deleted.
SCRIPT, LETTERS = "uakUA-", "IIKRRD"
START, S, U, A = 0x1111, 0x2222, 0x4444, 0x8888
_STEP = (2, 2, 3, 2)


def _kept(m: int, role: int) -> int:
    """States after keeping a turn, for each of four nibbles."""
    if role == 0:
        return (m & START) << 1
    if role == 1:
        return (m & START) << 2 | (m & S) << 1 | (m & A) >> 1
    return (m & U) << 1 if role == 2 else 0


def _added(m: int) -> int:
    """States after a turn of the role that the grammar wants."""
    return _kept(m, 1) | _kept(m, 2)


@lru_cache(1 << 15)
def chunk_costs(codes: bytes) -> tuple[int, ...]:
    """Cost from entry state to state after the last turn, 4 * entry + state; -1 where there is no way."""
    n = len(codes)
    target = 0x8421 | 0xCCCC | (2 if any(c in (0, 12) for c in codes) else 0)
    layers: list[list[int]] = []
    out = [-1] * 16
    while layers == [] or layers[-1][n] & target != target:
        c, now = len(layers), [0x8421]
        low = lambda k: layers[c - k] if c >= k else None
        one, two, three = low(1), low(2), low(3)
        for i in range(n + 1):
            m = now[0] if i == 0 else 0
            if one:
                m |= one[i]
            if i:
                code = codes[i - 1]
                role, fault = code & 3, code >> 2
                if three:
                    m |= three[i - 1]
                if fault == 0:
                    m |= _kept(now[i - 1], role)
                    if two:
                        m |= _added(two[i - 1])
                elif fault == 3:
                    if one:
                        m |= _kept(one[i - 1], role)
                    if three:
                        m |= _added(three[i - 1])
            if two and i < n:
                m |= _added(two[i])
            if i:
                now.append(m)
            else:
                now[0] = m
        layers.append(now)
        for k in range(16):
            if now[n] >> k & 1 and out[k] < 0:
                out[k] = c
    return tuple(out)


def _before_kept(m: int, role: int) -> int:
    """States from which keeping a turn leads into ``m`` (four bits)."""
    if role == 0:
        return m >> 1 & 1
    if role == 1:
        return 0b1011 if m & 4 else 0
    return 4 if role == 2 and m & 8 else 0


def _before_added(m: int) -> int:
    return (0b1011 if m & 4 else 0) | (4 if m & 8 else 0)


@lru_cache(1 << 15)
def trace(codes: bytes, to_go: tuple[int, ...], last: bool) -> tuple:
    """From each entry state: cost (of the chunk and what is to go), state after it, script of each turn."""
    n = len(codes)
    layers: list[list[int]] = []
    while not layers or layers[-1][0] != 15:
        c = len(layers)
        now = [0] * n + [sum(1 << s for s in range(4) if to_go[s] <= c)]
        for i in range(n - 1, -1, -1):
            role, fault = codes[i] & 3, codes[i] >> 2
            m = layers[c - 1][i] if c else 0
            if c >= DELETE:
                m |= layers[c - DELETE][i + 1]
            if c >= INSERT:
                m |= _before_added(layers[c - INSERT][i])
            extra = TRUNCATED if fault == 3 else 0
            if fault in (0, 3):
                if c >= extra:
                    m |= _before_kept((now if not extra else layers[c - extra])[i + 1], role)
                if c >= REROLE + extra:
                    m |= _before_added(layers[c - REROLE - extra][i + 1])
            now[i] = m
        layers.append(now)
    out = []
    for entry in range(4):
        c = next(c for c, x in enumerate(layers) if x[0] >> entry & 1)
        cost, state, i, scripts, script = c, entry, 0, [], ""
        while i < n:
            role, fault = codes[i] & 3, codes[i] >> 2
            extra, free, wanted = TRUNCATED if fault == 3 else 0, fault in (0, 3), _STEP[state]
            kept = _kept(1 << state, role).bit_length() - 1
            if c >= DELETE and layers[c - DELETE][i + 1] >> state & 1:
                c, step = c - DELETE, "-"
            elif c >= INSERT and layers[c - INSERT][i] >> wanted & 1:
                c, script, state = c - INSERT, script + ("u" if wanted == 2 else "a"), wanted
                continue
            elif free and kept >= 0 and c >= extra and layers[c - extra][i + 1] >> kept & 1:
                c, step, state = c - extra, "k", kept
            else:
                c, step, state = c - REROLE - extra, "U" if wanted == 2 else "A", wanted
            scripts.append(script + step)
            script, i = "", i + 1
        while last and state in (1, 2):
            state = _STEP[state]
            scripts[-1] += "u" if state == 2 else "a"
        out.append((cost, state, tuple(scripts)))
    return tuple(out)


def damaged(turns: DataFrame) -> DataFrame:
    """``nc, c`` (conversation), ``turn, role, text`` after the damage that each row's key gives."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    keyed = turns.select(*conversation(), "turn", shown("role").alias("role"), shown("text").alias("text"), d.alias("d")).filter("d <> 0")
    text = F.when(F.col("d") == 1, F.lit("")).when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("d") == 3, 2).otherwise(1)))
    return keyed.select("nc", "c", "turn", role.alias("role"), text.alias("text"), times.alias("_")).drop("_")


def conversation() -> list[Column]:
    id_ = F.col("conv_id").cast("long")
    return [id_.isNull().alias("nc"), F.coalesce(id_, F.lit(0).cast("long")).alias("c")]


def coded_turns(rows: DataFrame) -> DataFrame:
    """``nc, c, part, seq, idx, turn, role, text, code``: turns in order, in chunks.

    Turns are sorted by range, so one conversation may lie in several tasks; equal turns lie
    together, so of repeated rows the first is told from the others beside it.
    """
    spark = rows.sparkSession
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    letter = F.substring("role", 1, 1)
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    blank = F.length(F.translate("text", SPACES, "")) == 0
    code = initial + F.when(blank, 4).when(~last.isin(".", "!", "?"), 12).otherwise(0)
    at = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    rows = rows.select("*", code.cast("int").alias("code"), F.md5(F.concat(F.md5("role"), "text")).alias("same"), at.alias("at"))
    again = rows.groupBy("nc", "c", "same").agg(F.min("at").alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    rows = rows.join(again, ["nc", "c", "same"], "left").withColumn("later", F.coalesce(F.col("at") > F.col("first"), F.lit(False)))

    def run(batches):
        part, before, seq, idx = TaskContext.get().partitionId(), None, -1, 0
        for batch in batches:
            seqs, idxs, codes = [], [], []
            for *conv, turn, same, code, later in zip(*[batch.column(c).to_pylist() for c in ("nc", "c", "turn", "same", "code", "later")]):
                now = (*conv, turn, same)
                if before is None or before[:2] != now[:2] or idx + 1 == CHUNK:
                    seq, idx = seq + 1, 0
                else:
                    idx += 1
                if code >> 2 != 1 and (later or before == now):
                    code = code & 3 | 8
                seqs.append(seq)
                idxs.append(idx)
                codes.append(code)
                before = now
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("nc"), batch.column("c"), pa.array([part] * n, pa.int32()), pa.array(seqs, pa.int32()), pa.array(idxs, pa.int32()), *[batch.column(c) for c in ("turn", "role", "text")], pa.array(codes, pa.int32())],
                ["nc", "c", "part", "seq", "idx", "turn", "role", "text", "code"],
            )

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["nc", "c", F.asc_nulls_first("turn"), "role", "text"]
    ready = rows.select("nc", "c", "turn", "role", "text", "same", "code", "later").repartitionByRange(n, *order[:4], F.substring("text", 1, 16)).sortWithinPartitions(*order)
    schema = ready.select("nc", "c", *[F.lit(0).alias(x) for x in ("part", "seq", "idx")], "turn", "role", "text", "code").schema
    return ready.mapInArrow(run, schema)


def _stream(chunks: DataFrame, run, schema: str, *, last_first: bool) -> DataFrame:
    """``run`` over the chunk rows of whole conversations, in order or the last first."""
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc(c) if last_first else F.col(c) for c in ("part", "seq")]
    return chunks.repartition(n, "nc", "c").sortWithinPartitions("nc", "c", *order).mapInArrow(run, schema)


KEYS = "nc boolean, c long, part int, seq int"


def with_costs_to_go(chunks: DataFrame) -> DataFrame:
    """``nc, c, part, seq, codes, to_go, last``: least cost from each state after a chunk to the conversation's end."""

    def run(batches):
        conv, to_go = None, AT_END
        for batch in batches:
            out, lasts = [], []
            for nc, c, codes, cost in zip(*[batch.column(x).to_pylist() for x in ("nc", "c", "codes", "costs")]):
                last = conv != (nc, c)
                if last:
                    conv, to_go = (nc, c), AT_END
                out.append(to_go)
                lasts.append(last)
                to_go = tuple(min(cost[4 * e + s] + to_go[s] for s in range(4) if cost[4 * e + s] >= 0) for e in range(4))
            yield pa.RecordBatch.from_arrays([*batch.select(["nc", "c", "part", "seq", "codes"]).columns, pa.array(out, pa.list_(pa.int64())), pa.array(lasts)], ["nc", "c", "part", "seq", "codes", "to_go", "last"])

    return _stream(chunks, run, KEYS + ", codes binary, to_go array<long>, last boolean", last_first=True)


def chunk_rows(turns: DataFrame) -> DataFrame:
    """``nc, c, part, seq, codes, costs``: a row for each chunk of ``coded_turns``."""
    codes = F.transform(F.sort_array(F.collect_list(F.struct("idx", "code"))), lambda x: F.lpad(F.hex(x["code"]), 2, "0"))
    rows = turns.groupBy("nc", "c", "part", "seq").agg(F.unhex(F.array_join(codes, "")).alias("codes"))

    def run(batches):
        for batch in batches:
            costs = [chunk_costs(c) for c in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.list_(pa.int64()))], [*batch.schema.names, "costs"])

    return rows.mapInArrow(run, KEYS + ", codes binary, costs array<long>")


def traced(chunks: DataFrame) -> DataFrame:
    """``nc, c, part, seq, codes, cost, exit, scripts``: arrays over the entry states; scripts of a chunk are joined by spaces."""

    def run(batches):
        for batch in batches:
            done = []
            for codes, to_go, last in zip(*[batch.column(x).to_pylist() for x in ("codes", "to_go", "last")]):
                least = min(to_go)
                found = trace(codes, tuple(x - least for x in to_go), last)
                done.append(([x[0] + least for x in found], [x[1] for x in found], [" ".join(x[2]) for x in found]))
            costs, exits, scripts = zip(*done) if done else ((), (), ())
            new = [pa.array(costs, pa.list_(pa.int64())), pa.array(exits, pa.list_(pa.int32())), pa.array(scripts, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.select(["nc", "c", "part", "seq", "codes"]).columns, *new], ["nc", "c", "part", "seq", "codes", "cost", "exit", "scripts"])

    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartition(n, "part", "seq").mapInArrow(run, KEYS + ", codes binary, cost array<long>, exit array<int>, scripts array<string>")


def scripts_of(chunks: DataFrame) -> DataFrame:
    """``nc, c, part, seq, codes, script, cost, illegal``: the script of each chunk on the cheapest way, a conversation's cost in its first chunk."""
    fits = {(0, 1), (1, 2), (2, 1)}

    def run(batches):
        conv, state, before = None, 0, None
        for batch in batches:
            done = []
            for nc, c, codes, cost, exits, scripts in zip(*[batch.column(x).to_pylist() for x in ("nc", "c", "codes", "cost", "exit", "scripts")]):
                first = conv != (nc, c)
                if first:
                    conv, state, before = (nc, c), 0, None
                roles = [x & 3 for x in codes]
                pairs = zip(roles if before is None else [before, *roles], roles[1:] if before is None else roles)
                done.append((scripts[state], cost[0] if first else 0, sum(p not in fits for p in pairs)))
                state, before = exits[state], roles[-1]
            script, cost, illegal = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.select(["nc", "c", "part", "seq", "codes"]).columns, pa.array(script, pa.string()), pa.array(cost, pa.int64()), pa.array(illegal, pa.int64())], ["nc", "c", "part", "seq", "codes", "script", "cost", "illegal"])

    return _stream(chunks, run, KEYS + ", codes binary, script string, cost long, illegal long", last_first=False)


def repaired_lines(turns: DataFrame, scripts: DataFrame) -> DataFrame:
    """``nc, c, part, seq, idx, lines``: the repaired ``role:text`` that each turn becomes, with what is inserted beside it."""
    own = turns.join(scripts.select("part", "seq", F.split("script", " ").alias("all")), ["part", "seq"]).withColumn("script", F.get("all", F.col("idx")))

    def line(x: Column) -> Column:
        text = lambda role: F.concat(role, F.lit(":"), F.col("text"))
        return F.when(x == "u", "user:").when(x == "a", "assistant:").when(x == "k", text(F.col("role"))).when(x == "U", text(F.lit("user"))).when(x == "A", text(F.lit("assistant")))

    steps = F.filter(F.split("script", ""), lambda x: ~x.isin("", "-"))
    return own.select("nc", "c", "part", "seq", "idx", F.transform(steps, line).alias("lines"))


def text_digests(lines: DataFrame) -> DataFrame:
    """``nc, c, repaired_sha256``: a task streams over the lines of a conversation in order."""

    def run(batches):
        conv, digest, empty = None, None, True
        row = lambda: pa.RecordBatch.from_arrays([pa.array([conv[0]]), pa.array([conv[1]], pa.int64()), pa.array([digest.hexdigest()])], ["nc", "c", "repaired_sha256"])
        for batch in batches:
            for nc, c, new in zip(*[batch.column(x).to_pylist() for x in ("nc", "c", "lines")]):
                if conv != (nc, c):
                    if conv is not None:
                        yield row()
                    conv, digest, empty = (nc, c), hashlib.sha256(), True
                for x in new:
                    digest.update((x if empty else "\n" + x).encode())
                    empty = False
        if conv is not None:
            yield row()

    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = lines.filter(F.size("lines") > 0).repartition(n, "nc", "c").sortWithinPartitions("nc", "c", "part", "seq", "idx").select("nc", "c", "lines")
    return ready.mapInArrow(run, "nc boolean, c long, repaired_sha256 string")


def repair(spark: SparkSession, turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For ``nc, c, turn, role, text``: coded turns, scripts of chunks, lines of the repaired conversations."""
    small_batches(spark)
    coded = materialize(spark, coded_turns(turns), "repair-turns")
    chunks = materialize(spark, chunk_rows(coded), "repair-chunks")
    scripts = materialize(spark, scripts_of(traced(with_costs_to_go(chunks))), "repair-scripts")
    return coded, scripts, repaired_lines(coded, scripts)


def repair_report(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """A row for each conversation: its faults, the cost and the audit of the cheapest repair, and the digest of the result."""
    coded, scripts, lines = repair(spark, damaged(conversations))
    fault = F.shiftright("code", 2)
    turns = coded.groupBy("nc", "c", "turn").agg(*[F.count_if(fault == k).alias(x) for k, x in ((1, "blank"), (2, "duplicate"), (3, "truncated"))])
    gaps = F.coalesce(F.max("turn").cast("long") - F.min("turn").cast("long") + 1 - F.count("turn"), F.lit(0).cast("long")).alias("gaps")
    counts = turns.groupBy("nc", "c").agg(gaps, *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")])
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("part", "seq", "script"))), lambda x: F.translate(x["script"], SCRIPT + " ", LETTERS))
    audits = scripts.groupBy("nc", "c").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(pieces, "").alias("audit"))
    out = conversations.select(*conversation()).distinct()
    for part in (counts, audits, text_digests(lines)):
        out = out.join(part, ["nc", "c"], "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(
        F.when(~F.col("nc"), F.col("c")).alias("conv_id"), *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def op12_layered_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(spark, table(spark, sf_dir, "conversations"))


def _sql() -> str:
    """The same in SQL: for each turn and state the least cost and audit, as one string, by recursion over turns."""
    add = lambda b, cost, letter: f"printf('%06d', substr({b}, 1, 6)::INTEGER + {cost}) || substr({b}, 7) || '{letter}'"
    inserted = f"least(b2, {add('b0', INSERT, 'I')}, {add('b1', INSERT, 'I')}, {add('b3', INSERT, 'I')})"
    keep = lambda b, role: f"CASE WHEN fault IN (0, 3) AND initial = '{role}' THEN {add(b, 't', 'K')} END"
    wanted = lambda b: f"CASE WHEN fault IN (0, 3) THEN {add(b, f'{REROLE} + t', 'R')} END"
    drop = lambda b: add(b, DELETE, "D")
    return f"""
WITH RECURSIVE
bits AS (SELECT i, i::BIGINT AS x, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(x ORDER BY i) AS tab FROM bits WHERE k = 8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d FROM conversations, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) FROM keyed WHERE d <> 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM hurt),
g AS (SELECT *, CASE fault WHEN 3 THEN 1 ELSE 0 END AS t, coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial NOT IN ('su', 'ua', 'au'), FALSE) AS illegal FROM (
  SELECT *, role[1] AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM placed)),
dp AS (SELECT conv_id, 0::BIGINT AS pos, '000000' AS b0, NULL::VARCHAR AS b1, NULL::VARCHAR AS b2, NULL::VARCHAR AS b3 FROM (SELECT DISTINCT conv_id FROM g)
  UNION ALL SELECT conv_id, pos, {drop('b0')}, least({drop('b1')}, {keep('b0', 's')}), least({drop('x2')}, {keep('least(b0, b1, x3)', 'u')}, {wanted('least(b0, b1, x3)')}), least({drop('x3')}, {keep('x2', 'a')}, {wanted('x2')})
  FROM (SELECT g.conv_id, g.pos, initial, fault, t, b0, b1, x2, least(b3, {add('x2', INSERT, 'I')}) AS x3 FROM (SELECT *, {inserted} AS x2 FROM dp) p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.pos = p.pos + 1)),
best AS (SELECT conv_id, least(b0, b3, {add('x2', INSERT, 'I')}) AS best FROM (SELECT *, {inserted} AS x2 FROM dp) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
steps AS (SELECT conv_id, x, j, count(*) FILTER (x <> 'I') OVER w AS pos, count(*) FILTER (x <> 'D') OVER w AS k, count(*) FILTER (x <> 'D') OVER (PARTITION BY conv_id) % 2 AS odd
  FROM (SELECT conv_id, unnest(string_split(substr(best, 7), '')) AS x, generate_subscripts(string_split(substr(best, 7), ''), 1) AS j FROM best) WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
mended AS (SELECT s.conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (k - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS repaired
  FROM steps s LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.pos = s.pos AND x <> 'I' WHERE x <> 'D' GROUP BY s.conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (illegal) AS illegal FROM g GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(substr(best, 1, 6), '0')::BIGINT AS cost, coalesce(substr(best, 7), '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP12_SQL = _sql()
