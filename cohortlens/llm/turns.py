"""Repair the structure of conversations by a square-root checkpointed dynamic program.

A conversation must read ``(s?(ua)+)?`` in the initials of its roles. Edits: Keep costs 0,
Rerole to user or assistant 2, Delete 3 (required for blank rows and duplicates), Insert
an empty text of user or assistant 2; a truncated row that isn't deleted adds 1. At any
place only one role can be inserted or assigned, so the edits' initials name a repair.

Rows are sorted over all partitions by conversation and turn, so a conversation may span
any number of tasks, and numbered. They are cut into blocks of 1,024 rows; a
conversation's rows in a block are a segment. Backward state-cost vectors (least cost to
the end from each of four states) are kept at the segments' ends only: a segment's min-plus
matrix takes the vector at its end to the one at its start, and one light row per segment
passes these on. Then segments are walked on their own: inside, vectors are stored at every
square root of its rows, blocks between are computed again while walking forward, and the
ASCII-least edit that loses nothing is emitted. Each possible first state is walked, as the
state that a segment starts in is only known once its forerunner was walked. At last a
conversation's segments and rows pass by in order and the matching walk is applied.

Repaired texts are hashed as a stream, so one task sees a conversation's rows in turn at the
end (SHA-256 can't be split) but holds one at a time.

Defined cases: missing roles, texts and parts of the key count as one space; missing turns
come first and are left out of gaps; rows of equal turn are ordered by role, then by MD5
of the text; equal rows are rows of their own; rows without conversation id form one
conversation; gaps beyond 64 bits are null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.text import parts
from cohortlens.session import local_table, materialize

#: rows of a block, as a power of two
BLOCK_BITS = 10
FAR = 1 << 60
#: states: nothing yet, after s, after u, after ua; least cost to end from each, by inserts
STATES = range(4)
LAST = (0, 4, 2, 0)
#: state after the role that a state accepts from an insert or a new role
NEXT = (2, 2, 3, 2)
NEED = ("user", "assistant")  # by state: assistant after u, else user
#: state after a kept role, by its initial; none where the pattern forbids it
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "o": (None,) * 4}
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
NEWLINE = "\n"


def _row_edits(code: str) -> list[list[tuple[str, int, int]]]:
    """(edit, cost, next state) of a row by state, in ASCII order. ``b`` and ``d``: must go; capitals: truncated."""
    out: list[list[tuple[str, int, int]]] = []
    extra = int(code.isupper())
    for state in STATES:
        edits = [(DELETE, 3, state)]
        if code not in "bd":
            kept = KEPT[code.lower()][state]
            if kept is not None:
                edits.append((KEEP, extra, kept))
            edits.append((REROLE, 2 + extra, NEXT[state]))
        out.append(edits)
    return out


EDITS = {code: _row_edits(code) for code in "bdsuaoSUAO"}


def before_row(code: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs in front of a row from those behind it, inserts in front of it included."""
    v = [min(cost + after[to] for _, cost, to in edits) for edits in EDITS[code]]
    # from u to ua and back is the only way that inserts lead on
    two, three = min(v[2], 2 + v[3]), min(v[3], 2 + v[2])
    return min(v[0], 2 + two), min(v[1], 2 + two), two, three


def checkpoints(codes: str, last: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Vectors at rows 0, w, 2w, ... and the end, w being the square root of the number of rows."""
    width = isqrt(len(codes)) + 1
    marks = [last]
    v = last
    for i in range(len(codes) - 1, -1, -1):
        v = before_row(codes[i], v)
        if i % width == 0:
            marks.append(v)
    return marks[::-1]


def walk(codes: str, last: tuple[int, ...], state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits of a segment from ``state``, and the state behind its last row."""
    width = isqrt(len(codes)) + 1
    marks = checkpoints(codes, last)
    out = []
    for k, begin in enumerate(range(0, len(codes), width)):
        block = codes[begin : begin + width]
        vectors = [marks[k + 1]]
        for code in reversed(block):
            vectors.append(before_row(code, vectors[-1]))
        vectors.reverse()
        for i, code in enumerate(block):
            here, after = vectors[i], vectors[i + 1]
            while True:
                # D, then I, then K and R: the first that keeps the least cost
                edits = EDITS[code][state]
                if edits[0][1] + after[state] == here[state]:
                    edit, _, to = edits[0]
                elif 2 + here[NEXT[state]] == here[state]:
                    edit, to = INSERT, NEXT[state]
                else:
                    edit, _, to = next(e for e in edits if e[1] + after[e[2]] == here[state])
                out.append(edit)
                state = to
                if edit != INSERT:
                    break
    return "".join(out), state


def segment_matrix(codes: str) -> list[int]:
    """Least cost through a segment from each state (rows) to each state (columns)."""
    columns = []
    for end in STATES:
        v = tuple(0 if s == end else FAR for s in STATES)
        for code in reversed(codes):
            v = before_row(code, v)
        columns.append(v)
    return [min(columns[e][s], FAR) for s in STATES for e in STATES]


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Drop, empty, unstop, repeat or rerole rows by CRC-32 of ``conv:turn`` modulo 20 (cases 0 to 4).

    Returns ``conv``, ``turn``, ``role``, ``text`` and ``copy`` (1 for the repetition).
    """
    space = F.lit(" ")
    cells = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"),
                        F.coalesce(F.col(text), space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    case = F.crc32(key.cast("binary")) % 20
    cells = cells.withColumn("case", case).where("case <> 0")
    copies = F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return cells.select(
        "conv", "turn", F.when(F.col("case") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("case") == 1, F.lit("")).when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy"))


def _class(role: Column, text: Column) -> Column:
    """One letter: ``b`` for blank, else the role's initial (``o`` for others), a capital if truncated."""
    trimmed = F.rtrim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    initial = F.substring(role, 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    return (F.when(trimmed == "", F.lit("b"))
            .when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), initial).otherwise(F.upper(initial)))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Rows numbered (``at``) in order of conversation and turn over all partitions, with their class and digest.

    A conversation is spread over as many partitions as its rows fill; equal rows are told
    apart by a number, so that even they can be dealt to several.
    """
    marked = rows.withColumn("class", _class(F.col("role"), F.col("text"))).withColumn("digest", F.md5("text")).withColumn(
        "salt", F.xxhash64(F.monotonically_increasing_id()))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "copy", "salt"]
    placed = marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt", "copy").withColumn(
        "part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = materialize(placed, "turns")
    # one number per partition
    first, starts = 0, []
    for part, n in sorted(placed.groupBy("part").count().collect()):
        starts.append((part, first))
        first += n
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType())])
    starts = local_table(rows.sparkSession, starts, schema)
    return placed.join(starts, "part").withColumn("at", F.col("start") + F.col("place")).withColumn(
        "block", F.shiftright("at", BLOCK_BITS)).drop("part", "place", "start")


def segments(rows: DataFrame) -> DataFrame:
    """``conv``, ``block``, ``codes`` and, for those that may go on in another block, their ``matrix``."""
    narrow = rows.select("block", "at", "conv", "class")
    firsts = rows.groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).select(F.shiftright("at", BLOCK_BITS).alias("block"), "at")
    schema = T.StructType([rows.schema["conv"], T.StructField("block", T.LongType()), T.StructField("codes", T.StringType()),
                           T.StructField("matrix", T.ArrayType(T.LongType()))])

    def cut(members: pa.Table, new: pa.Table) -> pa.Table:
        order = np.argsort(members["at"].to_numpy())
        at = members["at"].to_numpy()[order]
        known = np.isin(at, new["at"].to_numpy())
        convs = members["conv"].to_pylist()
        classes = members["class"].to_pylist()
        found: list[tuple] = []
        for place, old in zip(order.tolist(), (~known).tolist(), strict=True):
            code = "d" if old and classes[place] != "b" else classes[place]
            if not found or found[-1][0] != convs[place]:
                found.append((convs[place], []))
            found[-1][1].append(code)
        codes = ["".join(c) for _, c in found]
        edge = {0, len(found) - 1}
        return pa.table({"conv": pa.array([c for c, _ in found], members.schema.field("conv").type),
                         "block": pa.array([members["block"][0].as_py()] * len(found), pa.int64()), "codes": codes,
                         "matrix": pa.array([segment_matrix(c) if i in edge else None for i, c in enumerate(codes)], pa.list_(pa.int64()))})

    return narrow.groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(cut, schema)


def segment_ends(cut: DataFrame) -> DataFrame:
    """``conv``, ``block``, ``first`` and ``last``: whether a segment starts its conversation, and the vector at its end.

    Segments of a conversation pass by from the last to the first; only one vector is carried.
    """
    schema = T.StructType([cut.schema["conv"], T.StructField("block", T.LongType()), T.StructField("last", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, carried = object(), LAST
        for batch in batches:
            convs, lasts = batch.column("conv").to_pylist(), []
            for conv, matrix in zip(convs, batch.column("matrix").to_pylist(), strict=True):
                if conv != before:
                    before, carried = conv, LAST
                lasts.append(carried)
                carried = tuple(min(matrix[4 * s + e] + carried[e] for e in STATES) for s in STATES)
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(lasts, pa.list_(pa.int64()))],
                                             names=schema.names)

    light = cut.where("matrix is not null").select("conv", "block", "matrix")
    return light.repartition("conv").sortWithinPartitions(F.col("conv"), F.col("block").desc()).mapInArrow(run, schema)


def walked(cut: DataFrame, ends: DataFrame) -> DataFrame:
    """``conv``, ``block``, ``codes``, and by first state the edits (``audits``) and the state behind (``exits``)."""
    edge = cut.where("matrix is not null").drop("matrix").alias("c").join(
        ends.alias("e"), F.col("c.conv").eqNullSafe(F.col("e.conv")) & (F.col("c.block") == F.col("e.block"))).select("c.*", "e.last")
    inner = cut.where("matrix is null").drop("matrix").withColumn("last", F.lit(None).cast("array<long>"))
    schema = T.StructType([cut.schema["conv"], T.StructField("block", T.LongType()), T.StructField("codes", T.StringType()),
                           T.StructField("audits", T.ArrayType(T.StringType())), T.StructField("exits", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, exits = [], []
            for codes, last in zip(batch.column("codes").to_pylist(), batch.column("last").to_pylist(), strict=True):
                ways = [walk(codes, LAST, 0)] if last is None else [walk(codes, tuple(last), s) for s in STATES]
                audits.append([a for a, _ in ways])
                exits.append([e for _, e in ways])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("block"), batch.column("codes"), pa.array(audits, pa.list_(pa.string())),
                 pa.array(exits, pa.list_(pa.int32()))], names=schema.names)

    return edge.unionByName(inner).mapInArrow(run, schema)


class _Conversation:
    """What is carried along a conversation whose segments and rows pass by in order."""

    def __init__(self, conv):
        self.conv = conv
        self.state = 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.distinct = 0
        self.least = self.most = self.initial = None
        self.audit: list[str] = []
        self.hash = hashlib.sha256()
        self.empty = True

    def segment(self, codes: str, audits: list[str], exits: list[int]) -> None:
        self.edits, self.codes = iter(audits[self.state]), iter(codes)
        self.audit.append(audits[self.state])
        self.at, self.state = self.state, exits[self.state]

    def emit(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else NEWLINE}{role}:{text}".encode())
        self.empty = False

    def insert(self) -> None:
        self.emit(NEED[self.at == 2], "")
        self.at = NEXT[self.at]
        self.cost += 2

    def row(self, turn, role: str, text: str) -> None:
        code = next(self.codes)
        self.blank += code == "b"
        self.duplicate += code == "d"
        cut = code.isupper()
        self.truncated += cut
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        if turn is not None:
            self.distinct += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        while (edit := next(self.edits)) == INSERT:
            self.insert()
        if edit == DELETE:
            self.cost += 3
            return
        self.cost += cut + 2 * (edit == REROLE)
        if edit == KEEP:
            self.emit(role, text)
            self.at = KEPT[code.lower()][self.at]
        else:
            self.emit(NEED[self.at == 2], text)
            self.at = NEXT[self.at]

    def result(self) -> tuple:
        self.at = self.state
        while LAST[self.at]:
            self.audit.append(INSERT)
            self.insert()
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.distinct
        return (self.conv, gaps if gaps < 1 << 63 else None, self.blank, self.duplicate, self.truncated, self.illegal, self.cost,
                "".join(self.audit), self.hash.hexdigest())


RESULTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def applied(rows: DataFrame, ways: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per id: counts of faults, cost, edits and the hash of the repaired conversation."""
    none = F.lit(None)
    head = ids.select("conv", F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("at"), none.cast("long").alias("turn"),
                      none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("string").alias("codes"),
                      none.cast("array<string>").alias("audits"), none.cast("array<int>").alias("exits"))
    segment = ways.select("conv", "block", F.lit(-1).cast("long").alias("at"), none.cast("long").alias("turn"), none.cast("string").alias("role"),
                          none.cast("string").alias("text"), "codes", "audits", "exits")
    row = rows.select("conv", "block", "at", F.col("turn").cast("long").alias("turn"), "role", "text", none.cast("string").alias("codes"),
                      none.cast("array<string>").alias("audits"), none.cast("array<int>").alias("exits"))
    stream = head.unionByName(segment).unionByName(row).repartition("conv").sortWithinPartitions("conv", "block", "at")
    fields = [T.StructField(c, T.StringType() if c in ("audit", "repaired_sha256") else T.LongType()) for c in RESULTS]
    schema = T.StructType([rows.schema["conv"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            types = [conv_type, *([pa.int64()] * 6), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        now: _Conversation | None = None
        conv_type, done = None, []
        for batch in parts(batches, 1024):
            conv_type = batch.schema.field("conv").type
            for conv, block, at, turn, role, text, codes, audits, exits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block < 0:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(conv)
                elif at < 0:
                    now.segment(codes, audits, exits)
                else:
                    now.row(turn, role, text)
            if done:
                yield flush(done)
                done = []
        if now is not None:
            yield flush([now.result()])

    return stream.mapInArrow(run, schema)


def repair_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Faults and cheapest repair per conversation of ``rows`` (``conv``, ``turn``, ``role``, ``text``, ``copy``)."""
    placed = ordered_rows(rows)
    cut = materialize(segments(placed), "segments")
    return applied(placed, walked(cut, segment_ends(cut)), ids)


def repair_conversations(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         as_is: bool = False) -> DataFrame:
    """One row per conversation of ``rows``: ``gaps``, faults, ``cost``, ``audit`` and ``repaired_sha256``.

    ``as_is`` repairs the rows as they are; else they are first damaged (see ``damage``).
    """
    cells = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text), F.lit(" ")).alias("text"), F.lit(0).alias("copy")) if as_is else damage(rows, conv, turn, role, text)
    return repair_rows(cells, rows.select(F.col(conv).alias("conv")).distinct()).withColumnRenamed("conv", conv)
