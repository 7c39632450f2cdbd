"""Repair of conversations whose turns were lost, emptied, cut off, repeated or given the wrong role.

Every row keeps its first fault (blank, duplicate, truncated); the cheapest edits that turn the roles into an optional
system message and exchanges of user and assistant are found as lightest derivations (``agenda``).

Rows are ordered by conversation and turn through one range shuffle, with a salt behind the last key, so a
conversation with a third of all rows, a turn with many rows or a row with many copies is spread over many partitions.
A conversation that lies in one partition and in one block is repaired there. What crosses a border, and what is longer than
a block, is written out and repaired block by block: first occurrences by an aggregate and a join, a table of
derivations by pair of states for each block, 64 blocks joined at a time until a conversation is one, and its audit dealt
back to the blocks. The audit itself is one letter a row and the only thing that grows with a conversation.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rillflow.llm import agenda
from rillflow.llm.common import saved, small_batches

#: Rows and characters of a block, blocks joined at once, bytes of text of a partition.
BLOCK_ROWS, BLOCK_CHARS, FAN, PART_BYTES = 256, 1 << 22, 64, 16 << 20
#: Blocks a partition may have, as the upper part of a block's number is its partition.
SPAN = 1 << 24
WHITE = " \t\n\x0b\x0c\r"
SALTS = 1024
REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
LEGAL = frozenset(("su", "ua", "au"))
TURNS = "array<struct<role: string, text: string>>"
TABLES = "seq long, tally string, table string"
WALKED = f"done boolean, seq long, place int, turn long, role string, text string, blank boolean, truncated boolean, copies long, report array<long>, audit string, turns {TURNS}"


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with a fault each, by crc32 of ``conv_id:turn`` modulo 20; columns conv_id, turn, role, text, copies.

    0 drops the row (no copies of it), 1 empties the text, 2 takes its full stops, exclamation and question marks, 3 repeats
    the row, 4 makes it a user's. A null role or text, and a null in the key, is one space; null ids and turns stay null.
    """
    conv, turn = F.col(conv_col), F.col(turn_col).cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    key = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    fault = F.crc32(key.cast("binary")) % 20
    return conversations.select(
        conv.alias("conv_id"), turn.alias("turn"), F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault.isin(0, 1), "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def intact(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows as they are, in the columns of ``damaged``."""
    return conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))), F.lit(1).cast("long").alias("copies"),
    )


class Tally:
    """Counts over consecutive rows of a conversation, joined with those of the rows that follow."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")

    def __init__(self, values: list | None = None):
        self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low, self.high, self.first, self.last = values or [0, 0, 0, 0, 0, None, None, None, None]

    def values(self) -> list:
        return [getattr(self, name) for name in self.FIELDS]

    def row(self, turn: int | None, initial: str, blank: bool, repeated: bool, truncated: bool, copies: int) -> None:
        one = Tally([copies if blank else 0, 0 if blank else copies - 1 + repeated, 0, 0, 0, turn, turn, initial, initial])
        one.truncated = int(truncated and not blank and not repeated)
        one.illegal, one.turns = (copies - 1) * (initial * 2 not in LEGAL), int(turn is not None)
        self.add(one)

    def add(self, other: Tally) -> None:
        """``other`` counts what follows; turns ascend, so a turn on both sides is the last here and the first there."""
        if other.first is None:
            return
        self.illegal += other.illegal + (self.first is not None and self.last + other.first not in LEGAL)
        self.turns += other.turns - (self.high is not None and self.high == other.low)
        self.blank, self.duplicate, self.truncated = self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated
        self.low, self.high = other.low if self.low is None else self.low, self.high if other.high is None else other.high
        self.first, self.last = other.first if self.first is None else self.first, other.last

    def report(self, cost: int) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [(gaps + (1 << 63)) % (1 << 64) - (1 << 63), self.blank, self.duplicate, self.truncated, self.illegal, cost]


def _whole(rows: list[tuple]) -> tuple[list[int], str, list[tuple[str, str]]]:
    """Report, audit and repaired turns of a conversation whose rows (turn, role, text, blank, truncated, copies) are all here."""
    tally, seen, edited = Tally(), set(), []
    for turn, role, text, blank, truncated, copies in rows:
        repeated = (role, text) in seen
        seen.add((role, text))
        tally.row(turn, role[:1], blank, repeated, truncated, copies)
        edited.append((role[:1], blank or repeated, truncated, copies - 1))
    cost, audit = agenda.repaired(edited)
    editor = agenda.Editor(audit)
    turns = [t for row in rows for t in editor.row(row[1], row[2], row[5])] + editor.close()
    return tally.report(cost), audit, turns


def _walker(schema: pa.Schema, block_rows: int, block_chars: int):
    """Ordered rows to repaired conversations, and to the rows of those that do not lie whole in one block of the partition."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() * SPAN
        out: list[tuple] = []
        rows: list[tuple] = []
        conv, size, block, opened, first = None, 0, 0, False, True

        def spill() -> None:
            """The buffered rows as a block of an unfinished conversation."""
            nonlocal block, size
            out.extend((conv, False, base + block, i, *row, None, None, None) for i, row in enumerate(rows))
            block, size = block + 1, 0
            rows.clear()

        def close(border: bool) -> None:
            nonlocal size
            if border or opened:
                spill()
            elif rows:
                report, audit, turns = _whole([r for r in rows if r[5]])
                out.append((conv, True, None, None, None, None, None, None, None, None, report, audit, [{"role": r, "text": t} for r, t in turns]))
                rows.clear()
                size = 0

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return made

        for batch in batches:
            for c, turn, role, text, blank, truncated, copies in zip(*(column.to_pylist() for column in batch.columns)):
                if rows or opened:
                    if c != conv:
                        close(first)
                        opened = first = False
                    elif rows and copies and rows[-1][5] and rows[-1][:3] == (turn, role, text):
                        rows[-1] = (*rows[-1][:5], rows[-1][5] + copies)
                        continue
                    elif len(rows) >= block_rows or rows and size + len(text) > block_chars:
                        spill()
                        opened = True
                conv = c
                rows.append((turn, role, text, blank, truncated, copies))
                size += len(text)
                if len(out) >= 2048:
                    yield batch_of()
        close(True)
        if out:
            yield batch_of()

    return walk


def _schema(conv_type: T.DataType, others: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv_type), *T.StructType.fromDDL(others).fields])


def _blocks(rows: DataFrame, conv_type: T.DataType) -> DataFrame:
    """Counts, and derivations by pair of states, of every block: conv_id, seq, tally and table (JSON).

    A block's audit names the block and the state before it, and ends in a bar. As equal beginnings of two audits have the
    same rows and states behind them, that changes no order.
    """
    schema = _schema(conv_type, TABLES)

    def of(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        seq, tally, edited = group.column("seq")[0].as_py(), Tally(), []
        for turn, initial, blank, repeated, truncated, copies in zip(*(group.column(c).to_pylist() for c in ("turn", "initial", "blank", "repeated", "truncated", "copies"))):
            if copies:
                tally.row(turn, initial, blank, repeated, truncated, copies)
                edited.append((initial, blank or repeated, truncated, copies - 1))
        table = [[p, q, cost, f"{seq}.{p}.{audit}|"] for (p, q), (cost, audit) in agenda.stretch(edited).items()]
        return _row(schema, group.column("conv_id")[0], seq, json.dumps(tally.values()), json.dumps(table))

    return rows.groupBy("conv_id", "seq").applyInArrow(of, schema)


def _row(schema: T.StructType, conv: pa.Scalar, *values) -> pa.Table:
    types = [field.type for field in to_arrow_schema(schema)]
    return pa.table([pa.array([v], t) for v, t in zip((conv.as_py(), *values), types)], names=schema.names)


def _joined(tables: DataFrame, conv_type: T.DataType, whole: bool, fan: int) -> DataFrame:
    """Stretches of one conversation and number as one: conv_id, seq, tally, table; or closed: conv_id, report, audit."""
    schema = _schema(conv_type, "report array<long>, audit string" if whole else TABLES)

    def of(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        tally, parts = Tally(), []
        for counts, table in zip(group.column("tally").to_pylist(), group.column("table").to_pylist()):
            tally.add(Tally(json.loads(counts)))
            parts.append({(p, q): (cost, audit) for p, q, cost, audit in json.loads(table)})
        best = {k: (cost, "".join(audit)) for k, (cost, audit) in agenda.joined(parts, whole).items()}
        if whole:
            (cost, audit), = best.values()
            return _row(schema, group.column("conv_id")[0], tally.report(cost), audit)
        return _row(schema, group.column("conv_id")[0], group.column("seq")[0].as_py(), json.dumps(tally.values()), json.dumps([[*k, *v] for k, v in best.items()]))

    numbered = tables.withColumnRenamed("seq", "part").withColumn("seq", F.lit(0).cast("long") if whole else F.floor(F.col("part") / fan))
    return numbered.groupBy("conv_id", "seq").applyInArrow(of, schema)


def _edited(rows: DataFrame, conv_type: T.DataType) -> DataFrame:
    """The turns that the rows of a block become under their part of the audit."""
    schema = _schema(conv_type, f"piece long, turns {TURNS}")

    def of(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        editor = agenda.Editor(group.column("edits")[0].as_py(), group.column("state")[0].as_py())
        rows = zip(*(group.column(c).to_pylist() for c in ("role", "text", "copies")))
        turns = [{"role": r, "text": t} for row in rows if row[2] for r, t in editor.row(*row)]
        return _row(schema, group.column("conv_id")[0], group.column("seq")[0].as_py(), turns)

    return rows.groupBy("conv_id", "seq").applyInArrow(of, schema)


def _same(a: str, b: str, *columns: str):
    """Null-safe equality of the named columns of two aliased tables."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _long(rows: DataFrame, conv_type: T.DataType, fan: int) -> DataFrame | None:
    """Repaired conversations from rows in several blocks (None without such rows), in the columns of ``repaired``."""
    top = rows.agg(F.max(F.floor(F.col("seq") / SPAN)), F.max(F.col("seq") % SPAN)).first()
    if top[0] is None:
        return None
    numbers = (top[0] + 1) * (top[1] + 1)
    seq = F.floor(F.col("seq") / SPAN) * (top[1] + 1) + F.col("seq") % SPAN
    rows = rows.withColumn("seq", seq).withColumn("digest", F.sha2("text", 256))
    earliest = rows.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("seq", "place")).alias("earliest"), F.count("*").alias("times"))
    flagged = rows.alias("r").join(earliest.where("times > 1").alias("e"), _same("r", "e", "conv_id", "role", "digest"), "left").select(
        "r.conv_id", "r.seq", "r.place", "r.turn", F.substring("r.role", 1, 1).alias("initial"), "r.blank", "r.truncated", "r.copies",
        F.coalesce(F.struct("r.seq", "r.place") > F.col("e.earliest"), F.lit(False)).alias("repeated"),
    )
    tables = saved(_blocks(flagged, conv_type))
    while numbers > fan:
        tables, numbers = saved(_joined(tables, conv_type, False, fan)), -(-numbers // fan)
    done = saved(_joined(tables, conv_type, True, fan))
    edits = done.select("conv_id", F.explode(F.split("audit", r"\|")).alias("edit"))
    named = F.split("edit", r"\.")
    of_blocks = edits.where(F.col("edit").contains(".")).select("conv_id", named[0].cast("long").alias("seq"), named[1].cast("int").alias("state"), named[2].alias("edits"))
    ours = rows.alias("r").join(of_blocks.alias("e"), _same("r", "e", "conv_id", "seq")).select("r.conv_id", "r.seq", "place", "role", "text", "copies", "state", "edits")
    answer = F.struct(F.lit("assistant").alias("role"), F.lit("").alias("text"))
    ask = F.struct(F.lit("user").alias("role"), F.lit("").alias("text"))
    closing = edits.where(F.col("edit").isin("I", "II")).select(
        "conv_id", F.lit((1 << 62)).cast("long").alias("piece"), F.when(F.col("edit") == "I", F.array(answer)).otherwise(F.array(ask, answer)).alias("turns"),
    )
    pieces = _edited(ours, conv_type).unionByName(closing)
    reports = done.select(
        "conv_id", F.lit(-1).cast("long").alias("piece"), *_report(), F.regexp_replace("audit", "[^KRDI]", "").alias("audit"), F.lit(None).cast(TURNS).alias("turns"),
    )
    return reports.unionByName(pieces.where(F.size("turns") > 0), allowMissingColumns=True)


def _report() -> list:
    return [F.col("report")[i].alias(n) for i, n in enumerate(REPORT)]


def repaired(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS, fan: int = FAN) -> DataFrame:
    """The repaired conversations of ``damaged`` or ``intact`` rows.

    Rows: conv_id, piece, gaps, blank, duplicate, truncated, illegal, cost, audit, turns (role and text). A conversation is one
    row with piece null; or, where it crosses a partition or is longer than a block (``block_rows``, ``block_chars``), a row with the report (piece -1)
    and its turns in the rows that follow by ascending piece. Order within a conversation is by turn (null first), role, text.
    All rows of a null conversation id are one conversation. Without rows after damage the report is zeros and the audit
    empty. Repeated rows are duplicates; empty and very long texts are ordinary ones; an empty table gives no rows.
    """
    conv_type = rows.schema["conv_id"].dataType
    solid = F.rtrim(F.col("text"), F.lit(WHITE))
    marked = small_batches(rows).select(
        "conv_id", "turn", "role", "text", (solid == "").alias("blank"), (~F.right(solid, F.lit(1)).isin(".", "!", "?") & (solid != "")).alias("truncated"), "copies",
        (F.monotonically_increasing_id() % SALTS).alias("salt"),
    )
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "salt")]
    ordered = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("salt")
    schema = _schema(conv_type, WALKED)
    walked = saved(ordered.mapInArrow(_walker(to_arrow_schema(schema), block_rows, block_chars), schema))
    short = walked.where("done").select("conv_id", F.lit(None).cast("long").alias("piece"), *_report(), "audit", "turns")
    long = _long(walked.where("not done"), conv_type, fan)
    return short if long is None else short.unionByName(long)


def _lines() -> F.Column:
    return F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def _digests(schema: pa.Schema):
    """Ordered reports and lines of long conversations to one row each, hashed as they pass."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, hashed, fresh = None, None, True
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["piece"] == -1:
                    if report is not None:
                        done.append({**report, "repaired_sha256": hashed.hexdigest()})
                    report, hashed, fresh = row, hashlib.sha256(), True
                else:
                    hashed.update((row["lines"] if fresh else "\n" + row["lines"]).encode())
                    fresh = False
            yield pa.RecordBatch.from_pylist([{f: r[f] for f in schema.names} for r in done], schema)
        if report is not None:
            yield pa.RecordBatch.from_pylist([{f: {**report, "repaired_sha256": hashed.hexdigest()}[f] for f in schema.names}], schema)

    return digests


def digested(conversations: DataFrame) -> DataFrame:
    """One row for each conversation of ``repaired``, its turns as a hash of their ``role:text`` lines.

    A long conversation's pieces pass through one task in order, one piece at a time: a hash has no parts.
    """
    columns = ["conv_id", *REPORT, "audit"]
    short = conversations.where("piece IS NULL").select(*columns, F.sha2(_lines(), 256).alias("repaired_sha256"))
    long = conversations.where("piece IS NOT NULL").select(*columns, "piece", _lines().alias("lines"))
    streamed = long.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_digests(to_arrow_schema(short.schema)), short.schema)
    return short.unionByName(streamed)


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation after the stated damage: faults, cheapest repair and the repaired text's hash."""
    return digested(repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
