"""Repair of damaged conversations: the cheapest edits that make the roles a dialogue, by a recursive query over grammar states.

Rows are put in order once, as narrow rows without their text, dealt by ranges so that one conversation spreads over as
many tasks as its rows need. Each run of at most ``CELL`` rows of a conversation is a cell. Cells are dealt by hash and
handed to DuckDB in batches of whole cells: a recursive query advances one turn for all cells of the batch at once and
keeps, for each start and each state of the grammar, the least cost and of those the least audit. A cell so becomes a
table of sixteen ways through it at most, and the same query over cells in place of turns joins a long conversation's
cells, ``CELL`` at a time, until one is left. No task holds more than a batch.

Of two audits of equal cost that lead from and to the same states over the same rows neither begins the other, because
it would be cheaper by its inserts; so the least audit of the whole is made of the least audits of its parts.

The texts are shuffled once, to their conversation's audit, and streamed in order: the repaired turns come out one by one.

Cases, all defined: a null role or text is one space, and so has no role of the grammar and is blank. Null turn numbers
come first; rows of equal turn are ordered by the hash of role and text, so repeated rows are adjacent, the later ones
being duplicates. A null conversation id is a conversation. A conversation without rows repairs to none, at no cost. A role
counts by its first letter as written. Texts and conversations may be of any length. An empty table gives an empty result.
Only the four columns named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import product

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import slices
from millrace.llm.text import ASCII_SPACE
from millrace.session import cut_lineage

#: Rows of one conversation that one recursion goes through, and rows that one query takes.
CELL, BATCH_ROWS = 256, 8_192
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The grammar (s?(ua)+)? as states: at the start, after s, after u, after a; and where it may end.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
#: What a row is to the grammar: ``x`` must be deleted, else the first letter of its role, ``o`` for any other, upper-case if truncated.
STEPS = "xsuaoSUAO"
SHIFT = CELL.bit_length() - 1

CELLS = pa.schema(
    [
        ("conv_id", pa.int64()), ("cell", pa.int64()), ("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()),
        ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
    ]
)
CELLS_DDL = "conv_id long, cell long, start int, state int, cost long, audit string, illegal long, first string, last string"
TURNS_DDL = "conv_id long, place long, role string, text string, edit string"
DIGEST_DDL = """conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,
    repaired_sha256 string, n_turns long"""


def damage(turns: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` damaged by a hash of conversation and turn, in five of twenty cases."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    case, role, text = F.crc32(name.cast("binary")) % 20, F.coalesce("role", space), F.coalesce("text", space)
    changed = turns.select(
        "conv_id", "turn", F.when(case == 4, "user").otherwise(role).alias("role"),
        F.when(case == 1, "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), case.alias("_case"),
    )
    times = F.explode(F.when(F.col("_case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_time")
    return changed.where("_case <> 0").select("conv_id", "turn", "role", "text", times).drop("_time")


@cache
def moves() -> pa.Table:
    """The best way of each kind of row from each state to each, inserts before it included."""
    inserts = {(s, s): (0, "") for s in range(4)} | {(s, 2): (INSERT, "I") for s in (0, 1, 3)} | {(2, 3): (INSERT, "I")}
    inserts |= {(s, 3): (2 * INSERT, "II") for s in (0, 1)}
    rows: dict[tuple, tuple] = {}
    for step, ((begin, mid), (cost, audit)) in product(STEPS, inserts.items()):
        ways = [(mid, DELETE, "D")]
        if step != "x":
            extra = TRUNCATED if step.isupper() else 0
            ways += [(NEXT[mid, c], extra, "K") for c in step.lower() if (mid, c) in NEXT]
            ways += [(NEXT[mid, c], REROLE + extra, "R") for c in NAMES if (mid, c) in NEXT]
        for end, more, edit in ways:
            key, way = (step, begin, end), (cost + more, audit + edit)
            rows[key] = min(way, rows.get(key, way))
    made = [(*key, *way) for key, way in rows.items()]
    return pa.table(dict(zip(("step", "begin", "finish", "cost", "audit"), map(list, zip(*made)), strict=True)))


#: Each recursion advances one step for all units, from each start, and keeps the least cost and audit of each state.
ADVANCE = """
WITH RECURSIVE path AS (
  SELECT unit, 0::BIGINT AS nth, start, start AS state, {'cost': 0::BIGINT, 'audit': ''} AS best
  FROM (SELECT DISTINCT unit FROM steps), (SELECT unnest([0, 1, 2, 3]) AS start)
  UNION ALL
  SELECT p.unit, p.nth + 1, p.start, m.finish, min({'cost': p.best.cost + m.cost, 'audit': p.best.audit || m.audit})
  FROM path p JOIN steps s ON s.unit = p.unit AND s.nth = p.nth + 1 JOIN moves m ON m.step = s.step AND m.begin = p.state
  GROUP BY p.unit, p.nth, p.start, m.finish
)
SELECT u.conv_id, u.cell, p.start, p.state, p.best.cost AS cost, p.best.audit AS audit, u.illegal, u.first, u.last
FROM path p JOIN units u ON u.unit = p.unit AND u.steps = p.nth
"""

#: The turns of a batch as steps of their cells.
OF_TURNS = """
CREATE OR REPLACE TEMP TABLE steps AS
SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST, cell) AS unit, row_number() OVER here AS nth, step, conv_id, cell, initial AS first, initial AS last,
       coalesce(lag(initial) OVER here || initial NOT IN {pairs}, false)::BIGINT AS illegal
FROM batch WINDOW here AS (PARTITION BY conv_id, cell ORDER BY pos)
"""

#: The cells of a batch as steps of the cells above them, and their ways as moves.
OF_CELLS = """
CREATE OR REPLACE TEMP TABLE steps AS
SELECT unit, nth, step, conv_id, cell, first, last, illegal + coalesce(lag(last) OVER here || first NOT IN {pairs}, false)::BIGINT AS illegal
FROM (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST, above) AS unit, dense_rank() OVER (PARTITION BY conv_id, above ORDER BY cell) AS nth,
         dense_rank() OVER (ORDER BY conv_id NULLS FIRST, above, cell) AS step, conv_id, above AS cell, first, last, illegal
  FROM (SELECT DISTINCT conv_id, above, cell, first, last, illegal FROM batch)
) WINDOW here AS (PARTITION BY unit ORDER BY nth);
CREATE OR REPLACE TEMP TABLE moves AS
SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST, above, cell) AS step, start AS begin, state AS finish, cost, audit FROM batch
"""

UNITS = """
CREATE OR REPLACE TEMP TABLE units AS
SELECT unit, any_value(conv_id) AS conv_id, any_value(cell) AS cell, count(*) AS steps, sum(illegal)::BIGINT AS illegal,
       arg_min(first, nth) AS first, arg_max(last, nth) AS last
FROM steps GROUP BY unit
"""


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int = 2, rows: int = BATCH_ROWS) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that never end within a run of equal values of the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            if sum(b.num_rows for b in held) < rows:
                continue
            table = pa.Table.from_batches(held)
            key = lambda i: [table.column(k)[i].as_py() for k in range(keys)]  # noqa: E731, B023
            last, upto = key(table.num_rows - 1), table.num_rows - 1
            while upto and key(upto - 1) == last:
                upto -= 1
            if upto:
                yield table.slice(0, upto)
                held = table.slice(upto).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _advancer(prepare: str, own_moves: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1}) as con:
            if not own_moves:
                con.register("moves", moves())
            for table in whole_runs(batches):
                con.register("batch", table)
                con.execute(prepare.format(pairs=LEGAL_PAIRS))
                con.execute(UNITS)
                yield from con.sql(ADVANCE).to_arrow_table().cast(CELLS).to_batches()
                con.unregister("batch")

    return advance


def _content(role: str = "role", text: str = "text") -> Column:
    return F.unhex(F.sha2(F.concat(F.char_length(role), F.lit(":"), F.col(role), F.col(text)), 256))


def clean(rows: DataFrame) -> DataFrame:
    space = F.lit(" ")
    made = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    return made.withColumn("content", _content())


def in_order(rows: DataFrame) -> DataFrame:
    """Narrow rows ``conv_id, turn, initial, pos, step, blank, duplicate, truncated``; ``pos`` rises in each conversation's order."""
    bare = F.trim("text", F.lit(ASCII_SPACE))
    narrow = rows.select(
        "conv_id", "turn", "content", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"), F.monotonically_increasing_id().alias("_row"),
    )
    order = ["conv_id", "turn", "content", "_row"]
    dealt = narrow.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
    placed = cut_lineage(dealt.withColumn("pos", F.monotonically_increasing_id()))
    # The least place of each content is found by sums, so a turn that is repeated any number of times is no hot group.
    first = placed.groupBy("conv_id", "content").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_first"))
    known = placed.join(first, "pos", "left").withColumn("duplicate", ~F.col("blank") & F.col("_first").isNull())
    known = known.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("cut"))
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    step = F.when(F.col("blank") | F.col("duplicate"), "x").when(F.col("truncated"), F.upper(letter)).otherwise(letter)
    return known.select("conv_id", "turn", "initial", "pos", step.alias("step"), "blank", "duplicate", "truncated")


def ways(ordered: DataFrame) -> DataFrame:
    """A conversation's ways through all its rows as one cell: ``CELLS``, one row for each start and end state."""
    turns = ordered.select("conv_id", F.shiftright("pos", SHIFT).alias("cell"), "pos", "step", "initial")
    dealt = turns.repartition("conv_id", "cell").sortWithinPartitions("conv_id", "cell", "pos")
    cells = cut_lineage(dealt.mapInArrow(_advancer(OF_TURNS, False), CELLS_DDL))
    whole = []
    while True:
        counted = cells.groupBy(F.col("conv_id").alias("_conv")).agg(F.count_distinct("cell").alias("_n"))
        many = cut_lineage(counted.where("_n > 1"))
        same = F.col("conv_id").eqNullSafe(F.col("_conv"))
        whole.append(cells.join(many, same, "left_anti"))
        if many.isEmpty():
            break
        above = F.when(F.col("_n") <= CELL, 0).otherwise(F.shiftright("cell", SHIFT)).cast("long").alias("above")
        columns = [c for c in CELLS.names if c != "conv_id"]
        parts = cells.join(many, same).select("conv_id", above, *columns)
        dealt = parts.repartition("conv_id", "above").sortWithinPartitions("conv_id", "above", "cell")
        cells = cut_lineage(dealt.mapInArrow(_advancer(OF_CELLS, True), CELLS_DDL))
    found = whole[0]
    for more in whole[1:]:
        found = found.unionByName(more)
    return found


def audits(ordered: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` for every conversation that has rows."""
    count = lambda c: F.count_if(c).alias(c)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    facts = ordered.groupBy("conv_id").agg(gaps, count("blank"), count("duplicate"), count("truncated"))
    lacks = F.when(F.col("state") == 1, 2).when(F.col("state") == 2, 1).otherwise(0)
    closed = F.struct((F.col("cost") + INSERT * lacks).alias("cost"), F.concat("audit", F.repeat(F.lit("I"), lacks)).alias("audit"))
    best = ways(ordered).where("start = 0").groupBy(F.col("conv_id").alias("_conv")).agg(F.min(closed).alias("best"), F.max("illegal").alias("illegal"))
    met = facts.join(best, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return met.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _streams(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows in order, in one task and side by side."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    heads = judged.select(
        "conv_id", F.lit(0).alias("is_row"), none("long", "turn"), none("binary", "content"), none("string", "role"),
        F.col("audit").alias("text"), F.array(*FACTS).alias("facts"),
    )
    turns = rows.select("conv_id", F.lit(1).alias("is_row"), "turn", "content", "role", "text", none("array<long>", "facts"))
    dealt = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "content")
    return dealt.select("conv_id", "is_row", "role", "text", "facts")


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """For each slice of _streams(), heads ``(conv_id, facts, audit)`` and repaired turns ``(conv_id, role, text, edit)``."""
    conv, audit, at, state = None, "", 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            yield turn(None, "")

    def turn(role: str | None, text: str) -> tuple:
        nonlocal at, state
        edit, at = audit[at], at + 1
        letter = role[0] if role else "a" if state == 2 else "u"
        state = NEXT[state, letter]
        return conv, role or NAMES[letter], text, edit

    for ids, is_row, roles, texts, facts in slices(batches):
        out: list[tuple] = []
        for row_conv, of_turn, role, text, told in zip(ids, is_row, roles, texts, facts, strict=True):
            if not of_turn:
                out += inserted()
                conv, audit, at, state = row_conv, text, 0, 0
                out.append((conv, told, audit))
                continue
            out += inserted()
            if audit[at] == "D":
                at += 1
            else:
                out.append(turn(role if audit[at] == "K" else None, text))
        yield out
    yield list(inserted())


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = 0
    for some in edited(batches):
        rows = []
        for row in some:
            if len(row) == 3:
                place = 0
                continue
            rows.append((row[0], place, *row[1:]))
            place += 1
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in TURNS_DDL.split(", ")])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head, digest, n = None, hashlib.sha256(), 0
    names = [c.split()[0] for c in DIGEST_DDL.split(",")]
    kinds = [pa.string() if c.split()[1] == "string" else pa.int64() for c in DIGEST_DDL.split(",")]

    def done() -> list[tuple]:
        return [] if head is None else [(head[0], *head[1], head[2], digest.hexdigest(), n)]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for some in edited(batches):
        rows = []
        for row in some:
            if len(row) == 3:
                rows += done()
                head, digest, n = row, hashlib.sha256(), 0
            else:
                digest.update(f"{chr(10) if n else ''}{row[1]}:{row[2]}".encode())
                n += 1
        yield made(rows)
    yield made(done())


def _judged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = clean(rows)
    return rows, audits(cut_lineage(in_order(rows)))


def repair(rows: DataFrame) -> DataFrame:
    """The repaired turns of rows of ``conv_id, turn, role, text``: ``conv_id, place, role, text, edit``, inserted turns included."""
    return _streams(*_judged(rows)).mapInArrow(_turns, TURNS_DDL)


def digest(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Faults, cost, audit and a digest of the repaired turns for every ``conv_id`` of ``conversations``, with rows left or not."""
    rows, judged = _judged(rows)
    every = conversations.select(F.col("conv_id").cast("long").alias("_conv")).distinct()
    met = every.join(judged, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    zero = F.lit(0).cast("long")
    heads = met.select(F.col("_conv").alias("conv_id"), *(F.coalesce(c, zero).alias(c) for c in FACTS), F.coalesce("audit", F.lit("")).alias("audit"))
    return _streams(rows, heads).mapInArrow(_digests, DIGEST_DDL)
