"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own, written out in full: all preceding turns as context,
that reply alone trainable. The examples of a conversation of n turns therefore hold its text about n / 2
times over; that is the method, and the work is dealt accordingly.

First the turns are dealt by ranges of (conversation, turn), so that a long conversation spreads over as
many tasks as its rows need, formatted, and numbered: within each task, then across tasks by the counts of
the few conversations that a range boundary cuts. Then ``BLOCK`` consecutive replies of a conversation are
one unit of work, to which all segments up to them are sent; a task streams these in order, holds the
prefix of one example, and writes an example at each reply of its block.

The template marks turns with the control strings below. Where a text holds one, a backslash is put
behind its opening bracket, and one more where backslashes already stand there, so that parsing gives
back every text exactly.

Cases, all defined: a null text is empty; a null role is the empty role; a null conversation id is a
conversation. Equal turn numbers are ordered by role and text, so repeated rows are turns of their
own, one after the other; a null turn number comes first. Turns after the last reply belong to one
more example without a trainable part, so no turn is lost. An empty table gives an empty result. Only
the four columns named are read. An example is one row, so the longest must fit a task's memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.batches import slices
from millrace.session import cut_lineage

#: Fixed values of the template: opening and closing control strings by role.
MARKS = {
    "user": ("[INST]", "[/INST]"),
    "assistant": ("<s>", "</s>"),
    "system": ("<<SYS>>", "<</SYS>>"),
}
OTHER_ROLE = ("[ROLE={}]", "[/ROLE]")
TRAINABLE_ROLE = "assistant"
#: An opening bracket, backslashes, and what would complete a control string.
CONTROL = r"(<<|<|\[)(\\*)(/?(?:INST\]|s>|SYS>>|ROLE))"
#: Replies of one conversation whose examples one task writes.
BLOCK = 256
#: Characters of examples that are handed on at a time.
BATCH_CHARS = 4_000_000

_CONTROL = re.compile(CONTROL)
_ESCAPED = re.compile(CONTROL.replace(r"(\\*)", r"\\(\\*)"))
_OPENING = re.compile(r"(\[INST\]|<s>|<<SYS>>|\[ROLE=([0-9a-f]*)\]) ")

SEGMENTS = pa.schema(
    [
        ("conv_id", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), ("example", pa.int64()),
        ("segment", pa.string()), ("trainable", pa.bool_()), ("body_start", pa.int64()), ("body_end", pa.int64()),
    ]
)
SEGMENTS_DDL = "conv_id long, part int, nth long, example long, segment string, trainable boolean, body_start long, body_end long"
EXAMPLES = pa.schema(
    [("conv_id", pa.int64()), ("example", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]
)
EXAMPLES_DDL = "conv_id long, example long, text string, loss_start long, loss_end long"
PARSED = pa.schema(
    [
        ("conv_id", pa.int64()), ("example", pa.int64()), ("chars", pa.int64()), ("loss", pa.string()),
        ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
    ]
)
PARSED_DDL = "conv_id long, example long, chars long, loss string, n_turns long, turns_sha256 string"
DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ]
)
DIGEST_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment, and where in it the escaped text starts and ends."""
    opening, closing = MARKS.get(role) or (OTHER_ROLE[0].format(role.encode().hex()), OTHER_ROLE[1])
    body = escape(text)
    start = len(opening) + 1
    return f"{opening} {body} {closing}", start, start + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted text. No escaped text holds a control string, so the next closing one ends a turn."""
    turns, at = [], 0
    while at < len(text):
        opening = _OPENING.match(text, at)
        if not opening:
            raise ValueError("not a text of this template")
        role = next((name for name, (mark, _) in MARKS.items() if mark == opening[1]), None)
        closing = " " + (OTHER_ROLE[1] if role is None else MARKS[role][1])
        end = text.find(closing, opening.end())
        if end < 0:
            raise ValueError("a turn without an end")
        turns.append((bytes.fromhex(opening[2]).decode() if role is None else role, unescape(text[opening.end() : end])))
        at = end + len(closing)
    return turns


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    current: object = _format  # equal to no id
    nth = example = 0
    for ids, roles, texts in slices(batches):
        rows = []
        for conv, role, text in zip(ids, roles, texts, strict=True):
            if conv != current:
                current, nth, example = conv, 0, 0
            reply = role == TRAINABLE_ROLE
            segment, start, end = format_turn(role or "", text or "")
            rows.append((conv, part, nth, example, segment, reply, start, end))
            nth, example = nth + 1, example + reply
        yield _emit(rows, SEGMENTS)


def segments(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The formatted turns: ``conv_id, nth, example, segment, trainable, body_start, body_end, last_block``.

    ``turns`` has ``conv_id, turn, role, text``. Turn ``nth`` of its conversation is new in example number
    ``example``; ``last_block`` is the block of the conversation's last example.
    """
    rows = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64))
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text")
    local = cut_lineage(ordered.select("conv_id", "role", "text").mapInArrow(_format, SEGMENTS_DDL))
    counted = local.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.count_if("trainable").alias("replies"))
    by_part = Window.partitionBy("conv_id").orderBy("part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.select(
        F.col("conv_id").alias("_conv"),
        F.col("part").alias("_part"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_nth"),
        F.coalesce(F.sum("replies").over(before), F.lit(0)).alias("_example"),
        F.floor(F.sum("replies").over(Window.partitionBy("conv_id")) / block).cast("long").alias("_last"),
    )
    # Left are conversations that a range boundary cuts, two for each task at most, and those of more than a block.
    moved = placed.where("_nth > 0 OR _last > 0")
    joined = local.join(moved, local["conv_id"].eqNullSafe(moved["_conv"]) & (local["part"] == moved["_part"]), "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "conv_id", (F.col("nth") + F.coalesce("_nth", zero)).alias("nth"), (F.col("example") + F.coalesce("_example", zero)).alias("example"),
        "segment", "trainable", "body_start", "body_end", F.coalesce("_last", zero).alias("last_block"),
    )


def _writer(block: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = _writer
        prefix, since, size = "", [], 0  # the text up to the block's last example, what came since, and the length of both
        rows, held, example, open_end = [], 0, 0, False

        def whole() -> str:
            nonlocal prefix, since
            prefix, since = "".join([prefix, *since]), []
            return prefix

        def ended() -> list[tuple]:
            return [(current[0], example, whole(), None, None)] if open_end else []

        for ids, blocks, last_blocks, numbers, parts, trainable, starts, stops in slices(batches):
            for conv, b, last, number, segment, reply, start, stop in zip(ids, blocks, last_blocks, numbers, parts, trainable, starts, stops, strict=True):
                if (conv, b) != current:
                    rows += ended()
                    current, prefix, since, size = (conv, b), "", [], 0
                since.append(segment)
                at, size, example = size, size + len(segment), number
                open_end = not reply and b == last
                if reply and number // block == b:
                    rows.append((conv, number, whole(), at + start, at + stop))
                    held += size
                if held > BATCH_CHARS:
                    yield _emit(rows, EXAMPLES)
                    rows, held = [], 0
        yield _emit(rows + ended(), EXAMPLES)

    return write


def expand(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, example, text, loss_start, loss_end``: every example as one string, of which the characters from
    ``loss_start`` to ``loss_end`` are trainable; both are null for turns after the last reply."""
    first = F.floor(F.col("example") / block).cast("long")
    sent = segments(turns, block).withColumn("block", F.explode(F.sequence(first, F.greatest(first, "last_block"))))
    dealt = sent.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "nth")
    columns = ["conv_id", "block", "last_block", "example", "segment", "trainable", "body_start", "body_end"]
    return dealt.select(*columns).mapInArrow(_writer(block), EXAMPLES_DDL)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each example's length and loss text; the turns, which the next example of its conversation repeats, of a run's last alone."""
    last: tuple | None = None

    def parsed(row: tuple, whole: bool) -> tuple:
        conv, example, text, start, end = row
        loss = None if start is None else unescape(text[start:end])
        turns = parse(text) if whole else []
        digest = hashlib.sha256("".join(f"{role}\n{body}\n" for role, body in turns).encode()).hexdigest()
        return (conv, example, len(text), loss, *((len(turns), digest) if whole else (None, None)))

    for columns in slices(batches, 16):
        rows = []
        for row in zip(*columns, strict=True):
            if last is not None:
                rows.append(parsed(last, row[0] != last[0] or row[1] <= last[1]))
            last = row
        yield _emit(rows, PARSED)
    if last is not None:
        yield _emit([parsed(last, True)], PARSED)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current: object = _digest
    loss, chars, total, of_turns = hashlib.sha256(), 0, 0, (0, "")

    def done() -> list[tuple]:
        return [] if current is _digest else [(current, *of_turns, chars, loss.hexdigest(), total)]

    for ids, _, lengths, losses, counts, digests in slices(batches):
        rows = []
        for conv, length, text, n, digest in zip(ids, lengths, losses, counts, digests, strict=True):
            if conv != current:
                rows += done()
                current, loss, chars, total = conv, hashlib.sha256(), 0, 0
            loss.update((text or "").encode())
            chars, total = chars + len(text or ""), total + length
            if n is not None:
                of_turns = (n, digest)
        yield _emit(rows, DIGEST)
    yield _emit(done(), DIGEST)


def read_back(examples: DataFrame) -> DataFrame:
    """A digest of each conversation, parsed from the texts and spans of its examples alone.

    ``formatted_chars`` counts every example in full, one without a trainable part included.
    """
    parsed = examples.select(*(f.name for f in EXAMPLES)).mapInArrow(_parse, PARSED_DDL)
    return parsed.repartition("conv_id").sortWithinPartitions("conv_id", "example").mapInArrow(_digest, DIGEST_DDL)
