"""State over ordered logs: coalescing, timers, ledgers, rules, and folds for what windows cannot say."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from millrace.functions import alignment
from millrace.operators.sequence import ordered, upto


def coalesce_pending(log: DataFrame, session: str, seq: str, kind: str, decision: str, snapshot: str, fire: str, timer: str, missed: str) -> DataFrame:
    """What is left of the arrivals before each decision: the newest snapshot, one fire for each timer, all else.

    A fire that replaces others counts each of them and what they missed: ``missed`` is the sum plus their number
    less one. Survivors keep the place of the last arrival.
    """
    interval = F.coalesce(F.sum((F.col(kind) == decision).cast("long")).over(upto(session, [seq]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pending = log.withColumn("interval", interval).where(F.col(kind) != decision)
    group = F.when(F.col(kind) == snapshot, "").when(F.col(kind) == fire, F.concat(F.lit("t"), F.col(timer).cast("string"))).otherwise(F.concat(F.lit("e"), F.col(seq).cast("string")))
    merged = pending.groupBy(session, "interval", F.col(kind).alias("kind"), group.alias("_group")).agg(
        F.max(seq).alias("seq"), (F.sum(missed) + F.count(F.lit(1)) - 1).alias("_missed")
    )
    return merged.select(session, "interval", "kind", "seq", F.when(F.col("kind") == fire, F.col("_missed")).alias("missed"))


def superseded(fires: DataFrame, session: str, seq: str, timer: str, closed: Column) -> DataFrame:
    """Fires with the fire of the same timer right before, if that is still open: the one that each supersedes."""
    by = Window.partitionBy(session, timer).orderBy(seq)
    before = F.lag(F.struct(F.col(seq).alias("s"), closed.alias("c"))).over(by)
    return fires.withColumn("supersedes", F.when(~before["c"], before["s"]))


def claim_timers(timers: DataFrame, now: Column, anchor: str, interval: str, fire_count: str) -> DataFrame:
    """Fixed-rate claims at ``now``, all in milliseconds: fires so far, periods missed, lateness, next due; only of timers that are due."""
    elapsed = F.floor((now - F.col(anchor)) / F.col(interval)).cast("long")
    due = timers.withColumn("fires", elapsed).where(F.col("fires") > F.col(fire_count))
    return due.withColumn("missed", F.col("fires") - F.col(fire_count) - 1).withColumn(
        "late_ms", now - (F.col(anchor) + F.col("fires") * F.col(interval))
    ).withColumn("next_due", F.col(anchor) + (F.col("fires") + 1) * F.col(interval))


def ledger(log: DataFrame, keys: Sequence[str], seq: str, terminal: Column, state: str) -> DataFrame:
    """The state of each key: its first terminal state or 'open', by which row, and whether a second one came."""
    ends = F.when(terminal, F.struct(F.col(seq).alias("s"), F.col(state).alias("state")))
    found = log.groupBy(*keys).agg(F.min(ends).alias("_first"), F.count_if(terminal).alias("_n"))
    return found.select(*keys, F.coalesce("_first.state", F.lit("open")).alias("state"), F.col("_first.s").alias("by_seq"), (F.col("_n") > 1).alias("repeated"))


def active_before(log: DataFrame, session: str, seq: str, opens: Column, closes: Column) -> DataFrame:
    """Add ``active``: how many were opened and not closed in the rows before, never below zero at any time."""
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    before = ordered(session, [seq]).rowsBetween(Window.unboundedPreceding, -1)
    running = log.withColumn("_step", step).withColumn("_sum", F.coalesce(F.sum("_step").over(before), F.lit(0)))
    lowest = F.least(F.lit(0), F.min("_sum").over(upto(session, [seq])))
    return running.withColumn("active", F.col("_sum") - lowest).drop("_step", "_sum")


def blocks(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``first_block``, the code of the first rule that holds, and ``all_blocks``, those of all, in the order given."""
    hits = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules.items()))
    return rows.withColumn("all_blocks", F.array_compact(hits)).withColumn("first_block", F.get("all_blocks", F.lit(0)))


def compress(log: DataFrame, session: str, seq: str, columns: Sequence[str]) -> DataFrame:
    """Add ``state_id``, which rises where any of the columns changes; equal neighbours share one."""
    changed = F.when(F.struct(*columns).eqNullSafe(F.lag(F.struct(*columns)).over(ordered(session, [seq]))), 0).otherwise(1)
    return log.withColumn("state_id", (F.sum(changed).over(upto(session, [seq])) - 1).cast("long"))


def carry_forward(log: DataFrame, session: str, seq: str, column: str) -> DataFrame:
    """``column`` with nulls replaced by the last value before."""
    return log.withColumn(column, F.last(column, ignorenulls=True).over(upto(session, [seq])))


def lifecycle_errors(log: DataFrame, keys: Sequence[str], seq: str, state: str, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows whose state may not follow the one before."""
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(seq))
    legal = F.lit(False)
    for first, nexts in allowed.items():
        legal = legal | ((F.col("before") == first) & F.col(state).isin(*nexts))
    return log.withColumn("before", before).where(F.col("before").isNotNull() & ~legal)


Step = Callable[[dict, tuple], tuple]


def fold(log: DataFrame, session: str, order: Sequence[str], columns: Sequence[str], step: Step, schema: str) -> DataFrame:
    """Run ``step(state, row) -> output row`` over each session in order, ``state`` being an empty dict at its start.

    For what feeds back on itself: resets that depend on what was added since, packing under several limits,
    spans that live on from revision to revision. Rows are streamed, so a session may be of any length.
    Null sessions are one session. Numbers of 64 bits and nulls pass through unchanged.
    """
    kinds = to_arrow_schema(_parse_datatype_string(schema))
    rows = log.select(session, *columns, *(c for c in order if c not in columns))
    sorted_rows = rows.repartition(session).sortWithinPartitions(session, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), {}
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = [batch.column(i).slice(start, 1024).to_pylist() for i in range(1 + len(columns))]
                out = []
                for key, *values in zip(*part, strict=True):
                    if key != current:
                        current, state = key, {}
                    out.append((key, *step(state, tuple(values))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return sorted_rows.mapInArrow(run, schema)


def rollover(limit: int, checkpoint: int) -> Step:
    """Segment of each row by size: a row that finds the segment at its limit starts a new one, which holds a checkpoint from the start."""

    def step(state: dict, row: tuple) -> tuple:
        seq, size = row
        if state.get("held", 0) >= limit:
            state["segment"], state["held"] = state["segment"] + 1, checkpoint
        state["held"] = state.get("held", 0) + size
        return seq, state.setdefault("segment", 0), state["held"]

    return step


def pack(max_rows: int, max_bytes: int, max_tokens: int) -> Step:
    """Shard of each row: consecutive rows as long as none of three limits is passed."""

    def step(state: dict, row: tuple) -> tuple:
        item, n_bytes, n_tokens = row
        held = state.get("held", (0, 0, 0))
        new = (held[0] + 1, held[1] + n_bytes, held[2] + n_tokens)
        if held[0] and (new[0] > max_rows or new[1] > max_bytes or new[2] > max_tokens):
            state["shard"], new = state["shard"] + 1, (1, n_bytes, n_tokens)
        state["held"] = new
        return item, state.setdefault("shard", 0), *new

    return step


def _first_word(text: str, nth: int) -> tuple[str, int]:
    words = text.split()
    word = words[nth] if len(words) > nth else ""
    return word, text.find(word)


def follow_span(start_word: int = 0) -> Step:
    """Where the first word of a session's first text stands in each later one: null once its surroundings changed or repeat."""

    def step(state: dict, row: tuple) -> tuple:
        seq, text = row
        if "span" not in state:
            word, at = _first_word(text, start_word)
            state["span"] = (at, at + len(word)) if word else None
        elif state["span"] is not None:
            (a, b), old = state["span"], state["text"]
            state["span"] = None
            for i, j, size in alignment.matching_blocks(old, text):
                if i <= a and b <= i + size:
                    same = old[i : i + size]
                    if alignment.once(old, same) and alignment.once(text, same):
                        state["span"] = (a - i + j, b - i + j)
        state["text"] = text
        found = state["span"]
        return seq, None if found is None else found[0], None if found is None else found[1]

    return step


def _descendants(old: str, new: str, span: tuple[int, int], word: str, edits: list[alignment.Opcode]) -> tuple[set[tuple[int, int]], bool]:
    """Where one occurrence of ``word`` may stand in the next text, and whether the revision touched it.

    Within a block that both texts hold once, its place is certain. Within a repeated block it may be in any copy of that. Where an edit
    reaches into it, it is the one occurrence that overlaps what the edit made of it, if there is just one.
    """
    start, end = span
    block = next((e for e in edits if e[0] == "equal" and e[1] <= start and end <= e[2]), None)
    if block:
        same = old[block[1] : block[2]]
        offset = start - block[1]
        if alignment.once(old, same) and alignment.once(new, same):
            return {(block[3] + offset, block[3] + offset + end - start)}, False
        places = ((at + offset, at + offset + end - start) for at in alignment.occurrences(new, same))
        return {(x, y) for x, y in places if new[x:y] == word}, True
    reached = [e for e in edits if max(start, e[1]) < min(end, e[2]) or (e[1] == e[2] and start < e[1] < end)]
    if not reached:
        return set(), True
    low, high = min(e[3] for e in reached), max(e[4] for e in reached)
    overlaps = (lambda x, y: x < high and y > low) if low < high else (lambda x, y: x < low < y)
    near = {(x, x + len(word)) for x in alignment.occurrences(new, word) if overlaps(x, x + len(word))}
    return near if len(near) == 1 else set(), True


def follow_ambiguous(start_word: int = 0) -> Step:
    """All places where the first word of a session's first text may have come to stand: ``seq, touched, starts``.

    ``starts`` is empty before a revision touches the word, since its place is then certain, and for good once no place is left.
    """

    def step(state: dict, row: tuple) -> tuple:
        seq, text = row
        if "text" not in state:
            word, at = _first_word(text, start_word)
            state.update(word=word, places={(at, at + len(word))} if word else set(), touched=False)
        elif state["places"]:
            old, word = state["text"], state["word"]
            edits = list(alignment.opcodes(old, text))
            moved = [_descendants(old, text, span, word, edits) for span in sorted(state["places"])]
            state["touched"] |= any(touched for _, touched in moved)
            state["places"] = set().union(*(places for places, _ in moved))
        state["text"] = text
        found = sorted(x for x, y in state["places"] if text[x:y] == state["word"])
        return seq, state["touched"], found if state["touched"] else []

    return step


def reduce_visible(state: dict, row: tuple) -> tuple:
    """The visible state after each row of a log of (seq, kind, k): latest view, open timers, requests pending, errors since."""
    seq, kind, k = row
    timers = state.setdefault("timers", set())
    if kind == "view":
        state["view"] = k
    elif kind == "signup":
        timers.add(k % 16)
    elif kind == "purchase":
        timers.discard(k % 16)
    elif kind == "click":
        state["pending"] = state.get("pending", 0) + 1
    else:
        state["pending"] = 0
    return seq, state.get("view"), len(timers), state.get("pending", 0)
