"""Actions that a decision could have taken: made from what was shown, judged by the rules, the first of each type kept."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from millrace.functions import utf16
from millrace.operators import rules as R
from millrace.operators import state as S
from millrace.operators.joins import as_of, as_of_many
from millrace.operators.rules import SEQ, SESSION, Limits, PolicyLog
from millrace.session import cut_lineage

_WORD = re.compile(r"\w+")
REQUESTS = 4


@udtf(returnType="nth int, span_start int, span_end int, span_text string")
class LexicalSpans:
    """The words of a text with their places in UTF-16 units, one row each, and the whole text as row -1; none of an empty text."""

    def eval(self, text: str) -> Iterator[tuple[int, int, int, str]]:
        if not text:
            return
        units = at = 0
        for nth, word in enumerate(_WORD.finditer(text)):
            units += len(text[at : word.start()].encode("utf-16-le")) // 2
            end = units + len(word.group().encode("utf-16-le")) // 2
            yield nth, units, end, word.group()
            units, at = end, word.end()
        yield -1, 0, units + len(text[at:].encode("utf-16-le")) // 2, text


def _first_active(changes: DataFrame) -> DataFrame:
    """``session_id, at, first_active``: the least timer that is active from row ``at`` on, after each row that changed one."""

    def step(state: dict, row: tuple) -> tuple:
        seq, timer, active = row
        running = state.setdefault("running", set())
        (running.add if active else running.discard)(timer)
        return seq, min(running, default=None)

    rows = changes.select(SESSION, SEQ, F.col("timer").cast("long").alias("timer"), "active")
    schema = f"{SESSION} long, {SEQ} long, first_active long, timer long"
    after = S.fold(rows, SESSION, [SEQ, "timer"], [SEQ, "timer", "active"], lambda state, row: (*step(state, row), row[1]), schema)
    # Of several changes at one row, that of the greatest timer comes last and has seen them all.
    best = after.groupBy(SESSION, SEQ).agg(F.max_by("first_active", "timer").alias("first_active"))
    return best.select(SESSION, (F.col(SEQ) + 1).alias("at"), "first_active")


def held(log: PolicyLog) -> PolicyLog:
    """``log`` with each table written once, as candidates and their view read them many times over."""
    return PolicyLog(*map(cut_lineage, (log.events, log.actions, log.timer_changes)))


def synthetic(log: PolicyLog, limits: Limits = Limits()) -> DataFrame:
    """Candidate actions for each of the log's actions of a known type, in order ``place``, with all columns that the rules read.

    One idle; of each word of the latest snapshot a mark and a delegation, of each and of the whole a schedule; an answer to it; the cancellation of
    the first active timer; and of the oldest open result and the oldest open fire a skip or, if the fire's timer is active, a nudge.
    What was seen and its spans are written once, not found anew for each kind of candidate.
    """
    actions = R.parsed(log.actions)
    events = cut_lineage(R.with_dispositions(log.events, actions))
    snapshots = events.where("kind = 'snapshot'").select(SESSION, F.col(SEQ).alias("at"), F.col(SEQ).alias("seq_of"), "text")
    tables = {"snapshot": snapshots, "timers": _first_active(log.timer_changes)}
    for kind in ("result", "fire"):
        tables[kind] = R.oldest_open(events.where(F.col("kind") == kind).select(SESSION, SEQ, "done_at", F.col(SEQ).alias("item"), "timer"), ["item", "timer"])
    decisions = actions.where("type IS NOT NULL").select(SESSION, SEQ, F.col("type").alias("taken"))
    seen = as_of_many(decisions, SESSION, SEQ, tables)
    open_item = lambda kind, column: F.when(F.col(SEQ) <= F.col(f"{kind}.to_seq"), F.col(f"{kind}.{column}"))
    seen = seen.select(
        SESSION, SEQ, "taken", F.col("snapshot.seq_of").alias("latest"), F.coalesce("snapshot.text", F.lit("")).alias("latest_text"), F.col("timers.first_active"),
        open_item("result", "item").alias("open_result"), open_item("fire", "item").alias("open_fire"), open_item("fire", "timer").cast("long").alias("fire_timer"),
    )
    statuses = log.timer_changes.select(R._slot(SESSION, "timer"), (F.col(SEQ) + 1).alias("at"), "active")
    seen = as_of(seen.withColumn("slot", R._slot(SESSION, "fire_timer")), statuses, "slot", SEQ, "at", ["active"]).withColumnRenamed("as_of_active", "fire_active").drop("slot")
    seen = cut_lineage(seen)

    def of(rows: DataFrame, kind: str, group: int, **columns) -> DataFrame:
        none = lambda t: F.lit(None).cast(t)
        kinds = {
            "target_seq": "long", "reason": "string", "span_start": "int", "span_end": "int", "span_text": "string", "mark_seq": "long", "interval_ms": "long",
            "message": "string", "request": "long", "timer": "long", "cancel_all": "boolean", "nth": "int",
        }
        made = {name: columns[name].cast(t) if name in columns else none(t) for name, t in kinds.items()}
        text = F.coalesce(made["message"], made["span_text"], F.lit(""))
        return rows.select(
            SESSION, SEQ, "taken", F.lit(kind).alias("type"), *(c.alias(n) for n, c in made.items() if n != "nth"), F.col("latest").alias("observed_seq"),
            F.octet_length(text).cast("long").alias("payload_bytes"), F.struct(F.lit(group).alias("g"), F.coalesce(made["nth"], F.lit(0)).alias("n")).alias("place"),
        )

    shown = seen.where("latest_text <> ''")
    spans = cut_lineage(shown.lateralJoin(LexicalSpans(F.col("latest_text").outer())))
    words, here = spans.where("nth >= 0"), F.col("latest")
    span = {c: F.col(c) for c in ("span_start", "span_end", "span_text")}
    whole = {"span_start": F.lit(0), "span_end": utf16.units(F.col("latest_text")), "span_text": F.col("latest_text")}
    interval = F.lit(min(limits.most_interval_ms, max(limits.least_interval_ms, 300_000)))
    request = F.crc32(F.col("span_text").cast("binary")) % REQUESTS
    last = F.when(F.col("nth") < 0, F.lit(2**31 - 1)).otherwise(F.col("nth"))
    parts = [
        of(seen, "idle", 0, reason=F.lit("no_new_instruction")),
        of(words, "mark", 1, target_seq=here, mark_seq=here, nth=F.col("nth"), **span),
        of(words, "delegate", 2, target_seq=here, request=request, nth=F.col("nth"), **span),
        of(spans, "schedule", 3, target_seq=here, interval_ms=interval, message=F.trim("span_text"), nth=last, **span),
        of(shown, "respond", 4, target_seq=here, message=F.lit("Understood.")),
        of(shown.where("first_active IS NOT NULL"), "cancel", 5, target_seq=here, timer=F.col("first_active"), cancel_all=F.lit(False), **whole),
        of(seen.where("open_result IS NOT NULL"), "skip", 6, target_seq=F.col("open_result"), reason=F.lit("stale_result")),
        of(seen.where("fire_active"), "nudge", 7, target_seq=F.col("open_fire"), timer=F.col("fire_timer")),
        of(seen.where("NOT fire_active"), "skip", 8, target_seq=F.col("open_fire"), reason=F.lit("canceled_timer"), timer=F.col("fire_timer")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def allowed(log: PolicyLog, limits: Limits = Limits()) -> DataFrame:
    """Of each decision the first candidate of every type that it did not take itself, if no rule blocks it: ``synthetic()``'s columns."""
    log = held(log)
    candidates = synthetic(log, limits).where("type <> taken")
    judged = S.blocks(R.view(log, judged=candidates), R.rules(limits)).where("first_block IS NULL")
    columns = [c for c in candidates.columns if c not in (SESSION, SEQ, "type", "taken")]
    best = judged.groupBy(SESSION, SEQ, "taken", "type").agg(F.min_by(F.struct(*columns), "place").alias("_c"))
    return best.select(SESSION, SEQ, "taken", "type", "_c.*")


#: Fixed value: of actions that are allowed at once, the first of these is the one to take.
RANKING = ("cancel", "schedule", "nudge", "skip", "mark", "integrate", "delegate", "respond", "idle")


def winners(log: PolicyLog, limits: Limits = Limits()) -> DataFrame:
    """``session_id, seq, taken, taken_allowed, winner, wins``: of the action taken and what else was allowed, the type that ranks first.

    ``winner`` is null where nothing is allowed; ``wins`` says that the action taken is the winner.
    """
    log = held(log)
    others = synthetic(log, limits).where("type <> taken").drop("place").withColumn("offered", F.lit(True))
    own = R.parsed(log.actions).where("type IS NOT NULL").withColumns({"taken": F.col("type"), "offered": F.lit(False)}).select(*others.columns)
    judged = S.blocks(R.view(log, judged=own.unionByName(others)), R.rules(limits)).withColumn("_fine", F.col("first_block").isNull())
    rank = F.array_position(F.array(*map(F.lit, RANKING)), F.col("type"))
    best = judged.groupBy(SESSION, SEQ, "taken").agg(
        F.max(F.when(~F.col("offered"), F.col("_fine"))).alias("taken_allowed"), F.min(F.when(F.col("_fine"), F.struct(rank.alias("r"), "type"))).alias("_best")
    )
    winner = F.col("_best.type")
    return best.select(SESSION, SEQ, "taken", "taken_allowed", winner.alias("winner"), F.coalesce(winner == F.col("taken"), F.lit(False)).alias("wins"))
