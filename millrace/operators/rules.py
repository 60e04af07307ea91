"""The objective rules that an action must pass, over the state that its session had shown before it.

Every fact is found for all actions at once: the state as of an action is a running value over its session,
or the latest of a set of disjoint intervals, never a loop over events. What an action changes holds from the
next row on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import utf16
from millrace.operators.joins import as_of, as_of_many
from millrace.session import cut_lineage

SESSION, SEQ = "session_id", "seq"
NEVER = 2**62
#: The closed set of action types, and the block codes in the order in which they are checked.
TYPES = ("idle", "mark", "delegate", "integrate", "skip", "respond", "schedule", "cancel", "nudge")
CODES = (
    "malformed_action", "payload_limit_exceeded", "unknown_reference", "reason_mismatch", "span_mismatch", "result_not_ready",
    "fire_not_open", "timer_not_active", "duplicate_schedule", "duplicate_tool_request", "floor_owned", "target_already_handled",
    "timer_limit_exceeded", "stale_decision",
)
AWAITING_TOOL, AWAITING_OPENING, ALREADY_HANDLED = "awaiting_tool", "awaiting_opening", "already_handled"
CANCELED_TIMER = "canceled_timer"


@dataclass(frozen=True)
class Limits:
    payload_bytes: int = 1500
    least_interval_ms: int = 5_000
    most_interval_ms: int = 45_000
    active_timers: int = 4


@dataclass(frozen=True)
class PolicyLog:
    """The rows of a session's log by what they are; every table has ``session_id`` and ``seq``.

    ``events``: kind (snapshot, fire, result or other), text, active, composing, timer, request, succeeded.
    ``actions``: raw, the action's JSON; target_seq, the event it refers to; reason, span_start, span_end, span_text,
    mark_seq, interval_ms, message, request, timer, cancel_all, payload_bytes, observed_seq.
    ``timer_changes``: timer, active.
    """

    events: DataFrame
    actions: DataFrame
    timer_changes: DataFrame


def parsed(actions: DataFrame) -> DataFrame:
    """Add ``type`` from the JSON in ``raw``; null where that is malformed or of a type outside the closed set."""
    action = F.from_json("raw", "type string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    typed = actions.withColumn("_action", action)
    known = F.col("_action._corrupt").isNull() & F.col("_action.type").isin(*TYPES)
    return typed.withColumn("type", F.when(known, F.col("_action.type"))).drop("_action")


def with_dispositions(events: DataFrame, actions: DataFrame) -> DataFrame:
    """Add ``done_at``: the first action that consumed a fire or result, or responded to a snapshot; null while it is open."""
    closing = F.col("type").isin("integrate", "skip", "nudge", "respond")
    ends = actions.groupBy(SESSION, F.col("target_seq").alias(SEQ)).agg(
        F.min(F.when(closing, F.col(SEQ))).alias("_closed"), F.min(F.when(F.col("type") == "respond", F.col(SEQ))).alias("_responded")
    )
    done = F.when(F.col("kind").isin("fire", "result"), F.col("_closed")).when(F.col("kind") == "snapshot", F.col("_responded"))
    return events.join(ends, [SESSION, SEQ], "left").withColumn("done_at", done).drop("_closed", "_responded")


def oldest_open(items: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Of ``session_id, seq, done_at`` the item that is the oldest open one, as intervals ``at`` to ``to_seq``.

    An item leads once all before it are done. The end of those is a running maximum, so the intervals of a session
    are disjoint and one as-of join finds the leader at any row.
    """
    done = F.coalesce("done_at", F.lit(NEVER))
    before = F.max("_done").over(Window.partitionBy(SESSION).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, -1))
    led = items.withColumn("_done", done).withColumn("_start", F.greatest(F.col(SEQ), F.coalesce(before, F.lit(-1))))
    return led.where(F.col("_done") > F.col("_start")).select(SESSION, (F.col("_start") + 1).alias("at"), F.col("_done").alias("to_seq"), *carry)


def requests(actions: DataFrame, events: DataFrame) -> DataFrame:
    """Each delegation with ``done_at``, the result of its request, and ``is_repeat``: it was made while one was pending."""
    asked = actions.where("type = 'delegate'").select(SESSION, SEQ, "request", F.col("target_seq").alias("fact_seq"), F.lit(True).alias("asks"))
    answered = events.where("kind = 'result'").select(SESSION, SEQ, "request", F.lit(None).cast("long").alias("fact_seq"), F.lit(False).alias("asks"))
    by = Window.partitionBy(SESSION, "request").orderBy(SEQ)
    later = by.rowsBetween(1, Window.unboundedFollowing)
    both = asked.unionByName(answered).withColumn("done_at", F.min(F.when(~F.col("asks"), F.col(SEQ))).over(later))
    return both.withColumn("is_repeat", F.coalesce(F.lag("asks").over(by), F.lit(False))).where("asks").drop("asks")


def active_counts(changes: DataFrame) -> DataFrame:
    """``session_id, at, n_active``: how many timers are active from row ``at`` on."""
    by = Window.partitionBy(SESSION, "timer").orderBy(SEQ)
    step = F.col("active").cast("int") - F.coalesce(F.lag("active").over(by), F.lit(False)).cast("int")
    steps = changes.withColumn("_step", step).groupBy(SESSION, (F.col(SEQ) + 1).alias("at")).agg(F.sum("_step").alias("_step"))
    upto = Window.partitionBy(SESSION).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(SESSION, "at", F.sum("_step").over(upto).alias("n_active"))


def _slot(session: str, timer: str) -> Column:
    return F.struct(F.col(session).alias("s"), F.col(timer).cast("long").alias("t")).alias("slot")


#: What each fact group adds to an action; a rule names those that it reads.
FACTS = ("target", "mark", "repeat", "snapshot", "results", "pending", "handled", "timers", "timer_active", "schedules", "marks")
NEEDS = {
    "malformed_action": (), "payload_limit_exceeded": (), "unknown_reference": ("target", "mark", "timer_active"),
    "reason_mismatch": ("target", "snapshot", "results", "pending", "handled", "timer_active"), "span_mismatch": ("target", "mark", "snapshot"),
    "result_not_ready": ("target",), "fire_not_open": ("target",), "timer_not_active": ("target", "timers", "timer_active"),
    "duplicate_schedule": ("target", "snapshot", "schedules"), "duplicate_tool_request": ("repeat",), "floor_owned": ("snapshot",),
    "target_already_handled": ("target", "marks"), "timer_limit_exceeded": ("timers",), "stale_decision": ("snapshot",),
}


def view(log: PolicyLog, needs: Sequence[str] = FACTS, judged: DataFrame | None = None) -> DataFrame:
    """Each action with the facts of the groups in ``needs``; actions keep their columns. What no group needs is not computed.

    ``judged`` are actions, with their ``type``, that the log does not hold and that change nothing in it: each is seen as of
    its row, and any number may stand at one. With all groups the plan is cut where it grows, else it stays one plan, whose
    scans read the columns of these facts alone.
    """
    has = set(needs) | ({"target"} if "timer_active" in needs else set())
    cut = cut_lineage if len(has) > 6 else lambda df: df
    actions = cut(parsed(log.actions))
    source = actions if judged is None else judged
    done = has & {"target", "mark", "results", "handled", "repeat", "pending", "snapshot"}
    events = cut(with_dispositions(log.events, actions) if has & {"target", "results", "handled"} else log.events) if done else None
    out = source
    if "target" in has:
        about = F.struct("kind", "text", "timer", "succeeded", "done_at")
        out = out.join(events.select(SESSION, F.col(SEQ).alias("target_seq"), about.alias("target")), [SESSION, "target_seq"], "left")
    if "mark" in has:
        out = out.join(events.select(SESSION, F.col(SEQ).alias("mark_seq"), F.struct("kind", "text").alias("mark")), [SESSION, "mark_seq"], "left")
    asked = requests(actions, events) if has & {"repeat", "pending"} else None
    if "repeat" in has:
        answered = events.where("kind = 'result'").select(_slot(SESSION, "request"), (F.col(SEQ) + 1).alias("at"), F.lit(False).alias("asks"))
        both = asked.select(_slot(SESSION, "request"), (F.col(SEQ) + 1).alias("at"), F.lit(True).alias("asks")).unionByName(answered)
        out = as_of(out.withColumn("slot", _slot(SESSION, "request")), both, "slot", SEQ, "at", ["asks"]).drop("slot")
        out = out.withColumn("is_repeat", (F.col("type") == "delegate") & F.coalesce("as_of_asks", F.lit(False))).drop("as_of_asks")

    tables: dict[str, DataFrame] = {}
    held = lambda name, column: F.when(F.col(SEQ) <= F.col(f"{name}.to_seq"), F.col(f"{name}.{column}"))
    facts: dict[str, Column] = {}
    if "snapshot" in has:
        owned = (F.col("active") | F.col("composing")).alias("owned")
        tables["snapshot"] = events.where("kind = 'snapshot'").select(SESSION, F.col(SEQ).alias("at"), F.col(SEQ).alias("seq_of"), owned, "text")
        facts |= {
            "latest_snapshot": F.col("snapshot.seq_of"), "latest_text": F.col("snapshot.text"), "floor_owned": F.coalesce("snapshot.owned", F.lit(False)),
            "newer_snapshot": F.coalesce(F.col("snapshot.seq_of") > F.col("observed_seq"), F.lit(False)),
        }
    if "results" in has:
        results = events.where("kind = 'result'").withColumn("result_seq", F.col(SEQ))
        tables |= {"succeeded_now": oldest_open(results.where("succeeded"), ["result_seq"]), "failed_now": oldest_open(results.where("NOT succeeded"), ["result_seq"])}
        facts |= {"oldest_succeeded": held("succeeded_now", "result_seq"), "oldest_failed": held("failed_now", "result_seq")}
    if "pending" in has:
        tables["pending_now"] = oldest_open(asked, ["fact_seq"])
        facts["oldest_pending_fact"] = held("pending_now", "fact_seq")
    if "handled" in has:
        by_end = Window.partitionBy(SESSION).orderBy("done_at").rangeBetween(Window.unboundedPreceding, 0)
        first = F.min(SEQ).over(by_end).alias("first")
        tables["handled_now"] = events.where("done_at IS NOT NULL").select(SESSION, (F.col("done_at") + 1).alias("at"), first).distinct()
        facts["earliest_handled"] = F.col("handled_now.first")
    if "timers" in has:
        tables["timers_now"] = active_counts(log.timer_changes)
        facts["n_active_timers"] = F.coalesce("timers_now.n_active", F.lit(0)).cast("long")
    if tables:
        out = cut(as_of_many(out, SESSION, SEQ, tables)).withColumns(facts).drop(*tables)
    if "timer_active" in has:
        meant = F.when(F.col("type") == "cancel", F.col("timer").cast("long")).otherwise(F.col("target.timer").cast("long"))
        statuses = log.timer_changes.select(_slot(SESSION, "timer"), (F.col(SEQ) + 1).alias("at"), "active")
        out = as_of(out.withColumn("_timer", meant).withColumn("slot", _slot(SESSION, "_timer")), statuses, "slot", SEQ, "at", ["active"])
        out = out.withColumnRenamed("as_of_active", "timer_active").drop("slot", "_timer")
    span = ("span_start", "span_end", "span_text")
    if "schedules" in has:
        out = _with_first(out, actions, "schedule", "earlier_span", span)
        out = _with_first(out, actions, "schedule", "earlier_instruction", ("target_seq", *span))
    if "marks" in has:
        out = _with_first(out, actions, "mark", "earlier_mark", ("target_seq", "mark_seq", "span_start"))
    return cut(out)


def _with_first(out: DataFrame, actions: DataFrame, kind: str, name: str, by: Sequence[str]) -> DataFrame:
    """Add ``name``: whether the log has an action of a kind before this row that agrees with it in ``by``, nulls alike."""
    first = actions.where(F.col("type") == kind).groupBy(SESSION, *by).agg(F.min(SEQ).alias("_first"))
    first = first.withColumnsRenamed({c: f"_{c}" for c in (SESSION, *by)})
    on = out[SESSION].eqNullSafe(first[f"_{SESSION}"])
    for c in by:
        on &= out[c].eqNullSafe(first[f"_{c}"])
    met = out.join(first, on, "left").withColumn(name, F.coalesce(F.col("_first") < F.col(SEQ), F.lit(False)))
    return met.drop("_first", *(f"_{c}" for c in (SESSION, *by)))


def semantic_repeats(actions: DataFrame) -> DataFrame:
    """Schedules that ask for the interval and message of an earlier one of their session, whatever their instruction."""
    same = Window.partitionBy(SESSION, "interval_ms", "message").orderBy(SEQ)
    asked = parsed(actions).where("type = 'schedule'").withColumn("nth", F.row_number().over(same))
    return asked.where("nth > 1").select(SESSION, SEQ, "interval_ms", "message", "nth")


def _slice_differs(event: str) -> Column:
    cut = utf16.piece(F.col(f"{event}.text"), F.col("span_start"), F.col("span_end"))
    return ~F.coalesce((F.col(f"{event}.kind") == "snapshot") & (cut == F.col("span_text")), F.lit(False))


def rules(limits: Limits = Limits()) -> dict[str, Column]:
    """A condition over view() for each block code, in order; a malformed action breaks the first alone."""
    kind, c = F.col("type"), F.col
    is_open = c("target.done_at").isNull() | (c("target.done_at") >= c(SEQ))
    target, failed = c("target.kind"), ~c("target.succeeded")
    refers = (kind != "idle") | c("reason").isin(AWAITING_TOOL, AWAITING_OPENING, ALREADY_HANDLED)
    one_timer = (kind == "cancel") & ~c("cancel_all")
    differs = lambda name: ~c(name).eqNullSafe(c("target_seq"))
    subject = F.coalesce("oldest_succeeded", "oldest_failed", "latest_snapshot")
    idle = (
        F.when(c("reason") == AWAITING_TOOL, differs("oldest_pending_fact"))
        .when(c("reason") == AWAITING_OPENING, ~subject.eqNullSafe(c("target_seq")))
        .when(c("reason") == ALREADY_HANDLED, differs("earliest_handled"))
    )
    respond = F.when((target == "result") & failed & is_open, differs("oldest_failed")).when(
        target == "snapshot", c("oldest_failed").isNotNull() | differs("latest_snapshot")
    )
    in_latest = utf16.piece(c("latest_text"), c("span_start"), c("span_end"))
    canceled = (target == "fire") & ~F.coalesce("timer_active", F.lit(True))
    skip = F.when(c("reason") == CANCELED_TIMER, ~F.coalesce(canceled, F.lit(False))).otherwise(~F.coalesce(target == "result", F.lit(False)))
    held = {
        "payload_limit_exceeded": c("payload_bytes") > limits.payload_bytes,
        "unknown_reference": (refers & target.isNull())
        | ((kind == "mark") & c("mark.kind").isNull())
        | (one_timer & c("timer_active").isNull())
        | ((kind == "respond") & ~((target == "snapshot") | ((target == "result") & failed))),
        "reason_mismatch": F.when(kind == "idle", idle).when(kind == "respond", respond).when(kind == "skip", skip),
        "span_mismatch": (kind.isin("mark", "delegate", "schedule", "cancel") & _slice_differs("target"))
        | ((kind == "mark") & (_slice_differs("mark") | ~c("mark_seq").eqNullSafe(c("latest_snapshot")))),
        "result_not_ready": (kind == "integrate") & ~F.coalesce((target == "result") & c("target.succeeded"), F.lit(False)),
        "fire_not_open": (kind == "nudge") & ~F.coalesce((target == "fire") & is_open, F.lit(False)),
        "timer_not_active": F.when((kind == "nudge") & (target == "fire") | one_timer, ~F.coalesce("timer_active", F.lit(False))).when(
            kind == "cancel", c("n_active_timers") == 0
        ),
        # A timer's instruction is where it was given, and where it stands in the latest snapshot if that still has it there.
        "duplicate_schedule": (kind == "schedule")
        & (c("earlier_instruction") | (c("earlier_span") & (c("target_seq") == c("latest_snapshot")) & (in_latest == c("span_text")))),
        "duplicate_tool_request": (kind == "delegate") & c("is_repeat"),
        "floor_owned": (kind == "respond") & c("floor_owned"),
        "target_already_handled": ((kind == "mark") & c("earlier_mark"))
        | (kind.isin("integrate", "skip") & ~F.coalesce(target.isin("fire", "result") & is_open, F.lit(False)))
        | ((kind == "respond") & target.isin("result", "snapshot") & ~is_open),
        "timer_limit_exceeded": (kind == "schedule")
        & (~c("interval_ms").between(limits.least_interval_ms, limits.most_interval_ms) | (c("n_active_timers") >= limits.active_timers)),
        "stale_decision": (kind == "respond") & c("newer_snapshot"),
    }
    return {"malformed_action": kind.isNull()} | {code: kind.isNotNull() & F.coalesce(rule, F.lit(False)) for code, rule in held.items()}


#: What a rule may wait for, the types of action that wait for it, and how the view looks once it has come.
RELEASES = {
    "request_pending": (("delegate",), {"is_repeat": F.lit}),
    "floor_owned": (("respond",), {"floor_owned": F.lit}),
    "timer_active": (("nudge", "skip"), {"timer_active": lambda _: F.col("type") == "nudge"}),
}


def one_variable_releases(seen: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Blocked actions of view(), each with what one variable alone would change: ``session_id, seq, type, variable, blocked_by, still_blocked_by, released``.

    A pending request is answered, the floor given up, the timer of a fire set active for a nudge and canceled for a skip; every
    rule is then asked again. ``still_blocked_by`` is the first that holds.
    """
    blocked = _first_block(seen, limits, "blocked_by").where("blocked_by IS NOT NULL AND type IS NOT NULL")
    out: DataFrame | None = None
    for variable, (types, changes) in RELEASES.items():
        changed = blocked.where(F.col("type").isin(*types)).withColumns({c: to(False) for c, to in changes.items()})
        again = _first_block(changed, limits, "still_blocked_by").withColumn("variable", F.lit(variable))
        again = again.select(SESSION, SEQ, "type", "variable", "blocked_by", "still_blocked_by", F.col("still_blocked_by").isNull().alias("released"))
        out = again if out is None else out.unionByName(again)
    return out


def _first_block(seen: DataFrame, limits: Limits, name: str) -> DataFrame:
    hits = [F.when(F.coalesce(held, F.lit(False)), F.lit(code)) for code, held in rules(limits).items()]
    return seen.withColumn(name, F.coalesce(*hits))


def schedule_key(instruction: Column, interval_ms: Column, message: Column) -> Column:
    """A digest that retries of one schedule share: of the canonical JSON of its instruction, interval and message."""
    body = F.to_json(F.struct(instruction.alias("instruction_id"), interval_ms.alias("interval_ms"), message.alias("message")))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("schedule-key-v1\0"), body), 256))


def timer_sources(timers: DataFrame, actions: DataFrame, span: Sequence[str]) -> DataFrame:
    """``timers`` with ``source_seq``, the one schedule of their session with the same span, and ``problem``: none, missing or ambiguous.

    Schedules are counted by span before they meet the timers, so a span scheduled any number of times is one row of the join.
    """
    found = actions.groupBy(SESSION, *span).agg(F.count(F.lit(1)).alias("_n"), F.min(SEQ).alias("_seq"))
    found = found.withColumnsRenamed({c: f"_{c}" for c in (SESSION, *span)})
    on = F.lit(True)
    for c in (SESSION, *span):
        on &= timers[c].eqNullSafe(found[f"_{c}"])
    met = timers.join(found, on, "left")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("none")
    return met.select(*timers.columns, F.when(F.col("_n") == 1, F.col("_seq")).alias("source_seq"), problem.alias("problem"))
