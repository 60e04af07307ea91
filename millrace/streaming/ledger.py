"""A live ledger of timers and delayed results: map state by session, and event-time timers for what falls due.

Commands are held until the watermark has passed them, so they are handled in the order of their time whatever batch they
came in. What falls due at a time comes before the commands of that time, fires before results, each by name.

- ``schedule``: a fixed-rate timer under a name, its interval being ``amount``. A name that was ever scheduled is answered with what it has; a
  new one is refused if ``max_active`` timers run.
- ``cancel``: the timers of ``names``, all of them or, if one does not run, none. ``cancel_all``: all that run.
- ``request``: a result under a name, delivered ``amount`` later; while it is pending, the same name asks for nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "session_id long, at_ms long, what string, name string, n long, seq long"
MAX_ACTIVE = 16


@dataclass
class Ledger:
    """``timers``: name to (interval, anchor, fires, active); ``requests``: name to the time its result is due."""

    max_active: int = MAX_ACTIVE
    timers: dict[str, tuple[int, int, int, bool]] = field(default_factory=dict)
    requests: dict[str, int] = field(default_factory=dict)

    def next_due(self) -> int | None:
        due = [anchor + (fires + 1) * interval for interval, anchor, fires, active in self.timers.values() if active]
        return min([*due, *self.requests.values()], default=None)

    def fall_due(self, upto: int) -> Iterator[tuple]:
        """All fires and results up to a time, in order."""
        while (at := self.next_due()) is not None and at <= upto:
            for name in sorted(self.timers):
                interval, anchor, fires, active = self.timers[name]
                if active and anchor + (fires + 1) * interval == at:
                    self.timers[name] = (interval, anchor, fires + 1, True)
                    yield at, "fire", name, fires + 1, None
            for name in sorted(k for k, due in self.requests.items() if due == at):
                del self.requests[name]
                yield at, "result", name, None, None

    def command(self, at: int, seq: int, kind: str, name: str | None, amount: int | None, names: list[str]) -> Iterator[tuple]:
        running = [k for k, t in self.timers.items() if t[3]]
        if kind == "schedule":
            if name in self.timers:
                yield at, "already_scheduled", name, None, seq
            elif len(running) >= self.max_active:
                yield at, "timer_limit", name, None, seq
            else:
                self.timers[name] = (amount, at, 0, True)
                yield at, "scheduled", name, None, seq
        elif kind in ("cancel", "cancel_all"):
            wanted = sorted(running if kind == "cancel_all" else set(names))
            if not set(wanted) <= set(running):
                yield at, "not_active", ",".join(wanted), None, seq
                return
            for k in wanted:
                self.timers[k] = (*self.timers[k][:3], False)
                yield at, "canceled", k, None, seq
        elif kind == "request":
            if name in self.requests:
                yield at, "already_pending", name, None, seq
            else:
                self.requests[name] = at + amount
                yield at, "requested", name, None, seq


class LedgerProcessor(StatefulProcessor):
    def __init__(self, max_active: int = MAX_ACTIVE) -> None:
        self.max_active = max_active

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.commands = handle.getMapState("commands", "at_ms long, seq long", "kind string, name string, amount long, names string")
        self.timers = handle.getMapState("timers", "name string", "interval long, anchor long, fires long, active boolean")
        self.requests = handle.getMapState("requests", "name string", "due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for batch in rows:
            for at, seq, kind, name, amount, names in batch[["at_ms", "seq", "kind", "name", "amount", "names"]].itertuples(index=False):
                if isinstance(kind, str):  # a tick has none
                    whole = None if pd.isna(amount) else int(amount)
                    texts = [v if isinstance(v, str) else None for v in (name, names)]
                    self.commands.updateValue((int(at), int(seq)), (kind, texts[0], whole, texts[1]))
                    first = int(at) if first is None else min(first, int(at))
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Everything that the watermark has passed; further timers of the same batch find nothing left to do."""
        watermark = timerValues.getCurrentWatermarkInMs()
        upto = watermark - 1  # rows at the watermark itself may still come
        ledger = Ledger(self.max_active, {k: v for (k,), v in self.timers.iterator()}, {k: due for (k,), (due,) in self.requests.iterator()})
        timers, requests = dict(ledger.timers), dict(ledger.requests)
        held = sorted(self.commands.iterator(), key=lambda c: c[0])
        ready = [(k, v) for k, v in held if k[0] <= upto]
        out: list[tuple] = []
        for (at, seq), (kind, name, amount, names) in ready:
            out += ledger.fall_due(at)
            out += ledger.command(at, seq, kind, name, amount, names.split(",") if names else [])
            self.commands.removeKey((at, seq))
        out += ledger.fall_due(upto)
        self._write(self.timers, timers, ledger.timers, lambda v: v)
        self._write(self.requests, requests, ledger.requests, lambda v: (v,))
        due = [held[len(ready)][0][0]] if len(ready) < len(held) else []
        due += [at for at in [ledger.next_due()] if at is not None]
        if due:
            self.handle.registerTimer(max(min(due), watermark + 1))  # a timer that is not beyond the watermark would be lost
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=[p.split()[0] for p in OUTPUT.split(", ")]).astype({"n": "Int64", "seq": "Int64"})

    @staticmethod
    def _write(state, before: Mapping, after: Mapping, row) -> None:
        for name in before.keys() - after.keys():
            state.removeKey((name,))
        for name, value in after.items():
            if before.get(name) != value:
                state.updateValue((name,), row(value))

    def close(self) -> None:
        pass


def live(commands: DataFrame, max_active: int = MAX_ACTIVE) -> DataFrame:
    """What a stream of ``session_id, at_ms, seq, kind, name, amount, names`` with a watermark leads to; ``names`` are joined by commas."""
    return commands.groupBy("session_id").transformWithStateInPandas(LedgerProcessor(max_active), OUTPUT, "Append", "EventTime")
