"""Bursts of activity over a live stream, equal to the batch rule: a gap of the threshold or more starts anew."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.streaming.running import read_files, to_the_end

OUTPUT = "session_id long, n_events long, start_us long, end_us long"
Burst = tuple[int, int, int]
#: Fixed value: a window of the state is as wide as so many gaps, and so has at most so many bursts.
WINDOW = 1024


def partial_bursts(times: np.ndarray, gap_us: int) -> list[Burst]:
    """``(n, start, end)`` of each run of times whose gaps are below ``gap_us``."""
    times = np.sort(times)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(times) >= gap_us]))
    ends = np.concatenate([starts[1:], [len(times)]])
    return [(int(b - a), int(times[a]), int(times[b - 1])) for a, b in zip(starts, ends, strict=True)]


def merged(one: list[Burst], other: list[Burst], gap_us: int) -> list[Burst]:
    """Two lists of bursts as one: those less than ``gap_us`` apart, or that overlap, are one burst."""
    out: list[Burst] = []
    for n, start, end in sorted([*one, *other], key=lambda b: b[1]):
        if out and start - out[-1][2] < gap_us:
            m, first, last = out[-1]
            out[-1] = (m + n, first, max(last, end))
        else:
            out.append((n, start, end))
    return out


class Bursts(StatefulProcessor):
    """Holds a session's bursts that an event yet to come may stretch or join, and no times.

    Each Arrow batch of a micro-batch is folded into partial bursts by itself. Bursts lie in the state by windows of time, some
    ``WINDOW`` to an entry, as their starts are a gap apart, so a call writes the few windows that it changed. A session has one timer, at the first end of
    a burst that it holds: it closes all that the watermark is ``gap_us`` beyond, and is set anew for the next.
    """

    def __init__(self, gap_us: int) -> None:
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "window long", "n array<long>, start_us array<long>, end_us array<long>")

    def _held(self) -> dict[int, list[Burst]]:
        return {window: list(zip(*lists, strict=True)) for (window,), lists in self.open.iterator()}

    def _hold(self, bursts: list[Burst], before: dict[int, list[Burst]]) -> None:
        """Write those windows of ``bursts`` that differ from ``before``."""
        now: dict[int, list[Burst]] = {}
        for burst in bursts:
            now.setdefault(burst[1] // (WINDOW * max(1, self.gap_us)), []).append(burst)
        for window in before.keys() - now.keys():
            self.open.removeKey((window,))
        for window, held in now.items():
            if held != before.get(window):
                self.open.updateValue((window,), tuple(map(list, zip(*held, strict=True))))

    def _wake(self, bursts: list[Burst]) -> int | None:
        """When the first of ``bursts`` may be closed, in milliseconds."""
        return min((-(-(end + self.gap_us) // 1000) for _, _, end in bursts), default=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self._held()
        held = was = [b for window in before.values() for b in window]
        for batch in rows:
            times = batch["at_us"].dropna().to_numpy(np.int64)
            if len(times):
                held = merged(held, partial_bursts(times, self.gap_us), self.gap_us)
        self._hold(held, before)
        wake, set_for = self._wake(held), self._wake(was)
        if wake is not None and (set_for is None or wake < set_for):  # a timer that is too early sets the next
            self.handle.registerTimer(wake)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        before = self._held()
        held = [b for window in before.values() for b in window]
        closed = [b for b in held if b[2] + self.gap_us <= upto]
        left = [b for b in held if b[2] + self.gap_us > upto]
        self._hold(left, before)
        if left:
            self.handle.registerTimer(self._wake(left))
        if closed:
            yield pd.DataFrame([(key[0], *b) for b in closed], columns=[p.split()[0] for p in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def closed_bursts(events: DataFrame, gap_us: int) -> DataFrame:
    """Finished bursts of a stream of ``session_id, at_us`` that has a watermark."""
    return events.groupBy("session_id").transformWithStateInPandas(Bursts(gap_us), OUTPUT, "Append", "EventTime")


def run_once(spark: SparkSession, path: str, gap_us: int, files_per_batch: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """All bursts of the event files at ``path``, in as many micro-batches as ``files_per_batch`` makes.

    Rows that are later than ``delay`` behind the latest of the batches before are lost, as with any watermark.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = read_files(spark, path, files_per_batch).select(F.col("user_id").alias("session_id"), at.alias("at_us"), F.floor(at / 1000).alias("at_ms"))
    last = spark.read.parquet(path).agg(F.max(at)).first()[0] or 0
    seconds = spark.sql(f"SELECT unix_micros(timestamp '1970-01-01 00:00:00' + interval {delay})").first()[0]
    found = to_the_end(spark, rows, "at_ms", (last + gap_us + seconds) // 1000 + 2, lambda timed: closed_bursts(timed, gap_us), delay)
    return found.where("session_id IS NOT NULL")
