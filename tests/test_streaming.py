"""Streams over several micro-batches against plain loops over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.streaming import bursts, lanes, ledger
from millrace.streaming.running import read_files, to_the_end


def in_files(spark, rows, schema, folder, n):
    """Rows in ``n`` files, one after the other in time, so that each is a micro-batch."""
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_bursts_over_several_batches_equal_a_loop(spark, tmp_path):
    rng = random.Random(1)
    at, rows = 0, []
    for _ in range(600):
        at += rng.choice([1_000, 50_000, 900_000, 3_000_000])
        rows.append((rng.randrange(5), at + rng.randrange(0, 400_000)))  # up to 0.4 s out of order
    gap = 2_000_000
    path = in_files(spark, rows, "user_id long, us long", str(tmp_path / "raw"), 6)
    spark.read.parquet(path).select("user_id", F.timestamp_micros("us").alias("ts"), "us").repartition(1).sortWithinPartitions("us").write.parquet(str(tmp_path / "one"))
    ordered = sorted(rows, key=lambda r: r[1])
    for i in range(6):
        part = ordered[i * 100 : i * 100 + 100]
        spark.createDataFrame(part, "user_id long, us long").select("user_id", F.timestamp_micros("us").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    got = bursts.run_once(spark, str(tmp_path / "events"), gap, files_per_batch=1, delay="1 seconds").collect()
    want = []
    for user in range(5):
        times = [t for u, t in ordered if u == user]
        want += [(user, *b) for b in bursts.partial_bursts(bursts.np.array(times), gap)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def test_bursts_merge_in_any_order():
    rng = random.Random(2)
    times = [rng.randrange(2_000) for _ in range(300)]
    want = bursts.partial_bursts(bursts.np.array(times), 9)
    held = []
    for i in range(0, 300, 7):
        held = bursts.merged(held, bursts.partial_bursts(bursts.np.array(times[i : i + 7]), 9), 9)
    assert held == want


class Handle:
    """A session's state and timers in memory, counting what is written."""

    def __init__(self):
        self.values, self.timers, self.writes, self.now = {}, set(), 0, 0

    def getMapState(self, name, key, value):  # noqa: N802
        return self

    def iterator(self):
        return iter(list(self.values.items()))

    def updateValue(self, key, value):  # noqa: N802
        self.values[key], self.writes = value, self.writes + 1

    def removeKey(self, key):  # noqa: N802
        del self.values[key]
        self.writes += 1

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)
        self.writes += 1

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now


def test_a_session_of_many_bursts_takes_few_writes_and_one_timer():
    rng = random.Random(4)
    gap, handle = 5_000, Handle()
    times = sorted(rng.randrange(10_000_000) for _ in range(900))
    session = bursts.Bursts(gap)
    session.init(handle)
    frame = lambda part: iter([bursts.pd.DataFrame({"at_us": part})])
    assert list(session.handleInputRows((7,), frame(times[:600]), handle)) == []
    assert handle.writes <= 4 and len(handle.timers) == 1
    got = []
    for now, part in ((times[600] // 1000, times[600:]), (20_000, [])):
        handle.now = now
        while due := sorted(t for t in handle.timers if t <= now):
            handle.timers.remove(due[0])
            got += [tuple(row) for out in session.handleExpiredTimer((7,), handle, None) for row in out.itertuples(index=False)]
        assert list(session.handleInputRows((7,), frame(part), handle)) == []
    assert got == [(7, *b) for b in bursts.partial_bursts(bursts.np.array(times), gap)] and len(got) > 200
    assert not handle.values and not handle.timers and handle.writes < 20


def plain_ledger(rows, last, cap):
    """Commands (session, at, seq, kind, name, amount, names) handled in order, time going on to ``last``."""
    out = []
    for session in {r[0] for r in rows}:
        timers, pending = {}, {}
        for at in range(last + 1):
            for name in sorted(n for n, t in timers.items() if t["runs"] and at > t["anchor"] and (at - t["anchor"]) % t["every"] == 0):
                timers[name]["fires"] += 1
                out.append((session, at, "fire", name, timers[name]["fires"], None))
            for name in sorted(n for n, due in pending.items() if due == at):
                del pending[name]
                out.append((session, at, "result", name, None, None))
            for _, _, seq, kind, name, amount, names in sorted(r for r in rows if r[0] == session and r[1] == at):
                runs = sorted(n for n, t in timers.items() if t["runs"])
                say = lambda what, n: out.append((session, at, what, n, None, seq))  # noqa: B023, E731
                if kind == "schedule" and name in timers:
                    say("already_scheduled", name)
                elif kind == "schedule" and len(runs) >= cap:
                    say("timer_limit", name)
                elif kind == "schedule":
                    timers[name] = {"every": amount, "anchor": at, "fires": 0, "runs": True}
                    say("scheduled", name)
                elif kind == "request" and name in pending:
                    say("already_pending", name)
                elif kind == "request":
                    pending[name] = at + amount
                    say("requested", name)
                else:
                    wanted = runs if kind == "cancel_all" else sorted(set(names.split(",")))
                    if set(wanted) - set(runs):
                        say("not_active", ",".join(wanted))
                    else:
                        for n in wanted:
                            timers[n]["runs"] = False
                            say("canceled", n)
    return out


@pytest.mark.parametrize("n_files", [1, 7])
def test_ledger_over_batches_equals_a_loop(spark, tmp_path, n_files):
    rng = random.Random(3)
    rows = []
    for i in range(260):
        at, session = i * 3 + rng.randrange(3), rng.choice([1, 2, None])
        kind = rng.choice(["schedule", "schedule", "request", "request", "cancel", "cancel_all"] if i % 9 == 0 else ["schedule", "request", "cancel"])
        name = {"schedule": f"t{rng.randrange(90 if i > 100 else 9)}", "request": f"r{rng.randrange(3)}"}.get(kind)
        names = ",".join(f"t{rng.randrange(9)}" for _ in range(rng.choice([1, 1, 2]))) if kind == "cancel" else None
        rows.append((session, at, i, kind, name, rng.randrange(5, 40) if name else None, names))
    schema = "session_id long, at_ms long, seq long, kind string, name string, amount long, names string"
    path = in_files(spark, [r for r in rows if r[0] is not None], schema, str(tmp_path / "in"), n_files)
    stream = read_files(spark, path, files_per_batch=1)
    got = to_the_end(spark, stream, "at_ms", 901, lambda timed: ledger.live(timed, 4)).where("session_id IS NOT NULL")
    want = plain_ledger([r for r in rows if r[0] is not None], 900, 4)
    assert {w[2] for w in want} == {"fire", "result", "already_scheduled", "timer_limit", "scheduled", "already_pending", "requested", "not_active", "canceled"}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_a_replayed_batch_changes_neither_lane(spark, tmp_path):
    lines = ['{"a": 1, "b": "x"}', '{"a": 1', '"text"', '{"a": 1}', '{"a": "one", "b": "x"}', '{"a": null, "b": "x"}', None, ""]
    rows = spark.createDataFrame(list(enumerate(lines)), "n long, line string")
    judged = lanes.judged(rows, "line", {"a": "bigint", "b": "string"})
    sinks = [str(tmp_path / s) for s in ("accepted", "rejected")]
    for batch in (0, 1, 1, 0):
        lanes.write_batch(judged, batch, *sinks)
    accepted, rejected = (spark.read.parquet(s).where("batch = 1") for s in sinks)
    assert [tuple(r["parsed"]) for r in accepted.collect()] == [(1, "x")]
    reasons = {r["n"]: r["reason"] for r in rejected.collect()}
    assert reasons == {1: "malformed_json", 2: "malformed_json", 3: "missing_field", 4: "wrong_type", 5: "missing_field", 6: "malformed_json", 7: "malformed_json"}
    rows.write.parquet(str(tmp_path / "in"))
    got = lanes.split(spark, read_files(spark, str(tmp_path / "in")), "line", {"a": "bigint", "b": "string"}, str(tmp_path / "run"))
    again = lanes.split(spark, read_files(spark, str(tmp_path / "in")), "line", {"a": "bigint", "b": "string"}, str(tmp_path / "run"))
    assert [df.count() for df in got] == [df.count() for df in again] == [1, 7]
