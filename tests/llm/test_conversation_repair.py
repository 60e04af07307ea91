"""Conversation repair against a search over all edits in plain Python."""

import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from millrace.llm import conversation_repair as cr

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
SPACE = re.compile(r"[^\x20\x09-\x0D]")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        out += [(conv, turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return out


def fault(text, seen):
    solid = SPACE.findall(text)
    return "blank" if not solid else "duplicate" if seen else "truncated" if solid[-1] not in ".!?" else ""


def plain_repair(rows):
    """Faults, cost, audit and repaired turns by a least-cost search over (row, roles so far)."""
    content = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, content(r)))
    seen, faults = set(), []
    for r in rows:
        faults.append(fault(r[3], r[2:] in seen))
        seen.add(r[2:])
    legal = {0: "su", 1: "u", 2: "a", 3: "u"}
    step = lambda state, c: {"s": 1, "u": 2, "a": 3}[c]
    queue, done = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, i, state, turns = heapq.heappop(queue)
        if i == len(rows) and state in (0, 3):
            break
        if (i, state, audit.count("I") > 3 * len(rows) + 4) in done:
            continue
        done.add((i, state, False))
        for c in "ua":
            if c in legal[state]:
                heapq.heappush(queue, (cost + 5, audit + "I", i, step(state, c), (*turns, (cr.NAMES[c], ""))))
        if i < len(rows):
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, turns))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] else 0
                _, _, role, text = rows[i]
                if role[:1] and role[:1] in legal[state]:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, step(state, role[0]), (*turns, (role, text))))
                for c in "ua":
                    if c in legal[state]:
                        heapq.heappush(queue, (cost + 1 + more, audit + "R", i + 1, step(state, c), (*turns, (cr.NAMES[c], text))))
    numbers = {r[1] for r in rows} - {None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit), turns


def plain(rows, originals):
    by_conv = defaultdict(list)
    for r in rows:
        by_conv[r[0]].append(r)
    out = []
    for conv in {r[0] for r in originals}:
        facts, turns = plain_repair(by_conv[conv])
        out.append((conv, *facts, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest(), len(turns)))
    return sorted(out, key=str)


def random_rows(seed, convs, longest, wild=True):
    rng = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", *(["tool", "", None, "ubuntu", "User"] if wild else [])]
    texts = ["Fine.", "What?", "cut off", "", " \n", "Other text!", "é. ", *([None] if wild else [])]
    rows = []
    for conv in range(convs):
        for turn in range(int(rng.integers(0, longest + 1))):
            text = texts[rng.integers(len(texts))]
            rows.append((conv, int(turn + rng.integers(0, 2)), roles[rng.integers(len(roles))], text and f"{text}{rng.integers(4)}."[: len(text) + int(rng.integers(3))]))
    return rows


def test_damage_equals_plain_python(spark):
    rows = [*random_rows(1, 60, 9), (None, None, None, None), (None, 3, "user", "a!b.c?"), (5, None, "user", "Hm.")]
    got = [tuple(r) for r in cr.damage(spark.createDataFrame(rows, TURNS)).collect()]
    assert sorted(got, key=str) == sorted(plain_damage(rows), key=str)


def test_digests_equal_search(spark):
    rows = [*random_rows(2, 250, 9), (None, 1, "user", "No id."), (None, 2, "assistant", "Nor here."), (None, None, "system", "Early.")] + [(900, 1, "user", "Again.")] * 5
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    damaged = plain_damage(rows)
    got = sorted((tuple(r) for r in cr.digest(cr.damage(turns), turns).collect()), key=str)
    assert got == plain(damaged, rows)


@pytest.mark.parametrize("cell", [2, 4])
def test_long_conversations_in_small_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(cr, "CELL", cell)
    monkeypatch.setattr(cr, "SHIFT", cell.bit_length() - 1)
    rows = random_rows(3, 12, 60)
    turns = spark.createDataFrame(rows, TURNS).repartition(7)
    got = sorted((tuple(r) for r in cr.digest(turns, turns).collect()), key=str)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got == plain(clean, rows)


def test_repaired_turns_are_a_dialogue(spark):
    rows = random_rows(4, 40, 12, wild=False)
    turns = cr.repair(spark.createDataFrame(rows, TURNS)).collect()
    by_conv = defaultdict(list)
    for r in sorted(turns, key=lambda r: (r["conv_id"], r["place"])):
        by_conv[r["conv_id"]].append(r)
    for conv, found in by_conv.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in found))
        assert [(r["role"], r["text"]) for r in found] == list(plain_repair([x for x in rows if x[0] == conv])[1])
        assert all((r["edit"] == "I") <= (r["text"] == "") for r in found)


def test_whole_runs_never_cut_a_run():
    batches = [pa.RecordBatch.from_pydict({"a": [1, 1, None, None], "b": [0, 0, 5, 5]}), pa.RecordBatch.from_pydict({"a": [None, 7, 7, 7], "b": [5, 1, 1, 2]})]
    tables = [t.to_pylist() for t in cr.whole_runs(iter(batches), rows=2)]
    assert [r for t in tables for r in t] == [r for b in batches for r in b.to_pylist()]
    edges = [(t[-1]["a"], t[-1]["b"]) for t in tables]
    assert len(set(edges)) == len(edges) > 1


def test_empty_tables_and_long_texts(spark):
    assert cr.digest(spark.createDataFrame([], TURNS), spark.createDataFrame([], TURNS)).count() == 0
    rows = [(1, i, ("user", "assistant")[i % 2], "x" * 1_000_000 + f"{i}.") for i in range(4)]
    turns = spark.createDataFrame(rows, TURNS).withColumns({"pos": F_lit(1), "step": F_lit("s"), "cell": F_lit(2)})
    (row,) = cr.digest(turns, turns).collect()
    assert (row["cost"], row["audit"]) == (0, "KKKK")


def F_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)
