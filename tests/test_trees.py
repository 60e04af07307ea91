"""Paths of nested JSON against plain recursion."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.operators import trees as V

TEXTS = st.text("ab \"\\.'é[", max_size=4)
JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 9) | TEXTS, lambda inner: st.lists(inner, max_size=3) | st.dictionaries(TEXTS, inner, max_size=3), max_leaves=8
)


def step(key):
    import re

    return f".{key}" if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", key) else '."' + re.sub(r'(["\\])', r"\\\1", key) + '"'


def plain(value, path="$", key=None):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", type(None): "null"}[type(value)]
    text = {"string": value, "boolean": str(value).lower(), "number": str(value)}.get(kind)
    yield path, key, kind, text
    if kind == "object":
        for k, v in value.items():
            yield from plain(v, path + step(k), k)
    if kind == "array":
        for i, v in enumerate(value):
            yield from plain(v, f"{path}[{i}]", key)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(JSON, min_size=12, max_size=25))
def test_paths_equal_recursion(spark, values):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "n long, j string")
    got = sorted((tuple(r) for r in V.paths(rows, ["n"], "j").collect()), key=str)
    assert got == sorted(((i, *row) for i, v in enumerate(values) for row in plain(v)), key=str)


def test_differences_are_told_once_and_with_their_kind(spark):
    pairs = [
        ({"a": {"b": [1, "x\"y"], "c": None}}, {"a": {"b": [1, "x\"y"], "c": None}}),
        ({"a": 1, "b": {"c": [1, 2]}}, {"b": {"c": [1, 2]}, "a": 1}),
        ({"a": 1}, {"a": "1"}), ({"a": []}, {"a": {}}), ({"a": [1, 2, {"z": 0}]}, {"a": [1, 3]}), ({"k.l": 1}, {"k": {"l": 1}}), ({"e_id": "x \\ y"}, {"e_id": "x  y"}),
    ]
    left, right = (spark.createDataFrame([(i, json.dumps(p[side])) for i, p in enumerate(pairs)], "n long, j string") for side in (0, 1))
    got = sorted(tuple(r) for r in V.differences(V.paths(left, ["n"], "j"), V.paths(right, ["n"], "j"), ["n"]).collect())
    assert got == sorted([
        (2, "$.a", "type", "1", "1"), (3, "$.a", "type", "array", "object"), (4, "$.a[1]", "value", "2", "3"), (4, "$.a[2]", "missing", "object", None),
        (5, '$."k.l"', "missing", "1", None), (5, "$.k", "extra", None, "object"), (6, "$.e_id", "value", "x \\ y", "x  y"),
    ])


def test_references_and_usable_answers_at_any_depth(spark):
    values = [{"a": {"b_event_id": "e_1", "note": "event_id\": \"e_9"}, "x": [{"c_event_ids": ["e_2", "e_1"]}]}, [None, "", {"k": " \t"}], {"a": [[0]]}, None, "ok"]
    rows = spark.createDataFrame([*((i, json.dumps(v)) for i, v in enumerate(values)), (9, "{oops")], "n long, j string")
    found = V.paths(rows, ["n"], "j")
    assert {r["n"]: r["ids"] for r in V.references(found, ["n"], "event_id").collect()} == {0: ["e_1", "e_2"], 1: [], 2: [], 3: [], 4: []}
    assert {r["n"]: r["usable"] for r in V.usable(found, ["n"]).collect()} == {0: True, 1: False, 2: True, 3: False, 4: True}


@pytest.mark.parametrize("depth", [3, 30])
def test_what_is_deeper_is_compared_whole(spark, depth):
    nest = lambda leaf: json.dumps(__import__("functools").reduce(lambda v, _: {"a": v}, range(depth), leaf))
    left, right, other = (V.paths(spark.createDataFrame([(1, nest(leaf))], "n long, j string"), ["n"], "j") for leaf in (1, 1, 2))
    assert V.differences(left, right, ["n"]).count() == 0 and V.differences(left, other, ["n"]).count() == 1
