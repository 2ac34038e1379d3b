"""Paths and types of JSON lines, in plain Python."""

import json
import random
from collections import Counter

import pytest

from logscope.operators.json_schema import json_columns, json_schema


def values(value, path, depth):
    inner = list(value.items()) if isinstance(value, dict) else list(enumerate(value)) if isinstance(value, list) else []
    if depth and inner:
        for key, x in inner:
            yield from values(x, f"{path}.{key}" if isinstance(value, dict) else path + "[]", depth - 1)
    else:
        names = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}
        yield path, names[type(value)]


def expected(rows, depth=6):
    out = Counter()
    for file, _, line in rows:
        if line and line.strip(" "):
            try:
                out.update((file, *x) for x in values(json.loads(line), "$", depth))
            except ValueError:
                out[file, "$", "malformed"] += 1
    return out


def found(df, **how):
    return Counter({(r.file, r.path, r.type): r["count"] for r in json_schema(df, **how).collect()})


def made(rng, depth):
    kind = rng.random()
    if depth and kind < 0.35:
        return {rng.choice("abc de"): made(rng, depth - 1) for _ in range(rng.randrange(4))}
    if depth and kind < 0.5:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, 3, -7, 2.5, 1e300, "text", "é🎉", "", 10**12])


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_random_values(lines, depth):
    rng = random.Random(depth)
    rows = [(rng.choice("pq"), i, json.dumps(made(rng, 5), ensure_ascii=False)) for i in range(200)]
    rows += [("p", 300, '{"a":'), ("p", 301, "plain"), ("p", 302, ""), ("q", 303, "  "), ("q", 304, None)]
    assert found(lines(rows), depth=depth) == expected(rows, depth)


def test_nothing(lines):
    assert found(lines("", " ")) == Counter()


def test_columns(lines):
    rows = lines(
        '{"n": 1, "x": 2.5, "m": 1, "s": "a", "o": {"k": true, "deep": {"z": "q"}}, "l": [1]}', '{"n": null, "x": 3, "m": "two", "o": 5}', "broken", '{"n": 7}'
    )
    out = json_columns(rows, json_schema(rows))
    kinds = dict(out.dtypes)
    assert {c: kinds[c] for c in ("n", "x", "m", "s", "o.k", "o.deep.z")} == {"n": "bigint", "x": "double", "m": "string", "s": "string", "o.k": "boolean", "o.deep.z": "string"}
    got = [(r["n"], r["x"], r["m"], r["o.k"], r["o.deep.z"]) for r in out.orderBy("line_no").collect()]
    assert got == [(1, 2.5, "1", True, "q"), (None, 3.0, "two", None, None), (None,) * 5, (7, None, None, None, None)]
    assert "l[]" not in out.columns and "l" not in out.columns
    with pytest.raises(ValueError, match="more than 2 paths"):
        json_columns(rows, json_schema(rows), most=2)
