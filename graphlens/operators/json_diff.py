"""What differs between two JSON texts, for every row of a table."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Changes are handed on in runs of so many.
RUN = 10_000


def _text(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def _number(text: str) -> float | int:
    """1.0 is the number 1."""
    value = float(text)
    return int(value) if value.is_integer() and abs(value) < 2**53 else value


def _read(text: str) -> object:
    return json.loads(text, parse_float=_number)


def _lines(value: object) -> int:
    """How many lines a value takes when each entry has its own and each container two."""
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else None
    return 1 if inner is None else 2 + sum(map(_lines, inner))


def _matched(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int | None, int | None]]:
    """Places of two lists side by side by a longest common subsequence; of ties the left one goes first.

    The table of lengths is made row by row from its end. Of its rows only every step-th is kept (step: the root of their
    number), and the rows between two kept ones are made again when the walk comes to them: memory grows with the width times that root, at every size.
    """
    n, m = len(a), len(b)
    step = max(1, math.isqrt(n))

    def above(row: np.ndarray, x: int) -> np.ndarray:
        best = row.copy()
        best[:-1] = np.maximum(row[:-1], np.where(b == a[x], row[1:] + 1, 0))
        return np.maximum.accumulate(best[::-1])[::-1]

    row, kept = np.zeros(m + 1, np.int32), {}
    for x in reversed(range(n)):
        if (x + 1) % step == 0 or x + 1 == n:
            kept[x + 1] = row
        row = above(row, x)
    rows: dict[int, np.ndarray] = {0: row} | ({n: kept[n]} if n else {})
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            yield i, j
            i, j = i + 1, j + 1
            continue
        if i < n and j < m and i + 1 not in rows or i < n and j < m and i not in rows:
            end = min(k for k in kept if k > i)
            rows = {end: kept[end]}
            for x in reversed(range(i, end)):
                rows[x] = above(rows[x + 1], x)
        if j == m or (i < n and rows[i + 1][j] >= rows[i][j + 1]):
            yield i, None
            i += 1
        else:
            yield None, j
            j += 1


def _aligned(a: list[str], b: list[str]) -> Iterator[tuple[int | None, int | None]]:
    """Places of two lists side by side: their equal ends, and what lies between by a longest common subsequence."""
    head = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    most = min(len(a), len(b)) - head
    tail = next((k for k in range(most) if a[-1 - k] != b[-1 - k]), most)
    n, m = len(a) - tail, len(b) - tail
    number: dict[str, int] = {}
    inner = [np.array([number.setdefault(x, len(number)) for x in part], np.int64) for part in (a[head:n], b[head:m])]
    yield from ((k, k) for k in range(head))
    for i, j in _matched(*inner):
        yield None if i is None else head + i, None if j is None else head + j
    yield from ((n + k, m + k) for k in range(tail))


def changes_of(left: object, right: object, path: str = "$") -> Iterator[tuple[str, str, str | None, str | None, int]]:
    """(path, tone, left, right, lines). Objects are compared by key, arrays element by element; values of different shape are a removal and an addition."""
    if isinstance(left, dict) and isinstance(right, dict):
        for key in sorted(left.keys() | right.keys()):
            at = f"{path}[{json.dumps(key, ensure_ascii=False)}]"
            if key in left and key in right:
                yield from changes_of(left[key], right[key], at)
            elif key in left:
                yield at, "removed", _text(left[key]), None, _lines(left[key])
            else:
                yield at, "added", None, _text(right[key]), _lines(right[key])
    elif isinstance(left, list) and isinstance(right, list):
        for i, j in _aligned([*map(_text, left)], [*map(_text, right)]):
            at = f"{path}[{i if j is None else j}]"
            if i is not None and j is not None:
                yield from changes_of(left[i], right[j], at)
            elif j is None:
                yield at, "removed", _text(left[i]), None, _lines(left[i])
            else:
                yield at, "added", None, _text(right[j]), _lines(right[j])
    elif isinstance(left, dict | list) or isinstance(right, dict | list):
        yield path, "removed", _text(left), None, _lines(left)
        yield path, "added", None, _text(right), _lines(right)
    elif _text(left) != _text(right):
        yield path, "changed", _text(left), _text(right), 1


def json_changes(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, place, path, tone, left, right, lines): a row for each change from left to right, in the order of place within its pair.

    Tone is added, removed or changed; lines counts what the value takes when it is written out. A text that is null is absent: the other
    side is added or removed whole. Texts that are not JSON are an error. Paths name places of arrays on the right, or on the left for what is removed.
    """
    schema = f"{key} {pairs.schema[key].dataType.simpleString()}, place int, path string, tone string, left string, right string, lines long"

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (key, "place", "path", "tone", "left", "right", "lines")
        for batch in batches:
            kind = batch.schema.field(0).type
            types = pa.schema([(key, kind), ("place", pa.int32()), *[(n, pa.string()) for n in names[2:6]], ("lines", pa.int64())])
            rows: list[tuple] = []
            for who, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if a is None or b is None:
                    whole = _read(a if b is None else b) if (a, b) != (None, None) else None
                    found = [] if (a, b) == (None, None) else [("$", "removed" if b is None else "added", a and _text(whole), b and _text(whole), _lines(whole))]
                else:
                    found = changes_of(_read(a), _read(b))
                rows.extend((who, place, *change) for place, change in enumerate(found))
                if len(rows) >= RUN:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)

    return pairs.select(key, left, right).mapInArrow(compared, schema)
