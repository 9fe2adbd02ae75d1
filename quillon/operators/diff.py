"""Line differences of pairs of texts."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from quillon.functions.core import in_order

#: Lines of a changed middle above which lines are compared by position, and unchanged lines shown around a change.
LARGE, CONTEXT = 1_500, 3
LINES = "pair long, position long, kind string, old_line long, new_line long, text string, truncated boolean"
SHOWN = "pair long, position long, kind string, text string"
#: Rows, or characters of texts, after which a worker sends what it has.
ROWS, CHARS = 4_096, 1 << 22


def table(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of longest common subsequences of all endings."""
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(s, len(ids)) for s in side], dtype=np.int64) for side in (a, b))
    t = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):
        take = np.where(y == x[i], t[i + 1, 1:] + 1, 0)
        best = np.maximum(t[i + 1, :-1], take)
        t[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    return t


def lines(old: str | None, new: str | None) -> tuple[list[tuple], bool]:
    """(kind, old line, new line, text) from 1 on, and whether the middle was compared by position. Where both would do, deletions come first."""
    a, b = ((s.split("\n") if s else []) for s in (old, new))
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    out = [("same", k + 1, k + 1, s) for k, s in enumerate(a[:head])]
    large = max(len(x), len(y)) > LARGE
    i = j = 0
    t = None if large else table(x, y)
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append(("same", head + i + 1, head + j + 1, x[i]))
            i, j = i + 1, j + 1
        elif i < len(x) and (j >= len(y) or (i <= j if large else t[i + 1, j] >= t[i, j + 1])):
            out.append(("delete", head + i + 1, None, x[i]))
            i += 1
        else:
            out.append(("insert", None, head + j + 1, y[j]))
            j += 1
    n = len(a) - tail, len(b) - tail
    return out + [("same", n[0] + k + 1, n[1] + k + 1, s) for k, s in enumerate(a[n[0] :])], large


def batches_of(batches: Iterator, rows_of: Callable[[str | None, str | None], Iterable[tuple]], schema: str) -> Iterator:
    """Arrow batches of ``rows_of(old, new)`` after each pair: many small pairs share one, and a long pair's rows wait for no others."""
    import pyarrow as pa

    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])
    held, chars = [], 0
    for batch in batches:
        for pair, old, new in (tuple(c[k].as_py() for c in batch.columns) for k in range(batch.num_rows)):
            held += [(pair, *row) for row in rows_of(old, new)]
            chars += len(old or "") + len(new or "")
            if held and (len(held) >= ROWS or chars >= CHARS):
                yield made(held)
                held, chars = [], 0
    if held:
        yield made(held)


def in_batches(pairs: DataFrame, rows_of: Callable[[str | None, str | None], Iterable[tuple]], schema: str) -> DataFrame:
    return pairs.select("pair", "old", "new").mapInArrow(lambda batches: batches_of(batches, rows_of, schema), schema)


def numbered(old: str | None, new: str | None) -> list[tuple]:
    rows, large = lines(old, new)
    return [(k, *row, large) for k, row in enumerate(rows)]


def compare(pairs: DataFrame) -> DataFrame:
    """The lines of each (pair, old, new); a null text has none."""
    return in_batches(pairs, numbered, LINES)


def around(rows: Iterable[tuple], context: int) -> Iterator[tuple]:
    """(position, kind, text) of changed lines and ``context`` lines on both sides, from (position, kind, text) in order; a run of others is one row ``gap`` at its first position."""
    waiting: deque[tuple] = deque()  # unchanged lines that a change may still show
    after = 0  # unchanged lines that the last change shows
    start, hidden = None, 0
    for row in rows:
        if row[1] == "same" and after == 0:
            waiting.append(row)
            if len(waiting) > context:
                first = waiting.popleft()
                start, hidden = (first[0] if hidden == 0 else start), hidden + 1
            continue
        after = after - 1 if row[1] == "same" else context
        if hidden:
            yield start, "gap", str(hidden)
            hidden = 0
        yield from waiting
        waiting.clear()
        yield row
    if waiting and hidden == 0:
        start = waiting[0][0]
    if hidden + len(waiting):
        yield start, "gap", str(hidden + len(waiting))


def collapse(rows: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Changed lines with some lines around them; runs of others become one row of kind ``gap`` with their number as text. The rows of each pair pass in order, once."""
    return in_order(rows.select("pair", "position", "kind", "text"), "pair", ["position"], lambda pair, own: ((pair, *row) for row in around((r[1:] for r in own), context)), SHOWN)


def collapsed(pairs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``collapse`` of ``compare``, where each pair is compared: its lines are in order there, so they are neither shuffled nor sorted."""
    return in_batches(pairs, lambda old, new: around(((k, kind, text) for k, (kind, _, _, text) in enumerate(lines(old, new)[0])), context), SHOWN)
