"""Small pairs share a batch, and a pair's lines are collapsed where they are compared."""

import contextlib
import io
import random

import pyarrow as pa

from quillon.operators import diff
from quillon.plans import registry


def test_small_pairs_share_a_batch():
    n = 1000
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["a\nb"] * n), pa.array(["a\nc"] * n)], names=["pair", "old", "new"])
    made = list(diff.batches_of(iter([batch]), diff.numbered, diff.LINES))
    assert len(made) == 1 and made[0].num_rows == 3 * n
    assert made[0].column(4).to_pylist()[:3] == [1, None, 2] and set(made[0].column(0).to_pylist()) == set(range(n))


def by_position(kinds, context):
    """(kind, length) of what is shown, and of gaps."""
    out = []
    for k, kind in enumerate(kinds):
        if any(x != "same" for x in kinds[max(k - context, 0) : k + context + 1]):
            out.append((kind, 1))
        elif out and out[-1][0] == "gap":
            out[-1] = ("gap", out[-1][1] + 1)
        else:
            out.append(("gap", 1))
    return out


def test_around():
    rnd = random.Random(5)
    for _ in range(500):
        context = rnd.randint(0, 3)
        kinds = [rnd.choice(["same"] * 6 + ["delete", "insert"]) for _ in range(rnd.randint(0, 30))]
        got = list(diff.around(((k, kind, "x") for k, kind in enumerate(kinds)), context))
        assert [(kind, int(text) if kind == "gap" else 1) for _, kind, text in got] == by_position(kinds, context)
        at = 0
        for position, kind, text in got:
            assert position == at
            at += int(text) if kind == "gap" else 1
        assert at == len(kinds)


def test_collapsed_is_collapse_of_compare(spark):
    rnd = random.Random(6)
    text = lambda: "\n".join(rnd.choice("ab") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 40)))
    pairs = spark.createDataFrame([(k, text(), text()) for k in range(60)] + [(60, None, "n"), (61, None, None)], "pair long, old string, new string").repartition(3)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(diff.collapsed(pairs)) == rows(diff.collapse(diff.compare(pairs)))


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_lines_are_compared_once_and_stay_where_they_are(spark, sf_dir):
    for name in ("line_differences", "collapsed_differences"):
        told = plan(registry.QUERIES[name](spark, sf_dir))
        assert told.count("MapInArrow") == 1 and told.count("Exchange") == 1 and "Window" not in told and "Pandas" not in told
