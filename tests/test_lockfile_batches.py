"""Lock files leave a worker in batches of bounded rows."""

from quillon.functions.core import record_batches
from quillon.sources import lockfiles


def test_rows_leave_in_bounded_batches():
    read = []

    def files():
        for k in range(100):
            read.append(k)
            yield f"f{k}", "# yarn lockfile v1\n\n" + "\n".join(f'p{n}@^1:\n  version "1.0"\n' for n in range(50))

    made = record_batches(lockfiles.parsed(files()), lockfiles.ROWS, most=100)
    first = next(made)
    assert first.num_rows == 100 and len(read) <= 3
    assert first.num_rows + sum(b.num_rows for b in made) == 5000


def test_null_and_malformed_files(spark):
    rows = lockfiles.read(spark.createDataFrame([("a", None), ("b", "{")], "file string, text string")).collect()
    assert sorted(tuple(r) for r in rows) == [("a", "unknown", "none", None, None, None), ("b", "unknown", "none", None, None, None)]
