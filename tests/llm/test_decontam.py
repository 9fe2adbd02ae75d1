from quillon.llm import decontam

ITEMS = [(1, "One two three four five six seven eight nine ten eleven."), (2, "short item"), (3, None), (10, "Über 2 short ITEM"), (4, "...")]
DOCS = [
    (1, "x one, TWO three four five six seven eight nine ten eleven twelve"),
    (2, "two three four five six seven eight nine ten"),
    (3, "a short -- item; and über 2 short item short item"),
    (4, None),
    (5, ""),
    (None, "SHORT ITEM"),
    (1, "ÜBER 2 short item"),
    (6, "!!! ---"),
]


def frames(spark):
    docs = spark.createDataFrame([(i, t, "extra") for i, t in DOCS], "doc_id long, text string, items string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def result(found):
    rows = found.selectExpr("doc_id", "_found.n_words", "_found.runs", "_found.items").collect()
    return sorted([(r.doc_id, r.n_words, sum(b - a for a, b in r.runs), len(r["items"])) for r in rows], key=str)


def test_against_brute_force(spark):
    docs, items = frames(spark)
    want = sorted([x[:4] for x in decontam.brute_force(DOCS, ITEMS)], key=str)
    assert result(decontam.scan(docs, items, "_found")) == want
    assert result(decontam.scan(docs, items, "_found", max_words=20)) == want


def test_query_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: tuple(r) for r in decontam.op7_decontamination(spark, sf_dir).collect()}
    want = decontam.brute_force(docs, items)
    assert got == {row[0]: row for row in want} and sum(row[5] for row in want) > 1


def test_removal(spark):
    docs, items = frames(spark)
    assert sorted(str(r.doc_id) for r in decontam.remove_documents(docs, items).collect()) == ["2", "4", "5", "6"]
    texts = {r.doc_id: r.text for r in decontam.remove_spans(docs.where("doc_id = 3"), items).collect()}
    assert texts[3] == "a ; and über 2 "
    assert decontam.scan(docs.limit(0), items, "_found").count() == 0
    assert decontam.scan(docs, items.limit(0), "_found").where("size(_found.runs) > 0").count() == 0


def test_long_texts_text_ids_and_own_columns(spark):
    item = " ".join(f"w{i}" for i in range(14))
    filler = "filler " * 60_000
    docs = spark.createDataFrame([(1, f"{filler}{item} {filler}", 0.5), (2, filler, None), (2, item, 1.0), (2, item, 1.0)], "doc_id long, text string, _found double")
    items = spark.createDataFrame([("b-1", item), ("a", item), (None, "w0 w1 w2"), (None, None)], "item_id string, text string")
    for most in (decontam.MAX_WORDS, 10):
        rows = decontam.scan(docs, items, "seen", max_words=most).selectExpr("doc_id", "_found", "seen.n_words", "seen.runs", "seen.items").collect()
        got = sorted((r.doc_id, r._found is None, r.n_words, [list(x) for x in r.runs], list(r["items"])) for r in rows)
        assert got == [
            (1, False, 120_014, [[60_000, 60_014]], ["a", "b-1"]), (2, False, 14, [[0, 14]], ["a", "b-1"]), (2, False, 14, [[0, 14]], ["a", "b-1"]), (2, True, 60_000, [], []),
        ]
    kept = decontam.remove_documents(docs, items)
    assert kept.columns == docs.columns and [(r.doc_id, r._found) for r in kept.collect()] == [(2, None)]


def test_items_longer_than_a_slice(spark):
    """Items are cut where they exceed a slice, and no slice holds more than it may."""
    long = " ".join(f"w{i}" for i in range(500))
    items = [(1, long), (2, "short item"), (3, " ".join(f"w{i}" for i in range(300, 330))), (4, "one"), (5, None), (6, "!")] + [(7 + i, f"a{i} b{i} c{i}") for i in range(40)]
    docs = [(1, long), (2, f"x {' '.join(f'w{i}' for i in range(95, 125))} y"), (3, "w9 w10 one a7 b7 c7 short"), (4, None)]
    frame = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    sliced, n = decontam._sliced(frame.selectExpr("cast(item_id as string) AS item_id", "text"), 10, 60)
    held = {}
    for r in sliced.collect():
        held[r.slice] = held.get(r.slice, 0) + len(decontam.words(r.text))
    assert max(held) < n and max(held.values()) <= 60 and n > 10
    got = result(decontam.scan(spark.createDataFrame(docs, "doc_id long, text string"), frame, "_found", max_words=60))
    assert got == sorted([x[:4] for x in decontam.brute_force(docs, items)], key=str)
