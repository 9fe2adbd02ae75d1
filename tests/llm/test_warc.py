import gzip
from collections import defaultdict

from pyspark.sql import functions as F

from quillon.llm import warc
from quillon.llm.common import open_fs, table


def expected(pages):
    largest = defaultdict(list)
    for page_id, _, html in pages:
        largest[html or ""].append(page_id)
    out = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        ids = [i for i in largest[html or ""] if i is not None]
        top = max(ids) if ids else None
        out.append((page_id, len(data), warc.base32_sha1(data), *(("response", None) if page_id == top else ("revisit", top))))
    return sorted(out, key=str)


def result(df):
    return sorted([tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=str)


def test_query(spark, sf_dir):
    pages = [tuple(r) for r in table(spark, sf_dir, "pages").select("page_id", "url", "html").collect()]
    assert result(warc.op2_warc(spark, sf_dir)) == expected(pages)


PAGES = [
    (1, "http://A.example.com/x?y#z", "same"),
    (5, "http://a.example.com/x?y#z", "same"),
    (3, None, "same"),
    (2, "no scheme", None),
    (9, "https://b.org", ""),
    (None, "http://c.org/ü\r\nX: y\t", "other"),
    (None, "http://c.org/", "same"),
    (7, "http://d.org/" + "p" * 5000, "ü" * 400_000),
    (8, "http://d.org/", "a\r\n\r\nb\0"),
    (8, "http://d.org/", "a\r\n\r\nb\0"),
    (8, "http://d.org/", "another of the same id"),
    (-4, "http://e.org/", "negative"),
]


def frame(spark):
    return spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, first string")


def test_odd_pages_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200)
    captures = warc.write_archives(frame(spark))
    top = warc.write_index(captures)
    keys = frame(spark).select(warc.capture_key(F.col("url"), F.col("page_id")).alias("capture"))
    found = warc.lookup(keys, top)
    assert result(found) == expected(PAGES)
    assert {(r.page_id, bytes(r.payload).decode()) for r in found.where("record_type = 'response'").collect()} == {(p[0], p[2] or "") for p, e in [(p, q) for p in PAGES for q in expected([*PAGES]) if q[0] == p[0] and q[3] == "response" and q[1] == len((p[2] or "").encode())]}
    assert warc.lookup(keys.limit(0), top).count() == 0
    assert warc.lookup(spark.createDataFrame([("zz)/ ",), ("",)], "capture string"), top).count() == 0
    for r in captures.collect():
        fs, path = open_fs(r.file)
        with fs.open_input_file(path) as f:
            assert gzip.decompress(f.read_at(r.length, r.offset)).startswith(b"WARC/1.1\r\n")


def test_empty_table(spark):
    captures = warc.write_archives(frame(spark).limit(0))
    assert captures.count() == 0 and warc.lookup(captures, warc.write_index(captures)).count() == 0


def test_url_keys(spark):
    urls = [("http://WWW.Example.com/A?b#c", "com,example,www)/A?b#c"), ("https://h", "h)"), ("x y", "x+y"), (None, "")]
    df = spark.createDataFrame(urls, "url string, want string").withColumn("got", warc.url_key(F.col("url")))
    assert all(r.got == r.want for r in df.collect())


def test_one_payload_of_most_pages(spark):
    rows = [(i, f"http://a.org/{i}", "<p>same</p>" if i % 10 else f"<p>{i}</p>") for i in range(500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    top = warc.write_index(warc.write_archives(pages))
    keys = pages.select(warc.capture_key(F.col("url"), F.col("page_id")).alias("capture"))
    assert result(warc.lookup(keys, top, payloads=False)) == expected(rows)
