import gzip
import hashlib
from urllib.parse import urlparse

from fluvia.llm import warc as w


def texts():
    return [None, "", "short", "short", "x" * 100, "é" * 60, "x" * 100, "é" * 60, "x" * 99, "x" * 99, "long " * 60_000, "a\r\n\r\nb" * 50]


def make(spark, tmp_path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))


def test_round_trip_and_revisits(spark, tmp_path):
    rows = [(i, None if i == 1 else f"http://x.org/{i} \n", t, "clash") for i, t in enumerate(texts())]
    make(spark, tmp_path, [*rows, rows[4]])
    for limit in (0, 1000):
        before, w.BROADCAST_GROUPS = w.BROADCAST_GROUPS, limit
        got = [r.asDict() for r in w.op4_warc_index(spark, str(tmp_path)).collect()]
        w.BROADCAST_GROUPS = before
        assert len(got) == len(rows) + 1
        for r in got:
            raw = (texts()[r["page_id"]] or "").encode()
            same = [i for i, t in enumerate(texts()) if (t or "").encode() == raw] if len(raw) >= 100 else [r["page_id"]]
            revisit = r["page_id"] != min(same)
            assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
            assert (r["record_type"], r["refers_to"]) == (("revisit", min(same)) if revisit else ("response", None))


def test_large_groups_are_broadcast_beyond_the_bound(spark):
    texts = ["a" * 200] * 30 + ["b" * 150] * 2 + ["c" * 150] * 2 + ["d" * 150, "short", "short", None]
    pages = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    marked = w.marked(pages, broadcast_groups=2)
    assert {r.page_id: r["first"] for r in marked.collect()} == {i: 0 if i < 30 else 30 if i < 32 else 32 if i < 34 else None for i in range(len(texts))}
    joined = marked._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in joined and joined.count("Join LeftOuter") >= 2


def test_selected_records_and_their_payloads(spark, tmp_path):
    make(spark, tmp_path, [(i, f"http://x.org/{i}", f"page {i} " * 30, "") for i in range(200)])
    index, folder = w.write_archives(w.marked(spark.read.parquet(str(tmp_path / "pages.parquet"))))
    got = w.read_records(index.filter("page_id % 7 = 3"), folder, with_payload=True).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {i: f"page {i} " * 30 for i in range(200) if i % 7 == 3}
    one = index.first()
    data = open(f"{urlparse(folder).path}/{one.file}", "rb").read()
    assert w.parse(gzip.decompress(data[one.offset : one.offset + one.length]))[0]["WARC-Target-URI"] == one.url
    assert gzip.decompress(data).startswith(b"WARC/1.1")


def test_ranges_join_neighbours_only():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 20 + w.GAP_BYTES, 5), ("b", 0, 5), ("b", 5, w.READ_BYTES)]
    assert w.ranges(rows) == [("a", 0, 15, 0, 2), ("a", 20 + w.GAP_BYTES, 25 + w.GAP_BYTES, 2, 3), ("b", 0, 5, 3, 4), ("b", 5, 5 + w.READ_BYTES, 4, 5)]


def test_empty_table(spark, tmp_path):
    make(spark, tmp_path, [])
    assert w.op4_warc_index(spark, str(tmp_path)).count() == 0


def test_query_matches_its_sql(spark, tmp_path):
    import duckdb

    make(spark, tmp_path, [(i, "u", t, "") for i, t in enumerate(texts())])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, w.op4_warc_index(spark, str(tmp_path)).collect()))) == sorted(map(str, con.execute(w.SQL).fetchall()))


def test_long_payloads_and_missing_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(w, "READ_BYTES", 400)
    long = hashlib.sha256(b"x").hexdigest() * 2000
    make(spark, tmp_path, [(1, "u", long, ""), (None, "v", long, ""), (None, None, None, ""), (4, "u", "short", "")])
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in w.op4_warc_index(spark, str(tmp_path)).collect()}
    assert got == {(1, len(long), "response", None), (None, len(long), "response", None), (None, 0, "response", None), (4, 5, "response", None)}
