from collections import Counter

from pyspark.sql import functions as F

from fluvia.llm import line_dedup as d


def brute(rows, ratio=d.MAX_RATIO, min_pages=d.MIN_PAGES, min_copies=d.MIN_COPIES):
    totals = Counter(h for h, _ in rows)
    copies = Counter((h, x) for h, t in rows for x in set((t or "").split("\n")) if t is not None and x.strip(" \t\x0b\x0c\r"))
    bad = {k for k, n in copies.items() if k[0] is not None and totals[k[0]] >= min_pages and n >= min_copies and n > ratio * totals[k[0]]}
    return [t if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in bad) for h, t in rows]


def rows():
    out = [("a", f"menu\nbody {i}\n\nmenu\nfooter {i % 3}") for i in range(40)] + [("b", f"menu\nb {i}") for i in range(19)]
    out += [("c", "menu\n" * (i < 5) + f"c {i}") for i in range(60)] + [(None, "menu\nx"), ("a", None), ("a", ""), ("a", "x" * 50_000)]
    return out


def test_matches_brute_force(spark):
    data = [(i, h, t, "clash") for i, (h, t) in enumerate(rows())]
    df = spark.createDataFrame(data, "doc_id long, source string, text string, line string")
    for limit in (0, 1000):
        d.BROADCAST_LINES, before = limit, d.BROADCAST_LINES
        got = {r.doc_id: r for r in d.without_boilerplate(df).collect()}
        d.BROADCAST_LINES = before
        for i, want in enumerate(brute(rows())):
            assert got[i].text == want and got[i].line == "clash"
    assert d.without_boilerplate(df.filter(F.lit(False))).count() == 0


def test_query_matches_its_sql(spark, tmp_path):
    import duckdb

    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows())], "doc_id long, source string, text string").coalesce(1).write.parquet(path)
    got = sorted(map(tuple, d.op7_line_dedup(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert got == sorted(con.execute(d.SQL).fetchall())
