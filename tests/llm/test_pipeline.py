import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from fluvia.llm import pii  # noqa: E402
from fluvia.llm.word_tokens import WordTokenizer, word_file  # noqa: E402
from tests.llm.test_line_dedup import brute as brute_lines  # noqa: E402
from tests.llm.test_near_dedup import brute as brute_near  # noqa: E402


def corpus():
    out = []
    for i in range(60):
        words = [f"w{(i * 131 + k * 7) % 911}" for k in range(50)]
        out.append((i, f"shared menu line\n{' '.join(words)}\nmail a{i}.b@example.org now", f"s{i % 2}"))
    out += [(100 + i, out[i][1].replace("mail", "post"), "s0") for i in range(6)]
    out += [(200 + i, " ".join(f"w{(i * 31 + k * 11) % 911}###" for k in range(50)), "s1") for i in range(30)]
    out += [(300, None, "s0"), (301, "", "s1"), (302, "too short", None), (303, "long " * 4000, "s0")]
    return out


def test_run_matches_brute_force(spark, tmp_path):
    rows = corpus()
    docs = [(i, t, "en", s, len(t or ""), "x") for i, t, s in rows] + [(0, rows[0][1], "en", rows[0][2], 0, "x")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, extra string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200), 0) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = now.columns
        now = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert now.columns == columns
            kept[name] = {r.doc_id: r.text for r in now.collect()}
    clean = {i: t for i, t, _ in rows if i < 200}
    assert kept["quality rules"] == clean
    source = {i: s for i, _, s in rows}
    ids = [*clean, 0]
    lines = dict(zip(ids, brute_lines([(source[i], clean[i]) for i in ids])))
    assert kept["line dedup"] == lines
    want = {i for i, (_, c) in brute_near(list(lines.items()), 5).items() if i == c}
    assert set(kept["near-duplicates"]) == want
    masked = {i: pii.masked(lines[i], pii.base_spans(lines[i])) for i in want}
    assert kept["personal data"] == masked and "[EMAIL]" in masked[0]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    t = WordTokenizer(word_file())
    lengths = {i: len(b) // 4 for i, b in zip(masked, t.batch(list(masked.values())))}
    covered = {}
    for r in pieces:
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.length
    assert covered == lengths


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_whole_copy_of_a_group_above_the_ratio_survives(spark, tmp_path):
    copy = "\n".join(" ".join(f"copy{k}x{j}" for j in range(12)) for k in range(6))
    rows = [(i, f"shared menu line\n{' '.join(f'w{(i * 131 + k * 7) % 911}' for k in range(50))}") for i in range(40)]
    rows += [(100 + i, copy) for i in range(20)] + [(130, f"{copy}\n \n"), (131, f"{copy}\na line of its own"), (132, "shared menu line\n")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    lines = corpus_pipeline.line_frequency(spark, docs, str(tmp_path))
    texts = {r.doc_id: r.text for r in lines.collect()}
    assert all(texts[i] == rows[i][1].split("\n")[1] for i in range(40))
    assert all(texts[i] == t for i, t in rows if 100 <= i <= 130) and texts[131] == "a line of its own" and texts[132] == "shared menu line\n"
    kept = {r.doc_id: r.text for r in corpus_pipeline.near_duplicates(spark, lines, str(tmp_path)).collect()}
    assert [i for i in sorted(kept) if 100 <= i <= 130] == [100] and kept[100] == copy


def test_rows_that_share_or_lack_an_id(spark, tmp_path):
    words = lambda k: " ".join(f"w{(k * 131 + j * 7) % 911}" for j in range(60))
    rows = [(1, words(2), {"a": 1}), (1, words(1), {"a": 2}), (2, words(3), None), (None, words(3), None), (None, None, None), (3, words(3), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>")
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, min(words(1), words(2))), (2, words(3)), (None, words(3)), (None, None)], key=str)
