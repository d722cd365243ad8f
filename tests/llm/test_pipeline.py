"""The pipeline's stages, each against what its operator must do to its own input."""

import corpus_pipeline
from quadrille.llm.shared import read_table
from tests.llm.test_operators import ODD, check_packing, exact_brute, jaccard_brute, texts


def test_stages(spark):
    docs = spark.createDataFrame([(i, t, "xx", "s", 7) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long").unionByName(read_table(spark, "/root/testdata/sf0.001", "documents").selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "n_chars"))
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, "")
        assert out.columns == docs.columns
        rows, before = texts(out), texts(seen)
        if name == "language_id":
            assert {i for i, t in before} - {i for i, _ in rows} == {i for i, t in before if not any(c.isalpha() for c in t)}
        elif name == "exact_dedup":
            assert {i for i, _ in rows} == {r[0] for r in exact_brute(before) if r[3]}
        elif name == "near_dedup":
            assert {i for i, _ in rows} == {i for i, _, c in jaccard_brute(before, 5, 80) if i == c}
        else:
            assert {i for i, _ in rows} == {i for i, _ in before} and not any("token = abcdef" in t for _, t in rows)
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        seen = spark.createDataFrame(out.collect(), out.schema)
    check_packing(seen, corpus_pipeline.STAGES[-1][1](spark, seen, "").collect())


def test_run_over_a_table(spark, tmp_path):
    read_table(spark, "/root/testdata/sf0.001", "documents").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and "sequence_id" in out.columns


def test_stages_of_an_empty_table_with_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, node long, text string, lang string, source string, n_chars int, _id int, digest string, key string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0
