"""The pipeline's stages on the small tables, each held against its own operator or brute force."""

import corpus_pipeline
from cohortry.llm import jaccard, langid

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    every = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, every[-1], sf).write.parquet(out)
        every.append(spark.read.parquet(out))
    raw, spoken, single, masked, mixed, packed = every
    assert all(d.columns == COLUMNS for d in every[:-1])
    rejected = {r["doc_id"] for r in langid.language_id(docs).where("rejected").collect()}
    assert {r["doc_id"] for r in spoken.collect()} == {r["doc_id"] for r in raw.collect()} - rejected
    groups = jaccard.similar_components(spoken).collect()
    assert {r["doc_id"] for r in single.collect()} == {r["component_id"] for r in groups}
    assert masked.count() == single.count()
    assert mixed.where("text is null").count() == 0 and packed.count() >= mixed.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(out)
        docs = spark.read.parquet(out)
    assert docs.count() == 0


def test_stages_on_edge_rows(spark, edge_docs, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and clashing column names go through every stage."""
    docs = edge_docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, "").write.parquet(out)
        found = spark.read.parquet(out)
        if name != "packing":
            assert found.columns == edge_docs.columns
        ids = {r[0] for r in found.select("doc_id").collect()}
        assert ids and 5 in ids
        if name == "ngram_jaccard_join":
            assert not ids & {6, 7} and found.count() == len(ids)
        if name == "secret_scans":
            assert not found.where("text like '%0123456789abcdef%' or text like '%AKIAABCDEF%'").count()
        docs = found
