import corpus_pipeline
from lumenquery.llm import pii


def test_stages_keep_columns_and_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "sentencepiece"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if n < 4:
            assert docs.columns == columns
        if n < 3:
            assert docs.count() <= before
            before = docs.count()
        if n == 2:
            left = docs.select(pii.base_spans(docs.text).alias("s")).where("size(s) > 0").count()
            assert left == 0
    assert docs.where("NOT parity").count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and {"doc_id", "ids", "n_tokens"} <= set(out.columns)


def test_stages_survive_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path, labels):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for start in (odd_docs, no_docs):
        docs = start
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            rows = docs.collect()
            docs = spark.createDataFrame(rows, docs.schema)
        assert docs.columns[:4] == ["doc_id", "lang", "source", "n_chars"]
