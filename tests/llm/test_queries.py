import duckdb
import pytest

from lumenquery.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted", "op2_matroska": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op3_secrets": "doc_id n_assign n_access n_hex base_sha256 spans", "op4_wrappers": "page_id url text n_chars", "op5_simhash": "doc_id fingerprint component_id",
    "op6_quality": "doc_id held_out score predicted", "op7_mixing": "doc_id size source_size target taken", "op8_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op9_sentencepiece": "doc_id", "op10_permutations": "query_id rank vec_id score",
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_returns_its_columns_for_every_row(spark, name):
    out = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    if name == "op10_permutations":
        asked = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").count()
        assert out.select("query_id").distinct().count() == asked and out.count() == 20 * asked
    else:
        source = "pages" if name == "op4_wrappers" else "documents"
        assert out.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


def test_mixing_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({queries.ORACLES['op7_mixing']})").fetchall())
    got = sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in queries.QUERIES["op7_mixing"](spark, SF).collect())
    assert got == want
