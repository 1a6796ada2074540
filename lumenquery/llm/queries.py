"""The registered queries of this subpackage: thin digests over the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenquery.llm import matroska, permutations, pii, quality, secrets, sentencepieces, toxicity, wrappers
from lumenquery.llm.mixing import mix
from lumenquery.llm.simhash import simhash_classes
from lumenquery.session import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_features(matroska.with_media(table(spark, sf_dir, "documents")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


def op4_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents")).drop("ids")


def op10_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutations.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_matroska": op2_matroska,
    "op3_secrets": op3_secrets,
    "op4_wrappers": op4_wrappers,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_pii": op8_pii,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_permutations": op10_permutations,
}

ORACLES: dict[str, str] = {
    "op7_mixing": r"""
        WITH docs AS (
          SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk, md5(CAST(doc_id AS VARCHAR)) AS place,
                 CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
        per AS (SELECT sk, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY sk),
        weighed AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY sk) - 1) % 3) + 1] AS w, source_size * 3 AS cap FROM per),
        run AS (SELECT *, row_number() OVER o AS nth, (SELECT sum(source_size) FROM per) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                       sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
                FROM weighed WINDOW o AS (ORDER BY cap / w, sk)),
        lev AS (SELECT arg_min(CAST(rest AS DOUBLE) / open, nth) AS level FROM run WHERE CAST(rest AS DOUBLE) / open <= cap / w),
        tgt AS (SELECT sk, source_size, least(CAST(cap AS DOUBLE), coalesce(level * w, CAST(cap AS DOUBLE))) AS target FROM run, lev),
        placed AS (SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
                          coalesce(sum(size) OVER (PARTITION BY sk ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                   FROM docs JOIN tgt USING (sk))
        SELECT doc_id, size, source_size, target,
               CAST(CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) ELSE 0 END AS BIGINT) AS taken
        FROM placed""",
}
