"""Full-text operators over documents, unstemmed so that SQL can follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenquery.functions import text as T
from lumenquery.operators import text_index as X
from lumenquery.plans.registry import query
from lumenquery.session import table

QUERIES = {"q1": "the token of that secret password", "q2": "apache license version", "q3": "idiot loser and trash with stupid clown", "q4": "ment euxre cion und der"}
_ACCENTS = ("áàâäãåéèêëíìîïóòôöõúùûüçýÿ", "aaaaaaeeeeiiiiooooouuuucyy")
_STOPS = ", ".join(f"'{w}'" for w in T.stop_words("english"))
_TOKENS = rf"""terms AS (SELECT doc_id AS id, list_filter(regexp_extract_all(translate(lower(text), '{_ACCENTS[0]}', '{_ACCENTS[1]}'), '[a-zñ0-9]+'),
    lambda t: (length(t) > 1 OR regexp_full_match(t, '[0-9]')) AND length(t) <= 50 AND t NOT IN ({_STOPS})) AS terms FROM documents),
    post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM terms) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    stat AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM terms)"""
_ASKED = "asked AS (SELECT q AS query, term, count(*) AS qtf FROM (SELECT q, unnest(list_filter(regexp_extract_all(t, '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN (" + _STOPS + "))) AS term FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in QUERIES.items()) + ") v(q, t)) GROUP BY ALL)"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.tokenised(table(spark, sf_dir, "documents"), "doc_id", "text", "english")


def _index(spark: SparkSession, sf_dir: str) -> X.TextIndex:
    """The stored index, built once for the table's files."""
    return X.TextIndex.of(table(spark, sf_dir, "documents"), "doc_id", "text", "english")


def _best(scores: DataFrame, k: int) -> DataFrame:
    """The k best by the score to nine places, so that ties are the same in SQL."""
    return X.rank(scores.withColumn("score", F.round("score", 9)), k).withColumn("score", F.round("score", 6))


def _asked(spark: SparkSession) -> DataFrame:
    return X.query_terms(spark, QUERIES, "english")


@query("text_tokens", f"WITH {_TOKENS} SELECT id, len(terms) AS n, array_to_string(terms[1:12], ' ') AS head FROM terms")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("id", F.size("terms").alias("n"), F.array_join(F.slice("terms", 1, 12), " ").alias("head"))


@query("text_dictionary", f"WITH {_TOKENS} SELECT p.term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, round(log10((SELECT n FROM stat) / count(*)::DOUBLE), 9) AS idf FROM post p GROUP BY p.term")
def text_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).dictionary().withColumn("idf", F.round("idf", 9))


@query("text_bm25", f"""WITH {_TOKENS}, {_ASKED}, len AS (SELECT id, len(terms) AS dl FROM terms),
    sc AS (SELECT query, p.id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM asked a JOIN post p USING (term) JOIN dfs USING (term) JOIN len USING (id), stat GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS place FROM sc) SELECT query, id, round(score, 6) AS score, CAST(place AS INT) AS place FROM r WHERE place <= 10""")  # fmt: skip
def text_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(_index(spark, sf_dir).bm25(_asked(spark)), 10)


@query("text_tfidf", f"""WITH {_TOKENS}, {_ASKED}, norm AS (SELECT id, sqrt(sum(pow(log10(1 + tf) * log10(n / df::DOUBLE), 2))) AS norm FROM post JOIN dfs USING (term), stat GROUP BY id),
    q AS (SELECT query, term, log10(n / df::DOUBLE) AS idf, log10(1 + qtf) * log10(n / df::DOUBLE) AS w FROM asked JOIN dfs USING (term), stat), qn AS (SELECT query, sqrt(sum(w * w)) AS qnorm FROM q GROUP BY query),
    sc AS (SELECT query, id, sum(w * idf * log10(1 + tf)) / (any_value(qnorm) * any_value(norm)) AS score FROM q JOIN post USING (term) JOIN norm USING (id) JOIN qn USING (query) WHERE idf > 0 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS place FROM sc) SELECT query, id, round(score, 6) AS score, CAST(place AS INT) AS place FROM r WHERE place <= 10""")  # fmt: skip
def text_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(_index(spark, sf_dir).tfidf(_asked(spark)), 10)


@query("text_match_filtered", f"""WITH {_TOKENS}, len AS (SELECT id, len(terms) AS dl FROM terms),
    sc AS (SELECT p.id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post p JOIN dfs USING (term) JOIN len USING (id), stat WHERE term IN ('license', 'apache') GROUP BY p.id)
    SELECT doc_id, round(score, 6) AS score FROM documents JOIN sc ON doc_id = id WHERE lang = 'en' AND doc_id > 100""")  # fmt: skip
def text_match_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = _index(spark, sf_dir).bm25(X.query_terms(spark, {"m": "apache license"}, "english"))
    kept = docs.where((F.col("lang") == "en") & (F.col("doc_id") > 100)).select("doc_id")
    return kept.join(hits, kept.doc_id == hits.id).select("doc_id", F.round("score", 6).alias("score"))


@query("text_coordination", f"""WITH {_TOKENS}, {_ASKED}, len AS (SELECT id, CAST(sum(tf) AS BIGINT) AS dl FROM post GROUP BY id),
    sc AS (SELECT query, p.id, count(*) AS met, round(sum(tf / (1 + 0.1::DOUBLE * greatest(dl, 1))), 9) AS density FROM asked JOIN post p USING (term) JOIN len USING (id) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY met DESC, density DESC, id) AS place FROM sc) SELECT query, id, met, density, CAST(place AS INT) AS place FROM r WHERE place <= 10""")  # fmt: skip
def text_coordination(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark)
    return X.coordination(_index(spark, sf_dir).hits(asked), asked, 10).withColumn("density", F.round("density", 9))


@query("text_more_like_this", f"""WITH {_TOKENS} SELECT p.term, round(log10(1 + tf) * log10(n / df::DOUBLE), 9) AS weight FROM post p JOIN dfs USING (term), stat
    WHERE id = 16 AND tf >= 2 AND df >= 5 ORDER BY log10(1 + tf) * log10(n / df::DOUBLE) DESC, p.term LIMIT 25""")  # fmt: skip
def text_more_like_this(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return X.more_like_this(index.postings, 16, index.n).withColumn("weight", F.round("weight", 9))


@query("text_weights", f"""WITH {_TOKENS}, w AS (SELECT id, term, tf / sum(tf) OVER (PARTITION BY id) AS weight FROM post)
    SELECT id, term, round(weight, 12) AS relative, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY id)), 9) AS unit FROM w""")  # fmt: skip
def text_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    relative = index.postings.select("id", "term", (F.col("tf") / F.col("dl")).alias("weight"))
    return X.unit_length(relative, keep="relative").select("id", "term", F.round("relative", 12).alias("relative"), F.round("weight", 9).alias("unit"))


@query("text_diagnostics", f"WITH {_TOKENS}, {_ASKED} SELECT query, term, coalesce(df, 0) AS df, round(CASE WHEN df > 0 THEN log10(n / df::DOUBLE) ELSE 0 END, 9) AS idf FROM asked LEFT JOIN dfs USING (term), stat")
def text_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, index = _asked(spark), _index(spark, sf_dir)
    return X.diagnostics(index.hits(asked), asked, index.n).withColumn("idf", F.round("idf", 9))


@query("text_precision_recall", f"""WITH {_TOKENS}, {_ASKED}, len AS (SELECT id, len(terms) AS dl FROM terms),
    sc AS (SELECT query, p.id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM asked a JOIN post p USING (term) JOIN dfs USING (term) JOIN len USING (id), stat GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS place FROM sc), rel AS (SELECT 'q3' AS query, doc_id AS id FROM labels WHERE toxic = 1),
    hit AS (SELECT query, count(*) AS hits FROM r JOIN rel USING (query, id) WHERE place <= 10 GROUP BY query)
    SELECT query, round(coalesce(any_value(hits), 0) / 10, 9) AS precision, round(coalesce(any_value(hits), 0) / count(*)::DOUBLE, 9) AS recall FROM rel LEFT JOIN hit USING (query) GROUP BY query""")  # fmt: skip
def text_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _best(_index(spark, sf_dir).bm25(_asked(spark)), 10)
    relevant = table(spark, sf_dir, "labels").where("toxic = 1").select(F.lit("q3").alias("query"), F.col("doc_id").alias("id"))
    return X.precision_recall(ranked, relevant, 10).select("query", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("text_stemmed_bm25")
def text_stemmed_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English stems on both sides; the stemmer has no SQL form."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    return X.TextIndex.of(docs, "doc_id", "text", "english", stemming=True).bm25(X.query_terms(spark, {"q": "licensed versions of passwords"}, "english", stemming=True), 10)


@query("text_snippet", """SELECT doc_id, CASE WHEN length(text) <= 160 THEN text WHEN i = 0 THEN text[1:160] || '...' ELSE
    CASE WHEN greatest(0, i - 1 - 53) > 0 THEN '...' ELSE '' END || substr(text, greatest(0, i - 1 - 53) + 1, 160) || CASE WHEN greatest(0, i - 1 - 53) + 160 < length(text) THEN '...' ELSE '' END END AS snippet
    FROM (SELECT doc_id, text, instr(lower(text), 'license') AS i FROM documents)""")  # fmt: skip
def text_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.snippet(F.col("text"), ["license"]).alias("snippet"))
