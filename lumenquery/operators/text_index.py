"""Postings, TF-IDF and BM25 ranking, and measures of rankings."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenquery.functions import text as T
from lumenquery.functions.snowball import STEMMERS, stems
from lumenquery.session import Scratch, cut, ship

K1, B = 1.5, 0.75  # fixed values


def tokenised(docs: DataFrame, id_col: str, text_col: str, language: str | None) -> DataFrame:
    """(id, terms array) of every document."""
    return docs.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col), language).alias("terms"))


def postings(docs: DataFrame, id_col: str, text_col: str, language: str | None = None, stemming: bool = False) -> DataFrame:
    """(id, term, tf). Stems are found on the distinct terms and joined back."""
    # an outer explode: a plain one makes Spark infer a filter that tokenises every text once more
    found = tokenised(docs, id_col, text_col, language).select("id", F.explode_outer("terms").alias("term")).where("term IS NOT NULL")
    counts = found.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    if stemming and language in STEMMERS:
        counts = counts.join(stems(counts, "term", language), "term").groupBy("id", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
    return counts.select("id", "term", "tf")


def query_terms(spark, queries: dict, language: str | None = None, stemming: bool = False) -> DataFrame:
    """(query, term, tf) of a few given queries, through the same steps as documents."""
    rows = spark.createDataFrame([(k, v) for k, v in queries.items()], "query string, text string")
    return postings(rows, "query", "text", language, stemming).withColumnRenamed("id", "query")


def document_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf_log10(n: Column, df: Column) -> Column:
    """log10(N / df), 0 for terms of no document."""
    return F.when(df > 0, F.log10(n / df)).otherwise(F.lit(0.0))


def norms(index: DataFrame, n_docs: int) -> DataFrame:
    """(id, norm): length of each document's vector of log10(1 + tf) * idf."""
    weighted = index.join(document_frequencies(index), "term")
    w = F.log10(1 + F.col("tf")) * idf_log10(F.lit(float(n_docs)), F.col("df"))
    return weighted.groupBy("id").agg(F.sqrt(F.sum(w * w)).alias("norm"))


def rank(scores: DataFrame, k: int | None) -> DataFrame:
    """The k best (query, id, score) of each query, ties to the smaller id, with place from 1; without k all, unplaced."""
    if k is None:
        return scores
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _cosines(index: DataFrame, hits: DataFrame, queries: DataFrame, n_docs: int, lengths: DataFrame) -> DataFrame:
    """(query, id, score): index has all postings of the query terms, lengths the norms of documents."""
    df = document_frequencies(index)
    asked = queries.join(df, "term").withColumn("idf", idf_log10(F.lit(float(n_docs)), F.col("df"))).where("idf > 0")
    asked = asked.withColumn("w", F.log10(1 + F.col("tf")) * F.col("idf")).withColumn("qnorm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query"))))
    met = hits.select("id", "term", F.col("tf").alias("dtf")).join(F.broadcast(asked), "term")
    dots = met.groupBy("query", "id", "qnorm").agg(F.sum(F.col("w") * F.col("idf") * F.log10(1 + F.col("dtf"))).alias("dot"))
    scored = dots.join(lengths, "id").where("norm > 0")
    return scored.select("query", "id", (F.col("dot") / (F.col("qnorm") * F.col("norm"))).alias("score"))


def tfidf(index: DataFrame, queries: DataFrame, n_docs: int, k: int | None) -> DataFrame:
    """Cosine of log10(1 + tf) * idf vectors; terms in every document weigh nothing."""
    return rank(_cosines(index, index, queries, n_docs, norms(index, n_docs)), k)


def bm25(tokens: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 of (id, terms) rows for a few queries, query terms counted once.

    Only the queries' terms are exploded from a document, so nothing but hits and lengths leaves the
    scan; document frequencies are those of the hits.
    """
    wanted = [r.term for r in queries.select("term").distinct().orderBy("term").collect()]
    # texts are read once: what the ranking needs of them is small
    lengths = cut(tokens.select("id", F.size("terms").alias("dl"), F.filter("terms", lambda t: t.isin(wanted) if wanted else F.lit(False)).alias("hits")))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    if not stats.n or not stats.avgdl:
        return queries.sparkSession.createDataFrame([], "query string, id long, score double, place int")
    tf = lengths.where(F.size("hits") > 0).select("id", "dl", F.explode("hits").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln((F.lit(float(stats.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    asked = queries.select("query", "term").distinct().join(df, "term").select("query", "term", idf.alias("idf"))
    scale = k1 * (1 - b + b * F.col("dl") / F.lit(float(stats.avgdl)))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + scale)
    scores = tf.join(F.broadcast(asked), "term").groupBy("query", "id").agg(F.sum(part).alias("score"))
    return rank(scores, k)


def bm25_postings(index: DataFrame, queries: DataFrame, n_docs: int, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 from stored postings for a few queries; documents without terms count in the number and mean length only."""
    lengths = index.groupBy("id").agg(F.sum("tf").alias("dl"))
    words = index.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    if not n_docs or not words:
        return index.sparkSession.createDataFrame([], "query string, id long, score double, place int")
    tf = index.join(F.broadcast(queries.select("term").distinct()), "term", "left_semi").join(lengths, "id")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    asked = queries.select("query", "term").distinct().join(df, "term").select("query", "term", idf.alias("idf"))
    scale = k1 * (1 - b + b * F.col("dl") / F.lit(words / n_docs))
    scores = tf.join(F.broadcast(asked), "term").groupBy("query", "id").agg(F.sum(F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + scale)).alias("score"))
    return rank(scores, k)


BLOCK_DOCS, CHUNK_QUERIES = 4096, 2048  # documents of a block and queries of a chunk, about
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
DENSE = 8  # terms of one document in so many, or more, are kept as a whole row of a block


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers in one value, each in the narrowest type."""
    out = io.BytesIO()
    for a in arrays:
        np.save(out, a if a.dtype.kind == "f" or not len(a) or a.min() < 0 else a.astype(np.min_scalar_type(a.max())), allow_pickle=False)
    return out.getvalue()


def _unpacked(value: pa.Scalar, n: int) -> list[np.ndarray]:
    held = io.BytesIO(value.as_buffer())
    return [np.load(held, allow_pickle=False) for _ in range(n)]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    fresh = np.ones(len(columns[0]), dtype=bool)
    if len(fresh):
        fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(fresh)


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a block's documents: ids, and lengths, terms and postings by term, packed. Rows of one id are one document.

    Terms are counted for a few rows at a time, so all words of a block are never held at once.
    """
    ids, sizes, parts, kind = [], [], [], None
    for b in batches:
        kind = b.schema.field("id").type
        for at in range(0, b.num_rows, 512):
            piece = b.slice(at, 512)
            size = piece.column("terms").value_lengths().to_numpy(zero_copy_only=False)
            terms = piece.column("terms").flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(ids), len(ids) + len(size), dtype=np.int32), size)
            by = np.lexsort((row, terms))
            terms, row = terms[by], row[by]
            first = _starts(terms, row)
            parts.append((terms[first].astype(np.int64), row[first], np.diff(np.append(first, len(terms))).astype(np.int32)))
            ids += piece.column("id").to_pylist()
            sizes.append(size)
    named = pa.array(ids, kind).dictionary_encode()
    names, who = named.dictionary, named.indices.to_numpy()
    order = pc.array_sort_indices(names)
    rank = np.empty(len(names), dtype=np.int32)
    rank[order.to_numpy()] = np.arange(len(names))
    lengths = np.bincount(rank[who], weights=np.concatenate(sizes), minlength=len(names)).astype(np.int64)
    terms, row, tf = (np.concatenate([p[i] for p in parts]) for i in range(3))
    del parts
    place = rank[who[row]]
    by = np.lexsort((place, terms))
    terms, place, tf = terms[by], place[by], tf[by]
    first = _starts(terms, place)
    tf = np.add.reduceat(tf, first) if len(first) else tf
    terms, place = terms[first], place[first]
    heads = _starts(terms)
    packed = _packed(lengths, terms[heads], np.append(heads, len(terms)), place, tf)
    yield pa.record_batch([pa.array([names.take(order).to_pylist()], pa.list_(names.type)), pa.array([packed], pa.binary()), pa.array([int(lengths.sum())])], names=["ids", "postings", "words"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): the documents of each term of each block."""
    for b in batches:
        for value in b.column(0):
            _, terms, cuts, _, _ = _unpacked(value, 5)
            yield pa.record_batch([pa.array(terms.astype(np.int64)), pa.array(np.diff(cuts.astype(np.int64)))], names=["key", "n"])


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a chunk's queries: names, and terms with their document frequencies, rare ones first, packed."""
    t = pa.Table.from_batches(list(batches))
    names = t.column("query").combine_chunks().dictionary_encode()
    who = names.indices.to_numpy().astype(np.int64)
    key, df = (t.column(c).to_numpy() for c in ("key", "df"))
    order = np.lexsort((key, df, who))
    cuts = np.searchsorted(who[order], np.arange(len(names.dictionary) + 1))
    yield pa.record_batch([pa.array([names.dictionary.to_pylist()], pa.list_(names.type.value_type)), pa.array([_packed(cuts, key[order], df[order])], pa.binary())], names=["queries", "asked"])


def _least(scores: np.ndarray, k: int) -> float:
    """A score that k of the scores reach: groups of 64 have so large a one; 0 if there are too few groups."""
    wide = len(scores) // 64
    return np.partition(scores[: wide * 64].reshape(64, wide).max(axis=0), wide - k)[wide - k] if wide >= k else 0.0


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores above 0, largest first, ties by place."""
    least = _least(scores, k)
    at = np.flatnonzero(scores >= least if least > 0 else scores > 0)
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def _scored(n_docs: int, mean: float, k: int, k1: float, b: float):
    """(query, id, score): the k best documents of each block for each query of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, names = batch.column("ids")[r].values, batch.column("queries")[r].values
                lengths, terms, cuts, place, tf = (x.astype(np.int64) for x in _unpacked(batch.column("postings")[r], 5))
                q_cuts, keys, df = (x.astype(np.int64) for x in _unpacked(batch.column("asked")[r], 3))
                wanted, one = np.unique(keys, return_index=True)
                wanted_df, spot = df[one], np.searchsorted(terms, wanted)
                here = np.flatnonzero(terms[np.minimum(spot, len(terms) - 1)] == wanted) if len(terms) else np.zeros(0, dtype=np.int64)
                scale = k1 * (1 - b + b * lengths / mean)
                parts: list = [None] * len(wanted)
                for i in here.tolist():
                    s = slice(cuts[spot[i]], cuts[spot[i] + 1])
                    at, f = place[s], tf[s]
                    weight = math.log((n_docs - wanted_df[i] + 0.5) / (wanted_df[i] + 0.5) + 1) * f * (k1 + 1) / (f + scale[at])
                    if wanted_df[i] * DENSE >= n_docs:
                        whole = np.zeros(len(ids))
                        whole[at] = weight
                        parts[i] = (None, whole)
                    else:
                        parts[i] = (at, weight)
                asked = np.searchsorted(wanted, keys).tolist()
                scores, found = np.zeros(len(ids)), []
                for q in range(len(names)):
                    scores[:] = 0
                    # the same order of terms in every block: equal documents have equal scores
                    for i in asked[q_cuts[q] : q_cuts[q + 1]]:
                        if parts[i]:
                            at, weight = parts[i]
                            if at is None:
                                scores += weight
                            else:
                                scores[at] += weight
                    at = _best(scores, k)
                    found.append((at, scores[at]))
                which = np.repeat(np.arange(len(names)), [len(at) for at, _ in found])
                if len(which):
                    columns = [names.take(pa.array(which)), ids.take(pa.array(np.concatenate([at for at, _ in found]))), pa.array(np.concatenate([x for _, x in found]))]
                    yield pa.record_batch(columns, names=["query", "id", "score"])
                    del columns
                # before the next block is unpacked
                del ids, names, lengths, terms, cuts, place, tf, parts, found, which, scores
                pa.default_memory_pool().release_unused()

    return run


def bm25_blocks(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, k: int, k1: float = K1, b: float = B, language: str | None = None) -> DataFrame:
    """BM25 of a table of (query, term) rows, the k best documents of each: (query, id, score, place).

    Documents are dealt to blocks and queries to chunks, packed and stored; every chunk meets every
    block, read from the shared folder, and only the k best of a block are shuffled, so the work
    grows with queries times documents and disk does not. Terms go by their 64-bit hashes. Rows of
    one id are one document, null ids have no hits; both count in the number of documents.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = tokenised(docs, id_col, text_col, language).select("id", F.transform(F.coalesce("terms", F.array().cast("array<string>")), lambda t: F.xxhash64(t)).alias("terms"))
    n_docs = docs.count()
    blocks = max(1, round(n_docs / BLOCK_DOCS))
    kind, q_kind = rows.schema["id"].dataType.simpleString(), queries.schema["query"].dataType.simpleString()
    dealt = rows.where("id IS NOT NULL").groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    held = scratch.store(dealt.applyInArrow(_block, f"ids array<{kind}>, postings binary, words long").repartition(blocks))
    unnamed = rows.where("id IS NULL").select(F.size("terms").cast("long").alias("words"))
    words = held.select("words").unionByName(unnamed).agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    if not n_docs or not words:
        return spark.createDataFrame([], f"query {q_kind}, id {kind}, score double, place int")
    wanted = queries.where("query IS NOT NULL").select("query", F.xxhash64("term").alias("key")).distinct()
    df = held.select("postings").mapInArrow(_frequencies, "key long, n long").groupBy("key").agg(F.sum("n").alias("df"))
    asked = scratch.store(wanted.join(df, "key").select("query", "key", "df"))
    chunks = max(1, round(asked.select("query").distinct().count() / CHUNK_QUERIES))
    chunked = scratch.store(asked.groupBy(F.pmod(F.xxhash64("query"), F.lit(chunks)).alias("chunk")).applyInArrow(_chunk, f"queries array<{q_kind}>, asked binary").repartition(chunks))
    # a batch that meets a task holds a few blocks only; a bound that the caller set stays
    if not spark.conf._jconf.contains(BATCH_KEY):
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    met = held.drop("words").hint("shuffle_replicate_nl").crossJoin(chunked)
    return rank(met.mapInArrow(_scored(n_docs, words / n_docs, k, k1, b), f"query {q_kind}, id {kind}, score double"), k)


BUCKETS = 64  # folders that an index's terms are dealt to


class TextIndex:
    """Postings of a table, written once, by term: (term, id, tf, dl), with norms added when first asked for.

    Terms are dealt to bucket folders, so a query reads its terms' folders only; a folder holds several
    files by a hash of the document, so a frequent term is no single task's work. The index belongs to
    the version of the table that it was built from; `of` keeps one for every version.
    """

    _KEPT: dict[tuple, TextIndex] = {}

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, language: str | None = None, stemming: bool = False, buckets: int = BUCKETS):
        self.spark, self.buckets = docs.sparkSession, buckets
        self.scratch = Scratch(self.spark)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        terms = tokenised(docs, id_col, text_col, language).select("id", F.size("terms").cast("long").alias("dl"), F.explode_outer("terms").alias("term")).where("term IS NOT NULL")
        if stemming and language in STEMMERS:
            found = self.scratch.store(terms.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
            terms = found.join(stems(found, "term", language), "term").select("id", "dl", F.col("stem").alias("term"), "tf")
        else:
            terms = terms.withColumn("tf", F.lit(1).cast("long"))
        place = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        salt = F.pmod(F.xxhash64("id"), F.lit(max(1, parts // buckets))).cast("int")
        dealt = terms.withColumn("bucket", place).withColumn("salt", salt).repartition("bucket", "salt")
        counted = dealt.groupBy("bucket", "salt", "term", "id", "dl").agg(F.sum("tf").alias("tf")).drop("salt")
        self.path = f"{self.scratch.folder}/postings"
        counted.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").option("compression", "none").parquet(self.path)
        self.postings = self.spark.read.schema(counted.select("term", "id", "dl", "tf", "bucket").schema).parquet(self.path)
        self.n = docs.count()
        self.words = self.postings.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
        self._norms: DataFrame | None = None

    @classmethod
    def of(cls, docs: DataFrame, id_col: str, text_col: str, language: str | None = None, stemming: bool = False) -> TextIndex:
        """The index of a table, built once for its plan and the names, lengths and times of its files."""
        spark = docs.sparkSession
        conf = spark._jsc.hadoopConfiguration()
        files = []
        for f in sorted(docs.inputFiles()):
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            status = path.getFileSystem(conf).getFileStatus(path)
            files.append((f, status.getLen(), status.getModificationTime()))
        key = (spark.sparkContext.applicationId, docs.semanticHash(), tuple(files), id_col, text_col, language, stemming)
        if not files or key not in cls._KEPT:
            made = cls(docs, id_col, text_col, language, stemming)
            if not files:
                return made
            cls._KEPT[key] = made
        return cls._KEPT[key]

    def hits(self, terms: DataFrame) -> DataFrame:
        """The postings of a few terms; only their folders are read."""
        wanted = terms.select("term", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("bucket")).distinct().collect()
        if not wanted:
            return self.postings.limit(0)
        return self.postings.where(F.col("bucket").isin(sorted({r.bucket for r in wanted})) & F.col("term").isin(sorted(r.term for r in wanted)))

    def dictionary(self) -> DataFrame:
        """(term, df, cf, idf) of every term."""
        counts = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
        return counts.withColumn("idf", idf_log10(F.lit(float(self.n)), F.col("df")))

    def norms(self) -> DataFrame:
        if self._norms is None:
            self._norms = self.scratch.store(norms(self.postings, self.n))
        return self._norms

    def bm25(self, queries: DataFrame, k: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
        """(query, id, score) of a few queries, the k best with their places, or all without k."""
        if not self.n or not self.words:
            return rank(self.spark.createDataFrame([], "query string, id long, score double"), k)
        found = self.hits(queries)
        df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        idf = F.ln((F.lit(float(self.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        asked = queries.select("query", "term").distinct().join(df, "term").select("query", "term", idf.alias("idf"))
        scale = k1 * (1 - b + b * F.col("dl") / F.lit(self.words / self.n))
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + scale)
        return rank(found.join(F.broadcast(asked), "term").groupBy("query", "id").agg(F.sum(part).alias("score")), k)

    def tfidf(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """Cosines of a few queries; norms are read for the documents that were hit."""
        found = self.hits(queries)
        return rank(_cosines(found, found, queries, self.n, self.norms()), k)


def coordination(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Rank by the number of query terms met, then by the sum of tf / (1 + length / 10)."""
    hits = index.join(F.broadcast(queries.select("query", "term").distinct()), "term")
    if "dl" not in index.columns:
        hits = hits.join(index.groupBy("id").agg(F.sum("tf").alias("dl")), "id")
    found = hits.groupBy("query", "id").agg(F.count(F.lit(1)).alias("met"), F.sum(F.col("tf") / (1 + 0.1 * F.greatest(F.col("dl"), F.lit(1)))).alias("density"))
    order = Window.partitionBy("query").orderBy(F.desc("met"), F.desc("density"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def more_like_this(index: DataFrame, doc_id, n_docs: int, max_terms: int = 25, min_tf: int = 2, min_df: int = 5) -> DataFrame:
    """(term, weight): the terms of one document that say most about it, ties alphabetical."""
    own = index.where((F.col("id") == doc_id) & (F.col("tf") >= min_tf))
    df = document_frequencies(index.join(F.broadcast(own.select("term")), "term", "left_semi")).where(F.col("df") >= min_df)
    weight = F.log10(1 + F.col("tf")) * idf_log10(F.lit(float(n_docs)), F.col("df"))
    return own.join(df, "term").select("term", weight.alias("weight")).orderBy(F.desc("weight"), "term").limit(max_terms)


def surfaces(docs: DataFrame, id_col: str, text_col: str, language: str) -> DataFrame:
    """(stem, surface, n, first_id): the words that each stem stands for, how often, and the least document with them."""
    found = tokenised(docs, id_col, text_col, language).select("id", F.explode_outer("terms").alias("term")).where("term IS NOT NULL")
    counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    return counts.join(stems(counts, "term", language), "term").select("stem", F.col("term").alias("surface"), "n", "first_id")


def surface_forms(forms: DataFrame, most: int = 10) -> DataFrame:
    """(stem, forms): a stem's words as an array, commonest first, ties alphabetical."""
    order = Window.partitionBy("stem").orderBy(F.desc("n"), "surface")
    best = forms.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most)
    return best.groupBy("stem").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "surface"))), lambda x: x["surface"]).alias("forms"))


def first_surfaces(docs: DataFrame, id_col: str, text_col: str, doc_id, language: str) -> DataFrame:
    """(stem, surface): the first word of one document that each stem stands for."""
    own = tokenised(docs.where(F.col(id_col) == doc_id), id_col, text_col, language).select(F.posexplode("terms").alias("at", "term"))
    named = own.join(stems(own, "term", language), "term")
    return named.groupBy("stem").agg(F.min(F.struct("at", "term")).alias("f")).select("stem", F.col("f.term").alias("surface"))


def relative_tf(index: DataFrame) -> DataFrame:
    """(id, term, weight): tf over the document's length."""
    total = F.sum("tf").over(Window.partitionBy("id"))
    return index.select("id", "term", (F.col("tf") / total).alias("weight"))


def unit_length(weights: DataFrame, keep: str | None = None) -> DataFrame:
    """(id, term, weight) rows scaled to vectors of length 1; zero vectors go. keep names the weight before."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("id")))
    before = [F.col("weight").alias(keep)] if keep else []
    return weights.withColumn("__norm", norm).where("__norm > 0").select("id", "term", *before, (F.col("weight") / F.col("__norm")).alias("weight"))


def diagnostics(index: DataFrame, queries: DataFrame, n_docs: int) -> DataFrame:
    """(query, term, df, idf) of the query terms, absent ones with df 0."""
    df = document_frequencies(index.join(F.broadcast(queries.select("term").distinct()), "term", "left_semi"))
    found = queries.select("query", "term").join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return found.select("query", "term", "df", idf_log10(F.lit(float(n_docs)), F.col("df")).alias("idf"))


def precision_recall(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query, precision, recall) of the first k of each ranking; precision counts k places even if fewer are filled."""
    hits = ranked.where(F.col("place") <= k).join(relevant.select("query", "id").distinct(), ["query", "id"], "left_semi").groupBy("query").agg(F.count(F.lit(1)).alias("hits"))
    size = relevant.select("query", "id").distinct().groupBy("query").agg(F.count(F.lit(1)).alias("size"))
    found = size.join(hits, "query", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return found.select("query", (F.col("hits") / F.lit(float(k))).alias("precision"), (F.col("hits") / F.col("size")).alias("recall"))


def average_length(tokens: DataFrame) -> float:
    return tokens.agg(F.coalesce(F.avg(F.size("terms")), F.lit(0.0))).first()[0]


def idf_bm25(n: int, df: int) -> float:
    """The BM25 idf of one term, for callers that hold the counts."""
    return math.log((n - df + 0.5) / (df + 0.5) + 1)
