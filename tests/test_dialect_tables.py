import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenquery.operators import snapshots as N
from lumenquery.operators.snapshots import SnapshotTable, WriteConflict
from lumenquery.plans import registry
from lumenquery.plans.dialect import Session, SqlError, lex
from lumenquery.sources import ingest as I
from lumenquery.streaming import windows as W


@pytest.fixture()
def db(spark):
    s = Session(spark)
    s.script(
        "CREATE TABLE docs (id INT PRIMARY KEY, contenido VARCHAR(200)); INSERT INTO docs VALUES (1, 'La casa es grande'); INSERT INTO docs VALUES (2, 'El gato está en la casa');"
        "INSERT INTO docs VALUES (3, 'La casa es bonita y grande'); INSERT INTO docs VALUES (4, 'El sol; brilla sobre la casa'); CREATE INDEX ON docs(contenido) USING INVERTED"
    )
    return s


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_match(db):
    out = db.execute("SELECT id, SCORE() AS s FROM docs WHERE MATCH(contenido, 'casa grande') USING BM25").collect()
    assert [r.id for r in out] == [1, 3, 2, 4]
    assert [r[0] for r in rows(db.execute("SELECT id FROM docs WHERE MATCH(contenido, 'casa grande') USING TF_IDF"))] == [1, 3]
    out = rows(db.execute("SELECT id, SCORE() FROM docs WHERE MATCH(contenido, 'casa grande') USING BM25 AND id > 1 ORDER BY id"))
    assert [r[0] for r in out] == [2, 3, 4] and out[1][1] > out[2][1]


def test_similar_with_extractor(spark):
    s = Session(spark)
    s.script("CREATE TABLE frases (id INT PRIMARY KEY, texto VARCHAR(40)); INSERT INTO frases VALUES (1, 'aaa'); INSERT INTO frases VALUES (2, 'bbb'); INSERT INTO frases VALUES (3, 'aab'); CREATE INDEX ON frases(texto) USING HNSW")
    s.use_extractor("frases", "texto", lambda t: [float(t.count(c)) for c in "abc"])
    out = s.execute("SELECT id, SIMILARITY_SCORE() FROM frases WHERE SIMILAR_TO('aaaa', k=2) USING HNSW")
    assert [r[0] for r in rows(out)] == [1, 3]
    assert s.execute("SELECT * FROM frases WHERE SIMILAR_TO('aaaa', k=2) USING EXACT").columns == ["id", "texto"]
    assert [r[0] for r in rows(s.execute("SELECT id FROM frases WHERE SIMILAR_TO('aaaa', k=2) USING EXACT AND id > 1"))] == [3, 2]


def test_ivf_clause(spark):
    s = Session(spark)
    s.register("e", spark.createDataFrame([(i, [float(i % 10), 1.0]) for i in range(100)], "vec_id long, v array<double>"), "vec_id")
    s.execute("CREATE INDEX ON e(v) USING IVF")
    out = s.execute(f"SELECT vec_id FROM e WHERE SIMILAR_TO('{json.dumps([3.0, 1.0])}', k=3) USING IVF WITH METRIC=euclidean")
    assert [r[0] for r in rows(out)] == [3, 13, 23]


def test_transactions_and_keys(db):
    db.script("BEGIN; DELETE FROM docs WHERE id = 1; ROLLBACK")
    assert db.execute("SELECT COUNT(*) FROM docs").first()[0] == 4
    db.script("BEGIN; DELETE FROM docs WHERE id = 1; COMMIT; UPDATE docs SET contenido = 'x' WHERE id >= 3")
    assert rows(db.execute("SELECT id, contenido FROM docs WHERE contenido = 'x' ORDER BY id DESC")) == [(4, "x"), (3, "x")]
    with pytest.raises(N.KeyConflict):
        db.execute("INSERT INTO docs VALUES (2, 'again')")
    with pytest.raises(SqlError):
        db.script("BEGIN; DELETE FROM docs; DROP TABLE docs")
    assert db.saved is None and db.execute("SELECT COUNT(*) FROM docs").first()[0] == 3
    db.execute("DROP TABLE docs")
    with pytest.raises(SqlError):
        db.execute("SELECT * FROM docs")


def test_points_labels_and_groups(spark):
    s = Session(spark)
    s.script("CREATE TABLE t (id INT PRIMARY KEY, k VARCHAR(5), at POINT); INSERT INTO t VALUES (1, 'a', POINT(-12.1, -77.0)); INSERT INTO t VALUES (2, 'a', POINT(-12.0, -77.0)); INSERT INTO t VALUES (3, 'b', POINT(0, 0)); SET p = POINT(-12.1, -77.0)")
    out = s.execute("SELECT *, distancia(at, p), distancia(at, p) FROM t WHERE dentro_de(at, POLYGON(POINT(-13,-78), POINT(-13,-76), POINT(-11,-76), POINT(-11,-78))) ORDER BY distancia(at, p)")
    assert out.columns[3:] == ["distancia(at,p)", "distancia(at,p)_2"] and [r.id for r in out.collect()] == [1, 2]
    assert sorted(rows(s.execute("SELECT k FROM t GROUP BY k"))) == [("a", 2), ("b", 1)]
    assert rows(s.execute("SELECT SUM(id), AVG(id), COUNT(*) FROM t WHERE id > 9")) == [(0, 0.0, 0)]
    plan = s.execute("EXPLAIN ANALYZE SELECT id FROM t WHERE id = 1").collect()
    assert plan[-1].plan == "rows: 1"
    s.execute("EXPLAIN DELETE FROM t")
    assert s.execute("SELECT COUNT(*) FROM t").first()[0] == 3


@pytest.mark.parametrize(
    "text",
    ["SELECT", "SELECT x FROM docs", "SELECT id FROM docs LIMIT 0", "SELECT *, id FROM docs", "SELECT id FROM docs WHERE MATCH(contenido, 'a') USING X", "SELECT id FROM docs WHERE id = 1 OR MATCH(contenido, 'a') USING BM25",
     "SELECT id FROM docs WHERE SIMILAR_TO('a', k=2) USING EXACT", "CREATE TABLE d (a INT)", "CREATE TABLE d (a VARCHAR PRIMARY KEY)", "SET p = POINT(99, 0)", "INSERT INTO docs VALUES (9)", "INSERT INTO docs VALUES ('x', 'y')", "COMMIT", "FOO"],
)
def test_errors(db, text):
    with pytest.raises(ValueError):
        db.execute(text)


def test_lexer():
    assert lex("SELECT 'it''s', x_1 >= 2.5") == [("word", "select"), ("str", "it's"), ("op", ","), ("name", "x_1"), ("op", ">="), ("num", "2.5")]


def test_snapshot_table(spark, tmp_path):
    t = N.SnapshotTable(spark, str(tmp_path / "t"), "k")
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    t.stage(df)
    t.rollback()
    assert t.version() is None
    t.stage(df)
    t.commit()
    t.stage(N.update(t.read(), {"v": "z"}, F.col("k") == 2, "k"))
    t.commit()
    t.reorganise()
    assert rows(t.read().orderBy("k")) == [(1, "a"), (2, "z")]


def test_schedules(spark):
    h = spark.createDataFrame([(1, "r", "S", 1), (2, "r", "S", 2), (2, "r", "X", 3), (3, "r", "S", 4), (1, "q", "X", 5), (3, "q", "X", 6)], "xact int, resource string, mode string, ts int")
    assert N.serial_order(N.precedence(h)) == [1, 2, 3]
    cyclic = h.union(spark.createDataFrame([(1, "r", "X", 9)], h.schema))
    assert N.serial_order(N.precedence(cyclic)) is None
    locks = N.LockTable()
    assert locks.acquire(1, "a", "S") and locks.acquire(2, "a", "S") and locks.acquire(1, "b", "X") and not locks.acquire(2, "b", "S")
    with pytest.raises(RuntimeError):
        locks.acquire(1, "a", "X")
    locks.release(2)
    assert locks.acquire(1, "a", "X")


@pytest.mark.parametrize("tile", [2, 8192])
def test_precedence_makes_each_pair_once_and_shuffles_none(spark, monkeypatch, tile):
    monkeypatch.setattr(N, "TILE", tile)
    rng = random.Random(5)
    h = [(rng.choice([*range(60), None]), rng.choice(["a", "b", "c", "d", None]), rng.choice("SSSXU") if rng.random() < 0.95 else None, rng.choice([*range(70), None])) for _ in range(260)]
    df = spark.createDataFrame(h, "xact long, resource string, mode string, ts int")
    df.createOrReplaceTempView("h")
    want = rows(spark.sql("SELECT DISTINCT a.xact, b.xact FROM h a JOIN h b ON a.resource = b.resource AND a.xact <> b.xact AND a.ts < b.ts AND NOT (a.mode = 'S' AND b.mode = 'S')"))
    found = N.precedence(df)
    assert sorted(rows(found)) == sorted(want) and len(want) > 500
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert N.precedence(df.limit(0)).count() == 0


def test_serializable_of_any_history(spark, monkeypatch):
    rng = random.Random(11)
    kinds = "xact long, resource string, mode string, ts int"
    seen = set()
    for n in range(4):
        if n % 2:  # transactions one after another on shared resources
            h = [(x, rng.choice("abc"), rng.choice("SX"), 3 * x + k) for x in range(12) for k in range(2)]
        else:
            h = [(rng.randrange(5), rng.choice("abcd"), rng.choice("SSX"), rng.randrange(30)) for _ in range(24)]
        df = spark.createDataFrame(h, kinds)
        want = N.serial_order(N.precedence(df)) is not None
        for most in (0, 1 << 21):
            monkeypatch.setattr(N, "LOCAL_EDGES", most)
            assert N.serializable(df) is want
        seen.add(want)
    # a cycle of three without one of two, and a read and write of one transaction, which is none
    ring = [(1, "a", "X", 1), (2, "a", "X", 2), (2, "b", "X", 3), (3, "b", "X", 4), (3, "c", "X", 5), (1, "c", "X", 6)]
    own = [(1, "a", "S", 1), (1, "a", "X", 2), (1, "a", "S", 3)]
    for most in (0, 1 << 21):
        monkeypatch.setattr(N, "LOCAL_EDGES", most)
        assert not N.serializable(spark.createDataFrame(ring, kinds)) and N.serializable(spark.createDataFrame(own, kinds))
        assert N.serializable(spark.createDataFrame([], kinds))
    assert seen == {True, False}


def test_serializable_collects_no_precedences_of_all_pairs(spark, monkeypatch):
    # 300 readers of one resource before 300 writers of it: 90 000 precedences by readers, 300 and 300 direct ones
    h = spark.range(600).select(F.col("id").alias("xact"), F.lit("r").alias("resource"), F.when(F.col("id") < 300, "S").otherwise("X").alias("mode"), F.col("id").alias("ts"))
    sizes = []
    monkeypatch.setattr(N, "_cyclic", lambda edges, run=N._cyclic: sizes.append(edges.num_rows) or run(edges))
    assert N.serializable(h) and sizes == [599]


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('sku,nombre,descripcion,precio\n1,Laptop,"con ""comillas"", y coma",10.5\n2,,,3\n3,Ñandú,' + "ñ" * 3000 + ",7\n", encoding="utf-8")
    df = I.read_csv(spark, str(tmp_path / "x.csv"), ["nombre", "descripcion"], "sku", ["precio"])
    assert [r.id for r in df.collect()] == [1, 3] and df.first().contenido == 'Laptop con "comillas", y coma'
    out, columns, clipped = I.prepare(df, ["precio"])
    assert columns[2] == ("precio", "double", 8) and clipped == 1
    assert max(len(r.contenido.encode()) for r in out.collect()) <= columns[1][2]
    assert [r.id for r in I.read_csv(spark, str(tmp_path / "x.csv"), ["nombre"]).collect()] == [1, 2]
    assert I.column_name(" 2 Año! ") == "c_2_a_o" and I.column_name("id") == "id_" and I.ui_type(df, "precio") == ("float", 4)


@pytest.mark.parametrize(("text", "size"), [("añb", 2), ("añb", 3), ("🙂🙂", 5), ("🙂", 3), ("abc", 9), ("日本語", 7), ("", 4)])
def test_utf8_clip(spark, text, size):
    got = spark.createDataFrame([(text,)], "t string").select(I.utf8_clip(F.col("t"), size)).first()[0]
    assert got == text.encode()[:size].decode(errors="ignore")


def test_utf8_clip_query_equals_its_sql_on_odd_texts(spark, tmp_path):
    texts = [(1, "日本語" * 20), (2, "é" * 40), (3, "é" * 15), (4, "plain text of more than thirty bytes"), (5, None), (6, ""), (7, "日本語" * 3), (8, "twice b"), (8, "twice a"), (None, "no id"), (9, "🙂" * 7 + "abc")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(path)
    want = duckdb.sql(registry.ORACLES["utf8_clip"].replace("FROM documents", f"FROM read_parquet('{path}/*.parquet')")).fetchall()
    got = rows(registry.QUERIES["utf8_clip"](spark, str(tmp_path)).select("doc_id", "head"))
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) == 6


def test_utf8_clip_query_has_a_head_of_every_document(spark, tmp_path):
    texts = dict(enumerate(["日本語" * 20, "é" * 40, "Çéé " * 9, "🙂" * 7 + "abc", "a" + "é" * 40, "日本語" * 3, "plain text of more than thirty bytes", "", None]))
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(path)
    want = {i: None if t is None else t.encode()[:30].decode(errors="ignore") for i, t in texts.items()}
    got = rows(registry.QUERIES["utf8_clip"](spark, str(tmp_path)).select("doc_id", "head"))
    sql = duckdb.sql(registry.ORACLES["utf8_clip"].replace("FROM documents", f"FROM read_parquet('{path}/*.parquet')")).fetchall()
    assert dict(got) == dict(sql) == want and len(got) == len(sql) == len(texts)


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 2.0), ("2024-01-01 03:00:00", "b", 3.0)], "ts string, k string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = W.read_stream(spark, str(tmp_path / "in"), df.schema)
    W.to_memory(W.tumbling(stream, "ts", ["k"], "1 hour"), "tumbled")
    assert spark.table("tumbled").count() >= 1
    W.to_memory(W.running_totals(stream, "k"), "totals", "update")
    assert {(r.k, r.total) for r in spark.table("totals").collect()} == {("a", 3.0), ("b", 3.0)}
    W.to_memory(W.sessions(stream, "ts", "k", "30 minutes"), "sess")
    batches = []
    W.upsert(stream, lambda d, n: batches.append((n, d.count())), str(tmp_path / "cp"))
    assert sum(n for _, n in batches) == 3


def test_json_and_media(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{broken\n{"a": 2}\n')
    assert sorted(r.a for r in I.read_json_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    assert I.read_media(spark, str(tmp_path), "*.jsonl").count() == 1
    I.write(spark.range(3), str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM t WHERE n = 'x'", "SELECT * FROM t WHERE s > 3", "SELECT * FROM t WHERE n LIKE 'a%'", "SELECT * FROM t WHERE n BETWEEN 1 AND 'b'", "SELECT * FROM t WHERE s IN ('a', 2)",
        "SELECT * FROM t WHERE at = 3", "SELECT * FROM t WHERE n IN (SELECT s FROM t)", "SELECT * FROM t WHERE n = s", "SELECT * FROM t JOIN u ON t.s = u.n", "UPDATE t SET s = 4", "UPDATE t SET n = 'four'",
        "UPDATE t SET s = 'much too long'", "INSERT INTO v VALUES ('x', 'y')",
    ],
)
def test_types_are_checked(spark, text):
    s = Session(spark)
    s.execute("CREATE TABLE v (id INT PRIMARY KEY, s VARCHAR(5))")
    s.register("t", spark.createDataFrame([(1, "a", {"lat": 1.0, "lon": 2.0})], "n int, s string, at struct<lat:double,lon:double>"), "n")
    s.register("u", spark.createDataFrame([(1, "a")], "n int, s string"), "n")
    with pytest.raises(SqlError):
        s.execute(text.replace("UPDATE t SET s = 'much too long'", "UPDATE v SET s = 'much too long'"))


def test_matching_types_pass(spark):
    s = Session(spark)
    s.register("t", spark.createDataFrame([(1, "a", 2.5), (2, "b", 0.5)], "n int, s string, x double"), "n")
    assert s.execute("SELECT n FROM t WHERE n < x AND s IN ('a', 'b') AND x BETWEEN 1 AND 3").collect()[0][0] == 1
    assert s.execute("SELECT n FROM t WHERE s LIKE 'b%' AND n >= 1.5").count() == 1


def test_two_writers_conflict(spark, tmp_path):
    path = str(tmp_path / "table")
    a, b = SnapshotTable(spark, path, "k"), SnapshotTable(spark, path, "k")
    a.stage(spark.range(3).toDF("k"))
    a.commit()
    a.stage(spark.range(4).toDF("k"))
    b.stage(spark.range(5).toDF("k"))
    b.commit()
    with pytest.raises(WriteConflict):
        a.commit()
    assert a.read().count() == 5
    (tmp_path / "table" / "_log" / "99999999999999999999").mkdir()  # a pointer that is still being written
    assert b.read().count() == 5
