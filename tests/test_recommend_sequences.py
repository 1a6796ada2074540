import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenquery.operators import recommend as C, sequences as Q


@pytest.fixture(scope="module")
def bought(spark):
    return spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (2, 3), (3, 2), (3, 3), (3, 4)], "u int, i int")


def test_affinity(bought):
    counts, pairs = C.buyers(bought, "u", "i"), C.supports(bought, "u", "i")
    assert {r.i: r.buyers for r in counts.collect()} == {1: 2, 2: 2, 3: 2, 4: 1}
    score = {(r.a, r.b): round(r.score, 6) for r in C.scored_pairs(pairs, counts, "i").collect()}
    assert score == {(1, 2): 0.045455, (1, 3): 0.045455, (2, 3): 0.045455, (2, 4): 0.064282, (3, 4): 0.064282}
    near = C.neighbours(C.scored_pairs(pairs, counts, "i"), 1).where("source = 2").first()
    assert near.target == 4


def test_purchase_equals_recount(spark, bought):
    counts, pairs = C.add_purchase(C.buyers(bought, "u", "i"), C.supports(bought, "u", "i"), bought, 1, [2, 3, 3], "u", "i")
    after = bought.union(spark.createDataFrame([(1, 3)], "u int, i int"))
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(counts) == as_set(C.buyers(after, "u", "i")) and as_set(pairs) == as_set(C.supports(after, "u", "i"))


def signals(spark, **lists):
    return spark.createDataFrame([(s, i, float(v)) for s, rows in lists.items() for i, v in rows.items()], "signal string, id int, score double")


def test_fusion(spark):
    out = {r.id: r for r in C.fuse(signals(spark, visual={1: 0.9, 2: 0.8}, text={2: 100, 1: 50}), {"visual": 3, "text": 1, "none": 5}).collect()}
    assert abs(out[1].total - 0.75) < 1e-12 and abs(out[2].total - 0.25) < 1e-12 and out[1].pct_visual == 100 and out[2].place_text == 1
    one = C.fuse(signals(spark, bought={7: 0.072}), {"bought": 1}, {"bought": 0.3}).first()
    assert abs(one.total - 0.24) < 1e-12
    out = C.combine(signals(spark, nombre={1: 8, 3: 2}, contenido={2: 9, 1: 6, 3: 1}), {"nombre": 0.5, "contenido": 0.5}).collect()
    assert [r.id for r in out] == [1, 2, 3] and abs(out[0].total - 0.8125) < 1e-12
    with pytest.raises(ValueError):
        C.fuse(signals(spark, a={1: 1}), {"a": -1})


def test_gower(spark):
    s = lambda *v: [F.lit(x) for x in v]
    g = lambda a, b, r=math.log(100): C.gower(*[x for pair in zip(s(*a), s(*b), strict=True) for x in pair], r)
    row = spark.range(1).select(g(("Earbuds", "Sony", 1000), ("Earbuds", "sony", 1000)), g(("Earbuds", "Sony", 1000), ("Headphones", "JBL", 10000)), g(("Earbuds", "", 1000), ("Earbuds", "JBL", 1000))).first()
    assert np.allclose(row, [1, 0.5 / 3, 1])


def test_curation(spark):
    assert C.quotas({"a": 100, "b": 5, "c": 30}, 40) == {"a": 17, "b": 5, "c": 17} and C.quotas({}, 3) == {}
    df = spark.createDataFrame([(1, "g", "s1", "One!", 5), (2, "g", "s1", "one", 9), (3, "g", "s2", "Two", 1), (4, "g", "s1", "Three", 2)], "k int, g string, s string, t string, n int")
    assert [r.k for r in C.curated(df, "g", "s", "t", "n", "k", 3).orderBy("place").collect()] == [2, 3, 4]
    paths = spark.createDataFrame([(["a", "b", "c"],), (["a", "x"],), (["z"],)], "p array<string>")
    assert [r.t for r in C.longest_prefix(paths, "p", {("a",): "A", ("a", "b"): "AB"}, "t").collect()] == ["AB", "A"]


HITS = "track string, query_s double, original_s double, similarity double"


def test_alignment(spark):
    line = [("A", t / 2, 12 + 1.05 * t / 2, 0.9) for t in range(8)]
    again = [("A", 0.0, 12.1, 0.5)]  # an instant votes once, by its most similar hit
    alone = [("B", 1.0, 1.0, 1.0), ("C", 0.0, 5.0, 1.0), ("C", 0.0, 5.1, 1.0)]
    apart = [("D", float(t), 100.0 * t, 0.9) for t in range(6)]
    dull = [("E", float(t), float(t), 0.1) for t in range(6)]
    df = spark.createDataFrame(line + again + alone + apart + dull, HITS)
    rows = Q.alignment_votes(df, ["track"], 0.05, threshold=0.3).collect()
    assert [(r.track, r.votes, r.speed) for r in rows] == [("A", 8, 1.05)]
    assert abs(rows[0].offset - 12) < 1e-6 and rows[0].instants == [t / 2 for t in range(8)]
    assert Q.alignment_votes(df.limit(0), ["track"]).count() == 0


def plain_alignment(rows, tolerance, speeds=Q.SPEEDS):
    best = None
    for v in speeds:
        for _, q0, o0, _ in rows:
            low, voters = o0 - v * q0, {}
            for _, q, o, s in rows:
                if low <= o - v * q <= low + 2 * tolerance:
                    voters[q] = min(voters.get(q, (9, 9)), (-s, o - v * q))
            if len(voters) >= 2 and max(voters) - min(voters) >= 1:
                mean = round(-sum(s for s, _ in voters.values()) / len(voters), 9)
                best = max(best or (0,), (len(voters), mean, round(-abs(1 - v), 9), -v, -low, float(np.median([o for _, o in voters.values()]))))
    return best


def test_alignment_equals_plain_model(spark):
    rng = random.Random(4)
    rows = [(rng.choice("XYZ"), float(rng.randrange(12)), rng.randrange(60) / 4, rng.randrange(1, 9) / 8) for _ in range(160)]
    got = {r.track: r for r in Q.alignment_votes(spark.createDataFrame(rows, HITS), ["track"], 0.5).collect()}
    for track in "XYZ":
        want, r = plain_alignment([x for x in rows if x[0] == track], 0.5), got[track]
        assert (r.votes, r.similarity, r.speed) == (want[0], want[1], -want[3]) and abs(r.offset - want[5]) < 1e-9


def test_merge_events(spark):
    kinds = "t string, start_s double, end_s double, speed double, offset double, similarity double, instants array<double>"
    rows = [
        ("A", 0.0, 4.0, 1.0, 10.0, 0.8, [0.0, 1.0, 2.0, 3.0]), ("A", 4.3, 10.0, 1.05, 10.1, 0.6, [3.0, 4.0, 5.0, 6.0, 7.0]),
        ("A", 10.0, 12.0, 1.0, 50.0, 0.5, [10.0, 11.0]), ("A", 10.2, 11.0, 1.0, 10.0, 0.1, [3.0]), ("B", 1.0, 2.0, 1.0, 0.0, 0.5, [1.0, 2.0]),
    ]
    out = Q.merge_events(spark.createDataFrame(rows, kinds), "t").orderBy("t", "start_s").collect()
    # instant 3 is shared, so four of the second event's five instants are new, and none of the fourth's
    assert [(r.t, r.start_s, r.end_s, round(r.similarity, 3), r.votes) for r in out] == [("A", 0, 11, 0.7, 8), ("A", 10, 12, 0.5, 2), ("B", 1, 2, 0.5, 2)]


def test_free_spans(spark):
    whole = spark.createDataFrame([("a", 0.0, 10.0), ("b", 0.0, 5.0)], "k string, start_s double, end_s double")
    covered = spark.createDataFrame([("a", -1.0, 2.0), ("a", 1.0, 3.0), ("a", 6.0, 7.0), ("a", 9.0, 20.0), ("a", 6.2, 6.4)], "k string, start_s double, end_s double")
    assert sorted(tuple(r) for r in Q.free_spans(whole, covered, "k").collect()) == [("a", 3.0, 6.0), ("a", 7.0, 9.0), ("b", 0.0, 5.0)]


def test_keep_stronger(spark):
    kinds = "t string, start_s double, end_s double, pct double"
    a = spark.createDataFrame([("x", 0.0, 5.0, 50.0), ("y", 0.0, 5.0, 90.0)], kinds)
    b = spark.createDataFrame([("x", 4.0, 9.0, 70.0), ("y", 1.0, 2.0, 90.0), ("x", 20.0, 30.0, 1.0)], kinds)
    assert sorted((r.t, r.start_s) for r in Q.keep_stronger(a, b, "t", "pct").collect()) == [("x", 4.0), ("x", 20.0), ("y", 0.0)]


def test_phrase_votes(spark):
    rows = [("q", f"p{i}", 4, "A", i * 5.0, i * 5.0 + 4, 100 + i * 5.0, 10.0) for i in range(3)] + [("q", "p0", 4, "B", 0.0, 4.0, 7.0, 5.0), ("r", "p", 4, "A", 0.0, 4.0, 0.0, 3.0)]
    out = {r.query: r for r in Q.phrase_votes(spark.createDataFrame(rows, "query string, phrase string, words int, track string, q_start double, q_end double, o_start double, score double")).collect()}
    assert out["q"].track == "A" and out["q"].accepted and out["q"].votes == 3.0 and not out["r"].accepted


def test_phrase_votes_of_all_conversations(spark, tmp_path):
    from lumenquery.plans.q_recommend import phrase_votes

    rng = random.Random(3)
    words = [f"word{x}" for x in "abcdefghijklmnop"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(8, 20)))) for i in range(6)]
    turns = [(c, t, "assistant" if t % 2 else "user", " ".join(rng.sample(words, 5))) for c in range(9) for t in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    bags = {i: Counter(t.split()) for i, t in docs}
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    idf = {w: math.log((len(bags) - n + 0.5) / (n + 0.5) + 1) for w, n in df.items()}
    ranked = defaultdict(list)
    for c, _, role, text in turns:
        scores = {i: sum(idf[w] * b[w] * 2.5 / (b[w] + 1.5 * (0.25 + 0.75 * sum(b.values()) / mean)) for w in text.split() if w in b) for i, b in bags.items()}
        if role == "user":
            ranked[c].append(sorted(((s, i) for i, s in scores.items() if s > 0), key=lambda x: (-x[0], x[1]))[:5])
    want = {}
    for c, phrases in ranked.items():
        votes = Counter()
        for p in phrases:
            for s, i in p:
                votes[i] += s / max(q[0][0] for q in phrases if q)
        want[str(c)] = max(votes.items(), key=lambda x: (x[1], -x[0]))
    got = {r["query"]: (r.track, r.votes) for r in phrase_votes(spark, str(tmp_path)).collect()}
    assert {q: t for q, (t, _) in got.items()} == {q: t for q, (t, _) in want.items()} and len(got) == 9
    assert all(abs(got[q][1] - v) < 1e-9 for q, (_, v) in want.items())


def test_warping():
    rng = np.random.default_rng(0)
    ref = np.abs(rng.normal(size=(60, 12)))
    ref /= np.linalg.norm(ref, axis=1, keepdims=True)
    found = Q.align_chroma(np.roll(ref[20:40], 3, axis=1), ref)
    assert found["similarity"] > 0.99 and found["semitones"] == 3
    assert Q.melody_similarity(ref[10:30], ref) > 0.99
    assert Q.align_chroma(ref[:5], ref) is None
    q, r = rng.normal(size=(8, 5)), rng.normal(size=(40, 5))
    best = 0
    for i in range(33):
        w = r[i : i + 8]
        plain = (q * w).sum() / (np.linalg.norm(q) * np.linalg.norm(w))
        qc, wc = q - q.mean(0), w - w.mean(0)
        best = max(best, 0.5 * max(plain, 0) + 0.5 * max((qc * wc).sum() / (np.linalg.norm(qc) * np.linalg.norm(wc)), 0))
    assert abs(Q.sequence_score(q, r) - best) < 1e-9


def test_best_sequence_finds_place_and_speed(spark):
    rng = np.random.default_rng(2)
    ref = rng.normal(size=(120, 6)).cumsum(axis=0)
    at = 1.05 * np.arange(29, 66)  # on the grid that the reference is sampled at
    fast = ref[at.astype(int)] + (at - at.astype(int))[:, None] * (ref[at.astype(int) + 1] - ref[at.astype(int)])
    found = Q.best_sequence(fast, ref)
    assert found["speed"] == 1.05 and abs(found["place"] - 29 * 1.05) < 1e-9 and found["score"] > 0.99
    pair = lambda name, x: spark.createDataFrame([(1, "k", x.tolist())], f"{'query_id' if name == 'q' else 'ref_id'} long, key string, {name}_frames array<array<double>>")
    assert [r.speed for r in Q.sequence_matches(pair("q", fast), pair("r", ref), "key").collect()] == [1.05]
    assert Q.sequence_matches(pair("q", ref), pair("r", fast), "key").count() == 0


def test_tonal_events_and_melody(spark):
    rng = np.random.default_rng(5)
    tones = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(np.abs(rng.normal(size=(n, 12))))
    song, other, noise = tones(90), tones(90), tones(60)
    query = np.vstack([np.roll(song[20:60], 2, axis=1), noise[:20]])
    queries = spark.createDataFrame([(1, query.tolist())], "query_id long, q_frames array<array<double>>")
    refs = spark.createDataFrame([("song", song.tolist()), ("other", other.tolist())], "track string, r_frames array<array<double>>")
    hits = spark.createDataFrame([(1, t, float(s), 0.9) for t in ("song", "other") for s in range(3)] + [(1, "quiet", 0.0, 0.1)], "query_id long, track string, query_s double, similarity double")
    candidates = Q.tonal_candidates(hits, 0.5)
    assert sorted(r.track for r in candidates.collect()) == ["other", "song"]
    none = spark.createDataFrame([], "query_id long, track string, start_s double, end_s double")
    found = Q.tonal_events(queries, refs, candidates, none, hop=0.5).collect()
    assert {r.track for r in found} == {"song"} and all(r.similarity >= 0.85 and r.semitones == 2 for r in found) and min(r.start_s for r in found) == 0
    held = spark.createDataFrame([(1, "song", 0.0, 30.0)], none.schema)
    assert Q.tonal_events(queries, refs, candidates, held, hop=0.5).count() == 0
    pairs = queries.crossJoin(refs)
    best = Q.melody_matches(pairs.withColumn("q_frames", F.slice("q_frames", 1, 40))).first()
    assert best.track == "song" and best.accepted and best.similarity > 0.99


def test_gap_groups(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("a", 21.0), ("b", 5.0)], "k string, t double")
    assert sorted((r.k, r.t, r.g) for r in Q.gap_groups(df, ["k"], "t", 10, "g").collect()) == [("a", 0.0, 1), ("a", 10.0, 1), ("a", 21.0, 2), ("b", 5.0, 1)]


def test_hybrid_candidates(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, 4.0 - i]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in Q.hybrid_candidates(df, df.where("vec_id = 2"), 2).collect()} >= {2}


def test_densest_window(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0, 1.0), ("a", 5.0, 6.0, 2.0), ("a", 9.0, 12.0, 9.0), ("a", 11.0, 13.0, 1.0)], "k string, s double, e double, w double")
    row = Q.densest_window(df, "k", "s", "e", "w", 10.0).first()
    assert (row.start, row.total) == (5.0, 12.0)


def scores(spark, rows):
    return spark.createDataFrame([(i, float(x)) for i, x in rows.items()], "id int, score double")


def test_recommend(spark):
    """Against the formula: min-max a signal, text as the mean of words and meaning, equal weights, purchases by scale."""
    visual, words, meaning, meta, bought = {1: 1.0, 2: 0.9, 3: 0.1, 4: 0.5}, {2: 10, 3: 30}, {2: 0.5, 4: 0.25}, {2: 0.2, 3: 0.4, 4: 1.0}, {3: 0.5, 4: 0.05}
    got = {r.id: r for r in C.recommend(1, *[scores(spark, x) for x in (visual, words, meaning, meta, bought)], k=10, purchase_scale=0.25).collect()}
    unit = lambda rows: {i: 1.0 if max(rows.values()) == min(rows.values()) else (x - min(rows.values())) / (max(rows.values()) - min(rows.values())) for i, x in rows.items()}
    text = Counter()
    for half in (words, meaning):
        for i, x in unit(half).items():
            text[i] += x / 2
    parts = [unit({i: x for i, x in visual.items() if i != 1}), unit(text), unit(meta), {i: min(1, x / 0.25) for i, x in bought.items()}]
    want = {i: sum(p.get(i, 0) for p in parts) / 4 for i in (2, 3, 4)}
    assert got.keys() == want.keys() and all(abs(got[i].total - want[i]) < 1e-9 for i in want)
    assert [r.id for r in C.recommend(1, *[scores(spark, x) for x in (visual, words, meaning, meta, bought)], k=2, purchase_scale=0.25).collect()] == sorted(want, key=lambda i: -want[i])[:2]


def test_hybrid_search(spark):
    counts = spark.createDataFrame([(1, 100), (2, 3)], "i int, buyers long")
    out = C.hybrid_search(scores(spark, {1: 5, 2: 9}), scores(spark, {2: 0.5, 3: 0.9}), counts, "i", 3).collect()
    popular = {i: math.log1p(n) / math.log1p(100) for i, n in ((1, 100), (2, 3), (3, 0))}
    want = {1: 0.2 * popular[1], 2: 0.4 + 0.2 * popular[2], 3: 0.4}
    assert [r.id for r in out] == sorted(want, key=lambda i: -want[i]) and all(abs(r.total - want[r.id]) < 1e-9 for r in out)


def test_index_maintenance(spark, tmp_path):
    from lumenquery.operators import vector_search as S

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    frame = lambda ids, v: spark.createDataFrame([(int(i), [float(y) for y in v[i]]) for i in ids], "vec_id long, embedding array<double>")
    index = S.Ivf(frame(range(150), x), cells=8)
    nearest = lambda ix, q, n=8: [r.vec_id for r in ix.search(q.tolist(), 5, n, "euclidean").collect()]
    exact = lambda ids, q: sorted(ids, key=lambda i: (np.linalg.norm(x[i] - q), i))[:5]
    grown = index.insert(frame(range(150, 200), x))
    assert nearest(grown, x[170]) == exact(range(200), x[170])
    with pytest.raises(ValueError):
        grown.insert(frame([3], x))
    less = grown.delete(spark.createDataFrame([(170,), (999,)], "vec_id long"))
    assert nearest(less, x[170]) == exact([i for i in range(200) if i != 170], x[170])
    moved = x.copy()
    moved[5] = x[170] + 0.001
    now = frame([*range(100), *range(160, 200)], moved)
    x = moved
    assert nearest(less.synchronised(now), moved[170]) == exact([*range(100), *range(160, 200)], moved[170])
    grown.write(str(tmp_path / "ix"))
    again = S.Ivf.read(spark, str(tmp_path / "ix"))
    assert nearest(again, moved[20], 3) == nearest(grown, moved[20], 3)
