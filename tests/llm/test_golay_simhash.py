import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenquery.llm import golay, simhash


def test_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.int32)[::97]
    index = golay.nearest(words)
    assert index.min() >= 0 and index.max() < 4096
    counts = np.bincount(golay.nearest(np.arange(1 << 23, dtype=np.int32)), minlength=4096)
    assert (counts == 2048).all()


def test_words_within_two_bits_share_a_key():
    rng = random.Random(3)
    for _ in range(300):
        a = rng.getrandbits(23)
        b = a
        for bit in rng.sample(range(23), rng.randrange(3)):
            b ^= 1 << bit
        row, key = golay.keys(np.array([a, b]))
        assert set(key[row == 0]) & set(key[row == 1])
        assert len(set(key[row == 0])) in (1, 6)


def brute_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (text or "")) if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", None, "one", "one two", "A b C d É f", "x " * 50, "tab\tand\x0bline\nbreaks here now"])
def test_fingerprint(text):
    assert simhash.majority(simhash.shingle_hashes(text, 3)) == brute_fingerprint(text)


def components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 2:
            parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_links_connect_all_pairs_within_two_bits(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(400):  # chains and a crowd round one word
        x = rng.choice(fps[:3] + fps[-40:])
        for bit in rng.sample(range(64), rng.randrange(3)):
            x ^= 1 << bit
        fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), crowd=4).collect()
    place = {x: i for i, x in enumerate(signed)}
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 2 for r in links)
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in links:
        parent[find(place[r.a])] = find(place[r.b])
    want = components(fps)
    got = [find(i) for i in range(len(fps))]
    assert {frozenset(i for i in range(len(fps)) if want[i] == w) for w in want} == {frozenset(i for i in range(len(fps)) if got[i] == g) for g in got}


def test_classes_odd_rows(odd_docs, no_docs):
    out = simhash.simhash_classes(odd_docs).collect()
    assert len(out) == 8
    zero = [r for r in out if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} >= {2, 3, 5} and len({r.component_id for r in zero}) == 1 and zero[0].component_id == 2
    assert simhash.simhash_classes(no_docs).count() == 0


def test_deduplicate(spark, odd_docs, no_docs):
    base = [f"w{i}" for i in range(120)]
    near = [*base]
    near[50] = "changed"
    far = [*base[:60], *[f"z{i}" for i in range(60)]]
    rows = [(10, " ".join(base)), (11, " ".join(near)), (12, " ".join(far)), (13, " ".join(base)), (14, "a b"), (15, "A  b"), (16, ""), (17, None), (18, " ")]
    kept = sorted(r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [10, 12, 14, 16]
    out = simhash.deduplicate(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.where("doc_id = 1").count() == 1 and out.where("doc_id IS NULL").count() == 1
    assert out.where("text IS NULL OR trim(text) = '' OR doc_id = 5").count() == 1
    assert simhash.deduplicate(no_docs).count() == 0


def test_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"word{i}" for i in range(100)]
    rows = []
    for n in range(150):
        words = [*base]
        words[rng.randrange(100)] = f"new{n}"
        rows.append((n, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.deduplicate(docs).count() == 1
    assert simhash.near_duplicates(docs).agg(F.count_distinct("c1")).first()[0] == 1


def shingle_sets(texts, width=5):
    split = [t.split() for t in texts]
    return [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in split]


def brute_components(texts, similarity=0.8):
    sets, parent = shingle_sets(texts), list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same >= similarity * (len(sets[i]) + len(sets[j]) - same):
                parent[find(i)] = find(j)
    return {frozenset(i for i in range(len(texts)) if find(i) == r) for r in {find(i) for i in range(len(texts))}}


def found_components(spark, texts):
    groups = {}
    for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        groups.setdefault((r.c1, r.c2), set()).add(r.id)
    return {frozenset(g) for g in groups.values()}


def test_pairs_of_copies_in_a_family_of_form_letters(spark):
    rng = random.Random(7)
    base, texts = [f"form{i}" for i in range(200)], []
    for n in range(400):
        words = [*base]
        for k in range(5):
            words[20 + 30 * k] = f"field{n}x{k}"
        near = [*words]
        near[rng.randrange(200)] = f"edit{n}"
        texts += [" ".join(words), " ".join(near)]
    want = brute_components(texts)
    assert len(want) == 400
    assert found_components(spark, texts) == want


def test_cut_copies_at_the_similarity_and_above(spark):
    rng, texts = random.Random(11), []
    for n in range(90):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(104)]  # 100 shingles
        keep = (84, 89, 94)[n % 3]  # 80, 85 and 90 of them
        texts += [" ".join(words), " ".join(words[:keep] if n % 2 else words[-keep:])]
    want = brute_components(texts)
    assert len(want) == 90
    assert found_components(spark, texts) == want


def test_order_of_shingles_decides_nothing(spark, monkeypatch):
    rng, texts = random.Random(4), []
    form = [f"form{i}" for i in range(60)]
    for n in range(30):
        words = [*form, *(f"{rng.choice('abcd')}{rng.randrange(900)}" for _ in range(44))]
        keep = (84, 89, 94)[n % 3]
        texts += [" ".join(words), " ".join(words[:keep] if n % 2 else words[-keep:])]
    want = brute_components(texts)
    monkeypatch.setattr(simhash, "_near", lambda pairs, marks: pairs.limit(0).select("a", "b"))  # all is left to the complete pass
    every, n = np.unique(np.concatenate([np.unique(simhash.shingle_hashes(t, 5)) for t in texts]), return_counts=True)
    for order in ((every, n), (every[:0], n[:0]), (every, n.max() - n + 1)):
        monkeypatch.setattr(simhash, "_common_shingles", lambda *_, found=order: found)
        assert found_components(spark, texts) == want


def test_classes_equal_brute_force(spark):
    """Components over whole documents: copies, edited copies in chains, short and empty texts."""
    rng = random.Random(12)
    texts = []
    for _ in range(12):
        words = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(rng.randrange(1, 400))]
        for _ in range(12):
            texts.append(" ".join(words))
            words = [*words]
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
    texts += ["", None, "  ", "One", "one", texts[0], texts[0].upper()]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, texts[k]) for i, k in enumerate(order)], "doc_id long, text string")
    fps = [brute_fingerprint(texts[k]) for k in order]
    groups = {}
    for i, root in enumerate(components(fps)):
        groups.setdefault(root, []).append(i)
    least = {i: min(g) for g in groups.values() for i in g}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_classes(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", least[i]) for i in range(len(order))}
    assert len(groups) < len(order) - 20
