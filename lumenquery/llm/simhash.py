"""SimHash near duplicates with Golay-code keys.

Two entry points. `simhash_classes` links documents whose 64-bit fingerprints differ in at most two
bits, exactly. `near_duplicates` links documents whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more: wide fingerprints and Golay codewords propose pairs, the sets decide.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenquery.llm import golay
from lumenquery.llm.frames import map_batches
from lumenquery.operators.components import connected_components
from lumenquery.session import Scratch, cut, released_shuffles

SEED = 42
_BLOCK = 1 << 15  # shingles whose bits are counted at once


def shingle_hashes(text: str | None, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle in order, repeats included; fewer words give one shingle, none give none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, seed)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], seed) for a, b in spans), dtype=np.uint64, count=len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes, unsigned."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _BLOCK):
        part = hashes[i : i + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _signed(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _fingerprints(width: int):
    def run(batches):
        for b in batches:
            marks = [majority(shingle_hashes(t, width)) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(_signed(marks))], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the 64-bit fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), _fingerprints(width), f"id {kind}, fp long")


def _pair_keys(batches):
    """Keys of two bits' tolerance: of three segments one is exact, the next within two bits."""
    for b in batches:
        fp = np.asarray(b.column(0)).view(np.uint64)
        parts = [(fp & np.uint64(0x7FFFFF)).astype(np.int64), (fp >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64), (fp >> np.uint64(46)).astype(np.int64)]
        keys, marks = [], []
        for n, (same, near) in enumerate(((0, 1), (1, 2), (2, 0))):
            row, key = golay.keys(parts[near])
            keys.append((n << 36) | (parts[same][row] << 12) | key)
            marks.append(fp.view(np.int64)[row])
        yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(marks))], names=["key", "fp"])


def _ball(fp):
    """A fingerprint and its 64 one-bit neighbours."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)])


def fingerprint_links(distinct: DataFrame, crowd: int = 16) -> DataFrame:
    """(a, b) pairs of distinct fingerprints, enough to connect all that differ in at most two bits.

    Every pair within two bits shares a Golay key. Keys with up to `crowd` fingerprints are joined
    and verified pair by pair. Fingerprints of larger keys take the exact way of their one-bit balls:
    words within two bits share a ball member, and all words of one ball are within two bits of each
    other, so linking each to the least of them loses no connection and makes 65 rows a word.
    """
    keyed = map_batches(distinct.select("fp"), _pair_keys, "key long, fp long")
    sizes = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    twos = sizes.where("n = 2").select("a", "b")
    few = keyed.join(sizes.where((F.col("n") > 2) & (F.col("n") <= crowd)).select("key"), "key")
    many = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b").select("a", "b")
    crowded = keyed.join(sizes.where(F.col("n") > crowd).select("key"), "key", "left_semi").select("fp").distinct()
    balls = crowded.select("fp", F.explode(_ball(F.col("fp"))).alias("centre"))
    least = balls.groupBy("centre").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = balls.join(least, "centre").where("fp <> a").select("a", F.col("fp").alias("b"))
    return twos.unionByName(many).unionByName(stars).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct()


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the least id reachable).

    Equal fingerprints form one class before anything is joined, so copies are never paired. Null and
    empty texts have fingerprint zero and are linked like any other; repeated rows stay repeated; an
    empty table gives no rows; other columns are ignored.
    """
    marks = cut(fingerprints(docs, id_col, text_col, width))
    classes = marks.groupBy("fp").agg(F.min("id").alias("rep"))
    links = fingerprint_links(classes.select("fp"))
    left, right = classes.select(F.col("fp").alias("a"), F.col("rep").alias("src")), classes.select(F.col("fp").alias("b"), F.col("rep").alias("dst"))
    edges = links.join(left, "a").join(right, "b").select("src", "dst")
    roots = connected_components(edges)
    named = classes.join(roots, classes.rep == roots.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = marks.join(named, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near duplicates by shingle sets

SEGMENTS = 41  # 23-bit segments of the words' fingerprint
STEPS = (1, 5)  # a key holds the codewords of two segments this many places apart
WORDS = 15  # 64-bit parts of the words' fingerprint
GRAM_WORDS = 4  # and of the shingles'
# Bits of 256 by which two texts of a shared key may differ to be compared in the first pass: a
# similarity of 0.8 of the shingles is a cosine of 0.89, of which 39 bits differ with a deviation of
# 6. Only the cost depends on it and on HUBS, since a complete pass follows.
FAR = 64
HUBS = 6  # central members that a text is compared with in the first pass
# Texts whose shingles are counted to put common ones last: a 64th, or this many if that is more.
# Only the cost depends on it.
SAMPLE = 20_000
COMMON = 1 << 18  # most frequent shingles of them that are told to all tasks
EARLIER = 4  # shingles before a shared one by which repeated meetings of two texts are told; only the cost depends on it
LOOKUP = 500_000  # texts up to this many are looked up by a broadcast of their hashes (8 bytes each)


def _spread(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th further hash of hashes, by one multiply-and-shift round."""
    if not n:
        return h
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
    return h ^ (h >> np.uint64(32))


def wide_fingerprint(text: str | None, width: int = 1, parts: int = WORDS) -> np.ndarray:
    """Bits (64 a part) that are set in over half of the distinct shingles, by default lower-case words."""
    h = np.unique(shingle_hashes(text, width))
    ones = np.zeros(64 * parts, dtype=np.int64)
    for at in range(0, len(h), _BLOCK // parts):
        part = h[at : at + _BLOCK // parts]
        mixed = np.stack([_spread(part, n) for n in range(parts)], axis=1)
        ones += np.unpackbits(mixed.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones * 2 > len(h) if len(h) else ones > 0


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct 32-bit shingle hashes."""
    return np.unique(shingle_hashes(text, width).astype(np.uint32)).view(np.int32)


_MARKS = [f"e{i}" for i in range(GRAM_WORDS)] + [f"g{i}" for i in range(-(-SEGMENTS // 5))]


def _signatures(width: int):
    """Fingerprints of the shingles, and the codewords nearest to the segments of the words', five to a long."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lines = b.column(3).to_pylist()
            bits = np.array([wide_fingerprint(t)[: 23 * SEGMENTS] for t in lines])
            codes = golay.nearest(bits.reshape(-1, 23) @ (1 << np.arange(23))).reshape(-1, SEGMENTS).astype(np.int64)
            packs = [(codes[:, at : at + 5] << (12 * np.arange(min(5, SEGMENTS - at)))).sum(axis=1) for at in range(0, SEGMENTS, 5)]
            grams = np.packbits([wide_fingerprint(t, width, GRAM_WORDS) for t in lines], axis=1, bitorder="little").view("<i8")
            cols = [np.ascontiguousarray(grams[:, i]) for i in range(GRAM_WORDS)] + packs
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), *map(pa.array, cols)], names=["id", "h1", "h2", *_MARKS])

    return run


def _sets(width: int):
    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([shingle_set(t, width) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["node", "grams"])

    return run


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two hashes of a text; all texts without words have the same."""
    bare = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return F.when(bare, F.lit(0).cast("long")).otherwise(F.xxhash64(text)), F.when(bare, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(1), text))


def _key_rows(classes: DataFrame) -> DataFrame:
    """(key, node): one key for each chosen pair of segments, both codewords in it."""
    code = [F.shiftright(F.col(f"g{i // 5}"), 12 * (i % 5)).bitwiseAND(F.lit(0xFFF)) for i in range(SEGMENTS)]
    chosen = [(i, (i + d) % SEGMENTS) for d in STEPS for i in range(SEGMENTS)]
    pairs = [F.lit(n << 24).cast("long") + F.shiftleft(code[i], 12) + code[j] for n, (i, j) in enumerate(chosen)]
    return classes.select(F.explode(F.array(*pairs)).alias("key"), "node")


def _near(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (a, b) whose shingle fingerprints are not too far apart."""
    side = lambda x: marks.select(F.col("node").alias(x), *[F.col(f"e{i}").alias(f"{x}{i}") for i in range(GRAM_WORDS)])
    far = sum(F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(GRAM_WORDS))
    return pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(far <= FAR).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(src, dst) of the pairs whose shingle sets have the similarity."""
    pairs = scratch.store(pairs)
    needed = scratch.store(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    asked = F.broadcast(needed) if needed.count() <= LOOKUP else needed
    sets = scratch.store(map_batches(texts.join(asked, "node", "left_semi").dropDuplicates(["node"]).select("node", "text"), _sets(width), "node long, grams array<int>"))
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b").join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    same = F.size(F.array_intersect("ga", "gb"))
    out = scratch.store(both.where(same >= similarity * (F.size("ga") + F.size("gb") - same)).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    scratch.free(pairs, needed, sets)
    return out


def _prefixes(width: int, similarity: float, common: np.ndarray, counts: np.ndarray):
    """The shingles of a text that a partner of the similarity must meet one of, rare ones first."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sizes, heads = [], []
            for t in b.column(1).to_pylist():
                h = np.unique(shingle_hashes(t, width))
                weight = np.zeros(len(h), dtype=np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    weight = np.where(common[at] == h, counts[at], 0)
                sizes.append(len(h))
                heads.append(h[np.lexsort((h, weight))][: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1].view(np.int64))
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int32()), pa.array(heads, pa.list_(pa.int64()))], names=["node", "size", "head"])

    return run


def _shingles(width: int):
    def run(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.record_batch([pa.array(np.unique(shingle_hashes(t, width)).view(np.int64))], names=["h"])

    return run


def _common_shingles(texts: DataFrame, roots: DataFrame, total: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles met twice or more in a sample of the texts (copies counted once), sorted, and their counts."""
    picked = texts.where(F.pmod(F.xxhash64("node"), F.lit(max(1, min(64, total // SAMPLE)))) == 0).dropDuplicates(["node"])
    picked = picked.join(roots.where("node <> component").select("node"), "node", "left_anti").select("text")
    found = map_batches(picked, _shingles(width), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    with released_shuffles(texts.sparkSession):
        rows = found.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h = np.asarray(rows.column("h")).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.asarray(rows.column("n"))[order]


def prefix_pairs(texts: DataFrame, roots: DataFrame, total: int, width: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b): every pair of (node, text) rows that may have the similarity, but those of one component.

    A complete filter: in any one order of all shingles, two sets of Jaccard similarity t share one
    among the first |x| - ceil(2t / (1 + t) |x|) + 1 of the smaller and the first |y| - ceil(t |y|) + 1
    of the larger, and what follows the first shared one bounds the overlap. The order puts shingles
    that are common in a sample last, so that form letters meet by what sets them apart. Shingles that
    only one component has are dropped before anything is joined. Two texts that share one of the
    last EARLIER shingles before the one they meet by have met before, where both bounds hold too.
    """
    common, counts = _common_shingles(texts, roots, total, width)
    heads = map_batches(texts, _prefixes(width, similarity, common, counts), "node long, size int, head array<long>").dropDuplicates(["node"])
    heads = scratch.store(heads.join(roots, "node", "left").select("node", "size", "head", F.coalesce("component", "node").alias("c")))
    shared = heads.select("c", F.explode("head").alias("key")).groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    shared = scratch.store(shared)
    posted = heads.select("node", "size", "c", F.posexplode("head").alias("place", "key"))
    met_by = posted.join(F.broadcast(shared) if shared.count() <= LOOKUP else shared, "key")
    before = F.collect_list("key").over(Window.partitionBy("node").orderBy("place").rowsBetween(-EARLIER, -1))
    mixed = scratch.store(met_by.withColumn("before", before))
    x, y = (mixed.select("key", *[F.col(k).alias(f"{k}_{side}") for k in ("node", "size", "place", "c", "before")]) for side in "xy")
    x = x.where(F.col("place_x") <= F.col("size_x") - F.ceil(2 * similarity / (1 + similarity) * F.col("size_x") - 1e-9))
    ordered = (F.col("size_x") < F.col("size_y")) | ((F.col("size_x") == F.col("size_y")) & (F.col("node_x") < F.col("node_y")))
    long_enough = F.col("size_x") >= similarity * F.col("size_y") - 1e-6
    enough = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y")) >= similarity / (1 + similarity) * (F.col("size_x") + F.col("size_y")) - 1e-6
    fresh = ~F.arrays_overlap("before_x", "before_y")
    met = x.join(y, (x["key"] == y["key"]) & (F.col("c_x") != F.col("c_y")) & ordered & long_enough & enough & fresh)
    out = scratch.store(met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct())
    scratch.free(heads, shared, mixed)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per distinct (id, text): id, h1, h2 (see text_keys), c1, c2 (its component), copies (rows).

    Components join texts whose sets of `width`-word shingles have the Jaccard similarity; equal
    texts, and all texts without words, are one class before anything is joined. Two passes propose
    pairs and the sets decide. First, texts that share the Golay codewords of two segments of their
    wide fingerprints: every text is compared with the most central members of its keys, those that
    share most keys with most texts; in a group of copies they are the least changed, so nearly all
    that is linked to anything is linked to them. Then whatever is left in different components is
    compared wherever `prefix_pairs` allows the similarity at all, so no link is lost. Tables of
    intermediate rows are deleted as soon as they are used. Null ids and texts, repeated rows, empty
    tables and other columns of any name are allowed.
    """
    scratch = Scratch(docs.sparkSession)
    h1, h2 = text_keys(F.col(text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), h1.alias("h1"), h2.alias("h2"), F.col(text_col).alias("text"))
    marks = scratch.store(map_batches(slim, _signatures(width), f"id {kind}, h1 long, h2 long, " + ", ".join(f"{c} long" for c in _MARKS)))
    classes = scratch.store(marks.where("h1 <> 0 OR h2 <> 0").groupBy(F.col("h1").alias("node"), "h2").agg(*[F.min(c).alias(c) for c in _MARKS]))
    texts = slim.select(F.col("h1").alias("node"), "text")
    # dealt by key once, for the counts and for the join with them
    keyed = _key_rows(classes).repartition("key")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("z")).where("n > 1 AND a <> z").select("key", "n")
    members = scratch.store(keyed.join(shared, "key").select("key", "node", "n"))
    central = members.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = members.join(central, "node")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("hub"))
    offers = weighed.join(hubs, "key").where("node <> hub.node").select("node", F.col("hub.node").alias("x"), F.col("hub.weight").alias("w")).distinct()
    best = offers.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("w"), "x"))).where(F.col("nth") <= HUBS)
    tried = scratch.store(best.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct())
    scratch.free(members)
    first = _verified(_near(tried, classes), texts, width, similarity, scratch)
    roots = connected_components(first, scratch=scratch)
    pairs = prefix_pairs(texts.where("node <> 0"), roots, classes.count(), width, similarity, scratch)
    second = _verified(pairs, texts, width, similarity, scratch)
    final = connected_components(first.unionByName(second), scratch=scratch)
    rows = marks.groupBy("id", "h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
    joined = rows.join(final, rows.h1 == final.node, "left")
    out = joined.select("id", "h1", "h2", F.coalesce("component", "h1").alias("c1"), F.when(F.col("component").isNull(), F.col("h2")).otherwise(F.lit(0)).alias("c2"), "copies")
    kept = Scratch(docs.sparkSession).store(out)
    scratch.close()
    return kept


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near duplicates: the one of the least id.

    Columns stay as they are. A null id is less than all others. Rows equal in id and text are one
    document and one of them stays.
    """
    groups = near_duplicates(docs, id_col, text_col, width, similarity)
    place = F.struct(F.col("id").isNotNull().alias("known"), F.col("id"), F.col("h1"), F.col("h2"))
    kept = groups.groupBy("c1", "c2").agg(F.min(place).alias("p")).select(F.col("p.id").alias("id"), F.col("p.h1").alias("h1"), F.col("p.h2").alias("h2"))
    h1, h2 = text_keys(F.col(text_col))
    # the row is packed, so that columns of any name stay apart from these
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col(id_col).alias("id"), h1.alias("h1"), h2.alias("h2"))
    out = keyed.join(kept, (keyed.h1 == kept.h1) & (keyed.h2 == kept.h2) & keyed.id.eqNullSafe(kept.id), "left_semi")
    if groups.where("copies > 1").limit(1).count():
        out = out.dropDuplicates(["id", "h1", "h2"])
    return out.select("row.*")
