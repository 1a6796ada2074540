import hashlib
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from lumenquery.llm import matroska as M, sentencepieces as P


@given(st.lists(st.binary(min_size=0, max_size=700), min_size=1, max_size=20), st.sampled_from([M.XIPH, M.EBML_LACING]))
@settings(max_examples=60, deadline=None)
def test_lacing_round_trip(frames, lacing):
    body = M.lace(frames, lacing)
    assert [body[a : a + n] for a, n in M.unlace(body, 0, len(body), lacing)] == frames


@pytest.mark.parametrize("n", [1, 15, 16, 17, 511, 512, 513, 2000])
def test_store_and_parse(n):
    payload = bytes(i * 7 % 251 for i in range(n * M.FRAME))
    buf = M.store(payload)
    back, media = M.read_back(buf)
    assert back == payload and len(media.packets) == n
    step = M.FRAME * 1_000_000_000 // M.RATE
    assert [p.timestamp_ns for p in media.packets] == [i * step for i in range(n)]
    assert [c[2] for c in media.cues] == [next(a for a in range(at - 16, at) if buf[a : a + 4] == bytes.fromhex("1f43b675")) for at in media.clusters]
    assert media.tracks[1]["codec"] == "A_PCM/INT/LIT" and media.tracks[1]["bits"] == 8


def test_unknown_sizes_groups_and_errors():
    block = M.block(M.BLOCK, 2, 5, [b"abc", b"defg"], M.XIPH)
    group = M.element(M.BLOCK_GROUP, block + M._uint(M.REFERENCE_BLOCK, 1))
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\xff" + M._uint(M.TIMESTAMP, 100) + group
    segment = M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + M.element(M.TRACKS, M.element(M.TRACK_ENTRY, M._uint(M.TRACK_NUMBER, 2))) + cluster + cluster + M.element(M.CUES, b"")
    media = M.parse(M.element(M.EBML, b"") + segment)
    assert [(p.track, p.timestamp_ns, p.length, p.keyframe) for p in media.packets] == [(2, 105_000_000, 3, False), (2, 105_000_000, 4, False)] * 2
    for bad in (b"", b"\x00\x00", M.store(b"x" * 192)[:-3], b"plain text"):
        with pytest.raises(M.MediaError):
            M.parse(bad)


def test_media_query(odd_docs, no_docs):
    media = M.with_media(odd_docs)
    rows = {r.doc_id: r for r in M.media_features(media).collect()}
    raw = ("é" * 50_000 + " 🙂 4111 1111 1111 1111").encode()
    padded = raw + b" " * (-len(raw) % 192)
    assert rows[7].payload_sha256 == hashlib.sha256(padded).hexdigest() and rows[7].tail_crc32 == zlib.crc32(padded[-16:])
    assert rows[2].n_bytes == rows[3].n_bytes == 0 and rows[2].payload_bytes == 192 and rows[2].media_sha256 == rows[3].media_sha256
    assert M.media_features(M.with_media(no_docs)).count() == 0
    packets = M.packet_table(media)
    assert packets.where("doc_id = 2").count() == 1 and packets.where("doc_id = 1").count() == 2


@pytest.fixture(scope="module")
def model():
    with open(P.DEFAULT_MODEL, "rb") as f:
        return f.read()


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_parity_random(texts):
    with open(P.DEFAULT_MODEL, "rb") as f:
        data = f.read()
    tool, other = P.codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = [t.replace("\0", "") for t in texts]
    for t, (ids, parity, back) in zip(texts, tool.encode_batch(texts), strict=True):
        ids = np.frombuffer(ids, "<i4").tolist()
        assert ids == other.encode(t) and parity
        assert not back or tool.decode(ids) == t.replace(P.SPACE, " ")


def test_unigram_model_builds():
    pieces = [("<unk>", 0.0, P.UNKNOWN), ("▁a", -1.0, P.NORMAL), ("b", -2.0, P.NORMAL), ("▁ab", -1.5, P.NORMAL)]

    def field(n, kind, body):
        return bytes([n << 3 | kind]) + body

    def piece(p, s, k):
        raw = p.encode()
        return field(1, 2, bytes([len(raw)]) + raw) + field(2, 5, np.float32(s).tobytes()) + field(3, 0, bytes([k]))

    data = b"".join(field(1, 2, bytes([len(x)]) + x) for x in (piece(*p) for p in pieces)) + field(2, 2, b"\x02" + field(3, 0, b"\x01"))
    m = P.Model(data)
    assert m.kind == P.UNIGRAM and m.unk_id == 0 and m.dummy_prefix
    assert P.build_tokenizer(m).encode("▁ab", add_special_tokens=False).ids == [3]


def test_encode_and_decode(spark, odd_docs, no_docs, model):
    out = P.encode(odd_docs, keep=("doc_id", "size"))
    rows = out.collect()
    assert len(rows) == 8 and all(r.parity and r.round_trip for r in rows)
    assert all(r.ids == [] for r in rows if r.doc_id in (2, 3))
    back = {r.doc_id: r.text for r in P.decode(out).collect()}
    assert back[6] == "long " * 40_000 and back[5] == "\t\n " and back[3] == ""
    assert P.encode(no_docs).count() == 0
