"""SentencePiece models on the tokenizers library.

The model protobuf is parsed here, field by field; its normaliser, metaspace marker, scores and byte
fallback are rebuilt as a `tokenizers.Tokenizer` (Unigram or BPE, as the model says). Texts are cut
before each run of metaspaces, which changes nothing as long as no piece has a metaspace after
another character (checked), so every distinct chunk of a batch is encoded once, with the library's
own threads, and compared with the sentencepiece library: `parity` reports that comparison.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenquery.llm.frames import map_batches, texts

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# piece types and model types of the public sentencepiece_model.proto (fixed values)
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_KEPT_CHARS, _KEPT_CHUNKS = 64, 400_000


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-width values stay bytes."""
    at, end = 0, len(buf)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = buf[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, buf[at : at + size]
        at += size


class Model:
    """What a model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        norm: dict = {}
        for field, value in _fields(data):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode("utf-8")
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                norm = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unk_id = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.charsmap = norm.get(2, b"")
        self.dummy_prefix = bool(norm.get(3, 1))
        self.squeeze = bool(norm.get(4, 1))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, k in self.pieces if k in (NORMAL, USER_DEFINED)):
            raise ValueError("pieces that span words can't be encoded chunk by chunk")
        if any(k == USER_DEFINED for *_, k in self.pieces):
            raise ValueError("user-defined symbols are not supported")


def build_tokenizer(model: Model):
    """The tokenizers.Tokenizer of a model, without normaliser: texts come normalised and cut."""
    from tokenizers import Tokenizer, models

    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    if model.kind == UNIGRAM:
        return Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback))
    if model.kind != BPE:
        raise ValueError("only Unigram and BPE models are supported")
    scores = {p: s for p, s, k in model.pieces if k == NORMAL}
    merges = [(-s, vocab[p], n, p[:n], p[n:]) for p, s in scores.items() for n in range(1, len(p)) if p[:n] in scores and p[n:] in scores]
    return Tokenizer(models.BPE(vocab, [m[3:] for m in sorted(merges)], unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback))


class Codec:
    """Encodes and decodes with one model, remembering short chunks."""

    def __init__(self, data: bytes, threads: int = 2):
        import sentencepiece

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = Model(data)
        self.tokenizer = build_tokenizer(self.model)
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.normaliser = None
        if self.model.charsmap:
            from tokenizers import normalizers

            self.normaliser = normalizers.Precompiled(self.model.charsmap)
        self.as_bytes = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNUSED) else p.replace(SPACE, " ").encode("utf-8") for p, _, k in self.model.pieces
        ]
        self.byte_sizes = np.array([len(x) for x in self.as_bytes], dtype=np.int64)
        self.kept: dict[str, bytes] = {}
        self.odd: dict[str, tuple[bool | None, bool]] = {}

    def normalise(self, text: str) -> str:
        """The text with the model's character map, white-space rules and metaspaces; empty stays empty."""
        if self.normaliser is not None:
            text = self.normaliser.normalize_str(text)
        text = text.replace(" ", SPACE)
        if self.model.squeeze:
            text = re.sub(f"{SPACE}{{2,}}", SPACE, text).strip(SPACE)
        return SPACE + text if text and self.model.dummy_prefix else text

    def decode(self, ids: Iterable[int]) -> str:
        """The normalised text of ids, with plain spaces and without the dummy prefix."""
        out = b"".join(map(self.as_bytes.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.model.dummy_prefix and out.startswith(" ") else out

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """chunk -> ids as little-endian int32; chunks that fail a comparison are noted in `odd`.

        The other library puts a dummy prefix before what it is given, so a chunk can be compared
        alone only if it is one metaspace and a word; others are compared in their whole text.
        """
        if not chunks:
            return {}
        alone = [self.model.dummy_prefix and len(c) > 1 and c[0] == SPACE and c[1] != SPACE for c in chunks]
        theirs = self.other.encode([c[1:] for c, ok in zip(chunks, alone, strict=True) if ok])
        ours = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ours), dtype="<i4")
        ends = np.cumsum([len(x) for x in ours], dtype=np.int64)
        raw, starts = flat.tobytes(), np.concatenate(([0], ends[:-1])).astype(np.int64)
        plain = [c.replace(SPACE, " ").encode("utf-8") for c in chunks]
        # all chunks decode to themselves if their bytes do in a row, each over its own length
        sizes = np.concatenate(([0], np.cumsum(self.byte_sizes[flat])))
        lengths = sizes[ends] - sizes[starts]
        whole = lengths.tolist() == [len(x) for x in plain] and b"".join(map(self.as_bytes.__getitem__, flat.tolist())) == b"".join(plain)
        if not (whole and all(alone) and ours == theirs):
            rest = iter(theirs)
            for chunk, ok, ids, wanted in zip(chunks, alone, ours, plain, strict=True):
                same = ids == next(rest) if ok else None
                back = b"".join(map(self.as_bytes.__getitem__, ids)) == wanted
                if not (same and back):
                    self.odd[chunk] = (same, back)
        return {c: raw[4 * x : 4 * y] for c, x, y in zip(chunks, starts.tolist(), ends.tolist(), strict=True)}

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text: metaspaces with what follows them."""
        plain = self.normalise(text)
        if SPACE * 2 in plain or not plain.startswith(SPACE):
            return _CHUNK.findall(plain)
        return [SPACE + w for w in plain[1:].split(SPACE)]

    def encode_batch(self, lines: list[str]) -> list[tuple[bytes, bool, bool]]:
        """For each text: ids as little-endian int32, parity, exact round trip to the normalised text."""
        cut = [self.chunks(t) for t in lines]
        look = self.kept
        new = list(set().union(*cut).difference(look))
        look.update(self.learn(new))
        odd = self.odd
        out = []
        for text, chunks in zip(lines, cut, strict=True):
            ids = b"".join([look[c] for c in chunks])
            notes = [odd[c] for c in chunks if c in odd] if odd else []
            same = [n[0] for n in notes]
            parity = self.other.encode(text) == np.frombuffer(ids, "<i4").tolist() if None in same else all(same)
            out.append((ids, parity, all([n[1] for n in notes])))
        if len(look) > _KEPT_CHUNKS:
            self.kept, self.odd = {}, {}
        else:
            for chunk in new:
                if len(chunk) > _KEPT_CHARS:
                    del look[chunk]
                    odd.pop(chunk, None)
        return out


_CODECS: dict[bytes, Codec] = {}


def codec(data: bytes, threads: int = 2) -> Codec:
    """One codec for each model in a worker process."""
    key = hashlib.sha256(data).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(data, threads)
    return _CODECS[key]


_SLICE = 250  # texts encoded together


def encode(docs: DataFrame, text_col: str = "text", model_path: str = DEFAULT_MODEL, threads: int = 2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ids array<int>, n_tokens, ids_sha256 (of the ids as little-endian int32),
    parity (same ids as the sentencepiece library), round_trip (the ids decode to the normalised text).

    A null or empty text has no ids. Repeated rows stay; an empty table gives no rows; columns that
    are not kept are ignored.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    slim = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        tool = codec(model.value, threads)
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                b = whole.slice(at, _SLICE)
                found = tool.encode_batch(texts(b.column(len(keep))))
                sizes = np.array([len(x[0]) // 4 for x in found], dtype=np.int32)
                flat = np.frombuffer(b"".join(x[0] for x in found), dtype="<i4")
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat, pa.int32()))
                extra = [ids, pa.array(sizes), pa.array([hashlib.sha256(x[0]).hexdigest() for x in found]), pa.array([x[1] for x in found]), pa.array([x[2] for x in found])]
                yield pa.record_batch([b.column(i) for i in range(len(keep))] + extra, names=[*keep, "ids", "n_tokens", "ids_sha256", "parity", "round_trip"])

    return map_batches(slim, run, f"{kinds}, ids array<int>, n_tokens int, ids_sha256 string, parity boolean, round_trip boolean")


def decode(encoded: DataFrame, ids_col: str = "ids", model_path: str = DEFAULT_MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and text: the normalised text of the ids (null ids: empty)."""
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())
    slim = encoded.select(*[F.col(c) for c in keep], F.col(ids_col).alias("__ids"))
    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        tool = codec(model.value)
        for b in batches:
            out = [tool.decode(ids or []) for ids in b.column(len(keep)).to_pylist()]
            yield pa.record_batch([b.column(i) for i in range(len(keep))] + [pa.array(out, pa.string())], names=[*keep, "text"])

    return map_batches(slim, run, f"{kinds}, text string")
