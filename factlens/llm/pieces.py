"""Operator 10: SentencePiece encoding and decoding by the tokenizers library.

The model file is a protobuf message; its pieces (text, score, type) and its trainer and normaliser settings are parsed from
the wire format here. From them a tokenizers pipeline is rebuilt: the normaliser (its compiled character map where it has
one, blanks to the metaspace marker, the marker before the text), a Unigram model with the scores or a BPE model whose merges
follow the scores, byte fallback, and the decoder. Batches are encoded by THREADS threads.

Where no piece has the marker after another character, no merge crosses a blank, so a text is encoded by its words, each once
while it is remembered; otherwise texts are encoded whole. Where moreover no longer piece has a newline and a newline has an
id of its own, a text is cut before newlines too: a newline and what follows it are encoded together, and the marker's id
that comes before them is left out. Every word (or text) that is encoded is also encoded by the sentencepiece library, and
`parity` says whether all ids agree.
"""

from __future__ import annotations

import array
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable

MARK = "▁"
THREADS = 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = 1  # 1 unigram, 2 BPE
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """Number, wire type and value of a message's fields."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        v = shift = 0
        while True:
            b = data[at]
            at += 1
            v |= (b & 127) << shift
            if b < 128:
                return v
            shift += 7

    while at < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, kind, data[at : at + size]
            at += size


def parse_model(data: bytes) -> Spec:
    import struct

    spec = Spec()
    for number, _, value in _fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for k, _, v in _fields(value):
                if k == 1:
                    text = v.decode("utf-8")
                elif k == 2:
                    (score,) = struct.unpack("<f", v)
                elif k == 3:
                    kind = v
            spec.pieces.append((text, score, kind))
        elif number == 2:
            for k, _, v in _fields(value):
                if k == 3:
                    spec.model_type = v
                elif k == 35:
                    spec.byte_fallback = bool(v)
                elif k == 40:
                    spec.unk_id = v
        elif number == 3:
            for k, _, v in _fields(value):
                if k == 2:
                    spec.charsmap = v
                elif k == 3:
                    spec.dummy_prefix = bool(v)
                elif k == 4:
                    spec.squeeze = bool(v)
                elif k == 5:
                    spec.escape = bool(v)
    return spec


def build(spec: Spec):
    """A tokenizers.Tokenizer that gives the model's ids."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    vocab = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
    unk = spec.pieces[spec.unk_id][0]
    if spec.model_type == 1:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unk_id=spec.unk_id, byte_fallback=spec.byte_fallback)
    elif spec.model_type == 2:
        usable = {p for p, _, k in spec.pieces if k in (NORMAL, USER)}
        merges = []
        for p, score, kind in spec.pieces:
            if kind == NORMAL:
                cuts = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
                merges += [(-score, vocab[p], vocab[a], vocab[b], a, b) for a, b in cuts]
        merges.sort()
        model = models.BPE(vocab, [(a, b) for *_, a, b in merges], unk_token=unk, fuse_unk=True, byte_fallback=spec.byte_fallback)
    else:
        raise ValueError(f"model type {spec.model_type}: only unigram (1) and BPE (2) are rebuilt")
    tok = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if spec.escape else " "))
    if spec.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tok.normalizer = normalizers.Sequence(steps)
    ends = [decoders.Replace(MARK, " ")] + ([decoders.ByteFallback()] if spec.byte_fallback else []) + [decoders.Fuse()]
    tok.decoder = decoders.Sequence(ends + ([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []))
    return tok


class Codec:
    """encode(texts): (ids as little-endian unsigned 32-bit bytes, parity) of each text; decode(ids)."""

    def __init__(self, path: str, threads: int = THREADS, keep: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        self.spec, self.threads, self.keep = parse_model(data), threads, keep
        self.tok = build(self.spec)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        plain = not self.spec.charsmap and not self.spec.squeeze and self.spec.dummy_prefix and self.spec.escape
        names = {p for p, _, _ in self.spec.pieces}
        self.by_word = plain and MARK in names and not any(MARK in p.lstrip(MARK) for p, _, k in self.spec.pieces if k in (NORMAL, USER)) and not any(k == USER for *_, k in self.spec.pieces)
        alone = "\n" in names or self.spec.byte_fallback and "<0x0A>" in names
        self.by_line = self.by_word and alone and not any("\n" in p and len(p) > 1 for p in names)
        self.lead = np.array([p.startswith(MARK) for p, _, _ in self.spec.pieces])
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.apart: set[str] = set()  # words whose ids the sentencepiece library does not give

    def _both(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        ours = [array.array("I", e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        theirs = self.sp.encode(texts, num_threads=self.threads)
        return [(a.tobytes(), a.tolist() == b) for a, b in zip(ours, theirs, strict=True)]

    def _learn(self, words: list[str]) -> None:
        """Groups of words at once: the marker's pieces say where each begins. A group on which the libraries differ goes word by word."""
        groups = [words[at : at + 500] for at in range(0, len(words), 500)]
        ours = self.tok.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)
        theirs = self.sp.encode([" ".join(g) for g in groups], num_threads=self.threads)
        for group, e, b in zip(groups, ours, theirs, strict=True):
            ids = e.ids
            flat = array.array("I", ids)
            starts = np.flatnonzero(self.lead[np.frombuffer(flat, np.uint32)]).tolist()
            if ids == b and len(starts) == len(group):
                data = flat.tobytes()
                for w, x, y in zip(group, starts, [*starts[1:], len(ids)], strict=True):
                    self.memo[w] = data[4 * x + 4 * (self.by_line and w[0] == "\n") : 4 * y]
                continue
            for w, (one, same) in zip(group, self._both(group), strict=True):
                self.memo[w] = one[4:] if self.by_line and w[0] == "\n" else one
                if not same:
                    self.apart.add(w)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        if not self.by_word:
            return self._both(texts)
        cut: list[list[str] | None] = []
        need: set[str] = set()
        odd = []
        for i, t in enumerate(texts):
            if not t or t[0] in " \n▁" or t[-1] in " ▁" or "  " in t or " \n" in t or MARK in t:
                odd.append(i)
                cut.append(None)
            else:
                cut.append(w := (t.replace("\n", " \n") if self.by_line else t).split(" "))
                need.update(w)
        if len(self.memo) > self.keep:
            self.old, self.memo = self.memo, {}
        memo, new = self.memo, []
        for w in need.difference(memo):
            if (v := self.old.get(w)) is not None:
                memo[w] = v
            else:
                new.append(w)
        for at in range(0, len(new), 20_000):
            self._learn(new[at : at + 20_000])
        out: list = [None] * len(texts)
        for i, v in zip(odd, self._both([texts[i] for i in odd]), strict=True):
            out[i] = v
        for i, w in enumerate(cut):
            if w is not None:
                out[i] = (b"".join(map(memo.__getitem__, w)), not self.apart or self.apart.isdisjoint(w))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids), parity (equal to the sentencepiece library), round_trip
    (decoding gives the text, where the normaliser keeps it), and ids if asked for.

    A null text is empty and has no ids. Null or repeated ids are carried along. Texts of any length are encoded whole. No
    rows give no rows. Other columns are not read.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                done = c.encode(texts)
                ids = [array.array("I", b).tolist() for b, _ in done]
                back = c.decode(ids)
                cols = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(b) for b, _ in done], pa.int64()), pa.array([p for _, p in done]), pa.array([a == b for a, b in zip(back, texts, strict=True)])]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=["doc_id", "n_ids", "ids_crc32", "parity", "round_trip", "ids"][: 5 + with_ids])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_ids long, ids_crc32 long, parity boolean, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode_documents(df: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row's ids; null or no ids give an empty text."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c.decode([x or [] for x in batch.column(1).to_pylist()]), pa.string())], names=["doc_id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
