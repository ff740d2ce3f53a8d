"""Operator 1: cost-balanced packing of token sequences.

The cost of a piece of n tokens is linear * n + quadratic * n * n: the matrix products of every layer and the attention
inside a document. Documents are packed in blocks of bounded size while the scan streams by, without a shuffle: a block's
documents, longest first, each go to the sequence of lowest cost that has room. A block has as many sequences as its tokens
need, so at most capacity - 1 places of a block stay empty; what fits nowhere whole is cut where the roomiest sequences end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable
from .tokens import encoder

SEQUENCE = 2048
BLOCK_TOKENS = 1024 * SEQUENCE
LINEAR, QUADRATIC = 1.0, 1.0 / SEQUENCE
END_ID = 1
_SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long{more}"


def assign(lengths: np.ndarray, capacity: int = SEQUENCE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """Pieces (document, start, length, sequence, offset) of one block, and the filled length of each sequence."""
    lengths = np.asarray(lengths, dtype=np.int64)
    pieces: list[tuple[int, int, int, int, int]] = []
    full = lengths // capacity
    rest = lengths - full * capacity
    n_full = 0
    for d in np.flatnonzero(full):
        for k in range(int(full[d])):
            pieces.append((int(d), k * capacity, capacity, n_full, 0))
            n_full += 1
    n_open = -(-int(rest.sum()) // capacity)
    room = np.full(n_open, capacity, dtype=np.int64)
    cost = np.zeros(n_open)
    for d in np.argsort(-rest, kind="stable"):
        left, start = int(rest[d]), int(full[d]) * capacity
        while left:
            fits = np.where(room >= left, cost, np.inf)
            s = int(fits.argmin())
            if fits[s] == np.inf:
                s = int(room.argmax())
            take = min(left, int(room[s]))
            pieces.append((int(d), start, take, n_full + s, capacity - int(room[s])))
            room[s] -= take
            cost[s] += linear * take + quadratic * take * take
            left -= take
            start += take
    return pieces, np.concatenate([np.full(n_full, capacity, dtype=np.int64), capacity - room])


def _packer(tokenizer: str, capacity: int, block_tokens: int, linear: float, quadratic: float, end_id: int, with_ids: bool, schema: pa.Schema):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        enc, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        ids, blobs, total = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal first
            pieces, filled = assign(np.array([len(b) // 4 for b in blobs]), capacity, linear, quadratic)
            doc, start, length, seq, offset = (np.array(x, dtype=np.int64) for x in zip(*pieces, strict=True))
            cut = [blobs[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
            cols = [pa.array(ids, type=schema.field(0).type).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array([len(blobs[d]) // 4 for d in doc], pa.int64()), pa.array(seq + first), pa.array(offset), pa.array(filled[seq])]
            if with_ids:
                cols.append(pa.array([np.frombuffer(c, "<u4").astype(np.int64) for c in cut], pa.list_(pa.int64())))
            first += len(filled)
            ids.clear()
            blobs.clear()
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for i, b in zip(part.column(0).to_pylist(), enc.encode(texts), strict=True):
                    ids.append(i)
                    blobs.append(b + end)
                    total += len(b) // 4 + 1
                    if total >= block_tokens:
                        yield flush()
                        total = 0
        if blobs:
            yield flush()

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE, block_tokens: int = BLOCK_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the piece's token ids as `ids`.

    A null or empty text is the end id alone. A null or repeated id is carried along: each row is its own document. No rows
    give no pieces. Texts of any length are cut into full sequences. Other columns of docs are not read. sequence_id is
    unique, made of the partition and a count in it, so a task that runs again gives the same rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    importable(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = _SCHEMA.format(id=kind, more=", ids array<bigint>" if with_ids else "")
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_packer(tokenizer, capacity, block_tokens, linear, quadratic, end_id, with_ids, arrow), schema)
