"""Operator 8: token ids in Simple-8b files, written in ascending id order and read back.

Word: the high 4 bits select how the low 60 hold ids. Selector 0 is a run of 240 zeros, selector 1 an escape: the next word
holds one id whole (for ids of more than 60 bits).

File: b"S8BTOK2\\n", the blocks' words (little-endian), then tables as little-endian 64-bit integers: for each block the
byte offset, the number of words and of ids; for each document its id, the id's kind (0 an integer, 1 null, 2 a text, whose
bytes' number stands for it) and the number of its ids; the bytes of the ids that are texts; last the number of blocks, of
documents, the byte offset of the tables, that of the id texts, and b"S8BEND2\\n". Every block is decoded by itself.

One file holds one range of ids. A manifest row for each file (its place in the order, its documents and ids) is written only
for tasks that succeeded, so files that a lost attempt left behind are never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, importable, n_partitions, new_path, written
from .tokens import encoder, forget

#: Selectors 2 to 15: ids a word, bits an id.
LAYOUT = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ZEROS, MAGIC, END = 240, b"S8BTOK2\n", b"S8BEND2\n"
BLOCK_IDS = 1 << 16


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs (0 for 0), exact for 64 bits."""
    high = (ids >> np.uint64(32)).astype(np.float64)
    low = (ids & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.int8)


def encode_block(ids: np.ndarray) -> np.ndarray:
    """Words of one block; the reader knows the number of ids, so the last word may be part empty."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    need = _bits(ids)
    most = int(need.max())
    # The widest slot that the next c ids need, for each c in use, gives the selector with most ids at each place.
    choice = np.full(n, 1, np.int8)
    span = {1: need}
    for k in range(len(LAYOUT) - 1, -1, -1):
        c, b = LAYOUT[k]
        if c == 1:
            wide = need
        else:
            half = max(x for x in span if x < c and 2 * x >= c) if any(2 * x >= c for x in span) else max(span)
            prev = span[half]
            wide = prev.copy()
            at = half
            while at < c:
                step = min(half, c - at)
                if step < half:  # overlapping windows cover the same ids
                    at = c - half
                if at < n:
                    np.maximum(wide[: n - at], prev[at:], out=wide[: n - at])
                at += half
        span[c] = wide
        choice[wide <= b] = k + 2
    if most == 0 or (need == 0).any():
        zero = np.concatenate([[0], np.cumsum(need == 0)])
        ends = np.minimum(np.arange(n) + ZEROS, n)
        run = (zero[ends] - zero[:n]) == ends - np.arange(n)
        choice[run & (ends - np.arange(n) > 60)] = 0
    count = np.array([ZEROS, 1, *[c for c, _ in LAYOUT]])
    step = (np.arange(n) + count[choice]).tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i = step[i]
    at = np.array(starts, dtype=np.int64)
    sel = choice[at].astype(np.uint64)
    words = sel << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(ZEROS, np.uint64)])
    for k, (c, b) in enumerate(LAYOUT, 2):
        if len(mine := np.flatnonzero(sel == k)):
            w = words[mine]
            for j in range(c):
                w |= padded[at[mine] + j] << np.uint64(j * b)
            words[mine] = w
    if len(esc := np.flatnonzero(sel == 1)):
        words = np.insert(words, esc + 1, ids[at[esc]])
    return words


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    words = np.asarray(words, dtype=np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (sel == 1).any():  # a word after an escape is an id, whatever its high bits are
        i = 0
        for i in range(len(words)):
            if sel[i] == 1 and not raw[i]:
                raw[i + 1] = True
    keep = ~raw
    values = words[np.flatnonzero(keep & (sel == 1)) + 1]
    words, sel = words[keep], sel[keep]
    count = np.array([ZEROS, 1, *[c for c, _ in LAYOUT]])[sel]
    start = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(max(int(start[-1]), n), np.uint64)
    for k, (c, b) in enumerate(LAYOUT, 2):
        if len(mine := np.flatnonzero(sel == k)):
            w, mask = words[mine], np.uint64((1 << b) - 1)
            for j in range(c):
                out[start[mine] + j] = (w >> np.uint64(j * b)) & mask
    out[start[np.flatnonzero(sel == 1)]] = values
    return out[:n]


class FileWriter:
    def __init__(self, out, block_ids: int = BLOCK_IDS):
        self.out, self.size = out, block_ids
        out.write(MAGIC)
        self.at, self.blocks, self.docs, self.names, self.held, self.n = len(MAGIC), [], [], [], [], 0

    def add(self, doc_id: int | str | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        if isinstance(doc_id, str):
            self.names.append(doc_id.encode())
            self.docs.append((len(self.names[-1]), 2, len(ids) // 4))
        else:
            self.docs.append((0 if doc_id is None else doc_id, int(doc_id is None), len(ids) // 4))
        self.held.append(ids)
        self.n += len(ids) // 4
        if self.n >= self.size:
            self.flush()

    def flush(self) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4").astype(np.uint64)
        for at in range(0, len(ids), self.size):
            part = ids[at : at + self.size]
            words = encode_block(part)
            self.out.write(words.astype("<u8").tobytes())
            self.blocks.append((self.at, len(words), len(part)))
            self.at += 8 * len(words)
        self.held, self.n = [], 0

    def close(self) -> int:
        self.flush()
        for table in (self.blocks, self.docs):
            self.out.write(np.array(table, dtype="<i8").tobytes())
        self.out.write(b"".join(self.names))
        self.out.write(np.array([len(self.blocks), len(self.docs), self.at, self.at + 24 * (len(self.blocks) + len(self.docs))], dtype="<i8").tobytes() + END)
        return sum(n for _, _, n in self.docs)


def read_file(f, size: int) -> Iterator[tuple[int | str | None, int, np.ndarray]]:
    """(id, ids before it in this file, its ids) of each document, holding one block and one document at a time."""
    f.seek(size - 40)
    tail = f.read(40)
    if tail[32:] != END:
        raise ValueError("not a token file")
    n_blocks, n_docs, at, names_at = (int(x) for x in np.frombuffer(tail[:32], "<i8"))
    f.seek(at)
    blocks = np.frombuffer(f.read(24 * n_blocks), "<i8").reshape(-1, 3)
    docs = np.frombuffer(f.read(24 * n_docs), "<i8").reshape(-1, 3)
    names, name_at = f.read(size - 40 - names_at), 0
    have, k, before = np.empty(0, np.uint64), 0, 0
    for doc_id, kind, n in docs.tolist():
        if kind == 2:
            doc_id, name_at = names[name_at : name_at + doc_id].decode(), name_at + doc_id
        parts, got = [], 0
        while got < n:
            if not len(have):
                offset, n_words, n_ids = blocks[k].tolist()
                f.seek(offset)
                have = decode_block(np.frombuffer(f.read(8 * n_words), "<u8"), n_ids)
                k += 1
            take = have[: n - got]
            have = have[n - got :]
            parts.append(take)
            got += len(take)
        yield (None if kind == 1 else doc_id), before, np.concatenate(parts) if parts else np.empty(0, np.uint64)
        before += n


def stored_id(docs: DataFrame, id_col: str) -> str:
    return "bigint" if docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"


def write_token_files(docs: DataFrame, tokenizer: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, partitions: int | None = None) -> DataFrame:
    """Writes the files under path; gives the manifest: part, file, n_docs, n_ids.

    Ids may be of any type that has an order; integers are stored as such, others as text. A null text is empty: the end id
    alone. Null ids come first; rows that share an id are ordered by a hash of their text, so the files' order does not depend
    on how the rows are dealt, and a hot id lies in several files. No rows give no files. A text of any length lies in as many blocks as it needs. Other columns are not read.
    """
    importable(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, w = TaskContext.get().partitionId(), encoder(tokenizer), None
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        fs, base = filesystem(path)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.s8b"
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                if not rows.num_rows:
                    continue
                if w is None:
                    fs.create_dir(base, recursive=True)
                    w = FileWriter(out := fs.open_output_stream(f"{base}/{name}"))
                for i, ids in zip(rows.column(0).to_pylist(), enc.encode([t or "" for t in rows.column(1).to_pylist()]), strict=True):
                    w.add(i, ids + end)
        if w is not None:
            n = w.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": pa.array([len(w.docs)], pa.int64()), "n_ids": pa.array([n], pa.int64())}, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The last key deals rows that are alike in id and text; whatever it gives, the result is the same.
    ranged = rows.repartitionByRange(partitions or n_partitions(docs.sparkSession), "doc_id", F.xxhash64("text"), F.rand(1)).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ranged = ranged.select(F.col("doc_id").cast(stored_id(docs, id_col)), "text")
    return written(ranged.mapInArrow(write, "part int, file string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame, path: str, with_ids: bool = False, id_type: str = "bigint") -> DataFrame:
    """doc_id (as id_type: bigint, or string for ids that are no integers), start (ids of all documents before it), n_tokens, ids_crc32, and the ids themselves if with_ids; read from the files."""
    importable(manifest.sparkSession)
    fields = [("doc_id", pa.int64() if id_type == "bigint" else pa.string()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] if with_ids else [])]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        fs, base = filesystem(path)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                with fs.open_input_file(f"{base}/{name}") as f:
                    held = 0
                    for i, before, ids in read_file(f, f.size()):
                        rows.append((i, first + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int64)] if with_ids else [])))
                        held += len(ids) if with_ids else 1
                        if held >= 100_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    schema = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + (", ids array<bigint>" if with_ids else "")
    return files.repartition(n_partitions(manifest.sparkSession)).mapInArrow(read, schema)


def encode_and_read(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    path = new_path(docs.sparkSession, "token-files")
    id_col = options.get("id_col", "doc_id")
    read = read_token_files(write_token_files(docs, tokenizer, path, **options), path, id_type=stored_id(docs, id_col))
    return read.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
