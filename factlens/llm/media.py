"""Operator 6: a Spark data source for archives of media, and texts stored in it as images.

The format "tararchive" writes one tar file a task into a folder, with an index of member offsets as its last member, and a
manifest of the files whose tasks were committed, with the index place of every MARK bytes. Reading plans partitions of RANGE
bytes over the archives: a partition has the members that start in its range, reads that stretch of the index alone, and
streams them as Arrow batches of at most BATCH_BYTES. A member is read at its own offset and tried again RETRIES times by
itself, with the file opened anew, if reading fails or a checksum does not hold (so are the opening and the index); then
`on_error` decides ("fail", or "null": a null payload with the error's text).

A payload is stored as a grayscale PNG of 8-bit samples, WIDTH to a row.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import filesystem, importable, new_path

WIDTH, RANGE, BATCH_BYTES, RETRIES, MARK = 64, 16 << 20, 4 << 20, 3, 4 << 20
_INDEX, _MANIFEST = "__index__", "_manifest.json"
_PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_of(payload: bytes, level: int = 6) -> bytes:
    """payload: a positive multiple of WIDTH bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and content of every chunk, after its checksum held."""
    if png[:8] != _PNG:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        (n,) = struct.unpack(">I", png[at : at + 4])
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if len(png) < at + 12 + n or zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a PNG chunk's checksum does not hold")
        yield kind, body
        at += 12 + n


def payload_of(png: bytes) -> bytes:
    data, size = [], None
    for kind, body in chunks(png):
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a filter that this reader lacks")
    return lines[:, 1:].tobytes()


def _header(name: str, size: int, kind: bytes = b"0") -> bytes:
    """A name of over 100 bytes comes in a member of its own before it."""
    raw, before = name.encode(), b""
    if len(raw) > 100:
        before = _header("././@LongLink", len(raw) + 1, b"L") + raw + b"\0" * (512 - len(raw) % 512)
    h = bytearray(512)
    h[0:100] = raw[:100].ljust(100, b"\0")
    h[100:108], h[108:116], h[116:124] = b"0000644\0", b"0000000\0", b"0000000\0"
    h[124:136] = b"%011o\0" % size if size < 1 << 33 else b"\x80" + size.to_bytes(11, "big")
    h[136:148], h[148:156], h[156:157], h[257:265] = b"00000000000\0", b" " * 8, kind, b"ustar\x0000"
    h[148:156] = b"%06o\0 " % sum(h)
    return before + bytes(h)


def _size(h: bytes) -> int:
    return int.from_bytes(h[125:136], "big") if h[124] & 0x80 else int(h[124:136].strip(b"\0 ") or b"0", 8)


def _member(f, at: int) -> tuple[str, bytes]:
    f.seek(at)
    h = f.read(512)
    if len(h) < 512 or int(h[148:156].strip(b"\0 ") or b"0", 8) != sum(h[:148]) + 32 * 8 + sum(h[156:]):
        raise OSError(f"no member starts at {at}")
    size = _size(h)
    data = f.read(size)
    if len(data) < size:
        raise OSError(f"the member at {at} ends early")
    if h[156:157] in (b"L", b"x"):  # the next member's name, or its extended header
        name, data_of = _member(f, at + 512 + size + -size % 512)
        if h[156:157] == b"L":
            name = data.rstrip(b"\0").decode()
        elif m := re.search(rb"(?:^|\n)\d+ path=([^\n]*)\n", data):
            name = m[1].decode()
        return name, data_of
    return h[:100].rstrip(b"\0").decode(errors="replace"), data  # a cut name is replaced by the whole one


@dataclass
class _Written(WriterCommitMessage):
    file: str = ""
    size: int = 0
    index: int = 0
    members: int = 0
    marks: list[int] = field(default_factory=list)  # members that start before each MARK bytes


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = path
        self.overwrite = overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = filesystem(self.path)
        name, out, at, offsets = f"part-{uuid.uuid4().hex}.tar", None, 0, []
        for batch in batches:
            for key, data in zip(batch.column("key").to_pylist(), batch.column("media"), strict=True):
                data = data.as_py() or b""
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}")
                offsets.append(at)
                body = _header("null" if key is None else f"k{key}", len(data)) + data + b"\0" * (-len(data) % 512)
                out.write(body)
                at += len(body)
        if out is None:
            return _Written()
        table = np.array(offsets, "<i8").tobytes()
        out.write(_header(_INDEX, len(table)) + table + b"\0" * (-len(table) % 512) + b"\0" * 1024)
        out.close()
        return _Written(name, at, at, len(offsets), np.searchsorted(offsets, np.arange(0, at + MARK, MARK)).tolist())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = filesystem(self.path)
        fs.create_dir(base, recursive=True)
        old = [] if self.overwrite else [x for x in read_manifest(self.path) if x["index"] >= 0]  # what was committed before
        new = [vars(m) for m in messages if m and m.file]
        with fs.open_output_stream(f"{base}/{_MANIFEST}") as f:
            f.write(json.dumps(old + new).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = filesystem(self.path)
        for m in messages:
            if m and m.file:
                fs.delete_file(f"{base}/{m.file}")


def read_manifest(path: str) -> list[dict]:
    """The committed archives; of a folder without a manifest, its tar files, whose index is looked for when they are read."""
    import pyarrow.fs as pafs

    fs, base = filesystem(path)
    if fs.get_file_info(f"{base}/{_MANIFEST}").type != pafs.FileType.NotFound:
        with fs.open_input_stream(f"{base}/{_MANIFEST}") as f:
            return json.loads(f.read())
    files = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return [{"file": x.base_name, "size": x.size, "index": -1, "members": -1} for x in sorted(files, key=lambda x: x.path) if x.extension == "tar"]


@dataclass
class _Range(InputPartition):
    file: str
    index: int
    start: int
    stop: int
    low: int = 0  # the stretch of the index in which its members are
    high: int = 0


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, batch_bytes: int, retries: int, on_error: str):
        self.path, self.range_bytes, self.batch_bytes, self.retries, self.on_error = path, range_bytes, batch_bytes, retries, on_error

    def partitions(self) -> list[_Range]:
        out = []
        for x in read_manifest(self.path):
            step = self.range_bytes if x["index"] >= 0 else x["size"]  # an archive without an index is walked by one task
            marks = x.get("marks") or [0]
            for at in range(0, x["size"], max(step, 1)):
                stop = min(at + step, x["size"])
                high = -(-stop // MARK)
                out.append(_Range(x["file"], x["index"], at, stop, marks[min(at // MARK, len(marks) - 1)], marks[high] if high < len(marks) else x["members"]))
        return out or [_Range("", -1, 0, 0)]

    def _offsets(self, f, part: _Range) -> list[int]:
        if part.index >= 0:
            f.seek(part.index + 512 + 8 * part.low)
            raw = f.read(8 * (part.high - part.low))
            if len(raw) < 8 * (part.high - part.low):
                raise OSError("the index ends early")
            some = np.frombuffer(raw, "<i8")
            return some[np.searchsorted(some, part.start) : np.searchsorted(some, part.stop)].tolist()
        at, out, size, long = 0, [], f.size(), False
        while at + 512 <= size:
            f.seek(at)
            h = f.read(512)
            if not h.strip(b"\0"):
                break
            n = _size(h)
            if h[156:157] in (b"0", b"\0", b"L", b"x") and not long and not h.startswith(_INDEX.encode() + b"\0"):
                out.append(at)
            long = h[156:157] in (b"L", b"x")  # the member after it is named by it
            at += 512 + n + (-n % 512)
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("media", pa.binary()), ("error", pa.string())])
        if not part.file:
            return
        fs, base = filesystem(self.path)
        opened: list = []

        def again(what):
            """what(file), tried again with the file opened anew."""
            for k in range(self.retries + 1):
                try:
                    if not opened:
                        opened.append(fs.open_input_file(f"{base}/{part.file}"))
                    return what(opened[0])
                except (OSError, ValueError):
                    opened.clear()
                    if k == self.retries:
                        raise
                    time.sleep(0.05 * 2**k)

        def member(f, at: int) -> tuple[str, bytes]:
            key, data = _member(f, at)
            if data[:8] == _PNG:
                for _ in chunks(data):
                    pass
            return key, data

        rows: list[tuple] = []
        held = 0
        for at in again(lambda f: self._offsets(f, part)):
            try:
                key, data = again(lambda f, at=at: member(f, at))
                rows.append((None if key == "null" else key.removeprefix("k"), data, None))
                held += len(data)
            except (OSError, ValueError) as e:
                if self.on_error != "null":
                    raise
                rows.append((None, None, f"{part.file}@{at}: {e}"))
            if held >= self.batch_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class TarArchive(DataSource):
    """format("tararchive"): key string, media binary (and error string when read). Options: path, rangeBytes, batchBytes, retries, onError."""

    @classmethod
    def name(cls) -> str:
        return "tararchive"

    def schema(self) -> str:
        return "key string, media binary, error string"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Reader(o["path"], int(o.get("rangebytes", o.get("rangeBytes", RANGE))), int(o.get("batchbytes", o.get("batchBytes", BATCH_BYTES))), int(o.get("retries", RETRIES)), o.get("onerror", o.get("onError", "fail")))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    importable(spark)
    spark.dataSource.register(TarArchive)


def store_texts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes each text, null as empty, as UTF-8 with zero bytes up to a positive multiple of WIDTH. A member's key is "=", the id as text, "-" and the unpadded length; a null id has neither "=" nor text. Ids may be of any type that can be cast to text and back. Repeated rows are members of their own."""
    register(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, media = [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = (t or "").encode()
                    media.append(png_of(raw + b"\0" * ((-len(raw) % WIDTH) if raw else WIDTH)))
                    keys.append(f"{'' if i is None else '=' + i}-{len(raw)}")
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(media, pa.binary())], names=["key", "media"])

    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(encode, "key string, media binary")
    rows.write.format("tararchive").mode("append").option("path", path).save()


def features(payload: bytes) -> str:
    """Mean and spread of the samples in thousandths, the share of each eighth of the range in thousandths, and an 8x8 average hash."""
    x = np.frombuffer(payload, np.uint8)
    n = len(x)
    shares = np.bincount(x >> 5, minlength=8) * 1000 // n
    total, square = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    var = (square * n - total * total) // (n * n)
    rows = x.reshape(-1, WIDTH)
    edges = np.linspace(0, len(rows), 9).astype(int)
    sums = np.add.reduceat(rows.astype(np.int64), np.minimum(edges[:-1], len(rows) - 1), axis=0).reshape(8, 8, 8).sum(axis=2)
    counts = np.maximum(np.diff(edges), 1)[:, None] * 8
    bits = (sums * n > total * counts).ravel()
    return f"mean={total * 1000 // n};var={var};hist={','.join(map(str, shares))};ahash={int(''.join('1' if b else '0' for b in bits), 2):016x}"


def read_media(spark: SparkSession, path: str, id_type: str = "bigint", **options) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and error of each member, from the stored bytes. A member that could not be read (onError "null") has a row with its error and nothing else. An empty folder gives no rows."""
    register(spark)
    reader = spark.read.format("tararchive").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, v)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, media, error in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if media is None:
                    rows.append((None,) * 8 + (error,))
                    continue
                i, _, n = key.rpartition("-")
                p = payload_of(media)
                rows.append((i[1:] if i else None, int(n), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), features(p), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names=names)

    read = reader.load().select("key", "media", "error").mapInArrow(measure, "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
    return read.withColumn("doc_id", F.col("doc_id").cast(id_type))


def store_and_read(docs: DataFrame, **columns) -> DataFrame:
    path = new_path(docs.sparkSession, "media")
    store_texts(docs, path, **columns)
    return read_media(docs.sparkSession, path, docs.schema[columns.get("id_col", "doc_id")].dataType.simpleString())
