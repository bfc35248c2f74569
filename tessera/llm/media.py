"""Media columns: a Spark data source over directories of archives.

``media_archive`` writes rows ``(doc_id, n_bytes, media)`` as ZIP archives, one
or more a task, and reads them back. A commit lists the archives of tasks that
succeeded in a manifest of its own, so the leavings of failed or repeated tasks are
never read, and writes that append don't touch each other. An overwrite deletes the
manifests before it, then their archives, once its own is written. Reading plans
partitions as byte ranges of archives, of ``rangeBytes`` or, so that the driver
plans no more than about ``MOST_RANGES``, longer ones; a member belongs to the range
in which its local header begins. Payloads stream through Arrow in
batches of bounded size. A member that can't be read is tried again by its own
offset, with the archive opened anew; the others aren't read twice. A member
that fails every time ends the task, and Spark runs it again elsewhere.

Samples are kept losslessly as 8-bit greyscale PNG, 192 samples a row. Files are
opened by ``pyarrow.fs``, so any store with a URI that it knows will do; the
folder must be shared by all executors.

Defined results: a null text is the empty text, whose payload is one row of
spaces; ids may be null or repeated (each row is a member); equal texts give
equal bytes; an empty table gives an empty archive directory and no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import common

ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id long, n_bytes long, media binary"
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, TRIES, MOST_RANGES = 128 << 20, 8 << 20, 1 << 20, 4, 200_000
MANIFEST = "_MANIFEST-"
#: Cells a side of the grid whose means make the fingerprint.
GRID = 8


def payload_of(text: bytes) -> bytes:
    """The text padded by spaces to a positive multiple of a row."""
    return text + b" " * ((-len(text)) % ROW if text else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 3) -> bytes:
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), dtype=np.uint8)  # filter type 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of a PNG that ``encode_png`` made; checks every chunk's CRC."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, size = 8, [], None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's CRC differs")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit greyscale")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return np.ascontiguousarray(lines[:, 1:]).tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a fingerprint of which grid cells are above the mean."""
    x = np.frombuffer(payload, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    n = len(x)
    values = np.arange(256, dtype=np.float64)
    mean = float((counts * values).sum()) / n
    std = max(0.0, float((counts * values * values).sum()) / n - mean * mean) ** 0.5
    p = counts[counts > 0] / n
    rows = x.reshape(-1, ROW)
    cuts = np.linspace(0, len(rows), min(GRID, len(rows)) + 1).astype(int)[:-1]
    sums = np.add.reduceat(np.add.reduceat(rows.astype(np.int64), np.arange(0, ROW, ROW // GRID), axis=1), cuts, axis=0)
    height = np.diff(np.append(cuts, len(rows)))[:, None] * (ROW // GRID)
    bits = (sums * n > counts.dot(np.arange(256)) * height).astype(np.uint8)
    return f"w{ROW}h{len(rows)}:m{mean:.4f}:s{std:.4f}:e{float(-(p * np.log2(p)).sum()) + 0.0:.4f}:{np.packbits(bits).tobytes().hex()}"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _manifests(store, root: str) -> list[str]:
    from pyarrow import fs

    return sorted(i.path for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.base_name.startswith(MANIFEST))


def _archives(store, manifest: str) -> dict[str, int]:
    with store.open_input_stream(manifest) as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


@dataclass
class ByteRange(InputPartition):
    name: str
    start: int
    end: int


class MediaArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        names, stream, archive, seq = [], None, None, 0

        def close() -> None:
            if archive is not None:
                archive.close()
                stream.close()

        for batch in iterator:
            for part in common.by_size(batch, "media", BATCH_BYTES):
                for doc_id, n, media in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if archive is None or archive.fp.tell() >= ARCHIVE_BYTES:
                        close()
                        names.append(f"part-{uuid.uuid4().hex}.zip")
                        stream = store.open_output_stream(f"{root}/{names[-1]}")
                        archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                    info = zipfile.ZipInfo(f"{seq}_{'null' if doc_id is None else doc_id}_{n}.png")
                    archive.writestr(info, media)
                    seq += 1
        close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        sizes = {i.base_name: i.size for m in messages if m for i in store.get_file_info([f"{root}/{n}" for n in m.names])}
        old = _manifests(store, root) if self.overwrite else []
        with store.open_output_stream(f"{root}/{MANIFEST}{time.time_ns():020d}-{uuid.uuid4().hex}") as f:
            f.write(json.dumps(sizes, sort_keys=True).encode())
        for manifest in old:
            gone = _archives(store, manifest)
            store.delete_file(manifest)
            for name in gone:
                store.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{root}/{name}")


class MediaArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[ByteRange]:
        store, root = _store(self.path)
        sizes = {name: size for m in _manifests(store, root) for name, size in _archives(store, m).items()}
        step = max(self.range_bytes, -(-sum(sizes.values()) // MOST_RANGES))
        return [ByteRange(name, a, min(a + step, size)) for name, size in sorted(sizes.items()) for a in range(0, size, step)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, root = _store(self.path)
        opened: list = []

        def archive(again: bool = False) -> zipfile.ZipFile:
            if again and opened:
                opened.pop().close()
            if not opened:
                opened.append(zipfile.ZipFile(store.open_input_file(f"{root}/{partition.name}")))
            return opened[0]

        members = sorted((m for m in archive().infolist() if partition.start <= m.header_offset < partition.end), key=lambda m: m.header_offset)
        rows: list[tuple] = []
        held = 0
        for m in members:
            media = read_member(archive, m)
            _, doc_id, n = m.filename.removesuffix(".png").split("_")
            rows.append((None if doc_id == "null" else int(doc_id), int(n), media))
            held += len(media)
            if held >= BATCH_BYTES or len(rows) >= 4096:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)
        if opened:
            opened.pop().close()


def read_member(archive, member: zipfile.ZipInfo, tries: int = TRIES, wait: float = 0.05) -> bytes:
    """One member's bytes, checked by its CRC; after a failure the archive is opened anew and this member alone read again."""
    for k in range(tries):
        try:
            return archive(again=k > 0).read(member)
        except (OSError, zipfile.BadZipFile, zlib.error, EOFError):
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)
    raise AssertionError("no tries")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n_bytes", "media"])


class MediaArchive(DataSource):
    """Options: ``path``, a folder's URI; ``rangeBytes``, bytes a partition."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaArchiveReader:
        return MediaArchiveReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> MediaArchiveWriter:
        return MediaArchiveWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaArchive)


def _media(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_size(batch):
                texts = common.byte_texts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode_png(payload_of(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return common.columns_of(docs, "doc_id", "text").transform(common.map_arrow, run, SCHEMA)


def store_documents(docs: DataFrame, path: str | None = None, mode: str = "append") -> str:
    """Write the texts of ``docs(doc_id, text)`` to an archive directory, after those there or (``overwrite``) instead of them; its URI."""
    spark = docs.sparkSession
    register(spark)
    path = path or common.scratch_path(spark, "media")
    if "://" not in path:
        path = path.replace("file:", "file://", 1) if path.startswith("file:/") else f"file://{path}"
    _media(docs).write.format("media_archive").mode(mode).option("path", path).save()
    return path


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``doc_id, n_bytes, media`` of an archive directory."""
    register(spark)
    return spark.read.format("media_archive").option("path", path).option("rangeBytes", str(range_bytes)).load()


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes give, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for m in batch.column(2).to_pylist():
                p = decode_png(m)
                for o, v in zip(out, (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(p)), strict=True):
                    o.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(o, t) for o, t in zip(out, kinds, strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", F.col("media")).transform(common.map_arrow, run, schema)


