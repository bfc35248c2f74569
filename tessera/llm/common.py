"""What the operators of this subpackage share: scratch tables and word hashing.

Scratch tables are Parquet folders under ``spark.checkpoint.dir``, the folder
that every executor shares, so a lost executor never takes one with it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Odd multipliers of the polynomial hashes (mod 2**64) and of the mixer.
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
#: Bytes of text that one round of array work takes, besides a longer word.
BLOCK_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[tuple[int, bool], np.ndarray] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, an own one in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not in_one_process(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    What the write shuffled is then needed no more; collecting the driver's
    garbage lets Spark delete those files now, not at some later time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def in_one_process(spark: SparkSession) -> bool:
    """Whether the driver is the only executor."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def release(spark: SparkSession) -> None:
    """On a cluster, let Spark delete shuffle files that no plan holds any more: it does so when the driver's garbage is collected."""
    if not in_one_process(spark):
        spark._jvm.System.gc()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete scratch tables that no later plan reads."""
    for table in tables:
        paths = [table] if isinstance(table, str) else sorted({f.rpartition("/")[0] for f in table.inputFiles()})
        for path in paths:
            if "/tessera/" in path or "/run-" in path:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def remainder_of_id(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


def powers(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or those of its inverse."""
    key = (int(base), inverse)
    have = _powers.get(key)
    if have is None or len(have) < n:
        b = np.uint64(pow(int(base), -1, 1 << 64)) if inverse else base
        steps = np.full(max(n, BLOCK_BYTES + 8192), b, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 2 * BLOCK_BYTES:
            _powers[key] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that every bit depends on every bit."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def _block_hashes(arr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = _SPACE[arr]
    edge = np.empty(len(arr) + 1, dtype=bool)
    edge[0] = not space[0]
    edge[-1] = not space[-1]
    np.not_equal(space[1:], space[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    sums = np.zeros(len(arr) + 1, dtype=np.uint64)
    np.cumsum((arr.astype(np.uint64) + np.uint64(1)) * powers(BYTE_BASE, len(arr)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(BYTE_BASE, len(arr), inverse=True)[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * MIX_B)), starts, ends


class Words:
    """Words (runs without ASCII white space) of several texts: hashes, byte spans, and each text's range.

    ``hashes[offsets[i]:offsets[i + 1]]`` are those of text i; spans are byte
    positions in ``data``, the texts joined by line feeds.
    """

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        arr = np.frombuffer(self.data, dtype=np.uint8)
        parts, at = [], 0
        while at < len(arr):
            end = min(len(arr), at + BLOCK_BYTES)
            while end < len(arr) and not _SPACE[arr[end - 1]]:
                step = np.flatnonzero(_SPACE[arr[end : end + 4096]])
                end = min(len(arr), end + (int(step[0]) + 1 if len(step) else 4096))
            h, s, e = _block_hashes(arr[at:end])
            parts.append((h, s + at, e + at))
            at = end
        self.hashes, self.starts, self.ends = (np.concatenate(x) for x in zip(*parts, strict=True))
        first = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=first[1:])
        self.offsets = np.searchsorted(self.starts, first)


def sequence_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` consecutive elements."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(WORD_BASE, n), out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * powers(WORD_BASE, n - length + 1, inverse=True))


def in_one_text(offsets: np.ndarray, length: int) -> np.ndarray:
    """For each run of ``length`` elements, whether one text holds all of it."""
    n = int(offsets[-1])
    ok = np.zeros(max(0, n - length + 1), dtype=bool)
    lens = np.diff(offsets)
    good = lens >= length
    edge = np.zeros(len(ok) + 1, dtype=np.int32)
    np.add.at(edge, offsets[:-1][good], 1)
    np.add.at(edge, offsets[:-1][good] + lens[good] - length + 1, -1)
    return np.cumsum(edge[:-1]) > 0 if len(ok) else ok


def window_extreme(values: np.ndarray, width: int, largest: bool) -> np.ndarray:
    """The extreme of each ``width`` consecutive values, by doubling."""
    pick = np.maximum if largest else np.minimum
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column's UTF-8; null is the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def by_size(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; every row is in one."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if i > at and (held + size > most or i - at >= rows):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if at < len(sizes):
        yield batch.slice(at)


#: Bits of a membership filter: those for each key, up to a most (so 8 MB).
FILTER_BITS_A_KEY, FILTER_MOST_BITS, FILTER_PROBES, FILTER_PIECE = 16, 1 << 26, 4, 1 << 16


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    h = mix(keys.view(np.uint64))
    step = mix(h) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(FILTER_PROBES)])


def with_members(rows: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """The rows whose ``key`` (a long) may be among the members', by a Bloom filter.

    It spares a later join the shuffle of most other rows and loses none that
    match. Its size is bounded; beyond that many members it lets more rows by.
    """
    spark = rows.sparkSession
    n = members.count()
    bits = 1 << max(16, min(FILTER_MOST_BITS, max(1, n) * FILTER_BITS_A_KEY - 1).bit_length())
    bits = min(bits, FILTER_MOST_BITS)
    at = rows.columns.index(key)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(bits, dtype=bool)
        for batch in batches:
            mine[_probes(np.asarray(batch.column(0)), bits).ravel()] = True
        packed = np.packbits(mine)
        pieces = [packed[i : i + FILTER_PIECE] for i in range(0, len(packed), FILTER_PIECE)]
        used = [i for i, x in enumerate(pieces) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([pieces[i].tobytes() for i in used], pa.binary())], names=["piece", "bits"])

    def either(table: pa.Table) -> pa.Table:
        all_bits = np.bitwise_or.reduce(np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype=np.uint8).reshape(table.num_rows, -1), axis=0)
        return pa.table({"piece": table.column("piece")[:1].cast(pa.int32()), "bits": pa.array([all_bits.tobytes()], pa.binary())})

    pieces = members.select(key).transform(map_arrow, fold, "piece int, bits binary").groupBy("piece").applyInArrow(either, "piece int, bits binary").collect()  # `bits` / 8 bytes
    packed = np.zeros(max(bits // 8, 1), dtype=np.uint8)
    for r in pieces:
        packed[r["piece"] * FILTER_PIECE : (r["piece"] + 1) * FILTER_PIECE] = np.frombuffer(r["bits"], dtype=np.uint8)
    shared = spark.sparkContext.broadcast(packed)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            probe = _probes(np.asarray(batch.column(at)), bits).astype(np.int64)
            hit = ((table[probe >> 3] >> (7 - (probe & 7)).astype(np.uint8)) & 1).all(axis=0)
            yield batch.filter(pa.array(hit))

    return map_arrow(rows, keep, rows.schema)


#: Bytes of a batch that Spark hands to Python, unless the session has its own bound.
BATCH_BYTES, BATCH_BOUND = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over batches of bounded bytes: 10,000 long texts at once fill an executor's memory."""
    if df.sparkSession.conf.get(BATCH_BOUND, None) is None:
        df.sparkSession.conf.set(BATCH_BOUND, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])
