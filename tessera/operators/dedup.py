"""Exact duplicates, and near duplicates by 64-bit simhash."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.functions import text
from tessera.operators import index
from tessera.sources import scratch

#: Blocks of a fingerprint. Two at distance d agree in all but d blocks at least, so each choice of the others makes a key.
BLOCKS = 5
#: Tokens whose 64 signs are in memory at once.
TOKENS = 1 << 17


def exact(docs: DataFrame) -> DataFrame:
    """``doc_id, content_hash, first_id, is_duplicate``: the first id of each text is kept. Counts are partial before the shuffle."""
    rows = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("content_hash"))
    first = rows.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"))
    return rows.join(first, "content_hash").select("doc_id", "content_hash", "first_id", (F.col("doc_id") != F.col("first_id")).alias("is_duplicate"))


def new_rows(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """One row of each key that ``known`` doesn't have."""
    return rows.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, h``: ``text.simhash`` of each text, a batch of rows at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column(1)
            terms = w.flatten().dictionary_encode()
            bits = b"".join(md5(t.encode()).digest()[8:] for t in terms.dictionary.to_pylist())
            signs = np.unpackbits(np.frombuffer(bits, dtype=np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1
            code, owner = np.asarray(terms.indices), np.repeat(np.arange(len(w)), np.diff(np.asarray(w.offsets)))
            sums = np.zeros((len(w), 64), dtype=np.int64)
            for at in range(0, len(code), TOKENS):
                own = owner[at : at + TOKENS]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                sums[own[first]] += np.add.reduceat(signs[code[at : at + TOKENS]], first, axis=0, dtype=np.int32)
            h = np.packbits(sums > 0, axis=1).view(">i8").ravel().astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h)], names=["doc_id", "h"])

    return index.tokens(docs).mapInArrow(run, StructType([docs.schema["doc_id"], StructField("h", LongType())]))


def near_pairs(prints: DataFrame, distance: int = 3, blocks: int = BLOCKS) -> DataFrame:
    """``a, b, distance``: pairs within a Hamming distance below ``blocks``, found by equal blocks.

    With 5 blocks and distance 3 there are 10 keys of 25 bits or more for each
    fingerprint, so a key's rows stay few up to hundreds of millions of them; more
    blocks make longer keys, and more of them. Equal fingerprints are joined once,
    through the smallest id that has each.
    """
    from itertools import combinations

    if distance >= blocks:
        raise ValueError(f"{blocks} blocks find distances below {blocks}")
    one = prints.groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    chosen = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - distance)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    keys = F.array(*[F.struct(F.lit(i).alias("table"), F.col("h").bitwiseAND(F.lit(signed(m)).cast("long")).alias("v")) for i, m in enumerate(chosen)])
    rows = one.select("doc_id", "h", F.explode(keys).alias("p")).select("doc_id", "h", "p.table", "p.v")
    right = rows.select(F.col("doc_id").alias("b"), F.col("h").alias("hb"), "table", "v")
    d = text.hamming(F.col("h"), F.col("hb"))
    return rows.withColumnRenamed("doc_id", "a").join(right, ["table", "v"]).where((F.col("a") < F.col("b")) & (d <= distance)).select("a", "b", d.alias("distance")).distinct()


def near_rows(prints: DataFrame, distance: int = 3) -> DataFrame:
    """``near_pairs`` and, at distance 0, a row of each other document with the smallest id of its fingerprint: linear in the documents."""
    prints = scratch.saved(prints, "prints")
    one = prints.groupBy("h").agg(F.min("doc_id").alias("a"))
    members = prints.join(one.hint("merge"), "h").where("doc_id <> a").select("a", F.col("doc_id").alias("b"), F.lit(0).alias("distance"))
    return near_pairs(prints, distance).unionByName(members)


def greedy(docs: DataFrame, distance: int = 3) -> DataFrame:
    """``doc_id, kept``: in order of id, a document stays unless it is near one that stayed.

    A round settles the documents that no open pair has as its second: they stay,
    and those paired with them go. Rounds end when no pair is open, so chains of
    any length are settled, and each round reads the pairs that are still open.
    """
    prints = scratch.saved(fingerprints(docs), "prints")
    same = prints.groupBy("h").agg(F.min("doc_id").alias("rep"))
    pairs, gone = scratch.saved(near_pairs(prints, distance).select("a", "b"), "pairs"), None
    while not pairs.isEmpty():
        first = pairs.select("a").distinct().join(pairs.select(F.col("b").alias("a")), "a", "left_anti")
        out = scratch.saved(pairs.join(first, "a", "left_semi").select("b").distinct(), "gone")
        gone = out if gone is None else gone.unionByName(out)
        pairs = scratch.saved(pairs.join(out, "b", "left_anti").join(out.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b"), "pairs")
    rows = prints.join(same.hint("merge"), "h")
    if gone is None:
        return rows.select("doc_id", (F.col("doc_id") == F.col("rep")).alias("kept"))
    out = rows.join(gone.select(F.col("b").alias("rep"), F.lit(True).alias("gone")), "rep", "left")
    return out.select("doc_id", ((F.col("doc_id") == F.col("rep")) & F.col("gone").isNull()).alias("kept"))


def stats(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count(F.lit(1)).alias("documents"), F.count_if("is_duplicate").alias("duplicates"), F.countDistinct("content_hash").alias("texts"))


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")
