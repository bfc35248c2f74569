"""Removal of repeated word windows with a log-structured fingerprint index.

A window is ``window`` consecutive words of one text. Every word of a window
that also starts anywhere else is removed; windows are judged on the input.

1. Fingerprints. Each window is filed under its minimizer: the smallest hash of
   the ``gram``-word runs in it. Equal windows have equal minimizers, and a
   minimizer serves many neighbouring windows, so the index holds a few
   hundredths of the windows and misses none.
2. Index. ``FingerprintIndex`` keeps sorted immutable runs of postings ``(fp, k,
   ta, copies)``. A new batch becomes a run and is merge-joined with the runs
   before it; its fingerprints that are repeated, in the batch or since before,
   are what the join returns. Only they go on.
3. Verification. Windows whose minimizer is repeated are hashed in full (two
   64-bit hashes) and counted, in the batch's texts and in the older ones that
   the index names.
4. Removal. Texts with counted windows are read once more and cut. Then the index
   is compacted, level by level.

Rows with equal texts are collapsed beforehand: each of their windows is
repeated by definition, so one of them stands for all with weight two.

``find_repeats`` without an index splits its input into batches of its own. With
an ``index`` of earlier input and that input as ``history``, the new rows alone
are indexed, judged and cut; older rows stay as they are.

Defined results: a null or empty text has no words and loses none; a text with
fewer than ``window`` words loses none; ids may be null or repeated; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 35
GRAM = 8
#: Runs of one level that are compacted into one of the next.
FAN_IN = 4
#: Copies of a repeated text's count, so that no task holds all rows of a text.
SALTS = 16
#: Stands for a null id in joins, beside the text's hash.
NO_ID = -(1 << 63)

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def identity() -> list[Column]:
    """A row's join key: its id (null has a stand-in) and two hashes of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(text).alias("ta"), F.xxhash64(F.lit(1), text).alias("tb")]


POSTING = "fp long, k long, ta long, copies int"


class FingerprintIndex:
    """Sorted immutable runs of postings ``(fp, k, ta, copies)`` in the shared folder, newest last.

    ``folder``: where a list of the runs is kept, so that a later session opens the same index.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fan_in: int = FAN_IN):
        self.spark, self.folder, self.fan_in = spark, folder, fan_in
        self.runs: list[tuple[int, DataFrame, str]] = []
        self.garbage: list[str] = []
        if folder and common.exists(spark, f"{folder}/runs"):
            for r in spark.read.schema("place int, level int, path string").json(f"{folder}/runs").orderBy("place").collect():  # the runs, not their rows
                self.runs.append((r["level"], spark.read.schema(POSTING).parquet(r["path"]), r["path"]))

    def _write(self, rows: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.folder}/run-{uuid.uuid4().hex}" if self.folder else common.scratch_path(self.spark, "run")
        rows.select("fp", "k", "ta", F.col("copies").cast("int").alias("copies")).repartition("fp").sortWithinPartitions("fp").write.parquet(path)
        common.release(self.spark)
        return self.spark.read.schema(POSTING).parquet(path), path

    def _list(self) -> None:
        if self.folder:
            rows = [(i, level, path) for i, (level, _, path) in enumerate(self.runs)]
            self.spark.createDataFrame(rows, "place int, level int, path string").coalesce(1).write.mode("overwrite").json(f"{self.folder}/runs")

    def postings(self) -> DataFrame:
        out = self.spark.createDataFrame([], POSTING)
        for _, run, _ in self.runs:
            out = out.unionByName(run)
        return out

    def add(self, batch: DataFrame) -> DataFrame:
        """File a batch of postings; return its fingerprints ``fp`` that are repeated, within it or by an older run, as a scratch table."""
        before = self.postings().select("fp").distinct().withColumn("old", F.lit(True)) if self.runs else None
        run, path = self._write(batch)
        now = run.groupBy("fp").agg(F.sum("copies").alias("n"))
        met = now.withColumn("old", F.lit(None).cast("boolean")) if before is None else now.join(before.hint("merge"), "fp", "left")
        seen = common.save(met.where("n >= 2 or old").select("fp"), "seen")
        self.runs.append((0, run, path))
        self._list()
        return seen

    def matched(self, seen: DataFrame) -> DataFrame:
        """``k, ta, copies, repeated`` of the texts, new or old, that hold fingerprints in ``seen``."""
        return self.postings().join(seen.hint("merge"), "fp").groupBy("k", "ta").agg(F.max("copies").alias("copies"), F.collect_set("fp").alias("repeated"))

    def compact(self, everything: bool = False) -> None:
        """Merge runs where a level is full, or all of them; old runs go only after the list names the new one."""
        while True:
            for level in sorted({lv for lv, _, _ in self.runs}):
                mine = [r for r in self.runs if everything or r[0] == level]
                if len(mine) >= (2 if everything else self.fan_in):
                    merged = mine[0][1]
                    for _, run, _ in mine[1:]:
                        merged = merged.unionByName(run)
                    out, path = self._write(merged)
                    self.runs = [r for r in self.runs if r not in mine] + [(max(r[0] for r in mine) + 1, out, path)]
                    self._list()
                    common.remove(self.spark, *[p for _, _, p in mine])
                    break
            else:
                return

    def delete(self) -> None:
        common.remove(self.spark, *[p for _, _, p in self.runs])
        self.runs = []


def minimizers(words: common.Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The minimizer of each window, 0 where no single text holds the window; and which gram positions are some window's minimizer."""
    grams = common.sequence_hashes(words.hashes, gram) | np.uint64(1)
    span = window - gram + 1
    if len(words.hashes) < window:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(grams), dtype=bool)
    least = common.window_extreme(grams, span, largest=False)
    least = np.where(common.in_one_text(words.offsets, window), least, np.uint64(0))
    edge = np.zeros(span - 1, dtype=np.uint64)
    return least, common.window_extreme(np.concatenate([edge, least, edge]), span, largest=True) == grams


def window_hashes(words: common.Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every window."""
    return common.sequence_hashes(words.hashes, window), common.sequence_hashes(common.mix(words.hashes ^ common.MIX_A), window)


def _kept(words: common.Words, i: int, drop: np.ndarray) -> bytes:
    """Text i's words that stay, joined by one space."""
    lo, hi = words.offsets[i], words.offsets[i + 1]
    text = words.data[words.starts[lo] : words.ends[hi - 1]] if hi > lo else b""
    split = text.split()
    return b" ".join(split if not drop.any() else [w for w, d in zip(split, drop.tolist(), strict=True) if not d])


def _signatures(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``k, ta, tb, n_words, sha, anchors`` of each row; an anchor is listed as often as it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_size(batch):
                words = common.Words(common.byte_texts(part.column(3)))
                grams = common.sequence_hashes(words.hashes, gram) | np.uint64(1)
                _, chosen = minimizers(words, window, gram)
                at = np.flatnonzero(chosen)
                none = np.zeros(0, dtype=bool)
                sha = [hashlib.sha256(_kept(words, i, none)).digest() for i in range(len(part))]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, words.offsets).astype(np.int32)), pa.array(grams[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.diff(words.offsets), pa.int64()), pa.array(sha, pa.binary()), lists], names=["k", "ta", "tb", "n_words", "sha", "anchors"])

    return docs.select(*identity(), "text").transform(common.map_arrow, run, "k long, ta long, tb long, n_words long, sha binary, anchors array<long>")


def _candidate_windows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """``k, ta, w1, w2, n`` of the windows whose minimizer is in the text's ``repeated`` list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_size(batch):
                words = common.Words(common.byte_texts(part.column(3)))
                least, _ = minimizers(words, window, gram)
                w1, w2 = window_hashes(words, window)
                k, ta, copies = (np.asarray(part.column(j)) for j in (0, 1, 2))
                marks = part.column(4).to_pylist()
                got = []
                for i in range(len(part)):
                    lo, hi = int(words.offsets[i]), int(words.offsets[i + 1]) - window + 1
                    if hi <= lo:
                        continue
                    at = lo + np.flatnonzero(np.isin(least[lo:hi], np.array(marks[i], dtype=np.int64).view(np.uint64)))
                    _, first, n = np.unique(w1[at], return_index=True, return_counts=True)
                    got.append((np.full(len(first), i), at[first], n * copies[i]))
                if got:
                    row, at, n = (np.concatenate(x) for x in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(k[row]), pa.array(ta[row]), pa.array(w1[at].view(np.int64)), pa.array(w2[at].view(np.int64)), pa.array(n.astype(np.int64))], names=["k", "ta", "w1", "w2", "n"])

    return texts.select("k", "ta", "copies", "text", "repeated").transform(common.map_arrow, run, "k long, ta long, w1 long, w2 long, n long")


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """``k, ta, n_removed, kept`` of texts with their repeated windows ``w``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_size(batch):
                words = common.Words(common.byte_texts(part.column(2)))
                w1 = common.sequence_hashes(words.hashes, window)
                marks = part.column(3).to_pylist()
                removed, kept = [], []
                for i in range(len(part)):
                    lo, hi = int(words.offsets[i]), int(words.offsets[i + 1])
                    hit = np.isin(w1[lo : hi - window + 1], np.array(marks[i], dtype=np.int64).view(np.uint64)) if hi - lo >= window else np.zeros(0, dtype=bool)
                    edge = np.zeros(hi - lo + 1, dtype=np.int64)
                    edge[: len(hit)] += hit
                    if len(hit):
                        edge[window : window + len(hit)] -= hit
                    drop = np.cumsum(edge[:-1]) > 0
                    removed.append(int(drop.sum()))
                    kept.append(_kept(words, i, drop))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["k", "ta", "n_removed", "kept"])

    return texts.select("k", "ta", "text", "w").transform(common.map_arrow, run, "k long, ta long, n_removed long, kept string")


def find_repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, batches: int = 2, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, cuts) for ``docs(doc_id, text)``.

    facts: ``k, ta, tb, n_words, sha, copies`` of each row; a row with copies > 1
    and at least ``window`` words loses all its words. cuts: ``k, ta, n_removed,
    kept`` of the other rows that lose words. Both are scratch tables.

    ``index``: one that holds earlier input, which ``history(doc_id, text)`` is;
    this input is added to it as one batch.
    """
    spark = docs.sparkSession
    docs = common.columns_of(docs, "doc_id", "text")
    facts = common.save(_signatures(docs, window, gram), "signatures")
    texts = facts.groupBy("ta", "tb").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("copies"), F.any_value("anchors").alias("anchors"))
    anchors = common.save(texts.where(F.size("anchors") > 0).select("k", "ta", F.least("copies", F.lit(2)).cast("int").alias("copies"), F.explode("anchors").alias("fp")), "anchors")
    own = index or FingerprintIndex(spark)
    if index is not None:
        seen = index.add(anchors)
    else:
        parts = [own.add(anchors.where(F.pmod("ta", F.lit(batches)) == b)) for b in range(batches)]
        seen = parts[0]
        for part in parts[1:]:
            seen = seen.unionByName(part)
        seen = common.save(seen.distinct(), "seen")  # written, so that the join below can split a frequent fingerprint
        common.remove(spark, *parts)
    common.remove(spark, anchors)
    marked = common.save(own.matched(seen), "marked")
    common.remove(spark, seen)
    if index is None:
        own.delete()
    every = docs.select(*identity(), "text", F.lit(True).alias("fresh"))
    if history is not None:
        every = every.unionByName(common.columns_of(history, "doc_id", "text").select(*identity(), "text", F.lit(False).alias("fresh")))
    likely = common.with_members(every, "ta", marked)
    candidates = common.save(likely.join(marked.hint("merge"), ["k", "ta"]), "candidates")
    common.remove(spark, marked)
    # The windows are hashed twice from the few candidates rather than written out.
    twice = common.save(_candidate_windows(candidates, window, gram).groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n >= 2").select("w1", "w2"), "twice")
    single = candidates.where("copies = 1 and fresh")
    hits = common.save(_candidate_windows(single, window, gram).select("k", "ta", "w1", "w2").join(twice.hint("merge"), ["w1", "w2"]).groupBy("k", "ta").agg(F.collect_set("w1").alias("w")), "hits")
    common.remove(spark, twice)
    cuts = common.save(_cut(single.join(hits, ["k", "ta"]), window), "cuts")
    common.remove(spark, candidates, hits)
    if index is not None:
        index.compact()
    # Rows of one text may be many: each meets one of SALTS copies of its text's count. Texts of one row need none.
    counts = facts.groupBy("ta", "tb").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = facts.select("k", "ta", "tb", "n_words", "sha", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    return salted.join(counts, ["ta", "tb", "salt"], "left").select("k", "ta", "tb", "n_words", "sha", F.coalesce("copies", F.lit(1)).alias("copies")), cuts


def dedup(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each row."""
    window = how.get("window", WINDOW)
    facts, cuts = find_repeats(docs, **how)
    gone = (F.col("copies") > 1) & (F.col("n_words") >= window)
    return (
        facts.join(cuts.select("k", "ta", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("cut_sha")).dropDuplicates(["k", "ta"]), ["k", "ta"], "left")
        .select(
            F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"),
            "n_words",
            F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(gone, F.lit(EMPTY_SHA)).otherwise(F.coalesce("cut_sha", F.lower(F.hex("sha")))).alias("kept_sha256"),
        )
    )


def clean(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the repeated windows cut out of ``text``; texts without any stay as they are."""
    window = how.get("window", WINDOW)
    facts, cuts = find_repeats(docs, **how)
    gone = facts.where((F.col("copies") > 1) & (F.col("n_words") >= window)).select("k", "ta", F.lit("").alias("kept"))
    change = gone.unionByName(cuts.where("n_removed > 0").select("k", "ta", "kept")).dropDuplicates(["k", "ta"])
    k, ta, _ = identity()
    keyed = docs.select("*", k.alias("__k"), ta.alias("__ta"))
    change = change.select(F.col("k").alias("__k"), F.col("ta").alias("__ta"), F.col("kept").alias("__kept"))
    own = [F.coalesce("__kept", "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return keyed.join(change, ["__k", "__ta"], "left").select(*own)


def brute_force(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple[int | None, int, int, str]]:
    """The same by plain loops, for tests."""
    words = [(t or "").encode().split() for _, t in rows]
    seen: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        drop = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                drop[i : i + window] = [True] * window
        kept = b" ".join(x for x, d in zip(w, drop, strict=True) if not d)
        out.append((doc_id, len(w), sum(drop), hashlib.sha256(kept).hexdigest()))
    return out
