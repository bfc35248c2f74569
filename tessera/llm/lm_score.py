"""Cross-entropy difference of matched n-gram models.

A target model and a background model have one vocabulary (all words of both
corpora and of the scored texts, A-Z lower-cased), one order (2) and one
smoothing; every pair of words counts, those held once too. A word's probability
after another is a mixture of its bigram estimate, its unigram estimate and the
uniform one. Each
token of a document loses -log p under both; the mean of (background loss -
target loss) over its tokens is the document's score: higher is nearer to the
target.

Counts cover every row and are exact but for collisions of 64-bit hashes of words
and of pairs. They travel in packed messages instead of rows:

1. Texts become blocks of about ``BLOCK_BYTES``: the distinct words of a block and
   its tokens as places in that list. Blocks are a scratch table, compressed.
2. A block's distinct words and pairs, counted, are sorted and cut by ranges of
   the hash into buckets; each (block, bucket) is one message. The block has
   summed its own, so a word or pair of all texts comes once a block.
3. A bucket adds up what its blocks sent, and answers each scored block with the
   places of the keys whose totals differ from what the block itself counted, and
   those totals. A pair that one block alone holds needs no answer.
4. A block and its answers meet again; losses are whole numbers of 1e-9 for each
   distinct pair and are summed by document, so sums don't depend on an order.

The number of buckets follows the number of tokens, so that a bucket has about
``BUCKET_KEYS`` keys whatever the input; there are never more messages than keys.

Defined results: null and empty texts have no tokens, null losses and score 0;
equal texts get equal values; an empty corpus gives the uniform model; ids may be
null or repeated, one result a row; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Weights of the bigram, unigram and uniform estimates.
MIXTURE = (0.5, 0.45, 0.05)
#: Losses are kept as multiples of 1 / SCALE.
SCALE = 10**9
#: Bytes of text and rows of a block, besides a longer text; keys of a bucket, about.
BLOCK_BYTES, BLOCK_ROWS, BUCKET_KEYS = 8 << 20, 1 << 17, 1_500_000
#: Stands before a text's first word.
START = np.uint64(0x5851F42D4C957F2D)
#: Bits by which the left neighbour is rotated in a pair's key.
TURN = 29

BLOCK_SCHEMA = "block long, t int, n int, scored boolean, doc_ids array<long>, tokens long, texts long, lengths binary, words binary, places binary"


def pack(values: np.ndarray) -> bytes:
    """An array's bytes, those of equal weight together, compressed."""
    raw = np.ascontiguousarray(values)
    planes = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, raw.itemsize).T).tobytes() if len(raw) else b""
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind) if size else np.zeros(0, dtype=kind)


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences of ascending values; ``np.cumsum`` undoes it."""
    return np.diff(values, prepend=values.dtype.type(0))


def _blocks(corpus: DataFrame, t: int, n: int, scored: bool) -> DataFrame:
    """Blocks of ``corpus(doc_id, text)``, counted ``t`` times for the target and ``n`` times for the background."""
    most = BLOCK_BYTES

    def block(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        words = common.Words([x.lower() for x in texts])
        distinct, place, many = np.unique(words.hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-many, kind="stable")  # frequent words have small places, which compress well
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        lengths = np.diff(words.offsets).astype(np.uint32)
        row = [uuid.uuid4().int >> 65, t, n, scored, ids if scored else [], len(place), int((lengths > 0).sum()), pack(lengths), pack(distinct[order]), pack(rank[place])]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), common.byte_texts(batch.column(1)), strict=True):
                if ids and (held + len(x) > most or len(ids) >= BLOCK_ROWS):
                    yield block(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(x)
                held += len(x)
        if ids:
            yield block(ids, texts)

    return corpus.transform(common.map_arrow, run, BLOCK_SCHEMA)


class Grams:
    """A block's words, tokens and distinct pairs, each pair with its left word's place (-1: it begins a text) and its word's."""

    def __init__(self, lengths: bytes, words: bytes, places: bytes):
        self.lengths, self.words, self.places = unpack(lengths, np.uint32).astype(np.int64), unpack(words, np.uint64), unpack(places, np.uint32).astype(np.int64)
        self.many = np.bincount(self.places, minlength=len(self.words))
        left = np.empty_like(self.places)
        left[1:] = self.places[:-1]
        ends = np.cumsum(self.lengths)
        left[(ends - self.lengths)[self.lengths > 0]] = -1
        before = np.append(self.words, START)[left]
        pair = common.mix(((before << np.uint64(TURN)) | (before >> np.uint64(64 - TURN))) ^ self.words[self.places])
        self.pairs, first, self.pair_of, self.pairs_many = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        self.left, self.right = left[first], self.places[first]
        self.order = np.argsort(self.words, kind="stable")  # words by their hash


def _cuts(keys: np.ndarray, buckets: int) -> list[int]:
    """Where each bucket's part of the sorted keys ends."""
    return np.searchsorted(keys, np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets)).tolist() + [len(keys)]


def _messages(blocks: DataFrame, buckets: int) -> DataFrame:
    """What each block sends to each bucket: its words and pairs of that range, and how often it holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                g = Grams(r["lengths"], r["words"], r["places"])
                words, many = g.words[g.order], g.many[g.order]
                rows: list[tuple] = []
                a = c = held = 0
                for k, (b, d) in enumerate(zip(_cuts(words, buckets), _cuts(g.pairs, buckets), strict=True)):
                    if b > a or d > c:
                        packed = [pack(_steps(words[a:b])), pack(many[a:b].astype(np.uint32)), pack(_steps(g.pairs[c:d])), pack(g.pairs_many[c:d].astype(np.uint32))]
                        rows.append((k, r["block"], r["t"], r["n"], r["scored"], *packed))
                        held += sum(map(len, packed))
                    a, c = b, d
                    if rows and (held > common.BATCH_BYTES or k == buckets - 1):
                        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], names=names)

    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()] + [pa.binary()] * 4
    names = ["bucket", "block", "t", "n", "scored", "words", "many", "pairs", "pairs_many"]
    return blocks.select("block", "t", "n", "scored", "lengths", "words", "places").transform(common.map_arrow, run, "bucket int, block long, t int, n int, scored boolean, words binary, many binary, pairs binary, pairs_many binary")


def _totals(keys: list[np.ndarray], many: list[np.ndarray], t: list[int], n: list[int]) -> tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The number of distinct keys; for each message the places, and both totals there, of keys that others hold too."""
    sizes = [len(k) for k in keys]
    every = np.concatenate(keys)
    one, at = np.unique(every, return_inverse=True)
    own = [np.concatenate([m.astype(np.int64) * r for m, r in zip(many, role, strict=True)]) for role in (t, n)]
    total = []
    for x in own:
        total.append(np.bincount(at, weights=x, minlength=len(one)).astype(np.int64)[at])  # exact up to 2**53
    news = (total[0] != own[0]) | (total[1] != own[1])
    out, lo = [], 0
    for size in sizes:
        p = np.flatnonzero(news[lo : lo + size])
        out.append((p, total[0][lo + p], total[1][lo + p]))
        lo += size
    return len(one), out


def _answers(messages: DataFrame) -> DataFrame:
    """``block, bucket, vocabulary`` and packed places and totals; a row with a null block has the bucket's number of words."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        t, n = [r["t"] for r in rows], [r["n"] for r in rows]
        words, of_words = _totals([np.cumsum(unpack(r["words"], np.uint64), dtype=np.uint64) for r in rows], [unpack(r["many"], np.uint32) for r in rows], t, n)
        _, of_pairs = _totals([np.cumsum(unpack(r["pairs"], np.uint64), dtype=np.uint64) for r in rows], [unpack(r["pairs_many"], np.uint32) for r in rows], t, n)
        out: list[tuple] = [(None, rows[0]["bucket"], words, *[None] * 6)]
        for r, w, p in zip(rows, of_words, of_pairs, strict=True):
            if r["scored"] and (len(w[0]) or len(p[0])):
                packed = [pack(x) for places, a, b in (w, p) for x in (_steps(places.astype(np.uint32)), a, b)]
                out.append((r["block"], r["bucket"], None, *packed))
        return pa.table({c: pa.array([x[i] for x in out], k) for i, (c, k) in enumerate(zip(names, [pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * 6, strict=True))})

    names = ["block", "bucket", "vocabulary", "words", "words_t", "words_n", "pairs", "pairs_t", "pairs_n"]
    return messages.groupBy("bucket").applyInArrow(run, "block long, bucket int, vocabulary long, " + ", ".join(f"{c} binary" for c in names[3:]))


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * SCALE).astype(np.int64)


def losses_of(g: Grams, words: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], totals: tuple[int, int], starts: tuple[int, int], vocabulary: int) -> list[np.ndarray]:
    """Each document's summed loss under both models, from the totals of the block's words and pairs."""
    uniform, out = 1.0 / max(1, vocabulary), []
    for word, pair, total, start in zip(words, pairs, totals, starts, strict=True):
        plain = MIXTURE[1] * (word / total if total else np.full(len(word), uniform)) + MIXTURE[2] * uniform
        left = np.append(word, start)[g.left]
        gain = np.log1p(MIXTURE[0] * pair / np.maximum(left, 1) / plain[g.right])
        loss = _whole(-np.log(plain))[g.right] - _whole(gain)
        up = np.zeros(len(g.pair_of) + 1, dtype=np.int64)
        np.cumsum(loss[g.pair_of], out=up[1:])
        ends = np.cumsum(g.lengths)
        out.append(up[ends] - up[ends - g.lengths])
    return out


def score(docs: DataFrame, target: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` of every row of ``docs(doc_id, text)``.

    ``target(text)`` and ``background(text)`` are the corpora; without a
    background, ``docs`` is.
    """
    spark = docs.sparkSession
    nobody = F.lit(None).cast("long").alias("doc_id")
    ids = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    blocks = _blocks(docs.select(*ids), 0, int(background is None), True).unionByName(_blocks(target.select(nobody, "text"), 1, 0, False))
    if background is not None:
        blocks = blocks.unionByName(_blocks(background.select(nobody, "text"), 0, 1, False))
    blocks = common.save(blocks, "blocks")
    sums = blocks.agg(*[F.coalesce(F.sum(F.col(c) * F.col(r)), F.lit(0)).alias(f"{c}_{r}") for c in ("tokens", "texts") for r in ("t", "n")], F.coalesce(F.sum("tokens"), F.lit(0)).alias("all")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(sums["all"] / BUCKET_KEYS))
    answers = common.save(_answers(_messages(blocks, buckets)), "answers")
    vocabulary = int(answers.where("block is null").agg(F.sum("vocabulary")).first()[0] or 0)
    totals, starts = (tuple(int(sums[f"{c}_{r}"]) for r in ("t", "n")) for c in ("tokens", "texts"))
    names = ["words", "words_t", "words_n", "pairs", "pairs_t", "pairs_n"]

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["bucket"] is None)
        g = Grams(own["lengths"], own["words"], own["places"])
        sorted_words = g.words[g.order]
        word = [g.many * own[r] for r in ("t", "n")]
        pair = [g.pairs_many * own[r] for r in ("t", "n")]
        word_starts, pair_starts = ([0, *_cuts(x, buckets)] for x in (sorted_words, g.pairs))
        for r in rows:
            if r["bucket"] is not None:
                for kind, into, begin in (("words", word, word_starts), ("pairs", pair, pair_starts)):
                    at = begin[r["bucket"]] + np.cumsum(unpack(r[kind], np.uint32), dtype=np.int64)
                    at = g.order[at] if kind == "words" else at
                    for x, c in zip(into, ("t", "n"), strict=True):
                        x[at] = unpack(r[f"{kind}_{c}"], np.int64)
        target_loss, background_loss = losses_of(g, tuple(word), tuple(pair), totals, starts, vocabulary)
        many = np.maximum(g.lengths, 1)
        none = pa.array(g.lengths == 0)
        mean = lambda x: np.round(x / many / SCALE, 9)
        nulls = pa.nulls(len(many), pa.float64())
        parts = [pa.compute.if_else(none, nulls, pa.array(mean(x))) for x in (target_loss, background_loss)]
        return pa.table({"doc_id": pa.array(own["doc_ids"], pa.int64()), "n_tokens": pa.array(g.lengths), "target_loss": parts[0], "background_loss": parts[1], "score": pa.array(mean(background_loss - target_loss) + 0.0)})

    empty = {c: F.lit(None).cast("binary").alias(c) for c in ("lengths", "places", *names)}
    payload = blocks.where("scored").select("block", F.lit(None).cast("int").alias("bucket"), "t", "n", "doc_ids", "lengths", "places", "words", *[empty[c] for c in names[1:]])
    sent = answers.where("block is not null").select("block", "bucket", *[F.lit(None).cast("int").alias(c) for c in ("t", "n")], F.lit(None).cast("array<long>").alias("doc_ids"), empty["lengths"], empty["places"], *names)
    return payload.unionByName(sent).groupBy("block").applyInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def brute_force(texts: list[str | None], target: list[str | None], background: list[str | None]) -> list[tuple[int, float | None, float | None]]:
    """(tokens, target loss, background loss) of each text by plain loops, for tests."""

    def pairs(text: str | None) -> list[tuple[bytes, bytes]]:
        words = (text or "").encode().lower().split()
        return list(zip([b" ", *words], words, strict=False))

    corpora = [[p for x in corpus for p in pairs(x)] for corpus in (target, background)]
    v = len({w for corpus in (*corpora, [p for x in texts for p in pairs(x)]) for _, w in corpus})
    models = [(Counter(c), Counter([w for _, w in c] + [b for b, _ in c if b == b" "]), len(c)) for c in corpora]

    def loss(model: tuple[Counter, Counter, int], b: bytes, w: bytes) -> float:
        pair, word, total = model
        bi = pair[b, w] / max(1, word[b])
        return -math.log(MIXTURE[0] * bi + MIXTURE[1] * (word[w] / total if total else 1 / v) + MIXTURE[2] / v)

    out = []
    for text in texts:
        own = pairs(text)
        out.append((len(own), *[sum(loss(m, *p) for p in own) / len(own) if own else None for m in models]))
    return out
