"""Language identification by the nearest of several clustered centroids per language.

A text becomes a TF-IDF vector of its letter 1-, 2- and 3-grams (hashed to
``dims`` places, sublinear counts, unit length). Each language's training
vectors are clustered by spherical k-means; a text takes the language of the
centroid with the highest cosine. A text farther from its centroid than nearly
every training text of it is marked ``rejected``; it keeps its nearest language.

Fitting reads a sample of about ``per_language`` labelled rows of each language
(chosen by a hash of the id: the documented bound); prediction reads every row.

Defined results: null text, empty text and text without a letter give ``und``
with score 0; repeated rows are each predicted; equal texts get equal values;
with no usable training row every text is ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_NOT_LETTERS = regex.compile(r"\P{L}+")
#: Sharpness of the softmax over languages that makes the score.
SHARPNESS = 25.0


@dataclass
class CentroidModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    reach: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.idf)


def gram_counts(texts: list[str], dims: int) -> np.ndarray:
    """A row of hashed letter n-gram counts for each text."""
    clean = [" " + _NOT_LETTERS.sub(" ", t.lower()).strip() + " " for t in texts]
    code = np.frombuffer(" ".join(clean).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(clean)), [len(c) + 1 for c in clean])[: len(code)]
    space = code == 32
    out = np.zeros(len(clean) * dims, dtype=np.float32)
    h = code
    for n in (1, 2, 3):
        if len(code) < n:
            break
        if n == 1:
            good = ~space
        else:
            h = h[:-1] * np.uint64(1_000_003) + code[n - 1 :]
            pairs = space[:-1] & space[1:]
            good = ~pairs if n == 2 else ~(pairs[:-1] | pairs[1:])
        slot = (common.mix(h[good] + np.uint64(n << 56)) & np.uint64(dims - 1)).astype(np.int64)
        out += np.bincount(doc[: len(h)][good] * dims + slot, minlength=len(out))
    return out.reshape(len(clean), dims)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centres spread by farthest-first choice from the mean, then refined."""
    near = x @ _unit(x.mean(axis=0, keepdims=True))[0]
    chosen = [int(np.argmax(near))]
    best = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[chosen[-1]])
    centres = x[chosen].copy()
    for _ in range(rounds):
        of = np.argmax(x @ centres.T, axis=1)
        for j in range(len(centres)):
            if (of == j).any():
                centres[j] = x[of == j].mean(axis=0)
        centres = _unit(centres)
    return centres, np.argmax(x @ centres.T, axis=1)


def fit(labelled: DataFrame, *, per_language: int = 300, clusters: int = 4, dims: int = 4096) -> CentroidModel:
    """Fit on ``labelled(doc_id, text, lang)``; null texts and langs are left out."""
    rows = common.columns_of(labelled, "doc_id", "text", "lang").where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return CentroidModel([], np.ones(dims, dtype=np.float32), np.zeros((0, dims), dtype=np.float32), np.zeros(0, dtype=int), np.zeros(0))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1 << 30, int((1 << 30) * per_language / n)))) for k, n in counts.items()])
    sample = rows.where(place < share).groupBy("doc_id").agg(F.min_by(F.struct("text", "lang"), F.struct("text", "lang")).alias("one")).select("one.*")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_size(batch, rows=128):
                got = gram_counts(part.column(0).to_pylist(), dims)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([r.tobytes() for r in got.astype(np.float32)], pa.binary())], names=["lang", "counts"])

    got = sample.select("text", "lang").transform(common.map_arrow, vectors, "lang string, counts binary").toArrow()
    langs = np.array(got.column("lang").to_pylist())
    tf = np.frombuffer(b"".join(got.column("counts").to_pylist()), dtype=np.float32).reshape(-1, dims)
    order = np.lexsort((tf @ np.arange(1, dims + 1, dtype=np.float32), langs))  # the rows' order must not matter
    langs, tf = langs[order], tf[order]
    use = tf.sum(axis=1) > 0
    langs, tf = langs[use], tf[use]
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
    x = _unit(np.log1p(tf) * idf)
    languages, centroids, owner, reach = sorted(set(langs.tolist())), [], [], []
    for i, name in enumerate(languages):
        mine = x[langs == name]
        centres, of = _spherical_kmeans(mine, clusters)
        for j, c in enumerate(centres):
            far = 1 - mine[of == j] @ c
            centroids.append(c)
            owner.append(i)
            reach.append(float(np.quantile(far, 0.995)) * 1.15 if len(far) else 0.0)
    return CentroidModel(languages, idf, np.array(centroids, dtype=np.float32).reshape(-1, dims), np.array(owner, dtype=int), np.array(reach))


def classify(model: CentroidModel, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, distance to the nearest centroid, and whether that is too far."""
    tf = gram_counts(texts, model.dims)
    known = (tf.sum(axis=1) > 0) & bool(model.languages)
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts)), np.ones(len(texts), dtype=bool)
    sims = _unit(np.log1p(tf) * model.idf) @ model.centroids.T
    best = np.stack([sims[:, model.owner == i].max(axis=1) for i in range(len(model.languages))], axis=1)
    pick, nearest = best.argmax(axis=1), sims.argmax(axis=1)
    e = np.exp(SHARPNESS * (best - best.max(axis=1, keepdims=True)).astype(np.float64))
    far = 1 - sims.max(axis=1).astype(np.float64)
    score = np.where(known, 1 / e.sum(axis=1), 0.0)
    return [model.languages[p] if k else "und" for p, k in zip(pick, known, strict=True)], score, far, ~known | (far > model.reach[nearest])


def predict(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """``doc_id, lang_pred, score, distance, rejected`` for every row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x clusters x dims floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_size(batch, rows=128):
                lang, score, far, rejected = classify(shared.value, [t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "distance", "rejected"])

    return common.columns_of(docs, "doc_id", "text").transform(common.map_arrow, run, "doc_id long, lang_pred string, score double, distance double, rejected boolean")
