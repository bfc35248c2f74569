"""Clusters and topics."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import index
from tessera.sources import scratch


def kmeans(vectors: DataFrame, k: int = 5, seed: int = 1) -> DataFrame:
    """``vec_id, cluster`` by cosine k-means."""
    from pyspark.ml.clustering import KMeans

    rows = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, distanceMeasure="cosine").fit(rows).transform(rows).select("vec_id", F.col("prediction").alias("cluster"))


def silhouette(vectors: DataFrame, clusters: DataFrame) -> float:
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows = vectors.join(clusters, "vec_id").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("cluster").alias("prediction"))
    return ClusteringEvaluator(distanceMeasure="cosine").evaluate(rows)


def class_terms(docs: DataFrame, cluster: str, k: int = 10) -> DataFrame:
    """``cluster, term, score``: class-based TF-IDF, tf * ln(1 + mean tokens per class / cf)."""
    rows = docs.select(F.col(cluster).alias("cluster"), F.explode(text.lexical("text")).alias("term")).groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("tf"))
    cf = rows.groupBy("term").agg(F.sum("tf").alias("cf"))
    per = rows.agg((F.sum("tf") / F.countDistinct("cluster")).alias("m")).scalar()
    from pyspark.sql import Window as W

    scored = rows.join(cf, "term").select("cluster", "term", F.round(F.col("tf") * F.log(1 + per / F.col("cf")), 6).alias("score"))
    return scored.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("score"), "term"))).where(F.col("r") <= k).drop("r")


def lda(docs: DataFrame, k: int = 4, rounds: int = 10, seed: int = 1, vocabulary: int = 5000):
    """(model, ``doc_id, topicDistribution``, words) of an LDA on terms in two documents or more and half of them at most."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizerModel

    stats = index.term_stats(index.postings(docs)).where((F.col("df") >= 2) & (F.col("df") <= docs.count() / 2))
    words = [r["term"] for r in stats.orderBy(F.desc("cf"), "term").limit(vocabulary).collect()]
    if not words:
        raise ValueError("no term stands in two documents or more and half of them at most")
    # Counts are saved once: rounds read them again, and a CountVectorizer's fit keeps all tokens in memory.
    counter = CountVectorizerModel.from_vocabulary(words, inputCol="w", outputCol="features")
    counts = scratch.saved(counter.transform(index.tokens(docs)).select("doc_id", "features"), "counts")
    model = LDA(k=k, maxIter=rounds, seed=seed).fit(counts)
    return model, model.transform(counts).select("doc_id", "topicDistribution"), words


def agglomerate(vectors: np.ndarray, k: int, linkage: str = "complete") -> np.ndarray:
    """Bottom-up clusters of a few vectors by cosine; for samples, as it compares all of them."""
    x = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    sim = x @ x.T
    groups = [[i] for i in range(len(x))]
    fold = {"single": np.max, "complete": np.min, "average": np.mean}[linkage]
    while len(groups) > max(1, k):
        best = max(((fold(sim[np.ix_(groups[i], groups[j])]), -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups))))
        i, j = -best[1], -best[2]
        groups[i] += groups.pop(j)
    out = np.zeros(len(x), dtype=int)
    for g, members in enumerate(groups):
        out[members] = g
    return out


def star_clusters(terms: list[str], threshold: float = 0.7) -> dict[str, str]:
    """term -> centre: each term in order joins the first centre that it resembles by normalised edit distance, or becomes one."""
    def alike(a: str, b: str) -> float:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return 1 - row[-1] / max(len(a), len(b), 1)

    centres: list[str] = []
    out = {}
    for t in terms:
        out[t] = next((c for c in centres if alike(t, c) >= threshold), t)
        if out[t] == t:
            centres.append(t)
    return out


def cooccurrence(docs: DataFrame, terms: list[str], least: int = 2) -> DataFrame:
    """``a, b, n``: documents that hold both of two of the terms."""
    rows = index.matches(docs, terms).select("doc_id", "term")
    pairs = rows.select("doc_id", F.col("term").alias("a")).join(rows.select("doc_id", F.col("term").alias("b")), "doc_id").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def hierarchical(vectors: DataFrame, k: int, linkage: str = "complete", most: int = 500) -> DataFrame:
    """``vec_id, cluster`` of a sample of at most ``most`` vectors, bottom-up; the method compares all of them, so more is an error."""
    rows = vectors.select("vec_id", "embedding").orderBy("vec_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"hierarchical clusters are for samples of {most} vectors at most")
    got = agglomerate(np.array([r["embedding"] for r in rows], dtype=float), k, linkage) if rows else []
    return vectors.sparkSession.createDataFrame([(r["vec_id"], int(c)) for r, c in zip(rows, got, strict=True)], "vec_id long, cluster int")


def hierarchical_groups(vectors: DataFrame, by: str, k: int, linkage: str = "average") -> DataFrame:
    """``vec_id, by, cluster``: all vectors, whose groups (a few) are joined bottom-up by the cosine of their means."""
    unit = vectors.select("vec_id", by, F.posexplode("embedding").alias("i", "x"))
    means = unit.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("embedding"))
    groups = means.select(F.col(by).cast("long").alias("vec_id"), "embedding")
    named = hierarchical(groups, k, linkage).select(F.col("vec_id").alias("_g"), "cluster")
    return vectors.select("vec_id", by).join(F.broadcast(named), F.col(by).cast("long") == F.col("_g")).drop("_g")


def silhouette_by_label(vectors: DataFrame, label: str = "label") -> DataFrame:
    """``label, n, silhouette``: the mean over each group by cosine distance, of all vectors against all groups.

    The mean distance to a group is one minus the product with the group's mean
    unit vector, so the work is vectors times groups. A vector alone in its group has 0.
    """
    x = F.col("embedding").cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    unit = vectors.select("vec_id", F.col(label).alias("own"), F.transform(x, lambda v: v / F.sqrt(dot(x, x))).alias("e"))
    parts = unit.select("own", F.posexplode("e").alias("i", "v")).groupBy("own", "i").agg(F.sum("v").alias("s"))
    sums = parts.groupBy("own").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("s"))
    groups = sums.join(unit.groupBy("own").agg(F.count(F.lit(1)).alias("n")), "own").select(F.col("own").alias("other"), "s", "n")
    pairs = unit.join(F.broadcast(groups))  # groups are few
    near, same = dot(F.col("e"), F.col("s")), F.col("own") == F.col("other")
    d = F.when(same, F.when(F.col("n") > 1, (F.col("n") - near) / (F.col("n") - 1)).otherwise(0.0)).otherwise(1 - near / F.col("n"))
    per = pairs.withColumn("d", d).groupBy("vec_id", "own").agg(F.min(F.when(~same, F.col("d"))).alias("b"), F.min(F.when(same, F.col("d"))).alias("a"), F.min(F.when(same, F.col("n"))).alias("n"))
    s = F.when(F.col("n") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.groupBy(F.col("own").alias(label)).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 6).alias("silhouette"))


def term_clusters(stats: DataFrame, k: int = 40, threshold: float = 0.7) -> DataFrame:
    """``term, centre``: star clusters of the k most frequent terms, in that order."""
    terms = [r["term"] for r in stats.orderBy(F.desc("cf"), "term").limit(k).collect()]
    return stats.sparkSession.createDataFrame(sorted(star_clusters(terms, threshold).items()), "term string, centre string")


def lda_topics(docs: DataFrame, k: int = 4, words: int = 10) -> DataFrame:
    """``doc_id, topic, weight``: each document's strongest topic with its rounded weight; a document without words has none (-1)."""
    model, rows, _ = lda(docs, k)
    from pyspark.ml.functions import vector_to_array

    v = vector_to_array("topicDistribution")
    best = F.array_max(F.transform(v, lambda x, i: F.struct(F.round(x, 4).alias("w"), (-i).alias("i"))))
    return rows.select("doc_id", best.alias("b")).select("doc_id", F.when(F.col("b.w") > 0, -F.col("b.i")).otherwise(-1).alias("topic"), F.col("b.w").alias("weight"))


def topic_words(docs: DataFrame, k: int = 4, words: int = 10) -> DataFrame:
    """``topic, rank, word, weight`` of an LDA model."""
    model, _, vocabulary = lda(docs, k)
    names = F.array(*[F.lit(w) for w in vocabulary])
    rows = model.describeTopics(words).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "p"))
    return rows.select("topic", (F.col("pos") + 1).alias("rank"), F.element_at(names, F.col("p.termIndices") + 1).alias("word"), F.round("p.termWeights", 6).alias("weight"))


def kmeans_report(vectors: DataFrame, k: int = 5) -> DataFrame:
    """``vec_id, cluster, similarity``: the cosine with the mean of the own cluster."""
    got = vectors.select("vec_id", "embedding").join(kmeans(vectors, k), "vec_id")
    x = F.col("embedding").cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    unit = got.select("vec_id", "cluster", F.transform(x, lambda v: v / F.sqrt(dot(x, x))).alias("e"))
    means = unit.select("cluster", F.posexplode("e").alias("i", "v")).groupBy("cluster", "i").agg(F.avg("v").alias("m"))
    centres = means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("c"))
    return unit.join(F.broadcast(centres), "cluster").select("vec_id", "cluster", F.round(dot(F.col("e"), F.col("c")) / F.sqrt(dot(F.col("c"), F.col("c"))), 6).alias("similarity"))


def assign_topics(vectors: DataFrame, topics: DataFrame, least: float = 0.2) -> DataFrame:
    """``vec_id, topic, similarity``: the nearest of a few topic vectors ``topic, embedding`` by cosine; -1 below ``least``."""
    x, t = F.col("embedding").cast("array<double>"), F.col("e").cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    pairs = vectors.select("vec_id", "embedding").join(F.broadcast(topics.select("topic", F.col("embedding").alias("e"))))  # topics are few
    s = F.round(dot(x, t) / F.sqrt(dot(x, x) * dot(t, t)), 6)
    best = pairs.withColumn("s", s).groupBy("vec_id").agg(F.max(F.struct("s", (-F.col("topic")).alias("t"))).alias("b"))
    return best.select("vec_id", F.when(F.col("b.s") >= least, (-F.col("b.t")).cast("int")).otherwise(F.lit(-1)).alias("topic"), F.col("b.s").alias("similarity"))


def group_means(vectors: DataFrame, label: str = "label") -> DataFrame:
    """``topic, embedding``: the mean vector of each label."""
    parts = vectors.select(F.col(label).alias("topic"), F.posexplode("embedding").alias("i", "x")).groupBy("topic", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("embedding"))
