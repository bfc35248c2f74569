"""Ranking models. A query is a list of terms; each scorer gives ``doc_id, score``, ties to the smaller id."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tessera.operators import index
from tessera.sources import scratch

DIGITS = 6


def _n(docs: DataFrame) -> Column:
    return docs.agg(F.count(F.lit(1)).cast("double")).scalar()


def _avgdl(docs: DataFrame) -> Column:
    """Tokens are counted for it, not taken out of the text."""
    return docs.agg(F.avg(index.text.lexical_count("text"))).scalar()


def _query(docs: DataFrame, terms: list[str]) -> DataFrame:
    return F.broadcast(docs.sparkSession.createDataFrame(sorted(Counter(terms).items()), "term string, qtf int"))  # the query's own terms


def _hits(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Matches with ``df`` and ``qtf``; df has one row a query term."""
    hits = index.matches(docs, terms)
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return hits.join(F.broadcast(df), "term").join(_query(docs, terms), "term")


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best after rounding, with their rank."""
    best = scores.select("doc_id", F.round("score", DIGITS).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
    return best.select("doc_id", "score", F.row_number().over(W.orderBy(F.desc("score"), "doc_id")).alias("rank"))


# term weighting

def tf_weight(scheme: str, tf: Column, largest: Column | None = None) -> Column:
    return {"n": tf.cast("double"), "l": 1 + F.log10(tf), "a": 0.5 + 0.5 * tf / (largest if largest is not None else tf), "b": F.lit(1.0)}[scheme]


def idf_weight(scheme: str, n: Column, df: Column) -> Column:
    return {"n": F.lit(1.0), "t": F.log10(n / df), "p": F.when(df >= n, 0.0).otherwise(F.log10((n - df) / df))}[scheme]


def doc_vectors(docs: DataFrame, scheme: str = "ltc") -> DataFrame:
    """``doc_id, term, w``: SMART-weighted vectors without weights of 0 or less."""
    post = index.postings(docs)
    own = W.partitionBy("doc_id")
    stats = index.term_stats(post)
    weighted = post.join(stats, "term").select("doc_id", "term", (tf_weight(scheme[0], F.col("tf"), F.max("tf").over(own)) * idf_weight(scheme[1], _n(docs), F.col("df"))).alias("w")).where("w > 0")
    return weighted if scheme[2] != "c" else weighted.select("doc_id", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(own))).alias("w"))


def top_terms(docs: DataFrame, k: int = 5, most: int = 1 << 18) -> DataFrame:
    """The k best terms of each document by (1 + log10 tf) * log10(N / df).

    The df of the ``most`` most frequent terms are sent to all tasks. There each of a
    document's terms has a weight, or bounds by the df that it can have, and only what
    may be among the k best goes on: the few other terms get their df by a join.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = docs.sparkSession
    stats = scratch.saved(index.corpus_stats(docs), "terms")
    known, least = index.most_frequent(stats, most)
    n = max(docs.count(), 1)
    sent = spark.sparkContext.broadcast((known.column("term").combine_chunks(), np.append(np.asarray(known.column("df"), dtype=np.int64), 0)))

    def run(ids: pa.Array, w: pa.ListArray) -> pa.RecordBatch:
        row, code, tf, terms = index.counted(w)
        names, dfs = sent.value
        df = dfs[np.asarray(pc.index_in(terms, value_set=names).fill_null(len(names)))][code]  # 0: not known
        part = 1 + np.log10(tf)
        low, high = part * np.log10(n / np.where(df > 0, df, max(least - 1, 1))), part * np.log10(n / np.maximum(df, 1))
        order = np.lexsort((-low, row))
        first = np.searchsorted(row, np.arange(len(w)))  # rows ascend
        size = np.diff(np.append(first, len(row)))
        floor = np.full(len(w), -np.inf)
        full = size >= k
        floor[full] = low[order[first[full] + k - 1]]
        stay = np.flatnonzero(high >= floor[row] - 4 * 10.0**-DIGITS)  # what may be equal after rounding stays
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row[stay])), terms.take(pa.array(code[stay])), pa.array(tf[stay].astype(np.int32)), pa.array(df[stay])], names=["doc_id", "term", "tf", "df"])

    rows = scratch.saved(index.by_part(docs, run, StructType([docs.schema["doc_id"], StructField("term", StringType()), StructField("tf", IntegerType()), StructField("df", LongType())])), "best")
    others = rows.where("df = 0").drop("df").join(stats.select("term", "df"), "term")
    w = rows.where("df > 0").unionByName(others).select("doc_id", "term", F.round((1 + F.log10("tf")) * F.log10(_n(docs) / F.col("df")), DIGITS).alias("w"))
    return w.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("w"), "term"))).where(F.col("rank") <= k)


def vsm(docs: DataFrame, terms: list[str], k: int = 10, query_idf: bool = False) -> DataFrame:
    """Cosine of ltc documents and an lnc (or ltc) query."""
    vec = doc_vectors(docs)
    q = _query(docs, terms).select("term", (1 + F.log10("qtf")).alias("qw"))
    if query_idf:
        df = index.matches(docs, terms).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        q = q.join(F.broadcast(df), "term").select("term", (F.col("qw") * F.log10(_n(docs) / F.col("df"))).alias("qw"))
    norm = q.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw")))).scalar()
    scores = vec.join(F.broadcast(q), "term").groupBy("doc_id").agg((F.sum(F.col("w") * F.col("qw")) / norm).alias("score"))
    return top(scores.where("score > 0"), k)


def similar_documents(docs: DataFrame, doc_id: int, k: int = 10) -> DataFrame:
    """Cosine of one document's vector with all others; its terms are the small side."""
    vec = doc_vectors(docs)
    own = vec.where(F.col("doc_id") == doc_id).select("term", F.col("w").alias("qw"))
    return top(vec.where(F.col("doc_id") != doc_id).join(own, "term").groupBy("doc_id").agg(F.sum(F.col("w") * F.col("qw")).alias("score")).where("score > 0"), k)


# probabilistic models

def bm25_parts(docs: DataFrame, terms: list[str], k1: float = 1.5, b: float = 0.75, delta: float = 0.0) -> DataFrame:
    """``doc_id, term, tf, df, idf, part``: what each term gives each document."""
    idf = F.log((_n(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    length = 1 - b + b * F.col("dl") / _avgdl(docs)
    part = F.col("qtf") * F.col("idf") * (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length) + delta)
    return _hits(docs, terms).withColumn("idf", idf).withColumn("part", part).select("doc_id", "term", "tf", "df", "idf", "part")


def bm25(docs: DataFrame, terms: list[str], k: int = 10, **how: float) -> DataFrame:
    scores = bm25_parts(docs, terms, **how).groupBy("doc_id").agg(F.sum("part").alias("score"))
    return top(scores.where("score > 0"), k)


def bm25_explain(docs: DataFrame, terms: list[str], doc_id: int) -> DataFrame:
    return bm25_parts(docs, terms).where(F.col("doc_id") == doc_id).select("term", "tf", "df", F.round("idf", 4).alias("idf"), F.round("part", 4).alias("score"))


def bm25_batch(docs: DataFrame, queries: DataFrame, k: int = 10, block: int = 1024) -> DataFrame:
    """``query_id, rank, doc_id, score`` for many queries ``query_id, text`` in one plan.

    Queries are broadcast in blocks of ``block`` with their terms' weights. A task
    scores its documents against a block as a product of two matrices and keeps k a
    query, so a frequent term gives no row for each document and no hot key.
    """
    import numpy as np
    import pyarrow as pa

    spark = docs.sparkSession
    q = queries.select("query_id", F.explode(index.text.lexical("text")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    df = index.tokens(docs).select(F.explode(F.array_distinct("w")).alias("term")).join(q.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((_n(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = q.join(df, "term").select("query_id", "term", (F.col("qtf") * idf).alias("w"))
    avgdl = float(docs.select(_avgdl(docs).alias("a")).limit(1).first()["a"] or 1.0) if not docs.isEmpty() else 1.0
    ids = [r[0] for r in q.select("query_id").distinct().orderBy("query_id").collect()]  # the queries' ids
    best = None
    for at in range(0, max(len(ids), 1), block):
        own = ids[at : at + block]
        rows = weights.where(F.col("query_id").between(own[0], own[-1]) if own else F.lit(False)).toArrow()  # terms of `block` queries
        terms, col = np.unique(np.asarray(rows.column("term").to_pylist(), dtype=object).astype(str), return_inverse=True)
        matrix = np.zeros((len(own), len(terms)))
        place = {i: n for n, i in enumerate(own)}
        matrix[[place[i] for i in rows.column("query_id").to_pylist()], col] = rows.column("w").to_numpy()
        shared = spark.sparkContext.broadcast((own, {t: n for n, t in enumerate(terms.tolist())}, matrix))

        def run(batches, shared=shared):
            own, known, matrix = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows if own else 0, 512):
                    part = batch.slice(lo, 512)
                    tf = np.zeros((len(known), part.num_rows))
                    dl = np.zeros(part.num_rows)
                    for j, w in enumerate(part.column(1).to_pylist()):
                        dl[j] = len(w)
                        for t, n in Counter(w).items():
                            if t in known:
                                tf[known[t], j] = n
                    s = np.round(matrix @ _gain(tf, dl, avgdl), DIGITS)
                    some = matrix.astype(bool) @ (tf > 0)
                    s[~some] = -np.inf
                    take = min(k, part.num_rows)
                    # All that tie with the k-th stay; the window breaks ties by id.
                    kth = -np.partition(-s, take - 1, axis=1)[:, take - 1]
                    i, j = np.nonzero((s >= kth[:, None]) & np.isfinite(s))
                    doc_ids = np.asarray(part.column(0))
                    yield pa.RecordBatch.from_arrays([pa.array([own[x] for x in i.tolist()], pa.int64()), pa.array(doc_ids[j]), pa.array(s[i, j])], names=["query_id", "doc_id", "score"])

        found = index.tokens(docs.where("doc_id is not null")).mapInArrow(run, "query_id long, doc_id long, score double")
        best = found if best is None else best.unionByName(found)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return ranked.where(F.col("rank") <= k)


def _gain(tf, dl, avgdl: float):
    """BM25's part of the term frequency, for terms by documents."""
    return tf * 2.5 / (tf + (1.5 * (0.25 + 0.75 * dl / avgdl))[None, :])


def term_bounds(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``term, df, max_tf, upper``: the most that a term can add to a BM25 score."""
    parts = bm25_parts(docs, terms)
    return parts.groupBy("term", "df").agg(F.max("tf").alias("max_tf"), F.round(F.max("part"), DIGITS).alias("upper"))


def _smoothed(method: str, lam: float, mu: float, delta: float) -> Column:
    tf, dl, pc = F.coalesce(F.col("tf"), F.lit(0)), F.col("dl"), F.col("pc")
    return {
        "jm": F.when(dl > 0, lam * tf / dl).otherwise(0.0) + (1 - lam) * pc,
        "dirichlet": (tf + mu * pc) / (dl + mu),
        "absolute": F.when(dl > 0, F.greatest(tf - delta, F.lit(0.0)) / dl + delta * F.col("uniq") / dl * pc).otherwise(pc),
    }[method]


def language_model(docs: DataFrame, terms: list[str], method: str = "jm", k: int = 10, *, lam: float = 0.7, mu: float = 2000.0, delta: float = 0.7, candidates_only: bool = False) -> DataFrame:
    """Sum of ln P(term | document) over the query's terms, for all documents or for those with a term."""
    stats = index.doc_stats(docs)
    collection = stats.agg(F.sum("dl").cast("double")).scalar()
    hits = index.matches(docs, terms)
    cf = hits.groupBy("term").agg(F.sum("tf").alias("cf"))
    vocabulary = index.tokens(docs).select(F.explode("w").alias("t")).agg(F.countDistinct("t").cast("double")).scalar()
    q = _query(docs, terms).join(F.broadcast(cf), "term", "left").select("term", "qtf", F.coalesce(F.col("cf") / collection, 1 / vocabulary).alias("pc"))
    every = stats.join(hits.select("doc_id").distinct(), "doc_id", "left_semi") if candidates_only else stats
    grid = every.withColumn("term", F.explode(F.array(*[F.lit(t) for t in dict.fromkeys(terms)]))).join(F.broadcast(q), "term")
    p = _smoothed(method, lam, mu, delta)
    scored = grid.join(hits.select("doc_id", "term", "tf"), ["doc_id", "term"], "left").withColumn("p", p)
    return top(scored.groupBy("doc_id").agg(F.sum(F.col("qtf") * F.log(F.when(F.col("p") > 0, F.col("p")).otherwise(1e-10))).alias("score")), k)


def lm_divergence(docs: DataFrame, terms: list[str], k: int = 10, lam: float = 0.7) -> DataFrame:
    """Minus the Kullback-Leibler divergence of the query's model from each document's (JM), documents with a term."""
    stats = index.doc_stats(docs)
    collection = stats.agg(F.sum("dl").cast("double")).scalar()
    hits = index.matches(docs, terms)
    cf = hits.groupBy("term").agg(F.sum("tf").alias("cf"))
    q = _query(docs, terms).join(F.broadcast(cf), "term").select("term", (F.col("qtf") / F.lit(float(len(terms)))).alias("pq"), (F.col("cf") / collection).alias("pc"))
    every = hits.select("doc_id", "dl").distinct().withColumn("term", F.explode(F.array(*[F.lit(t) for t in dict.fromkeys(terms)]))).join(F.broadcast(q), "term")
    p = lam * F.coalesce(F.col("tf"), F.lit(0)) / F.col("dl") + (1 - lam) * F.col("pc")
    scored = every.join(hits.select("doc_id", "term", "tf"), ["doc_id", "term"], "left").withColumn("p", p)
    return top(scored.groupBy("doc_id").agg((-F.sum(F.col("pq") * F.log(F.col("pq") / F.col("p")))).alias("score")), k)


def bim(docs: DataFrame, terms: list[str], k: int = 10, relevant: list[int] | None = None) -> DataFrame:
    """Retrieval status values of the binary independence model; with ``relevant`` ids the Robertson-Sparck Jones weights."""
    hits = _hits(docs, terms)
    n = _n(docs)
    if relevant is None:
        w = F.greatest(F.lit(0.0), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        rows = hits.withColumn("w", w)
    else:
        r = hits.where(F.col("doc_id").isin(relevant)).groupBy("term").agg(F.count(F.lit(1)).alias("r"))
        big = F.lit(float(len(relevant)))
        rr = F.coalesce("r", F.lit(0))
        p, q = (rr + 0.5) / (big + 1), (F.col("df") - rr + 0.5) / (n - big + 1)
        rows = hits.join(F.broadcast(r), "term", "left").withColumn("w", F.log(p * (1 - q) / ((1 - p) * q)))
    return top(rows.groupBy("doc_id").agg(F.sum("w").alias("score")).where("score > 0"), k)


# dense vectors

def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dense(vectors: DataFrame, vec_id: int, k: int = 10, where: Column | None = None) -> DataFrame:
    """The k vectors nearest to one by cosine."""
    q = vectors.where(F.col("vec_id") == vec_id).agg(F.max("embedding")).scalar()
    rows = vectors.where(F.col("vec_id") != vec_id)
    rows = rows if where is None else rows.where(where)
    scored = rows.withColumn("q", q).select(F.col("vec_id").alias("doc_id"), cosine(F.col("embedding"), F.col("q")).alias("score"))
    return top(scored, k).withColumnRenamed("doc_id", "vec_id")


# fusion of runs ``model, doc_id, score``

def _normalised(runs: DataFrame, method: str) -> DataFrame:
    own = W.partitionBy("model")
    s, lo, hi = F.col("score"), F.min("score").over(own), F.max("score").over(own)
    mean, dev = F.avg("score").over(own), F.stddev_pop("score").over(own)
    value = {"minmax": F.when(hi == lo, 1.0).otherwise((s - lo) / (hi - lo)), "zscore": F.when(dev == 0, 0.0).otherwise((s - mean) / dev), "max": s / hi, "none": s}[method]
    return runs.withColumn("v", value)


def fuse(runs: DataFrame, method: str = "linear", weights: dict[str, float] | None = None, normalise: str = "minmax", k: int = 10) -> DataFrame:
    """``linear``, ``rrf``, ``combsum`` or ``combmnz``; weights default to equal shares."""
    if weights:
        w = F.coalesce(*[F.when(F.col("model") == m, F.lit(float(x))) for m, x in weights.items()], F.lit(0.0))
    else:
        w = 1 / runs.agg(F.countDistinct("model").cast("double")).scalar()
    if method == "rrf":
        place = F.row_number().over(W.partitionBy("model").orderBy(F.desc("score"), "doc_id"))
        scores = runs.withColumn("v", w / (60 + place)).groupBy("doc_id").agg(F.sum("v").alias("score"))
    elif method == "linear":
        scores = _normalised(runs, normalise).groupBy("doc_id").agg(F.sum(w * F.col("v")).alias("score"))
    else:
        many = F.count_if(F.col("score") > 0) if method == "combmnz" else F.lit(1)
        scores = runs.groupBy("doc_id").agg((F.sum(w * F.col("score")) * many).alias("score"))
    return top(scores, k)


def overlap(runs: DataFrame) -> DataFrame:
    """``a, b, shared``: common documents of each two models."""
    right = runs.select(F.col("model").alias("b"), "doc_id")
    return runs.select(F.col("model").alias("a"), "doc_id").join(right, "doc_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def rank_span(runs: DataFrame) -> DataFrame:
    """``doc_id, models, span`` of ranks over models, widest first."""
    return runs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("models"), (F.max("rank") - F.min("rank")).alias("span")).orderBy(F.desc("span"), "doc_id").limit(50)


# feedback

def rocchio(docs: DataFrame, terms: list[str], relevant: list[int], other: list[int] = (), *, alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.15, most: int = 10, least: float = 0.0) -> DataFrame:
    """``term, w, is_new``: alpha * query + beta * mean(relevant) - gamma * mean(others), at 0 or more; original terms and the best new ones."""
    vec = doc_vectors(docs)
    parts = _query(docs, terms).select("term", (F.lit(alpha) * F.col("qtf")).alias("w"))
    for ids, factor in ((relevant, beta), (other, -gamma)):
        if ids:
            parts = parts.unionByName(vec.where(F.col("doc_id").isin(list(ids))).select("term", (F.col("w") * F.lit(factor / len(ids))).alias("w")))
    sums = parts.groupBy("term").agg(F.round(F.sum("w"), DIGITS).alias("w")).where(F.col("w") > least).withColumn("is_new", ~F.col("term").isin(list(terms)))
    place = F.row_number().over(W.partitionBy("is_new").orderBy(F.desc("w"), "term"))
    return sums.withColumn("r", place).where(~F.col("is_new") | (F.col("r") <= most)).drop("r")


def expand_by_feedback(docs: DataFrame, terms: list[str], top_docs: int = 5, most: int = 10) -> DataFrame:
    """Rocchio on the best BM25 documents, which are few."""
    return rocchio(docs, terms, [r["doc_id"] for r in bm25(docs, terms, top_docs).collect()], most=most)


def field_boost(docs: DataFrame, terms: list[str], weights: dict[str, float], cap: float = 1.5) -> DataFrame:
    """``doc_id, boost``: field weight * min(term hits, 3), summed and capped."""
    post = index.field_postings(docs, list(weights)).where(F.col("term").isin(terms))
    hits = post.groupBy("doc_id", "field").agg(F.least(F.count(F.lit(1)), F.lit(3)).alias("hits"))
    w = F.coalesce(*[F.when(F.col("field") == f, F.lit(float(x))) for f, x in weights.items()])
    return hits.groupBy("doc_id").agg(F.round(F.least(F.sum(w * F.col("hits")), F.lit(cap)), DIGITS).alias("boost"))


def ltr_features(docs: DataFrame, labels: DataFrame, terms: list[str]) -> DataFrame:
    """``doc_id, bm25, dl, hits, label`` of labelled documents."""
    s = bm25_parts(docs, terms).groupBy("doc_id").agg(F.round(F.sum("part"), DIGITS).alias("bm25"), F.count(F.lit(1)).alias("hits"))
    return labels.select("doc_id", F.col("quality").alias("label")).join(index.doc_stats(docs), "doc_id").join(s, "doc_id", "left").select("doc_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), "dl", F.coalesce("hits", F.lit(0)).alias("hits"), "label")


def train_ltr(features: DataFrame):
    """A logistic model of the label on the features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["bm25", "dl", "hits"], outputCol="features").transform(features.withColumn("label", F.col("label").cast("double")))
    return LogisticRegression(maxIter=20, regParam=0.01).fit(rows), rows


# explanations, expansions, and models by name

def lm_explain(docs: DataFrame, terms: list[str], doc_id: int, lam: float = 0.7) -> DataFrame:
    """``term, tf, p_doc, p_collection, p, logp`` of a query under one document's model (JM)."""
    stats = index.doc_stats(docs)
    collection = stats.agg(F.sum("dl").cast("double")).scalar()
    hits = index.matches(docs, terms)
    cf = hits.groupBy("term").agg(F.sum("tf").alias("cf"))
    own = hits.where(F.col("doc_id") == doc_id).select("term", "tf")
    dl = stats.where(F.col("doc_id") == doc_id).agg(F.max("dl").cast("double")).scalar()
    rows = _query(docs, terms).join(F.broadcast(cf), "term").join(F.broadcast(own), "term", "left").withColumn("tf", F.coalesce("tf", F.lit(0)))
    p_doc, p_all = F.coalesce(F.try_divide(F.col("tf"), dl), F.lit(0.0)), F.col("cf") / collection
    p = lam * p_doc + (1 - lam) * p_all
    return rows.select("term", "tf", F.round(p_doc, 9).alias("p_doc"), F.round(p_all, 9).alias("p_collection"), F.round(p, 9).alias("p"), F.round(F.log(p), DIGITS).alias("logp"))


def bim_explain(docs: DataFrame, terms: list[str], doc_id: int) -> DataFrame:
    """``term, df, w``: the weight of each query term that one document has."""
    w = F.greatest(F.lit(0.0), F.log((_n(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return _hits(docs, terms).withColumn("w", F.round(w, DIGITS)).where(F.col("doc_id") == doc_id).select("term", "df", "w")


def bm25_log10(docs: DataFrame, term: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``doc_id, score``: one term's BM25 with idf = log10(N / df)."""
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / _avgdl(docs)))
    return _hits(docs, [term]).withColumn("s", F.log10(_n(docs) / F.col("df")) * gain).select("doc_id", F.round("s", DIGITS).alias("score"))


def expansions(docs: DataFrame, terms: list[str], how: str = "fuzzy", distance: int = 1, most: int = 50) -> DataFrame:
    """``term, w``: the vocabulary's terms that stand for a query term, ``most`` of each at most: ``fuzzy`` ones by 1 / (1 + edits), ``phonetic`` ones of equal sound by a half."""
    q = docs.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(terms)], "q string")
    vocabulary = index.tokens(docs).select(F.explode(F.array_distinct("w")).alias("term")).distinct()
    if how == "fuzzy":
        pairs = vocabulary.join(F.broadcast(q), (F.abs(F.length("term") - F.length("q")) <= distance) & (F.levenshtein(F.col("q"), F.col("term"), distance) >= 0))
        pairs = pairs.withColumn("d", F.levenshtein(F.col("q"), F.col("term"), distance)).withColumn("w", 1 / (1 + F.col("d")))
    else:
        same = F.soundex("term") == F.soundex("q")
        pairs = vocabulary.where(F.col("term").rlike("^[a-z]")).join(F.broadcast(q), same).withColumn("d", (F.col("term") != F.col("q")).cast("int")).withColumn("w", F.when(F.col("d") == 0, 1.0).otherwise(0.5))
    best = pairs.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("d", "term"))).where(F.col("r") <= most)
    return best.groupBy("term").agg(F.max("w").alias("w"))


def bm25_expanded(docs: DataFrame, terms: list[str], how: str = "fuzzy", k: int = 10) -> DataFrame:
    """BM25 over the expanded query, each term's part scaled by its weight."""
    wide = F.broadcast(expansions(docs, terms, how))  # at most 50 rows a query term
    hits = index.postings(docs).join(wide, "term")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((_n(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    gain = F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / _avgdl(docs)))
    rows = hits.join(F.broadcast(df), "term").join(index.doc_stats(docs).select("doc_id", "dl"), "doc_id")
    return top(rows.groupBy("doc_id").agg(F.sum(F.col("w") * idf * gain).alias("score")), k)


def rocchio_drift(docs: DataFrame, terms: list[str], relevant: list[int], other: list[int] = (), *, warn: float = 0.5) -> DataFrame:
    """``drift, drifted``: 1 - cosine of the query before and after Rocchio's expansion."""
    before = _query(docs, terms).select("term", F.col("qtf").cast("double").alias("q"))
    both = rocchio(docs, terms, relevant, other).join(before, "term", "full")
    x, y = F.coalesce("q", F.lit(0.0)), F.coalesce("w", F.lit(0.0))
    cos = F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y))
    return both.agg(F.round(1 - cos, DIGITS).alias("drift")).select("drift", (F.col("drift") > warn).alias("drifted"))


def suggest(docs: DataFrame, prefix: str, k: int = 10) -> DataFrame:
    """``term, df``: completions of a prefix, those of most documents first."""
    terms = index.tokens(docs).select(F.explode(F.array_distinct(F.filter("w", lambda t: t.startswith(prefix)))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(k)


def boolean_ranked(docs: DataFrame, query: str, k: int = 10) -> DataFrame:
    """``doc_id, score, rank`` of a boolean query's documents by the occurrences of its words; operators are no words."""
    import re

    from tessera.plans import query as plans

    words = sorted({w for w in re.findall(r"[一-鿿]+|[a-z0-9]+", re.sub(r"\b(AND|OR|NOT|NEAR/\d+)\b", " ", query).lower())})
    found = plans.Planner().run(docs, query)
    return top(index.tokens(found).select("doc_id", F.size(F.filter("w", lambda t: t.isin(words))).cast("double").alias("score")), k)


def with_attributes(found: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """Ranked rows with their documents' attributes; the k found rows are the small side."""
    return docs.select("doc_id", *columns).join(F.broadcast(found), "doc_id", "right")


def fuse_explain(runs: DataFrame, weights: dict[str, float], normalise: str = "minmax") -> DataFrame:
    """``doc_id, model, raw, scaled, part``: what each model adds to a document's fused score."""
    w = F.coalesce(*[F.when(F.col("model") == m, F.lit(float(x))) for m, x in weights.items()], F.lit(0.0))
    rows = _normalised(runs, normalise)
    return rows.select("doc_id", "model", F.round("score", DIGITS).alias("raw"), F.round("v", DIGITS).alias("scaled"), F.round(w * F.col("v"), DIGITS).alias("part"))


#: Models by name, each a function of documents, terms and k: another ranker is added by putting it here.
MODELS = {
    "bm25": bm25,
    "bm25+": lambda docs, terms, k=10: bm25(docs, terms, k, delta=1.0),
    "vsm": vsm,
    "lm": language_model,
    "lm-kl": lm_divergence,
    "bim": bim,
}


def dispatch(docs: DataFrame, model: str, terms: list[str], k: int = 10) -> DataFrame:
    """``model, doc_id, score, rank`` of one registered model."""
    if model not in MODELS:
        raise ValueError(f"no model {model!r}; there are {', '.join(sorted(MODELS))}")
    return MODELS[model](docs, terms, k).select(F.lit(model).alias("model"), "doc_id", "score", "rank")


def score_with(docs: DataFrame, terms: list[str], scorer, k: int = 10) -> DataFrame:
    """Ranks by any ``scorer(tf, dl, df, n) -> Column``, summed over the query's terms."""
    part = scorer(F.col("tf"), F.col("dl"), F.col("df"), _n(docs))
    return top(_hits(docs, terms).withColumn("part", F.col("qtf") * part).groupBy("doc_id").agg(F.sum("part").alias("score")), k)


def dense_batch(vectors: DataFrame, queries: Column, k: int = 5, block: int = 4096, step: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest by cosine of every vector that ``queries`` names.

    The query vectors are broadcast in blocks of ``block``, so what is broadcast
    at once is bounded; each task multiplies ``step`` rows at a time with a block and keeps k a query in all.
    """
    import numpy as np
    import pyarrow as pa

    ids = [r[0] for r in vectors.where(queries).select("vec_id").orderBy("vec_id").collect()]
    best = None
    for at in range(0, max(len(ids), 1), block):
        asked = vectors.where(queries & F.col("vec_id").between(ids[at], ids[min(at + block, len(ids)) - 1]) if ids else F.lit(False)).select("vec_id", "embedding").toArrow()
        q_ids = np.asarray(asked.column("vec_id"))
        q = _unit_rows(asked.column("embedding"), len(q_ids))
        shared = vectors.sparkSession.sparkContext.broadcast((q_ids, q))

        def run(batches, shared=shared):
            own, qv = shared.value
            top_s, top_i = np.full((len(own), k), -np.inf), np.full((len(own), k), np.iinfo(np.int64).max)
            for batch in batches if len(own) else ():
                for i in range(0, batch.num_rows, step):
                    cut = batch.slice(i, step)
                    c_ids = np.asarray(cut.column(0))
                    s = np.round(qv @ _unit_rows(cut.column(1), len(c_ids)).T, DIGITS)
                    s[own[:, None] == c_ids[None, :]] = -np.inf
                    take = min(k, len(c_ids))
                    # All that tie with the k-th are kept; ids break ties.
                    low = np.maximum(-np.partition(-s, take - 1, axis=1)[:, take - 1], top_s[:, -1])
                    r, c = np.nonzero((s >= low[:, None]) & np.isfinite(s))
                    keep_best(top_s, top_i, r, c_ids[c], s[r, c])
            r, c = np.nonzero(np.isfinite(top_s))
            yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(top_i[r, c]), pa.array(top_s[r, c])], names=["query_id", "vec_id", "score"])

        part = vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double")
        best = part if best is None else best.unionByName(part)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def keep_best(top_s, top_i, row, item, score) -> None:
    """Put (row, item, score) into the rows of ``top_s``, best first, and ``top_i``; equals go by item."""
    import numpy as np

    if not len(row):
        return
    k, touched = top_s.shape[1], np.unique(row)
    owner = np.concatenate([row, np.repeat(touched, k)])
    score = np.concatenate([score, top_s[touched].ravel()])
    item = np.concatenate([item.astype(np.int64), top_i[touched].ravel()])
    o = np.lexsort((item, -score, owner))
    slot = o[np.searchsorted(owner[o], touched)[:, None] + np.arange(k)[None, :]]
    top_s[touched], top_i[touched] = score[slot], item[slot]


def _unit_rows(column, n: int):
    import numpy as np

    flat = np.asarray(column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten(), dtype=np.float64)
    x = flat.reshape(n, -1) if n else flat.reshape(0, 0)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def hashed_vectors(docs: DataFrame, dims: int = 64) -> DataFrame:
    """``doc_id, slot, v``: unit vectors of hashed term counts, a text encoder that needs no model; slots and signs come from md5."""
    h = F.md5(F.col("term").cast("binary"))
    slot = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dims
    sign = F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    rows = index.postings(docs).select("doc_id", slot.alias("slot"), (sign * (1 + F.log(F.col("tf").cast("double")))).alias("x"))
    sums = rows.groupBy("doc_id", "slot").agg(F.sum("x").alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("doc_id")))
    return sums.select("doc_id", "slot", F.coalesce(F.try_divide(F.col("x"), norm), F.lit(0.0)).alias("v"))


def analysis_graph(found: DataFrame, query: str) -> DataFrame:
    """``source, target, kind, weight``: edges from a query to models and from models to their documents ``model, doc_id, score``."""
    models = found.select("model").distinct().select(F.lit(f"query:{query}").alias("source"), F.concat(F.lit("model:"), "model").alias("target"), F.lit("asked").alias("kind"), F.lit(None).cast("double").alias("weight"))
    docs = found.select(F.concat(F.lit("model:"), "model").alias("source"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("target"), F.lit("found").alias("kind"), F.col("score").alias("weight"))
    return models.unionByName(docs)


@dataclass(frozen=True)
class Ranker:
    """A model with its parameters, to be called like any entry of ``MODELS``."""

    model: str = "bm25"
    parameters: tuple[tuple[str, float], ...] = ()

    @classmethod
    def of(cls, model: str, **parameters: float) -> Ranker:
        if model not in MODELS:
            raise ValueError(f"no model {model!r}")
        return cls(model, tuple(sorted(parameters.items())))

    def __call__(self, docs: DataFrame, terms: list[str], k: int = 10) -> DataFrame:
        return MODELS[self.model](docs, terms, k, **dict(self.parameters))
