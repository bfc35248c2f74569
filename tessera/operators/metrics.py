"""Ranking evaluation. ``run(query_id, rank, doc_id)`` against ``qrels(query_id, doc_id, rel)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIGITS = 6


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with ``rel`` (0 where not judged), ``hit``, and running counts of hits and misses up to each rank."""
    rows = run.join(qrels.select("query_id", "doc_id", "rel"), ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    rows = rows.withColumn("hit", (F.col("rel") > 0).cast("int"))
    upto = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("hits", F.sum("hit").over(upto)).withColumn("misses", F.sum(1 - F.col("hit")).over(upto))


def _relevant(qrels: DataFrame) -> DataFrame:
    return qrels.groupBy("query_id").agg(F.count_if(F.col("rel") > 0).alias("r"))


def _r(x: Column, name: str, digits: int | None = DIGITS) -> Column:
    return (x if digits is None else F.round(x, digits)).alias(name)


def _dcg(gain: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), gain) - 1) / F.log2(rank + 1)


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10, p: float = 0.8, top_grade: float = 3.0, digits: int | None = DIGITS) -> DataFrame:
    """All metrics of each query of the run that has judgments; ``digits`` None leaves them unrounded."""
    rows = judged(run, qrels).join(_relevant(qrels), "query_id")
    at = F.col("rank") <= k
    n, r = F.count(F.lit(1)), F.first("r")
    stop = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.pow(F.lit(2.0), F.lit(top_grade))
    before = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("stop", stop).withColumn("go", F.coalesce(F.exp(F.sum(F.log(1 - F.col("stop"))).over(before)), F.lit(1.0)))
    ideal = qrels.withColumn("i", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id"))).where(F.col("i") <= k)
    ideal = ideal.groupBy("query_id").agg(F.sum(_dcg(F.col("rel"), F.col("i"))).alias("idcg"))
    kept = F.least(F.lit(k), n)
    precision, recall = F.sum("hit") / n, F.try_divide(F.sum("hit").cast("double"), r)
    out = rows.groupBy("query_id").agg(
        _r(precision, "precision", digits),
        _r(F.coalesce(recall, F.lit(0.0)), "recall", digits),
        _r(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)), "f1", digits),
        _r(F.sum(F.when(at, F.col("hit")).otherwise(0)) / kept, "p_at_k", digits),
        _r(F.coalesce(F.try_divide(F.sum(F.when(at, F.col("hit")).otherwise(0)).cast("double"), r), F.lit(0.0)), "r_at_k", digits),
        F.max(F.when(at, F.col("hit")).otherwise(0)).alias("success_at_k"),
        _r(F.coalesce(F.try_divide(F.sum(F.col("hit") * F.col("hits") / F.col("rank")), r), F.lit(0.0)), "ap", digits),
        _r(F.coalesce(1 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)), "rr", digits),
        F.sum(F.when(at, _dcg(F.col("rel"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
        _r(F.sum(F.when(at, F.col("go") * F.col("stop") / F.col("rank")).otherwise(0.0)), "err", digits),
        _r(F.sum((1 - p) * F.pow(F.lit(p), F.col("rank") - 1) * F.col("hit")), "rbp", digits),
        _r(F.sum((1 - p) * F.pow(F.lit(p), F.col("rank") - 1) * F.col("rel") / top_grade), "graded_rbp", digits),
        _r(F.coalesce(F.try_divide(F.sum(F.col("hit") * (1 - F.least(F.col("misses"), F.col("r")) / F.when(F.col("r") > 0, F.col("r")))), r), F.lit(0.0)), "bpref", digits),
        _r(F.coalesce(F.try_divide(F.sum(F.when(F.col("rank") <= F.col("r"), F.col("hit")).otherwise(0)).cast("double"), r), F.lit(0.0)), "r_precision", digits),
    )
    return out.join(ideal, "query_id").withColumn("ndcg", _r(F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)), "ndcg", digits)).withColumn("dcg", _r(F.col("dcg"), "dcg", digits)).drop("idcg")


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * precision * recall, b * precision + recall), F.lit(0.0))


def overall(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """MAP, MRR, GMAP and mean nDCG over the queries, rounded once."""
    q = per_query(run, qrels, k, digits=None)
    return q.agg(F.count(F.lit(1)).alias("queries"), _r(F.avg("ap"), "map"), _r(F.avg("rr"), "mrr"), _r(F.exp(F.avg(F.log(F.col("ap") + 1e-10))), "gmap"), _r(F.avg("ndcg"), "mean_ndcg"))


def pr_curve(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``level, precision``: mean over queries of the best precision at each of 11 recall levels or above."""
    rows = judged(run, qrels).join(_relevant(qrels), "query_id").where("r > 0")
    points = rows.select("query_id", (F.col("hits") / F.col("r")).alias("recall"), (F.col("hits") / F.col("rank")).alias("p"))
    levels = F.sequence(F.lit(0), F.lit(10))
    reached = points.select("query_id", "p", "recall", F.explode(levels).alias("i"))
    best = reached.groupBy("query_id", "i").agg(F.coalesce(F.max(F.when(F.col("recall") >= F.col("i") / 10 - 1e-12, F.col("p"))), F.lit(0.0)).alias("p"))
    return best.groupBy("i").agg(_r(F.avg("p"), "precision")).select((F.col("i") / 10).alias("level"), "precision")


def keyword_scores(found: Column, truth: Column) -> dict[str, Column]:
    """Precision, recall and F1 of extracted keywords against true ones."""
    both = F.size(F.array_intersect(found, truth)).cast("double")
    p, r = F.coalesce(F.try_divide(both, F.size(found)), F.lit(0.0)), F.coalesce(F.try_divide(both, F.size(truth)), F.lit(0.0))
    return {"precision": F.round(p, DIGITS), "recall": F.round(r, DIGITS), "f1": F.round(f_beta(p, r), DIGITS)}


def f_beta_series(run: DataFrame, qrels: DataFrame, ks: list[int] = (5, 10, 20)) -> DataFrame:
    """``k, precision, recall, f_half, f_two``: means over queries at each cut."""
    rows = judged(run, qrels).join(_relevant(qrels), "query_id").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))
    per = rows.groupBy("k", "query_id").agg((F.sum("hit") / F.count(F.lit(1))).alias("p"), F.coalesce(F.try_divide(F.sum("hit").cast("double"), F.first("r")), F.lit(0.0)).alias("q"))
    f = lambda beta: F.avg(f_beta(F.col("p"), F.col("q"), beta))
    return per.groupBy("k").agg(_r(F.avg("p"), "precision"), _r(F.avg("q"), "recall"), _r(f(0.5), "f_half"), _r(f(2.0), "f_two"))


def query_sets(queries: DataFrame, version: str) -> DataFrame:
    """``name, queries, key`` of query sets ``name, query_id, text``; the key changes with the version or any query."""
    line = F.concat(F.col("query_id").cast("string"), F.lit("="), F.md5(F.col("text").cast("binary")))
    rows = queries.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("query_id", line.alias("line")))).alias("q"))
    key = F.sha2(F.concat_ws("\n", F.lit(version), F.array_join(F.transform("q", lambda x: x["line"]), "\n")).cast("binary"), 256)
    return rows.select("name", F.size("q").cast("long").alias("queries"), key.alias("key"))


def cache_key(request: dict, dataset: str, judgments: str) -> str:
    """The key under which an evaluation's result is kept."""
    import hashlib
    import json

    return hashlib.sha256(f"{dataset}|{judgments}|{json.dumps(request, sort_keys=True)}".encode()).hexdigest()


def keyword_eval(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``doc_id, precision, recall, f1`` of keyword lists ``doc_id, k`` against true ones."""
    rows = found.select("doc_id", F.col("k").alias("f")).join(truth.select("doc_id", F.col("k").alias("g")), "doc_id")
    return rows.select("doc_id", *[c.alias(n) for n, c in keyword_scores(F.col("f"), F.col("g")).items()])
