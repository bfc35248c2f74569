"""Top-k BM25 that scores only documents which can still reach the top: WAND and MaxScore.

Both start from a threshold that is surely reached: the k-th best score among the
documents of the term that can add most. WAND then scores the documents whose
terms' upper bounds add up to it; MaxScore those with a term outside of the
cheapest terms that together stay below it. Scores are exact, so the result is
that of the full scan. What is told to the driver is a row for each query term
and the threshold.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import index, ranking

#: Sums of doubles in another order may differ by so much.
SLACK = 1e-9


@dataclass
class Pruned:
    """``found``: the k best; ``scored``: the rows that were scored; ``candidates``: those with any term."""

    found: DataFrame
    scored: DataFrame
    candidates: DataFrame
    threshold: float
    upper: dict[str, float]

    def stats(self) -> DataFrame:
        return self.candidates.agg(F.count(F.lit(1)).alias("candidates")).select("candidates", self.scored.agg(F.count(F.lit(1))).scalar().alias("scored"))


def _sum(parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def _count(column: str, term: str) -> Column:
    return F.size(F.filter(column, lambda x: x == term))


def search(docs: DataFrame, terms: list[str], k: int = 10, method: str = "wand", *, k1: float = 1.5, b: float = 0.75) -> Pruned:
    many = Counter(terms)
    names = sorted(many)
    rows = index.tokens(docs).where(F.arrays_overlap("w", F.array(*[F.lit(t) for t in names])))
    rows = rows.select("doc_id", F.size("w").alias("dl"), *[_count("w", t).alias(f"tf{i}") for i, t in enumerate(names)])
    n, avgdl = index.doc_stats(docs).agg(F.count(F.lit(1)), F.avg("dl")).first()
    gain = lambda i: F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("dl") / F.lit(float(avgdl or 1.0))))
    facts = rows.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(names))], *[F.max(gain(i)).alias(f"g{i}") for i in range(len(names))]).first()
    idf = [float(_idf(n, facts[f"df{i}"])) for i in range(len(names))]
    upper = [many[t] * idf[i] * (facts[f"g{i}"] or 0.0) for i, t in enumerate(names)]
    score = _sum([F.when(F.col(f"tf{i}") > 0, many[t] * idf[i] * gain(i)).otherwise(0.0) for i, t in enumerate(names)])
    top = max(range(len(names)), key=lambda i: (upper[i], names[i]))
    seeds = rows.where(F.col(f"tf{top}") > 0).select(score.alias("s")).orderBy(F.desc("s")).limit(k).collect()
    threshold = seeds[-1]["s"] if len(seeds) == k else 0.0
    if method == "wand":
        able = _sum([F.when(F.col(f"tf{i}") > 0, F.lit(upper[i])).otherwise(0.0) for i in range(len(names))]) >= threshold - SLACK
    else:
        able, below = F.lit(False), 0.0
        for i in sorted(range(len(names)), key=lambda i: (upper[i], names[i])):
            below += upper[i]
            if below >= threshold - SLACK:
                able = able | (F.col(f"tf{i}") > 0)
    scored = rows.where(able).select("doc_id", score.alias("score"))
    return Pruned(ranking.top(scored.where("score > 0"), k), scored, rows.select("doc_id"), float(threshold), dict(zip(names, upper, strict=True)))


def _idf(n: int, df: int) -> float:
    import math

    return math.log((n - df + 0.5) / (df + 0.5) + 1)
