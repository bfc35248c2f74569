"""N-gram models, collocations, summaries, keywords."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import index
from tessera.operators.keywords import ranked_each
from tessera.sources import scratch

DIGITS = 6


def bigrams(docs: DataFrame) -> DataFrame:
    """``a, b, n`` of adjacent tokens."""
    return index.grams(docs, 2).groupBy(F.col("t0").alias("a"), F.col("t1").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def unigrams(docs: DataFrame) -> DataFrame:
    return index.tokens(docs).select(F.explode("w").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))


def bigram_model(docs: DataFrame, method: str = "laplace", lam: float = 0.7, mu: float = 2000.0) -> DataFrame:
    """``a, b, n, p``: P(b | a) of the bigrams seen, not rounded, by ``mle``, ``laplace``, ``jm`` or ``dirichlet``."""
    pairs, single = scratch.saved(bigrams(docs), "bigrams"), scratch.saved(unigrams(docs), "unigrams")  # each is used several times
    context = pairs.groupBy("a").agg(F.sum("n").alias("c"))
    v = single.agg(F.count(F.lit(1)).cast("double")).scalar()
    total = single.agg(F.sum("n").cast("double")).scalar()
    rows = pairs.join(context, "a").join(single.select(F.col("t").alias("b"), F.col("n").alias("nb")), "b")
    n, c, pb = F.col("n"), F.col("c"), F.col("nb") / total
    p = {"mle": n / c, "laplace": (n + 1) / (c + v), "jm": lam * n / c + (1 - lam) * pb, "dirichlet": (n + mu * pb) / (c + mu)}[method]
    return rows.select("a", "b", "n", p.alias("p"))


def ngram_probability(docs: DataFrame, method: str = "laplace", **how: float) -> DataFrame:
    """``a, b, p`` of ``bigram_model``, rounded."""
    return bigram_model(docs, method, **how).select("a", "b", F.round("p", 9).alias("p"))


def log_probability(docs: DataFrame, method: str = "laplace", **how: float) -> DataFrame:
    """``a, b, logp``: ln P(b | a), null where there is none."""
    return bigram_model(docs, method, **how).select("a", "b", F.round(F.when(F.col("p") > 0, F.log("p")), DIGITS).alias("logp"))


def model_stats(docs: DataFrame) -> DataFrame:
    """``tokens, vocabulary, bigrams, contexts`` of the bigram model."""
    pairs = bigrams(docs)
    of_pairs = pairs.agg(F.count(F.lit(1)).alias("bigrams"), F.countDistinct("a").alias("contexts"))
    return unigrams(docs).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("vocabulary")).select("tokens", "vocabulary", of_pairs.select("bigrams").scalar().alias("bigrams"), of_pairs.select("contexts").scalar().alias("contexts"))


def perplexity(docs: DataFrame, train: DataFrame, lam: float = 0.7) -> DataFrame:
    """``doc_id, tokens, perplexity`` under the bigram model (JM) of ``train``; pairs without probability are skipped."""
    model = bigram_model(train, "jm", lam).drop("n")
    pairs = index.grams(docs, 2).withColumnsRenamed({"t0": "a", "t1": "b"})
    known = pairs.groupBy("doc_id", "a", "b").agg(F.count(F.lit(1)).alias("m")).join(model, ["a", "b"]).where("p > 0")
    return known.groupBy("doc_id").agg(F.sum("m").alias("tokens"), F.round(F.pow(F.lit(2.0), -F.sum(F.col("m") * F.log2("p")) / F.sum("m")), 4).alias("perplexity"))


def generate(docs: DataFrame, start: str, length: int = 20, seed: int = 0) -> list[str]:
    """Words drawn one after another by bigram counts; each step looks up one context."""
    model, rng, out = bigrams(docs).cache(), np.random.default_rng(seed), [start]
    try:
        while len(out) < length:
            near = model.where(F.col("a") == out[-1]).orderBy(F.desc("n"), "b").limit(1000).collect()
            if not near:
                break
            n = np.array([r["n"] for r in near], dtype=float)
            out.append(near[int(rng.choice(len(near), p=n / n.sum()))]["b"])
    finally:
        model.unpersist()
    return out


def collocations(docs: DataFrame, measure: str = "pmi", least: int = 5, k: int = 100) -> DataFrame:
    """``a, b, n, score`` of adjacent pairs by ``pmi``, ``llr``, ``chi2``, ``t`` or ``dice``."""
    pairs = scratch.saved(bigrams(docs), "bigrams")  # used four times
    left = pairs.groupBy("a").agg(F.sum("n").alias("na"))
    right = pairs.groupBy("b").agg(F.sum("n").alias("nb"))
    total = pairs.agg(F.sum("n").cast("double")).scalar()
    rows = pairs.where(F.col("n") >= least).join(left, "a").join(right, "b").withColumn("total", total)
    o11, n1, n2, big = F.col("n").cast("double"), F.col("na"), F.col("nb"), F.col("total")
    zero = F.lit(0.0)
    o12, o21 = F.greatest(n1 - o11, zero), F.greatest(n2 - o11, zero)
    o22 = F.greatest(big - n1 - n2 + o11, zero)
    cells = [(o11, n1 * n2 / big), (o12, n1 * (big - n2) / big), (o21, (big - n1) * n2 / big), (o22, (big - n1) * (big - n2) / big)]
    both = lambda f: sum((f(o, e) for o, e in cells), zero)
    p = o11 / big
    score = {
        "pmi": F.log2(o11 * big / (n1 * n2)),
        "llr": 2 * both(lambda o, e: F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0)),
        "chi2": both(lambda o, e: F.when(e > 0, (o - e) * (o - e) / e).otherwise(0.0)),
        "t": (p - n1 / big * (n2 / big)) / F.sqrt(p / big),
        "dice": 2 * o11 / (n1 + n2),
    }[measure]
    return rows.select("a", "b", "n", F.round(score, DIGITS).alias("score")).orderBy(F.desc("score"), "a", "b").limit(k)


# summaries: sentences of 5 to 100 tokens

def sentence_rows(docs: DataFrame, least: int = 5, most: int = 100) -> DataFrame:
    """``doc_id, i, sentence, w``; i counts the kept sentences of a document from 0."""
    kept = F.filter(F.transform(text.sentences("text"), lambda s: F.struct(s.alias("sentence"), text.lexical(s).alias("w"))), lambda s: F.size(s["w"]).between(least, most))
    return docs.select("doc_id", F.posexplode(kept).alias("i", "s")).select("doc_id", "i", "s.sentence", "s.w")


def lead(docs: DataFrame, k: int = 3) -> DataFrame:
    return sentence_rows(docs).where(F.col("i") < k).select("doc_id", "i", "sentence")


def key_sentences(docs: DataFrame, k: int = 3) -> DataFrame:
    """The k sentences with the highest mean tf * ln(S / df), earlier ones favoured, in text order."""
    rows = sentence_rows(docs)
    total = F.col("sentences")
    tokens = rows.select("doc_id", "i", F.explode("w").alias("t"))
    per = tokens.groupBy("doc_id", "i", "t").agg(F.count(F.lit(1)).alias("n"))
    doc = W.partitionBy("doc_id", "t")
    per = per.withColumn("tf", F.sum("n").over(doc)).withColumn("df", F.count(F.lit(1)).over(doc))
    sizes = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"))
    scored = per.join(sizes, "doc_id").groupBy("doc_id", "i").agg((F.sum(F.col("n") * F.col("tf") * F.log(total / F.col("df"))) / F.sum("n")).alias("mean"))
    scored = scored.withColumn("score", F.round(F.col("mean") * (1 + 0.5 / (1 + F.col("i"))), DIGITS))
    best = scored.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "i"))).where(F.col("r") <= k)
    return best.select("doc_id", "i", "score")


def query_sentences(docs: DataFrame, terms: list[str], k: int = 3) -> DataFrame:
    """The k sentences with the most query terms over sqrt(query terms * sentence tokens)."""
    q = F.array(*[F.lit(t) for t in terms])
    score = F.round(F.size(F.array_intersect("w", q)) / F.sqrt(F.lit(float(len(terms))) * F.size("w")), DIGITS)
    rows = sentence_rows(docs).withColumn("score", score).where("score > 0")
    return rows.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "i"))).where(F.col("r") <= k).select("doc_id", "i", "score")


def multi_document_summary(docs: DataFrame, k: int = 5, threshold: float = 0.5, pool: int = 200) -> pd.DataFrame:
    """Greedy choice among the ``pool`` best sentences; ones too like a chosen one (Jaccard) are passed over."""
    best = key_sentences(docs, 3).orderBy(F.desc("score"), "doc_id", "i").limit(pool)
    rows = best.join(sentence_rows(docs), ["doc_id", "i"]).orderBy(F.desc("score"), "doc_id", "i").toPandas()
    chosen: list[int] = []
    for j, w in enumerate(rows["w"]):
        mine = set(w)
        if len(chosen) < k and all(len(mine & set(rows["w"][c])) <= threshold * len(mine | set(rows["w"][c])) for c in chosen):
            chosen.append(j)
    return rows.iloc[chosen][["doc_id", "i", "sentence", "score"]].reset_index(drop=True)


# keywords

def rake(docs: DataFrame, k: int = 10) -> DataFrame:
    """``doc_id, phrase, score``: runs between stopwords and punctuation, by the sum of their words' degree over frequency; counted in a document's row, nothing is shuffled."""
    stop = "|".join(text.STOPWORDS)
    cut = F.split(F.regexp_replace(F.lower("text"), f"(?U)[^\\w\\s]+|\\n|\\b({stop})\\b", "|"), "\\|")
    phrases = F.filter(F.transform(cut, lambda p: F.trim(F.regexp_replace(p, "\\s+", " "))), lambda p: p != "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.column(1).to_pylist():
                every = [(p, p.split(" ")) for p in row or ()]
                freq: Counter = Counter()
                degree: Counter = Counter()
                for _, w in every:
                    for t in w:
                        freq[t] += 1
                        degree[t] += len(w)
                found.append([{"phrase": p, "s": sum(degree[t] / freq[t] for t in w)} for p, w in dict(every).items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=pa.list_(pa.struct([("phrase", pa.string()), ("s", pa.float64())])))], names=["doc_id", "p"])

    scored = docs.where("doc_id is not null").select("doc_id", phrases.alias("p")).mapInArrow(run, "doc_id long, p array<struct<phrase string, s double>>")
    ranked = F.array_sort(F.transform("p", lambda x: F.struct((-F.round(x["s"], DIGITS)).alias("s"), x["phrase"].alias("phrase"))))
    return scored.select("doc_id", F.explode(F.slice(ranked, 1, k)).alias("p")).select("doc_id", "p.phrase", (-F.col("p.s")).alias("score"))


def tf_keywords(docs: DataFrame, k: int = 10) -> DataFrame:
    """``doc_id, term, tf``: the most frequent terms of two letters or more that are no stopwords."""
    post = index.postings(docs).where((F.length("term") > 1) & ~F.col("term").isin(text.STOPWORDS))
    return post.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("tf"), "term"))).where(F.col("r") <= k).drop("r")


def textrank(docs: DataFrame, k: int = 10, window: int = 5, damping: float = 0.85, rounds: int = 50) -> DataFrame:
    """``doc_id, term, score`` by PageRank on each document's own co-occurrence graph, earlier terms favoured."""
    keep = text.without_stopwords(F.col("w"), least=2)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, w, ranks in zip(frame["doc_id"], frame["w"], ranked_each(frame["w"], window, damping, rounds), strict=True):
                if not ranks:
                    continue
                terms, rank = np.array(list(ranks), dtype=object).astype(str), np.array(list(ranks.values()))
                at = np.searchsorted(terms, np.asarray(w, dtype=object).astype(str))
                first = np.full(len(terms), len(at))
                np.minimum.at(first, at, np.arange(len(at)))
                score = np.round(rank * (1 + 0.3 * (1 - first / len(at))), 9)
                best = np.lexsort((terms, -score))[:k]
                out.append(pd.DataFrame({"doc_id": doc_id, "term": terms[best], "score": score[best]}))
            yield pd.concat(out) if out else pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "term": pd.Series(dtype=str), "score": pd.Series(dtype=float)})

    return index.tokens(docs).select("doc_id", keep.alias("w")).mapInPandas(run, "doc_id long, term string, score double")


def entities(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, value`` by patterns: e-mail addresses, links, dates, amounts of money, numbers."""
    # What each kind looks like.
    kinds = {"email": r"[\w.+-]+@[\w-]+\.[\w.]+", "link": r"https?://[^\s<>\"]+", "date": r"\b\d{4}-\d{2}-\d{2}\b", "money": r"[$€£]\d[\d,.]*\d"}

    def found(kind: str, pattern: str):
        return F.transform(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return docs.select("doc_id", F.explode(F.concat(*[found(k, p) for k, p in kinds.items()])).alias("e")).select("doc_id", "e.kind", "e.value")


def triples(edges: DataFrame) -> DataFrame:
    """``sent_id, subject, verb, object`` by rules on a table of dependency edges."""
    root = edges.where("relation = 'root'").select("sent_id", F.col("dep").alias("v"), F.col("dep_word").alias("verb"))
    below = edges.join(root, "sent_id").where("head = v")
    subject = below.where(F.col("relation").isin("nsubj", "nsubjpass", "top")).groupBy("sent_id").agg(F.min_by("dep_word", "dep").alias("subject"))
    obj = below.where(F.col("relation").isin("dobj", "attr", "ccomp", "iobj")).groupBy("sent_id").agg(F.min_by("dep_word", "dep").alias("object"))
    return root.join(subject, "sent_id", "left").join(obj, "sent_id", "left").select("sent_id", "subject", "verb", "object", F.when(F.col("subject").isNotNull() & F.col("object").isNotNull(), 1.0).otherwise(0.7).alias("confidence"))



def entity_stats(found: DataFrame) -> DataFrame:
    """``kind, n, values, pct`` of entities ``kind, value``: occurrences, distinct values, share of all."""
    total = found.agg(F.count(F.lit(1)).cast("double")).scalar()
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("values")).select("kind", "n", "values", F.round(100.0 * F.col("n") / total, 4).alias("pct"))


def common_entities(found: DataFrame, k: int = 10) -> DataFrame:
    """``kind, value, n, rank``: the k most frequent values of each kind."""
    counts = found.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)


def keyword_lists(docs: DataFrame, k: int = 10) -> DataFrame:
    """``doc_id, k``: an array of each document's keywords."""
    return tf_keywords(docs, k).groupBy("doc_id").agg(F.collect_list("term").alias("k"))


def frequent_lists(docs: DataFrame, least: int) -> DataFrame:
    """``doc_id, k``: an array of the words that a document holds ``least`` times or more."""
    post = index.postings(docs).where((F.col("tf") >= least) & (F.length("term") > 1) & ~F.col("term").isin(text.STOPWORDS))
    return post.groupBy("doc_id").agg(F.collect_list("term").alias("k"))


def detail(docs: DataFrame, doc_id: int, terms: list[str], k: int = 5) -> DataFrame:
    """One document's attributes, number of distinct terms, keywords and matched query terms; null where there are none."""
    one = docs.where(F.col("doc_id") == doc_id)
    w = text.lexical("text")
    joined = lambda a: F.nullif(F.array_join(a, ","), F.lit(""))
    best = tf_keywords(one, k).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("tf")).alias("n"), "term"))), lambda x: x["term"]).alias("k"))
    return one.select("doc_id", "lang", "source", "n_chars", F.size(F.array_distinct(w)).alias("distinct_terms"), joined(best.scalar()).alias("keywords"), joined(F.array_sort(F.array_intersect(w, F.array(*[F.lit(t) for t in terms])))).alias("matched"))


def generate_greedy(docs: DataFrame, start: str, length: int = 20) -> DataFrame:
    """``pos, word``: from ``start``, always the most frequent next word (the first of equals); one row is looked up a step."""
    model = bigrams(docs).groupBy("a").agg(F.min_by("b", F.struct(-F.col("n"), F.col("b"))).alias("b")).cache()
    out = [start]
    try:
        while len(out) < length:
            row = model.where(F.col("a") == out[-1]).first()
            if row is None:
                break
            out.append(row["b"])
    finally:
        model.unpersist()
    return docs.sparkSession.createDataFrame(list(enumerate(out)), "pos int, word string")


def dependency_tree(edges: DataFrame) -> DataFrame:
    """``sent_id, head, children, relations``: the words under each head, in their order in the sentence."""
    rows = edges.groupBy("sent_id", "head").agg(F.array_sort(F.collect_list(F.struct("dep", "dep_word", "relation"))).alias("c"))
    return rows.select("sent_id", "head", F.array_join(F.transform("c", lambda x: x["dep_word"]), ",").alias("children"), F.array_join(F.transform("c", lambda x: x["relation"]), ",").alias("relations"))
