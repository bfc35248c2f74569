"""Queries that SQL can't express, against plain versions of the same or by what must hold of their content."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera import registry
from tessera.functions import text as texts
from tessera.operators import cluster, dedup, index, keywords, nlp, pruning, ranking, recommend
from tessera.streaming import flows

STOP = set(texts.STOPWORDS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 4000").select("doc_id", "text", "lang").cache()


def lexical(t):
    return re.findall(r"[一-鿿]+|[a-z0-9]+", (t or "").lower())


def soundex(word):
    codes = {c: d for d, cs in {"1": "BFPV", "2": "CGJKQSXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}.items() for c in cs}
    w = word.upper()
    if not w or not ("A" <= w[0] <= "Z"):
        return word
    out, last = w[0], codes.get(w[0], "")
    for c in w[1:]:
        if not ("A" <= c <= "Z"):
            last = ""
            continue
        d = codes.get(c, "")
        if d and d != last:
            out += d
        if c not in "HW":
            last = d
    return (out + "000")[:4]


def test_phonetic_codes(spark, sf_dir):
    rows = registry.queries()["phonetic"](spark, sf_dir).where("t rlike '^[a-z]+$'").collect()
    assert len(rows) > 1_000
    assert [r["t"] for r in rows if r["code"] != soundex(r["t"])] == []


def test_phonetic_bm25(docs):
    rows = {r["doc_id"]: lexical(r["text"]) for r in docs.collect()}
    query = ["thing", "with"]
    vocabulary = {w for ws in rows.values() for w in ws}
    weight = {}
    for q in query:
        alike = sorted((w != q, w) for w in vocabulary if re.match("[a-z]", w) and soundex(w) == soundex(q))[:50]
        for other, w in alike:
            weight[w] = max(weight.get(w, 0), 0.5 if other else 1.0)
    n, mean = len(rows), sum(map(len, rows.values())) / len(rows)
    df = {t: sum(t in set(ws) for ws in rows.values()) for t in weight}
    score = {}
    for i, ws in rows.items():
        tf = Counter(w for w in ws if w in weight)
        if tf:
            score[i] = sum(weight[t] * math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for t, c in tf.items())
    want = sorted((-round(s, 6), i) for i, s in score.items())[:10]
    got = [(-r["score"], r["doc_id"]) for r in ranking.bm25_expanded(docs, query, "phonetic").orderBy("rank").collect()]
    assert [i for _, i in got] == [i for _, i in want] and [s for s, _ in got] == pytest.approx([s for s, _ in want])


def test_rake(docs):
    few = docs.where("doc_id < 60")
    got = defaultdict(list)
    for r in nlp.rake(few).collect():
        got[r["doc_id"]].append((r["phrase"], r["score"]))
    for r in few.collect():
        cut = re.sub(r"[^\w\s]+|\n|\b(" + "|".join(texts.STOPWORDS) + r")\b", "|", (r["text"] or "").lower())
        phrases = [p for p in (re.sub(r"\s+", " ", x).strip() for x in cut.split("|")) if p]
        freq, degree = Counter(), Counter()
        for p in phrases:
            for w in p.split(" "):
                freq[w] += 1
                degree[w] += len(p.split(" "))
        scored = {p: round(sum(degree[w] / freq[w] for w in p.split(" ")), 6) for p in phrases}
        want = sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:10]
        assert sorted(s for _, s in got[r["doc_id"]]) == pytest.approx(sorted(s for _, s in want)), r["doc_id"]


def test_textrank_is_the_fixed_point():
    words = "a b c a d b e f a c g b a".split()
    rank = keywords.ranked_words(words, window=3, rounds=200)
    terms = sorted(set(words))
    edges = Counter()
    for i, x in enumerate(words):
        for y in words[i + 1 : i + 3]:
            if x != y:
                edges[x, y] += 1
                edges[y, x] += 1
    m = np.array([[edges[x, y] for y in terms] for x in terms], dtype=float)
    m /= m.sum(axis=1, keepdims=True)
    p = np.array([rank[t] for t in terms])
    assert np.allclose(p, 0.15 / len(terms) + 0.85 * p @ m, atol=1e-9) and abs(p.sum() - 1) < 1e-9
    phrases = dict(keywords.textrank_phrases("Solar panel and wind turbine. Solar panel of the wind farm, solar panel again", 10))
    assert phrases["solar panel"] == pytest.approx(np.mean([keywords.ranked_words("solar panel wind turbine solar panel wind farm solar panel again".split())[w] for w in ("solar", "panel")]), abs=1e-9)
    assert all(len(p.split()) <= 4 and not STOP & set(p.split()) for p in phrases)


def test_yake():
    text = "Kelp grows fast. Divers saw Kelp near the pier. The pier is old. Kelp feeds urchins, and urchins eat Kelp. One diver left early."
    best = keywords.yake_phrases(text, 3)
    weight = keywords.yake_terms(text)
    assert weight["kelp"] < min(weight["urchins"], weight["pier"], weight["divers"]) and not STOP & set(weight)
    assert [s for _, s in best] == sorted(s for _, s in best)
    assert keywords.yake_phrases("", 3) == keywords.yake_phrases("the of and", 3) == []


def test_embedding_keywords():
    text = "graph index search graph index ranking graph"
    near = keywords.embedding_keywords(text, 5, diversity=0.0)
    assert [s for _, s in near] == sorted((s for _, s in near), reverse=True)
    whole = keywords.hashed_embedding(text.split())
    assert all(s == pytest.approx(float(keywords.hashed_embedding(p.split()) @ whole), abs=1e-6) for p, s in near)
    spread = keywords.embedding_keywords(text, 5, diversity=0.9)
    assert spread[0] == near[0] and {p for p, _ in spread} != {p for p, _ in near}
    assert keywords.embedding_keywords("", 5) == []


@pytest.mark.parametrize("method", sorted(keywords.METHODS))
def test_extracted_rows(docs, method):
    few = docs.where("doc_id < 20")
    got = defaultdict(list)
    for r in keywords.extract(few, method, 4).orderBy("doc_id", "rank").collect():
        got[r["doc_id"]].append((r["phrase"], r["score"]))
    assert dict(got) == {r["doc_id"]: x for r in few.collect() if (x := keywords.METHODS[method](r["text"] or "", 4))}
    assert keywords.extract(docs.limit(0), method).count() == 0


def test_bm25_batch_blocks(spark, docs):
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["the thing", "that that with", "zzz", "", "of and the"])], "query_id long, text string")
    want = {}
    for i, t in enumerate(["the thing", "that that with", "zzz", "", "of and the"]):
        want[i] = [(r["doc_id"], r["score"]) for r in ranking.bm25(docs, t.split(), 6).orderBy("rank").collect()] if t else []
    for block in (2, 1024):
        got = defaultdict(list)
        for r in ranking.bm25_batch(docs, queries, 6, block).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["doc_id"], r["score"]))
        for i in range(5):
            assert [d for d, _ in got[i]] == [d for d, _ in want[i]] and [s for _, s in got[i]] == pytest.approx([s for _, s in want[i]], abs=2e-6)


@pytest.mark.parametrize("terms", [["the"], ["the", "and", "of", "thing"], ["zzz"], ["that", "that", "with"]])
@pytest.mark.parametrize("method", ["wand", "maxscore"])
def test_pruning_loses_nothing(docs, terms, method):
    got = pruning.search(docs, terms, 7, method)
    want = ranking.bm25(docs, terms, 7)
    assert [tuple(r) for r in got.found.orderBy("rank").collect()] == [tuple(r) for r in want.orderBy("rank").collect()]
    stats = got.stats().first()
    assert stats["scored"] <= stats["candidates"]


def test_pruning_skips(docs):
    stats = pruning.search(docs, ["the", "and", "of", "a", "thing"], 3).stats().first()
    assert stats["scored"] < stats["candidates"]


def test_hierarchical(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 6))
    got = cluster.hierarchical(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = [{i} for i in range(12)]
    while len(groups) > 4:
        i, j = max(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: min(u[a] @ u[b] for a in groups[p[0]] for b in groups[p[1]]))
        groups[j] |= groups.pop(i)
    mine = defaultdict(set)
    for r in got.collect():
        mine[r["cluster"]].add(r["vec_id"])
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups))
    with pytest.raises(ValueError):
        cluster.hierarchical(spark.range(9).selectExpr("id vec_id", "array(1.0D) embedding"), 2, most=8)


def test_hierarchical_groups(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = cluster.hierarchical_groups(v, "label", 3).collect()
    assert len(got) == v.count() and len({r["cluster"] for r in got}) == 3
    assert all(len({r["cluster"] for r in got if r["label"] == x}) == 1 for x in {r["label"] for r in got})


def test_term_clusters():
    got = cluster.star_clusters(["house", "houses", "mouse", "tree", "trees", "free"])
    assert got == {"house": "house", "houses": "house", "mouse": "house", "tree": "tree", "trees": "tree", "free": "tree"}


def test_mmr(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in v.collect()}
    unit = {i: x / np.linalg.norm(x) for i, x in rows.items()}
    near = sorted((-round(float(unit[7] @ x), 6), i) for i, x in unit.items() if i != 7)[:20]
    rest, chosen = [(i, -s) for s, i in near], []
    while len(chosen) < 10:
        best = max(rest, key=lambda c: (0.3 * c[1] - 0.7 * max((unit[c[0]] @ unit[d] for d in chosen), default=0.0)))
        rest.remove(best)
        chosen.append(best[0])
    assert [r["vec_id"] for r in recommend.mmr(v, 7).orderBy("rank").collect()] == chosen


def test_near_pairs_by_blocks(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**63), 2**63, 40, dtype=np.int64)
    prints = [(i, int(h)) for i, h in enumerate(base)]
    for i, h in list(prints):
        flip = 0
        for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False).tolist():
            flip |= 1 << bit
        x = (h ^ flip) & (2**64 - 1)
        prints.append((100 + i, x - 2**64 if x >= 2**63 else x))
    want = [(a, b, d) for k, (a, x) in enumerate(prints) for b, y in prints[k + 1 :] if (d := ((x ^ y) & (2**64 - 1)).bit_count()) <= 3]
    df = spark.createDataFrame(prints, "doc_id long, h long")
    for blocks in (4, 5, 6):
        assert sorted(map(tuple, dedup.near_pairs(df, 3, blocks).collect())) == sorted(want)


def test_greedy_duplicates(docs):
    prints = {r["doc_id"]: r["h"] for r in dedup.fingerprints(docs).collect()}
    kept = []
    for i in sorted(prints):
        if all(((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() > 3 for j in kept):
            kept.append(i)
    assert sorted(r["doc_id"] for r in dedup.greedy(docs).where("kept").collect()) == kept


def test_multi_document_summary(docs):
    got = nlp.multi_document_summary(docs, 4)
    assert len(got) == 4 and list(got["score"]) == sorted(got["score"], reverse=True)
    sets = [set(lexical(s)) for s in got["sentence"]]
    assert all(len(a & b) <= 0.5 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])


def test_factor_lists(spark):
    rows = [(u, i, float(5 if (u + i) % 2 == 0 else 1)) for u in range(12) for i in range(10) if (u * 7 + i * 3) % 4]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    seen = {(u, i) for u, i, _ in rows}
    got = recommend.factor_lists(ratings, 2).collect()
    assert got and not any((r["user_id"], r["item_id"]) in seen for r in got)
    assert all(r["rank"] <= 2 for r in got)
    # The pattern has rank two, so unseen items of a user's parity come first.
    first = [r for r in got if r["rank"] == 1 and any((r["user_id"] + i) % 2 == 0 and (r["user_id"], i) not in seen for i in range(10))]
    assert sum((r["user_id"] + r["item_id"]) % 2 == 0 for r in first) >= 0.9 * len(first)


def test_topics(spark):
    groups = [["sun", "moon", "star", "orbit"], ["bread", "flour", "oven", "yeast"]]
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(groups[i % 2], 30))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    topic = {r["doc_id"]: r["topic"] for r in cluster.lda_topics(df, 2).collect()}
    assert len({topic[i] for i in range(0, 60, 2)}) == 1 and len({topic[i] for i in range(1, 60, 2)}) == 1 and topic[0] != topic[1]
    words = cluster.topic_words(df, 2, 4).collect()
    assert {frozenset(r["word"] for r in words if r["topic"] == t) for t in (0, 1)} == set(map(frozenset, groups))


def test_kmeans_report(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = cluster.kmeans_report(v).collect()
    x = {r["vec_id"]: np.array(r["embedding"], dtype=float) / np.linalg.norm(r["embedding"]) for r in v.collect()}
    centre = {c: np.mean([x[r["vec_id"]] for r in got if r["cluster"] == c], axis=0) for c in {r["cluster"] for r in got}}
    assert len(got) == len(x) and len(centre) == 5
    assert all(r["similarity"] == pytest.approx(float(x[r["vec_id"]] @ centre[r["cluster"]] / np.linalg.norm(centre[r["cluster"]])), abs=2e-6) for r in got)


def test_dense_batch_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [(q, r + 1, j, s) for q in range(0, 90, 9) for r, (s, j) in enumerate(sorted(((round(float(u[q] @ u[j]), 6), j) for j in range(90) if j != q), key=lambda p: (-p[0], p[1]))[:5])]
    for block in (3, 4096):
        got = sorted(tuple(r) for r in ranking.dense_batch(df, df["vec_id"] % 9 == 0, 5, block).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)
    assert ranking.dense_batch(df.limit(0), df["vec_id"] % 9 == 0).count() == 0


def test_near_and_within():
    rng = np.random.default_rng(4)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tessera.plans import query as plans

    spark = SparkSession.getActiveSession()
    rows = [(i, rng.choice(list("abcd"), rng.integers(0, 14)).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, w array<string>")
    found = lambda c: {r["doc_id"] for r in df.where(c).collect()}
    at = lambda w, t: [i for i, x in enumerate(w) if x == t]
    for k in (1, 2, 4):
        assert found(plans.near(F.col("w"), "a", "b", k)) == {i for i, w in rows if any(abs(x - y) <= k for x in at(w, "a") for y in at(w, "b"))}
        assert found(plans.within(F.col("w"), ["a", "b", "c"], k + 2)) == {i for i, w in rows if any({"a", "b", "c"} <= set(w[j : j + k + 2]) for j in range(len(w)))}
    assert found(plans.phrase_at(F.col("w"), ["a", "b", "a"])) == {i for i, w in rows if any(w[j : j + 3] == ["a", "b", "a"] for j in range(len(w)))}


def test_cached_index(spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    assert [index.cached(docs, path)[2], index.cached(docs, path)[2], index.cached(docs.limit(50), path)[2]] == [False, True, False]


def test_late_events_are_dropped(spark, tmp_path):
    """The second file has one row inside and one behind the watermark that the first one set."""
    schema = "ts timestamp, event_type string, value double"
    for i, rows in enumerate([["2024-01-01 10:00:00", "2024-01-02 10:00:00"], ["2024-01-01 09:00:00", "2024-01-02 09:30:00"]]):
        spark.sql("select * from values " + ", ".join(f"(timestamp'{t}', 'x', 1.0D)" for t in rows) + " as t(ts, event_type, value)").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        flows.to_folder(flows.windows(stream, "1 hour"), f"file://{tmp_path}/out")
    spark.sql("select timestamp'2024-01-09 00:00:00' ts, 'x' event_type, 1.0D value").write.mode("append").parquet(f"{tmp_path}/in")
    got = flows.to_folder(flows.windows(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "1 hour"), f"file://{tmp_path}/out")
    assert sorted(str(r["start"])[:13] for r in got.collect()) == ["2024-01-01 10", "2024-01-02 09", "2024-01-02 10"]
