"""What larger tables and odd rows brought to light: sums, empty matches, spreading of work."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import registry
from tessera.functions import text as texts
from tessera.operators import cluster, dedup, index, keywords, nlp, ranking, recommend
from tessera.sources import articles


def test_manifest_of_many_rows(spark):
    n = 140_000  # their hashes add up to more than a long holds
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    want = sum(int(hashlib.md5(f"{i}|x".encode()).hexdigest()[:12], 16) for i in range(n))
    assert want >= 2**63
    assert tuple(index.manifest(docs).first()) == ("1", n, want % 2**63)


def test_stored_index_of_many_rows(spark, tmp_path):
    docs = spark.range(140_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    path = f"file://{tmp_path}/index"
    assert not index.cached(docs, path)[2] and index.cached(docs, path)[2]
    post, lengths, _ = index.cached(docs, path)
    assert [r["doc_id"] for r in index.stored_bm25(post, lengths, ["x"]).collect()] == list(range(10))


def test_stored_index_query_of_many_rows(spark, tmp_path):
    # The whole query against its SQL, over more rows than the old digest held.
    words = F.concat(*[F.repeat(F.lit(f"{w} "), (F.col("id") % n).cast("int")) for w, n in (("The", 7), ("and", 5), ("of", 3), ("kelp", 11))])
    docs = spark.range(0, 140_000, 1, 8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 999 != 0, words).alias("text"))
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = registry.queries()["stored_index_bm25"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(registry.oracle_sql()["stored_index_bm25"])
    assert len(want) == 10 and sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


def test_detail_without_matches(spark):
    rows = [(1, "le chat est ici", "fr", "src1", 15), (2, "", "en", "src1", 0), (3, None, None, None, None), (4, "the cat and the dog", "en", "src2", 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {i: nlp.detail(docs, i, ["the", "and", "of"]).collect() for i in range(1, 6)}
    assert [(r["distinct_terms"], r["keywords"], r["matched"]) for i in range(1, 5) for r in got[i]] == [(4, "chat,est,ici,le", None), (0, None, None), (0, None, None), (4, "cat,dog", "and,the")]
    assert got[5] == []


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rake_shuffles_nothing(spark):
    docs = spark.createDataFrame([(1, "Deep kelp grows, deep kelp dives. Deep kelp"), (2, None), (3, "the of. and"), (None, "kelp")], "doc_id long, text string")
    got = nlp.rake(docs)
    assert "Exchange" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, "deep kelp", 5.333333), (1, "deep kelp dives", 8.333333), (1, "deep kelp grows", 8.333333)]


def test_greedy_settles_long_chains(spark, monkeypatch):
    # Each fingerprint is near its neighbours alone, so 70 rounds are needed where 30 were made.
    n = 70
    prints = [0]
    for i in range(n - 1):
        prints.append(prints[-1] ^ (0b11 << (2 * (i % 31)) if (i // 31) % 2 == 0 else 0b101 << (3 * (i % 20))))
    kept, near = [], lambda x, y: (x ^ y).bit_count() <= 3
    for i, h in enumerate(prints):
        if not any(near(h, prints[j]) for j in kept):
            kept.append(i)
    docs = spark.createDataFrame(list(enumerate(prints)), "doc_id long, h long")
    monkeypatch.setattr(dedup, "fingerprints", lambda d: d)
    got = dedup.greedy(docs).collect()
    assert len(got) == n and sorted(r["doc_id"] for r in got if r["kept"]) == kept and all(r["kept"] is not None for r in got)


def test_fingerprints_in_slices(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 9))) for i in range(40)] + [(40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["h"] for r in index.tokens(docs).select("doc_id", texts.simhash(F.col("w")).alias("h")).collect()}
    monkeypatch.setattr(dedup, "TOKENS", 7)
    got = dedup.fingerprints(docs)
    assert {r["doc_id"]: r["h"] for r in got.collect()} == want
    assert "MapInArrow" in plan(got)


def test_best_unseen_is_exact():
    rng = np.random.default_rng(5)
    for n, m, k, step in ((9, 200, 4, 16), (5, 3, 4, 8), (6, 700, 3, 64)):
        u, v = rng.normal(size=(n, 5)).astype(np.float32), rng.normal(size=(m, 5)).astype(np.float32)
        v[m // 2 :: 7] = v[0]  # equal items go by id
        ids = rng.permutation(10 * m)[:m].astype(np.int32)
        order = np.lexsort((ids, -np.linalg.norm(v, axis=1)))
        ids, v = ids[order], v[order]
        seen = [rng.choice(ids, int(rng.integers(0, m)), replace=False).tolist() + [-5] for _ in range(n)]
        got = list(zip(*(x.tolist() for x in recommend.best_unseen(u, seen, ids, v, k, step)), strict=True))
        exact = np.round(u.astype(float) @ v.astype(float).T, 4)
        want = [(i, -s, j) for i in range(n) for s, j in sorted((-exact[i, c], int(ids[c])) for c in range(m) if ids[c] not in set(seen[i]))[:k]]
        assert [(i, round(s, 4), j) for i, j, s in got] == [(i, round(s, 4), j) for i, s, j in want]


def test_factor_lists_of_who_saw_much(spark):
    # User 0 has rated all but two of 320 items, more than the 200 that were taken from the model besides k.
    rows = [(u, i, float(1 + (3 * i + u) % 5)) for u in range(6) for i in range(320) if (i not in (7, 300) if u == 0 else i % 4 != u % 4)]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    for block in (100, 2_000_000):
        got = recommend.factor_lists(ratings, 3, block).collect()
        assert {r["item_id"] for r in got if r["user_id"] == 0} == {7, 300}
        assert all(sorted(r["rank"] for r in got if r["user_id"] == u) == [1, 2, 3] for u in range(1, 6))


def test_field_postings_compare_no_structs(spark):
    docs = spark.createDataFrame([(1, "a b a", "A b", ["x y", "y"]), (2, None, "", None)], "doc_id long, text string, source string, tags array<string>")
    got = index.field_postings(docs, ["text"], ["source"], ["tags"])
    assert "array_distinct(flatten(array_compact" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [("source", "a b", 1), ("tags", "x", 1), ("tags", "y", 1), ("text", "a", 1), ("text", "b", 1)]
    twice = index.field_postings(docs, ["text"], ["text"])
    assert sorted(map(tuple, twice.collect())) == [("text", "a", 1), ("text", "a b a", 1), ("text", "b", 1)]
    assert sorted(map(tuple, index.field_stats(got).collect())) == [("source", 1, 1, 1), ("tags", 2, 2, 1), ("text", 2, 2, 1)]


def test_grams_without_lambdas(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "a"), (3, None)], "doc_id long, text string")
    got = index.grams(docs, 2)
    assert "lambda" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, "a", "b"), (1, "a", "b"), (1, "b", "a")]
    assert index.grams(docs, 5).count() == 0
    assert {(*r["ngram"], r["n"]) for r in index.ngram_counts(docs, 3).collect()} == {("a", "b", "a", 1), ("b", "a", "b", 1)}
    assert "Scan parquet" in plan(nlp.collocations(docs, "t", 1)) and "regexp_extract_all" not in plan(nlp.collocations(docs, "t", 1))


def test_folders_of_part_files(spark, tmp_path):
    from tessera import table_queries

    docs = spark.range(0, 400, 1, 4).select(F.col("id").cast("string").alias("article_id"), F.lit("x").alias("content"))
    path = f"file://{tmp_path}/jsonl"
    table_queries._two_files(spark, docs, path)
    assert all(len(list((tmp_path / "jsonl" / f).glob("part-*"))) == 4 for f in "ab")
    got = articles.read_folder(spark, f"{path}/*", most_per_file=70, schema="article_id string, content string").collect()
    assert sorted(int(r["article_id"]) for r in got) == list(range(140))
    assert [r["article_id"] for r in articles.read_folder(spark, f"{path}/*", most=3, schema="article_id string, content string").collect()] == ["0", "2", "4"]


def test_lda_keeps_no_tokens(spark, monkeypatch):
    import pyspark.ml.feature

    monkeypatch.setattr(pyspark.ml.feature, "CountVectorizer", None)
    docs = spark.createDataFrame([(i, f"all w{i % 3} w{i % 3} v{i}") for i in range(9)], "doc_id long, text string")
    model, rows, words = cluster.lda(docs, 2)
    assert words == ["w0", "w1", "w2"] and rows.count() == 9


def test_dense_batch_in_slices(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.integers(-2, 3, size=(120, 3)) + 0.5)], "vec_id long, embedding array<double>")
    one, many = (sorted(map(tuple, ranking.dense_batch(df, df["vec_id"] % 10 == 0, 5, 4096, step).collect())) for step in (1000, 7))
    assert one == many and len(one) == 60


ODD = ["", None, "Kelp kelp 中文kelp7 日本語-b", "aéb 一鿿䷿ꀀ x", "K İx", "the the the of", "z9"]


def test_postings_are_those_of_the_expression(spark, monkeypatch):
    # The array functions took about 150 core seconds for 0.1 GB.
    monkeypatch.setattr(index, "PART", 8)  # parts end between all texts
    docs = spark.createDataFrame([*enumerate(ODD), (None, "kelp z9")], "doc_id int, text string")
    want = index.tokens(docs).select("doc_id", F.explode("w").alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    got = index.postings(docs)
    assert "transform(" not in plan(got) and got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert sorted(map(repr, index.postings(docs, texts.words).collect())) != []
    stats = want.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    assert sorted(map(tuple, index.corpus_stats(docs).collect())) == sorted(map(tuple, stats.collect()))


def test_keyword_ranking_shuffles_no_postings(spark, monkeypatch):
    monkeypatch.setattr(index, "COMMON", 1)  # so that most documents are settled by the join
    docs = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "d e"), (4, "f f"), (5, "b g"), (5, "h"), (6, ""), (None, "a")], "doc_id long, text string")
    got = index.keyword_ranking(docs)
    assert "Generate" not in plan(got) and "MapInArrow" not in plan(got)  # only what was saved is read again
    n = 4  # documents 1, 2, 4 and 5 hold a, b or f; the null id doesn't count
    want = [("a", 4, 3), ("b", 2, 2), ("f", 2, 1)]
    want = [(t, cf, df, round(cf / 13 * (math.log((n + 1) / (df + 1)) + 1), 9)) for t, cf, df in want]
    assert list(map(tuple, got.collect())) == sorted(want, key=lambda r: (-r[3], r[0]))


@pytest.mark.parametrize("most", [1 << 18, 40, 3, 0])
def test_top_terms_by_any_number_of_known_terms(spark, most, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(120)], k=rng.randrange(60)))) for i in range(150)] + [(7, "w1 w1 zz"), (None, "w3 yy"), (999, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    post = index.postings(docs)
    w = post.join(index.term_stats(post), "term").select("doc_id", "term", F.round((1 + F.log10("tf")) * F.log10(F.lit(float(len(rows))) / F.col("df")), 6).alias("w"))
    want = w.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("w"), "term"))).where("rank <= 5")
    got = ranking.top_terms(docs, most=most)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_textrank_of_many_texts_at_once(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["the", "of", "x"]
    every = ["", "kelp", "kelp kelp", "the of", "kelp of kelp urchin", *[" ".join(rng.choices(words, k=rng.randrange(1, 90))) for _ in range(60)]]

    def plain(tokens):  # every edge once for each time it occurs, 50 rounds
        terms = sorted(set(tokens))
        m = np.zeros((len(terms), len(terms)))
        for i, x in enumerate(tokens):
            for y in tokens[i + 1 : i + 5]:
                if x != y:
                    m[terms.index(x), terms.index(y)] += 1
                    m[terms.index(y), terms.index(x)] += 1
        degree, rank = m.sum(axis=1), np.full(len(terms), 1 / max(len(terms), 1))
        for _ in range(50):
            rank = 0.15 / len(terms) + 0.85 * ((rank / np.where(degree > 0, degree, 1)) @ m + rank[degree == 0].sum() / len(terms))
        return dict(zip(terms, rank, strict=True))

    lists = [t.split() for t in every]
    for got, tokens in zip(keywords.ranked_each(lists, most=100), lists, strict=True):
        want = plain(tokens) if tokens else {}
        assert list(got) == list(want) and np.allclose(list(got.values()), list(want.values()), rtol=0, atol=1e-12)
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    monkeypatch.setattr(keywords, "CHARACTERS", 300)
    rows = sorted(map(tuple, keywords.extract(docs, "textrank", 4).collect()))
    assert rows == [(i, r, p, s) for i, t in enumerate(every) for r, (p, s) in enumerate(keywords.textrank_phrases(t, 4), 1)]
