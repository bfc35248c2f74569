"""All queries of the library proper over the given tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import cluster, dedup, facets, feedback, index, metrics, nlp, ranking, recommend
from tessera.plans import query as plans
from tessera.sources import articles
from tessera.streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

TERMS = ["the", "and", "of"]
SEED_DOC, SEED_VEC, SEED_USER = 1, 7, 1

_CTES = {
    "w": "w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\x{4e00}-\\x{9fff}]+|[a-z0-9]+') w from documents)",
    "tok": "tok as (select doc_id, unnest(w) term, (generate_subscripts(w, 1) - 1)::int pos from w)",
    "p": "p as (select term, doc_id, count(*)::int tf from tok group by all)",
    "s": "s as (select doc_id, len(w)::int dl, len(list_distinct(w))::int uniq from w)",
    "t": "t as (select term, count(*) df, sum(tf)::bigint cf from p group by term)",
    "n": "n as (select count(*)::double n, avg(dl) avgdl, sum(dl)::double total from s)",
}


def _with(body: str, *more: str) -> str:
    return f"with {', '.join([*_CTES.values(), *more])} {body}"


def _q(terms: list[str]) -> str:
    return "q as (select * from (values " + ", ".join(f"('{t}', {terms.count(t)})" for t in dict.fromkeys(terms)) + ") v(term, qtf))"


def _top(body: str, k: int = 10, key: str = "doc_id") -> str:
    return f"select {key}, score, row_number() over (order by score desc, {key})::int rank from (select {key}, round(score, 6) score from ({body}) order by round(score, 6) desc, {key} limit {k})"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on(name: str, table: str, fn: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = lambda spark, sf_dir: fn(_read(spark, sf_dir, table))
    if sql:
        _SQL[name] = sql


def _docs(name: str, fn: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    _on(name, "documents", fn, sql)


# tokens and indexes

def _token_counts(tokenizer: Callable[[str], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda d: index.tokens(d, tokenizer).select("doc_id", F.size("w").alias("tokens"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


_docs("tokens_t1", _token_counts(text.lexical), _with("select doc_id, len(w)::int tokens, md5(array_to_string(w, ' ')) digest from w"))
_docs("tokens_t2", _token_counts(text.words), "select doc_id, len(w)::int tokens, md5(array_to_string(w, ' ')) digest from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') w from documents)")
_docs("postings", index.postings, _with("select term, doc_id, tf from p"))
_docs("doc_stats", index.doc_stats, _with("select doc_id, dl, uniq from s"))
_docs("term_stats", lambda d: index.term_stats(index.postings(d)), _with("select term, df, cf from t"))
_docs("index_stats", index.index_stats, _with("select count(*) doc_count, (select count(*) from t) vocabulary, (select sum(df)::bigint from t) postings, round((select sum(df) from t) / (select count(*) from t), 6) avg_postings, round(avg(dl), 6) avg_dl from s"))
_docs("positions", lambda d: index.position_lists(d).select("term", "doc_id", F.array_join(F.transform("positions", lambda x: x.cast("string")), " ").alias("positions")), _with("select term, doc_id, string_agg(pos::varchar, ' ' order by pos) positions from tok group by all"))
_docs("stopword_ratio", lambda d: index.tokens(d).select("doc_id", F.round(1 - F.size(text.without_stopwords(F.col("w"))) / F.when(F.size("w") > 0, F.size("w")), 6).alias("ratio")), _with("select doc_id, round(1 - len(list_filter(w, lambda x: not list_contains([" + ", ".join(f"'{s}'" for s in text.STOPWORDS) + "], x))) / nullif(len(w), 0), 6) ratio from w"))
_docs("postings_and", lambda d: _two(d, index.intersect), _with("select a.doc_id, a.tf from p a semi join (select doc_id from p where term = 'that') b using (doc_id) where a.term = 'the'"))
_docs("postings_or", lambda d: _two(d, index.union), _with("select doc_id, coalesce(a.tf, b.tf) tf from (from p where term = 'the') a full join (from p where term = 'that') b using (doc_id)"))
_docs("postings_not", lambda d: index.negate(d, index.matches(d, ["the"])), _with("select doc_id, 0 tf from documents anti join (select doc_id from p where term = 'the') using (doc_id)"))


def _two(d: DataFrame, fn: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    return fn(index.matches(d, ["the"]).select("doc_id", "tf"), index.matches(d, ["that"]).select("doc_id", "tf"))


_docs("field_postings", lambda d: index.field_postings(d.withColumnRenamed("lang", "category"), ["text"], ["source", "category"]), _with("select 'text' field, term, doc_id from p union all select 'source', lower(source), doc_id from documents where source <> '' union all select 'category', lower(lang), doc_id from documents where lang <> ''"))
_docs("prefix_search", lambda d: index.prefix_search(index.term_stats(index.postings(d)), "the"), _with("select term, df, cf from t where starts_with(term, 'the')"))
_docs("wildcard_expand", lambda d: index.wildcard_expand(index.term_stats(index.postings(d)), "th*in?"), _with("select term, df, cf from t where regexp_full_match(term, 'th.*in.') order by term limit 50"))
_docs("fuzzy_expand", lambda d: index.fuzzy_expand(index.term_stats(index.postings(d)), "thing", 2), _with("select term, levenshtein('thing', term)::int distance from t where levenshtein('thing', term) <= 2 order by 2, 1 limit 50"))
_docs("trie_keywords", lambda d: index.keyword_ranking(d), _with("select term, cf, df, round(cf / (select sum(cf) from t)::double * (ln(((select count(distinct doc_id) from p semi join c using (term)) + 1)::double / (df + 1)) + 1), 9) score from c order by score desc, term limit 20", "c as (select * from t where cf >= 2)"))
_docs("ngrams", lambda d: index.ngram_counts(d, 2).select(F.array_join("ngram", " ").alias("ngram"), "n").where("n >= 3"), _with("select a.term || ' ' || b.term ngram, count(*) n from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 group by 1 having count(*) >= 3"))
_PATTERN_SQL = _with(
    "select pattern, n, round(log2(n / tt) - (select sum(log2(cf / tt)) from t where term = x.a) - (select sum(log2(cf / tt)) from t where term = x.b) - coalesce((select sum(log2(cf / tt)) from t where term = x.c), 0), 6) mi from g x, (select sum(cf)::double tt from t) order by mi desc, pattern limit 20",
    "g as (select a.term || ' ' || b.term pattern, a.term a, b.term b, null c, count(*) n from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 group by all having count(*) >= 5 union all select a.term || ' ' || b.term || ' ' || c.term, a.term, b.term, c.term, count(*) from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 join tok c on a.doc_id = c.doc_id and c.pos = a.pos + 2 group by all having count(*) >= 5)",
)
_docs("patterns_mi", index.patterns, _PATTERN_SQL)
_VB = "case when g < 128 then 1 when g < 16384 then 2 when g < 2097152 then 3 else 4 end"
_docs(
    "gap_codecs",
    lambda d: index.compressed_sizes(index.postings(d)),
    _with(
        f"select term, count(*) * 4 raw_bytes, sum({_VB})::bigint vbyte_bytes, sum(2 * b - 1)::bigint gamma_bits, sum(2 * (floor(log2(b)) + 1) - 1 + b - 1)::bigint delta_bits from (select *, (floor(log2(g)) + 1)::bigint b from g) group by term",
        "g as (select term, doc_id - coalesce(lag(doc_id) over (partition by term order by doc_id), -1) g from p)",
    ),
)

# ranking

_BM25 = "select doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)){plus})) score from p join q using (term) join t using (term) join s using (doc_id), n group by doc_id"
_docs("bm25_topk", lambda d: ranking.bm25(d, TERMS), _with(_top(_BM25.format(plus="")), _q(TERMS)))
_docs("bm25_plus", lambda d: ranking.bm25(d, TERMS, delta=1.0), _with(_top(_BM25.format(plus=" + 1.0")), _q(TERMS)))
_docs("bm25_repeated_terms", lambda d: ranking.bm25(d, ["the", "the", "that"]), _with(_top(_BM25.format(plus="")), _q(["the", "the", "that"])))
_docs("wand_bounds", lambda d: ranking.term_bounds(d, TERMS), _with("select term, df, max(tf) max_tf, round(max(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) upper from p join q using (term) join t using (term) join s using (doc_id), n group by all", _q(TERMS)))
_docs("bm25_explain", lambda d: ranking.bm25_explain(d, TERMS, SEED_DOC), _with(f"select term, tf, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 4) idf, round(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)), 4) score from p join q using (term) join t using (term) join s using (doc_id), n where doc_id = {SEED_DOC}", _q(TERMS)))
_QUERIES["bm25_batch"] = lambda spark, d: ranking.bm25_batch(_read(spark, d, "documents"), _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
_SQL["bm25_batch"] = _with(
    "select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id)::int rank from (select query_id, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score from q join p using (term) join t using (term) join s using (doc_id), n group by all)) where rank <= 10",
    "q as (select query_id, term, count(*) qtf from (select item_id query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\x{4e00}-\\x{9fff}]+|[a-z0-9]+')) term from benchmark) group by all)",
)
_LTC = "v as (select doc_id, term, x / sqrt(sum(x * x) over (partition by doc_id)) w from (select doc_id, term, (1 + log10(tf)) * log10(n / df) x from p join t using (term), n) where x > 0)"
_docs("tfidf_cosine_vectors", lambda d: ranking.doc_vectors(d).select("doc_id", "term", F.round("w", 6).alias("w")), _with("select doc_id, term, round(w, 6) w from v", _LTC))


def _tf(scheme: str) -> Callable[[DataFrame], DataFrame]:
    return lambda d: index.postings(d).select("doc_id", "term", F.round(ranking.tf_weight(scheme, F.col("tf"), F.max("tf").over(W.partitionBy("doc_id"))), 6).alias("w"))


_docs("tf_log", _tf("l"), _with("select doc_id, term, round(1 + log10(tf), 6) w from p"))
_docs("tf_augmented", _tf("a"), _with("select doc_id, term, round(0.5 + 0.5 * tf / max(tf) over (partition by doc_id), 6) w from p"))
_docs("tf_boolean", _tf("b"), _with("select doc_id, term, 1.0::double w from p"))


def _idf(scheme: str) -> Callable[[DataFrame], DataFrame]:
    return lambda d: index.term_stats(index.postings(d)).select("term", F.round(ranking.idf_weight(scheme, d.agg(F.count(F.lit(1)).cast("double")).scalar(), F.col("df")), 6).alias("idf"))


_docs("idf_log", _idf("t"), _with("select term, round(log10(n / df), 6) idf from t, n"))
_docs("idf_prob", _idf("p"), _with("select term, case when df >= n then 0 else round(log10((n - df) / df), 6) end idf from t, n"))
_docs("top_terms_per_doc", ranking.top_terms, _with("select * from (select doc_id, term, w, row_number() over (partition by doc_id order by w desc, term)::int rank from (select doc_id, term, round((1 + log10(tf)) * log10(n / df), 6) w from p join t using (term), n)) where rank <= 5"))
_QN = "qn as (select sqrt(sum(qw * qw)) qn from qv)"
_docs("vsm_lnc_ltc", lambda d: ranking.vsm(d, TERMS), _with(_top("select doc_id, sum(w * qw) / any_value(qn) score from v join qv using (term), qn group by doc_id having sum(w * qw) > 0"), _LTC, _q(TERMS), "qv as (select term, 1 + log10(qtf) qw from q)", _QN))
_docs("vsm_ltc_ltc", lambda d: ranking.vsm(d, TERMS, query_idf=True), _with(_top("select doc_id, sum(w * qw) / any_value(qn) score from v join qv using (term), qn group by doc_id having sum(w * qw) > 0"), _LTC, _q(TERMS), "qv as (select term, (1 + log10(qtf)) * log10(n / df) qw from q join t using (term), n)", _QN))
_docs("doc_similarity", lambda d: ranking.similar_documents(d, SEED_DOC), _with(_top(f"select b.doc_id, sum(a.w * b.w) score from v a join v b using (term) where a.doc_id = {SEED_DOC} and b.doc_id <> {SEED_DOC} group by b.doc_id"), _LTC))
_LM = "select doc_id, sum(qtf * ln(case when pr > 0 then pr else 1e-10 end)) score from (select s.doc_id, qtf, {pr} pr from s, q, n left join p on p.doc_id = s.doc_id and p.term = q.term left join t on t.term = q.term) group by doc_id"
_PC = "coalesce(cf / total, 1 / (select count(*) from t)::double)"
for _m, _pr in {
    "jm": f"case when dl > 0 then 0.7 * coalesce(tf, 0) / dl else 0 end + (1 - 0.7) * {_PC}",
    "dirichlet": f"(coalesce(tf, 0) + 2000.0 * {_PC}) / (dl + 2000.0)",
    "absolute": f"case when dl > 0 then greatest(coalesce(tf, 0) - 0.7, 0) / dl + 0.7 * uniq / dl * {_PC} else {_PC} end",
}.items():
    _docs(f"lm_{_m}", lambda d, m=_m: ranking.language_model(d, TERMS, m), _with(_top(_LM.format(pr=_pr.replace("0.7 ", "0.7::double ").replace("- 0.7", "- 0.7::double"))), _q(TERMS)))
_docs("lm_candidates", lambda d: ranking.language_model(d, ["that", "with"], candidates_only=True), _with(_top("select doc_id, sum(ln(0.7 * coalesce(tf, 0) / dl + (1 - 0.7::double) * cf / total)) score from (select s.doc_id, dl, q.term, cf, total, p.tf from s, q, n left join p on p.doc_id = s.doc_id and p.term = q.term join t on t.term = q.term where s.doc_id in (select doc_id from p join q using (term))) group by doc_id"), _q(["that", "with"])))
_docs("lm_kl", lambda d: ranking.lm_divergence(d, TERMS), _with(_top("select doc_id, -sum(pq * ln(pq / (0.7 * coalesce(tf, 0) / dl + (1 - 0.7::double) * cf / total))) score from (select s.doc_id, dl, q.term, qtf / 3.0::double pq, cf, total, p.tf from s, q, n left join p on p.doc_id = s.doc_id and p.term = q.term join t on t.term = q.term where s.doc_id in (select doc_id from p join q using (term))) group by doc_id"), _q(TERMS)))
_docs("bim_idf", lambda d: ranking.bim(d, ["that", "with", "thing"]), _with(_top("select doc_id, sum(greatest(0, ln((n - df + 0.5) / (df + 0.5)))) score from p join q using (term) join t using (term), n group by doc_id having sum(greatest(0, ln((n - df + 0.5) / (df + 0.5)))) > 0"), _q(["that", "with", "thing"])))
_REL = [1, 2, 5]
_docs("bim_rsj", lambda d: ranking.bim(d, ["that", "with"], relevant=_REL), _with(_top("select doc_id, sum(w) score from p join (select term, ln((r + 0.5) / 4.0 * (1 - (df - r + 0.5) / (n - 3 + 1)) / ((1 - (r + 0.5) / 4.0) * ((df - r + 0.5) / (n - 3 + 1)))) w from (select term, df, (select count(*) from p where p.term = t.term and doc_id in (1, 2, 5))::double r from t join q using (term)), n) using (term) group by doc_id having sum(w) > 0"), _q(["that", "with"])))
_COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"
_on("dense_topk", "embeddings", lambda v: ranking.dense(v, SEED_VEC), _top(f"select b.vec_id, {_COS} score from embeddings a, embeddings b where a.vec_id = {SEED_VEC} and b.vec_id <> {SEED_VEC}", key="vec_id"))
_on("content_similar_filtered", "embeddings", lambda v: ranking.dense(v, SEED_VEC, where=F.col("label") == 1), _top(f"select b.vec_id, {_COS} score from embeddings a, embeddings b where a.vec_id = {SEED_VEC} and b.vec_id <> {SEED_VEC} and b.label = 1", key="vec_id"))

# fusion

_RUN_SQL = {"bm25": _top(_BM25.format(plus=""), 50), "bim": _top("select doc_id, sum(greatest(0, ln((n - df + 0.5) / (df + 0.5)))) score from p join q using (term) join t using (term), n group by doc_id having sum(greatest(0, ln((n - df + 0.5) / (df + 0.5)))) > 0", 50), "vsm": _top("select doc_id, sum(w * qw) / any_value(qn) score from v join qv using (term), qn group by doc_id having sum(w * qw) > 0", 50)}
_FUSE_TERMS = ["that", "with", "thing"]
_RUNS = [_LTC, _q(_FUSE_TERMS), "qv as (select term, 1 + log10(qtf) qw from q)", _QN, "runs as (" + " union all ".join(f"select '{m}' model, * from ({s})" for m, s in _RUN_SQL.items()) + ")"]


def _runs(d: DataFrame) -> DataFrame:
    parts = {"bm25": ranking.bm25(d, _FUSE_TERMS, 50), "bim": ranking.bim(d, _FUSE_TERMS, 50), "vsm": ranking.vsm(d, _FUSE_TERMS, 50)}
    out = None
    for m, r in parts.items():
        one = r.select(F.lit(m).alias("model"), "doc_id", "score", "rank")
        out = one if out is None else out.unionByName(one)
    return out


def _fused(name: str, body: str, **how) -> None:
    _docs(name, lambda d: ranking.fuse(_runs(d), **how), _with(_top(body), *_RUNS))


_NORM = "select doc_id, sum(x / 3) score from (select doc_id, {x} x from (select *, min(score) over (partition by model) lo, max(score) over (partition by model) hi, avg(score) over (partition by model) mu, stddev_pop(score) over (partition by model) sd from runs)) group by doc_id"
_fused("fuse_linear_minmax", _NORM.format(x="case when hi = lo then 1 else (score - lo) / (hi - lo) end"))
_fused("fuse_zscore", _NORM.format(x="case when sd = 0 then 0 else (score - mu) / sd end"), normalise="zscore")
_fused("fuse_rrf", "select doc_id, sum(1 / 3::double / (60 + rank)) score from runs group by doc_id", method="rrf")
_fused("fuse_combsum", "select doc_id, sum(score / 3) score from runs group by doc_id", method="combsum")
_fused("fuse_combmnz", "select doc_id, sum(score / 3) * count(*) filter (score > 0) score from runs group by doc_id", method="combmnz")
_docs("model_overlap", lambda d: ranking.overlap(_runs(d)), _with("select a.model a, b.model b, count(*) shared from runs a join runs b using (doc_id) where a.model < b.model group by all", *_RUNS))
_docs("rank_span", lambda d: ranking.rank_span(_runs(d)), _with("select doc_id, count(*) models, (max(rank) - min(rank))::int span from runs group by doc_id order by span desc, doc_id limit 50", *_RUNS))
_docs("rocchio_expand", lambda d: ranking.rocchio(d, ["that", "with"], [1, 2], [5]), _with("select term, w, is_new from (select *, row_number() over (partition by is_new order by w desc, term) r from (select term, round(sum(x), 6) w, term not in ('that', 'with') is_new from (select term, qtf::double x from q union all select term, w * 0.75 / 2 from v where doc_id in (1, 2) union all select term, w * -0.15 from v where doc_id = 5) group by term) where w > 0) where not is_new or r <= 10", _LTC, _q(["that", "with"])))
_docs("field_boost", lambda d: ranking.field_boost(d, ["the", "en", "src1"], {"text": 0.06, "lang": 0.18, "source": 0.25}), _with("select doc_id, round(least(sum(w * least(hits, 3)), 1.5), 6) boost from (select doc_id, w, count(*) hits from (select doc_id, 0.06::double w from p where term in ('the', 'en', 'src1') union all select doc_id, 0.18 from documents where lang = 'en' union all select doc_id, 0.25 from documents where source = 'src1') group by all) group by doc_id"))
_docs("related_docs", lambda d: ranking.similar_documents(d, 3, 5), _with(_top("select b.doc_id, sum(a.w * b.w) score from v a join v b using (term) where a.doc_id = 3 and b.doc_id <> 3 group by b.doc_id", 5), _LTC))

# boolean and field queries

_HAS = "exists (select 1 from p where p.doc_id = d.doc_id and term = '{}')"


def _found(name: str, query: str, where: str, planner: plans.Planner | None = None) -> None:
    _docs(name, lambda d: (planner or plans.Planner()).run(d, query).select("doc_id"), _with(f"select doc_id from documents d where {where}"))


_found("bool_and", "the AND that", f"{_HAS.format('the')} and {_HAS.format('that')}")
_found("bool_or", "thing OR that", f"{_HAS.format('thing')} or {_HAS.format('that')}")
_found("bool_not", "NOT the", f"not {_HAS.format('the')}")
_found("bool_nested", "(the OR le) AND NOT (that OR est)", f"({_HAS.format('the')} or {_HAS.format('le')}) and not ({_HAS.format('that')} or {_HAS.format('est')})")
_found("phrase", '"of the"', "exists (select 1 from tok a join tok b on b.doc_id = a.doc_id and b.pos = a.pos + 1 where a.doc_id = d.doc_id and a.term = 'of' and b.term = 'the')")
_found("near_k", "the NEAR/3 that", "exists (select 1 from tok a join tok b on b.doc_id = a.doc_id and abs(b.pos - a.pos) <= 3 where a.doc_id = d.doc_id and a.term = 'the' and b.term = 'that')")
_docs("window_query", lambda d: d.where(plans.within(text.lexical("text"), ["the", "and", "of"], 8)).select("doc_id"), _with("select distinct a.doc_id from tok a join tok b on a.doc_id = b.doc_id join tok c on a.doc_id = c.doc_id where a.term = 'the' and b.term = 'and' and c.term = 'of' and greatest(a.pos, b.pos, c.pos) - least(a.pos, b.pos, c.pos) < 8"))
_found("wildcard_query", "thing*", "exists (select 1 from p where p.doc_id = d.doc_id and starts_with(term, 'thing'))")
_found("fuzzy_query", "thing~", "exists (select 1 from p where p.doc_id = d.doc_id and levenshtein(term, 'thing') <= 1)")
_FIELDS = plans.Planner(exact={"source", "lang"})
_found("field_term", "source:src1 AND lang:(fr OR de)", "source = 'src1' and lang in ('fr', 'de')", _FIELDS)
_found("field_range", "n_chars:[100 TO 900] AND NOT lang:en", "n_chars between 100 and 900 and lang <> 'en'", _FIELDS)
_docs("structured_query", lambda d: _FIELDS.run(d, plans.from_conditions([{"field": "lang", "operator": "match", "value": "en"}, {"field": "n_chars", "operator": "between", "value": [500, 2000]}])).select("doc_id"), "select doc_id from documents where lang = 'en' and n_chars between 500 and 2000")
_on("field_date_range", "orders", lambda o: index.date_range(o, "o_orderdate", "1995-01-01", "1995-06-30").select("o_orderkey"), "select o_orderkey from orders where substr(o_orderdate::varchar, 1, 10) between '1995-01-01' and '1995-06-30'")

# facets, filters

_on("facet_term", "orders", lambda o: facets.term_facet(o, "o_orderstatus"), "select o_orderstatus \"value\", count(*) \"count\" from orders group by 1 order by 2 desc, 1 limit 20")
_on("facet_date", "orders", lambda o: facets.date_facet(o, "o_orderdate"), "select strftime(o_orderdate, '%Y-%m') \"value\", count(*) \"count\" from orders group by 1")
_BUCKETS = [("low", None, 50000.0), ("mid", 50000.0, 150000.0), ("high", 150000.0, None)]
_on("facet_numeric", "orders", lambda o: facets.numeric_facet(o, "o_totalprice", _BUCKETS), "select case when o_totalprice < 50000 then 'low' when o_totalprice < 150000 then 'mid' else 'high' end \"value\", count(*) \"count\" from orders group by 1")
_on("facet_filtered", "orders", lambda o: facets.term_facet(facets.FilterSet().add("o_orderstatus", "in", ["O", "F"]).add("o_totalprice", "gte", 100000).apply(o), "o_orderpriority"), "select o_orderpriority \"value\", count(*) \"count\" from orders where o_orderstatus in ('O', 'F') and o_totalprice >= 100000 group by 1 order by 2 desc, 1 limit 20")
_docs("facet_all", lambda d: facets.facets(d, ["lang", "source"]), "select 'lang' field, lang \"value\", count(*) \"count\" from documents where lang is not null group by 2 union all select 'source', source, count(*) from documents where source is not null group by 2")
_docs("filter_ops", lambda d: facets.FilterSet().add("n_chars", "range", (100, 2000)).add("source", "startswith", "src1").add("text", "contains", "th").apply(d).select("doc_id"), "select doc_id from documents where n_chars between 100 and 2000 and starts_with(source, 'src1') and contains(text, 'th')")
_docs("filter_lexical_range", lambda d: facets.FilterSet([facets.Condition("n_chars", "range", ("10", "9"), lexical=True)]).apply(d).select("doc_id"), "select doc_id from documents where n_chars::varchar between '10' and '9'")
_on("browse_sorted", "orders", lambda o: facets.browse(o, date="o_orderdate", key="o_orderkey", k=50).select("o_orderkey", "o_orderstatus"), "select o_orderkey, o_orderstatus from orders order by o_orderdate desc, o_orderkey desc limit 50")
_docs("corpus_audit", lambda d: facets.audit(d, "n_chars"), "select count(n_chars) n, min(n_chars) low, max(n_chars) high, round(avg(n_chars), 6) mean, median(n_chars) median, count(distinct text) texts from documents")
_docs("field_quality", lambda d: facets.field_quality(d, ["text", "lang", "source"]), "select field, present, coverage, case when coverage >= 0.95 then 'good' when coverage >= 0.75 then 'watch' else 'poor' end status from (" + " union all ".join(f"select '{c}' field, count(*) filter ({c} <> '') present, round(count(*) filter ({c} <> '') / count(*), 6) coverage from documents" for c in ("text", "lang", "source")) + ")")

# feedback: events stand for clicks and searches

_on("top_queries", "events", lambda e: feedback.top_values(e, "user_id"), "select user_id, count(*) n, round(avg(value), 6) mean from events group by 1 order by 2 desc, 1 limit 20")
_on("zero_result_queries", "events", lambda e: feedback.zero_results(e, ["user_id", "event_type"], F.col("value") < 10), "select user_id, event_type, count(*) n, max(ts) \"last\" from events where value < 10 group by all order by n desc, user_id, event_type limit 20")
_on("model_ctr", "events", lambda e: feedback.rates(e, F.pmod("user_id", F.lit(5)), F.lit(True), F.col("event_type") == "click"), "select user_id % 5 grp, count(*) tries, count(*) filter (event_type = 'click') hits, round(count(*) filter (event_type = 'click') / count(*), 6) rate from events group by 1")
_on("relevance_distribution", "events", lambda e: feedback.grades(e, F.pmod("event_id", F.lit(3))), "select g::int grade, count(event_id) n from range(0, 4) r(g) left join events on event_id % 3 = g group by 1")
_on("position_bias", "events", lambda e: feedback.position_bias(e, F.pmod("event_id", F.lit(15)).cast("int")), "select case when r < 1 then 'unknown' when r = 1 then '1' when r <= 3 then '2-3' when r <= 10 then '4-10' else '11+' end bucket, count(*) n, round(avg(r), 6) mean_rank from (select event_id % 15 r from events) group by 1")
_on("session_metrics", "events", lambda e: feedback.sessions(e), "select user_id, min(ts) \"start\", count(*) n, round(sum(value), 4) total from (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) s from (select *, case when ts < lag(ts) over (partition by user_id order by ts) + interval 30 minute then 0 else 1 end new from events)) group by user_id, s")
_on("duplicate_events", "events", lambda e: feedback.duplicates(e.withColumn("day", F.to_date("ts")), ["user_id", "event_type", "day"]), "select user_id, event_type, ts::date \"day\", count(*) n from events group by all having count(*) > 1")
_on("recent_feedback", "events", lambda e: feedback.recent(e).select("event_id", "ts", "user_id"), "select event_id, ts, user_id from events order by ts desc, event_id desc limit 20")
_on("feedback_totals", "events", lambda e: e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "select event_type, count(*) n from events group by 1")
_on("event_windows", "events", feedback.daily, "select date_trunc('day', ts)::timestamp \"day\", event_type, count(*) n, round(sum(value), 4) total from events group by all")
_on("as_of_join", "events", lambda e: feedback.as_of(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), e.where("event_type = 'click'").select("user_id", "ts", "value"), "user_id", "ts", "value"), "select a.user_id, a.ts, a.event_id, (select b.value from events b where b.event_type = 'click' and b.user_id = a.user_id and b.ts <= a.ts order by b.ts desc limit 1) value_as_of from events a where a.event_type = 'purchase'")

# evaluation: rankings by length against quality labels, in groups of sources

_RUN = "run as (select source query_id, doc_id, row_number() over (partition by source order by n_chars desc, doc_id)::int rank from documents qualify rank <= 30)"
_QRELS = "qrels as (select source query_id, doc_id, (quality + 2 * toxic)::int rel from labels join documents using (doc_id))"
_J = "j as (select r.*, coalesce(rel, 0) rel, (coalesce(rel, 0) > 0)::int hit, sum((coalesce(rel, 0) > 0)::int) over (partition by query_id order by rank) hits, sum(1 - (coalesce(rel, 0) > 0)::int) over (partition by query_id order by rank) misses from run r left join qrels using (query_id, doc_id)), rr as (select query_id, count(*) filter (rel > 0) r from qrels group by 1), x as (select * from j join rr using (query_id))"


def _evaluation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = _read(spark, sf_dir, "documents")
    run = d.select(F.col("source").alias("query_id"), "doc_id", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank")).where("rank <= 30")
    qrels = _read(spark, sf_dir, "labels").join(d.select("doc_id", "source"), "doc_id").select(F.col("source").alias("query_id"), "doc_id", (F.col("quality") + 2 * F.col("toxic")).cast("int").alias("rel"))
    return run, qrels


def _metric(name: str, columns: list[str], body: str) -> None:
    _QUERIES[name] = lambda spark, d: metrics.per_query(*_evaluation(spark, d)).select("query_id", *columns)
    _SQL[name] = f"with {_RUN}, {_QRELS}, {_J} {body}"


_metric("precision_recall_k", ["precision", "recall", "f1", "p_at_k", "r_at_k", "success_at_k"], "select query_id, round(pr, 6) \"precision\", round(re, 6) recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) f1, round(hk / least(10, n), 6) p_at_k, round(coalesce(hk / nullif(r, 0), 0), 6) r_at_k, (hk > 0)::int success_at_k from (select query_id, any_value(r) r, count(*) n, sum(hit) / count(*) pr, coalesce(sum(hit) / nullif(any_value(r), 0), 0) re, coalesce(sum(hit) filter (rank <= 10), 0) hk from x group by 1)")
_metric("average_precision", ["ap"], "select query_id, round(coalesce(sum(hit * hits / rank) / nullif(any_value(r), 0), 0), 6) ap from x group by 1")
_metric("mrr", ["rr"], "select query_id, round(coalesce(1 / min(rank) filter (hit = 1), 0), 6) rr from x group by 1")
_metric("ndcg_k", ["dcg", "ndcg"], "select query_id, round(dcg, 6) dcg, round(coalesce(dcg / nullif(idcg, 0), 0), 6) ndcg from (select query_id, sum(case when rank <= 10 then (pow(2, rel) - 1) / log2(rank + 1) else 0 end) dcg from x group by 1) join (select query_id, sum((pow(2, rel) - 1) / log2(i + 1)) idcg from (select *, row_number() over (partition by query_id order by rel desc, doc_id) i from qrels) where i <= 10 group by 1) using (query_id)")
_metric("err_k", ["err"], "select query_id, round(sum(case when rank <= 10 then go * stop / rank else 0 end), 6) err from (select *, coalesce(exp(sum(ln(1 - stop)) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding)), 1) go from (select *, (pow(2, rel) - 1) / 8 stop from x)) group by 1")
_metric("rbp", ["rbp", "graded_rbp"], "select query_id, round(sum(0.2::double * pow(0.8::double, rank - 1) * hit), 6) rbp, round(sum(0.2::double * pow(0.8::double, rank - 1) * rel / 3), 6) graded_rbp from x group by 1")
_metric("bpref", ["bpref"], "select query_id, round(coalesce(sum(case when r > 0 then hit * (1 - least(misses, r) / r) end) / nullif(any_value(r), 0), 0), 6) bpref from x group by 1")
_metric("r_precision", ["r_precision"], "select query_id, round(coalesce(sum(case when rank <= r then hit else 0 end) / nullif(any_value(r), 0), 0), 6) r_precision from x group by 1")
_QUERIES["evaluate_run"] = lambda spark, d: metrics.overall(*_evaluation(spark, d))
_SQL["evaluate_run"] = f"with {_RUN}, {_QRELS}, {_J}, m as (select query_id, coalesce(sum(hit * hits / rank) / nullif(any_value(r), 0), 0) ap, coalesce(1 / min(rank) filter (hit = 1), 0) rr, sum(case when rank <= 10 then (pow(2, rel) - 1) / log2(rank + 1) else 0 end) dcg from x group by 1), i as (select query_id, sum((pow(2, rel) - 1) / log2(i + 1)) idcg from (select *, row_number() over (partition by query_id order by rel desc, doc_id) i from qrels) where i <= 10 group by 1) select count(*) queries, round(avg(ap), 6) map, round(avg(rr), 6) mrr, round(exp(avg(ln(ap + 1e-10))), 6) gmap, round(avg(coalesce(dcg / nullif(idcg, 0), 0)), 6) mean_ndcg from m join i using (query_id)"
_QUERIES["pr_curve_11pt"] = lambda spark, d: metrics.pr_curve(*_evaluation(spark, d))
_SQL["pr_curve_11pt"] = f"with {_RUN}, {_QRELS}, {_J} select i / 10 \"level\", round(avg(p), 6) \"precision\" from (select query_id, i, coalesce(max(case when hits / r >= i / 10 - 1e-12 then hits / rank end), 0) p from x, range(0, 11) l(i) where r > 0 group by all) group by i"

# language models, collocations, summaries, keywords

_BI = "bi as (select a.term a, b.term b, count(*) n from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 group by all), ctx as (select a, sum(n)::double c from bi group by a), rgt as (select b, sum(n)::double c from bi group by b), u as (select count(*)::double v, sum(cf)::double total from t)"
for _m, _p in {"laplace": "(n + 1) / (c + v)", "mle": "n / c", "jm": "0.7::double * n / c + (1 - 0.7::double) * (cf / total)", "dirichlet": "(n + 2000.0::double * (cf / total)) / (c + 2000.0)"}.items():
    _docs(f"ngram_{_m}", lambda d, m=_m: nlp.ngram_probability(d, m), _with(f"select a, b, round({_p}, 9) p from bi join ctx using (a) join t on t.term = b, u", _BI))
_PAIRS = ["pr as materialized (select doc_id, w[i] a, w[i + 1] b from (select doc_id, w, unnest(range(1, len(w))) i from w))", "bi as (select a, b, count(*) n from pr group by all)", "ctx as (select a, sum(n)::double c from bi group by a)"]
_docs("perplexity", lambda d: nlp.perplexity(d, d), _with("select doc_id, sum(m)::bigint tokens, round(pow(2, -sum(m * log2(0.7::double * n / c + (1 - 0.7::double) * (cf / total))) / sum(m)), 4) perplexity from (select doc_id, a, b, count(*) m from pr group by all) join bi using (a, b) join ctx using (a) join t on t.term = b, (select sum(cf)::double total from t) group by doc_id", *_PAIRS))
_CELLS = [("o11", "n1 * n2 / big"), ("greatest(n1 - o11, 0)", "n1 * (big - n2) / big"), ("greatest(n2 - o11, 0)", "(big - n1) * n2 / big"), ("greatest(big - n1 - n2 + o11, 0)", "(big - n1) * (big - n2) / big")]
for _m, _p in {
    "pmi": "log2(o11 * big / (n1 * n2))",
    "llr": "2 * (" + " + ".join(f"case when {o} > 0 and {e} > 0 then {o} * ln({o} / ({e})) else 0 end" for o, e in _CELLS) + ")",
    "chi2": " + ".join(f"case when {e} > 0 then ({o} - {e}) * ({o} - {e}) / ({e}) else 0 end" for o, e in _CELLS),
    "t": "(o11 / big - n1 / big * (n2 / big)) / sqrt(o11 / big / big)",
    "dice": "2 * o11 / (n1 + n2)",
}.items():
    _docs(f"collocation_{_m}", lambda d, m=_m: nlp.collocations(d, m), _with(f"select a, b, n, round({_p}, 6) score from (select a, b, n, n::double o11, ctx.c n1, rgt.c n2, (select sum(n)::double from bi) big from bi join ctx using (a) join rgt using (b) where n >= 5) order by score desc, a, b limit 100", _BI))
_SENT = "sp as (select doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?。！？]+'), lambda x: trim(x)), lambda x: x <> '') s from documents), se as (select doc_id, list_filter(list_transform(s, lambda x: {'sentence': x, 'w': regexp_extract_all(lower(x), '[\\x{4e00}-\\x{9fff}]+|[a-z0-9]+')}), lambda y: len(y.w) between 5 and 100) s from sp), st as (select doc_id, (i - 1)::int i, s.sentence sentence, s.w w from (select doc_id, unnest(s) s, generate_subscripts(s, 1) i from se))"
_docs("lead_k", nlp.lead, _with("select doc_id, i, sentence from st where i < 3", _SENT))
_docs("key_sentence", nlp.key_sentences, _with("select doc_id, i, score from (select doc_id, i, score, row_number() over (partition by doc_id order by score desc, i) r from (select doc_id, i, round(sum(n * tf * ln(S / df)) / sum(n) * (1 + 0.5 / (1 + i)), 6) score from (select *, sum(n) over (partition by doc_id, term) tf, count(*) over (partition by doc_id, term) df from (select doc_id, i, term, count(*) n from (select doc_id, i, unnest(w) term from st) group by all)) join (select doc_id, count(*)::double S from st group by 1) using (doc_id) group by doc_id, i)) where r <= 3", _SENT))
_docs("query_focused", lambda d: nlp.query_sentences(d, TERMS), _with("select doc_id, i, score from (select *, row_number() over (partition by doc_id order by score desc, i) r from (select doc_id, i, round(len(list_intersect(w, ['the', 'and', 'of'])) / sqrt(3.0::double * len(w)), 6) score from st) where score > 0) where r <= 3", _SENT))
_docs("tf_keywords", nlp.tf_keywords, _with("select term, doc_id, tf from (select *, row_number() over (partition by doc_id order by tf desc, term) r from p where length(term) > 1 and term not in (" + ", ".join(f"'{s}'" for s in text.STOPWORDS) + ")) where r <= 10"))
_docs("rake", nlp.rake, None)
_docs("kwic_fixed", lambda d: d.select("doc_id", F.explode(text.kwic("text", "license", 20)).alias("k")).select("doc_id", "k.position", "k.before", "k.after"), "select doc_id, \"position\"::int \"position\", substr(text, greatest(\"position\" - 20, 0) + 1, least(\"position\", 20)) \"before\", substr(text, \"position\" + 8, 20) \"after\" from (select doc_id, text, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x)))::bigint + (i - 1) * 7)) \"position\" from (select doc_id, text, string_split(lower(text), 'license') parts from documents where contains(lower(text), 'license')))")
_docs("snippet", lambda d: d.select("doc_id", text.best_window("text", TERMS).alias("snippet")), "select d.doc_id, snippet from documents d left join (select doc_id, arg_min(s[1:180], -10000000 * (contains(lower(s), 'the')::bigint + contains(lower(s), 'and')::bigint + contains(lower(s), 'of')::bigint) + i) snippet from (select doc_id, unnest(s) s, generate_subscripts(s, 1) i from (select doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?。！？]+'), lambda x: trim(x)), lambda x: x <> '') s from documents)) group by 1) using (doc_id)")
_docs("highlight", lambda d: d.select("doc_id", F.md5(text.highlight("text", ["license", "the"]).cast("binary")).alias("marked")), "select doc_id, md5(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)(license|the)', '<mark>\\1</mark>', 'g')) marked from documents")
_docs("textrank", nlp.textrank)
_ENTITIES_SQL = "regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"
for _e, _c in text.ENTITIES.items():
    _ENTITIES_SQL = f"replace({_ENTITIES_SQL}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"
_on("html_text", "pages", lambda p: p.select("page_id", F.length(text.html_text("html")).alias("chars"), F.md5(text.html_text("html").cast("binary")).alias("digest")), f"select page_id, length(x)::int chars, md5(x) digest from (select page_id, trim(regexp_replace({_ENTITIES_SQL}, '\\s+', ' ', 'g')) x from pages)")
_docs("phonetic", lambda d: d.select(F.explode(text.lexical("text")).alias("t")).distinct().select("t", text.phonetic(F.col("t")).alias("code")), None)

# duplicates and articles

_docs("dedup_exact", dedup.exact, "select doc_id, md5(text) content_hash, min(doc_id) over (partition by md5(text)) first_id, doc_id <> min(doc_id) over (partition by md5(text)) is_duplicate from documents")
_docs("dedup_stats", lambda d: dedup.stats(dedup.exact(d)), "select count(*) documents, count(*) - count(distinct md5(text)) duplicates, count(distinct md5(text)) texts from documents")
_docs("near_dup_pairs", lambda d: dedup.near_rows(dedup.fingerprints(d)))
_docs("validate_rows", lambda d: articles.issues(d.withColumnRenamed("source", "title"), "doc_id", "title", "text"), "select doc_id, issue from (select doc_id, unnest([case when coalesce(trim(source), '') = '' then 'missing_title' when length(trim(source)) < 2 then 'title_too_short' end, case when coalesce(trim(text), '') = '' then 'missing_content' when length(trim(text)) < 20 then 'content_too_short' end]) issue from documents) where issue is not null")
_docs("corpus_build", lambda d: articles.build_corpus(d.select("doc_id", "text", "source", F.col("source").alias("title"), F.col("text").alias("url")), order="doc_id", most_per_source=20).select("doc_id", "title"), "select doc_id, title from (select *, row_number() over (partition by title order by doc_id) k from (select *, row_number() over (partition by title, lower(trim(text, ' ')) order by doc_id) r from (select doc_id, trim(source) title, trim(text, ' ') text from documents where length(trim(source)) >= 2 and length(trim(text, ' ')) >= 20)) where r = 1) where k <= 20")
_on("iso_dates", "orders", lambda o: o.select("o_orderkey", articles.iso_date(F.date_format("o_orderdate", "yyyy/M/d")).alias("day")), "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') \"day\" from orders")
_on("json_props", "events", lambda e: e.select("event_id", F.get_json_object("props", "$.k").alias("k")), "select event_id, json_extract_string(props, '$.k') k from events")

# recommendation: orders are ratings of parts

_RATINGS = "ratings as (select o_custkey user_id, l_partkey item_id, arg_max(l_quantity, (l_orderkey * 10 + l_linenumber) * 1000 + l_quantity) rating from orders join lineitem on o_orderkey = l_orderkey group by all)"


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    o, li = _read(spark, d, "orders").select("o_orderkey", "o_custkey"), _read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    rows = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("seq", (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000 + F.col("l_quantity"))
    return recommend.interactions(rows, "o_custkey", "l_partkey", "l_quantity", "seq")


def _rated(name: str, fn: Callable[[DataFrame], DataFrame], body: str | None) -> None:
    _QUERIES[name] = lambda spark, d: fn(_ratings(spark, d))
    if body:
        _SQL[name] = f"with {_RATINGS}{body}"


_rated("interactions", lambda r: r, " select * from ratings")
_rated("user_profiles", lambda r: recommend.profiles(r, "user_id"), " select user_id, count(*) n, round(avg(rating), 6) mean_rating from ratings group by 1")
_rated("popularity", recommend.popularity, " select item_id, count(distinct user_id) users, round(count(distinct user_id) / (select count(distinct user_id) from ratings), 6) popularity from ratings group by 1")
_UW = ", uw as (select *, rating / sqrt(sum(rating * rating) over (partition by user_id)) w from ratings), near as (select b.user_id, round(sum(a.w * b.w), 6) sim from uw a join uw b using (item_id) where a.user_id = 1 and b.user_id <> 1 group by 1 having round(sum(a.w * b.w), 6) > 0 order by sim desc, user_id limit 20)"
_rated("user_similarity", lambda r: recommend.similar_to(r, "user_id", "item_id", SEED_USER), f"{_UW} select * from near")
_rated("cf_user", lambda r: recommend.by_users(r, SEED_USER), f"{_UW} select item_id, round(sum(sim * rating) / sum(sim), 6) score from ratings join near using (user_id) where item_id not in (select item_id from ratings where user_id = 1) group by 1 order by 2 desc, 1 limit 10")
_rated("user_jaccard", lambda r: recommend.similar_to(r, "user_id", "item_id", SEED_USER, "jaccard"), ", c as (select user_id, count(*) n from ratings group by 1) select b.user_id, round(count(*) / (any_value(c.n) + (select n from c where user_id = 1) - count(*)), 6) sim from ratings a join ratings b using (item_id) join c on c.user_id = b.user_id where a.user_id = 1 and b.user_id <> 1 group by 1 order by 2 desc, 1 limit 20")
_rated("cf_item", lambda r: recommend.by_items(r, SEED_USER), ", iw as (select *, rating / sqrt(sum(rating * rating) over (partition by item_id)) w from ratings), mine as (select item_id mine, rating r from ratings where user_id = 1), sims as (select b.item_id, a.item_id mine, sum(a.w * b.w) s from iw a join iw b using (user_id) where a.item_id in (select mine from mine) and a.item_id <> b.item_id group by all) select item_id, round(sum(s * r) / sum(s), 6) score from sims join mine using (mine) where item_id not in (select mine from mine) group by 1 order by 2 desc, 1 limit 10")
_rated("hybrid_weighted", lambda r: recommend.hybrid({"cf": (recommend.by_users(r, SEED_USER, 50), 0.6), "popular": (recommend.popularity(r).select("item_id", F.col("popularity").alias("score")), 0.4)}), f"{_UW}, cf as (select item_id, round(sum(sim * rating) / sum(sim), 6) score from ratings join near using (user_id) where item_id not in (select item_id from ratings where user_id = 1) group by 1 order by 2 desc, 1 limit 50), pop as (select item_id, round(count(distinct user_id) / (select count(distinct user_id) from ratings), 6) score from ratings group by 1) " + _top("select item_id, sum(v) score from (select item_id, 0.6::double * (score / max(score) over ()) v from cf union all select item_id, 0.4::double * (score / max(score) over ()) from pop) group by 1", key="item_id"))
_on("user_profile_recommend", "embeddings", lambda v: recommend.personal(v, [1, 2, 3]), "with m as (select list(a order by i) q from (select i, avg(x) a from (select unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings where vec_id in (1, 2, 3)) group by i)) " + _top("select vec_id, list_cosine_similarity(embedding::double[], q) score from embeddings, m where vec_id not in (1, 2, 3)", key="vec_id"))

# clusters, topics, learning to rank

_docs("class_tfidf", lambda d: cluster.class_terms(d, "lang"), _with("select * from (select cluster, term, score, row_number() over (partition by cluster order by score desc, term) r from (select cluster, term, round(tf * ln(1 + (select sum(tf) / count(distinct cluster) from ct) / cf), 6) score from ct join (select term, sum(tf) cf from ct group by 1) using (term))) where r <= 10".replace("select * from (select cluster", "select cluster, term, score from (select cluster"), "ct as (select lang cluster, term, count(*) tf from tok join documents using (doc_id) group by all)"))
_docs("cooccurrence", lambda d: cluster.cooccurrence(d, ["the", "and", "of", "that"]), _with("select a.term a, b.term b, count(*) n from p a join p b using (doc_id) where a.term < b.term and a.term in ('the', 'and', 'of', 'that') and b.term in ('the', 'and', 'of', 'that') group by all having count(*) >= 2"))
_QUERIES["ltr_features"] = lambda spark, d: ranking.ltr_features(_read(spark, d, "documents"), _read(spark, d, "labels"), TERMS)
_SQL["ltr_features"] = _with("select l.doc_id, coalesce(bm25, 0) bm25, dl, coalesce(hits, 0) hits, quality label from labels l join s using (doc_id) left join (select doc_id, round(score, 6) bm25, hits from (select doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score, count(*) hits from p join q using (term) join t using (term) join s using (doc_id), n group by doc_id)) using (doc_id)", _q(TERMS))

# streams over the same files


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jvm).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    rows = reader.option("pathGlobFilter", f"{name}.parquet").parquet(d) if single else reader.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


_SQL["stream_event_windows"] = "select date_trunc('day', ts)::timestamp \"start\", event_type, count(*) n, round(sum(value), 4) total from events group by all"
_SQL["stream_dedup"] = "select distinct event_id from events"


def _complete() -> None:
    """Load the modules that register the other queries; they import this one."""
    from tessera import search_queries, table_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _complete()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _complete()
    return dict(_SQL)


