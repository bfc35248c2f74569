"""Queries of the search side that the first registry lacks: pruning, dispatch, explanations, expansions, tries, stored indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import dedup, index, keywords, nlp, pruning, ranking
from tessera.plans import query as plans
from tessera.registry import _BM25, _FIELDS, _FUSE_TERMS, _LTC, _QN, _QUERIES, _RUNS, _SQL, SEED_DOC, TERMS, _docs, _on, _q, _read, _runs, _top, _with
from tessera.sources import scratch

_TWO = ["that", "with"]
_STATS = lambda d: index.term_stats(index.postings(d))
_PART = "qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))"

# pruning

_docs("wand_topk", lambda d: pruning.search(d, _TWO).found, _with(_top(_BM25.format(plus="")), _q(_TWO)))
_docs("maxscore_topk", lambda d: pruning.search(d, [*TERMS, "thing"], method="maxscore").found, _with(_top(_BM25.format(plus="")), _q([*TERMS, "thing"])))
_PRUNED = [
    f"b as (select doc_id, term, {_PART} part from p join q using (term) join t using (term) join s using (doc_id), n)",
    "up as (select term, max(part) u from b group by 1)",
    "sc as (select doc_id, sum(part) s from b group by 1)",
    "th as (select case when count(*) = 10 then min(s) else 0 end x from (select s from sc where doc_id in (select doc_id from b where term = (select term from up order by u desc, term desc limit 1)) order by s desc limit 10))",
]
for _name, _body in {
    "wand": "select doc_id from b join up using (term) group by doc_id having sum(u) >= (select x from th) - 1e-9",
    "maxscore": "select distinct doc_id from b where term in (select term from (select term, sum(u) over (order by u, term) below from up) where below >= (select x from th) - 1e-9)",
}.items():
    _docs(f"{_name}_stats", lambda d, m=_name: pruning.search(d, [*TERMS, "thing"], method=m).stats(), _with(f"select count(*) candidates, (select count(*) from ({_body})) scored from sc", _q([*TERMS, "thing"]), *_PRUNED))

# boolean ranking, dispatch, analysis

_docs("boolean_ranked", lambda d: ranking.boolean_ranked(d, "the AND (that OR with)"), _with(_top("select doc_id, sum(tf)::double score from p where term in ('the', 'that', 'with') and doc_id in (select doc_id from p where term = 'the') and doc_id in (select doc_id from p where term in ('that', 'with')) group by doc_id")))
_docs("unified_simple", lambda d: plans.search(d, "that with"), _with(_top(_BM25.format(plus="")), _q(_TWO)))
_BY_ID = "select doc_id, 1.0::double score, row_number() over (order by doc_id)::int rank from (select doc_id from ({}) order by doc_id limit 10)"
_docs("unified_boolean", lambda d: plans.search(d, "the AND that"), _with(_BY_ID.format("select doc_id from p where term = 'the' intersect select doc_id from p where term = 'that'")))
_docs("unified_field", lambda d: plans.search(d, "lang:fr AND n_chars:[100 TO 900]", fields={"lang", "n_chars"}, planner=_FIELDS), _BY_ID.format("select doc_id from documents where lang = 'fr' and n_chars between 100 and 900"))
_CONDITIONS = [{"field": "lang", "operator": "match", "value": "de"}, {"field": "n_chars", "operator": "between", "value": [300, 3000]}]
_docs("advanced_search", lambda d: plans.advanced(d, _CONDITIONS, planner=_FIELDS, order="n_chars", descending=True, k=15, offset=5).select("doc_id", "n_chars"), "select doc_id, n_chars from documents where lang = 'de' and n_chars between 300 and 3000 order by n_chars desc, doc_id limit 15 offset 5")
_docs("query_fields", lambda d: plans.field_catalogue(d, _FIELDS), "select * from (values ('doc_id', 'number'), ('text', 'text'), ('lang', 'exact'), ('source', 'exact'), ('n_chars', 'number')) v(field, kind)")
_STOP = "[" + ", ".join(f"'{s}'" for s in text.STOPWORDS) + "]"
_on(
    "query_analysis",
    "benchmark",
    lambda b: plans.analyse(b.select(F.col("item_id").alias("query_id"), "text"), {"the": "this", "that": "which"}),
    f"select item_id query_id, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) normalised, array_to_string(w, ' ') terms, array_to_string(list_filter(w, lambda x: not list_contains({_STOP}, x) and length(x) > 1), ' ') significant, array_to_string(list_filter(w, lambda x: list_contains({_STOP}, x)), ' ') removed, array_to_string(list_transform(list_filter(w, lambda x: x in ('the', 'that')), lambda x: case x when 'the' then 'this' else 'which' end), ' ') synonyms, coalesce(regexp_matches(text, '\\b(AND|OR|NOT)\\b|\"'), false) is_boolean from (select *, regexp_extract_all(lower(coalesce(text, '')), '[\\x{{4e00}}-\\x{{9fff}}]+|[a-z0-9]+') w from benchmark)",
)
_docs("matched_fields", lambda d: plans.with_matched_fields(d, "thing OR lang:fr OR NOT source:src1", plans.Planner(exact={"source", "lang"})), _with("select doc_id, array_to_string(list_filter([case when lang = 'fr' then 'lang' end, case when source = 'src1' then 'source' end, case when has then 'text' end], lambda x: x is not null), ',') fields from (select *, doc_id in (select doc_id from p where term = 'thing') has from documents) where has or lang = 'fr' or source <> 'src1'"))
_docs("result_metadata", lambda d: ranking.with_attributes(ranking.bm25(d, TERMS), d, ["lang", "source", "n_chars"]), _with(f"select r.*, lang, source, n_chars from ({_top(_BM25.format(plus=''))}) r join documents using (doc_id)", _q(TERMS)))
_MODELS_SQL = {
    "bm25": _top(_BM25.format(plus="")),
    "bim": _top("select doc_id, sum(greatest(0, ln((n - df + 0.5) / (df + 0.5)))) score from p join q using (term) join t using (term), n group by doc_id having sum(greatest(0, ln((n - df + 0.5) / (df + 0.5)))) > 0"),
    "vsm": _top("select doc_id, sum(w * qw) / any_value(qn) score from v join qv using (term), qn group by doc_id having sum(w * qw) > 0"),
}


def _every_model(d: DataFrame) -> DataFrame:
    out = None
    for m in _MODELS_SQL:
        one = ranking.dispatch(d, m, _FUSE_TERMS)
        out = one if out is None else out.unionByName(one)
    return out


_docs("model_dispatch", _every_model, _with(" union all ".join(f"select '{m}' model, * from ({s})" for m, s in _MODELS_SQL.items()), _LTC, _q(_FUSE_TERMS), "qv as (select term, 1 + log10(qtf) qw from q)", _QN))
_docs("scorer_plugin", lambda d: ranking.score_with(d, _TWO, lambda tf, dl, df, n: F.log(1 + tf) * F.log10(n / df)), _with(_top("select doc_id, sum(qtf * ln(1 + tf) * log10(n / df)) score from p join q using (term) join t using (term), n group by doc_id"), _q(_TWO)))

# explanations and variants

_docs("lm_explain", lambda d: ranking.lm_explain(d, TERMS, SEED_DOC), _with(f"select term, tf, round(pd, 9) p_doc, round(pc, 9) p_collection, round(0.7::double * pd + (1 - 0.7::double) * pc, 9) p, round(ln(0.7::double * pd + (1 - 0.7::double) * pc), 6) logp from (select q.term, coalesce(o.tf, 0)::int tf, coalesce(coalesce(o.tf, 0) / nullif((select dl from s where doc_id = {SEED_DOC}), 0), 0)::double pd, cf / total pc from q join t using (term) left join (from p where doc_id = {SEED_DOC}) o on o.term = q.term, n)", _q(TERMS)))
_docs("bim_explain", lambda d: ranking.bim_explain(d, [*_TWO, "the"], SEED_DOC), _with(f"select term, df, round(greatest(0, ln((n - df + 0.5) / (df + 0.5))), 6) w from p join q using (term) join t using (term), n where doc_id = {SEED_DOC}", _q([*_TWO, "the"])))
_docs("bm25_log10", lambda d: ranking.bm25_log10(d, "that"), _with("select doc_id, round(log10(n / df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)), 6) score from p join t using (term) join s using (doc_id), n where term = 'that'"))
_EXPANDED = "ex as (select term, max(1 / (1 + d)::double) ew from (select *, row_number() over (partition by q order by d, term) r from (select q.term q, t.term, levenshtein(q.term, t.term) d from q join t on abs(length(q.term) - length(t.term)) <= 1 and levenshtein(q.term, t.term) <= 1)) where r <= 50 group by term)"
_docs("bm25_fuzzy", lambda d: ranking.bm25_expanded(d, ["thing", "with"]), _with(_top("select doc_id, sum(ew * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score from p join ex using (term) join t using (term) join s using (doc_id), n group by doc_id"), _q(["thing", "with"]), _EXPANDED))
_docs("fuzzy_expansions", lambda d: ranking.expansions(d, ["thing", "with"]), _with("select term, ew w from ex", _q(["thing", "with"]), _EXPANDED))
_docs("bm25_phonetic", lambda d: ranking.bm25_expanded(d, ["thing", "with"], "phonetic"))
_docs("rocchio_drift", lambda d: ranking.rocchio_drift(d, ["that", "with"], [1, 2], [5]), f"select drift, drift > 0.5 drifted from (select round(1 - sum(coalesce(q, 0) * coalesce(w, 0)) / sqrt(sum(coalesce(q, 0) * coalesce(q, 0)) * sum(coalesce(w, 0) * coalesce(w, 0))), 6) drift from ({_SQL['rocchio_expand']}) e full join (values ('that', 1.0::double), ('with', 1.0)) v(term, q) using (term))")
_docs("suggest", lambda d: ranking.suggest(d, "th"), _with("select term, df from t where starts_with(term, 'th') order by df desc, term limit 10"))
_docs("fuse_explain", lambda d: ranking.fuse_explain(_runs(d), {"bm25": 0.5, "bim": 0.2, "vsm": 0.3}), _with("select doc_id, model, round(score, 6) raw, round(v, 6) scaled, round(v * case model when 'bm25' then 0.5::double when 'bim' then 0.2 else 0.3 end, 6) part from (select *, case when max(score) over (partition by model) = min(score) over (partition by model) then 1 else (score - min(score) over (partition by model)) / (max(score) over (partition by model) - min(score) over (partition by model)) end v from runs)", *_RUNS))
_on("dense_batch", "embeddings", lambda v: ranking.dense_batch(v, F.col("vec_id") % 50 == 0), "select query_id, rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from (select a.vec_id query_id, b.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) score from embeddings a join embeddings b on a.vec_id % 50 = 0 and b.vec_id <> a.vec_id)) where rank <= 5")
_docs("text_vectors", lambda d: ranking.hashed_vectors(d).select("doc_id", "slot", F.round("v", 6).alias("v")), _with("select doc_id, slot, round(coalesce(x / nullif(sqrt(sum(x * x) over (partition by doc_id)), 0), 0), 6) v from (select doc_id, slot, sum(x) x from (select doc_id, ('0x' || substr(md5(term), 1, 8))::bigint % 64 slot, case when ('0x' || substr(md5(term), 9, 1))::int % 2 = 0 then 1 else -1 end * (1 + ln(tf)) x from p) group by all)"))

# index structures

_docs("serving_weights", lambda d: index.serving_weights(d, "source", ["lang", "text"]), "with w as (select doc_id, unnest(regexp_extract_all(lower(concat_ws(' ', source, source, source, lang, text)), '[\\x{4e00}-\\x{9fff}]+|[a-z0-9]+')) term from documents), p as (select term, doc_id, count(*)::int tf from w group by all), t as (select term, count(*) df from p group by 1) select term, doc_id, tf, round((1 + log10(tf)) * ln(1 + ((select count(*) from documents) - df + 0.5) / (df + 0.5)), 6) w from p join t using (term)")
_docs("fuzzy_stats", lambda d: index.fuzzy_stats(_STATS(d), "thing", 2), _with("select levenshtein('thing', term)::int distance, count(*) n from t where levenshtein('thing', term) <= 2 group by 1"))
_docs("wildcard_stats", lambda d: index.wildcard_stats(_STATS(d), "th*"), _with("select count(*) matches, min(length(term))::int shortest, max(length(term))::int longest, 'prefix' kind from t where starts_with(term, 'th')"))
_NODES = ["px as (select pre, bool_or(i = length(term)) is_term from (select term, unnest(range(1, length(term) + 1)) i, term[1:i] pre from t) group by 1)", "ch as (select pre[1:length(pre) - 1] pre, count(*) c from px group by 1)"]
_docs("trie_stats", lambda d: index.trie_stats(_STATS(d)), _with("select *, round(nodes / compressed_nodes, 6) chars_per_node from (select count(*) filter (is_term) terms, count(*) nodes, max(length(pre))::int depth, count(*) filter (is_term or coalesce(c, 0) <> 1) compressed_nodes from px left join ch using (pre))", *_NODES))
_docs("trie_view", lambda d: index.trie_view(_STATS(d), "th"), _with("select term[1:3] node, count(*) terms, sum(cf)::bigint cf from t where starts_with(term, 'th') and length(term) > 2 group by 1 order by 2 desc, 1 limit 100"))
_docs("pattern_lookup", lambda d: index.pattern_lookup(d, [["of", "the"], ["the", "that"]]), _with("select a.term || ' ' || b.term pattern, count(*) n, count(distinct a.doc_id) docs from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where (a.term, b.term) in (('of', 'the'), ('the', 'that')) group by 1"))
_docs("window_pairs", lambda d: index.window_pairs(d, 3, 5), _with("select least(a.term, b.term) a, greatest(a.term, b.term) b, count(*) n from tok a join tok b on a.doc_id = b.doc_id and b.pos between a.pos + 1 and a.pos + 2 where a.term <> b.term group by 1, 2 having count(*) >= 5"))
_docs("field_stats", lambda d: index.field_stats(index.field_postings(d, ["text"], ["source", "lang"])), _with("select 'text' field, count(distinct term) terms, count(*) postings, count(distinct doc_id) docs from p union all select 'source', count(distinct lower(source)), count(*), count(*) from documents where source <> '' union all select 'lang', count(distinct lower(lang)), count(*), count(*) from documents where lang <> ''"))
_docs("index_manifest", index.manifest, "select '1' version, count(*) documents, coalesce(sum(('0x' || substr(md5(doc_id::varchar || '|' || coalesce(text, '')), 1, 12))::bigint), 0)::bigint digest from documents")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    post, lengths, _ = index.cached(_read(spark, sf_dir, "documents"), scratch.path(spark, "index"))
    return index.stored_bm25(post, lengths, TERMS)


_QUERIES["stored_index_bm25"] = _stored
_SQL["stored_index_bm25"] = _with(_top(_BM25.format(plus="")), _q(TERMS))

# text

_docs("token_filter", lambda d: index.tokens(d).select("doc_id", F.md5(F.array_join(text.filtered(F.col("w")), " ").cast("binary")).alias("digest")), _with(f"select doc_id, md5(array_to_string(list_filter(w, lambda x: length(x) >= 2 and not list_contains({_STOP}, x) and not regexp_full_match(x, '[0-9]+')), ' ')) digest from w"))
_docs("stopword_counts", lambda d: text.stopword_counts(index.tokens(d), [*text.STOPWORDS, "thing"]), _with(f"select term, count(*) n from tok where list_contains({_STOP}, term) or term = 'thing' group by 1"))
_docs("text_quality", lambda d: index.tokens(d).select("doc_id", F.md5(F.array_join(text.significant(F.col("w"), protected=["it", "is"]), " ").cast("binary")).alias("digest")), _with(f"select doc_id, md5(array_to_string(list_filter(w, lambda x: x in ('it', 'is') or not list_contains({_STOP}, x) and length(x) > 1 and not regexp_full_match(x, '[0-9]+')), ' ')) digest from w"))
_docs("taxonomy", lambda d: text.classify(d, "source", {"src1": "news", "src2": "news", "src3": "blogs"}).select("doc_id", "source", "class"), "select doc_id, source, case when source in ('src1', 'src2') then 'news' when source = 'src3' then 'blogs' when coalesce(trim(source), '') = '' then 'unknown' else 'other' end \"class\" from documents")
_docs("set_similarity", lambda d: text.neighbour_jaccard(d), _with("select a.doc_id, b.doc_id other, round(case when len(list_distinct(list_concat(a.w, b.w))) = 0 then 1 else len(list_intersect(list_distinct(a.w), list_distinct(b.w))) / len(list_distinct(list_concat(a.w, b.w))) end, 6) similarity from w a join w b on b.doc_id = a.doc_id + 1"))
_docs("simhash", dedup.fingerprints, _with("select doc_id, coalesce(h, 0) h from s left join (select doc_id, sum(case when v > 0 then (case when i = 63 then (-9223372036854775808)::hugeint else (1::hugeint << i) end) else 0 end)::bigint h from (select doc_id, i, sum(tf * case when (('0x' || substr(md5(term), 17, 16))::ubigint >> i) & 1 = 1 then 1 else -1 end) v from p, (select unnest(range(0, 64))::ubigint i) group by all) group by doc_id) using (doc_id)"))
_docs("cjk_bigrams", lambda d: d.select("doc_id", F.md5(F.array_join(text.cjk_bigrams(F.concat(F.coalesce("text", F.lit("")), F.lit(" 中文分詞 測 "), F.col("doc_id").cast("string"))), " ").cast("binary")).alias("digest")), "select doc_id, md5(array_to_string(list_concat(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ['中文', '文分', '分詞', '測', doc_id::varchar]), ' ')) digest from documents")
_docs("html_free_text", lambda d: d.select("doc_id", F.md5(text.html_text(F.concat(F.lit("<p>a &amp; b</p><script>x < y</script> <b>"), F.regexp_replace(F.col("text"), "[<>&]", " "), F.lit("</b><!-- c -->"))).cast("binary")).alias("digest")), "select doc_id, md5(trim(regexp_replace('a & b  ' || regexp_replace(text, '[<>&]', ' ', 'g'), '\\s+', ' ', 'g'))) digest from documents")

# n-gram models and keywords

_docs("ngram_stats", nlp.model_stats, _with("select (select sum(tf)::bigint from p) tokens, (select count(*) from t) vocabulary, count(*) bigrams, count(distinct a) contexts from (select distinct a.term a, b.term b from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1)"))
_docs("ngram_log_probability", nlp.log_probability, _with("select a, b, round(ln((n + 1) / (c + (select count(*) from t)::double)), 6) logp from (select *, sum(n) over (partition by a)::double c from (select a.term a, b.term b, count(*) n from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 group by all))"))
for _method in keywords.METHODS:
    _docs(f"keywords_{_method}", lambda d, m=_method: keywords.extract(d, m))
_docs("ranker_configured", lambda d: ranking.Ranker.of("bm25", k1=1.2, b=0.5)(d, TERMS), _with(_top("select doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2::double / (tf + 1.2::double * (0.5 + 0.5 * dl / avgdl)))) score from p join q using (term) join t using (term) join s using (doc_id), n group by doc_id"), _q(TERMS)))
