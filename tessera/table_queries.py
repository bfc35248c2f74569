"""Queries over tables and files: sources and sinks, aggregation, windows, sets, evaluation extras, streams, clusters, SQL functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import sql, text
from tessera.operators import cluster, dedup, feedback, index, metrics, nlp, ranking, recommend
from tessera.registry import _J, _QRELS, _QUERIES, _RUN, _SQL, SEED_DOC, TERMS, _docs, _evaluation, _on, _ratings, _read, _stream, _with
from tessera.sources import articles, scratch, trec
from tessera.streaming import flows

# sources and sinks: each writes files and reads them again

_JSON = "article_id string, title string, content string, source string, category string, published_date string"


def _as_articles(d: DataFrame) -> DataFrame:
    return d.select(F.col("doc_id").cast("string").alias("article_id"), F.col("source").alias("title"), F.col("text").alias("content"), "source", F.col("lang").alias("category"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(300)).cast("int")), "yyyy-MM-dd").alias("published_date"))


_DAY = "strftime(date '2024-01-01' + (doc_id % 300)::int, '%Y-%m-%d')"


def _files(name: str, write, read, sql_: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch.path(spark, name)
        write(spark, _as_articles(_read(spark, sf_dir, "documents")), path)
        return read(spark, path)

    _QUERIES[name], _SQL[name] = run, sql_


def _two_files(spark: SparkSession, a: DataFrame, path: str) -> None:
    even = F.col("article_id").cast("long") % 2 == 0
    articles.write_jsonl(a.where(even), f"{path}/a")
    articles.write_jsonl(a.where(~even), f"{path}/b")


_files("jsonl_scan", lambda s, a, p: articles.write_jsonl(a, p), lambda s, p: articles.read_jsonl(s, p, schema=_JSON).select("article_id", "source", F.md5(F.col("content").cast("binary")).alias("digest")), "select doc_id::varchar article_id, source, md5(text) digest from documents where text <> ''")
_files("jsonl_folder", _two_files, lambda s, p: articles.read_folder(s, f"{p}/*", most_per_file=20, schema=_JSON).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.pmod(F.col("article_id").cast("long"), F.lit(2))).alias("files")), "select least(count(*) filter (doc_id % 2 = 0 and text <> ''), 20) + least(count(*) filter (doc_id % 2 = 1 and text <> ''), 20) n, count(distinct doc_id % 2) files from documents")
_files("jsonl_files", _two_files, lambda s, p: articles.read_jsonl(s, [f"{p}/a", f"{p}/b"], schema=_JSON).groupBy("source").agg(F.count(F.lit(1)).alias("n")), "select source, count(*) n from documents where text <> '' group by 1")
_files("file_stats", lambda s, a, p: articles.write_jsonl(a, p), lambda s, p: articles.file_stats(articles.read_jsonl(s, p, schema=_JSON)), f"select count(*) \"rows\", count(distinct source) sources, count(distinct lang) categories, min({_DAY}) \"first\", max({_DAY}) \"last\" from documents where text <> ''")
_files("csv_export", lambda s, a, p: a.select("article_id", "source", "category").write.option("header", True).csv(p), lambda s, p: s.read.option("header", True).schema("article_id string, source string, category string").csv(p), "select doc_id::varchar article_id, source, lang category from documents")
_files("json_export", lambda s, a, p: a.select("article_id", F.struct("source", "category").alias("about")).write.json(p), lambda s, p: s.read.schema("article_id string, about struct<source string, category string>").json(p).select("article_id", "about.source", "about.category"), "select doc_id::varchar article_id, source, lang category from documents")


def _merge(spark: SparkSession, a: DataFrame, path: str) -> None:
    half = F.col("article_id").cast("long") < 50
    articles.write_jsonl(articles.merge([a.where(half).drop("category"), a.where(~half).drop("title")]), path)


_files("merge_jsonl", _merge, lambda s, p: articles.read_jsonl(s, p, schema=_JSON).select("article_id", "title", "category"), "select doc_id::varchar article_id, case when doc_id < 50 then source end title, case when doc_id >= 50 then lang end category from documents where text <> ''")
_docs("content_hash", lambda d: d.select("doc_id", articles.content_hash(F.col("source"), F.col("text")).alias("hash")), "select doc_id, md5(concat_ws(chr(10), source, text)) hash from documents")
_docs("dedup_key", lambda d: d.select("doc_id", articles.dedup_hash(F.col("source"), F.col("text")).alias("hash")), "select doc_id, md5(lower(trim(coalesce(source, ''))) || '||' || lower(trim(coalesce(text, '')))) hash from documents")
_docs("table_scan", lambda d: articles.scan(d.withColumnRenamed("lang", "category"), source="src7", category="en").select("doc_id", "n_chars"), "select doc_id, n_chars from documents where source = 'src7' and lang = 'en'")
_docs("table_newest", lambda d: articles.scan(d, source="src2", order="doc_id", limit=10).select("doc_id"), "select doc_id from documents where source = 'src2' order by doc_id desc limit 10")
_docs("point_lookup", lambda d: articles.lookup(d, [3, 5, 8], "doc_id").select("doc_id", "source"), "select doc_id, source from documents where doc_id in (3, 5, 8)")
_QUERIES["keyed_lookup"] = lambda spark, s: articles.lookup(_read(spark, s, "documents"), _read(spark, s, "labels").where("toxic = 1"), "doc_id").select("doc_id", "lang")
_SQL["keyed_lookup"] = "select doc_id, lang from documents where doc_id in (select doc_id from labels where toxic = 1)"
_docs("lookup_by_hash", lambda d: d.where(F.md5(F.col("text").cast("binary")) == d.where(F.col("doc_id") == SEED_DOC).select(F.md5(F.col("text").cast("binary"))).scalar()).select("doc_id"), f"select doc_id from documents where md5(text) = (select md5(text) from documents where doc_id = {SEED_DOC})")
_docs("document_lookup", lambda d: d.where((F.col("doc_id") == 7) | (F.concat(F.lit("a"), F.col("doc_id").cast("string")) == "a11")).select("doc_id", "lang", "source", "n_chars"), "select doc_id, lang, source, n_chars from documents where doc_id = 7 or 'a' || doc_id::varchar = 'a11'")
_docs("upsert_new", lambda d: articles.upsert(d.select("doc_id", F.lit("t").alias("title"), F.col("text").alias("content")), d.where("doc_id < 40").select(articles.content_hash(F.lit("t"), F.col("text")).alias("content_hash"))).select("content_hash"), "select distinct md5('t' || chr(10) || text) content_hash from documents where md5(text) not in (select md5(text) from documents where doc_id < 40)")
_docs("corpus_stats", lambda d: articles.corpus_stats(d.withColumnRenamed("lang", "category")), "select count(*) articles, count(distinct source) sources, count(distinct lang) categories from documents")
_docs("source_counts", lambda d: d.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source"), "select source, count(*) n from documents group by 1")
_on("last_write_wins", "events", lambda e: articles.last_wins(e.select("user_id", "event_id", "event_type"), "user_id", "event_id"), "select user_id, max(event_id) event_id, arg_max(event_type, event_id) event_type from events group by 1")
_docs("serving_ids", lambda d: articles.dense_ids(d.where("lang = 'fr'").select("doc_id"), "doc_id").select("doc_id", "serving_id"), "select doc_id, row_number() over (order by doc_id) - 1 serving_id from documents where lang = 'fr'")
_docs("tag_normalisation", lambda d: d.select("doc_id", F.array_join(articles.tags(F.concat_ws(",", F.lit(" a "), "source", F.lit(" "), "lang")), "|").alias("tags")), "select doc_id, array_to_string(list_filter(list_transform(string_split(concat_ws(',', ' a ', source, ' ', lang), ','), lambda x: trim(x)), lambda x: x <> ''), '|') tags from documents")
_docs("clean_text", lambda d: articles.cleaned(d, ["text"]).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest")), "select doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) digest from documents")
_docs("ingestion_stats", lambda d: articles.ingestion_stats(d, "text"), "select *, round(100.0::double * duplicates / processed, 4) duplicate_pct from (select count(*) processed, count(distinct text) indexed, count(*) - count(distinct text) duplicates from documents)")
_docs("schema_fields", lambda d: d.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in d.schema], "field string, kind string"), "select * from (values ('doc_id', 'bigint'), ('text', 'string'), ('lang', 'string'), ('source', 'string'), ('n_chars', 'bigint')) v(field, kind)")


def _event_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.path(spark, "events")
    events = _read(spark, sf_dir, "events")
    articles.log_events(events.where("event_id % 2 = 0"), path)
    articles.log_events(events.where("event_id % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("newest"))


_QUERIES["event_sink"] = _event_sink
_SQL["event_sink"] = "select ts::date \"day\", count(*) n, max(event_id) newest from events group by 1"


def _trec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.path(spark, "run")
    _evaluation(spark, sf_dir)[0].select(F.concat_ws(" ", "query_id", F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), F.lit("1.5"), F.lit("tag"))).write.text(path)
    return trec.read_run(spark, path).select("query_id", F.col("doc_id").cast("long").alias("doc_id"), "rank")


_QUERIES["trec_run"] = _trec
_SQL["trec_run"] = f"with {_RUN} select query_id, doc_id, rank from run"
_docs("preprocess_batch", lambda d: d.select("doc_id", F.size(text.lexical("text")).alias("tokens"), F.size(text.without_stopwords(text.lexical("text"))).alias("kept"), F.size(text.sentences("text")).alias("sentences")), "select doc_id, len(w)::int tokens, len(list_filter(w, lambda x: not list_contains([" + ", ".join(f"'{s}'" for s in text.STOPWORDS) + "], x)))::int kept, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?。！？]+'), lambda x: trim(x) <> ''))::int sentences from (select *, regexp_extract_all(lower(coalesce(text, '')), '[\\x{4e00}-\\x{9fff}]+|[a-z0-9]+') w from documents)")

# aggregation, windows, sets

_AGG = lambda: [F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("int").alias("gid")]
_AGG_SQL = "count(*) n, round(sum(o_totalprice), 2) total, grouping_id(o_orderstatus, o_orderpriority)::int gid from orders group by"
_on("rollup_orders", "orders", lambda o: o.rollup("o_orderstatus", "o_orderpriority").agg(*_AGG()), f"select o_orderstatus, o_orderpriority, {_AGG_SQL} rollup (o_orderstatus, o_orderpriority)")
_on("cube_orders", "orders", lambda o: o.cube("o_orderstatus", "o_orderpriority").agg(*_AGG()), f"select o_orderstatus, o_orderpriority, {_AGG_SQL} cube (o_orderstatus, o_orderpriority)")
_on("grouping_sets", "orders", lambda o: o.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(*_AGG()), f"select o_orderstatus, o_orderpriority, {_AGG_SQL} grouping sets ((o_orderstatus), (o_orderpriority), ())")
_on("distinct_pairs", "orders", lambda o: o.select("o_orderstatus", "o_orderpriority").distinct(), "select distinct o_orderstatus, o_orderpriority from orders")
_BY = lambda: W.partitionBy("o_orderpriority").orderBy(F.desc("o_orderstatus"))
_ORDER = lambda: W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
_on("window_ranks", "orders", lambda o: o.select("o_orderkey", F.rank().over(_BY()).alias("rank"), F.dense_rank().over(_BY()).alias("dense"), F.round(F.percent_rank().over(_BY()), 6).alias("pct"), F.round(F.cume_dist().over(_BY()), 6).alias("cume")))
_SQL["window_ranks"] = "select o_orderkey, (rank() over w)::int \"rank\", (dense_rank() over w)::int \"dense\", round(percent_rank() over w, 6) pct, round(cume_dist() over w, 6) cume from orders window w as (partition by o_orderpriority order by o_orderstatus desc)"
_on("window_frames", "orders", lambda o: o.select("o_orderkey", F.lag("o_orderkey").over(_ORDER()).alias("before"), F.lead("o_orderkey", 2).over(_ORDER()).alias("after"), F.ntile(3).over(_ORDER()).alias("third"), F.round(F.avg("o_totalprice").over(_ORDER().rowsBetween(-2, 0)), 4).alias("mean3"), F.first("o_orderkey").over(_ORDER()).alias("head")), "select o_orderkey, lag(o_orderkey) over w \"before\", lead(o_orderkey, 2) over w \"after\", (ntile(3) over w)::int third, round(avg(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 4) mean3, first(o_orderkey) over w head from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
_in = lambda d, lang: d.where(F.col("lang") == lang).select("source")
_docs("set_intersect", lambda d: _in(d, "fr").intersect(_in(d, "de")), "select source from documents where lang = 'fr' intersect select source from documents where lang = 'de'")
_docs("set_except", lambda d: d.select("source").where("n_chars > 3000").subtract(_in(d, "de").where("n_chars > 3000")), "select source from documents where n_chars > 3000 except select source from documents where lang = 'de' and n_chars > 3000")
_docs("set_union", lambda d: _in(d, "fr").union(_in(d, "de")).distinct(), "select source from documents where lang = 'fr' union select source from documents where lang = 'de'")
_on("top_clicked", "events", lambda e: feedback.top_clicked(e.where("event_type = 'click'"), F.get_json_object("props", "$.k")), "select json_extract_string(props, '$.k') doc, count(*) clicks, count(distinct user_id) users from events where event_type = 'click' group by 1 order by 2 desc, 1 limit 20")
_KINDS = {"email": r"[\w.+-]+@[\w-]+\.[\w.]+", "link": r"https?://[^\s<>\"]+", "date": r"\b\d{4}-\d{2}-\d{2}\b", "money": r"[$€£]\d[\d,.]*\d"}
_ENT = "e as (" + " union all ".join(f"select doc_id, '{k}' kind, unnest(regexp_extract_all(text, '{p}')) \"value\" from documents" for k, p in _KINDS.items()) + ")"
_docs("entities", nlp.entities, f"with {_ENT} select * from e")
_docs("entity_stats", lambda d: nlp.entity_stats(nlp.entities(d)), f"with {_ENT} select kind, count(*) n, count(distinct \"value\") \"values\", round(100.0::double * count(*) / (select count(*) from e), 4) pct from e group by 1")
_docs("common_entities", lambda d: nlp.common_entities(nlp.entities(d), 5), f"with {_ENT} select kind, \"value\", n, rank from (select *, row_number() over (partition by kind order by n desc, \"value\")::int rank from (select kind, \"value\", count(*) n from e group by all)) where rank <= 5")

# evaluation extras

_QUERIES["f_beta_series"] = lambda spark, s: metrics.f_beta_series(*_evaluation(spark, s))
_SQL["f_beta_series"] = f"with {_RUN}, {_QRELS}, rr as (select query_id, count(*) filter (rel > 0) r from qrels group by 1), x as (select k, run.query_id, sum((coalesce(rel, 0) > 0)::int) h, count(*) n from (select unnest([5, 10, 20])::int k) ks join run on rank <= k left join qrels using (query_id, doc_id) group by all), y as (select k, h / n pr, coalesce(h / nullif(r, 0), 0) re from x join rr using (query_id)) select k, round(avg(pr), 6) \"precision\", round(avg(re), 6) recall, round(avg(coalesce(1.25::double * pr * re / nullif(0.25::double * pr + re, 0), 0)), 6) f_half, round(avg(coalesce(5.0::double * pr * re / nullif(4.0::double * pr + re, 0), 0)), 6) f_two from y group by 1"
_QUERIES["query_set_keys"] = lambda spark, s: metrics.query_sets(_read(spark, s, "benchmark").select(F.concat(F.lit("set"), F.pmod("item_id", F.lit(3)).cast("string")).alias("name"), F.col("item_id").alias("query_id"), "text"), "v1")
_SQL["query_set_keys"] = "select 'set' || (item_id % 3) \"name\", count(*) queries, sha256('v1' || chr(10) || string_agg(item_id::varchar || '=' || md5(text), chr(10) order by item_id)) \"key\" from benchmark group by 1"
_KEEP = f"length(term) > 1 and term not in ({', '.join(repr(s) for s in text.STOPWORDS)})"
_docs("keyword_eval", lambda d: metrics.keyword_eval(nlp.keyword_lists(d, 10), nlp.frequent_lists(d, 3)), _with("select doc_id, round(b / len(f)::double, 6) \"precision\", round(b / len(g)::double, 6) recall, round(coalesce(2 * (b / len(f)::double) * (b / len(g)::double) / nullif(b / len(f)::double + b / len(g)::double, 0), 0), 6) f1 from (select doc_id, kf.k f, kg.k g, len(list_intersect(kf.k, kg.k)) b from kf join kg using (doc_id))", f"kf as (select doc_id, list(term) k from (select *, row_number() over (partition by doc_id order by tf desc, term) r from p where {_KEEP}) where r <= 10 group by 1)", f"kg as (select doc_id, list(term) k from p where tf >= 3 and {_KEEP} group by 1)"))
_docs("evaluation_key", lambda d: d.sparkSession.createDataFrame([(metrics.cache_key({"model": "bm25", "k": 10}, "d1", "q1"),)], "key string"), f"select '{hashlib.sha256(b'd1|q1|{\"k\": 10, \"model\": \"bm25\"}').hexdigest()}' \"key\"")

# documents in detail

_docs("document_detail", lambda d: nlp.detail(d, SEED_DOC, TERMS), _with(f"select doc_id, lang, source, n_chars, (select count(*)::int from p where doc_id = {SEED_DOC}) distinct_terms, (select string_agg(term, ',' order by tf desc, term) from (select * from p where doc_id = {SEED_DOC} and length(term) > 1 and term not in ({', '.join(repr(s) for s in text.STOPWORDS)}) order by tf desc, term limit 5)) keywords, (select string_agg(term, ',' order by term) from p where doc_id = {SEED_DOC} and term in ('the', 'and', 'of')) matched from documents where doc_id = {SEED_DOC}"))
_docs("multi_document_summary", lambda d: d.sparkSession.createDataFrame(nlp.multi_document_summary(d).astype({"doc_id": "int64", "i": "int32"}), "doc_id long, i int, sentence string, score double"))
_docs("greedy_generation", lambda d: nlp.generate_greedy(d, "the", 8), _with("select pos, word from g", "bn as (select a, b from (select a, b, row_number() over (partition by a order by n desc, b) r from (select x.term a, y.term b, count(*) n from tok x join tok y on x.doc_id = y.doc_id and y.pos = x.pos + 1 group by all)) where r = 1)", "g(pos, word) as (select 0, 'the' union all select pos + 1, b from g join bn on word = a where pos < 7)").replace("with w as", "with recursive w as", 1))
_EDGES = [(1, 2, 1, "eats", "cat", "nsubj"), (1, 0, 2, "", "eats", "root"), (1, 2, 4, "eats", "fish", "dobj"), (1, 4, 3, "fish", "the", "det"), (2, 0, 1, "", "sleeps", "root"), (2, 1, 2, "sleeps", "dog", "nsubj")]
_EDGE_SCHEMA = "sent_id long, head int, dep int, head_word string, dep_word string, relation string"
_QUERIES["svo_triples"] = lambda spark, s: nlp.triples(spark.createDataFrame(_EDGES, _EDGE_SCHEMA))
_SQL["svo_triples"] = "select * from (values (1::bigint, 'cat', 'eats', 'fish', 1.0::double), (2, 'dog', 'sleeps', null, 0.7)) v(sent_id, subject, verb, object, confidence)"
_QUERIES["dependency_tree"] = lambda spark, s: nlp.dependency_tree(spark.createDataFrame(_EDGES, _EDGE_SCHEMA))
_SQL["dependency_tree"] = "select * from (values (1::bigint, 0, 'eats', 'root'), (1, 2, 'cat,fish', 'nsubj,dobj'), (1, 4, 'the', 'det'), (2, 0, 'sleeps', 'root'), (2, 1, 'dog', 'nsubj')) v(sent_id, head, children, relations)"
_QUERIES["analysis_graph"] = lambda spark, s: ranking.analysis_graph(ranking.dispatch(_read(spark, s, "documents"), "bm25", TERMS, 5), "the and of")
_SQL["analysis_graph"] = _with("select 'query:the and of' source, 'model:bm25' target, 'asked' kind, null::double weight union all select 'model:bm25', 'doc:' || doc_id, 'found', score from (select doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score from p join q using (term) join t using (term) join s using (doc_id), n group by doc_id order by 2 desc, 1 limit 5)", "q as (select * from (values ('the', 1), ('and', 1), ('of', 1)) v(term, qtf))")

# clusters and recommendation

_on("hierarchical_clusters", "embeddings", lambda v: cluster.hierarchical_groups(v, "label", 5))
_on("silhouette", "embeddings", lambda v: cluster.silhouette_by_label(v))
_SQL["silhouette"] = "with u as (select vec_id, label, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) e from embeddings), m as (select label, count(*) n, list(s order by i) s from (select label, i, sum(x) s, count(*) n from (select label, unnest(e) x, generate_subscripts(e, 1) i from u) group by all) group by label), mm as (select m.label, c.n, m.s from m join (select label, count(*) n from u group by 1) c using (label)), d as (select vec_id, u.label own, mm.label other, case when u.label = mm.label then (case when mm.n > 1 then (mm.n - list_dot_product(e, s)) / (mm.n - 1) else 0 end) else 1 - list_dot_product(e, s) / mm.n end d, mm.n from u, mm), ab as (select vec_id, any_value(own) lab, min(d) filter (own <> other) b, min(d) filter (own = other) a, min(n) filter (own = other) n from d group by 1) select lab::int label, count(*) n, round(avg(case when n = 1 then 0 else (b - a) / greatest(a, b) end), 6) silhouette from ab group by 1"
_docs("term_clusters", lambda d: cluster.term_clusters(index.term_stats(index.postings(d)), 40))
_docs("lda", lambda d: cluster.lda_topics(d))
_docs("lda_words", lambda d: cluster.topic_words(d))
_QUERIES["als"] = lambda spark, s: recommend.factor_lists(_ratings(spark, s), 5)
_on("mmr_rerank", "embeddings", lambda v: recommend.mmr(v, 7, 10))
_on("kmeans", "embeddings", lambda v: cluster.kmeans_report(v))
_docs("near_dup_greedy", lambda d: dedup.greedy(d))

# streams: files in, files out


def _stream_windows(spark: SparkSession, s: str) -> DataFrame:
    return flows.to_folder(flows.windows(_stream(spark, s, "events")), scratch.path(spark, "windows"), "complete")


_QUERIES["stream_event_windows"] = _stream_windows
_QUERIES["stream_dedup"] = lambda spark, s: flows.to_folder(flows.unique(_stream(spark, s, "events"), ["event_id"]).select("event_id"), scratch.path(spark, "unique"))
_QUERIES["stream_sliding"] = lambda spark, s: flows.to_folder(flows.windows(_stream(spark, s, "events"), "1 day", "12 hours"), scratch.path(spark, "sliding"), "complete")
_SQL["stream_sliding"] = "select start, event_type, count(*) n, round(sum(\"value\"), 4) total from (select *, unnest([h, h - interval 12 hour])::timestamp start from (select *, time_bucket(interval 12 hour, ts, timestamp '2000-01-01') h from events)) group by all"
_QUERIES["stream_sessions"] = lambda spark, s: flows.to_folder(flows.session_windows(_stream(spark, s, "events")), scratch.path(spark, "sessions"), "complete")
_SQL["stream_sessions"] = "select user_id, min(ts)::timestamp start, count(*) n from (select *, sum(fresh) over (partition by user_id order by ts, event_id) g from (select *, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 2 hour then 0 else 1 end fresh from events)) group by user_id, g"


def _ingest(spark: SparkSession, s: str) -> DataFrame:
    path = scratch.path(spark, "ingest")
    docs = _read(spark, s, "documents").select("doc_id", "text")
    for half in (0, 1):  # the second run sees only the new files
        docs.where(F.col("doc_id") % 2 == half).write.mode("append").parquet(f"{path}/in")
        flows.ingest(spark, f"{path}/in", f"{path}/index").awaitTermination()
    return index.term_stats(spark.read.parquet(f"{path}/index/postings").drop("batch"))


_QUERIES["stream_ingest"] = _ingest
_SQL["stream_ingest"] = _with("select term, df, cf from t")

# functions in SQL


def _sql_over_documents(statement: str):
    def run(spark: SparkSession, s: str) -> DataFrame:
        sql.register(spark)
        _read(spark, s, "documents").createOrReplaceTempView("tessera_docs")
        return spark.sql(statement)

    return run


_QUERIES["udtf_ngrams"] = _sql_over_documents("select d.doc_id, g.gram, count(*) n from tessera_docs d, lateral tessera_ngrams(d.text, 2) g group by all")
_SQL["udtf_ngrams"] = _with("select a.doc_id, a.term || ' ' || b.term gram, count(*) n from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 group by all")
_QUERIES["udaf_geomean"] = _sql_over_documents("select lang, tessera_geomean(n_chars) gm from tessera_docs group by lang")
_SQL["udaf_geomean"] = "select lang, round(exp(avg(ln(n_chars))), 4) gm from documents group by 1"
_QUERIES["sql_udf_tokens"] = _sql_over_documents("select lang, sum(tessera_tokens(text)) tokens from tessera_docs group by lang")
_SQL["sql_udf_tokens"] = _with("select lang, sum(len(w))::bigint tokens from documents join w using (doc_id) group by 1")

# hybrid recommendation and topics

_PARTS = "ratings as (select o_custkey user_id, l_partkey item_id, arg_max(l_quantity, (l_orderkey * 10 + l_linenumber) * 1000 + l_quantity) rating from orders join lineitem on o_orderkey = l_orderkey group by all), pop as (select item_id, count(distinct user_id) / (select count(distinct user_id) from ratings) p from ratings group by 1), con as (select item_id, round(avg(rating) / 50, 6) s from ratings group by 1)"


def _content_of(r: DataFrame) -> DataFrame:
    return r.groupBy("item_id").agg(F.round(F.avg("rating") / 50, 6).alias("score"))


def _popular(r: DataFrame) -> DataFrame:
    return recommend.popularity(r).select("item_id", F.col("popularity").alias("score"))


_QUERIES["hybrid_cascade"] = lambda spark, s: (lambda r: recommend.cascade(_content_of(r), recommend.by_items(r, 1, 50), _popular(r)))(_ratings(spark, s))
_SQL["hybrid_cascade"] = f"with cf as ({_SQL['cf_item'].replace('limit 10', 'limit 50')}), {_PARTS} select item_id, round(case when coalesce(score, 0) > 0 then 0.7::double * score + 0.2::double * s + 0.1::double * round(p, 6) else 0.8::double * s + 0.2::double * round(p, 6) end, 6) score from con join pop using (item_id) left join cf using (item_id) order by 2 desc, 1 limit 10"
_QUERIES["hybrid_switching"] = lambda spark, s: (lambda r: recommend.switching(r, -5, _content_of(r), _popular(r)))(_ratings(spark, s))
_SQL["hybrid_switching"] = f"with {_PARTS} select item_id, s score, 'content' \"method\" from con order by 2 desc, 1 limit 10"
_on("topic_assignment", "embeddings", lambda v: cluster.assign_topics(v, cluster.group_means(v), 0.1))
_SQL["topic_assignment"] = "with m as (select label, list(x order by i) c from (select label, i, avg(x) x from (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings) group by all) group by label), e as (select e.vec_id, m.label, round(list_cosine_similarity(e.embedding::double[], m.c), 6) s from embeddings e, m) select vec_id, case when s >= 0.1 then label else -1 end::int topic, s similarity from (select *, row_number() over (partition by vec_id order by s desc, label) r from e) where r = 1"
_docs("vector_providers", lambda d: recommend.vectors_of(d, "tfidf").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total")), _with("select doc_id, count(*) n, round(sum(w), 6) total from v group by 1", "v as (select doc_id, term, x / sqrt(sum(x * x) over (partition by doc_id)) w from (select doc_id, term, (1 + log10(tf)) * log10(n / df) x from p join t using (term), n) where x > 0)"))
