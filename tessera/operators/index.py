"""Inverted, positional and field indexes as DataFrames, and what is counted on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tessera.functions import codecs, text
from tessera.sources import scratch

Tokenizer = Callable[[str], Column]
#: Bytes of text whose tokens are counted at once.
PART = 1 << 22
#: Of the terms of ``keyword_ranking``, those that are looked for in each document first.
COMMON = 1024
# The bytes of lexical tokens in lower-cased ASCII.
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1


def tokens(docs: DataFrame, tokenizer: Tokenizer = text.lexical) -> DataFrame:
    """``doc_id, w``."""
    return docs.select("doc_id", tokenizer("text").alias("w"))


def positions(docs: DataFrame, tokenizer: Tokenizer = text.lexical) -> DataFrame:
    """``doc_id, pos, term``, positions from 0."""
    return tokens(docs, tokenizer).select("doc_id", F.posexplode("w").alias("pos", "term"))


def lexical_lists(lowered: pa.StringArray) -> pa.ListArray:
    """``text.lexical`` of lower-cased texts, by their bytes: a token is a run of one kind, and ends where its text does."""
    offsets = np.frombuffer(lowered.buffers()[1], dtype=np.int32)[lowered.offset : lowered.offset + len(lowered) + 1] if len(lowered) else np.zeros(1, dtype=np.int32)
    data = np.frombuffer(lowered.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    kind = _KINDS[data]
    lead = np.flatnonzero((data >= 0xE4) & (data <= 0xE9))  # of three bytes; U+4E00 to U+9FFF are among them
    lead = lead[lead + 2 < len(data)]
    point = ((data[lead] & 0x0F).astype(np.int32) << 12) | ((data[lead + 1] & 0x3F).astype(np.int32) << 6) | (data[lead + 2] & 0x3F)
    lead = lead[(point >= 0x4E00) & (point <= 0x9FFF)]
    for i in range(3):
        kind[lead + i] = 2
    before = np.concatenate([kind[:0], np.zeros(min(1, len(kind)), dtype=np.uint8), kind[:-1]])
    before[at[:-1][at[:-1] < len(kind)]] = 0
    begins = (kind != 0) & (kind != before)
    kept = kind != 0
    starts = np.append(np.flatnonzero(begins[kept]), np.count_nonzero(kept)).astype(np.int32)
    tokens_ = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data[kept]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(np.flatnonzero(begins), at).astype(np.int32)), tokens_)


def counted(w: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, count) of each distinct token of each row of token lists, rows ascending, and the tokens by code."""
    tokens_ = w.flatten().dictionary_encode()
    n = max(len(tokens_.dictionary), 1)
    owner = np.repeat(np.arange(len(w)), np.asarray(w.value_lengths().fill_null(0)))
    key, count = np.unique(owner * n + np.asarray(tokens_.indices), return_counts=True)
    return key // n, key % n, count, tokens_.dictionary


def by_part(docs: DataFrame, run: Callable[[pa.Array, pa.ListArray], pa.RecordBatch], schema: StructType, tokenizer: Tokenizer = text.lexical) -> DataFrame:
    """``run(doc_id, token lists)`` of runs of documents with about ``PART`` bytes, a longer one alone. Lexical tokens are cut in Python, others by their expression."""
    own = tokenizer is text.lexical
    rows = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("w")) if own else tokens(docs, tokenizer)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column(1)
            size = pc.binary_length(w) if own else pc.multiply(w.value_lengths().fill_null(0), 8)
            cuts = (np.flatnonzero(np.diff(np.cumsum(np.asarray(size), dtype=np.int64) // PART)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(w)], strict=True):
                if b > a:
                    part = w.slice(a, b - a)
                    yield run(batch.column(0).slice(a, b - a), lexical_lists(part) if own else part)

    return rows.mapInArrow(parts, schema)


def postings(docs: DataFrame, tokenizer: Tokenizer = text.lexical) -> DataFrame:
    """``term, doc_id, tf``. A document's counts are made in its task, so nothing is shuffled."""

    def run(ids: pa.Array, w: pa.ListArray) -> pa.RecordBatch:
        row, code, tf, terms = counted(w)
        return pa.RecordBatch.from_arrays([terms.take(pa.array(code)), ids.take(pa.array(row)), pa.array(tf.astype(np.int32))], names=["term", "doc_id", "tf"])

    return by_part(docs, run, StructType([StructField("term", StringType()), docs.schema["doc_id"], StructField("tf", IntegerType())]), tokenizer)


def corpus_stats(docs: DataFrame, tokenizer: Tokenizer = text.lexical) -> DataFrame:
    """``term_stats`` of the documents' postings; those of a part are added up before they leave Python."""

    def run(ids: pa.Array, w: pa.ListArray) -> pa.RecordBatch:
        _, code, tf, terms = counted(w)
        df, cf = np.bincount(code, minlength=len(terms)), np.bincount(code, weights=tf, minlength=len(terms))
        return pa.RecordBatch.from_arrays([terms, pa.array(df), pa.array(cf.astype(np.int64))], names=["term", "df", "cf"])

    rows = by_part(docs, run, StructType([StructField("term", StringType()), StructField("df", LongType()), StructField("cf", LongType())]), tokenizer)
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def most_frequent(stats: DataFrame, most: int) -> tuple[pa.Table, int]:
    """``term, df`` of all terms of some df or more, ``most`` terms at most, and that df."""
    least, n = 1, 0
    for df, terms in sorted(map(tuple, stats.groupBy("df").count().collect()), reverse=True):  # a row for each df that occurs
        n += terms
        if n > most:
            least = df + 1
            break
    return stats.where(F.col("df") >= least).select("term", "df").toArrow(), least


def matches(docs: DataFrame, terms: list[str], tokenizer: Tokenizer = text.lexical) -> DataFrame:
    """``doc_id, dl, uniq, term, tf`` of the documents that hold some of the terms; no shuffle."""

    def one(t: str) -> Column:
        return F.struct(F.lit(t).alias("term"), F.size(F.filter("w", lambda x: x == t)).alias("tf"))

    rows = tokens(docs, tokenizer).where(F.arrays_overlap("w", F.array(*[F.lit(t) for t in terms])))
    found = F.filter(F.array(*map(one, dict.fromkeys(terms))), lambda p: p["tf"] > 0)
    return rows.select("doc_id", F.size("w").alias("dl"), F.size(F.array_distinct("w")).alias("uniq"), F.explode(found).alias("p")).select("doc_id", "dl", "uniq", "p.term", "p.tf")


def doc_stats(docs: DataFrame, tokenizer: Tokenizer = text.lexical) -> DataFrame:
    return tokens(docs, tokenizer).select("doc_id", F.size("w").alias("dl"), F.size(F.array_distinct("w")).alias("uniq"))


def term_stats(post: DataFrame) -> DataFrame:
    """``term, df, cf``; partial counts are made before the shuffle."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def index_stats(docs: DataFrame) -> DataFrame:
    stats = term_stats(postings(docs))
    terms, total = stats.agg(F.count(F.lit(1))).scalar(), stats.agg(F.sum("df")).scalar()
    sizes = doc_stats(docs).agg(F.count(F.lit(1)).alias("doc_count"), F.round(F.avg("dl"), 6).alias("avg_dl"))
    return sizes.select("doc_count", terms.alias("vocabulary"), total.alias("postings"), F.round(total / terms, 6).alias("avg_postings"), "avg_dl")


def position_lists(docs: DataFrame) -> DataFrame:
    """``term, doc_id, positions`` ascending."""
    return positions(docs).groupBy("term", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def build(docs: DataFrame, path: str, buckets: int = 64) -> None:
    """Write ``postings`` sorted by term within ``buckets`` files, so that term filters skip row groups, and ``doc_stats``."""
    postings(docs).repartition(buckets, "term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    doc_stats(docs).write.mode("overwrite").parquet(f"{path}/doc_stats")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/doc_stats")


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Postings in both, with the left counts."""
    return left.join(right.select("doc_id"), "doc_id", "left_semi")


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Postings in either, with the left counts where both have one."""
    return left.select("doc_id", F.col("tf").alias("l")).join(right.select("doc_id", F.col("tf").alias("r")), "doc_id", "full").select("doc_id", F.coalesce("l", "r").alias("tf"))


def negate(docs: DataFrame, post: DataFrame) -> DataFrame:
    return docs.select("doc_id").join(post, "doc_id", "left_anti").select("doc_id", F.lit(0).alias("tf"))


def field_postings(docs: DataFrame, text_fields: list[str], exact_fields: list[str] = (), multi_fields: list[str] = ()) -> DataFrame:
    """``field, term, doc_id``: text fields by token, exact ones whole and lower-cased, arrays token by token."""

    def named(f: str, terms: Column) -> Column:
        return F.transform(terms, lambda t: F.struct(F.lit(f).alias("field"), t.alias("term")))

    # Strings are made distinct by hashing, structs by comparing all.
    parts = [named(f, F.array_distinct(text.lexical(f))) for f in text_fields]
    parts += [F.when(F.coalesce(F.col(f), F.lit("")) != "", F.array(F.struct(F.lit(f).alias("field"), F.lower(f).alias("term")))) for f in exact_fields]
    parts += [named(f, F.array_distinct(F.flatten(F.transform(f, text.lexical)))) for f in multi_fields]
    every = F.flatten(F.array_compact(F.array(*parts)))
    names = [*text_fields, *exact_fields, *multi_fields]
    return docs.select("doc_id", F.explode(every if len(set(names)) == len(names) else F.array_distinct(every)).alias("p")).select("p.field", "p.term", "doc_id")


def date_range(docs: DataFrame, column: str, low: str, high: str) -> DataFrame:
    """Documents whose date's first ten characters lie between the bounds."""
    return docs.where(F.substring(F.col(column).cast("string"), 1, 10).between(low, high))


def prefix_search(stats: DataFrame, prefix: str) -> DataFrame:
    return stats.where(F.col("term").startswith(prefix))


def wildcard_regex(pattern: str) -> str:
    import re

    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def wildcard_expand(stats: DataFrame, pattern: str, most: int = 50) -> DataFrame:
    """Terms that match, in alphabetical order."""
    return stats.where(F.col("term").rlike("(?i)" + wildcard_regex(pattern))).orderBy("term").limit(most)


def fuzzy_expand(stats: DataFrame, term: str, distance: int = 2, most: int = 50) -> DataFrame:
    """``term, distance`` of terms within an edit distance; lengths are compared before."""
    near = stats.where(F.abs(F.length("term") - len(term)) <= distance)
    d = F.levenshtein(F.lit(term), F.col("term"), distance)
    return near.select("term", d.alias("distance")).where("distance >= 0").orderBy("distance", "term").limit(most)


def keyword_ranking(docs: DataFrame, method: str = "tfidf", top_k: int = 20, least_cf: int = 2, least_df: int = 1, tokenizer: Tokenizer = text.lexical) -> DataFrame:
    """Corpus keywords by ``tfidf``, ``frequency``, ``doc_frequency`` or ``combined``; the texts are read twice, and no posting is shuffled."""
    stats = scratch.saved(corpus_stats(docs, tokenizer), "terms")
    cand = stats.where((F.col("cf") >= least_cf) & (F.col("df") >= least_df))
    total = stats.agg(F.sum("cf").cast("double")).scalar()
    with_any = _holding(docs, cand, tokenizer).agg(F.countDistinct("doc_id")).scalar()
    tf, idf = F.col("cf") / total, F.log((with_any + 1) / (F.col("df") + 1)) + 1
    score = {"tfidf": tf * idf, "frequency": F.col("cf").cast("double"), "doc_frequency": F.col("df").cast("double"), "combined": tf * idf * (1 + F.log(F.col("df") + 1))}[method]
    return cand.select("term", "cf", "df", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "term").limit(top_k)


def _holding(docs: DataFrame, cand: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``doc_id`` of the documents that hold some term of ``cand(term, df)``. Nearly all hold a common one; the terms of the others are joined."""
    common = pa.array([r["term"] for r in cand.orderBy(F.desc("df"), "term").limit(COMMON).collect()], pa.string())

    def run(ids: pa.Array, w: pa.ListArray) -> pa.RecordBatch:
        row, code, _, terms = counted(w)
        hit = np.zeros(len(w), dtype=bool)
        hit[row[np.asarray(pc.is_in(terms, value_set=common).to_numpy(zero_copy_only=False), dtype=bool)[code]]] = True
        left = ~hit[row]
        found, none = np.flatnonzero(hit), np.count_nonzero(hit)
        term = pa.concat_arrays([pa.nulls(none, pa.string()), terms.take(pa.array(code[left]))])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate([found, row[left]]))), term], names=["doc_id", "term"])

    rows = scratch.saved(by_part(docs, run, StructType([docs.schema["doc_id"], StructField("term", StringType())]), tokenizer), "holding")
    others = rows.where("term is not null").join(cand.select("term"), "term", "left_semi")
    return rows.where("term is null").select("doc_id").unionByName(others.select("doc_id"))


def ngram_counts(docs: DataFrame, n: int) -> DataFrame:
    """``ngram, n``."""
    names = [f"t{i}" for i in range(n)]
    return grams(docs, n).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).select(F.array(*names).alias("ngram"), "n")


def grams(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, t0, t1, ...``: n consecutive tokens a row. The token arrays are zipped with themselves shifted, as lambdas aren't compiled."""
    names = [f"t{i}" for i in range(n)]
    cut = tokens(docs).select("doc_id", *[F.slice("w", i + 1, F.greatest(F.size("w") - (n - 1), F.lit(0))).alias(t) for i, t in enumerate(names)])
    return cut.select("doc_id", F.explode(F.arrays_zip(*names)).alias("g")).select("doc_id", *[F.col(f"g.{t}") for t in names])


def patterns(docs: DataFrame, longest: int = 3, least: int = 5, top_k: int = 20) -> DataFrame:
    """Token patterns of two or more by mutual information: log2 of their share over the product of their tokens' shares."""
    single = scratch.saved(ngram_counts(docs, 1).select(F.get("ngram", F.lit(0)).alias("t"), F.col("n").alias("c")), "tokens")
    total = single.agg(F.sum("c").cast("double")).scalar()
    grams = None
    for n in range(2, longest + 1):
        g = ngram_counts(docs, n).where(F.col("n") >= least)
        grams = g if grams is None else grams.unionByName(g)
    parts = grams.select("ngram", "n", F.explode("ngram").alias("t")).join(single, "t")
    mi = F.log2(F.col("n") / total) - F.sum(F.log2(F.col("c") / total))
    scored = parts.groupBy("ngram", "n").agg(F.round(mi, 6).alias("mi"))
    return scored.select(F.array_join("ngram", " ").alias("pattern"), "n", "mi").orderBy(F.desc("mi"), "pattern").limit(top_k)


def compressed_sizes(post: DataFrame) -> DataFrame:
    """``term, raw_bytes, vbyte_bytes, gamma_bits, delta_bits`` of each term's gap list; ids count from 1."""
    gap = F.col("doc_id") - F.coalesce(F.lag("doc_id").over(W.partitionBy("term").orderBy("doc_id")), F.lit(-1))
    g = post.select("term", gap.alias("g"))
    return g.groupBy("term").agg((F.count(F.lit(1)) * 4).alias("raw_bytes"), F.sum(codecs.vbyte_size(F.col("g"))).alias("vbyte_bytes"), F.sum(F.length(codecs.gamma_code(F.col("g")))).alias("gamma_bits"), F.sum(F.length(codecs.delta_code(F.col("g")))).alias("delta_bits"))


def fuzzy_stats(stats: DataFrame, term: str, distance: int = 2) -> DataFrame:
    """``distance, n``: how many terms stand at each edit distance."""
    near = stats.where(F.abs(F.length("term") - len(term)) <= distance).select(F.levenshtein(F.lit(term), F.col("term"), distance).alias("distance"))
    return near.where("distance >= 0").groupBy("distance").agg(F.count(F.lit(1)).alias("n"))


def wildcard_stats(stats: DataFrame, pattern: str) -> DataFrame:
    """``matches, shortest, longest`` of a pattern, and where its fixed part stands."""
    wild = [c in "*?" for c in pattern]
    kind = "exact" if not any(wild) else "prefix" if not wild[0] and all(wild[wild.index(True) :]) else "suffix" if not wild[-1] and all(wild[: wild.index(False)]) and not any(wild[wild.index(False) :]) else "infix"
    found = stats.where(F.col("term").rlike("(?i)" + wildcard_regex(pattern)))
    return found.agg(F.count(F.lit(1)).alias("matches"), F.min(F.length("term")).alias("shortest"), F.max(F.length("term")).alias("longest")).withColumn("kind", F.lit(kind))


def serving_weights(docs: DataFrame, title: str, others: list[str], repeat: int = 3) -> DataFrame:
    """``term, doc_id, tf, w`` of a text in which the title counts ``repeat`` times; w = (1 + log10 tf) * ln(1 + (N - df + .5) / (df + .5))."""
    whole = docs.select("doc_id", F.concat_ws(" ", *[F.col(title)] * repeat, *[F.col(c) for c in others]).alias("text"))
    post = postings(whole)
    n = docs.agg(F.count(F.lit(1)).cast("double")).scalar()
    rows = post.join(term_stats(post).select("term", "df"), "term")
    return rows.select("term", "doc_id", "tf", F.round((1 + F.log10("tf")) * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("w"))


def _prefixes(stats: DataFrame) -> DataFrame:
    """``prefix, is_term`` of every node of the terms' trie but its root."""
    rows = stats.select("term", F.explode(F.sequence(F.lit(1), F.length("term"))).alias("i"))
    return rows.groupBy(F.substring("term", F.lit(1), F.col("i")).alias("prefix")).agg(F.bool_or(F.col("i") == F.length("term")).alias("is_term"))


def trie_stats(stats: DataFrame) -> DataFrame:
    """``terms, nodes, depth, compressed_nodes, chars_per_node``: a compressed node ends a term or branches."""
    nodes = _prefixes(stats)
    below = nodes.groupBy(F.substring("prefix", F.lit(1), F.length("prefix") - 1).alias("prefix")).agg(F.count(F.lit(1)).alias("children"))
    rows = nodes.join(below, "prefix", "left")
    own = F.col("is_term") | (F.coalesce("children", F.lit(0)) != 1)
    out = rows.agg(F.count_if("is_term").alias("terms"), F.count(F.lit(1)).alias("nodes"), F.max(F.length("prefix")).alias("depth"), F.count_if(own).alias("compressed_nodes"))
    return out.withColumn("chars_per_node", F.round(F.col("nodes") / F.col("compressed_nodes"), 6))


def trie_view(stats: DataFrame, prefix: str = "", k: int = 100) -> DataFrame:
    """``node, terms, cf``: the children of a node, those with the most terms first."""
    under = stats.where(F.col("term").startswith(prefix) & (F.length("term") > len(prefix)))
    return under.groupBy(F.substring("term", 1, len(prefix) + 1).alias("node")).agg(F.count(F.lit(1)).alias("terms"), F.sum("cf").alias("cf")).orderBy(F.desc("terms"), "node").limit(k)


def pattern_lookup(docs: DataFrame, patterns_: list[list[str]]) -> DataFrame:
    """``pattern, n, docs``: occurrences of given token sequences and the documents that hold them; one scan, partial sums."""
    joined = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    # Neighbouring occurrences share a space, so it is looked for ahead.
    count = lambda p: F.regexp_count(joined, F.lit(f" {' '.join(p)}(?= )"))
    found = F.array(*[F.struct(F.lit(" ".join(p)).alias("pattern"), count(p).alias("n")) for p in patterns_])
    rows = tokens(docs).select(F.explode(found).alias("f")).where("f.n > 0")
    return rows.groupBy("f.pattern").agg(F.sum("f.n").alias("n"), F.count(F.lit(1)).alias("docs"))


def window_pairs(docs: DataFrame, window: int = 3, least: int = 1) -> DataFrame:
    """``a, b, n``: unequal tokens within ``window`` places of each other, in alphabetical order."""
    pairs = F.flatten(F.transform("w", lambda t, i: F.transform(F.slice("w", i + 2, F.lit(window - 1)), lambda u: F.struct(F.least(t, u).alias("a"), F.greatest(t, u).alias("b")))))
    rows = tokens(docs).select(F.explode(pairs).alias("p")).where("p.a <> p.b")
    return rows.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def field_stats(fields: DataFrame) -> DataFrame:
    """``field, terms, postings, docs`` of field postings; terms and documents are counted apart, each with partial counts before the shuffle."""
    terms = fields.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n")).groupBy("field").agg(F.count("term").alias("terms"), F.sum("n").alias("postings"))
    docs = fields.select("field", "doc_id").distinct().groupBy("field").agg(F.count("doc_id").alias("docs"))
    return terms.join(docs, "field").select("field", "terms", "postings", "docs")


def manifest(docs: DataFrame, version: str = "1") -> DataFrame:
    """``version, documents, digest``: what an index was built from; a stored index serves while its row equals a new one.

    The digest sums a hash of 48 bits of each row modulo 2^63, so the order of rows doesn't matter, nothing is collected and any number of rows fits.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).cast("binary")), 1, 12), 16, 10).cast("decimal(20,0)")
    total = F.sum(h) % F.lit(str(1 << 63)).cast("decimal(20,0)")
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(total, F.lit(0)).cast("long").alias("digest")).select(F.lit(version).alias("version"), "documents", "digest")


def cached(docs: DataFrame, path: str, version: str = "1") -> tuple[DataFrame, DataFrame, bool]:
    """(postings, lengths, whether they were stored already) of an index that is built only if its manifest differs."""
    spark = docs.sparkSession
    now = tuple(manifest(docs, version).first())
    try:
        stored = tuple(spark.read.parquet(f"{path}/manifest").first())
    except Exception as e:  # no such folder yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = None
    if stored != now:
        build(docs, path)
        manifest(docs, version).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return (*load(spark, path), stored == now)


def build_positions(docs: DataFrame, path: str, buckets: int = 64) -> None:
    positions(docs).repartition(buckets, "term").sortWithinPartitions("term", "doc_id", "pos").write.mode("overwrite").parquet(f"{path}/positions")


def stored_bm25(post: DataFrame, lengths: DataFrame, terms: list[str], k: int = 10) -> DataFrame:
    """BM25 from a stored index: the term filter is pushed into the sorted postings, the text isn't read."""
    from tessera.operators import ranking

    hits = post.where(F.col("term").isin(terms)).join(F.broadcast(lengths.sparkSession.createDataFrame([(t, terms.count(t)) for t in dict.fromkeys(terms)], "term string, qtf int")), "term")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, avgdl = lengths.agg(F.count(F.lit(1)).cast("double")).scalar(), lengths.agg(F.avg("dl")).scalar()
    part = F.col("qtf") * F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * (F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / avgdl)))
    rows = hits.join(F.broadcast(df), "term").join(lengths.select("doc_id", "dl"), "doc_id")
    return ranking.top(rows.groupBy("doc_id").agg(F.sum(part).alias("score")), k)
