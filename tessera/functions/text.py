"""Text as columns: everything here stays inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English function words that carry no information.
STOPWORDS = ("a an and are as at be by for from has he in is it its of on or that the to was were will with").split()
# HTML entities that are turned back into characters.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def lexical(text: str | Column) -> Column:
    """Runs of CJK characters or of ASCII letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("([\\u4e00-\\u9fff]+|[a-zA-Z0-9]+)"), F.lit(1))


def lexical_count(text: str | Column) -> Column:
    """The number of ``lexical`` tokens."""
    return F.regexp_count(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("[\\u4e00-\\u9fff]+|[a-zA-Z0-9]+"))


def words(text: str | Column) -> Column:
    """Runs of word characters of any script, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("(?U)(\\b\\w+\\b)"), F.lit(1))


def cjk_bigrams(text: str | Column) -> Column:
    """Overlapping pairs inside runs of CJK characters, other tokens whole: segmentation without a dictionary."""
    def cut(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, 2))
        return F.when(t.rlike("^[\\u4e00-\\u9fff]{2,}$"), pairs).otherwise(F.array(t))

    return F.flatten(F.transform(lexical(text), cut))


def normalised(text: str | Column) -> Column:
    """Lower case, one space for white space, and the common variant of one character."""
    return F.trim(F.regexp_replace(F.lower(F.translate(_c(text), "臺", "台")), "\\s+", " "))


def sentences(text: str | Column) -> Column:
    """Parts between sentence ends, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), "[.!?。！？]+"), lambda s: F.trim(s)), lambda s: s != "")


def without_stopwords(tokens: Column, stopwords: list[str] | None = None, least: int = 1) -> Column:
    stop = F.array(*[F.lit(w) for w in stopwords or STOPWORDS])
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t) & (F.length(t) >= least))


def html_text(html: str | Column) -> Column:
    """The readable text of a page: scripts, styles and comments go, tags part words."""
    out = F.regexp_replace(F.coalesce(_c(html), F.lit("")), "(?is)<(script|style)[^>]*>.*?</\\1>|<!--.*?-->", " ")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def highlight(text: str | Column, terms: list[str], left: str = "<mark>", right: str = "</mark>") -> Column:
    """Escaped text with every term marked; longer terms win, marks are never searched again."""
    import re

    escaped = _c(text)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))
    alternatives = "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return F.regexp_replace(escaped, f"(?i)({alternatives})", f"{left}$1{right}") if terms else escaped


def kwic(text: str | Column, keyword: str, window: int = 50) -> Column:
    """``array<struct<position, before, after>>`` of every place of the keyword, ignoring case, with fixed windows."""
    t = F.coalesce(_c(text), F.lit(""))
    parts = F.split(F.lower(t), F.lit(f"\\Q{keyword.lower()}\\E"), -1)
    n = len(keyword)
    # A place ends where the parts before it, and the keywords between them, end.
    starts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) + (i - 1) * n)
    found = F.transform(starts, lambda p: F.struct(p.alias("position"), F.substring(t, F.greatest(p - window, F.lit(0)) + 1, F.least(p, F.lit(window))).alias("before"), F.substring(t, p + n + 1, F.lit(window)).alias("after")))
    return F.when(F.size(parts) > 1, found).otherwise(F.array().cast("array<struct<position:int,before:string,after:string>>"))


def best_window(text: str | Column, terms: list[str], width: int = 180) -> Column:
    """The sentence with the most of the terms (the first of equals), cut to ``width``."""
    hits = lambda s: sum((F.lower(s).contains(t.lower()).cast("int") for t in terms), F.lit(0))
    ranked = F.transform(sentences(text), lambda s, i: F.struct((-hits(s)).alias("h"), i.alias("i"), F.substring(s, 1, width).alias("s")))
    return F.array_min(ranked)["s"]


def phonetic(text: str | Column) -> Column:
    """Sound codes of a text's words, separated by spaces."""
    return F.array_join(F.transform(lexical(text), F.soundex), " ")


def phonetic_similarity(a: Column, b: Column) -> Column:
    """Equal codes at equal places, over the longer code list."""
    x, y = F.split(a, " "), F.split(b, " ")
    same = F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce((p == q).cast("int"), F.lit(0))), F.lit(0), lambda s, v: s + v)
    return same / F.greatest(F.size(x), F.size(y))


def ngrams(tokens: Column, n: int) -> Column:
    """Arrays of n consecutive tokens; none where there are fewer."""
    grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.slice(tokens, i, F.lit(n)))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<array<string>>"))


def prefix_similarity(a: Column, b: Column) -> Column:
    """Common leading characters over the mean length."""
    x, y = F.split(a, ""), F.split(b, "")
    run = F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce((p == q).cast("int"), F.lit(0))), F.struct(F.lit(0).alias("n"), F.lit(1).alias("on")), lambda s, v: F.struct((s["n"] + s["on"] * v).alias("n"), (s["on"] * v).alias("on")))
    return run["n"] / ((F.length(a) + F.length(b)) / 2)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def simhash(tokens: Column) -> Column:
    """64 bits as a long: each is the sign of the sum over tokens of that md5 bit as +1 or -1; 0 for no tokens."""
    hashes = F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 17, 16), 16, -10).cast("long"))
    zero = F.array_repeat(F.lit(0), 64)
    sums = F.aggregate(hashes, zero, lambda acc, h: F.transform(acc, lambda v, i: v + F.when(h.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0, 1).otherwise(-1)))
    return F.aggregate(sums, F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("i")), lambda s, v: F.struct(s["h"].bitwiseOR(F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), s["i"])).otherwise(F.lit(0).cast("long"))).alias("h"), (s["i"] + 1).alias("i")))["h"]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def filtered(tokens: Column, stopwords: list[str] | None = None, least: int = 2) -> Column:
    """Tokens of ``least`` characters or more that are neither stopwords nor numbers."""
    return F.filter(without_stopwords(tokens, stopwords, least), lambda t: ~t.rlike("^[0-9]+$"))


def significant(tokens: Column, protected: list[str] = (), stopwords: list[str] | None = None) -> Column:
    """Tokens that carry information, and the protected ones whatever they are."""
    stop = list(stopwords or STOPWORDS)
    return F.filter(tokens, lambda t: t.isin(list(protected)) | (~t.isin(stop) & (F.length(t) > 1) & ~t.rlike("^[0-9]+$")))


def stopword_counts(rows: DataFrame, stopwords: list[str]) -> DataFrame:
    """``term, n`` of the stopwords in ``rows(w)``; the list may be any, so words are added or taken out by passing another."""
    found = rows.select(F.explode(F.filter("w", lambda t: t.isin(list(stopwords)))).alias("term"))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def classify(rows: DataFrame, column: str, aliases: dict[str, str], other: str = "other", unknown: str = "unknown") -> DataFrame:
    """``rows`` with ``class``: the alias's class of a trimmed, lower-cased value; ``other`` where it has none, ``unknown`` where there is no value."""
    value = F.lower(F.trim(F.col(column)))
    table = F.create_map(*[F.lit(x) for a, c in aliases.items() for x in (a.lower(), c)])
    return rows.withColumn("class", F.when(F.coalesce(value, F.lit("")) == "", unknown).otherwise(F.coalesce(F.try_element_at(table, value), F.lit(other))))


def neighbour_jaccard(docs: DataFrame) -> DataFrame:
    """``doc_id, other, similarity`` of the token sets of documents whose ids follow each other."""
    rows = docs.select("doc_id", F.array_distinct(lexical("text")).alias("w"))
    nxt = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("other"), F.col("w").alias("v"))
    return rows.join(nxt, "doc_id").select("doc_id", "other", F.round(jaccard(F.col("w"), F.col("v")), 6).alias("similarity"))
