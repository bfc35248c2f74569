"""Article files: JSONL in, validated and deduplicated rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ARTICLE = "article_id string, url string, source string, source_name string, crawled_at string, title string, content string, author string, published_date string, category string, tags array<string>"
# Other names under which a column arrives, first of them wins.
ALTERNATES = {"content": ["content", "content_clean", "text", "body"], "title": ["title", "headline"], "url": ["url", "link"], "published_date": ["published_date", "published_at", "date"], "source": ["source", "source_name"]}


def read_jsonl(spark: SparkSession, paths: str | list[str], *, limit: int | None = None, schema: str = ARTICLE) -> DataFrame:
    """Rows with content of one object a line; broken lines are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(paths)
    rows = rows.where("_bad is null and coalesce(content, '') <> ''").drop("_bad")
    return rows.limit(limit) if limit else rows


def file_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("source").alias("sources"), F.countDistinct("category").alias("categories"), F.min("published_date").alias("first"), F.max("published_date").alias("last"))


def normalised(raw: DataFrame) -> DataFrame:
    """Coalesce alternate columns; trim; keep the others."""
    out = raw
    for name, names in ALTERNATES.items():
        have = [F.when(F.trim(F.col(n)) != "", F.trim(F.col(n))) for n in names if n in raw.columns]
        out = out.withColumn(name, F.coalesce(*have) if have else F.lit(None).cast("string"))
    return out


def content_hash(title: Column, content: Column) -> Column:
    return F.md5(F.concat_ws("\n", title, content).cast("binary"))


def dedup_hash(title: Column, url: Column) -> Column:
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.md5(F.concat_ws("||", low(title), low(url)).cast("binary"))


def tags(value: Column) -> Column:
    """An array from text separated by commas, without empty parts."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def issues(rows: DataFrame, key: str = "article_id", title: str = "title", content: str = "content") -> DataFrame:
    """``key, issue`` of rows that miss a field or have it too short."""
    found = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim(title), F.lit("")) == "", "missing_title").when(F.length(F.trim(title)) < 2, "title_too_short"),
            F.when(F.coalesce(F.trim(content), F.lit("")) == "", "missing_content").when(F.length(F.trim(content)) < 20, "content_too_short"),
        )
    )
    return rows.select(key, F.explode(found).alias("issue"))


def iso_date(value: Column) -> Column:
    """The date as yyyy-MM-dd from dashes, slashes (padded or not) or a timestamp; else null."""
    part = F.regexp_extract(value, r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})", 0)
    piece = lambda i: F.lpad(F.regexp_extract(value, r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})", i), 2, "0")
    return F.when(part != "", F.concat_ws("-", F.regexp_extract(value, r"^(\d{4})", 1), piece(2), piece(3)))


def build_corpus(raw: DataFrame, *, order: str, most: int | None = None, most_per_source: int | None = None) -> DataFrame:
    """Valid rows, the first of each dedup hash, capped in total and per source in order."""
    rows = normalised(raw).where("length(title) >= 2 and length(content) >= 20")
    rows = rows.withColumn("dedup_hash", dedup_hash(F.col("title"), F.col("url")))
    rows = rows.withColumn("_r", F.row_number().over(W.partitionBy("dedup_hash").orderBy(order))).where("_r = 1").drop("_r")
    if most_per_source:
        rows = rows.withColumn("_r", F.row_number().over(W.partitionBy("source").orderBy(order))).where(F.col("_r") <= most_per_source).drop("_r")
    return rows.orderBy(order).limit(most) if most else rows


def upsert(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows whose content hash the table doesn't have, one each: append these."""
    keyed = rows.withColumn("content_hash", content_hash(F.col("title"), F.col("content")))
    return keyed.dropDuplicates(["content_hash"]).join(table.select("content_hash"), "content_hash", "left_anti")


def merge(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_folder(spark: SparkSession, folder: str, *, most_per_file: int | None = None, most: int | None = None, schema: str = ARTICLE) -> DataFrame:
    """All JSONL files of a folder in order of their names; limits count rows with content.

    A folder of part files, as Spark writes it, counts as one file, so no task has to write or read it whole.
    """
    path = F.col("_metadata.file_path")
    rows = read_jsonl(spark, folder, schema=schema).select("*", F.regexp_replace(path, "/part-[^/]*$", "").alias("_file"), path.alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    order = ["_path", "_start", "_row"]
    if most_per_file:
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("_file").orderBy(*order))).where(F.col("_n") <= most_per_file).drop("_n")
    rows = rows.orderBy("_file", *order).limit(most) if most else rows
    return rows.drop("_file", *order)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def scan(table: DataFrame, *, source: str | None = None, category: str | None = None, order: str = "published_date", limit: int | None = None) -> DataFrame:
    """Rows by source and category, newest first; the filters reach the reader."""
    rows = table
    for column, value in (("source", source), ("category", category)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.orderBy(F.desc(order)).limit(limit) if limit else rows


def lookup(table: DataFrame, keys: DataFrame | list, column: str) -> DataFrame:
    """Rows whose key is among the given ones: a filter for a list, a semi join for a table."""
    if isinstance(keys, DataFrame):
        return table.join(keys.select(column), column, "left_semi")
    return table.where(F.col(column).isin(keys))


def corpus_stats(rows: DataFrame) -> DataFrame:
    """``articles, sources, categories`` of a table."""
    return rows.agg(F.count(F.lit(1)).alias("articles"), F.countDistinct("source").alias("sources"), F.countDistinct("category").alias("categories"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; one aggregation, no sort."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def dense_ids(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``serving_id`` 0..n-1 in order: ids within partitions plus the sizes of those before them, so no task holds all rows."""
    spark = rows.sparkSession
    part = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order)
    placed = part.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row a partition
    return placed.join(F.broadcast(before), "_p").withColumn("serving_id", F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def cleaned(rows: DataFrame, columns: list[str]) -> DataFrame:
    """White space collapsed in the named columns."""
    return rows.withColumns({c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "\\s+", " ")) for c in columns})


def log_events(events: DataFrame, path: str) -> None:
    """Append events to a folder by day, in whole files: readers never see half a batch."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def ingestion_stats(rows: DataFrame, key: str) -> DataFrame:
    """``processed, indexed, duplicates, duplicate_pct`` of rows that are indexed once a key."""
    out = rows.agg(F.count(F.lit(1)).alias("processed"), F.countDistinct(key).alias("indexed")).withColumn("duplicates", F.col("processed") - F.col("indexed"))
    return out.withColumn("duplicate_pct", F.round(F.coalesce(F.try_divide(100.0 * F.col("duplicates"), F.col("processed")), F.lit(0.0)), 4))
