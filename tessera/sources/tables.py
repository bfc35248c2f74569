"""The article store as tables: create, append what is new, drop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import articles

#: Tables and their columns; ``articles`` lies in folders by source, so a filter on it skips files.
TABLES = {
    "articles": "article_id string, url string, title string, content string, author string, published_date string, category string, content_hash string, loaded_at timestamp, source string",
    "corpus_statistics": "name string, value string",
}


def create(spark: SparkSession, database: str, location: str) -> None:
    spark.sql(f"create database if not exists {database} location '{location}'")
    for name, columns in TABLES.items():
        spark.sql(f"create table if not exists {database}.{name} ({columns}) using parquet" + (" partitioned by (source)" if name == "articles" else ""))


def drop(spark: SparkSession, database: str) -> None:
    spark.sql(f"drop database if exists {database} cascade")


def append_new(rows: DataFrame, database: str) -> None:
    """Add the rows whose content hash the store doesn't have."""
    spark = rows.sparkSession
    new = articles.upsert(rows, spark.table(f"{database}.articles"))
    names = [c.split()[0] for c in TABLES["articles"].split(", ")]
    have = set(new.columns)
    new.select(*[F.current_timestamp().alias(c) if c == "loaded_at" else F.col(c).cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in names]).write.insertInto(f"{database}.articles")


def columns(spark: SparkSession, database: str) -> DataFrame:
    """``table, column, kind`` of the store."""
    rows = [(t, f.name, f.dataType.simpleString()) for t in TABLES for f in spark.table(f"{database}.{t}").schema]
    return spark.createDataFrame(rows, "table string, column string, kind string")
