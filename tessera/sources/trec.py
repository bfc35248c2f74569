"""TREC run and judgment files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, doc_id, rank, score`` from ``qid Q0 doc rank score tag`` lines."""
    p = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).where(F.size(p) >= 5)
    return rows.select(p[0].alias("query_id"), p[2].alias("doc_id"), p[3].cast("int").alias("rank"), p[4].cast("double").alias("score"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, doc_id, rel`` from ``qid iter doc rel`` lines."""
    p = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).where(F.size(p) >= 4).select(p[0].alias("query_id"), p[2].alias("doc_id"), p[3].cast("double").alias("rel"))


def read_json_run(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, doc_id, rank`` from one JSON object of id lists."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("query_id", "docs"))
    return rows.select("query_id", F.posexplode("docs").alias("pos", "doc_id")).select("query_id", "doc_id", (F.col("pos") + 1).alias("rank"))


def write_run(run: DataFrame, path: str, tag: str = "run") -> None:
    line = F.concat_ws(" ", "query_id", F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), F.col("score").cast("string"), F.lit(tag))
    run.select(line.alias("value")).write.mode("overwrite").text(path)


def export(rows: DataFrame, path: str, form: str = "json") -> None:
    """Result rows as JSON lines or CSV with a header."""
    writer = rows.write.mode("overwrite")
    writer.json(path) if form == "json" else writer.option("header", True).csv(path)
