"""Analytics on search and feedback events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_values(events: DataFrame, key: str, value: str = "value", k: int = 20) -> DataFrame:
    """``key, n, mean`` of the most frequent keys."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean")).orderBy(F.desc("n"), key).limit(k)


def zero_results(events: DataFrame, keys: list[str], empty: Column, k: int = 20) -> DataFrame:
    return events.where(empty).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")).orderBy(F.desc("n"), *keys).limit(k)


def rates(events: DataFrame, group: Column, tries: Column, hits: Column) -> DataFrame:
    """``grp, tries, hits, rate``; no tries, no rate."""
    out = events.groupBy(group.alias("grp")).agg(F.count_if(tries).alias("tries"), F.count_if(hits).alias("hits"))
    return out.withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("tries")), F.lit(0.0)), 6))


def grades(events: DataFrame, grade: Column, most: int = 3) -> DataFrame:
    """``grade, n`` for 0 to ``most``, zeros included."""
    every = events.sparkSession.range(0, most + 1).select(F.col("id").cast("int").alias("grade"))
    counts = events.groupBy(grade.cast("int").alias("grade")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "grade", "left").select("grade", F.coalesce("n", F.lit(0)).alias("n"))


def position_bias(events: DataFrame, rank: Column) -> DataFrame:
    bucket = F.when(rank.isNull() | (rank < 1), "unknown").when(rank == 1, "1").when(rank <= 3, "2-3").when(rank <= 10, "4-10").otherwise("11+")
    return events.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(rank), 6).alias("mean_rank"))


def sessions(events: DataFrame, user: str = "user_id", gap: str = "30 minutes") -> DataFrame:
    """``user, start, n, value`` of runs of a user's events without a longer gap."""
    out = events.groupBy(F.session_window("ts", gap).alias("s"), user).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(user, F.col("s.start").alias("start"), "n", "total")


def duplicates(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def recent(events: DataFrame, k: int = 20) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(k)


def daily(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before each row's time, by one sort within each key."""
    a = left.select(key, at, F.lit(None).cast(dict(right.dtypes)[value]).alias("v"), F.struct(*left.columns).alias("row"), F.lit(1).alias("side"))
    b = right.select(key, at, F.col(value).alias("v"), F.lit(None).cast(a.schema["row"].dataType).alias("row"), F.lit(0).alias("side"))
    upto = W.partitionBy(key).orderBy(at, "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = a.unionByName(b).withColumn("found", F.last("v", ignorenulls=True).over(upto))
    return both.where("side = 1").select("row.*", F.col("found").alias(f"{value}_as_of"))


def top_clicked(clicks: DataFrame, doc: Column, k: int = 20) -> DataFrame:
    """``doc, clicks, users`` of the documents clicked most."""
    return clicks.groupBy(doc.alias("doc")).agg(F.count(F.lit(1)).alias("clicks"), F.countDistinct("user_id").alias("users")).orderBy(F.desc("clicks"), "doc").limit(k)
